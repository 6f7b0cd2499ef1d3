"""Calendar features of an hourly timestamp.

Fixed values that must equal the reference's feature set (names and order):
hour_sin, hour_cos, dow_sin, dow_cos, is_weekend, month_sin, month_cos.
Day of week counts Monday = 0; weekend is day of week >= 5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timefns import weekday0

# The exogenous calendar columns, in the reference's order.
CALENDAR_COLS = ["hour_sin", "hour_cos", "dow_sin", "dow_cos",
                 "is_weekend", "month_sin", "month_cos"]


def calendar_columns(ts: str | Column = "ts") -> dict[str, Column]:
    t = F.col(ts) if isinstance(ts, str) else ts
    two_pi = 2.0 * F.pi()
    hour = F.hour(t).cast("double")
    dow = weekday0(t).cast("double")
    month = F.month(t).cast("double")
    return {
        "hour_sin": F.sin(two_pi * hour / 24.0),
        "hour_cos": F.cos(two_pi * hour / 24.0),
        "dow_sin": F.sin(two_pi * dow / 7.0),
        "dow_cos": F.cos(two_pi * dow / 7.0),
        "is_weekend": (weekday0(t) >= 5).cast("int"),
        "month_sin": F.sin(two_pi * month / 12.0),
        "month_cos": F.cos(two_pi * month / 12.0),
    }


def with_calendar(df, ts: str = "ts", cols: list[str] | None = None):
    """Add the calendar columns computed from ``ts`` (narrow, no join)."""
    feats = calendar_columns(ts)
    return df.withColumns({k: feats[k] for k in (cols or CALENDAR_COLS)})

