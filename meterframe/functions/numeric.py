"""Numeric scalar helpers: lenient parsing, NaN handling, stable rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(col) -> Column:
    """NaN -> NULL.  Spark's ``avg``/``sum`` propagate NaN; missing must be
    NULL everywhere in this library (trap T4)."""
    return F.nanvl(_c(col), F.lit(None))


def lenient_float(col) -> Column:
    """Text cell -> FLOAT, accepting both decimal comma and point; anything
    unparseable becomes NULL (S4).  Decided per cell, not per column
    (deliberate deviation T2)."""
    txt = F.trim(_c(col).cast("string"))
    return nan_to_null(F.regexp_replace(txt, ",", ".").try_cast("float"))


def lenient_timestamp(col) -> Column:
    """Text -> TIMESTAMP_NTZ, NULL when unparseable (S3)."""
    return F.trim(_c(col).cast("string")).try_cast("timestamp_ntz")


def round_half_up(col, digits: int = 4) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` as DOUBLE.

    Gives the same digits in Spark and DuckDB, which ``round`` on doubles does
    not (trap T6).  ``+ 0.0`` turns a negative zero into zero.  NaN gives
    NULL; infinities and values so large that they have no such digits
    (``|x| * 10^d >= 2^53``) are returned as they are."""
    scale = float(10 ** digits)
    x = _c(col).cast("double")
    return (F.when(F.isnan(x), F.lit(None))
            .when(F.abs(x) * scale >= float(2 ** 53), x)
            .otherwise(F.floor(x * scale + 0.5) / scale + F.lit(0.0)))
