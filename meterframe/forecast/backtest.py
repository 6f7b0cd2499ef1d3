"""Two-phase evaluation protocol (F8) and scoring by model name.

Phase ``validation``: fit on train (last ``lookback`` rows per series), forecast
the validation hours, score.  Phase ``test``: refit on train + validation (the
lookback re-applied), forecast the test hours, score.  Each phase is fitted
once: its model table is written, and forecasts and scores read it.

Horizon (trap T8): ``"count"`` forecasts as many hours as the split has
distinct timestamps, starting after the last history hour (the reference;
with a removed day inside the split the last hours are never scored);
``"span"`` forecasts up to the split's last hour (default).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, panel
from ..operators.resample import time_bounds
from ..schema import CLIENT, MODEL, SPLIT, TS, Y
from ..sources.sinks import stored
from . import jobs

PHASE = "phase"


def horizon(target: DataFrame, mode: str = "span") -> dict:
    """Keyword arguments of :func:`jobs.forecast` for the hours of ``target``."""
    if mode == "count":
        return {"hours": panel.horizon(target)}
    if mode == "span":
        return {"until": time_bounds(target)[1]}
    raise ValueError(f"unknown horizon mode {mode!r}")


def horizon_axis(history: DataFrame, target: DataFrame, mode: str = "span") -> DataFrame:
    return jobs.future_axis(history, **horizon(target, mode))


def fit_phase(history: DataFrame, model: str, lookback: int | None) -> DataFrame:
    """The stored model table of one phase."""
    return stored(jobs.fit(jobs.recent(history, lookback), model), "model-table")


def run_phase(history: DataFrame, target: DataFrame, model: str, lookback: int | None,
              mode: str = "span", digits: int | None = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, metrics, model table) of one phase.  Only hours with both an
    actual and a prediction are scored (J2)."""
    table = fit_phase(history, model, lookback)
    preds = jobs.forecast(table, model, **horizon(target, mode))
    pairs = evaluate.scored(target.select(CLIENT, TS, Y), preds.drop(MODEL), generated=True)
    return preds, evaluate.metrics_table(pairs, null_safe=False, digits=digits), table


def backtest(panel_df: DataFrame, model: str, lookback: int | None = 672,
             mode: str = "span", digits: int | None = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F8 over a panel with a ``split`` column: predictions, metrics and model
    tables, each with a ``phase`` column."""
    cols = [CLIENT, TS, Y]
    train = panel_df.where(F.col(SPLIT) == "train").select(*cols)
    val = panel_df.where(F.col(SPLIT) == "validation").select(*cols)
    test = panel_df.where(F.col(SPLIT) == "test").select(*cols)
    phases = [run_phase(train, val, model, lookback, mode, digits),
              run_phase(panel.union_history(train, val), test, model, lookback, mode, digits)]
    return tuple(a.withColumn(PHASE, F.lit("validation")).unionByName(b.withColumn(PHASE, F.lit("test")))
                 for a, b in zip(*phases, strict=True))


def predictions_by_name(names: list[str], history: DataFrame, target: DataFrame,
                        lookback: int | None = 672, mode: str = "span") -> DataFrame:
    """forecasts of several registered models through one interface,
    long (``model`` is a column)."""
    hist = jobs.recent(history, lookback)
    ahead = horizon(target, mode)
    out = None
    for name in names:
        p = jobs.forecast(stored(jobs.fit(hist, name), "model-table"), name, **ahead)
        out = p if out is None else out.unionByName(p)
    return out
