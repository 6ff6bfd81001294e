"""Lags, leads, windows and run-aligned sequences."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.operators.ordering import first_rows, latest_before, over_frames, positions


def lag_steps(horizon: int, lookback: int, every_row: bool = False) -> list[int]:
    """Lags from the horizon to the lookback, one per row or one per horizon."""
    return list(range(horizon, lookback + 1, 1 if every_row else horizon))


def lag_features(
    df: DataFrame, by: Sequence[str], pos: str, col: str, lags: Sequence[int], block: int = 4096
) -> DataFrame:
    """``{col}_lag_{n}``: the value n rows earlier. ``pos`` counts rows within the key."""
    made = {f"{col}_lag_{n}": (lambda w, n=n: F.lag(col, n).over(w)) for n in lags}
    return over_frames(df, by, pos, made, before=max(lags), block=block)


def run_lag_features(
    runs: DataFrame, by: Sequence[str], ts: str, col: str, lags: Sequence[int], chunk: Column
) -> DataFrame:
    """Lags over the mean per valid time of overlapping runs, joined back to the run rows."""
    mean = runs.groupBy(*by, ts).agg(F.avg(col).alias(col))
    placed = positions(mean, by, [ts], chunk, into="_pos")
    lagged = lag_features(placed, by, "_pos", col, lags)
    names = [f"{col}_lag_{n}" for n in lags]
    return runs.join(lagged.select(*by, ts, *names), [*by, ts], "left")


def lead_columns(df: DataFrame, by: Sequence[str], pos: str, col: str, horizon: int) -> DataFrame:
    """``{col}_t1 .. {col}_tH``; rows without a complete future are dropped."""
    names = {f"{col}_t{n}": (lambda w, n=n: F.lead(col, n).over(w)) for n in range(1, horizon + 1)}
    return over_frames(df, by, pos, names, after=horizon).na.drop(subset=[*names])


def sliding_windows(
    df: DataFrame, by: Sequence[str], pos: str, ts: str, cols: Sequence[str], length: int, step: int = 1,
    block: int = 4096, times: bool = False,
) -> DataFrame:
    """Arrays of ``length`` rows starting every ``step`` rows; only full windows are kept.

    ``pos`` starts at 1 in every series. Missing values stay in place as nulls.
    """
    def frame(w):
        return F.collect_list(F.struct(ts, *cols)).over(w.rowsBetween(0, length - 1))

    rows = over_frames(df, by, pos, {"_window": frame}, after=length - 1, block=block)
    rows = rows.filter((F.size("_window") == length) & ((F.col(pos) - 1) % step == 0))
    arrays = [F.col("_window")[c].alias(c) for c in cols]
    if times:
        arrays.append(F.col("_window")[ts].alias("_times"))
    return rows.select(*by, F.col(ts).alias("window_start"), *arrays)


def history_future_windows(
    df: DataFrame, by: Sequence[str], pos: str, ts: str, known: Sequence[str], observed: Sequence[str],
    target: str, history: int, future: int, step: int = 1,
) -> DataFrame:
    """``known`` over history and future, ``observed`` over the history, ``y`` over the future."""
    cols = list(dict.fromkeys([*known, *observed, target]))
    rows = sliding_windows(df, by, pos, ts, cols, history + future, step, times=True)
    past = [F.slice(c, 1, history).alias(f"observed_{c}") for c in observed]
    ahead = [F.col(c).alias(f"known_{c}") for c in known]
    y = F.slice(target, history + 1, future).alias("y")
    return rows.select(*by, F.col("_times")[history].alias("forecast_start"), *ahead, *past, y)


def run_sequences(
    frame: DataFrame, by: Sequence[str], known: str, observed: str, target: str, history: int, future: int
) -> DataFrame:
    """One sample per complete run: past runs and the run itself, observations, target.

    ``frame`` has ``starttime, forecasttime, timestamp``. A run's sample is made of its
    leads 1 to ``future``, all of which must be there; longer runs go on beyond it. The past
    runs start exactly ``k * future`` hours earlier; every hour of the history before the
    first valid time must be observed. Samples with a gap are left out.
    """
    step = F.struct("forecasttime", "timestamp", known, target)
    inside = F.col("forecasttime") <= future
    runs = frame.filter(inside).groupBy(*by, "starttime").agg(F.sort_array(F.collect_list(step)).alias("_run"))
    runs = runs.filter(F.size("_run") == future)
    out = runs.select(
        *by, "starttime", F.col("_run")[known].alias("_now"), F.col("_run")[target].alias("y"),
        F.col("_run.timestamp")[0].alias("_first"),
    )
    parts = [F.col("_now")]
    for k in range(1, math.ceil(history / future) + 1):
        later = F.timestamp_seconds(F.unix_timestamp("starttime") + k * future * 3600)
        past = runs.select(*by, later.alias("starttime"), F.col("_run")[known].alias(f"_past{k}"))
        out = out.join(past, [*by, "starttime"])
        parts.insert(0, F.col(f"_past{k}"))
    seen = frame.groupBy(*by, "timestamp").agg(
        F.min_by(observed, F.struct("starttime", "forecasttime")).alias("_seen")
    )
    hours = F.transform(
        F.sequence(F.lit(history), F.lit(1), F.lit(-1)),
        lambda h: F.timestamp_seconds(F.unix_timestamp("_first") - h * 3600),
    )
    needed = out.select(*by, "starttime", F.explode(hours).alias("timestamp"))
    past_values = (
        needed.join(seen, [*by, "timestamp"])
        .groupBy(*by, "starttime")
        .agg(F.sort_array(F.collect_list(F.struct("timestamp", "_seen"))).alias("_obs"))
        .filter(F.size("_obs") == history)
    )
    return out.join(past_values, [*by, "starttime"]).select(
        *by, "starttime", F.concat(*parts).alias("known"), F.col("_obs._seen").alias("observed"), "y"
    )


def nearest_in_time(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, tolerance_s: int
) -> DataFrame:
    """Nearest right time per left time, the earlier one on ties; none beyond the tolerance.

    Both sides are cut into bins as wide as the tolerance and meet in three of them.
    """
    far = F.unix_timestamp(left_time) / tolerance_s
    near = [F.floor(far) + d for d in (-1, 0, 1)]
    probes = left.select(*by, left_time).distinct().withColumn("_bin", F.explode(F.array(*near)))
    marks = right.select(*by, right_time).distinct().withColumn(
        "_bin", F.floor(F.unix_timestamp(right_time) / tolerance_s)
    )
    gap = F.abs(F.unix_timestamp(left_time) - F.unix_timestamp(right_time))
    pairs = probes.join(marks, [*by, "_bin"]).withColumn("_gap", gap).filter(F.col("_gap") <= tolerance_s)
    best = first_rows(pairs, [*by, left_time], ["_gap", right_time]).select(*by, left_time, right_time)
    return left.join(best, [*by, left_time], "left")


def run_pairs(
    runs: DataFrame, series: DataFrame, by: Sequence[str], value: str, history: int, future: int,
    tolerance_s: int = 3 * 3600,
) -> DataFrame:
    """Each run with its history run and the first ``reason`` against using it.

    ``runs`` has ``starttime``, ``series`` hourly ``timestamp`` rows per key. Reasons in
    order: ``no_timestamp``, ``bounds``, ``no_history``, ``missing``, else ``valid``.
    """
    span = series.groupBy(*by).agg(F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to"))
    start = F.unix_timestamp("starttime")
    keyed = runs.join(span, [*by]) if by else runs.withColumns(
        {c: span.select(c).scalar() for c in ("_from", "_to")}
    )
    goal = keyed.withColumn("_goal", F.timestamp_seconds(start - history * 3600))
    own = runs.select(*by, F.col("starttime").alias("history_run"))
    paired = nearest_in_time(goal, own, by, "_goal", "history_run", tolerance_s)
    offsets = F.sequence(F.lit(-history), F.lit(future - 1))
    hours = runs.select(*by, "starttime", F.explode(offsets).alias("_h")).withColumn(
        "timestamp", F.timestamp_seconds(start + F.col("_h") * 3600)
    )
    known = series.select(*by, "timestamp", F.col(value).isNotNull().alias("_ok"))
    seen = hours.join(known, [*by, "timestamp"]).groupBy(*by, "starttime").agg(
        F.count_if("_ok").alias("_n"), F.count_if(F.col("_h") == 0).alias("_at")
    )
    out = paired.join(seen, [*by, "starttime"], "left")
    bounded = (F.unix_timestamp("_from") <= start - history * 3600) & (
        F.unix_timestamp("_to") >= start + (future - 1) * 3600
    )
    reason = (
        F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, "no_timestamp")
        .when(~bounded, "bounds")
        .when(F.col("history_run").isNull(), "no_history")
        .when(F.coalesce(F.col("_n"), F.lit(0)) < history + future, "missing")
        .otherwise("valid")
    )
    return out.select(*by, "starttime", "history_run", reason.alias("reason"))


# -- cubic gap filling ---------------------------------------------------------

# A knot moves the spline 40 knots away by less than 0.27**40, far below double
# precision, so a block with this halo gives the values of the whole-series spline.
SPLINE_HALO = 40


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic not-a-knot spline through (x, y); NaN outside the knots."""
    n = len(x)
    if n < 4:
        return np.where((at >= x[0]) & (at <= x[-1]), np.interp(at, x, y), np.nan)
    h = np.diff(x)
    system, right = np.zeros((n, n)), np.zeros(n)
    mid = np.arange(1, n - 1)
    system[mid, mid - 1], system[mid, mid], system[mid, mid + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    right[mid] = 6 * np.diff(np.diff(y) / h)
    system[0, :3] = h[1], -(h[0] + h[1]), h[0]
    system[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    bend = np.linalg.solve(system, right)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    left, back = at - x[i], x[i + 1] - at
    out = (bend[i] * back**3 + bend[i + 1] * left**3) / (6 * h[i])
    out += (y[i] / h[i] - bend[i] * h[i] / 6) * back + (y[i + 1] / h[i] - bend[i + 1] * h[i] / 6) * left
    return np.where((at >= x[0]) & (at <= x[-1]), out, np.nan)


def interpolate_cubic(
    df: DataFrame, by: Sequence[str], pos: str, col: str, block: int = 512
) -> DataFrame:
    """Fill inner gaps with a cubic spline over ``pos``; leading and trailing gaps stay.

    Knots are numbered per series and cut into blocks with a halo on both sides, so a
    long series is many tasks.
    """
    rows = df.select(*by, pos, F.col(col).alias("_y"))
    chunk = F.floor(F.col(pos) / block)
    knots = positions(rows.filter("_y IS NOT NULL"), by, [pos], chunk, into="_k")
    gaps = rows.filter("_y IS NULL")
    placed = latest_before(
        gaps.select(*by, pos), knots.select(*by, F.col(pos).alias("_at"), "_k"), by, pos, "_at", ["_k"],
        chunk=lambda t: F.floor(t / block),
    ).filter("_k IS NOT NULL")
    first, last = (F.floor((F.col("_k") + d) / block) for d in (-SPLINE_HALO - 1, SPLINE_HALO))
    # a long outage hangs on one knot, so the rows to fill are cut by position as well
    wanted = placed.select(
        *by, pos, F.lit(None).cast("double").alias("_y"), F.floor(F.col("_k") / block).alias("_block"),
        F.floor(F.col(pos) / (16 * block)).alias("_part"),
    )
    tasks = wanted.select(*by, "_block", "_part").distinct()
    shared = knots.withColumn("_block", F.explode(F.sequence(first, last))).join(tasks, [*by, "_block"])
    rows = wanted.unionByName(shared.select(*by, pos, "_y", "_block", "_part"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        known, hole = pdf[pdf["_y"].notna()].sort_values(pos), pdf[pdf["_y"].isna()]
        if len(hole) and len(known):
            values = spline_values(
                known[pos].to_numpy(float), known["_y"].to_numpy(float), hole[pos].to_numpy(float)
            )
            hole = hole.assign(_y=values)
        return hole[[*by, pos, "_y"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by, pos, "_y").schema)
    filled = rows.groupBy(*by, "_block", "_part").applyInPandas(solve, schema)
    filled = filled.withColumn("_y", F.nanvl("_y", F.lit(None).cast("double")))
    out = df.join(filled, [*by, pos], "left")
    return out.withColumn(col, F.coalesce(F.col(col), F.col("_y"))).select(*df.columns)
