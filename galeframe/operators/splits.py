"""Leakage-free splits of series, runs, stations and clients."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.operators.neighbours import k_nearest
from galeframe.operators.ordering import first_rows, positions

QUARTER = 900


def _ts(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def split_at(ts: Column | str, test_start: datetime | Column, test_end: datetime | Column | None = None) -> Column:
    """``train`` up to 15 minutes before the test start, ``test`` from it on, else null.

    Between the two nothing is used; run frames pass their start time.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    start = _ts(test_start)
    inside = (ts >= start) if test_end is None else (ts >= start) & (ts <= _ts(test_end))
    train = F.unix_micros(ts) <= F.unix_micros(start) - QUARTER * 1_000_000
    return F.when(train, "train").when(inside, "test")


def split_runs_at(start_col: Column | str, test_start: datetime | Column, test_end: datetime | Column | None = None) -> Column:
    """Like ``split_at`` for run starts: everything before the test start trains."""
    start = F.col(start_col) if isinstance(start_col, str) else start_col
    role = F.when(start < _ts(test_start), "train")
    inside = F.lit(True) if test_end is None else start <= _ts(test_end)
    return role.when(inside, "test")


def fraction_boundary(
    df: DataFrame, by: Sequence[str], ts: str, fraction: float, chunk: Column, hour: int = 0
) -> DataFrame:
    """``by, test_start``: midnight plus ``hour`` of the row that ends the training fraction."""
    placed = positions(df, by, [ts], chunk, "_p", "_n")
    last = placed.filter(F.col("_p") == F.floor(F.col("_n") * fraction))
    day = F.date_trunc("day", ts)
    return last.select(*by, F.timestamp_seconds(F.unix_timestamp(day) + hour * 3600).alias("test_start"))


def history_start(test_start: Column | str, history_hours: float) -> Column:
    """Test start moved back so that the first window has its whole history."""
    start = F.col(test_start) if isinstance(test_start, str) else test_start
    return F.timestamp_seconds(F.unix_timestamp(start) - int(history_hours * 3600))


def _tail_fold(pos: Column, total: Column, k: int) -> Column:
    """Validation fold of a 1-based position; null for rows that only ever train."""
    size = F.floor(total / (k + 1))
    into = pos - 1 - (total - k * size)
    return F.when((into >= 0) & (size > 0), F.floor(F.try_divide(into, size))).cast("int")


def time_series_folds(
    df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, chunk: Column, into: str = "val_fold"
) -> DataFrame:
    """Expanding-window folds with test size ``n // (k + 1)`` at the end of each series.

    A row validates in ``val_fold`` and trains in every later fold; rows with a null
    train in all folds. ``fold_roles`` spells this out.
    """
    placed = positions(df, by, order, chunk, "_p", "_n")
    return placed.withColumn(into, _tail_fold(F.col("_p"), F.col("_n"), k)).drop("_p", "_n")


def fold_roles(df: DataFrame, k: int, val_fold: str = "val_fold") -> DataFrame:
    """One row per fold a row takes part in, with ``fold`` and ``role``."""
    first = F.coalesce(F.col(val_fold), F.lit(0))
    out = df.withColumn("fold", F.explode(F.sequence(first, F.lit(k - 1))))
    role = F.when(F.col(val_fold) == F.col("fold"), "val").otherwise("train")
    return out.withColumn("role", role)


def folds_with_training_block(
    df: DataFrame, by: Sequence[str], ts: str, min_train: datetime, k: int, chunk: Column
) -> DataFrame:
    """Rows up to ``min_train`` always train; the rest of each series is folded on its own."""
    block = F.col(ts) <= _ts(min_train)
    rest = time_series_folds(df.filter(~block), by, [ts], k, chunk)
    return df.filter(block).withColumn("val_fold", F.lit(None).cast("int")).unionByName(rest)


def holdout_folds(df: DataFrame, order: Sequence[str], k: int, chunk: Column) -> DataFrame:
    """Held-out samples of all stations in time order, cut in ``k + 1`` chunks.

    Fold f validates on chunk f + 1; the last one takes the remainder, and chunk 0 is unused (null).
    """
    placed = positions(df, [], order, chunk, "_p", "_n")
    size = F.floor(F.col("_n") / (k + 1))
    chunk_no = F.least(F.floor(F.try_divide(F.col("_p") - 1, size)), F.lit(k))
    return placed.withColumn("val_fold", F.when(chunk_no >= 1, chunk_no - 1).cast("int")).drop("_p", "_n")


def duration_fold(ts: Column | str, first: datetime | Column, test_start: datetime | Column, k: int) -> Column:
    """Fold by equal durations between ``first`` and the test start; null before and after."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    begin, end = F.unix_timestamp(_ts(first)), F.unix_timestamp(_ts(test_start))
    number = F.floor((F.unix_timestamp(ts) - begin) * (k + 1) / (end - begin)) - 1
    return F.when((number >= 0) & (number < k), number.cast("int"))


def fraction_holdout(df: DataFrame, by: Sequence[str], order: Sequence[str], fraction: float, chunk: Column) -> DataFrame:
    """The first ``int(n (1 - fraction))`` rows train, the others validate."""
    placed = positions(df, by, order, chunk, "_p", "_n")
    train = F.col("_p") <= F.floor(F.col("_n") * (1 - fraction))
    return placed.withColumn("role", F.when(train, "train").otherwise("val")).drop("_p", "_n")


def retrain_period(ts: Column | str, start: datetime, end: datetime, step_seconds: int, n: int) -> Column:
    """Number of the retraining period; the last periods take the remainder."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    total = int((end - start).total_seconds()) // step_seconds + 1
    size, extra = divmod(total, n)
    index = F.floor((F.unix_timestamp(ts) - F.unix_timestamp(_ts(start))) / step_seconds)
    plain = (n - extra) * size
    number = F.when(index < plain, F.floor(index / max(size, 1))).otherwise(
        (n - extra) + F.floor((index - plain) / (size + 1))
    )
    return F.when((index >= 0) & (index < total), number.cast("int"))


def client_folds(
    df: DataFrame, clients: DataFrame, order: Sequence[str], k: int, chunk: Column
) -> DataFrame:
    """Attach each station's client and fold the samples of every client on its own."""
    return time_series_folds(df.join(clients, "station_id"), ["client_id"], order, k, chunk)


def draw(seed: int, *parts: Column | str) -> Column:
    """Reproducible text to order by: equal on every run, executor and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))


def draw_number(seed: int, *parts: Column | str) -> Column:
    """Reproducible whole number in [0, 2**60), so that a remainder by any count is all but unbiased."""
    return F.conv(F.substring(draw(seed, *parts), 1, 15), 16, 10).cast("bigint")


def _coprime(step: Column, size: Column) -> Column:
    """Whether steps of this width reach all of ``size`` places: the remainders of Euclid end at 1."""
    begin = F.struct(step.alias("a"), size.alias("b"))
    shorten = lambda s, _: F.when(s["b"] == 0, s).otherwise(
        F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), begin, shorten)["a"] == 1


def mask_targets(
    runs: DataFrame, stations: DataFrame, run_key: str, low: int, high: int, neighbours: int, seed: int, tries: int = 16
) -> DataFrame:
    """Targets and neighbours drawn per run: ``run_key, station_id, role``.

    ``low`` to ``high`` stations become targets, whose history is to be zeroed, and the
    next ``neighbours`` are kept. Stations are shuffled into one circle; every run walks it
    from a place and in a step width of its own, so only the drawn stations meet a run. The
    step is the first of ``tries`` drawn ones that reaches all places, else 1.
    """
    shuffled = stations.select("station_id").withColumn("_h", draw(seed, "station_id"))
    placed = positions(shuffled, [], ["_h", "station_id"], F.substring("_h", 1, 2), "_p")
    placed = placed.select((F.col("_p") - 1).alias("_at"), "station_id")
    size = stations.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = F.lit(low) + draw_number(seed, run_key) % (high - low + 1)
    picks = runs.select(run_key, wanted.alias("_n"), size.alias("_size"))
    steps = F.array(*(draw_number(seed + 2 + i, run_key) % F.col("_size") for i in range(tries)))
    fitting = F.filter(steps, lambda step: _coprime(step, F.col("_size")))
    picks = picks.select(
        "*",
        (draw_number(seed + 1, run_key) % F.col("_size")).alias("_start"),
        F.coalesce(F.get(fitting, F.lit(0)), F.lit(1).cast("bigint")).alias("_step"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("_n") + neighbours, F.col("_size")) - 1)).alias("_i"),
    )
    drawn = picks.withColumn("_at", (F.col("_start") + F.col("_i") * F.col("_step")) % F.col("_size")).join(placed, "_at")
    role = F.when(F.col("_i") < F.col("_n"), "target").otherwise("neighbour")
    return drawn.select(run_key, "station_id", role.alias("role"))


def mask_targets_and_nearest(
    runs: DataFrame, stations: DataFrame, run_key: str, low: int, high: int, neighbours: int, seed: int, metric: str = "degrees"
) -> DataFrame:
    """Like ``mask_targets``, but a run's neighbours are the stations nearest to any of its targets.

    Of a target's ``neighbours + high`` nearest stations at most ``high`` are targets
    themselves, so the lists of the run's targets hold all neighbours.
    """
    targets = mask_targets(runs, stations, run_key, low, high, 0, seed)
    near = k_nearest(stations, stations, neighbours + high, candidate_key="station_id", metric=metric, exclude_self=True)
    reached = targets.select(run_key, F.col("station_id").alias("target_id")).join(near, "target_id")
    reached = reached.groupBy(run_key, F.col("near_id").alias("station_id")).agg(F.min("distance").alias("_d"))
    free = reached.join(targets.select(run_key, "station_id"), [run_key, "station_id"], "left_anti")
    picked = first_rows(free, [run_key], [F.round("_d", 9), "station_id"], neighbours)
    return targets.unionByName(picked.select(run_key, "station_id", F.lit("neighbour").alias("role")))


def assign_turbines(stations: DataFrame, turbines: DataFrame, seed: int) -> DataFrame:
    """One turbine type per station, drawn reproducibly, with its parameters.

    ``turbines`` is numbered 0, 1, ... in ``number``.
    """
    count = turbines.agg(F.count(F.lit(1)).alias("n")).scalar()
    picked = stations.withColumn("number", (draw_number(seed, "station_id") % count).cast("bigint"))
    return picked.join(turbines, "number")


def fold_table(ts: Column | str, folds: Sequence[tuple[int, datetime, datetime, datetime, datetime]]) -> Column:
    """Array of ``(fold, role)`` from explicit train and validation dates per fold."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    roles = []
    for fold, train_start, train_end, val_start, val_end in folds:
        for role, a, b in (("train", train_start, train_end), ("val", val_start, val_end)):
            inside = (ts >= _ts(a)) & (ts <= _ts(b))
            roles.append(F.when(inside, F.struct(F.lit(fold).alias("fold"), F.lit(role).alias("role"))))
    return F.filter(F.array(*roles), lambda r: r.isNotNull())


