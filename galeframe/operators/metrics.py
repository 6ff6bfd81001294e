"""Forecast scores as aggregate expressions and comparisons between models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.operators.ordering import group_ranks


def _pair(truth: Column | str, pred: Column | str) -> tuple[Column, Column]:
    """Both sides, null unless both are present."""
    y = F.col(truth) if isinstance(truth, str) else truth
    p = F.col(pred) if isinstance(pred, str) else pred
    whole = y.isNotNull() & p.isNotNull()
    return F.when(whole, y), F.when(whole, p)


def rmse(truth, pred) -> Column:
    y, p = _pair(truth, pred)
    return F.sqrt(F.avg((p - y) * (p - y)))


def mae(truth, pred) -> Column:
    y, p = _pair(truth, pred)
    return F.avg(F.abs(p - y))


def bias(truth, pred) -> Column:
    y, p = _pair(truth, pred)
    return F.avg(p - y)


def r2(truth, pred) -> Column:
    """``1 - SSE / SST``; null for a constant truth or fewer than two samples."""
    y, p = _pair(truth, pred)
    spread = F.var_pop(y)
    return F.when((F.count(y) >= 2) & (spread > 0), 1.0 - F.avg((p - y) * (p - y)) / spread)


def samples(truth, pred) -> Column:
    return F.count(_pair(truth, pred)[0])


def skill(truth, pred, reference) -> Column:
    """``1 - RMSE / RMSE_ref``; null without a reference or with a perfect one."""
    return 1.0 - F.try_divide(rmse(truth, pred), rmse(truth, reference))


def score(df: DataFrame, by: Sequence[str], truth: str = "gt", pred: str = "pred", **references: str) -> DataFrame:
    """RMSE, MAE, R2, sample count and a skill per named reference column."""
    enough = samples(truth, pred) >= 2
    picks = [
        F.when(enough, rmse(truth, pred)).alias("rmse"),
        F.when(enough, mae(truth, pred)).alias("mae"),
        r2(truth, pred).alias("r2"),
        samples(truth, pred).alias("n_samples"),
        *[skill(truth, pred, ref).alias(name) for name, ref in references.items()],
    ]
    return df.groupBy(*by).agg(*picks) if by else df.agg(*picks)


def detailed(df: DataFrame, by: Sequence[str], step: str, truth: str = "gt", pred: str = "pred") -> DataFrame:
    """Mean RMSE over the steps and R2 weighted by each step's variance."""
    y, p = _pair(truth, pred)
    per_step = df.groupBy(*by, step).agg(
        rmse(truth, pred).alias("_rmse"), F.var_pop(y).alias("_var"),
        F.avg((p - y) * (p - y)).alias("_mse"), F.count(y).alias("_n"),
    )
    explained = 1.0 - F.try_divide(F.sum(F.col("_mse") * F.col("_n")), F.sum(F.col("_var") * F.col("_n")))
    picks = [F.avg("_rmse").alias("mean_step_rmse"), explained.alias("weighted_r2")]
    return per_step.groupBy(*by).agg(*picks) if by else per_step.agg(*picks)


def pinball(truth, pred, q: float) -> Column:
    """Quantile loss of ``pred`` as the ``q`` quantile."""
    y, p = _pair(truth, pred)
    return F.avg(F.greatest((q - 1.0) * (y - p), q * (y - p)))


def horizon_weighted(
    df: DataFrame, by: Sequence[str], step: str, horizon: int, decay: float, truth: str = "gt", pred: str = "pred",
    delta: float = 1.0,
) -> DataFrame:
    """MSE, MAE and Huber loss with weights ``decay^t`` that sum to the horizon (t from 0)."""
    scale = horizon / sum(decay**i for i in range(horizon))
    w = scale * F.pow(F.lit(decay), F.col(step) - 1)
    y, p = _pair(truth, pred)
    e, a = p - y, F.abs(p - y)
    huber = F.when(a <= delta, 0.5 * e * e).otherwise(delta * (a - 0.5 * delta))
    picks = [F.avg(w * x).alias(n) for n, x in (("weighted_mse", e * e), ("weighted_mae", a), ("weighted_huber", huber))]
    return df.groupBy(*by).agg(*picks) if by else df.agg(*picks)


def delta_to_reference(df: DataFrame, by: Sequence[str], reference: Column, value: str) -> DataFrame:
    """Absolute and relative difference to the group's reference row."""
    base = df.filter(reference).select(*by, F.col(value).alias("_ref"))
    delta = F.col(value) - F.col("_ref")
    out = df.join(base, [*by])
    return out.withColumns(
        {"delta": delta, "relative_delta": F.try_divide(delta, F.col("_ref"))}
    ).drop("_ref")


def model_deltas(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Delta of two models per key with a mean and a sample-std row.

    The mean row's relative delta is the mean delta over the mean reference.
    """
    both = left.select(key, F.col(value).alias("model")).join(
        right.select(key, F.col(value).alias("reference")), key
    )
    both = both.withColumn("delta", F.col("model") - F.col("reference"))
    both = both.withColumn("relative_delta", F.try_divide(F.col("delta"), F.col("reference")))
    cols = ["model", "reference", "delta"]
    mean = both.agg(*[F.avg(c).alias(c) for c in cols]).select(
        F.lit("mean").alias(key), *cols, F.try_divide(F.col("delta"), F.col("reference")).alias("relative_delta")
    )
    std = both.agg(*[F.stddev_samp(c).alias(c) for c in [*cols, "relative_delta"]]).select(
        F.lit("std").alias(key), *cols, "relative_delta"
    )
    return both.unionByName(mean).unionByName(std)


def signed_rank(df: DataFrame, delta: str, chunk: Column, exact_up_to: int = 50) -> DataFrame:
    """Wilcoxon signed-rank statistic of paired deltas with the one-sided (greater) p-value.

    Equal magnitudes share their mean rank, missing deltas and zeros are left out. Ranks come from counts per magnitude, so
    ``chunk`` (coarser than the magnitude, order-preserving) bounds what a task holds. The p-value is that of the exact
    distribution for up to ``exact_up_to`` deltas without ties or zeros (``exact`` says so), else of the normal one.
    """
    magnitudes = df.filter(F.col(delta) != 0).select(F.abs(delta).alias("_m"), (F.col(delta) > 0).alias("_up"))
    tied = group_ranks(magnitudes, [], "_m", chunk(F.col("_m")), "_first").groupBy("_m", "_first").agg(
        F.count(F.lit(1)).alias("_c"), F.count_if("_up").alias("_n_up")
    )
    ranked = tied.withColumn("_rank", F.col("_first") + (F.col("_c") - 1) / 2.0)
    total = ranked.agg(
        F.sum("_c").alias("n"),
        F.sum(F.col("_rank") * F.col("_n_up")).alias("w_plus"),
        F.sum(F.pow(F.col("_c").cast("double"), F.lit(3.0)) - F.col("_c")).alias("_ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0)
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4.0, spread)
    zeros = df.agg(F.count_if(F.col(delta) == 0)).scalar()
    exact = F.coalesce((F.col("n") <= exact_up_to) & (F.col("_ties") == 0) & (zeros == 0), F.lit(False))
    p_value = F.when(exact, signed_rank_tail(F.col("n"), F.col("w_plus"))).otherwise(upper_tail(z))
    return total.select("n", "w_plus", z.alias("z"), p_value.alias("p_value"), exact.alias("exact"))


def signed_rank_tail(n: Column, w_plus: Column) -> Column:
    """P(W >= w_plus) of the sum of the ranks 1 to n that get a positive sign, each with probability one half.

    Each rank in turn adds the number of ways to reach a sum without it, so the table of ways has n (n + 1) / 2 + 1 entries.
    """
    size = (n * (n + 1) / 2 + 1).cast("int")
    none = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1))
    moved = lambda ways, r: F.concat(F.array_repeat(F.lit(0.0), r), F.slice(ways, F.lit(1), size - r))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), none, lambda w, r: F.zip_with(w, moved(w, r), lambda a, b: a + b))
    first = w_plus.cast("int") + 1
    tail = F.aggregate(F.slice(ways, first, F.greatest(size - first + 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, tail / F.pow(F.lit(2.0), n)).otherwise(F.lit(1.0))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, good to seven digits."""
    # The rational approximation 26.2.17 of Abramowitz and Stegun.
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = series * F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    return F.when(z >= 0, far).otherwise(1.0 - far)


def disagreement(df: DataFrame, models: Sequence[str], into: str = "diff") -> DataFrame:
    """Mean absolute difference over all pairs of model columns."""
    gaps = [F.abs(F.col(a) - F.col(b)) for i, a in enumerate(models) for b in models[i + 1 :]]
    return df.withColumn(into, F.round(sum(gaps[1:], gaps[0]) / len(gaps), 9))


def consolidate(results: DataFrame, persistence: DataFrame, keys: Sequence[str], index: Sequence[str]) -> DataFrame:
    """Mean RMSE and skill against the persistence of the same key, best skill first."""
    ref = persistence.select(*keys, F.col("rmse").alias("_p"))
    rows = results.join(ref, [*keys], "left").withColumn("skill", 1.0 - F.try_divide(F.col("rmse"), F.col("_p")))
    out = rows.groupBy(*index).agg(F.avg("rmse").alias("rmse"), F.avg("skill").alias("skill"))
    return out.orderBy(F.desc_nulls_last("skill"))


def prediction_table(runs: DataFrame, keys: Sequence[str], leads: str, values: Sequence[str]) -> DataFrame:
    """One row per run and lead from per-run arrays; ``starttime`` is among the keys."""
    rows = runs.select(*keys, F.explode(F.arrays_zip(leads, *values)).alias("_z"))
    horizon = F.col(f"_z.{leads}").cast("int")
    valid = F.timestamp_seconds(F.unix_timestamp("starttime") + horizon * 3600)
    return rows.select(
        *keys, horizon.alias("horizon"), valid.alias("valid_time"), *[F.col(f"_z.{v}").alias(v) for v in values]
    )
