"""Resampling, pivots, weighted aggregates and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions.physics import cap_area, degrees_from_sin_cos
from galeframe.operators.ordering import first_rows
from galeframe.operators.quantiles import quantile_columns


def resample_mean(
    df: DataFrame, by: Sequence[str], ts: str, step_seconds: int, cols: Sequence[str], origin: str = "midnight"
) -> DataFrame:
    """Mean per left-closed, left-labelled bin; bins without rows appear with nulls.

    ``origin="midnight"`` aligns bins with the clock, ``"start"`` with the first row
    of each series. Means are combined before the shuffle, so a hot series is cheap.
    """
    micros, step = F.unix_micros(F.col(ts)), step_seconds * 1_000_000
    rows = df
    if origin == "start":
        rows = df.join(df.groupBy(*by).agg(F.min(micros).alias("_anchor")), [*by])
    else:
        rows = df.withColumn("_anchor", F.lit(0).cast("bigint"))
    bin_of = F.floor((micros - F.col("_anchor")) / step).alias("_bin")
    means = rows.groupBy(*by, "_anchor", bin_of).agg(*[F.avg(c).alias(c) for c in cols])
    spans = means.groupBy(*by, "_anchor").agg(F.min("_bin").alias("_from"), F.max("_bin").alias("_to"))
    bins = spans.select(*by, "_anchor", F.explode(F.sequence("_from", "_to")).alias("_bin"))
    start = F.timestamp_micros(F.col("_anchor") + F.col("_bin") * step)
    return bins.join(means, [*by, "_anchor", "_bin"], "left").select(*by, start.alias(ts), *cols)


def lead_bins(
    df: DataFrame, by: Sequence[str], lead: str, step_hours: float, cols: Sequence[str], last_bin: int
) -> DataFrame:
    """Mean per run and lead bin ``floor(lead / step)``; bins 1 to ``last_bin`` are kept."""
    number = F.floor(F.col(lead) / step_hours).alias("lead_bin")
    return (
        df.groupBy(*by, number)
        .agg(*[F.avg(c).alias(c) for c in cols])
        .filter(F.col("lead_bin").between(1, last_bin))
    )


def pivot_mean(
    df: DataFrame, keys: Sequence[str], over: str, values: Sequence, cols: dict[str, str], how: str = "mean"
) -> DataFrame:
    """One column per value of ``over``; ``cols`` maps columns to name patterns with ``{}``.

    The value list is given, so the schema is fixed and no pass is spent finding it.
    ``how="first"`` takes the smallest value instead of the mean where rows repeat.
    """
    agg = F.avg if how == "mean" else F.min
    picks = [
        agg(F.when(F.col(over) == v, F.col(c))).alias(pattern.format(v))
        for c, pattern in cols.items()
        for v in values
    ]
    return df.groupBy(*keys).agg(*picks)


def pivot_mean_map(df: DataFrame, keys: Sequence[str], over: str, col: str, into: str) -> DataFrame:
    """``pivot_mean`` for any number of values of ``over``: the means as one map column, values without rows left out."""
    means = df.filter(F.col(over).isNotNull()).groupBy(*keys, over).agg(F.avg(col).alias("_mean"))
    return means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(over, "_mean"))).alias(into))


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([*ids], [*cols], name, value)


def circular_mean(degrees: Column | str) -> Column:
    """Mean direction in [0, 360); null without any value."""
    angle = F.radians(degrees)
    return degrees_from_sin_cos(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def inverse_distance_mean(
    df: DataFrame, keys: Sequence[str], distance: str, cols: Sequence[str], k: int, floor: float | None = None
) -> DataFrame:
    """Mean over ``k`` neighbours weighted by 1/distance; a missing one makes the result missing.

    Points at distance 0 share all weight, or with ``floor`` distances are floored.
    """
    d = F.col(distance)
    if floor is None:
        hits = F.sum(F.when(d == 0, 1.0).otherwise(0.0))
    else:
        d, hits = F.greatest(d, F.lit(floor)), F.lit(0.0)
    weight = F.try_divide(F.lit(1.0), d)
    picks = []
    for c in cols:
        v = F.col(c)
        usual = F.sum(weight * v) / F.sum(weight)
        exact = F.try_divide(F.sum(F.when(d == 0, v)), hits)
        whole = F.count(v) == k
        picks.append(F.when(whole, F.when(hits > 0, exact).otherwise(usual)).alias(c))
    return df.groupBy(*keys).agg(*picks)


def rotor_weights(turbines: DataFrame, heights: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Share of the summed rotor area that each level's layer covers.

    ``turbines`` has ``hub_height`` and ``diameter``; layers meet halfway between levels.
    """
    levels = sorted(heights)
    edges = [0.0, *[(a + b) / 2 for a, b in zip(levels, levels[1:])], float("inf")]
    layers = [F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(h).alias("height"))
              for h, lo, hi in zip(levels, edges, edges[1:])]
    r, hub = F.col("diameter") / 2.0, F.col("hub_height")
    sliced = turbines.withColumn("_layer", F.explode(F.array(*layers)))
    top = F.least(F.col("_layer.hi") - hub, r)
    down = F.greatest(F.col("_layer.lo") - hub, -r)
    area = F.when((down < r) & (top > -r), cap_area(r, down) - cap_area(r, top)).otherwise(0.0)
    total = turbines.groupBy(*by).agg(F.sum(F.pi() * r * r).alias("_total"))
    parts = sliced.groupBy(*by, F.col("_layer.height").alias("height")).agg(F.sum(area).alias("_area"))
    return parts.join(total, [*by]).select(*by, "height", (F.col("_area") / F.col("_total")).alias("weight"))


def rotor_equivalent(
    df: DataFrame, weights: DataFrame, on: Sequence[str], keys: Sequence[str], speed: str, density: str | None = None
) -> DataFrame:
    """``(sum w v^3)^(1/3)`` and ``sum w rho`` over the levels that carry weight.

    A level missing a value makes the result of that key missing.
    """
    rows = df.join(weights.filter("weight > 0"), [*on])

    def total(c: Column) -> Column:
        return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))

    cubed = total(F.col("weight") * F.pow(F.col(speed), F.lit(3.0)))
    picks = [F.pow(cubed, F.lit(1.0 / 3.0)).alias("wind_speed_rotor_eq")]
    if density:
        picks.append(total(F.col("weight") * F.col(density)).alias("density_rotor_eq"))
    return rows.groupBy(*keys).agg(*picks)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Weighted mean that leaves out rows without a value."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    present = F.when(v.isNotNull(), w)
    return F.try_divide(F.sum(v * w), F.sum(present))


def merge_moments(n: str, mu: str, var: str) -> dict[str, Column]:
    """Global mean and population std from per-client counts, means and variances."""
    total = F.sum(n)
    mean = F.sum(F.col(n) * F.col(mu)) / total
    second = F.sum(F.col(n) * (F.col(var) + F.col(mu) * F.col(mu))) / total
    return {"mean": mean, "std": F.sqrt(F.greatest(second - mean * mean, F.lit(0.0)))}


def smallest_mode(df: DataFrame, by: Sequence[str], value: str, into: str) -> DataFrame:
    """Most frequent value per key, the smallest one on ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(F.col(value), F.struct(F.col("_n"), -F.col(value))).alias(into)
    return counts.groupBy(*by).agg(best) if by else counts.agg(best)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max, one row per column."""
    long = df.unpivot([], [*cols], "column", "value")
    base = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    marks = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    return base.join(quantile_columns(long, ["column"], "value", marks), "column", "left")


def quantile_bins(df: DataFrame, value: str, n: int, into: str) -> DataFrame:
    """Number of the right-closed quantile bin (0-based) of each non-null value."""
    names = {f"_edge_{i}": i / n for i in range(1, n)}
    edges = quantile_columns(df, [], value, names)
    label = F.lit(0)
    for c in names:
        label = label + F.when(F.col(value) > edges.select(c).scalar(), 1).otherwise(0)
    return df.withColumn(into, F.when(F.col(value).isNotNull(), label))


def fixed_bins(value: Column | str, edges: Sequence[float]) -> Column:
    """Index of the right-open bin; the last bin is open, values below the first are null."""
    v = F.col(value) if isinstance(value, str) else value
    label = F.when(v >= edges[0], 0)
    for i, edge in enumerate(edges[1:], start=1):
        label = F.when(v >= edge, i).otherwise(label)
    return label


def drop_sparse_days(df: DataFrame, by: Sequence[str], ts: str, value: str, threshold: int) -> DataFrame:
    """Rows of the days whose missing values do not exceed ``threshold``."""
    day = F.date_trunc("day", ts).alias("_day")
    gaps = F.sum(F.col(value).isNull().cast("int"))
    good = df.groupBy(*by, day).agg(gaps.alias("_gaps")).filter(F.col("_gaps") <= threshold)
    return df.withColumn("_day", day).join(good.drop("_gaps"), [*by, "_day"], "left_semi").drop("_day")


def capacity(df: DataFrame, by: Sequence[str], order: str, power: str, first: int | None = None) -> DataFrame:
    """Largest power per series, over the whole series or its ``first`` rows."""
    rows = first_rows(df, by, [order], first) if first else df
    return rows.groupBy(*by).agg(F.max(power).alias("capacity"))


def with_summary_rows(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Append a ``mean`` row (mean of the rows, not pooled) and a sample-``std`` row."""
    rows = [
        df.agg(*[how(c).alias(c) for c in cols]).select(F.lit(name).alias(label), *cols)
        for name, how in (("mean", F.avg), ("std", F.stddev_samp))
    ]
    return df.select(label, *cols).unionByName(rows[0]).unionByName(rows[1])


def federated_average(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Average of long parameter tables over clients, by sample count or uniform."""
    average = weighted_mean(value, weight) if weight else F.avg(value)
    return df.groupBy(*keys).agg(average.alias(value))
