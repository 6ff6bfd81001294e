"""Scalers fitted with one aggregation, and principal components per series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_scaler(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), where: Column | None = None
) -> DataFrame:
    """``{c}_mean`` and ``{c}_std`` (population) of the rows in ``where``, nulls skipped.

    One pass over all stations gives the global scaler, ``by`` one scaler per key.
    """
    rows = df if where is None else df.filter(where)
    picks = [p for c in cols for p in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return rows.groupBy(*by).agg(*picks) if by else rows.agg(*picks)


def fit_min_max(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    picks = [p for c in cols for p in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return df.groupBy(*by).agg(*picks) if by else df.agg(*picks)


def _unit(std: Column, floor: float | None, eps: float | None) -> Column:
    if floor is not None:
        return F.greatest(std, F.lit(floor))
    if eps is not None:
        return std + eps
    return F.when(std == 0, 1.0).otherwise(std)


def _stat(stats: DataFrame, name: str, by: Sequence[str]) -> Column:
    if name not in stats.columns:
        raise ValueError(f"the scaler was not fitted on {name.rsplit('_', 1)[0]!r}")
    # without a key the statistics are one row: a scalar subquery, not a join
    return F.col(name) if by else stats.select(name).scalar()


def standardize(
    column: str, stats: DataFrame, by: Sequence[str] = (), floor: float | None = None, eps: float | None = None
) -> Column:
    """z-score; zero spread counts as 1 unless a floor or an epsilon is given."""
    unit = _unit(_stat(stats, f"{column}_std", by), floor, eps)
    return (F.col(column) - _stat(stats, f"{column}_mean", by)) / unit


def transform(
    df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = (), eps: float | None = None
) -> DataFrame:
    rows = df.join(stats, [*by], "left") if by else df
    out = rows.withColumns({c: standardize(c, stats, by, eps=eps) for c in cols})
    return out.select(*df.columns)


def inverse_transform(
    df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = (), eps: float | None = None
) -> DataFrame:
    rows = df.join(stats, [*by], "left") if by else df
    back = {
        c: F.col(c) * _unit(_stat(stats, f"{c}_std", by), None, eps) + _stat(stats, f"{c}_mean", by)
        for c in cols
    }
    return rows.withColumns(back).select(*df.columns)


def min_max(column: str, stats: DataFrame, by: Sequence[str] = ()) -> Column:
    """Position between min and max; a constant column becomes 0."""
    low, high = _stat(stats, f"{column}_min", by), _stat(stats, f"{column}_max", by)
    return F.coalesce(F.try_divide(F.col(column) - low, high - low), F.col(column) * 0.0)


def principal_components(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], n: int
) -> DataFrame:
    """First ``n`` principal scores per series as ``known_pca_0, known_pca_1, ...`` in place of the columns.

    Columns are standardised per series. The covariances are plain aggregates; only
    the small matrix of a series goes through NumPy. Each component points so that
    its largest loading is positive. Rows with a missing value get null scores.
    """
    if not by:
        return principal_components(df.withColumn("_all", F.lit(0)), ["_all"], cols, n).drop("_all")
    n = min(n, len(cols))
    stats = fit_scaler(df, cols, by)
    scaled = transform(df, stats, cols, by)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    moments = scaled.na.drop(subset=[*cols]).groupBy(*by).agg(
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("_cov")
    )
    index = [(cols.index(a), cols.index(b)) for a, b in pairs]
    size = len(cols)

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            loadings = []
            for values in batch["_cov"]:
                matrix = np.zeros((size, size))
                for (i, j), v in zip(index, np.asarray(values, dtype=float)):
                    matrix[i, j] = matrix[j, i] = v
                sizes, vectors = np.linalg.eigh(matrix)
                vectors = vectors[:, np.argsort(sizes)[::-1][:n]].T
                # of equally large loadings, the first column's
                peak = vectors[np.arange(n), np.round(np.abs(vectors), 9).argmax(axis=1)]
                loadings.append((vectors * np.sign(peak)[:, None]).tolist())
            yield batch.drop(columns="_cov").assign(_load=loadings)

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.schema if f.name in by)
    loads = moments.mapInPandas(decompose, f"{keys}, _load array<array<double>>")
    out = scaled.join(loads, [*by])
    for k in range(n):
        terms = [F.col("_load")[k][i] * F.col(c) for i, c in enumerate(cols)]
        out = out.withColumn(f"known_pca_{k}", sum(terms[1:], terms[0]))
    return out.drop("_load", *cols)
