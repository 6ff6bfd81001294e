"""Linear persistence models fitted from grouped moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_line(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """``slope`` and ``intercept`` per key."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def fit_predict(
    train: DataFrame, test: DataFrame, by: Sequence[str], y: str, features: Sequence[str]
) -> DataFrame:
    """Least squares on several features per key; adds ``prediction`` to the test rows.

    The fit needs only means and covariances, so all keys are fitted in one aggregation
    and just one small matrix per key reaches NumPy. Training rows with a missing value are
    left out; without keys there is one fit for all.
    """
    if not by:
        constant = F.lit(0).alias("_all")
        out = fit_predict(train.select("*", constant), test.select("*", constant), ["_all"], y, features)
        return out.drop("_all")
    names = [*features, y]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = train.na.drop(subset=names).groupBy(*by).agg(
        F.array(*[F.avg(c) for c in names]).alias("_mean"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("_cov"),
    )
    index = [(names.index(a), names.index(b)) for a, b in pairs]
    size = len(names)
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.schema if f.name in by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            betas = []
            for mean, cov in zip(batch["_mean"], batch["_cov"]):
                full = np.zeros((size, size))
                for (i, j), v in zip(index, np.asarray(cov, float)):
                    full[i, j] = full[j, i] = v
                slope = np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=None)[0]
                mean = np.asarray(mean, float)
                betas.append([mean[-1] - slope @ mean[:-1], *slope])
            yield batch[[*by]].assign(_beta=betas)

    fitted = moments.mapInPandas(solve, f"{keys}, _beta array<double>")
    terms = [F.col("_beta")[i + 1] * F.col(c) for i, c in enumerate(features)]
    return test.join(fitted, [*by]).withColumn("prediction", F.col("_beta")[0] + sum(terms[1:], terms[0])).drop("_beta")
