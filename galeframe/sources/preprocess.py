"""Preparation steps chosen by the kind of source. A step is a function DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from galeframe.operators.reshape import resample_mean

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}


def step(kind: str) -> Callable[[Step], Step]:
    """Register the step of a kind of source."""

    def keep(fn: Step) -> Step:
        STEPS[kind] = fn
        return fn

    return keep


def prepare(df: DataFrame, path: str, **options) -> DataFrame:
    """Apply the step whose kind occurs in the path (the longest one that does)."""
    kinds = sorted((k for k in STEPS if k in path), key=len, reverse=True)
    if not kinds:
        raise ValueError(f"no preparation step for {path!r}; known kinds: {sorted(STEPS)}")
    return df.transform(STEPS[kinds[0]], **options)


def _numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]


@step("wind")
def hourly_wind(df: DataFrame, temperature: str | None = None) -> DataFrame:
    """Complete rows as hourly means per station."""
    cols = [c for c in _numeric(df) if c != temperature]
    rows = df.na.drop(subset=[temperature]) if temperature else df
    return resample_mean(rows, ["station_id"], "timestamp", 3600, cols)


@step("solar")
def quarter_hourly_solar(df: DataFrame) -> DataFrame:
    return resample_mean(df, ["station_id"], "timestamp", 900, _numeric(df))
