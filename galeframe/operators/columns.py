"""Column selection by name and row filters of the feature preparation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching_columns(cols: Sequence[str], feature: str, suffix: str = r"\d+") -> list[str]:
    """Columns named ``feature`` or ``feature_<suffix>``; never a substring match."""
    pattern = re.compile(rf"^{re.escape(feature)}(_{suffix})?$")
    return [c for c in cols if pattern.match(c)]


def select_features(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], suffix: str = r"[A-Z0-9]+"
) -> DataFrame:
    found = [c for f in features for c in matching_columns(df.columns, f, suffix)]
    return df.select(*keys, *dict.fromkeys(found))


def resolve_roles(
    cols: Sequence[str], known: Sequence[str], observed: Sequence[str]
) -> tuple[list[str], list[str]]:
    """Known-future and observed columns: principal components first, macros expanded."""
    picked = [c for c in cols if "known_pca_" in c]
    for feature in known:
        if feature == "wind_speed_nwp":
            picked += [c for c in cols if "wind_speed_h" in c]
        else:
            picked += matching_columns(cols, feature)
    picked += [c for c in cols if "wind_speed_rotor_eq" in c or "wind_speed_mean_height" in c]
    past = [c for f in observed for c in matching_columns(cols, f)]
    return list(dict.fromkeys(picked)), list(dict.fromkeys(past))


def features_of_mode(features: Sequence[str], mode: str) -> list[str]:
    """Keep wind as speeds (``absolute``), as ``components`` or both ways."""
    if mode in ("both", "dir_in_deg"):
        return list(features)
    dropped = {"absolute": r"[uv]_", "components": r"wind_speed_"}[mode]
    kept = [f for f in features if not re.match(dropped, f)]
    if not kept:
        raise ValueError(f"mode {mode!r} leaves no feature of {list(features)}")
    return kept


def in_period(
    start_col: str, train_start: datetime, test_end: datetime, cutoff: datetime | None = None, margin_days: int = 7
) -> Column:
    """Runs from ``margin_days`` before the training start to the cutoff or the test end."""
    low = F.lit(train_start - timedelta(days=margin_days)).cast("timestamp")
    high = F.lit(cutoff or test_end).cast("timestamp")
    return (F.col(start_col) >= low) & (F.col(start_col) <= high)


def run_hour_in(start_col: str, hours: Sequence[int]) -> Column:
    return F.hour(start_col).isin(*hours)


def aligned_start(df: DataFrame, by: Sequence[str], ts: str, hours: int = 3) -> DataFrame:
    """Rows from the first full hour divisible by ``hours`` on.

    A series whose first row already lies in such an hour is kept whole.
    """
    first = df.groupBy(*by).agg(F.min(ts).alias("_first"))
    step = hours * 3600
    up = F.timestamp_seconds((F.floor(F.unix_timestamp("_first") / step) + 1) * step)
    from_ = F.when(F.hour("_first") % hours == 0, F.col("_first")).otherwise(up)
    return df.join(first, [*by]).filter(F.col(ts) >= from_).drop("_first")


def at_time_of_day(ts: Column | str, hour: int) -> Column:
    return F.date_format(ts, "HH:mm:ss") == f"{hour:02d}:00:00"
