"""Completeness audits and maintenance of a run store."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.operators.ordering import first_rows


def null_report(df: DataFrame, by: Sequence[str], cols: Sequence[str], ts: str) -> DataFrame:
    """Per key and column: rows, nulls and the first time a value is missing."""
    long = df.unpivot([*by, ts], [*cols], "column", "_v")
    missing = F.col("_v").isNull()
    return long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(missing).alias("n_null"),
        F.min(F.when(missing, F.col(ts))).alias("first_null"),
    )


def null_counts(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[(F.count(F.lit(1)) - F.count(c)).alias(f"null_{c}") for c in cols])


def worst_null_counts(df: DataFrame, key: str, cols: Sequence[str], n: int) -> DataFrame:
    """The n keys with most missing values per column."""
    long = df.unpivot([key], [*cols], "column", "_v")
    counts = long.groupBy("column", key).agg(F.count_if(F.col("_v").isNull()).alias("n_null"))
    return first_rows(counts, ["column"], [F.desc("n_null"), key], n, "rank")


def missing_runs(
    observed: DataFrame, by: Sequence[str], first: datetime, last: datetime, hours: Sequence[int]
) -> DataFrame:
    """Runs of the daily calendar that a key lacks; keys come from ``observed``."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    listed = F.array(*[F.lit(int(h)) for h in hours])
    calendar = observed.select(*by).distinct().withColumn("_day", F.explode(days))
    calendar = calendar.withColumn("_hour", F.explode(listed))
    start = F.timestamp_seconds(F.unix_timestamp(F.col("_day").cast("timestamp")) + F.col("_hour") * 3600)
    return calendar.select(*by, start.alias("starttime")).join(
        observed.select(*by, "starttime").distinct(), [*by, "starttime"], "left_anti"
    )


def run_sizes(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def incomplete_runs(runs: DataFrame, by: Sequence[str], expected: int) -> DataFrame:
    return run_sizes(runs, by).filter(F.col("n_rows") != expected)


def missing_leads(runs: DataFrame, by: Sequence[str], leads: Sequence[int], first: int = 5) -> DataFrame:
    """Number and first few of the leads that incomplete runs lack."""
    have = F.collect_set(F.col("forecasttime").cast("int"))
    lost = F.array_except(F.array(*[F.lit(int(x)) for x in leads]), have)
    out = runs.groupBy(*by).agg(F.sort_array(lost).alias("_lost")).filter(F.size("_lost") > 0)
    return out.select(*by, F.size("_lost").alias("n_missing"), F.slice("_lost", 1, first).alias("first_missing"))


def null_rows(
    runs: DataFrame, by: Sequence[str], expected: int, cols: Sequence[str], radiation: Sequence[str]
) -> DataFrame:
    """Rows with nulls in runs of full length; rows between full hours need only ``radiation``."""
    def any_null(names: Sequence[str]) -> Column:
        out = F.lit(False)
        for c in names:
            out = out | F.col(c).isNull()
        return out

    bad = F.when(F.col("forecasttime") % 1 == 0, any_null(cols)).otherwise(any_null(radiation))
    sizes = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("n_null_rows"))
    return sizes.filter((F.col("_n") == expected) & (F.col("n_null_rows") > 0)).drop("_n")


def station_status(stations: DataFrame, runs: DataFrame, key: str, expected: int, examples: int = 5) -> DataFrame:
    """OK, INCOMPLETE or ERROR (no run at all) per station with counts and first examples."""
    sizes = run_sizes(runs, [key, "starttime"])
    short = F.col("n_rows") != expected
    totals = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(short).alias("incomplete"))
    listed = first_rows(sizes.filter(short), [key], ["starttime"], examples).groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.date_format("starttime", "yyyy-MM-dd HH"))), ",").alias("examples")
    )
    out = stations.select(key).join(totals, key, "left").join(listed, key, "left")
    status = F.when(F.col("total").isNull(), "ERROR").when(F.col("incomplete") > 0, "INCOMPLETE").otherwise("OK")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("total", "incomplete")}
    return out.withColumn("status", status).withColumns(zero)


def grid_summary(audit: DataFrame, mapping: DataFrame) -> DataFrame:
    """Audit rows per grid point with the stations it serves, matched by rounded coordinates."""
    spot = [F.round("latitude", 4).alias("lat"), F.round("longitude", 4).alias("lon")]
    issues = audit.groupBy(*spot).agg(F.count(F.lit(1)).alias("n_runs"), F.min("starttime").alias("first_run"))
    served = mapping.groupBy(*spot).agg(
        F.count(F.lit(1)).alias("n_stations"),
        F.min_by("station_id", F.struct(F.round("distance", 6), "station_id")).alias("nearest_station"),
    )
    return issues.join(served, ["lat", "lon"], "left")


def patch_store(
    store: DataFrame, source: DataFrame, run: Sequence[str], row: Sequence[str], expected: int
) -> tuple[DataFrame, DataFrame]:
    """Repair a store from a second source. Returns the new rows and an action per run.

    A run is ``added`` if the store lacks it and the source has it whole, ``replaced`` if
    the store's is short or holds nulls and the source's is whole, ``merged`` (missing
    rows only) if the source merely has more, else ``skipped`` or ``kept``.
    """
    values = [c for c in store.columns if c not in (*run, *row)]
    clean = first_rows(source.select(*store.columns).na.drop("any"), [*run, *row], values)
    holes = F.lit(False)
    for c in values:
        holes = holes | F.col(c).isNull()
    mine = store.groupBy(*run).agg(F.count(F.lit(1)).alias("n_store"), F.max(holes).alias("_holes"))
    theirs = clean.groupBy(*run).agg(F.count(F.lit(1)).alias("n_source"))
    both = mine.join(theirs, [*run], "full_outer").na.fill(0, ["n_store", "n_source"])
    whole, short = F.col("n_source") == expected, F.col("n_store") < expected
    action = (
        F.when(F.col("n_store") == 0, F.when(whole, "added").otherwise("skipped"))
        .when(whole & (short | F.col("_holes")), "replaced")
        .when(short & (F.col("n_source") > F.col("n_store")), "merged")
        .otherwise("kept")
    )
    log = both.select(*run, "n_store", "n_source", action.alias("action"))

    def of(*names: str) -> DataFrame:
        return log.filter(F.col("action").isin(*names)).select(*run)

    kept = store.join(of("replaced"), [*run], "left_anti")
    taken = clean.join(of("added", "replaced"), [*run], "left_semi")
    extra = clean.join(of("merged"), [*run], "left_semi").join(store.select(*run, *row), [*run, *row], "left_anti")
    return kept.unionByName(taken).unionByName(extra), log


def append_missing_runs(store: DataFrame, source: DataFrame, run: Sequence[str]) -> DataFrame:
    """The store and all runs of the source it lacks."""
    new = source.select(*store.columns).join(store.select(*run).distinct(), [*run], "left_anti")
    return store.unionByName(new)


def upsert(store: DataFrame, source: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Insert new keys; on known keys only null values are taken from the source.

    ``source`` must be unique per key.
    """
    new = source.select(*key, *[F.col(v).alias(f"_new_{v}") for v in values])
    out = store.select(*key, *values).join(new, [*key], "full_outer")
    return out.select(*key, *[F.coalesce(F.col(v), F.col(f"_new_{v}")).alias(v) for v in values])


def attrition(runs: DataFrame, grid: str, cols: Sequence[str], top: int = 15) -> DataFrame:
    """``metric, item, n`` on the (run, grid) slots: filled, missing, by feature, node and hour.

    Counted from totals, so missing slots are never spelled out.
    """
    slots = runs.groupBy("starttime", grid).agg(
        *[F.max(F.col(c).isNull().cast("int")).alias(f"_null_{c}") for c in cols]
    )
    # one aggregate over the slots: per run, per node and in all
    nulls = [F.sum(f"_null_{c}").alias(f"_null_{c}") for c in cols]
    marks = slots.groupingSets([["starttime"], [grid], []], "starttime", grid).agg(
        F.grouping_id().alias("_kind"), F.count(F.lit(1)).alias("_filled"), *nulls
    )
    is_run, is_node, is_total = (F.col("_kind") == kind for kind in (1, 2, 3))
    size = marks.agg(F.count_if(is_run).alias("runs"), F.count_if(is_node).alias("nodes"))
    n_runs, n_nodes = size.select("runs").scalar(), size.select("nodes").scalar()
    sized = marks.filter(~is_node).withColumn("_nodes", n_nodes)

    def entry(metric: str, item: Column, n: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), item.cast("string").alias("item"), n.cast("bigint").alias("n"))

    whole, none = F.col("_filled") == F.col("_nodes"), F.lit("all")
    of_run = F.array(
        entry("slots", none, F.col("_nodes")),
        entry("filled", none, F.col("_filled")),
        entry("missing", none, F.col("_nodes") - F.col("_filled")),
        entry("complete_runs", none, whole.cast("int")),
        entry("incomplete_runs", none, (~whole).cast("int")),
    )
    by_hour = F.array(entry("incomplete_runs_by_hour", F.hour("starttime"), F.lit(1)))
    of_all = F.array(*[entry("null_slots_by_feature", F.lit(c), F.col(f"_null_{c}")) for c in cols])
    entries = F.when(is_total, of_all).when(whole, of_run).otherwise(F.concat(of_run, by_hour))
    counted = sized.select(F.inline(entries)).groupBy("metric", "item").agg(F.sum("n").alias("n"))
    lost = marks.filter(is_node).withColumn("_lost", n_runs - F.col("_filled"))
    worst = lost.orderBy(F.desc("_lost"), grid).limit(top)
    return counted.unionByName(
        worst.select(F.lit("missing_by_node").alias("metric"), F.col(grid).cast("string").alias("item"), F.col("_lost").alias("n"))
    )


def check_layouts(layouts: dict[str, Sequence[str]]) -> None:
    """Raise unless all stations have the same columns in the same order."""
    names = list(layouts)
    base = list(layouts[names[0]])
    for name in names[1:]:
        cols = list(layouts[name])
        if cols != base:
            lost, extra = sorted(set(base) - set(cols)), sorted(set(cols) - set(base))
            what = f"missing {lost}, extra {extra}" if lost or extra else "other column order"
            raise ValueError(f"columns of {name!r} differ from {names[0]!r}: {what}")
