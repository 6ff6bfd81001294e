"""Exact nearest-neighbour and radius joins through equi-joins on spatial cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions.geo import EARTH_RADIUS_KM, METRICS, geodesic
from galeframe.operators.ordering import first_rows, latest_before, positions, spread

# Cell edges: the one of level 0, doubled per level until one cell spans the whole domain
# (kilometres on the sphere, degrees on the plane). Crowded points add levels below 0.
FINEST = {"haversine": 5.0, "degrees": 0.05}
LEVELS = 12
DEEPEST = -24
#: Points of a block, about, at least and at most, and blocks of one side there are to be, about.
BLOCK, MOST_BLOCK, BLOCKS = 256, 4096, 128
#: Most candidates of a leaf, at least and in multiples of those wanted.
LEAF, CROWD = 32, 4
#: Levels from a cell to those it is opened into, and most cells that a target starts from.
STEP, ROOTS = 2, 32
#: Targets of a task, about, where there are more of them than tasks in use.
TARGETS = 1_000
#: Most cells of a level that are broadcast, counted before, at some 100 bytes each; copies of a cell for each target beyond.
CELLS, COPIES = 250_000, 16
#: More than the largest relative difference of great-circle and WGS-84 distances.
SPHERE_ERROR = 0.006


def _axes(metric: str, lat: str = "latitude", lon: str = "longitude") -> dict[str, Column]:
    """Coordinates in which the straight-line distance orders like the metric."""
    if metric == "degrees":
        return {"_x": F.col(lat).cast("double"), "_y": F.col(lon).cast("double")}
    phi, lam = F.radians(lat), F.radians(lon)
    return {
        "_x": EARTH_RADIUS_KM * F.cos(phi) * F.cos(lam),
        "_y": EARTH_RADIUS_KM * F.cos(phi) * F.sin(lam),
        "_z": EARTH_RADIUS_KM * F.sin(phi),
    }


def _cell(axes: Sequence[str], edge: Column) -> list[Column]:
    return [F.floor(F.col(a) / edge).alias(f"_c{a}") for a in axes]


def _around(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One copy per neighbouring cell, the own cell included."""
    for a in axes:
        near = F.array(*[F.col(f"_c{a}") + d for d in (-1, 0, 1)])
        df = df.withColumn(f"_c{a}", F.explode(near))
    return df


def _points(df: DataFrame, key: str, prefix: str, metric: str) -> DataFrame:
    axes = _axes(metric)
    return df.select(
        F.col(key).alias(f"{prefix}_id"),
        F.col("latitude").alias(f"{prefix}_lat"),
        F.col("longitude").alias(f"{prefix}_lon"),
        *[v.alias(k) for k, v in axes.items()],
    )


def _distance(metric: str) -> Column:
    return METRICS[metric]("target_lat", "target_lon", "near_lat", "near_lon")


def _lowest_level(points: DataFrame, axes: Sequence[str], metric: str, most: int) -> int:
    """The highest level, 0 or below, at which no cell holds more than ``most`` points.

    A level is left by as many steps as its fullest cell needs if points lie on a surface, where a step leaves a quarter at best.
    """
    level = 0
    while level > DEEPEST:
        cells = points.select(*_cell(axes, F.lit(FINEST[metric] * 2.0**level)))
        counts = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("n"))
        fullest = counts.agg(F.max("n")).first()[0] or 0
        if fullest <= most:
            break
        level = max(DEEPEST, level - max(1, int(math.log(fullest / most, 4))))
    return level


def k_nearest(
    targets: DataFrame,
    candidates: DataFrame,
    k: int,
    target_key: str = "station_id",
    candidate_key: str = "grid_id",
    metric: str = "haversine",
    exclude_self: bool = False,
) -> DataFrame:
    """``target_id, near_id, rank, distance``: the k nearest candidates per target.

    Both sides carry ``latitude`` and ``longitude``. Candidates are counted in nested cells, down to a level at which none is
    crowded. A target starts from a few large cells, drops those that lie farther away than enough points certainly do, opens the
    others that hold many points into the cells inside, and so on; it meets the points of the leaves that are left. So a target
    looks at about as many cells and candidates however dense they are and however they gather, on lines or in clumps, and a
    candidate is in one leaf only. Ties in distance (to 1e-9) go to the smaller id. Candidates at one and the same position
    beyond the first k ids can never be chosen and are left out beforehand.

    ``geodesic`` ranks by distance on WGS-84: on the sphere a distance is off by less than
    ``SPHERE_ERROR``, so the candidates up to that far beyond the k-th one on the sphere, all
    of which the reach holds, are measured exactly and ranked again.
    """
    if metric == "geodesic":
        pairs = _ring_pairs(targets, candidates, k, target_key, candidate_key, "haversine", exclude_self, places=True)
        reach = first_rows(pairs, ["target_id"], ["distance"], k).groupBy("target_id").agg(F.max("distance").alias("_reach"))
        close = pairs.join(reach, "target_id").filter(F.col("distance") <= F.col("_reach") * (1 + SPHERE_ERROR) / (1 - SPHERE_ERROR) + 1e-9)
        exact = geodesic("target_lat", "target_lon", "near_lat", "near_lon")
        pairs = close.select("target_id", "near_id", exact["km"].alias("distance"))
    else:
        pairs = _ring_pairs(targets, candidates, k, target_key, candidate_key, metric, exclude_self)
    ranked = first_rows(pairs, ["target_id"], [F.round("distance", 9), "near_id"], k, "rank")
    return ranked.select("target_id", "near_id", F.col("rank").cast("int").alias("rank"), "distance")


def _ring_pairs(
    targets: DataFrame,
    candidates: DataFrame,
    k: int,
    target_key: str,
    candidate_key: str,
    metric: str,
    exclude_self: bool,
    places: bool = False,
) -> DataFrame:
    """``target_id, near_id, distance`` (and both places) of a target and the candidates of the leaves it can't rule out."""
    need = k
    near = _points(candidates, candidate_key, "near", metric).filter(F.col("near_lat").isNotNull() & F.col("near_lon").isNotNull())
    if exclude_self:  # the rows of a target's own id, one if ids are unique, are no candidates
        near = near.filter(F.col("near_id").isNotNull())
        own = near.groupBy("near_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        need = k + (own or 1)
    axes = list(_axes(metric))
    cells = ["_level", *[f"_c{a}" for a in axes]]
    near = first_rows(near, ["near_lat", "near_lon"], ["near_id"], need)
    leaf = max(LEAF, CROWD * need)
    lowest = _lowest_level(near, axes, metric, leaf)
    finest = [c.alias(f"_f{a}") for c, a in zip(_cell(axes, F.lit(FINEST[metric] * 2.0**lowest)), axes, strict=True)]
    near = near.select("*", *finest)
    keys = [f"_f{a}" for a in axes]

    # edges are doubled from level to level, so cells of one level are whole cells of the one below
    above = [F.floor(F.col(f) / F.pow(F.lit(2.0), F.col("_level") - lowest)).alias(c) for f, c in zip(keys, cells[1:], strict=True)]
    counts = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    nested = counts.withColumn("_level", F.explode(F.sequence(F.lit(lowest), F.lit(LEVELS + 1), F.lit(STEP))))
    nested = nested.select("_level", *keys, *above, "_n")
    tree = nested.groupBy(*cells).agg(F.sum("_n").alias("_n"))
    sizes = tree.groupBy("_level").agg(F.count(F.lit(1)).alias("cells"), F.max("_n").alias("fullest")).toLocalIterator()
    sizes = {r["_level"]: r for r in sizes} or {lowest: {"cells": 0, "fullest": 0}}
    top = min((level for level, r in sizes.items() if r["cells"] <= ROOTS), default=max(sizes))
    tree = tree.filter(F.col("_level") <= top)
    leaves = tree.filter((F.col("_n") <= leaf) | (F.col("_level") == lowest)).select(*cells)

    goal = _points(targets, target_key, "target", metric).filter(F.col("target_lat").isNotNull() & F.col("target_lon").isNotNull())
    goal = goal.groupBy("target_id", "target_lat", "target_lon", *axes).agg(F.count(F.lit(1)).alias("_times"))
    # windows over decimals deal the rows anew, however they are dealt, so a target is named by their exact text
    place = ["target_id", "_place"]
    goal = goal.withColumn("_place", F.concat_ws(" ", F.col("target_lat").cast("string"), F.col("target_lon").cast("string")))
    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in (*cells[1:], "_n")) + ">>"
    roots = tree.filter(F.col("_level") == top).toLocalIterator()
    roots = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in (*cells[1:], "_n")]) for r in roots]).cast(kind)
    # few rows go into windows and joins for the work they are, so their number of tasks is given
    n_targets = goal.count()
    tasks = max(spread(goal), n_targets // TARGETS)
    front = goal.repartition(tasks, *place).select("*", F.lit(top).alias("_level"), F.inline(roots), F.lit(None).cast("double").alias("_reach"))
    front = _reached(front, place, axes, metric, need)
    for level in range(top, lowest, -STEP):
        if sizes[level]["fullest"] <= leaf:
            break
        up = [F.floor(F.col(c) / 2**STEP).alias(c) for c in cells[1:]]
        below = tree.filter(F.col("_level") == level - STEP)
        below = below.select(F.lit(level).alias("_level"), *up, F.struct("_level", *cells[1:], "_n").alias("_child"))
        inner = below.groupBy(*cells).agg(F.collect_list("_child").alias("_inner"), F.sum("_child._n").alias("_held"))
        inner = inner.filter(F.col("_held") > leaf).drop("_held")
        n_cells = sizes[level - STEP]["cells"]
        copies = 0 if n_cells <= CELLS else max(1, min(tasks, COPIES * n_targets // n_cells))
        front = _reached(_opened(front, inner, place, cells, copies, tasks), place, axes, metric, need)

    homes = nested.select("_level", *keys, *cells[1:]).join(leaves, cells, "left_semi")
    homes = homes.groupBy(*keys).agg(F.max("_level").alias("_level"))
    housed = near.join(homes, keys).select("near_id", "near_lat", "near_lon", *[F.col(a).alias(f"{a}n") for a in axes], "_level", *above)
    pairs = front.drop("_n", "_place").repartition(tasks, *cells).join(housed.repartition(tasks, *cells), cells)
    apart = [(F.col(a) - F.col(f"{a}n")) * (F.col(a) - F.col(f"{a}n")) for a in axes]
    pairs = pairs.filter(F.col("_reach").isNull() | (sum(apart[1:], apart[0]) <= F.col("_reach") * F.col("_reach")))
    if exclude_self:
        pairs = pairs.filter(F.col("target_id") != F.col("near_id"))
    pairs = pairs.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_times"), F.lit(k)))))
    ends = ["target_lat", "target_lon", "near_lat", "near_lon"] if places else []
    return pairs.select("target_id", "near_id", _distance(metric).alias("distance"), *ends)


def _opened(front: DataFrame, inner: DataFrame, place: Sequence[str], cells: Sequence[str], copies: int, tasks: int) -> DataFrame:
    """``front`` with the cells inside (``_inner``) in place of each cell that ``inner`` opens.

    A cell that many targets look at is in all tasks: broadcast, so that targets stay where they are, or in ``copies`` that
    share its targets, where there are too many cells for that.
    """
    keys = list(cells)
    if copies:
        keys.append("_copy")
        inner = inner.withColumn("_copy", F.explode(F.array(*map(F.lit, range(copies))))).repartition(tasks, *keys)
        front = front.withColumn("_copy", F.pmod(F.xxhash64(*place), F.lit(copies)).cast("int")).repartition(tasks, *keys)
    else:
        inner = inner.hint("broadcast")
    own = F.array(F.struct(*cells, "_n"))
    rest = [c for c in front.columns if c not in {*keys, "_n"}]
    out = front.join(inner, keys, "left").select(*rest, F.inline(F.coalesce("_inner", own)))
    return out.repartition(tasks, *place) if copies else out


def _reached(front: DataFrame, place: Sequence[str], axes: Sequence[str], metric: str, need: int) -> DataFrame:
    """``front`` (a target and a cell with ``_n`` points) without cells that can't hold any of a target's nearest, and with a new ``_reach``.

    The cells whose farthest corners are nearest and that hold ``need`` points together bound the distance of the last one wanted.
    A target's cells are few whatever they hold, so the windows stay small; the rows of a target are in one task already.
    """
    edge = F.lit(FINEST[metric]) * F.pow(F.lit(2.0), F.col("_level"))
    sides = [(F.col(a) - F.col(f"_c{a}") * edge, (F.col(f"_c{a}") + 1) * edge - F.col(a)) for a in axes]
    close = [F.greatest(F.lit(0.0), -low, -high) for low, high in sides]
    far = [F.greatest(F.abs(low), F.abs(high)) for low, high in sides]
    length = lambda v: F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))
    whole = Window.partitionBy(*place)
    held = F.sum("_n").over(whole.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0))
    in_reach = F.col("_reach").isNull() | (F.col("_close") <= F.col("_reach"))
    rows = front.withColumns({"_close": length(close), "_far": length(far)}).filter(in_reach)
    rows = rows.withColumn("_held", held)
    # with room for rounding and the ellipsoid; nothing bounds the reach where there are too few points
    reach = F.min(F.when(F.col("_held") >= need, F.col("_far"))).over(whole) * (1 + 3 * SPHERE_ERROR) + 1e-6
    rows = rows.withColumn("_reach", reach)
    return rows.filter(in_reach).drop("_close", "_far", "_held")


def _blocks(df: DataFrame, key: str, prefix: str, metric: str, edge: Column) -> DataFrame:
    """Cell and ``_<prefix>``, an array of some points of the cell.

    What pairs of blocks carry grows with the number of blocks, so they are larger where points are many: there are enough of
    them for all tasks then.
    """
    axes = list(_axes(metric))
    cells = [f"_c{a}" for a in axes]
    points = _points(df, key, prefix, metric).filter(F.col(f"{prefix}_lat").isNotNull() & F.col(f"{prefix}_lon").isNotNull())
    own = [f"{prefix}_{x}" for x in ("id", "lat", "lon")]
    points = points.select(*own, *_cell(axes, edge))
    size = points.agg(F.count(F.lit(1)).alias("n")).select(F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), F.col("n") / BLOCKS)).alias("size"))
    crowds = points.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    crowds = crowds.select(*cells, F.ceil(F.col("_n") / size.scalar()).alias("_parts"))
    dealt = points.join(crowds, cells).withColumn("_part", F.pmod(F.xxhash64(*own), F.col("_parts")))
    return dealt.groupBy(*cells, "_part").agg(F.collect_list(F.struct(*own)).alias(f"_{prefix}")).drop("_part")


def within(
    targets: DataFrame,
    candidates: DataFrame,
    radius: float,
    target_key: str = "station_id",
    candidate_key: str = "station_id",
    metric: str = "haversine",
    once: bool = False,
) -> DataFrame:
    """``target_id, near_id, distance`` of all pairs at most ``radius`` apart.

    Points of a cell are dealt into blocks; blocks of neighbouring cells meet, evenly spread over the tasks, and are
    unfolded there. So the shuffles carry blocks, not pairs, and a crowded cell is many tasks.

    ``once`` keeps each unordered pair of a self-join once (``target_id < near_id``).
    """
    axes = list(_axes(metric))
    reach = radius
    if metric == "haversine":
        reach = 2 * EARTH_RADIUS_KM * math.sin(min(radius / (2 * EARTH_RADIUS_KM), math.pi / 2))
    edge = F.lit(reach * (1 + 1e-9) + 1e-9)
    cells = [f"_c{a}" for a in axes]
    goal = _around(_blocks(targets, target_key, "target", metric, edge), axes)
    met = goal.join(_blocks(candidates, candidate_key, "near", metric, edge), cells)
    met = met.select("_target", "_near").repartition(spread(met))
    pairs = met.select(F.inline("_target"), "_near").select("target_id", "target_lat", "target_lon", F.inline("_near"))
    if once:
        pairs = pairs.filter(F.col("target_id") < F.col("near_id"))
    return pairs.select("target_id", "near_id", _distance(metric).alias("distance")).filter(
        F.col("distance") <= radius
    )


def match_coordinates(
    targets: DataFrame, candidates: DataFrame, tolerance: float, target_key: str, candidate_key: str
) -> DataFrame:
    """Nearest candidate within ``tolerance`` degrees per target, null where there is none."""
    hits = within(targets, candidates, tolerance, target_key, candidate_key, "degrees")
    best = first_rows(hits, ["target_id"], [F.round("distance", 9), "near_id"])
    keys = targets.select(F.col(target_key).alias("target_id"))
    return keys.join(best, "target_id", "left")


def quadrant_labels(
    neighbours: DataFrame, targets: DataFrame, candidates: DataFrame, target_key: str, candidate_key: str
) -> DataFrame:
    """Compass label of each neighbour seen from its target; repeats get a running number."""
    t = targets.select(
        F.col(target_key).alias("target_id"),
        F.col("latitude").alias("_tlat"),
        F.col("longitude").alias("_tlon"),
    )
    c = candidates.select(
        F.col(candidate_key).alias("near_id"),
        F.col("latitude").alias("_nlat"),
        F.col("longitude").alias("_nlon"),
    )
    dlat, dlon = F.col("_nlat") - F.col("_tlat"), F.col("_nlon") - F.col("_tlon")
    label = (
        F.when((F.abs(dlat) < 0.01) & (F.abs(dlon) < 0.01), "C")
        .when((dlat >= 0) & (dlon >= 0), "NE")
        .when(dlat >= 0, "NW")
        .when(dlon >= 0, "SE")
        .otherwise("SW")
    )
    # a target has at most k neighbours, so this window stays small
    seen = F.row_number().over(Window.partitionBy("target_id", "_label").orderBy("rank"))
    out = neighbours.join(t, "target_id").join(c, "near_id").withColumn("_label", label)
    return out.withColumn(
        "label", F.concat("_label", F.when(seen > 1, seen.cast("string")).otherwise(""))
    ).drop("_tlat", "_tlon", "_nlat", "_nlon", "_label")


# Lattice offsets (latitude, longitude) of the labels around the first grid
# line north and east of a station, in the order in which points are handed out.
INNER_LABELS = {"NW": (0, -1), "NE": (0, 0), "SW": (-1, -1), "SE": (-1, 0)}
OUTER_LABELS = {
    "NNW": (1, -1), "NNE": (1, 0), "SSW": (-2, -1), "SSE": (-2, 0),
    "WNW": (0, -2), "WSW": (-1, -2), "ENE": (0, 1), "ESE": (-1, 1),
}


def enclosing_labels(
    targets: DataFrame, candidates: DataFrame, n: int = 4, target_key: str = "station_id",
    candidate_key: str = "grid_id",
) -> DataFrame:
    """``target_id, label, near_id, rel_lat, rel_lon``: grid points by compass position.

    Each label names a lattice point around the target; it gets the nearest grid point
    that no earlier label of the target holds, which is the point itself where it
    exists. At most ``n`` points are ever taken, so the ``n`` nearest per lattice point
    are enough. ``rel_*`` place the target inside its quad (0 south/west, 1 north/east).
    """
    if n not in (4, 12):
        raise ValueError("labels exist for 4 or 12 points")
    offsets = INNER_LABELS if n == 4 else INNER_LABELS | OUTER_LABELS
    margin = 1 if n == 4 else 2
    goal = targets.select(F.col(target_key).alias("target_id"), "latitude", "longitude")
    lattice = F.explode(F.array(*[
        F.struct(F.lit(i).alias("order"), F.lit(name).alias("label"), F.lit(a).alias("latitude"), F.lit(b).alias("longitude"))
        for i, (name, (a, b)) in enumerate(offsets.items())
    ])).alias("_label")
    points = goal.select("target_id", lattice)
    for axis in ("latitude", "longitude"):
        lines = positions(candidates.select(axis).distinct(), [], [axis], F.floor(axis), "_line", "_lines")
        lines = lines.withColumnRenamed(axis, "_value")
        below = latest_before(goal, lines, [], axis, "_value", ["_line"], F.floor, strict=True)
        total = lines.agg(F.max("_lines").alias("n")).scalar()
        first = F.least(F.greatest(F.coalesce("_line", F.lit(0)), F.lit(margin)), total - margin)
        spot = below.select("target_id", first.alias("_first"))
        index = F.greatest(F.least(F.col("_first") + F.col(f"_label.{axis}"), total - 1), F.lit(0)) + 1
        points = points.join(spot, "target_id").withColumn("_line", index).drop("_first")
        points = points.join(lines.select("_line", F.col("_value").alias(axis)), "_line").drop("_line")
    points = points.withColumn("_key", F.concat_ws("|", "target_id", "_label.label"))
    near = k_nearest(points, candidates, n, "_key", candidate_key)
    ranked = near.groupBy("target_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "near_id"))), lambda x: x["near_id"]).alias("_near")
    ).withColumnRenamed("target_id", "_key")
    kind = dict(candidates.dtypes)[candidate_key]
    rows = points.join(ranked, "_key")
    edge = {
        f"_{side}_{axis}": F.max(F.when(F.col("_label.label") == side, F.col(axis)))
        for side in ("SW", "NE") for axis in ("latitude", "longitude")
    }
    grouped = rows.groupBy("target_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_label.order"), F.col("_label.label"), "_near"))).alias("_all"),
        *[c.alias(k) for k, c in edge.items()],
    )
    start = F.array().cast(f"array<struct<label:string,near_id:{kind}>>")

    def take(taken, item):
        free = F.filter(item["_near"], lambda x: ~F.exists(taken, lambda u: u["near_id"] == x))
        return F.when(
            F.size(free) > 0,
            F.concat(taken, F.array(F.struct(item["label"].alias("label"), F.get(free, F.lit(0)).alias("near_id")))),
        ).otherwise(taken)

    chosen = grouped.withColumn("_p", F.explode(F.aggregate("_all", start, take))).join(goal, "target_id")

    def share(axis: str) -> Column:
        return F.try_divide(F.col(axis) - F.col(f"_SW_{axis}"), F.col(f"_NE_{axis}") - F.col(f"_SW_{axis}"))

    return chosen.select(
        "target_id", F.col("_p.label").alias("label"), F.col("_p.near_id").alias("near_id"),
        share("latitude").alias("rel_lat"), share("longitude").alias("rel_lon"),
    )


def nearest_to_group(targets: DataFrame, candidates: DataFrame, radius: float, k: int, key: str = "station_id") -> DataFrame:
    """The k candidates closest to any target, among those within ``radius`` km of one."""
    hits = within(targets, candidates, radius, key, key)
    closest = hits.groupBy("near_id").agg(F.min("distance").alias("distance"))
    return closest.orderBy(F.round("distance", 9), "near_id").limit(k)


def neighbour_series(
    series: DataFrame, neighbours: DataFrame, cols: Sequence[str], k: int, time: str = "timestamp"
) -> DataFrame:
    """Series of each target's k neighbours as ``{col}_next_{rank}`` columns."""
    near = neighbours.select(F.col("near_id").alias("station_id"), "target_id", "rank")
    rows = series.select("station_id", time, *cols).join(near, "station_id")
    picks = [
        F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}_next_{r}") for c in cols for r in range(1, k + 1)
    ]
    return rows.groupBy(F.col("target_id").alias("station_id"), time).agg(*picks)
