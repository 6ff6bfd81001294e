"""Semivariograms, kriging weights and spatial interpolation of station series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from galeframe.functions.geo import EARTH_RADIUS_KM, inverse_geodesic, utm
from galeframe.operators.neighbours import k_nearest, within
from galeframe.operators.ordering import positions, spread

#: Stations of a tile, about: where pairs are listed, and where all within reach meet.
TILE, WIDE_TILE = 64, 512
#: Tiles of a group that a task holds, at least and at most, and most values of it (16 bytes each).
GROUP, MOST_GROUP, HELD_VALUES = 8, 24, 4 << 20
#: Values of neighbours that are worked on at once, about.
MOST_EDGES = 1 << 20
#: Systems that are solved at once.
SYSTEMS = 10_000
#: Bytes of tables of a group that are kept, times of one table, and rows of a batch of pairs that comes out.
DENSE_BYTES, SLOTS, OUT_ROWS = 80 << 20, 1024, 1 << 16


# -- models --------------------------------------------------------------------


def _shape_column(model: str, x: Column) -> Column:
    if model == "gaussian":
        return 1.0 - F.exp(-x * x)
    if model == "exponential":
        return 1.0 - F.exp(-x)
    return F.when(x <= 1, 1.5 * x - 0.5 * x * x * x).otherwise(1.0)


def _shape_values(model: str, x: np.ndarray) -> np.ndarray:
    if model == "gaussian":
        return 1.0 - np.exp(-(x**2))
    if model == "exponential":
        return 1.0 - np.exp(-x)
    return np.where(x <= 1, 1.5 * x - 0.5 * x**3, 1.0)


def variogram(model: str, h: Column | str, nugget, psill, range_) -> Column:
    """Semivariance at distance ``h``, 0 at 0; an unknown model means spherical."""
    h = F.col(h) if isinstance(h, str) else h
    return F.when(h == 0, 0.0).otherwise(nugget + psill * _shape_column(model, h / range_))


def variogram_values(model: str, h: np.ndarray, nugget, psill, range_) -> np.ndarray:
    return np.where(h == 0, 0.0, nugget + psill * _shape_values(model, h / range_))


# -- empirical semivariograms --------------------------------------------------


def detrend(series: DataFrame, value: str, station: str = "station_id") -> DataFrame:
    """Subtract each station's mean over time."""
    mean = series.groupBy(station).agg(F.avg(value).alias("_mean"))
    return series.join(mean, station).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


@dataclass(frozen=True)
class StationPairs:
    """All pairs of stations up to ``max_km`` apart, each once; they are many more than stations, so only ``rows`` lists them.

    ``placed`` has other coordinates, whose straight-line distance counts then; ``reach`` bounds the great-circle distance too.
    """

    stations: DataFrame
    max_km: float
    placed: DataFrame | None = None
    reach: float | None = None

    def rows(self) -> DataFrame:
        """``i, j, distance``."""
        if self.placed is not None:
            return _planar_pairs(self.placed, StationPairs(self.stations, self.reach or self.max_km).rows(), self.max_km)
        pairs = within(self.stations, self.stations, self.max_km, once=True)
        return pairs.select(F.col("target_id").alias("i"), F.col("near_id").alias("j"), "distance")


def station_pairs(stations: DataFrame, max_km: float, placed: DataFrame | None = None, reach: float | None = None) -> StationPairs:
    """All station pairs up to ``max_km``, each once."""
    return StationPairs(stations, max_km, placed, reach)


def station_tiles(stations: DataFrame, km: float = 100.0, most: int = TILE) -> DataFrame:
    """``station_id, tile``: stations of one cell of about ``km``, at most about ``most`` of them."""
    cell = [F.floor(F.col(c) * 111.2 / km).alias(f"_{c}") for c in ("latitude", "longitude")]
    rows = stations.select("station_id", *cell).distinct()
    crowds = rows.groupBy("_latitude", "_longitude").agg(F.ceil(F.count("*") / most).alias("_parts"))
    part = F.pmod(F.xxhash64("station_id"), F.col("_parts"))
    return rows.join(crowds, ["_latitude", "_longitude"]).select("station_id", F.xxhash64("_latitude", "_longitude", part).alias("tile"))


def _tile_sums(one: pa.Array, other: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sums of squared differences, times both have) of each station of one tile with each of another.

    Stations come with their times t and values v; a mask product counts common times, and three products of masked, centred
    values give the sums.
    """
    sides = [one] if one is other else [one, other]
    times = [x.field("t").flatten().to_numpy() for x in sides]
    values = [x.field("v").flatten().to_numpy(zero_copy_only=False) for x in sides]
    slots = np.unique(np.concatenate(times))
    centre = np.concatenate(values).mean()
    filled, masks = [], []
    for x, t, v in zip(sides, times, values, strict=True):
        at = np.repeat(np.arange(len(x)), x.field("t").value_lengths().to_numpy()), np.searchsorted(slots, t)
        table, mask = np.zeros((len(x), len(slots))), np.zeros((len(x), len(slots)))
        table[at], mask[at] = v - centre, 1.0
        filled.append(table)
        masks.append(mask)
    a, b, m, n = filled[0], filled[-1], masks[0], masks[-1]
    total = (a * a) @ n.T - 2 * a @ b.T + m @ (b * b).T
    return np.maximum(total, 0.0), m @ n.T


def _pair_sums(one: pa.Array, other: pa.Array, same: bool) -> tuple[np.ndarray, ...]:
    """(place in one, place in other, sum of squared differences, times both have) of the stations of two tiles.

    Within one tile each pair is given once.
    """
    total, count = _tile_sums(one, one if same else other)
    i, j = np.nonzero(np.triu(count, 1) if same else count)
    return i, j, total[i, j], count[i, j].astype(np.int64)


def _along_curve(lat: str, lon: str, bits: int = 16) -> Column:
    """Place on a Z-shaped curve through cells of some 300 m, so that rows close on it are close in space."""
    out = F.lit(0).cast("long")
    for at, (c, span) in enumerate(((lat, 180.0), (lon, 360.0))):
        cell = F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), F.floor((F.col(c) / span + 0.5) * 2**bits))).cast("long")
        for i in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, i).bitwiseAND(1), 2 * i + at))
    return out


def _tiled(pairs: StationPairs) -> DataFrame:
    """``station_id, tile, pos, lat, lon, x, y``: a number along a curve in space for each row of the stations that has a place.

    A tile is ``WIDE_TILE`` consecutive numbers.
    """
    rows = pairs.stations.select("station_id", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"))
    rows = rows.na.drop()
    if pairs.placed is None:
        rows = rows.withColumns({"x": F.col("lat"), "y": F.col("lon")})
    else:
        rows = rows.join(pairs.placed.select("station_id", F.col("latitude").alias("x"), F.col("longitude").alias("y")), "station_id")
    rows = rows.withColumn("_z", _along_curve("lat", "lon"))
    numbered = positions(rows, [], ["_z", "station_id", "lat", "lon", "x", "y"], F.shiftright("_z", 8))
    pos = F.col("pos") - 1
    return numbered.select("station_id", F.floor(pos / WIDE_TILE).alias("tile"), pos.alias("pos"), "lat", "lon", "x", "y")


def _meetings(tiled: DataFrame, km: float, one: str, other: str) -> DataFrame:
    """``one, other`` of the parts of the stations (columns of ``tiled``) that may be up to ``km`` apart: their boxes in space are."""
    phi, lam = F.radians("lat"), F.radians("lon")
    axes = {"_x": F.cos(phi) * F.cos(lam), "_y": F.cos(phi) * F.sin(lam), "_z": F.sin(phi)}
    ends = [f(EARTH_RADIUS_KM * v).alias(f"{n}{k}") for k, v in axes.items() for n, f in (("low", F.min), ("high", F.max))]

    def cells(part: str, s: str, margin: float) -> DataFrame:
        """Boxes, widened by a margin, once in each cell of about ``km`` that they touch."""
        boxes = tiled.groupBy(part).agg(*ends)
        out = boxes.select(F.col(part).alias(s), *[F.col(c).alias(f"{s}{c}") for c in boxes.columns if c != part])
        for k in axes:
            ends_ = [F.floor((F.col(f"{s}{e}{k}") + m) / (km + 1.0)) for e, m in (("low", -margin), ("high", margin))]
            out = out.withColumn(f"_c{k}", F.explode(F.sequence(*ends_)))
        return out

    gaps = [F.greatest(F.lit(0.0), F.col(f"alow{k}") - F.col(f"bhigh{k}"), F.col(f"blow{k}") - F.col(f"ahigh{k}")) for k in axes]
    near = F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])) <= km + 1e-6
    met = cells(one, "a", 0.0).join(cells(other, "b", km + 1e-3), [f"_c{k}" for k in axes])
    return met.filter(near).select(F.col("a").alias(one), F.col("b").alias(other)).distinct()


class _Group:
    """The values of a group of stations, held in short form, which tiles of stations meet one after the other."""

    def __init__(self) -> None:
        self.blocks: dict = {}
        self.place: dict = {}
        self.values: dict = {}
        self.dense: dict = {}
        self.room = DENSE_BYTES

    def add(self, span: object, tile: int, block: pa.Array) -> None:
        self.blocks.setdefault(span, []).append((tile, block))

    def settle(self) -> None:
        """Number the times of each span and free the rows they came in."""
        self.slots, self.centre = {}, {}
        for span, blocks in self.blocks.items():
            parts = [(tile, *_entries(block, tile)) for tile, block in blocks]
            self.slots[span] = np.unique(np.concatenate([t for _, _, t, _ in parts]))
            self.centre[span] = np.concatenate([v for *_, v in parts]).mean()
            self.values[span] = [
                (tile, at.astype(np.int32), np.searchsorted(self.slots[span], t).astype(np.int32), v - self.centre[span]) for tile, at, t, v in parts
            ]
            for tile, block in blocks:
                _note(self.place, tile, block)
        self.blocks = {}

    def _left(self, span: object, n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Squares, values times -2 and mask of a tile in a stretch of times, side by side; those first made are kept."""
        name = span, n, first
        if name in self.dense:
            return self.dense[name]
        _, at, slot, v = self.values[span][n]
        some = (slot >= first) & (slot < last)
        made = _left_side(at[some], slot[some] - first, v[some], last - first)
        size = made[0].nbytes + made[1].nbytes
        if size <= self.room:
            self.room -= size
            self.dense[name] = made
        return made

    def meet(self, span: object, tile: int, block: pa.Array, sums: dict) -> None:
        """Add what a tile's values of one span have in common with the group's to ``sums``, a pair of matrices for each own tile.

        Of two tiles of the group only the first takes the other.
        """
        if span not in self.values:
            return
        slots = self.slots[span]
        at, t, v = _entries(block, tile)
        slot = np.searchsorted(slots, t)
        known = slots[np.minimum(slot, len(slots) - 1)] == t
        at, slot, v = at[known], slot[known], v[known] - self.centre[span]
        used = np.unique(slot)
        few = 2 * len(used) < len(slots)  # hardly any common times: only those count
        for first in range(0, len(used) if few else len(slots), SLOTS):
            if few:
                own = used[first : first + SLOTS]
                some = (slot >= own[0]) & (slot <= own[-1])
                place, width = np.searchsorted(own, slot[some]), len(own)
            else:
                width = min(SLOTS, len(slots) - first)
                some = (slot >= first) & (slot < first + width)
                place = slot[some] - first
            if not some.any():
                continue
            right, mask = _right_side(at[some], place, v[some], width)
            for n, (mine, at_a, slot_a, v_a) in enumerate(self.values[span]):
                if mine > tile and tile in self.place:
                    continue
                if few:
                    to = np.searchsorted(own, slot_a)
                    held = own[np.minimum(to, width - 1)] == slot_a
                    left, left_mask = _left_side(at_a[held], to[held], v_a[held], width)
                else:
                    left, left_mask = self._left(span, n, first, first + width)
                if mine not in sums:
                    sums[mine] = np.zeros((WIDE_TILE, WIDE_TILE)), np.zeros((WIDE_TILE, WIDE_TILE), np.float32)
                sums[mine][0][:] += left @ right.T
                sums[mine][1][:] += left_mask @ mask.T


def _entries(block: pa.Array, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the tile, time and value of each value of a block."""
    times = block.field("t")
    at = np.repeat(block.field("pos").to_numpy() - tile * WIDE_TILE, times.value_lengths().to_numpy())
    return at, times.flatten().to_numpy(), block.field("v").flatten().to_numpy(zero_copy_only=False)


def _note(place: dict, tile: int, block: pa.Array) -> None:
    """Names and places of the stations of a tile, in their order there."""
    names, spots = place.setdefault(tile, ([None] * WIDE_TILE, np.full((4, WIDE_TILE), np.nan)))
    at = block.field("pos").to_numpy() - tile * WIDE_TILE
    for k, name in zip(at.tolist(), block.field("station_id").to_pylist(), strict=True):
        names[k] = name
    for row, c in zip(spots, ("lat", "lon", "x", "y"), strict=True):
        row[at] = block.field(c).to_numpy()


def _table(at: np.ndarray, slot: np.ndarray, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    table, mask = np.zeros((WIDE_TILE, width)), np.zeros((WIDE_TILE, width), np.float32)
    table[at, slot], mask[at, slot] = v, 1.0
    return table, mask


def _left_side(at: np.ndarray, slot: np.ndarray, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    table, mask = _table(at, slot, v, width)
    return np.concatenate([table * table, -2.0 * table, mask], axis=1), mask


def _right_side(at: np.ndarray, slot: np.ndarray, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    table, mask = _table(at, slot, v, width)
    return np.concatenate([mask, table, table * table], axis=1), mask


def _between(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Great-circle distances of all places (latitudes, longitudes) of one side to all of the other, without an angle function a pair."""
    (lat, lon), (lat2, lon2) = np.radians(one), np.radians(other)
    half = lambda x, y: np.outer(np.sin(x / 2), np.cos(y / 2)) - np.outer(np.cos(x / 2), np.sin(y / 2))
    a = half(lat, lat2) ** 2 + np.outer(np.cos(lat), np.cos(lat2)) * half(lon, lon2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _brought_together(series: DataFrame, pairs: StationPairs, value: str, time: str, by: Sequence[str], span: str) -> DataFrame:
    """The rows a task of ``_near_pair_semivariance`` takes, in their order: for each group (``_a``, ``_part`` and ``by``) its own tiles,
    then those it meets (``_side`` 1), each with the values of one span."""
    tiled = _tiled(pairs)
    tasks = spread(tiled)
    n_tiles = max(1, -(-tiled.count() // WIDE_TILE))
    most = max(GROUP, min(MOST_GROUP, n_tiles // 24))
    parts = -(-tasks // -(-n_tiles // most))
    tasks = max(tasks, -(-n_tiles // most) * parts)

    rows = series.filter(F.col(value).isNotNull()).withColumn("_span", F.date_trunc(span, time))
    entry = F.struct(F.unix_micros(F.col(time)).alias("t"), F.col(value).cast("double").alias("v"))
    of_station = rows.groupBy(*by, "station_id", "_span").agg(F.collect_list(entry).alias("_e"))
    # a group is smaller where its values would not fit
    n_values = of_station.agg(F.coalesce(F.sum(F.size("_e")), F.lit(0)).alias("n")).scalar()
    size = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(HELD_VALUES * n_tiles) / (n_values + 1)))).cast("long")
    tiles = tiled.withColumn("group", F.floor(F.col("tile") / size))
    of_station = of_station.join(tiles.select("station_id", "tile", "group", "pos", "lat", "lon", "x", "y"), "station_id")
    member = F.struct("pos", "station_id", "lat", "lon", "x", "y", F.col("_e.t").alias("t"), F.col("_e.v").alias("v"))
    blocks = of_station.groupBy(*by, "_span", F.col("tile").alias("_tile")).agg(F.collect_list(member).alias("_block"))

    owner = tiles.groupBy("tile").agg(F.min("group").alias("own"))
    meet = _meetings(tiles, pairs.reach or pairs.max_km, "group", "tile").join(owner, "tile")
    taken = (F.col("group") == F.col("own")) | ((F.col("group") < F.col("own")) == ((F.col("group") + F.col("own")) % 2 == 0))
    comes = meet.filter(taken).select("tile", F.col("group").alias("_a"), (F.col("tile") % parts).alias("_part"), F.lit(1).alias("_side"))
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part")
    stays = owner.select("tile", F.col("own").alias("_a"), shares).withColumn("_side", F.lit(0))
    goes = comes.unionByName(stays).groupBy("tile").agg(F.collect_list(F.struct("_a", "_part", "_side")).alias("_goes"))
    goes = goes.withColumnRenamed("tile", "_tile")
    met = blocks.join(goes, "_tile").select(F.inline("_goes"), *by, "_tile", "_span", "_block")
    group = ["_a", "_part", *by]
    met = met.repartitionById(tasks, ((F.col("_a") * parts + F.col("_part")) % tasks).cast("int"))
    return met.sortWithinPartitions(*group, "_side", "_tile", "_span")


def _near_pair_semivariance(
    series: DataFrame, pairs: StationPairs, value: str, time: str, by: Sequence[str], span: str
) -> DataFrame:
    """``pair_semivariance`` of all pairs, which are found where the values of a group of stations and of a tile meet.

    Stations are numbered along a curve in space; ``WIDE_TILE`` of them are a tile, some tiles a group. The values of a tile in
    one span are one row. A task holds the values of one group and takes the tiles within reach one after the other,
    span by span, adds up a matrix of sums for each tile of the group and leaves out at the end what is too far apart. Of two
    groups one takes the tiles of the other. So a shuffle carries each tile to half the groups within reach and to the tasks that
    share a group's work, and neither pairs nor their sums; the number of pairs is the number of rows that come out.
    """
    met, group = _brought_together(series, pairs, value, time, by, span), ["_a", "_part", *by]
    fields = [met.schema[c] for c in by]
    kinds = {c: to_arrow_type(met.schema[c].dataType) for c in by}
    kind = series.schema["station_id"].dataType
    pairs_placed, reach, max_km = pairs.placed is not None, pairs.reach or pairs.max_km, pairs.max_km

    def finished(name: tuple, mine: int, tile: int, one: tuple, other: tuple, total: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = np.triu(count, 1) > 0 if mine == tile else count > 0
        (ids, spots), (ids2, spots2) = one, other
        distance = _between(spots[:2], spots2[:2])
        if pairs_placed:
            keep &= distance <= reach
            distance = np.sqrt(np.subtract.outer(spots[2], spots2[2]) ** 2 + np.subtract.outer(spots[3], spots2[3]) ** 2)
        keep &= distance <= max_km
        order = {s: n for n, s in enumerate(sorted({*ids, *ids2} - {None}))}
        rank, rank2 = (np.array([order.get(s, -1) for s in x]) for x in (ids, ids2))
        keep &= rank[:, None] != rank2[None, :]
        names = pa.array([*order], to_arrow_type(kind))
        i, j = np.nonzero(keep)
        p, q = rank[i], rank2[j]
        ends = [names.take(pa.array(x)) for x in (np.minimum(p, q), np.maximum(p, q))]
        fixed = [pa.array([v], kinds[c]).take(pa.array(np.zeros(len(i), np.int8))) for c, v in zip(by, name[2:], strict=True)]
        value = 0.5 * np.maximum(total[i, j], 0.0) / count[i, j]
        whole = pa.RecordBatch.from_arrays([*fixed, *ends, pa.array(distance[i, j]), pa.array(value)], names=[*by, "i", "j", "distance", "semivariance"])
        for first in range(0, len(i), OUT_ROWS):
            yield whole.slice(first, OUT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, tile, sums, place = None, None, None, {}, {}

        def closed() -> Iterator[pa.RecordBatch]:
            for mine in [*sums]:
                yield from finished(name, mine, tile, held.place[mine], place[tile], *sums.pop(mine))
            place.clear()

        for batch in batches:
            for r in range(len(batch)):
                here = tuple(batch.column(c)[r].as_py() for c in group)
                at, when, block = batch.column("_tile")[r].as_py(), batch.column("_span")[r], batch.column("_block")[r].values
                if here != name or at != tile:
                    yield from closed()
                    tile = at
                if here != name:
                    name, held = here, _Group()
                if batch.column("_side")[r].as_py() == 0:
                    held.add(when, at, block)
                    continue
                if held.blocks:
                    held.settle()
                _note(place, at, block)
                held.meet(when, at, block, sums)
        if held is not None:
            yield from closed()

    schema = T.StructType([*fields, T.StructField("i", kind), T.StructField("j", kind), *T.StructType.fromDDL("distance double, semivariance double").fields])
    return met.mapInArrow(run, schema)


def pair_semivariance(
    series: DataFrame, pairs: DataFrame | StationPairs, value: str, time: str = "timestamp", by: Sequence[str] = (),
    stations: DataFrame | None = None, span: str = "month",
) -> DataFrame:
    """``0.5 * mean((z_i - z_j)^2)`` per pair over the times at which both have values.

    Stations are dealt into tiles (by place if ``stations`` has coordinates, else by hash). The values of a tile in
    one ``span`` of time are one row, which meets each tile it has listed pairs with once; the sums of all pairs
    of the two come from masked matrix products. So rows in a shuffle are tiles times spans times neighbouring tiles, and
    a pair has one partial sum a span. A station has one value a time. Pairs that are not listed (``station_pairs``) are
    found where the tiles meet.
    """
    if isinstance(pairs, StationPairs):
        return _near_pair_semivariance(series, pairs, value, time, by, span)
    if stations is not None:
        tiles = station_tiles(stations, most=TILE)
    else:
        ends = pairs.select(F.explode(F.array("i", "j")).alias("station_id")).distinct()
        parts = ends.agg(F.ceil(F.count("*") / TILE)).scalar()
        tiles = ends.select("station_id", F.pmod(F.xxhash64("station_id"), parts).alias("tile"))
    rows = series.filter(F.col(value).isNotNull()).withColumn("_span", F.date_trunc(span, time))
    entry = F.struct(F.unix_micros(F.col(time)).alias("t"), F.col(value).cast("double").alias("v"))
    of_station = rows.groupBy(*by, "station_id", "_span").agg(F.collect_list(entry).alias("e")).join(tiles, "station_id")
    member = F.struct("station_id", F.col("e.t").alias("t"), F.col("e.v").alias("v"))
    blocks = of_station.groupBy(*by, "_span", "tile").agg(F.sort_array(F.collect_list(member)).alias("_rows"))
    tile_of = lambda end: tiles.select(F.col("station_id").alias(end), F.col("tile").alias(f"_{end}"))
    meet = pairs.join(tile_of("i"), "i").join(tile_of("j"), "j").select(F.least("_i", "_j").alias("_a"), F.greatest("_i", "_j").alias("_b")).distinct()
    one = blocks.select(*by, "_span", F.col("tile").alias("_a"), F.col("_rows").alias("_one"))
    other = blocks.select(*by, "_span", F.col("tile").alias("_b"), F.col("_rows").alias("_other"))
    met = one.join(meet, "_a").join(other, [*by, "_span", "_b"]).select(*by, "_a", "_b", "_one", "_other")
    fields = [met.schema[c] for c in by]
    kind = series.schema["station_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                one, other = (batch.column(c)[r].values for c in ("_one", "_other"))
                i, j, total, n = _pair_sums(one, other, batch.column("_a")[r].as_py() == batch.column("_b")[r].as_py())
                fixed = [batch.column(c).take(pa.array(np.full(len(i), r))) for c in by]
                ends = [x.field("station_id").take(pa.array(at)) for x, at in ((one, i), (other, j))]
                yield pa.RecordBatch.from_arrays([*fixed, *ends, pa.array(total), pa.array(n)], names=[*by, "_p", "_q", "_total", "_n"])

    schema = T.StructType([*fields, *T.StructType.fromDDL(f"_p {kind}, _q {kind}, _total double, _n long").fields])
    sums = met.mapInArrow(run, schema).groupBy(*by, F.least("_p", "_q").alias("_p"), F.greatest("_p", "_q").alias("_q"))
    sums = sums.agg((0.5 * F.sum("_total") / F.sum("_n")).alias("semivariance"))
    listed = pairs.select("*", F.least("i", "j").alias("_p"), F.greatest("i", "j").alias("_q"))
    return listed.join(sums, ["_p", "_q"]).select(*by, "i", "j", "distance", "semivariance")


def bin_semivariance(
    pair_values: DataFrame, max_km: float, n_lags: int, by: Sequence[str] = ()
) -> DataFrame:
    """Mean of the pair values per right-closed distance bin."""
    width = max_km / n_lags
    lag = F.least(F.greatest(F.ceil(F.col("distance") / width) - 1, F.lit(0)), F.lit(n_lags - 1))
    return pair_values.groupBy(*by, lag.cast("int").alias("lag_bin")).agg(
        F.avg("semivariance").alias("semivariance"), F.count(F.lit(1)).alias("n_pairs")
    ).withColumn("lag_km", (F.col("lag_bin") + 0.5) * width)


def in_direction(bearing: Column, azimuth: Column, tolerance: float) -> Column:
    """Whether a bearing lies within ``tolerance`` of an axis (both folded to 180 degrees)."""
    off = F.abs(F.pmod(bearing, F.lit(180.0)) - azimuth)
    return F.least(off, 180.0 - off) <= tolerance


# -- fit -----------------------------------------------------------------------


# Fixed values of the fit: share of the first semivariance taken as nugget at the start, share of the sill at which
# the range starts, least partial sill and range, most sill and range in multiples of the largest values.
NUGGET_START, SILL_START, LEAST_FIT, MOST_SILL, MOST_RANGE = 0.5, 0.8, 1e-6, 3, 2


def _fit(lags: np.ndarray, gamma: np.ndarray, model: str, rounds: int = 200) -> tuple[float, float, float]:
    """Damped least squares inside the bounds, started at 80 % of the sill."""
    sill = float(gamma.max())
    reached = min(int(np.searchsorted(gamma, SILL_START * sill)), len(lags) - 1)
    start = np.array([gamma[0] * NUGGET_START, sill - gamma[0] * NUGGET_START, lags[reached]])
    low = np.array([0.0, LEAST_FIT, LEAST_FIT])
    high = np.array([MOST_SILL * sill, MOST_SILL * sill, MOST_RANGE * lags[-1]])
    if not np.all(low < high):
        return tuple(start)

    def miss(p):
        return variogram_values(model, lags, *p) - gamma

    p = np.clip(start, low, high)
    r = miss(p)
    damping = 1e-3
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(miss(p + e) - r) / e[i] for i, e in enumerate(np.diag(step))], axis=1)
        hess, grad = jac.T @ jac, jac.T @ r
        # a parameter held at its bound by the gradient does not move
        held = ((p <= low) & (grad > 0)) | ((p >= high) & (grad < 0))
        free = ~held
        if not free.any():
            break
        scale = np.diag(np.maximum(np.diag(hess)[free], 1e-12))
        move = np.zeros(3)
        move[free] = np.linalg.lstsq(hess[np.ix_(free, free)] + damping * scale, -grad[free], rcond=None)[0]
        trial = np.clip(p + move, low, high)
        r_trial = miss(trial)
        if r_trial @ r_trial < r @ r:
            done = np.abs(trial - p).max() <= 1e-10 * (1 + np.abs(p).max())
            p, r, damping = trial, r_trial, damping / 3
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return tuple(p) if np.all(np.isfinite(p)) else tuple(start)


def fit_variograms(binned: DataFrame, model: str = "spherical", by: Sequence[str] = ()) -> DataFrame:
    """``nugget, psill, range`` per key from the bins; a key has at most ``n_lags`` bins."""
    points = F.sort_array(F.collect_list(F.struct("lag_km", "semivariance"))).alias("_points")
    keys = [*by] or ["_all"]
    rows = (binned if by else binned.withColumn("_all", F.lit(0))).groupBy(*keys).agg(points)
    rows = rows.select(*keys, F.col("_points.lag_km").alias("_x"), F.col("_points.semivariance").alias("_y"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                _fit(np.asarray(x, float), np.asarray(y, float), model)
                for x, y in zip(batch["_x"], batch["_y"])
            ]
            values = np.array(found, dtype=float).reshape(-1, 3)
            yield batch[keys].assign(nugget=values[:, 0], psill=values[:, 1], range=values[:, 2])

    fitted = rows.mapInPandas(fit, f"{schema}, nugget double, psill double, range double")
    return fitted.select(*by, "nugget", "psill", "range")


def flat_variograms(params: DataFrame) -> DataFrame:
    return params.withColumn("flat", F.col("nugget") + F.col("psill") < 1e-6)


# -- kriging weights -----------------------------------------------------------


def _haversine(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _planar(x1, y1, x2, y2):
    return np.hypot(x2 - x1, y2 - y1)


DISTANCES: dict[str, Callable] = {
    "haversine": _haversine,
    "geodesic": lambda *p: inverse_geodesic(*p)[0],
    "planar": _planar,
}


def anisotropic_axes(stations: DataFrame, angle_deg: float, ratio: float) -> DataFrame:
    """Stations with planar coordinates in km whose distance is the anisotropic one."""
    east, north = utm(F.col("latitude"), F.col("longitude"))
    theta = F.radians(F.lit(float(angle_deg)))
    along = (east * F.sin(theta) + north * F.cos(theta)) / 1000.0
    across = (east * F.cos(theta) - north * F.sin(theta)) / (1000.0 * ratio)
    return stations.select("station_id", along.alias("latitude"), across.alias("longitude"))


def solve_weights(near: np.ndarray, target: np.ndarray, params: np.ndarray, model: str, metric: str) -> np.ndarray:
    """Ordinary kriging weights of ``(b, k, 2)`` neighbours for ``b`` targets with ``(b, 3)`` parameters."""
    b, k = near.shape[:2]
    distance = DISTANCES[metric]
    x, y = near[..., 0], near[..., 1]
    nugget, psill, reach = (params[:, i, None, None] for i in range(3))
    system = np.ones((b, k + 1, k + 1))
    between = distance(x[:, :, None], y[:, :, None], x[:, None, :], y[:, None, :]) * (1 - np.eye(k))
    system[:, :k, :k] = variogram_values(model, between, nugget, psill, reach)
    system[:, k, k] = 0.0
    right = np.ones((b, k + 1, 1))
    to_target = distance(x, y, target[:, :1], target[:, 1:])
    right[:, :k, 0] = variogram_values(model, to_target, nugget[..., 0], psill[..., 0], reach[..., 0])
    try:
        return np.linalg.solve(system, right)[:, :k, 0]
    except np.linalg.LinAlgError:  # some are singular: least squares for those alone
        return np.stack([_solve_one(m, r)[:k] for m, r in zip(system, right[..., 0], strict=True)])


def _solve_one(system: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(system, right)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(system, right, rcond=None)[0]


def kriging_weights(
    neighbours: DataFrame,
    stations: DataFrame,
    cells: DataFrame,
    params: DataFrame,
    by: Sequence[str] = (),
    model: str = "spherical",
    metric: str = "haversine",
) -> DataFrame:
    """``by, target_id, near_id, rank, distance, weight`` for the (by, target) cells that occur.

    A row carries one target with its k neighbours and one fitted model; the systems
    are solved inside the tasks and the weights reused for every time step.
    """
    place = stations.select(F.col("station_id").alias("near_id"), "latitude", "longitude")
    member = F.struct("rank", "near_id", "distance", "latitude", "longitude")
    groups = neighbours.join(place, "near_id").groupBy("target_id").agg(
        F.sort_array(F.collect_list(member)).alias("_near")
    )
    goal = stations.select(
        F.col("station_id").alias("target_id"), F.col("latitude").alias("_tx"), F.col("longitude").alias("_ty")
    )
    rows = cells.select(*by, "target_id").join(groups, "target_id").join(goal, "target_id")
    if by:
        rows = rows.join(params, [*by])
    else:
        rows = rows.withColumns({c: params.select(c).scalar() for c in ("nugget", "psill", "range")})
    rows = rows.select(
        *by, "target_id", "_near", F.col("_near.latitude").alias("_x"), F.col("_near.longitude").alias("_y"),
        "_tx", "_ty", "nugget", "psill", "range",
    )

    @F.pandas_udf("array<double>")
    def solve(
        xs: pd.Series, ys: pd.Series, tx: pd.Series, ty: pd.Series, n: pd.Series, p: pd.Series, r: pd.Series
    ) -> pd.Series:
        sizes = xs.str.len().to_numpy()
        out = np.empty(len(xs), dtype=object)
        for k in np.unique(sizes):  # equally large systems are solved together
            at = np.flatnonzero(sizes == k)
            near = np.stack([np.stack(xs.to_numpy()[at]), np.stack(ys.to_numpy()[at])], axis=-1).astype(float)
            target = np.column_stack([tx.to_numpy()[at], ty.to_numpy()[at]])
            params = np.column_stack([c.to_numpy()[at] for c in (n, p, r)])
            for i, w in zip(at, solve_weights(near, target, params, model, metric), strict=True):
                out[i] = w
        return pd.Series(out)

    solved = rows.withColumn("_w", solve("_x", "_y", "_tx", "_ty", "nugget", "psill", "range"))
    pair = F.explode(F.arrays_zip("_near", "_w")).alias("_p")
    return solved.select(*by, "target_id", pair).select(
        *by, "target_id", F.col("_p._near.near_id").alias("near_id"), F.col("_p._near.rank").alias("rank"),
        F.col("_p._near.distance").alias("distance"), F.col("_p._w").alias("weight"),
    )


# -- prediction ----------------------------------------------------------------


def neighbour_values(
    series: DataFrame, weights: DataFrame, cols: Sequence[str], time: str = "timestamp", by: Sequence[str] = ()
) -> DataFrame:
    """Values of each target's neighbours at each time, next to their weights."""
    near = series.select(*by, time, F.col("station_id").alias("near_id"), *cols)
    return near.join(weights, [*by, "near_id"])


def idw_prediction(value: Column, distance: Column, power: float = 2.0) -> Column:
    """Inverse-distance mean over the grouped neighbours that have a value; those at distance 0 take all weight."""
    weight = F.when(value.isNotNull(), F.try_divide(F.lit(1.0), F.pow(distance, F.lit(power))))
    on_the_spot = F.avg(F.when(distance == 0, value))
    return F.coalesce(on_the_spot, F.sum(weight * value) / F.sum(weight))


def kriged(value: Column, weight: Column, k: int) -> Column:
    """Weighted sum over the grouped neighbours; null unless all ``k`` are present."""
    return F.when(F.count(value) == k, F.sum(weight * value))


class _Neighbourhoods:
    """Some targets of a tile with their own values and those of their neighbours, as flat arrays over the values of a chunk.

    ``key`` numbers a target and a time. ``own`` and ``near`` are places in ``time`` and ``columns``, pairs of values and mask.
    """

    def __init__(self, time: np.ndarray, slot: np.ndarray, n_slots: int, columns: list, spans: np.ndarray, targets: list, edges: list) -> None:
        self.time, self.columns, self.targets, self.n_keys = time, columns, targets, len(targets) * n_slots
        rows = np.asarray(targets, np.int64)
        self.own, owner = _places(spans, rows)
        self.own_key, self.own_row = owner * n_slots + slot[self.own], rows[owner]
        self.near, edge = _places(spans, np.fromiter((e[1] for e in edges), np.int64, len(edges)))
        of_edge = lambda i, kind: np.fromiter((e[i] for e in edges), kind, len(edges))[edge]
        self.key = of_edge(0, np.int64) * n_slots + slot[self.near]
        self.rank, self.distance, self.weight = of_edge(2, np.int64), of_edge(3, np.float64), of_edge(4, np.float64)

    def sum(self, values: np.ndarray | None = None, where: np.ndarray | None = None) -> np.ndarray:
        """Sum (or number) of the neighbours' values of each key."""
        pick = slice(None) if where is None else where
        return np.bincount(self.key[pick], None if values is None else values[pick], self.n_keys)


def _places(spans: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all values of the rows, number of the row in ``rows``); row i has the places ``spans[i]`` to ``spans[i + 1]``."""
    sizes = spans[rows + 1] - spans[rows]
    which = np.repeat(np.arange(len(rows)), sizes)
    return np.arange(sizes.sum()) - (np.cumsum(sizes) - sizes)[which] + spans[rows][which], which


def _over_neighbourhoods(
    series: DataFrame, weights: DataFrame, cols: Sequence[str], time: str, by: Sequence[str], places: DataFrame | None,
    solve: Callable, names: Sequence[str], per_time: DataFrame | None = None,
) -> DataFrame:
    """``by, time, station_id`` and ``names`` (doubles) from ``solve`` over the targets' own and their neighbours' values.

    Targets are dealt into tiles, by place if ``places`` has coordinates. A station's values of a month are one row, sent once to
    each tile that has it as a target or a neighbour, whatever the number of targets there; a target's row carries its weights. A
    tile with a month is one piece of work, of some hundred stations. ``per_time`` (``by``, time and numbers) goes to all; with it
    each station is a target, those without weights too.
    ``solve(neighbourhoods, numbers of the own times)`` gives places among the own values, then values and mask of each name.
    """
    keys = [*by, "_tile", "_chunk"]
    if places is None:
        n_tiles = spread(series)
        edges = weights.withColumnRenamed("target_id", "station_id").withColumn("_tile", F.pmod(F.xxhash64("station_id"), F.lit(n_tiles)))
    else:
        tiles = _tiled(StationPairs(places, 0.0)).groupBy("station_id").agg(F.min("tile").alias("_tile"))
        n_tiles = max(1, -(-places.count() // WIDE_TILE))
        edges = weights.withColumnRenamed("target_id", "station_id").join(tiles, "station_id", "left")
        edges = edges.withColumn("_tile", F.coalesce("_tile", F.lit(0).cast("long")))
    tasks = max(spread(series), n_tiles // 2)
    edge = F.struct("near_id", F.col("rank").cast("long").alias("rank"), F.col("distance").cast("double").alias("distance"), F.col("weight").cast("double").alias("weight"))
    to_near = edges.select(*by, F.col("near_id").alias("station_id"), "_tile", F.lit(None).alias("_edge"))
    wanted = edges.select(*by, "station_id", "_tile", edge.alias("_edge")).unionByName(to_near)
    own = (F.count("_edge") > 0).alias("_goal")
    goes = wanted.repartition(*by, "station_id").groupBy(*by, "station_id", "_tile").agg(own, F.collect_list("_edge").alias("_edges"))
    micros = F.unix_micros(F.col(time))
    columns = {f"_c{i}": F.col(c).cast("double") for i, c in enumerate(cols)}
    timed = series.filter(F.col(time).isNotNull())
    entry = F.struct(micros.alias("t"), *[c.alias(n) for n, c in columns.items()])
    packed = timed.groupBy(*by, "station_id", F.date_trunc("month", time).alias("_chunk")).agg(F.collect_list(entry).alias("_values"))
    n_stats = 0
    if per_time is None:
        rows = goes.join(packed, [*by, "station_id"]).select(*keys, "station_id", "_goal", "_edges", "_values")
    else:
        somewhere = F.pmod(F.xxhash64("station_id"), F.lit(n_tiles)).alias("_tile")
        alone = F.array(F.struct(somewhere, F.lit(True).alias("_goal"), F.array().cast(goes.schema["_edges"].dataType).alias("_edges")))
        tiles_of = goes.groupBy(*by, "station_id").agg(F.collect_list(F.struct("_tile", "_goal", "_edges")).alias("_goes"))
        found = packed.join(tiles_of, [*by, "station_id"], "left")
        goal = F.when(F.exists("_goes", lambda g: g["_goal"]), F.col("_goes")).otherwise(F.concat(F.coalesce("_goes", F.slice(alone, 1, 0)), alone))
        rows = found.select(*by, "_chunk", "station_id", "_values", F.inline(goal)).select(*keys, "station_id", "_goal", "_edges", "_values")
        stats = [c for c in per_time.columns if c not in {*by, time}]
        n_stats = len(stats)
        point = F.struct(micros.alias("t"), *[F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(stats)])
        points = per_time.filter(F.col(time).isNotNull()).groupBy(*by, F.date_trunc("month", time).alias("_chunk")).agg(F.collect_list(point).alias("_stats"))
        everywhere = F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))
        points = points.select(*by, F.explode(everywhere).alias("_tile"), "_chunk", "_stats")
        rows = points.unionByName(rows, allowMissingColumns=True)
    rows = rows.repartition(tasks, *keys).sortWithinPartitions(*keys)
    kinds = {c: to_arrow_type(rows.schema[c].dataType) for c in by}
    kind = rows.schema["station_id"].dataType
    width = len(cols)

    def worked(name: tuple, stations: list, stats: pa.Array | None) -> Iterator[pa.RecordBatch]:
        row_of = {s: i for i, (s, *_) in enumerate(stations)}
        values = [v for *_, v in stations]
        sizes = np.array([len(v) for v in values])
        spans = np.concatenate([[0], np.cumsum(sizes)])
        times = np.concatenate([v.field("t").to_numpy() for v in values])
        columns = []
        for c in range(width):
            mine = [v.field(f"_c{c}") for v in values]
            columns.append((
                np.concatenate([m.to_numpy(zero_copy_only=False) for m in mine]), np.concatenate([m.is_valid().to_numpy(zero_copy_only=False) for m in mine])
            ))
        slots, slot = np.unique(times, return_inverse=True)
        numbers = None
        if n_stats:
            at = np.searchsorted(slots, stats.field("t").to_numpy()) if stats is not None else np.zeros(0, int)
            held = (at < len(slots)) & (slots[np.minimum(at, len(slots) - 1)] == stats.field("t").to_numpy()) if len(at) else np.zeros(0, bool)
            numbers = np.full((n_stats, len(slots)), np.nan)
            for i in range(n_stats if len(at) else 0):
                numbers[i, at[held]] = stats.field(f"_s{i}").to_numpy(zero_copy_only=False)[held]
        names_ = pa.array([s for s, *_ in stations], to_arrow_type(kind))
        targets, edges, size = [], [], 0
        todo = [(i, e) for i, (_, goal, e, _) in enumerate(stations) if goal]
        for n, (i, own) in enumerate(todo):
            for e in own:
                if (j := row_of.get(e["near_id"])) is not None:
                    edges.append((len(targets), j, e["rank"], e["distance"], e["weight"]))
                    size += sizes[j]
            targets.append(i)
            if size < MOST_EDGES and n < len(todo) - 1:
                continue
            part = _Neighbourhoods(times, slot, len(slots), columns, spans, targets, edges)
            with np.errstate(divide="ignore", invalid="ignore"):
                picked, *found = solve(part, None if numbers is None else numbers[:, part.own_key % len(slots)])
            fixed = [pa.array([v], kinds[c]).take(pa.array(np.zeros(len(picked), np.int8))) for c, v in zip(by, name, strict=False)]
            when, ids = pa.array(times[part.own[picked]]), names_.take(pa.array(part.own_row[picked]))
            out = [pa.array(v, pa.float64(), mask=None if m is None else ~m) for v, m in found]
            yield pa.RecordBatch.from_arrays([*fixed, when, ids, *out], names=[*by, "_t", "station_id", *names])
            targets, edges, size = [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stations, stats = None, [], None
        for batch in batches:
            for r in range(len(batch)):
                here = tuple(batch.column(c)[r].as_py() for c in keys)
                if here != name:
                    if stations:
                        yield from worked(name, stations, stats)
                    name, stations, stats = here, [], None
                if n_stats and batch.column("_stats")[r].is_valid:
                    stats = batch.column("_stats")[r].values
                else:
                    station = batch.column("station_id")[r].as_py()
                    stations.append((station, *(batch.column(c)[r].as_py() for c in ("_goal", "_edges")), batch.column("_values")[r].values))
        if stations:
            yield from worked(name, stations, stats)

    fields = [T.StructField(c, rows.schema[c].dataType) for c in by]
    schema = T.StructType([*fields, T.StructField("_t", T.LongType()), T.StructField("station_id", kind), *[T.StructField(n, T.DoubleType()) for n in names]])
    out = rows.mapInArrow(run, schema)
    return out.select(*by, F.timestamp_micros("_t").cast(series.schema[time].dataType).alias(time), "station_id", *names)


def leave_one_out(
    series: DataFrame,
    weights: DataFrame,
    value: str,
    k: int,
    covariate: str | None = None,
    power: float = 2.0,
    time: str = "timestamp",
    by: Sequence[str] = (),
    places: DataFrame | None = None,
) -> DataFrame:
    """IDW, ordinary and regression kriging of every station from its neighbours.

    The linear trend, the kriged residual and the other two estimates are sums over
    the same k neighbour values, taken where a tile of stations (near each other if ``places`` is given) has them all. A
    (station, time) that is not observed or misses a neighbour is skipped; without covariates ``rk_pred`` falls back
    to the ordinary kriging value.
    """
    cols = [value, *([covariate] if covariate else [])]

    def solve(part: _Neighbourhoods, _: None) -> list:
        z, here = part.columns[0]
        zs, some, w, d = z[part.near], here[part.near], part.weight, part.distance
        n = part.sum(where=some)
        near = 1.0 / d**power
        spot = part.sum(where=some & (d == 0))
        idw = np.where(spot > 0, part.sum(zs, some & (d == 0)) / spot, part.sum(near * zs, some & (d != 0)) / part.sum(near, some & (d != 0)))
        ordinary = part.sum(w * zs, some)
        own = np.flatnonzero(here[part.own])
        own = own[n[part.own_key[own]] == k]
        key = part.own_key[own]
        rk = ordinary[key]
        if covariate:
            x, known = part.columns[1]
            xs, full = x[part.near], known[part.near]
            mean_z, mean_x = part.sum(zs, some) / n, part.sum(xs, full) / part.sum(where=full)
            dx, dz = xs - mean_x[part.key], zs - mean_z[part.key]
            var, size = part.sum(dx * dx, full) / part.sum(where=full), part.sum(np.abs(xs), full) / part.sum(where=full)
            # covariates that differ by rounding alone carry no trend
            slope = np.where(np.sqrt(var) > 1e-9 * (size + 1e-9), part.sum(dx * dz, full & some) / part.sum(dx * dx, full & some), 0.0)
            usable = (part.sum(where=full)[key] == k) & known[part.own[own]]
            base = mean_z - slope * mean_x
            residual = ordinary - base * part.sum(w) - slope * part.sum(w * xs, full)
            rk = np.where(usable, base[key] + slope[key] * x[part.own[own]] + residual[key], rk)
        return [own, *[(v, None) for v in (z[part.own[own]], idw[key], ordinary[key], rk)]]

    names = ["observed", "idw_pred", "ok_pred", "rk_pred"]
    out = _over_neighbourhoods(series, weights, cols, time, by, places, solve, names)
    return out.withColumn("observed", F.col("observed").cast(series.schema[value].dataType))


def leave_one_out_components(
    series: DataFrame,
    weights: DataFrame,
    value: str,
    u: str,
    v: str,
    k: int,
    covariate: str | None = None,
    time: str = "timestamp",
    by: Sequence[str] = (),
    places: DataFrame | None = None,
) -> DataFrame:
    """Leave-one-out of the speed and, with the same weights, of both wind components.

    Adds ``u_*`` and ``v_*`` where both components can be predicted, and per method the
    speed of the predicted components as ``uv_*``.
    """
    keys = [*by, time, "station_id"]
    methods = ["idw_pred", "ok_pred", "rk_pred"]
    parts = [
        leave_one_out(series, weights, c, k, covariate, time=time, by=by, places=places).withColumnsRenamed(
            {m: f"{name}_{m}" for m in ["observed", *methods]}
        )
        for name, c in (("u", u), ("v", v))
    ]
    speed = leave_one_out(series, weights, value, k, covariate, time=time, by=by, places=places)
    out = speed.join(parts[0].join(parts[1], keys), keys, "left")
    return out.withColumns({f"uv_{m}": F.hypot(f"u_{m}", f"v_{m}") for m in methods})


def regression_kriging(
    series: DataFrame,
    weights: DataFrame,
    value: str,
    covariates: Sequence[str],
    k: int,
    time: str = "timestamp",
    by: Sequence[str] = (),
    places: DataFrame | None = None,
) -> DataFrame:
    """Regression kriging on several covariates: per (station, time) an OLS fit on k rows.

    Small systems are solved together where a tile of stations (near each other if ``places`` is given) has the values of all
    neighbours; nothing larger than the tile's month is ever gathered. The fit is centred per
    neighbourhood, so of the fits that are equally good the flattest one counts. Where a
    covariate is missing at a neighbour or at the target, the ordinary kriging value stands.
    """
    def predict(zs: np.ndarray, ws: np.ndarray, near: np.ndarray, goal: np.ndarray) -> np.ndarray:
        ordinary = (ws * zs).sum(axis=1)
        whole = np.isfinite(near).all(axis=(1, 2)) & np.isfinite(goal).all(axis=1)
        middle, level = np.nan_to_num(near).mean(axis=1), zs.mean(axis=1)
        spread = np.nan_to_num(near) - middle[:, None, :]
        # covariates that differ by rounding alone carry no trend
        spread[np.broadcast_to((np.abs(spread).max(axis=1) <= 1e-9 * (np.abs(middle) + 1e-9))[:, None, :], spread.shape)] = 0.0
        beta = np.einsum("bij,bj->bi", np.linalg.pinv(spread), zs - level[:, None])
        residual = zs - level[:, None] - np.einsum("bkf,bf->bk", spread, beta)
        trend = level + (beta * (np.nan_to_num(goal) - middle)).sum(axis=1)
        return np.where(whole, trend + (ws * residual).sum(axis=1), ordinary)

    def solve(part: _Neighbourhoods, _: None) -> list:
        z, here = part.columns[0]
        some = np.flatnonzero(here[part.near])
        some = some[np.lexsort((part.rank[some], part.key[some]))]
        n = np.bincount(part.key[some], minlength=part.n_keys)
        first = np.cumsum(n) - n
        own = np.flatnonzero(here[part.own])
        own = own[n[part.own_key[own]] == k]
        found = np.empty(len(own))
        for at in range(0, len(own), SYSTEMS):
            some_own = own[at : at + SYSTEMS]
            rows = some[first[part.own_key[some_own]][:, None] + np.arange(k)]
            near = np.stack([x[part.near[rows]] for x, _ in part.columns[1:]], axis=-1)
            goal = np.stack([x[part.own[some_own]] for x, _ in part.columns[1:]], axis=-1)
            found[at : at + SYSTEMS] = predict(z[part.near[rows]], part.weight[rows], near, goal)
        return [own, (z[part.own[own]], None), (found, None)]

    out = _over_neighbourhoods(series, weights, [value, *covariates], time, by, places, solve, ["observed", "rk_pred"])
    return out.withColumn("observed", F.col("observed").cast(series.schema[value].dataType))


def global_trend_kriging(
    series: DataFrame,
    weights: DataFrame,
    value: str,
    covariate: str,
    time: str = "timestamp",
    by: Sequence[str] = (),
    places: DataFrame | None = None,
) -> DataFrame:
    """Trend fitted on all other stations of a time step, residuals kriged over present neighbours.

    Leaving a station out of the fit is a subtraction from the sums of its time step,
    so no station meets all others. Weights are renormalised over present neighbours.
    """
    x, z = F.col(covariate), F.col(value)
    full = x.isNotNull() & z.isNotNull()
    # Moments are those of deviations from the time step's means: raw squares would cancel.
    n = F.count(F.when(full, F.lit(1)))
    both = [F.when(full, c.cast("double")) for c in (x, z)]
    per_time = series.groupBy(*by, time).agg(
        n.alias("n"), F.avg(both[0]).alias("mx"), F.avg(both[1]).alias("mz"),
        (F.var_pop(both[0]) * n).alias("xx"), (F.covar_pop(*both) * n).alias("xz"),
    )

    def solve(part: _Neighbourhoods, numbers: np.ndarray) -> list:
        (z, here), (x, known) = part.columns
        n, mx, mz, sxx, sxz = numbers
        own = part.own
        z0, x0, whole = z[own], x[own], here[own] & known[own]
        dx, dz = np.where(whole, x0 - mx, 0.0), np.where(whole, z0 - mz, 0.0)
        everyone, n = sxx, n - whole
        sx, sz, sxx, sxz = -dx, -dz, sxx - dx * dx, sxz - dx * dz
        spread = sxx - sx * sx / n
        # what the subtraction leaves over by rounding, or values that differ by it alone, is no spread
        varies = (n > 1) & (spread > 1e-12 * everyone) & (np.sqrt(np.abs(spread) / n) > 1e-9 * (np.abs(mx) + 1e-9))
        b = np.where(varies, (sxz - sx * sz / n) / spread, 0.0)
        a = mz + sz / n - b * (mx + sx / n)
        level, slope = np.full((2, part.n_keys), np.nan)
        level[part.own_key], slope[part.own_key] = a, b
        residual = z[part.near] - level[part.key] - slope[part.key] * x[part.near]
        present = here[part.near] & known[part.near] & (n > 0)[_first_of(part.own_key, part.n_keys)[part.key]]
        total = part.sum(part.weight, present)
        r = np.where(total != 0, part.sum(part.weight * residual, present) / total, 0.0)[part.own_key]
        # without any neighbour the trend stands alone
        return [np.arange(len(own)), (z0, here[own]), (a + b * x0 + r, known[own] & (n > 0))]

    out = _over_neighbourhoods(series, weights, [value, covariate], time, by, places, solve, ["observed", "rk_pred"], per_time)
    return out.withColumn("observed", F.col("observed").cast(series.schema[value].dataType))


def _first_of(keys: np.ndarray, n: int) -> np.ndarray:
    """A place of each key, 0 for a key that there is none of."""
    out = np.zeros(n, np.int64)
    out[keys] = np.arange(len(keys))
    return out


def interpolate_stations(
    series: DataFrame,
    stations: DataFrame,
    value: str,
    k: int,
    max_km: float,
    n_lags: int = 20,
    model: str = "spherical",
    covariate: str | None = None,
    segment: str | None = None,
    detrended: bool = False,
    anisotropy: tuple[float, float] | None = None,
    distance: str = "haversine",
) -> DataFrame:
    """The whole leave-one-out run: pairs, semivariograms, fits, weights, predictions.

    ``distance`` (``haversine`` or ``geodesic``) chooses the neighbours, their IDW weights and
    the kriging systems. Anisotropic distances (angle, ratio) shape the variogram and the
    kriging weights only; neighbours and IDW keep the plain distance.
    """
    by = [segment] if segment else []
    z = detrend(series, value) if detrended else series
    if anisotropy:
        placed, metric = anisotropic_axes(stations, *anisotropy), "planar"
        # the stretch only lengthens distances; 1 % covers the scale error of the projection
        pairs = station_pairs(stations, max_km, placed, max_km * 1.01)
    else:
        placed, metric = stations, distance
        pairs = station_pairs(stations, max_km)
    binned = bin_semivariance(pair_semivariance(z, pairs, value, by=by, stations=stations), max_km, n_lags, by)
    params = fit_variograms(binned, model, by)
    near = k_nearest(stations, stations, k, candidate_key="station_id", metric=distance, exclude_self=True)
    cells = series.select(*by, F.col("station_id").alias("target_id")).distinct()
    weights = kriging_weights(near, placed, cells, params, by, model, metric)
    return leave_one_out(series, weights, value, k, covariate, by=by, places=stations)


def _planar_pairs(placed: DataFrame, pairs: DataFrame, max_km: float) -> DataFrame:
    ends = [
        placed.select(F.col("station_id").alias(s), F.col("latitude").alias(f"_x{s}"), F.col("longitude").alias(f"_y{s}"))
        for s in ("i", "j")
    ]
    dx, dy = F.col("_xi") - F.col("_xj"), F.col("_yi") - F.col("_yj")
    return (
        pairs.select("i", "j").join(ends[0], "i").join(ends[1], "j")
        .select("i", "j", F.sqrt(dx * dx + dy * dy).alias("distance"))
        .filter(F.col("distance") <= max_km)
    )
