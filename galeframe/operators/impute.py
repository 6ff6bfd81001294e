"""Filling gaps from other sources, other stations and similar rows."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from galeframe.functions.physics import cyclical
from galeframe.operators.ordering import day_chunk, fill, first_rows, spread
from galeframe.operators.reshape import resample_mean
from galeframe.operators.scale import fit_scaler, inverse_transform, transform

# Most entries of a block of rows (2 MB), fewest rows of one, and nearest rows looked at exactly at first.
CELLS, LEAST, FIRST = 1 << 18, 64, 256
#: Columns of a row up to which distances of all pairs are taken at once.
NARROW = 16
#: Most times of a station matrix whose table of distances fits a task.
TIMES = 2048


def fill_from(df: DataFrame, source: DataFrame, on: Sequence[str], pairs: dict[str, str]) -> DataFrame:
    """Null ``column`` takes ``source[prediction]`` of the same key where there is one."""
    extra = source.select(*on, *[F.col(p).alias(f"_from_{c}") for c, p in pairs.items()])
    out = df.join(extra, [*on], "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_from_{c}")) for c in pairs}
    return out.withColumns(filled).select(*df.columns)


def fill_from_wide(
    df: DataFrame, wide: DataFrame, ts: str, columns: dict[str, str] | str, column: str, step_seconds: int
) -> DataFrame:
    """Fill from a table with one column per station, brought to the target frequency first.

    ``columns`` maps the wide table's column names to station ids, or names a column that holds a map from station ids to
    values: a plan has room for some hundred columns, a row for any number of stations.
    """
    if isinstance(columns, str):
        long = wide.select(ts, F.explode(columns).alias("station_id", "_value"))
    else:
        long = wide.unpivot([ts], [*columns], "_name", "_value")
        names = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
        long = long.select(names[F.col("_name")].alias("station_id"), ts, "_value")
    regular = resample_mean(long, ["station_id"], ts, step_seconds, ["_value"])
    return fill_from(df, regular, ["station_id", ts], {column: "_value"})


def fill_covariate(df: DataFrame, col: str, ts: str = "timestamp", chunk=day_chunk) -> DataFrame:
    """Forward and backward fill per station, then the mean of the other stations."""
    out = fill(df, ["station_id"], [ts], [col], chunk(F.col(ts)))
    mean = out.groupBy(ts).agg(F.avg(col).alias("_mean"))
    return out.join(mean, ts).withColumn(col, F.coalesce(F.col(col), F.col("_mean"))).select(*df.columns)


def drop_sparse_times(df: DataFrame, col: str, share: float, ts: str = "timestamp") -> DataFrame:
    """Rows of the times at which at most ``share`` of the stations lack ``col``."""
    missing = F.avg(F.col(col).isNull().cast("double"))
    good = df.groupBy(ts).agg(missing.alias("_missing")).filter(F.col("_missing") <= share)
    return df.join(good.select(ts), ts, "left_semi")


# -- nearest rows --------------------------------------------------------------


def _best(tables: Sequence[np.ndarray], k: int) -> list[np.ndarray]:
    """The k smallest along the last axis of (distance, donor, value), by distance and then donor."""
    for by in (1, 0):
        at = np.argsort(tables[by], axis=-1, kind="stable")
        tables = [np.take_along_axis(x, at, axis=-1) for x in tables]
    return [x[..., :k] for x in tables]


class NearestOfNarrowRows:
    """``NearestRows`` for few columns: all exact distances of two blocks, then one sort a column."""

    def __init__(self, goal: np.ndarray, k: int) -> None:
        self.goal, self.k = goal, k
        self.open = np.isnan(goal)
        self.gaps = [np.flatnonzero(row) for row in self.open]
        shape = (*goal.shape, k)
        self.tables = [np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, np.nan)]

    def meet(self, keys: np.ndarray, have: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, have = keys[order], have[order]
        known = ~np.isnan(have)
        rows = max(1, 4 * CELLS // max(1, have.size))
        for start in range(0, len(self.goal), rows):
            part = slice(start, start + rows)
            away = self.goal[part, None, :] - have[None, :, :]
            both = ~np.isnan(away)
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = np.round(np.sqrt((np.where(both, away, 0.0) ** 2).sum(axis=2) * away.shape[2] / both.sum(axis=2)), 9)
            distance[np.isnan(distance)] = np.inf
            for c in np.flatnonzero(self.open[part].any(axis=0)):
                want, give = np.flatnonzero(self.open[part, c]), np.flatnonzero(known[:, c])
                near = distance[np.ix_(want, give)]
                best = np.argsort(near, axis=1, kind="stable")[:, : self.k]  # donors are in the order of their keys
                new = [np.take_along_axis(near, best, axis=1), keys[give][best], have[give, c][best]]
                at = want + start, c
                for table, x in zip(self.tables, _best([np.concatenate([t[at], n], axis=1) for t, n in zip(self.tables, new, strict=True)], self.k), strict=True):
                    table[at] = x

    def means(self, i: int) -> np.ndarray:
        distance, _, value = (table[i, self.gaps[i]] for table in self.tables)
        found = np.isfinite(distance)
        with np.errstate(invalid="ignore"):
            return np.where(found, value, 0.0).sum(axis=1) / found.sum(axis=1)


class NearestRows:
    """The k rows nearest to each row of a block, for each of its gaps; donors come block by block."""

    def __init__(self, goal: np.ndarray, k: int) -> None:
        self.goal, self.k = goal, k
        self.gaps = [np.flatnonzero(row) for row in np.isnan(goal)]
        shape = [(len(g), k) for g in self.gaps]
        self.distance = [np.full(s, np.inf) for s in shape]
        self.donor = [np.full(s, np.iinfo(np.int64).max) for s in shape]
        self.value = [np.full(s, np.nan) for s in shape]

    def squares(self, have: np.ndarray) -> np.ndarray:
        """Mean squares over the coordinates that both rows have, up to rounding: products of centred values and masks."""
        with np.errstate(invalid="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            centre = np.nan_to_num(np.nanmean(np.vstack([self.goal, have]), axis=0))
        parts = []
        for x in (self.goal, have):
            known = ~np.isnan(x)
            parts.append((np.where(known, x - centre, 0.0), known.astype(float)))
        (a, m), (b, n) = parts
        total = (a * a) @ n.T - 2 * a @ b.T + m @ (b * b).T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.maximum(total, 0) * self.goal.shape[1] / (m @ n.T)

    def meet(self, keys: np.ndarray, have: np.ndarray) -> None:
        """Take the donors of a block into account; keys settle equal distances."""
        near, known = self.squares(have), ~np.isnan(have)
        slack = 1e-6 * (1 + np.nanmax(np.where(np.isfinite(near), near, 0.0), initial=0.0))
        for i, gaps in enumerate(self.gaps):
            if not len(gaps):
                continue
            worst = self.distance[i][:, -1].max()
            able = np.flatnonzero(near[i] <= worst**2 + slack)  # no common coordinate is not a number
            most = FIRST
            while len(able):
                part, limit = able, np.inf
                if most < len(able):
                    order = np.argpartition(near[i, able], most - 1)[:most]
                    part, limit = able[order], np.sqrt(max(0.0, near[i, able[order]].max() - slack))
                if self._take(i, gaps, part, keys, have, known, limit):
                    break
                most *= 4

    def _take(self, i: int, gaps: np.ndarray, part: np.ndarray, keys: np.ndarray, have: np.ndarray, known: np.ndarray, limit: float) -> bool:
        """Merge the best of the donors ``part``, unless one at or beyond ``limit`` could be among the best of all."""
        away = self.goal[i] - have[part]
        both = ~np.isnan(away)
        distance = np.round(np.sqrt((np.where(both, away, 0.0) ** 2).sum(axis=1) * away.shape[1] / both.sum(axis=1)), 9)
        order = np.lexsort((keys[part], distance))
        part, distance = part[order], distance[order]
        holds = known[part][:, gaps]
        rank = np.cumsum(holds, axis=0, dtype=np.int32)
        donors, columns = np.nonzero(holds & (rank <= self.k))
        place = rank[donors, columns] - 1
        shape = self.distance[i].shape
        new = [np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, np.nan)]
        values = distance[donors], keys[part][donors], have[part[donors], gaps[columns]]
        for table, v in zip(new, values, strict=True):
            table[columns, place] = v
        old = self.distance[i], self.donor[i], self.value[i]
        if np.isfinite(old[0]).any():
            new = _best([np.concatenate(pair, axis=1) for pair in zip(old, new, strict=True)], self.k)
        if np.isfinite(limit) and new[0][:, -1].max() >= limit:
            return False
        self.distance[i], self.donor[i], self.value[i] = new
        return True

    def means(self, i: int) -> np.ndarray:
        """The mean of the donors' values for each gap of a row, not a number where there is no donor."""
        found = np.isfinite(self.distance[i])
        with np.errstate(invalid="ignore"):
            return np.where(found, self.value[i], 0.0).sum(axis=1) / found.sum(axis=1)


def _block(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys and matrix of a list of (k, x)."""
    values = items.field("x").flatten().to_numpy(zero_copy_only=False)
    return items.field("k").to_numpy(), values.reshape(len(items), -1)


def nearest_rows_mean(
    df: DataFrame, by: Sequence[str], key: str, features: str, k: int, block_rows: int | None = None
) -> DataFrame:
    """``by, key, column, value`` for every missing entry of the ``features`` arrays (all of one size).

    The value is the mean over the k rows nearest in the coordinates both rows have (distances scaled up by the
    share of missing coordinates, equal ones in the order of the keys). Each series is dealt into blocks of about
    ``block_rows`` rows by a hash of the key: by default 64 blocks over all series, of 64 rows at least and ``CELLS``
    entries at most. A block of rows with gaps is one task, which meets the blocks of its series one after the other and
    keeps k donors a gap, so nothing but the number of blocks grows with the series. An entry no row can donate
    to gets the column mean. The key is a timestamp or a whole number and names a row of its series.
    """
    kind = df.schema[key].dataType.simpleString()
    number = F.unix_micros(key) if kind.startswith("timestamp") else F.col(key).cast("long")
    rows = df.select(*by, number.alias("k"), F.col(features).cast("array<double>").alias("x"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.max(F.size("x")).alias("_width"))
    if block_rows:
        size = F.lit(block_rows)
    else:
        series = sizes.count() if by else 1
        least, most = F.lit(LEAST if series == 1 else 16 * LEAST), F.greatest(F.lit(1), F.floor(CELLS / F.col("_width")))
        size = F.least(most, F.greatest(least, F.ceil(F.col("_n") * max(1, series) / 64)))
    sizes = sizes.select(*by, F.ceil(F.col("_n") / size).cast("int").alias("_blocks"))
    sized = rows.join(sizes, [*by]) if by else rows.withColumn("_blocks", sizes.scalar())
    dealt = sized.withColumn("_block", F.pmod(F.xxhash64("k"), F.col("_blocks")).cast("int"))
    blocks = dealt.groupBy(*by, "_blocks", "_block").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("_rows"))
    open_rows = F.filter("_rows", lambda r: F.exists(r["x"], lambda v: v.isNull()))
    goals = blocks.select(*by, F.col("_block").alias("_mine"), "_blocks", open_rows.alias("_open")).filter(F.size("_open") > 0)
    meet = goals.select(*by, "_mine", "_open", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    meet = meet.join(blocks.drop("_blocks"), [*by, "_block"])
    mine = [*by, "_mine"]
    in_turn = meet.repartition(*mine).sortWithinPartitions(*mine, "_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, nearest = None, None
        for batch in batches:
            for i in range(len(batch)):
                here = tuple(batch.column(c)[i].as_py() for c in mine)
                if here != name:
                    if nearest is not None:
                        yield found(name, keys, nearest)
                    name = here
                    keys, goal = _block(batch.column("_open")[i].values)
                    nearest = (NearestOfNarrowRows if goal.shape[1] <= NARROW else NearestRows)(goal, k)
                nearest.meet(*_block(batch.column("_rows")[i].values))
        if nearest is not None:
            yield found(name, keys, nearest)

    def found(name: tuple, keys: np.ndarray, nearest: NearestRows) -> pa.RecordBatch:
        fixed = [pa.array([v] * len(keys), meet_types[c]) for c, v in zip(by, name, strict=False)]
        columns = pa.array(nearest.gaps, pa.list_(pa.int32()))
        values = pa.array([nearest.means(i) for i in range(len(keys))], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*fixed, pa.array(keys), columns, values], names=[*by, "k", "columns", "values"])

    meet_types = {c: to_arrow_type(df.schema[c].dataType) for c in by}
    fields = [df.schema[c] for c in by]
    schema = T.StructType([*fields, *T.StructType.fromDDL("k long, columns array<int>, values array<double>").fields])
    filled = in_turn.mapInArrow(run, schema)
    zipped = F.arrays_zip(F.col("columns").alias("column"), F.col("values").alias("value"))
    gaps = filled.select(*by, "k", F.inline(zipped)).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    entries = rows.select(*by, F.posexplode("x").alias("column", "_v"))
    overall = entries.groupBy(*by, "column").agg(F.avg("_v").alias("_all"))
    back = F.timestamp_micros("k") if kind.startswith("timestamp") else F.col("k")
    out = gaps.join(overall, [*by, "column"], "left")
    return out.select(*by, back.cast(kind).alias(key), "column", F.coalesce("value", "_all").alias("value"))


def impute_rows(
    df: DataFrame, by: Sequence[str], ts: str, cols: Sequence[str], k: int = 5, block_rows: int | None = None
) -> DataFrame:
    """Fill gaps of each series from its k most similar rows in value, hour and month.

    All columns are standardised first. A series without gaps passes unchanged.
    """
    clock = dict(zip(("_hs", "_hc"), cyclical(F.hour(ts), 24))) | dict(zip(("_ms", "_mc"), cyclical(F.month(ts), 12)))
    rows = df.withColumns(clock)
    names = [*cols, *clock]
    stats = fit_scaler(rows, names, by)
    scaled = transform(rows, stats, names, by).withColumn("_x", F.array(*names))
    values = nearest_rows_mean(scaled, by, ts, "_x", k, block_rows)
    wide = values.groupBy(*by, ts).agg(
        *[F.max(F.when(F.col("column") == i, F.col("value"))).alias(c) for i, c in enumerate(cols)]
    )
    back = inverse_transform(wide, stats.select(*by, *[f"{c}_{s}" for c in cols for s in ("mean", "std")]), cols, by)
    return fill_from(df, back, [*by, ts], {c: c for c in cols})


class _Tile:
    """Values of some stations at all times, by station and part, with a mask of what is there and of what is a number."""

    def __init__(self, stations: pa.Array, times: pa.Array, parts: int) -> None:
        self.n, self.names = len(stations), stations.field("station_id")
        order = times.field("t")
        first = order.null_count  # a missing time comes first
        known = order.slice(first).to_numpy(zero_copy_only=False).astype(np.int64)
        entries = stations.field("e")
        flat, at = entries.flatten(), np.repeat(np.arange(self.n), entries.value_lengths().to_numpy())
        slot = np.searchsorted(known, flat.field("t").to_numpy()) + first
        self.values = np.zeros((parts, self.n, len(order)))
        self.there = np.zeros((self.n, len(order)), bool)
        self.there[at, slot] = True
        for p in range(parts):
            self.values[p, at, slot] = flat.field(f"v{p}").to_numpy(zero_copy_only=False)
        self.known = np.broadcast_to(self.there, self.values.shape) & ~np.isnan(self.values)

    def add_squares(self, total: np.ndarray, common: np.ndarray) -> None:
        """Add squared differences of each time to each later one, and how many entries both have."""
        for values, known in zip(self.values, self.known, strict=True):
            filled, mask = np.where(known, values, 0.0), known.astype(np.float32)
            common += (mask.T @ mask).astype(np.int64)
            for i in range(len(total) - 1):
                own = np.flatnonzero(known[:, i])
                away = (filled[own, i + 1 :] - filled[own, i, None]) * mask[own, i + 1 :]
                total[i, i + 1 :] += np.einsum("sj,sj->j", away, away)

    def fill(self, rank: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, mask) with each missing entry as the mean of its k donors, else that of its row of the tile.

        ``rank[a, b]`` is the place of time b among those nearest to a, the number of times where they have nothing in common.
        """
        filled, there = self.values.copy(), np.broadcast_to(self.there, self.values.shape).copy()
        for s in range(self.n):
            gaps = np.flatnonzero(~self.there[s])
            for p in range(len(self.values)):
                row, donors = self.values[p, s], np.flatnonzero(self.known[p, s])
                if not len(gaps) or not self.there[s].any():
                    continue
                best = rank[np.ix_(gaps, donors)]
                if k < len(donors):
                    best = np.partition(best, k - 1, axis=1)[:, :k]
                best.sort(axis=1)
                found = best < len(order)
                n = found.sum(axis=1)
                values = np.where(found, row[order[gaps[:, None], np.where(found, best, 0)]], 0.0).sum(axis=1)
                filled[p, s, gaps] = np.where(n > 0, values / np.maximum(n, 1), row[self.there[s]].mean())
                there[p, s, gaps] = True
        return filled, there


def _impute_wide(df: DataFrame, ts: str, parts: Sequence[Column], k: int, n_tiles: int) -> DataFrame:
    """``station_id, ts, v0`` (and ``v1``) of a matrix with few times and any number of stations, gaps filled.

    Stations are dealt into tiles by a hash. Squared differences of two times add up over the stations, so each task sums
    them over its tiles, a table of all pairs of times; the tables are added, and the places of all times among those nearest
    to each go to every task, which then fills its tiles on its own. So a shuffle carries each value twice, whatever the
    number of stations.
    """
    kind = df.schema[ts].dataType.simpleString()
    names = [f"v{i}" for i in range(len(parts))]
    number = F.unix_micros(ts) if kind.startswith("timestamp") else F.col(ts).cast("long")
    rows = df.select("station_id", number.alias("t"), *[v.cast("double").alias(n) for n, v in zip(names, parts, strict=True)])
    # what has no name or no time is nobody's value, and is in the result
    here = F.col("station_id").isNotNull() & F.col("t").isNotNull() & F.col("v0").isNotNull()
    times = rows.agg(F.sort_array(F.collect_set(F.struct("t"))).alias("times")).scalar()
    of_station = rows.groupBy("station_id").agg(F.collect_list(F.when(here, F.struct("t", *names))).alias("e"))
    tasks = min(n_tiles, spread(df))
    tile = F.pmod(F.xxhash64("station_id"), F.lit(n_tiles)).cast("int")
    tiles = of_station.groupBy(tile.alias("tile")).agg(F.sort_array(F.collect_list(F.struct("station_id", "e"))).alias("stations"))
    tiles = tiles.withColumn("part", F.col("tile") % tasks)
    dealt = tiles.repartitionById(tasks, F.col("part")).sortWithinPartitions("tile").withColumn("times", times)
    width = len(parts)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, columns, part = None, 0, 0
        for batch in batches:
            for r in range(len(batch)):
                tile = _Tile(batch.column("stations")[r].values, batch.column("times")[r].values, width)
                if total is None:
                    n = tile.there.shape[1]
                    total, common = np.zeros((n, n)), np.zeros((n, n), np.int64)
                tile.add_squares(total, common)
                columns, part = columns + tile.n * width, batch.column("part")[r].as_py()
        if total is None:
            return
        total += total.T
        for i in range(n):
            numbers = [pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([columns], pa.int64())]
            lists = [pa.array([total[i]], pa.list_(pa.float64())), pa.array([common[i]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*numbers, *lists], names=["a", "part", "columns", "total", "common"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None

        def closed() -> Iterator[pa.RecordBatch]:
            total, common, columns = sums
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = np.round(np.sqrt(total * columns / common), 9)
            distance[common == 0] = np.inf
            place = np.empty(len(total), np.int32)
            place[np.argsort(distance, kind="stable")] = np.arange(len(total))
            place[common == 0] = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([place], pa.list_(pa.int32()))], names=["a", "place"])

        for batch in batches:
            for r in range(len(batch)):
                total, common = (batch.column(c)[r].values.to_numpy() for c in ("total", "common"))
                if batch.column("a")[r].as_py() != at:
                    if at is not None:
                        yield from closed()
                    at, sums = batch.column("a")[r].as_py(), [0.0, 0, 0]
                sums = [sums[0] + total, sums[1] + common, sums[2] + batch.column("columns")[r].as_py()]
        if at is not None:
            yield from closed()

    tables = dealt.mapInArrow(squares, "a int, part int, columns long, total array<double>, common array<long>")
    near = tables.repartition(spread(df), "a").sortWithinPartitions("a", "part").mapInArrow(places, "a int, place array<int>")
    copies = near.select("a", "place", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part"))
    copies = copies.select("part", F.lit(-1).alias("tile"), "a", "place", F.lit(None).cast(tiles.schema["stations"].dataType).alias("stations"))
    whole = copies.unionByName(tiles.select("part", "tile", F.lit(None).cast("int").alias("a"), F.lit(None).cast("array<int>").alias("place"), "stations"))
    whole = whole.repartitionById(tasks, F.col("part")).sortWithinPartitions("tile", "a").withColumn("times", times)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, order = [], None
        for batch in batches:
            for r in range(len(batch)):
                if batch.column("tile")[r].as_py() < 0:
                    near.append(batch.column("place")[r].values.to_numpy())
                    continue
                if order is None:
                    near = np.stack(near)
                    order = np.argsort(near, axis=1, kind="stable").astype(np.int32)
                times = batch.column("times")[r].values
                tile = _Tile(batch.column("stations")[r].values, times, width)
                values, there = tile.fill(near, order, k)
                ids = tile.names.take(pa.array(np.repeat(np.arange(tile.n), len(order))))
                when = times.field("t").take(pa.array(np.tile(np.arange(len(order)), tile.n)))
                columns = [pa.array(v.ravel(), pa.float64(), mask=~m.ravel()) for v, m in zip(values, there, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, when, *columns], names=["station_id", "t", *names])

    types = ", ".join(f"{n} double" for n in names)
    out = whole.mapInArrow(filled, f"station_id {df.schema['station_id'].dataType.simpleString()}, t long, {types}")
    back = F.timestamp_micros("t") if kind.startswith("timestamp") else F.col("t")
    return out.select("station_id", back.cast(kind).alias(ts), *names)


def impute_matrix(
    df: DataFrame, ts: str, col: str, k: int = 10, circular: bool = False, block_rows: int | None = None
) -> DataFrame:
    """Fill a station matrix from the k times at which the stations looked most alike.

    A row is one time with one entry per station (two, sine and cosine, for a direction). Returns ``station_id, ts, col``.
    Many stations at up to ``TIMES`` times are dealt into tiles; with few of them, or in ``block_rows``, times are.
    """
    parts = {col: F.col(col)} if not circular else {
        "_s": F.sin(F.radians(col)), "_c": F.cos(F.radians(col))
    }
    if not block_rows:
        n_times, n_stations = df.agg(F.approx_count_distinct(ts), F.approx_count_distinct("station_id")).first()
        if n_times <= TIMES and n_stations > NARROW:
            n_tiles = max(1, n_times * n_stations * len(parts) // CELLS, min(spread(df), n_stations // LEAST))
            wide = _impute_wide(df, ts, [*parts.values()], k, n_tiles)
            if not circular:
                return wide.withColumnRenamed("v0", col)
            return wide.select("station_id", ts, F.pmod(F.degrees(F.atan2("v0", "v1")), F.lit(360.0)).alias(col))
    stations = df.agg(F.sort_array(F.collect_set("station_id")).alias("s"))
    known = F.collect_list(F.struct("station_id", *[v.cast("double").alias(n) for n, v in parts.items()]))
    rows = df.groupBy(ts).agg(known.alias("_known")).withColumn("_ids", stations.scalar())
    # Stations without a row are appended without values; sorted, all entries stand in station order.
    empty = [F.lit(None).cast("double").alias(n) for n in parts]
    absent = F.transform(
        F.array_except("_ids", F.col("_known.station_id")), lambda s: F.struct(s.alias("station_id"), *empty)
    )
    rows = rows.withColumn("_all", F.sort_array(F.concat("_known", absent)))
    rows = rows.withColumn("_x", F.concat(*[F.col(f"_all.{n}") for n in parts])).drop("_known", "_all")
    values = nearest_rows_mean(rows, [], ts, "_x", k, block_rows)
    # names come by number from a thin table: an entry that carried the whole list of them would be as long as its row
    names = stations.select(F.posexplode("s").alias("_at", "station_id"))
    size = stations.select(F.size("s")).scalar()
    cells = rows.select(ts, F.posexplode("_x").alias("column", "_v")).join(values, [ts, "column"], "left")
    cells = cells.select(
        ts, (F.col("column") % size).alias("_at"), F.floor(F.col("column") / size).alias("_part"), F.coalesce("_v", "value").alias("_v")
    ).join(names, "_at")
    if not circular:
        return cells.select("station_id", ts, F.col("_v").alias(col))
    pick = [F.max(F.when(F.col("_part") == i, F.col("_v"))) for i in (0, 1)]
    angle = F.pmod(F.degrees(F.atan2(*pick)), F.lit(360.0))
    return cells.groupBy("station_id", ts).agg(angle.alias(col))
