"""Station graphs: edges, edge features, weights and diffusion of a signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions.geo import bearing_degrees
from galeframe.functions.physics import at_least, clip
from galeframe.operators.neighbours import k_nearest, within
from galeframe.operators.ordering import positions


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Undirected (a, b) pairs as two directed edges each."""
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                   F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.withColumn("_e", F.explode(ends)).select("_e.src", "_e.dst", "distance")


def _undirected(near: DataFrame) -> DataFrame:
    low, high = F.least("target_id", "near_id"), F.greatest("target_id", "near_id")
    return near.groupBy(low.alias("a"), high.alias("b")).agg(F.min("distance").alias("distance"))


def nearest_edges(stations: DataFrame, k: int) -> DataFrame:
    """``src, dst, distance``: union of everyone's k nearest, in both directions."""
    near = k_nearest(stations, stations, k, candidate_key="station_id", exclude_self=True)
    return _both_ways(_undirected(near))


def radius_edges(stations: DataFrame, radius_km: float, cap: int | None = None) -> DataFrame:
    """Edges from every station within the radius; with ``cap`` only the nearest ones come in."""
    if cap:  # the nearest ones within the radius are the nearest of all, up to the radius
        near = k_nearest(stations, stations, cap, candidate_key="station_id", exclude_self=True).filter(F.col("distance") <= radius_km)
    else:
        near = within(stations, stations, radius_km).filter("target_id <> near_id")
    return near.select(F.col("near_id").alias("src"), F.col("target_id").alias("dst"), "distance")


def grid_edges(stations: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Edges from the k nearest grid nodes to every station."""
    near = k_nearest(stations, nodes, k)
    return near.select(F.col("near_id").alias("src"), F.col("target_id").alias("dst"), "distance")


def edge_features(
    edges: DataFrame, src: DataFrame, dst: DataFrame, altitude: str | None = None, differences: Sequence[str] = (),
    max_km: float | None = None,
) -> DataFrame:
    """Normalised distance, bearing, clipped altitude difference and feature differences.

    ``src`` and ``dst`` have ``id, latitude, longitude`` and the named columns; without
    ``max_km`` distances are divided by the largest one.
    """
    extra = [*([altitude] if altitude else []), *differences]
    ends = []
    for name, dim in (("src", src), ("dst", dst)):
        cols = dict.fromkeys(["latitude", "longitude", *extra])
        ends.append(dim.select(F.col("id").alias(name), *[F.col(c).alias(f"_{name}_{c}") for c in cols]))
    rows = edges.join(ends[0], "src").join(ends[1], "dst")
    top = F.lit(max_km) if max_km else edges.agg((F.max("distance") + 1e-8).alias("m")).scalar()
    bearing = F.radians(bearing_degrees("_src_latitude", "_src_longitude", "_dst_latitude", "_dst_longitude"))
    picks = [
        (F.col("distance") / top).alias("dist_norm"), F.sin(bearing).alias("sin_brg"), F.cos(bearing).alias("cos_brg"),
    ]
    if altitude:
        rise = (F.col(f"_dst_{altitude}") - F.col(f"_src_{altitude}")) / 3000.0
        picks.append(clip(rise, -1.0, 1.0).alias("d_alt"))
    picks += [(F.col(f"_dst_{c}") - F.col(f"_src_{c}")).alias(f"d_{c}") for c in differences]
    return rows.select("src", "dst", *picks)


def constant_features(edges: DataFrame) -> DataFrame:
    """The single feature of a graph without any: 1."""
    return edges.select("src", "dst", F.lit(1.0).alias("constant"))


def induced_subgraph(edges: DataFrame, members: DataFrame, chunk: Column) -> DataFrame:
    """Edges among ``members`` (``station_id``), renumbered from 0 in id order.

    ``chunk`` is a coarser, order-preserving function of ``station_id``.
    """
    ids = positions(members.select("station_id").distinct(), [], ["station_id"], chunk, "_n")
    number = ids.select("station_id", (F.col("_n") - 1).alias("n"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(number.withColumnsRenamed({"station_id": end, "n": f"{end}_index"}), end)
    return out


def edge_roles(stations: DataFrame, k: int) -> DataFrame:
    """Undirected edges by the split that first brings them in (``role`` of the stations).

    Training edges come from training stations alone, so later splits leave them as they are.
    """
    pools = [("train", ["train"]), ("val", ["train", "val"]), ("test", ["train", "val", "test"])]
    known, out = None, None
    for name, roles in pools:
        pool = stations.filter(F.col("role").isin(roles))
        near = k_nearest(pool, pool, k, candidate_key="station_id", exclude_self=True)
        edges = _undirected(near).select("a", "b")
        new = edges if known is None else edges.join(known, ["a", "b"], "left_anti")
        labelled = new.withColumn("edge_role", F.lit(name))
        out = labelled if out is None else out.unionByName(labelled)
        known = edges
    return out


def gaussian_weight(dist_norm: Column | str, sigma: float = 0.2) -> Column:
    d = F.col(dist_norm) if isinstance(dist_norm, str) else dist_norm
    return F.exp(-(d * d) / (sigma * sigma))


def wind_weight(dist_norm: Column | str, flow_degrees: Column | str, sin_brg: Column | str, cos_brg: Column | str) -> Column:
    """``exp(-d) * max(cos(flow - bearing), 0)`` for air moving towards ``flow_degrees``."""
    d, flow, s, c = (F.col(x) if isinstance(x, str) else x for x in (dist_norm, flow_degrees, sin_brg, cos_brg))
    along = F.cos(F.radians(flow)) * c + F.sin(F.radians(flow)) * s
    return F.exp(-d) * at_least(along, 0.0)


def diffuse(signal: DataFrame, edges: DataFrame, value: str, hops: int, time: str = "timestamp") -> DataFrame:
    """``{value}_hop_0 .. hop_K``: the signal carried along weighted out-edges K times.

    ``edges`` has ``src, dst, weight``. Weights are divided by the summed weight leaving
    each source. Each hop is one join with the edge table and one aggregation.
    """
    leaving = edges.groupBy("src").agg(F.greatest(F.sum("weight"), F.lit(1e-8)).alias("_out"))
    steps = edges.join(leaving, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("_p"))
    current = signal.select("station_id", time, F.col(value).alias(f"{value}_hop_0"))
    out = current
    for hop in range(1, hops + 1):
        moved = current.select(F.col("station_id").alias("src"), time, F.col(f"{value}_hop_{hop - 1}").alias("_x"))
        current = (
            moved.join(steps, "src").groupBy(F.col("dst").alias("station_id"), time)
            .agg(F.sum(F.col("_p") * F.col("_x")).alias(f"{value}_hop_{hop}"))
        )
        out = out.join(current, ["station_id", time], "left").fillna(0.0, [f"{value}_hop_{hop}"])
    return out
