"""Scalar functions on forecast and station rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.functions import geo, physics, text
from galeframe.operators.ordering import first_rows
from galeframe.plans.registry import query

NWP_KEYS = "grid_id, starttime, forecasttime, height"
KEYS = ["grid_id", "starttime", "forecasttime", "height"]


@query(
    "h01_wind_speed",
    "SELECT grid_id, starttime, forecasttime, height, sqrt(u_wind * u_wind + v_wind * v_wind) AS speed FROM nwp",
    num="speed",
    ts="starttime",
)
def h01(t):
    return t.nwp.select(*KEYS, physics.wind_speed("u_wind", "v_wind").alias("speed"))


@query(
    "h02_wind_components",
    """SELECT event_id, -wind_speed * sin(radians(wind_direction)) AS u,
        -wind_speed * cos(radians(wind_direction)) AS v FROM raw""",
    num="u v",
)
def h02(t):
    u, v = physics.wind_components("wind_speed", "wind_direction")
    return t.raw.select("event_id", u.alias("u"), v.alias("v"))


@query(
    "h03_direction_encoding",
    f"""SELECT {NWP_KEYS}, -u / CASE WHEN s < 1e-6 THEN 1e-6 ELSE s END AS dir_sin, -v / CASE WHEN s < 1e-6 THEN 1e-6 ELSE s END AS dir_cos
    FROM (SELECT *, sqrt(u * u + v * v) AS s FROM (SELECT *, u_wind AS u, CASE WHEN qs IS NOT NULL THEN v_wind END AS v FROM nwp))""",
    num="dir_sin dir_cos",
    ts="starttime",
)
def h03(t):
    v = F.when(F.col("qs").isNotNull(), F.col("v_wind"))  # some components are missing
    sin, cos = physics.direction_encoding("u_wind", v)
    return t.nwp.select(*KEYS, sin.alias("dir_sin"), cos.alias("dir_cos"))


@query(
    "h04_angle_encoding",
    "SELECT event_id, sin(radians(wind_direction)) AS s, cos(radians(wind_direction)) AS c FROM raw",
    num="s c",
)
def h04(t):
    s, c = physics.angle_encoding("wind_direction")
    return t.raw.select("event_id", s.alias("s"), c.alias("c"))


@query(
    "h05_cyclical_time",
    """SELECT event_id, sin(2 * pi() * hour("timestamp") / 24) AS hour_sin, cos(2 * pi() * hour("timestamp") / 24) AS hour_cos,
        sin(2 * pi() * month("timestamp") / 12) AS month_sin, cos(2 * pi() * month("timestamp") / 12) AS month_cos FROM raw""",
    num="hour_sin hour_cos month_sin month_cos",
)
def h05(t):
    hs, hc = physics.cyclical(F.hour("timestamp"), 24)
    ms, mc = physics.cyclical(F.month("timestamp"), 12)
    return t.raw.select(
        "event_id", hs.alias("hour_sin"), hc.alias("hour_cos"), ms.alias("month_sin"), mc.alias("month_cos")
    )


HUANG_SQL = """CASE WHEN {t} > 0 THEN exp(34.494e0 - 4924.99e0 / ({t} + 237.1e0)) / pow({t} + 105e0, 1.57e0)
    ELSE exp(43.494e0 - 6545.8e0 / ({t} + 278e0)) / pow({t} + 868e0, 2) END"""
MAGNUS_SQL = """CASE WHEN {t} > 0 THEN 610.94e0 * exp(17.625e0 * {t} / ({t} + 243.04e0))
    ELSE 611.21e0 * exp(22.587e0 * {t} / ({t} + 273.86e0)) END"""


@query(
    "h06_saturation_vapour_pressure",
    f"""SELECT event_id, {HUANG_SQL.format(t='temperature')} AS huang, {MAGNUS_SQL.format(t='temperature')} AS magnus
    FROM raw WHERE temperature IS NOT NULL""",
    num="huang magnus",
)
def h06(t):
    return t.raw.filter("temperature IS NOT NULL").select(
        "event_id",
        physics.saturation_vapour_pressure("temperature", "huang").alias("huang"),
        physics.saturation_vapour_pressure("temperature", "improved_magnus").alias("magnus"),
    )


MOIST_SQL = f"""SELECT *, {MAGNUS_SQL.format(t='c')} AS es_magnus, {HUANG_SQL.format(t='c')} AS es_huang
    FROM (SELECT *, temperature - 273.15e0 AS c FROM nwp)"""
HUMID_SQL = f"""SELECT *, (qs / (1 - qs)) / (0.622e0 * es_magnus / (pressure - es_magnus)) AS rh FROM ({MOIST_SQL})"""


@query("h07_relative_humidity", f"SELECT {NWP_KEYS}, rh FROM ({HUMID_SQL})", num="rh", ts="starttime")
def h07(t):
    return t.nwp.select(*KEYS, physics.relative_humidity("qs", "pressure", "temperature").alias("rh"))


@query(
    "h08_air_density",
    f"""SELECT {NWP_KEYS}, (pressure - rh * es_huang) / (287.05e0 * temperature)
        + rh * es_huang / (461.5e0 * temperature) AS density FROM ({HUMID_SQL})""",
    num="density",
    ts="starttime",
)
def h08(t):
    rh = physics.relative_humidity("qs", "pressure", "temperature")
    es = physics.saturation_vapour_pressure(F.col("temperature") - 273.15, "huang")
    return t.nwp.select(*KEYS, physics.air_density("temperature", "pressure", rh, es).alias("density"))


@query(
    "h09_density_at_height",
    """SELECT event_id, 1.2e0 * pow(1 - 0.00649e0 * (100 - 2) / (temperature + 273.15e0),
        0.028949e0 * 9.81e0 / (0.00649e0 * 8.31451e0) - 1) AS density FROM raw""",
    num="density",
)
def h09(t):
    return t.raw.select(
        "event_id", physics.density_at_height(F.lit(1.2), "temperature", 100.0).alias("density")
    )


@query(
    "h10_cap_area",
    """SELECT location_id, CASE WHEN y <= -r THEN pi() * r * r WHEN y >= r THEN 0
        ELSE r * r * acos(y / r) - y * sqrt(r * r - y * y) END AS area
    FROM (SELECT location_id, slope AS r, aspect / 4 - 45 AS y FROM topo)""",
    num="area",
)
def h10(t):
    return t.topo.select("location_id", physics.cap_area("slope", F.col("aspect") / 4.0 - 45.0).alias("area"))


@query(
    "h11_hub_height_speed",
    """SELECT grid_id, starttime, forecasttime, CASE WHEN high IS NOT NULL THEN low * pow(100e0 / 10, least(greatest(
        ln(greatest(high, 0.01e0) / greatest(low, 0.01e0)) / ln(38e0 / 10), 0), 1)) END AS hub_speed
    FROM (SELECT a.grid_id, a.starttime, a.forecasttime, a.wind_speed AS low, b.wind_speed AS high
        FROM (SELECT * FROM nwp WHERE height = 10) a LEFT JOIN (SELECT * FROM nwp WHERE height = 38) b
            ON a.grid_id = b.grid_id AND a.starttime = b.starttime AND a.forecasttime = b.forecasttime)""",
    num="hub_speed",
    ts="starttime",
)
def h11(t):
    keys = KEYS[:3]
    low = t.nwp.filter("height = 10").select(*keys, F.col("wind_speed").alias("low"))
    high = t.nwp.filter("height = 38").select(*keys, F.col("wind_speed").alias("high"))
    # rows without an upper level have no shear and stay missing
    return low.join(high, keys, "left").select(
        *keys, physics.power_law_speed("low", "high", 10.0, 100.0, reference_height=38.0).alias("hub_speed")
    )


@query(
    "h12_level_height",
    """SELECT DISTINCT toplevel, bottomlevel, slope,
        CAST(round_even((toplevel + bottomlevel + slope) / 2, 0) AS INTEGER) AS half_even,
        CAST(round((toplevel + bottomlevel + slope) / 2) AS INTEGER) AS half_up
    FROM (SELECT toplevel, bottomlevel, qs, part_key FROM nwp_raw) n JOIN topo ON location_id = part_key""",
    num="toplevel bottomlevel slope",
)
def h12(t):
    rows = t.nwp_raw.select("toplevel", "bottomlevel", F.col("part_key").alias("location_id"))
    top = F.col("toplevel") + F.col("slope")
    return rows.join(t.topo.select("location_id", "slope"), "location_id").select(
        "toplevel",
        "bottomlevel",
        "slope",
        physics.level_height(top, "bottomlevel").alias("half_even"),
        physics.level_height(top, "bottomlevel", "half_up").alias("half_up"),
    ).distinct()


@query(
    "h13_valid_time",
    """SELECT grid_id, starttime, forecasttime, count(*) AS n, starttime + to_minutes(CAST(forecasttime * 15 AS INTEGER)) AS valid_time
    FROM nwp_raw GROUP BY ALL""",
    ts="starttime valid_time",
)
def h13(t):
    valid = physics.valid_time("starttime", F.col("forecasttime") / 4.0)
    return t.nwp_raw.groupBy(*KEYS[:3], valid.alias("valid_time")).agg(F.count(F.lit(1)).alias("n"))


HAVERSINE_SQL = """2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2)
    + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"""
BEARING_SQL = """atan2(sin(radians({b}.longitude - {a}.longitude)) * cos(radians({b}.latitude)),
    cos(radians({a}.latitude)) * sin(radians({b}.latitude))
    - sin(radians({a}.latitude)) * cos(radians({b}.latitude)) * cos(radians({b}.longitude - {a}.longitude)))"""

# a station and the grid node of the same number
PAIR_SQL = "stations s JOIN nodes n ON s.station_id = lpad(CAST(n.grid_id AS VARCHAR), 5, '0')"


def station_node_pairs(t):
    node = t.nodes.select(
        F.lpad(F.col("grid_id").cast("string"), 5, "0").alias("station_id"),
        F.col("latitude").alias("node_lat"),
        F.col("longitude").alias("node_lon"),
    )
    return t.stations.join(node, "station_id")


POINTS = ("latitude", "longitude", "node_lat", "node_lon")


@query(
    "h14_haversine",
    f"SELECT s.station_id, {HAVERSINE_SQL.format(a='s', b='n')} AS km FROM {PAIR_SQL}",
    num="km",
)
def h14(t):
    return station_node_pairs(t).select("station_id", geo.haversine_km(*POINTS).alias("km"))


@query("h15_geodesic", num="km bearing")
def h15(t):
    pair = station_node_pairs(t).withColumn("g", geo.geodesic(*POINTS))
    return pair.select("station_id", F.col("g.km").alias("km"), F.col("g.bearing").alias("bearing"))


@query(
    "h16_spherical_bearing",
    f"""SELECT s.station_id, sin({BEARING_SQL.format(a='s', b='n')}) AS brg_sin,
        cos({BEARING_SQL.format(a='s', b='n')}) AS brg_cos FROM {PAIR_SQL}""",
    num="brg_sin brg_cos",
)
def h16(t):
    sin, cos = geo.bearing_sin_cos(*POINTS)
    return station_node_pairs(t).select("station_id", sin.alias("brg_sin"), cos.alias("brg_cos"))


def _utm_sql(lat: str, lon: str) -> str:
    """(east, north) by the series in the third flattening, from the definition of the conformal latitude."""
    return f"""SELECT station_id, 500000e0 + 0.9996e0 * q * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS x,
        0.9996e0 * q * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS y
    FROM (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM (
        SELECT *, sinh(atanh(sin(p)) - e * atanh(e * sin(p))) AS t FROM (
            SELECT s.station_id, radians({lat}) AS p, radians({lon} - 9) AS l, n, sqrt(f * (2 - f)) AS e, n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 AS a1,
                13 * n * n / 48 - 3 * pow(n, 3) / 5 AS a2, 61 * pow(n, 3) / 240 AS a3, 6378137e0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS q
            FROM {PAIR_SQL} CROSS JOIN (SELECT 1 / 298.257223563e0 AS f, 1 / (2 * 298.257223563e0 - 1) AS n))))"""


@query(
    "h17_utm_anisotropic",
    f"""WITH a AS ({_utm_sql('s.latitude', 's.longitude')}), b AS ({_utm_sql('n.latitude', 'n.longitude')}),
    d AS (SELECT station_id, a.x AS easting, a.y AS northing, b.x - a.x AS dx, b.y - a.y AS dy FROM a JOIN b USING (station_id))
    SELECT station_id, easting, northing, sqrt(pow(dx * sin(radians(135)) + dy * cos(radians(135)), 2)
        + pow((dx * cos(radians(135)) - dy * sin(radians(135))) / 0.5, 2)) / 1000 AS anisotropic_km, sqrt(dx * dx + dy * dy) / 1000 AS planar_km FROM d""",
    num="easting northing anisotropic_km planar_km",
)
def h17(t):
    east, north = geo.utm(F.col("latitude"), F.col("longitude"))
    node_east, node_north = geo.utm(F.col("node_lat"), F.col("node_lon"))
    placed = station_node_pairs(t).select(
        "station_id", east.alias("easting"), north.alias("northing"), node_east.alias("x2"), node_north.alias("y2")
    )
    ends = ("easting", "northing", "x2", "y2")
    return placed.select(
        "station_id", "easting", "northing",
        geo.anisotropic_km(*ends, 135.0, 0.5).alias("anisotropic_km"),
        geo.anisotropic_km(*ends, 135.0, 1.0).alias("planar_km"),
    )


@query(
    "h18_variogram_models",
    """SELECT event_id, CASE WHEN h = 0 THEN 0 WHEN h <= 3 THEN 0.1e0 + 2 * (1.5e0 * h / 3 - 0.5e0 * pow(h / 3, 3)) ELSE 2.1e0 END AS spherical,
        CASE WHEN h = 0 THEN 0 ELSE 0.1e0 + 2 * (1 - exp(-pow(h / 3, 2))) END AS gaussian,
        CASE WHEN h = 0 THEN 0 ELSE 0.1e0 + 2 * (1 - exp(-h / 3)) END AS exponential
    FROM (SELECT event_id, wind_speed AS h FROM raw)""",
    num="spherical gaussian exponential",
)
def h18(t):
    from galeframe.operators.kriging import variogram

    models = [
        variogram(m, "wind_speed", 0.1, 2.0, 3.0).alias(m) for m in ("spherical", "gaussian", "exponential")
    ]
    return t.raw.select("event_id", *models)


@query(
    "h19_irradiance",
    """SELECT event_id, CASE WHEN temperature IS NOT NULL AND wind_speed IS NOT NULL THEN greatest(temperature * 10 + wind_speed, 0) END AS ghi,
        CASE WHEN temperature IS NOT NULL THEN greatest(temperature * 10, 0) END AS bhi,
        CASE WHEN temperature IS NOT NULL THEN greatest(temperature * 10, 0) END AS direct_only FROM raw""",
    num="ghi bhi direct_only",
)
def h19(t):
    direct = F.col("temperature") * 10.0
    return t.raw.select(
        "event_id",
        physics.global_irradiance(direct, "wind_speed").alias("ghi"),
        physics.non_negative(direct).alias("bhi"),
        physics.global_irradiance(direct, None).alias("direct_only"),
    )


@query(
    "h20_park_age",
    """SELECT o_orderkey, floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-01-01') / 365e0) AS whole_years,
        date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-01-01') / 365.25e0 AS years FROM orders""",
    num="whole_years years",
)
def h20(t):
    reference = F.lit("2024-01-01").cast("date")
    return t.table("orders").select(
        "o_orderkey",
        physics.age_years("o_orderdate", reference).alias("whole_years"),
        physics.age_years("o_orderdate", reference, whole=False).alias("years"),
    )


@query(
    "h21_clip",
    """SELECT event_id, CASE WHEN temperature IS NOT NULL THEN least(greatest(temperature / 20, 0), 1) END AS clipped,
        CASE WHEN temperature IS NOT NULL THEN greatest(temperature, 0) END AS positive FROM raw""",
    num="clipped positive",
)
def h21(t):
    value = F.col("temperature")
    return t.raw.select(
        "event_id",
        physics.clip(value / 20.0, 0, 1).alias("clipped"),
        physics.non_negative(value).alias("positive"),
    )


@query(
    "h22_name_parsing",
    r"""SELECT number, regexp_extract(study_name, 'm-([^_]+)', 1) AS model,
        CAST(regexp_extract(study_name, 'out-([0-9]+)', 1) AS INTEGER) AS output_dim,
        regexp_extract(study_name, 'freq-([^_]+)', 1) AS freq,
        CAST(replace(CAST(CAST(floor(value / 10000) AS INTEGER) AS VARCHAR) || '%', '%', '') AS DOUBLE) / 100 AS share
    FROM trials""",
    num="share",
)
def h22(t):
    percent = F.concat(F.floor(F.col("value") / 10000).cast("string"), F.lit("%"))
    parts = text.study_name_parts("study_name")
    return t.trials.select(
        "number",
        parts["model"].alias("model"),
        parts["output_dim"].alias("output_dim"),
        parts["freq"].alias("freq"),
        text.percent_to_number(percent).alias("share"),
    )


@query(
    "h23_position_encoding",
    """SELECT station_id, sin(radians(latitude)) AS lat_sin, cos(radians(latitude)) AS lat_cos,
        sin(radians(longitude)) AS lon_sin, cos(radians(longitude)) AS lon_cos,
        (station_height - (SELECT avg(station_height) FROM stations))
            / greatest((SELECT stddev_pop(station_height) FROM stations), 1e-6) AS height_z
    FROM stations""",
    num="lat_sin lat_cos lon_sin lon_cos height_z",
)
def h23(t):
    from galeframe.operators.scale import fit_scaler, standardize

    names = ("lat_sin", "lat_cos", "lon_sin", "lon_cos")
    encoded = [c.alias(n) for c, n in zip(geo.position_encoding("latitude", "longitude"), names)]
    stats = fit_scaler(t.stations, ["station_height"])
    z = standardize("station_height", stats, floor=1e-6).alias("height_z")
    return t.stations.select("station_id", *encoded, z)


@query(
    "a12_umlaut_key",
    """SELECT c_custkey, replace(replace(replace(replace(replace(c_name || '_höh', 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'),
        'ß', 'ss'), 'Ä', 'Ae') AS park_key FROM customer""",
)
def a12(t):
    return t.table("customer").select(
        "c_custkey", text.ascii_key(F.concat("c_name", F.lit("_höh"))).alias("park_key")
    )
