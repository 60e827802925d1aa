"""Queries of the spatial and trajectory operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial, trajectory
from ..sources import synthetic
from . import build
from ..sources import months
from . import fixtures as fx
from .panel_queries import r6
from .registry import query


@query("SELECT pixel_id, round(cos(radians(latitude)) * cos(radians(longitude)), 9) x, round(cos(radians(latitude)) * sin(radians(longitude)), 9) y, round(sin(radians(latitude)), 9) z FROM lattice10")
def unit_sphere(spark: SparkSession, d: str) -> DataFrame:
    xyz = geo.unit_sphere(F.col("latitude"), F.col("longitude"))
    return fx.lattice10(spark).select("pixel_id", *[F.round(c, 9).alias(n) for c, n in zip(xyz, "xyz", strict=True)])


#: Targets off the lattice: the nations' cells, moved and stretched.
_TARGETS = "targets AS (SELECT pixel_id, latitude * 2.13 + 0.21 AS latitude, longitude * 2.71 - 0.37 AS longitude FROM lattice5), pairs AS (SELECT t.pixel_id, s.pixel_id AS source, round(sqrt((cos(radians(t.latitude)) * cos(radians(t.longitude)) - cos(radians(s.latitude)) * cos(radians(s.longitude))) ** 2 + (cos(radians(t.latitude)) * sin(radians(t.longitude)) - cos(radians(s.latitude)) * sin(radians(s.longitude))) ** 2 + (sin(radians(t.latitude)) - sin(radians(s.latitude))) ** 2), 12) AS c FROM targets t, lattice10 s), nearest AS (SELECT pixel_id, source, degrees(2 * asin(least(c / 2, 1))) AS degrees FROM pairs QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY c, source) = 1)"


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return fx.lattice5(spark, d).select("pixel_id", (F.col("latitude") * 2.13 + 0.21).alias("latitude"), (F.col("longitude") * 2.71 - 0.37).alias("longitude"))


@query("SELECT pixel_id, source, round(degrees, 6) degrees FROM nearest WHERE degrees <= 1", _TARGETS)
def nearest_cell_sphere(spark: SparkSession, d: str) -> DataFrame:
    met = spatial.nearest_on_sphere(_targets(spark, d), spatial.Lattice.of(fx.lattice10(spark)))
    return met.filter("source is not null").select("pixel_id", "source", *r6("degrees"))


@query("SELECT pixel_id, CASE WHEN degrees <= 0.5 THEN source END AS source FROM nearest", _TARGETS)
def nearest_guard(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_on_sphere(_targets(spark, d), spatial.Lattice.of(fx.lattice10(spark)), limit=0.5).select("pixel_id", "source")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size = (SELECT p_size FROM (SELECT DISTINCT p_size FROM part) ORDER BY abs(p_size - 23.4), p_size LIMIT 1)")
def nearest_level(spark: SparkSession, d: str) -> DataFrame:
    parts = fx.load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return spatial.nearest_level(parts, ["p_partkey"], "p_size", 23.4)


#: Points inside the lattice, from the events.
_POINTS = "points AS (SELECT event_id, value % 9 AS lat, (value * 7) % 9 AS lon, 100 + (value * 13) % 1000 AS pressure FROM events)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return fx.load(spark, d, "events").select("event_id", (v % 9).alias("lat"), ((v * 7) % 9).alias("lon"), (100 + (v * 13) % 1000).alias("pressure"))


@query(
    "SELECT event_id, cell, round(d, 6) AS distance FROM (SELECT event_id, pixel_id AS cell, round(sqrt((lat - latitude) ** 2 + (lon - longitude) ** 2), 12) AS d FROM points JOIN irregular ON abs(lat - latitude) <= 1 AND abs(lon - longitude) <= 1 WHERE sqrt((lat - latitude) ** 2 + (lon - longitude) ** 2) <= 0.7072 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, pixel_id) = 1)",
    _POINTS,
)
def voronoi_filter(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_cell(_points(spark, d), fx.irregular(spark), 1.0, ["event_id"]).select("event_id", "cell", *r6("distance"))


@query("SELECT event_id FROM points WHERE lat BETWEEN 1 AND 7 AND lon BETWEEN 2 AND 8 AND pressure BETWEEN 100 AND 950", _POINTS)
def band_filter(spark: SparkSession, d: str) -> DataFrame:
    return spatial.inside_band(_points(spark, d), (1.0, 7.0, 2.0, 8.0)).select("event_id")


#: A square with a square hole, and a triangle apart from it.
_RINGS = {("a", 0): [(0.5, 0.5), (0.5, 5.5), (5.5, 5.5), (5.5, 0.5)], ("a", 1): [(2.2, 2.2), (2.2, 3.7), (3.7, 3.7), (3.7, 2.2)], ("b", 0): [(6.1, 6.1), (6.1, 8.9), (8.9, 6.1)]}
_SIDES = [(p, r, *ring[k], *ring[(k + 1) % len(ring)]) for (p, r), ring in _RINGS.items() for k in range(len(ring))]
_EDGES = "edges(polygon, ring, lat1, lon1, lat2, lon2) AS (VALUES " + ", ".join(f"('{p}', {r}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for p, r, a, b, c, e in _SIDES) + "), odd AS (SELECT pixel_id, polygon, ring, sum(CASE WHEN (lat1 > latitude) <> (lat2 > latitude) AND longitude < lon1 + (latitude - lat1) * (lon2 - lon1) / nullif(lat2 - lat1, 0) THEN 1 ELSE 0 END) % 2 = 1 AS odd FROM lattice10, edges GROUP BY ALL), poly AS (SELECT pixel_id, polygon, bool_or(odd AND ring = 0) AND NOT bool_or(odd AND ring > 0) AS inside FROM odd GROUP BY ALL)"


@query("SELECT pixel_id, bool_or(inside) AS inside FROM poly GROUP BY 1", _EDGES)
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    sides = spark.createDataFrame(_SIDES, "polygon string, ring int, lat1 double, lon1 double, lat2 double, lon2 double")
    return spatial.in_polygons(fx.lattice10(spark), sides, ["pixel_id"])


#: A smooth full field on the 10 x 10 lattice.
_FIELD = "field AS (SELECT latitude, longitude, sqrt(2 + latitude * 3 + longitude * longitude) AS value FROM lattice10), " + _POINTS


@query(
    "SELECT event_id, round(sum(w * f.value), 6) AS value FROM (SELECT event_id, (floor(lat) + a) AS ci, (floor(lon) + b) AS cj, CASE WHEN a = 1 THEN lat - floor(lat) ELSE 1 - (lat - floor(lat)) END * CASE WHEN b = 1 THEN lon - floor(lon) ELSE 1 - (lon - floor(lon)) END AS w FROM points, range(2) r(a), range(2) s(b)) c JOIN field f ON f.latitude = ci AND f.longitude = cj WHERE w > 0 GROUP BY 1",
    _FIELD,
)
def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    field = fx.lattice10(spark).select("latitude", "longitude", F.sqrt(2 + F.col("latitude") * 3 + F.col("longitude") * F.col("longitude")).alias("value"))
    return spatial.bilinear(_points(spark, d), field, 1.0, (0.0, 0.0), ["event_id"]).select("event_id", *r6("value"))


#: The events' field of all days on the full lattice, with its gaps.
_FULL = "days AS (SELECT DISTINCT t FROM raster_b), whole AS (SELECT q.t, l.latitude, l.longitude, r.value FROM days q CROSS JOIN lattice10 l LEFT JOIN raster_b r ON r.t = q.t AND r.latitude = l.latitude AND r.longitude = l.longitude), once AS (SELECT t, latitude, longitude, coalesce(value, avg(value) OVER (PARTITION BY t, latitude)) AS value FROM whole)"


def _full(spark: SparkSession, d: str) -> DataFrame:
    field = fx.raster_b(spark, d)
    days = field.select("t").distinct()
    return days.crossJoin(fx.lattice10(spark)).join(field, ["t", "latitude", "longitude"], "left").select("t", "latitude", "longitude", "value")


@query("SELECT t, latitude, longitude, round(coalesce(value, avg(value) OVER (PARTITION BY t, longitude), 0), 6) AS value FROM once", _FULL)
def row_col_mean_fill(spark: SparkSession, d: str) -> DataFrame:
    return spatial.row_col_fill(_full(spark, d), keys=["t"]).select("t", "latitude", "longitude", *r6("value"))


@query("SELECT latitude, longitude, count(value) > 0 AS land FROM whole GROUP BY 1, 2", _FULL)
def land_mask(spark: SparkSession, d: str) -> DataFrame:
    return spatial.land_mask(_full(spark, d), "value")


@query(
    "SELECT o_orderkey, o_orderdate, coalesce(t0, first) AS t0, coalesce(t1, CASE WHEN t0 IS NULL THEN first ELSE t0 END) AS t1, round(CASE WHEN t0 IS NULL OR t1 IS NULL THEN 0 ELSE epoch(o_orderdate - t0)::DOUBLE / epoch(t1 - t0) END, 9) AS w1 FROM (SELECT o_orderkey, o_orderdate, (SELECT max(ts) FROM axis WHERE ts <= o_orderdate) t0, (SELECT min(ts) FROM axis WHERE ts > o_orderdate) t1, (SELECT min(ts) FROM axis) first FROM orders)",
    "axis AS (SELECT ts + INTERVAL 15 DAY AS ts FROM months)",
)
def asof_bracket(spark: SparkSession, d: str) -> DataFrame:
    axis = fx.months(spark, d).select((F.col("ts") + F.expr("INTERVAL '15' DAY")).alias("ts"))
    events = fx.load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return spatial.bracket(events, axis, "o_orderdate").select("o_orderkey", "o_orderdate", "t0", "t1", F.round("w1", 9).alias("w1"))


@query(
    "SELECT event_id, round(lat - degrees(v * 3600 / 6371000), 6) lat, round(((lon - degrees(u * 3600 / (6371000 * greatest(cos(radians(lat)), cos(radians(89))))) + 180) % 360 + 360) % 360 - 180, 6) lon, round(pressure - w * 36, 6) pressure FROM (SELECT event_id, (value * 7) % 170 - 85 AS lat, (value * 11) % 360 - 180 AS lon, 800.0::DOUBLE AS pressure, value / 10 - 12 AS u, 8 - value / 15 AS v, value / 100 AS w FROM events)"
)
def euler_step(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("value")
    e = fx.load(spark, d, "events")
    after = geo.step_back((x * 7) % 170 - 85, (x * 11) % 360 - 180, F.lit(800.0), x / 10 - 12, 8 - x / 15, x / 100)
    return e.select("event_id", *[F.round(c, 6).alias(n) for c, n in zip(after, ("lat", "lon", "pressure"), strict=True)])


#: In a uniform wind (u = -6, v = 0) a parcel keeps its latitude and moves by equal steps.
@query(
    "SELECT ts, origin, h, round(lat, 6) lat, round(lon, 6) lon FROM (SELECT s.ts, g.pixel_id AS origin, r.h::INTEGER AS h, g.latitude AS lat, g.longitude + r.h * degrees(6 * 3600.0::DOUBLE / (6371000 * cos(radians(g.latitude)))) AS lon FROM lattice5 g, range(48) r(h), months s) WHERE lon <= 4"
)
def back_trajectory(spark: SparkSession, d: str) -> DataFrame:
    stamps = fx.months(spark, d).select(F.col("ts").alias("time"))
    raster = stamps.crossJoin(fx.lattice5(spark, d).select("latitude", "longitude")).select("time", "latitude", "longitude", F.lit(-6.0).alias("u"), F.lit(0.0).alias("v"), F.lit(0.0).alias("omega"))
    starts = fx.months(spark, d).select("ts")
    points = trajectory.back_trajectories(fx.lattice5(spark, d), starts, trajectory.Wind(raster), 48)
    return points.select("ts", "origin", "h", *r6("lat", "lon"))


@query("SELECT DISTINCT date_trunc('month', l_shipdate)::TIMESTAMP AS ts FROM lineitem INTERSECT SELECT ts FROM months")
def time_intersect(spark: SparkSession, d: str) -> DataFrame:
    shipped = fx.load(spark, d, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts")).distinct()
    return spatial.common_times(shipped, fx.months(spark, d))


@query("SELECT pixel_id, ts, round(y, 6) y FROM panel_a WHERE ts IN (SELECT DISTINCT date_trunc('month', l_shipdate)::TIMESTAMP FROM lineitem WHERE l_quantity >= 49)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    kept = fx.load(spark, d, "lineitem").filter("l_quantity >= 49").select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts")).distinct()
    return spatial.within_times(fx.panel_a(spark, d), kept).select("pixel_id", "ts", *r6("y"))


@query("SELECT count(*) FILTER (r.latitude IS NULL) AS only_left, count(*) FILTER (l.latitude IS NULL) AS only_right, count(*) FILTER (l.latitude IS NOT NULL AND r.latitude IS NOT NULL) AS both FROM irregular l FULL JOIN lattice5 r ON l.latitude = r.latitude AND l.longitude = r.longitude")
def grid_diff(spark: SparkSession, d: str) -> DataFrame:
    return spatial.grid_difference(fx.irregular(spark), fx.lattice5(spark, d))


#: A uniform wind that blows to the south-east and lifts parcels out of the band after 38 hours.
_U, _V, _OMEGA = -6.0, 2.0, 0.5


@query(
    "SELECT DISTINCT s.ts, a.i, a.j FROM arrived a, months s WHERE a.i <> a.j",
    f"""walks(i, h, lat, lon, p) AS (SELECT pixel_id, 0, latitude, longitude, 800.0::DOUBLE FROM irregular
  UNION ALL SELECT i, h + 1, lat - degrees({_V}::DOUBLE * 3600 / 6371000), lon - degrees({_U}::DOUBLE * 3600 / (6371000 * cos(radians(lat)))), p - {_OMEGA} * 36 FROM walks
  WHERE h < 119 AND lat - degrees({_V}::DOUBLE * 3600 / 6371000) BETWEEN 0 AND 9 AND lon - degrees({_U}::DOUBLE * 3600 / (6371000 * cos(radians(lat)))) BETWEEN 0 AND 9 AND p - {_OMEGA} * 36 BETWEEN 100 AND 950),
arrived AS (SELECT w.i, arg_min(g.pixel_id, (round(sqrt((w.lat - g.latitude) ** 2 + (w.lon - g.longitude) ** 2), 10) * 1000 + g.pixel_id / 1000000)) AS j FROM walks w JOIN irregular g ON sqrt((w.lat - g.latitude) ** 2 + (w.lon - g.longitude) ** 2) <= 0.7072 GROUP BY w.i, w.h)""",
)
def snapped_circulation(spark: SparkSession, d: str) -> DataFrame:
    """Which cells of the lattice with a hole the trajectories of every month visit."""
    stamps = fx.months(spark, d).select("ts")
    values = [F.lit(v).alias(n) for v, n in ((_U, "u"), (_V, "v"), (_OMEGA, "omega"))]
    raster = stamps.withColumnRenamed("ts", "time").crossJoin(fx.lattice10(spark).select("latitude", "longitude")).select("time", "latitude", "longitude", *values)
    return trajectory.snapped_circulation(fx.irregular(spark), stamps, trajectory.Wind(raster), 120, 1.0)


#: Leaf area and a wind on three levels, in Pa, of the nations' panel.
_LEVELS = (70000.0, 80000.0, 85000.0)


@query(
    "SELECT pixel_id, ts, round(coalesce(y::FLOAT::DOUBLE, (y0::FLOAT::DOUBLE + epoch(ts - t0)::DOUBLE / nullif(epoch(t1 - t0), 0) * (y1::FLOAT::DOUBLE - y0::FLOAT::DOUBLE))::FLOAT::DOUBLE, y0::FLOAT::DOUBLE, y1::FLOAT::DOUBLE), 2) AS lai, 10 + t * 0.25::DOUBLE AS u, pixel_id - 12.5::DOUBLE AS v, 0.5::DOUBLE AS omega FROM held_a"
)
def wind_level_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel of a leaf area with gaps and a wind with levels, both of the
    nations' months; cells lie a little off the fields' lattice."""
    held = fx.panel_a(spark, d).join(fx.lattice5(spark, d), "pixel_id").withColumnRenamed("ts", "time")
    lai = held.select("time", "latitude", "longitude", F.col("y").alias("lai"))
    wind = held.select("time", "latitude", "longitude", F.explode(F.array(*[F.lit(v) for v in _LEVELS])).alias("level"), "t", "pixel_id")
    wind = wind.select("time", "latitude", "longitude", "level", (F.col("level") / 8000 + F.col("t") * 0.25).alias("u"), (F.col("pixel_id") - 12.5).alias("v"), F.lit(0.5).alias("omega"))
    grid = fx.lattice5(spark, d).select("pixel_id", (F.col("latitude") + 0.2).alias("latitude"), (F.col("longitude") - 0.3).alias("longitude"))
    rows = build.build_panel(grid, lai, wind)
    return rows.select("pixel_id", "ts", F.round(F.col("lai").cast("double"), 2).alias("lai"), *[F.col(c).cast("double").alias(c) for c in ("u", "v", "omega")])


@query(
    "SELECT t, latitude, longitude, round(coalesce(u, avg(u) OVER (PARTITION BY t, longitude), 0), 4) AS u FROM rowed",
    _FULL + """, places AS (SELECT pixel_id, latitude - 4.5 AS latitude, longitude - 4.5 AS longitude FROM lattice10),
shore AS (SELECT pixel_id, latitude - 5 AS latitude, longitude - 5 AS longitude, pixel_id % 7 < 4 AS land FROM lattice10),
near AS (SELECT p.latitude, p.longitude, s.land FROM places p, shore s QUALIFY row_number() OVER (PARTITION BY p.pixel_id ORDER BY round(sqrt((cos(radians(p.latitude)) * cos(radians(p.longitude)) - cos(radians(s.latitude)) * cos(radians(s.longitude))) ** 2 + (cos(radians(p.latitude)) * sin(radians(p.longitude)) - cos(radians(s.latitude)) * sin(radians(s.longitude))) ** 2 + (sin(radians(p.latitude)) - sin(radians(s.latitude))) ** 2), 12), s.pixel_id) = 1),
masked AS (SELECT w.t, w.latitude - 4.5 AS latitude, w.longitude - 4.5 AS longitude, CASE WHEN n.land THEN w.value END AS u FROM whole w JOIN near n ON n.latitude = w.latitude - 4.5 AND n.longitude = w.longitude - 4.5),
rowed AS (SELECT t, latitude, longitude, coalesce(u, avg(u) OVER (PARTITION BY t, latitude)) AS u FROM masked)""",
)
def panel_fill_wind(spark: SparkSession, d: str) -> DataFrame:
    """The wind of a land-masked panel, around the origin, where the leaf area
    has its cells half a cell beside those of the wind."""
    moved = lambda df, by: df.withColumns({c: F.col(c) - by for c in ("latitude", "longitude")})
    field = moved(_full(spark, d), 4.5).select(F.col("t").alias("time"), "latitude", "longitude", F.col("value").alias("u"), F.lit(1.0).alias("v"), F.lit(0.0).alias("omega"))
    lai = moved(fx.lattice10(spark), 5.0).select("latitude", "longitude", F.when(F.col("pixel_id") % 7 < 4, 1.0).alias("lai"))
    out = build.wind_field(field, lai)
    return out.select(F.col("time").alias("t"), "latitude", "longitude", F.round("u", 4).alias("u"))


def _smoke_sql() -> str:
    """The smoke rasters as SQL: their formulas, and the one gap between its neighbours in time."""
    season = "sin(2 * pi() * t / 12)"
    lai = f"(4.0 + 0.5 * {season} + 0.02 * i + 0.01 * j)::FLOAT"
    at = lambda t: lai.replace("* t /", f"* {t} /")
    gap = f"({at(0)}::DOUBLE + 31.0 / 60 * ({at(2)}::DOUBLE - {at(0)}::DOUBLE))::FLOAT"
    return (
        "SELECT (i * 17 + j)::BIGINT AS pixel_id, (TIMESTAMP '2000-01-01' + to_months(t::INTEGER)) AS ts, "
        f"round(CASE WHEN t = 1 AND i = 0 AND j = 0 THEN {gap} ELSE {lai} END::DOUBLE, 4) AS lai, "
        f"round((-6.0 + {season})::DOUBLE, 4) AS u, round((0.5 * {season})::DOUBLE, 4) AS v, 0.0::DOUBLE AS omega FROM range(6) a(t), range(17) b(i), range(17) c(j)"
    )


@query(_smoke_sql())
def demo_smoke_panel(spark: SparkSession, d: str) -> DataFrame:
    """The smoke build's panel, of synthetic rasters."""
    t = synthetic.smoke_rasters(spark)
    rows = build.build_panel(t["grid"], t["lai"], t["wind"])
    return rows.select("pixel_id", "ts", *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in ("lai", "u", "v", "omega")])


_OVERLAP = """seen AS (SELECT date_trunc('day', ts)::TIMESTAMP AS time, k // 10 AS a, k % 10 AS b, avg(value) v FROM (SELECT *, (props->>'$.k')::BIGINT k FROM events) GROUP BY 1, 2, 3),
met AS (SELECT time, i, j, v, greatest(least((a + 1) * 0.4, i + 1) - greatest(a * 0.4, i), 0) * greatest(least((b + 1) * 0.4, j + 1) - greatest(b * 0.4, j), 0) w FROM seen, range(4) x(i), range(4) y(j))"""


@query("SELECT time, (i + 0.5) * 2.5 AS latitude, (j + 0.5) * 2.5 AS longitude, round(sum(w * v) / sum(w), 6) AS value FROM met WHERE w > 1e-9 GROUP BY 1, 2, 3", _OVERLAP)
def leaf_area_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of the events' cells, one degree wide, then means by overlap in cells of two and a half degrees."""
    k = F.get_json_object("props", "$.k").cast("long")
    raw = fx.load(spark, d, "events").select(F.col("ts").alias("time"), (F.floor(k / 10) + 0.5).alias("latitude"), (k % 10 + 0.5).alias("longitude"), "value")
    return months.mean_of_means(raw, "value", 1.0, 2.5, "day").withColumn("value", F.round("value", 6))
