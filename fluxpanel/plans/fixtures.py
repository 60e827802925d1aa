"""The driver's tables as panels, graphs and grids, in Spark and in SQL.

Cell values are square roots of exact means (integer cents over counts), so
both engines start from the same bits and rounding never meets a tie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators import graph, panel, spatial
from ..tables import materialise

#: Depth of the shells on the nation panel, and its baseline year.
DEPTH, BASE_YEAR = 3, 1995


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice5(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return load(spark, sf_dir, "nation").select(key.alias("pixel_id"), F.floor(key / 5).cast("double").alias("latitude"), (key % 5).cast("double").alias("longitude"))


def lattice10(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.range(100).select(F.col("id").alias("pixel_id"), F.expr("id div 10").cast("double").alias("latitude"), (F.col("id") % 10).cast("double").alias("longitude"))


def irregular(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """The 10 x 10 lattice with a hole, where graph distance is not a formula."""
    return lattice10(spark).filter(~(F.col("latitude").between(4, 5) & F.col("longitude").between(3, 6)))


def _month(c: str):
    return F.date_trunc("month", c).cast("timestamp_ntz")


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = load(spark, sf_dir, "orders").select(_month("o_orderdate").alias("ts")).distinct()
    return panel.period_index(stamps)


def panel_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel_id, ts, t, y): nations by months of orders, null where none."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", _month("o_orderdate").alias("ts"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    owner = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("pixel_id"))
    seen = orders.join(owner, "o_custkey").groupBy("pixel_id", "ts").agg(F.sqrt(F.sum("cents") / (F.count(F.lit(1)) * 100.0)).alias("y"))
    rows = panel.spine(lattice5(spark, sf_dir).select("pixel_id"), months(spark, sf_dir))
    return panel.on_spine(rows, seen, ["pixel_id", "ts"]).select("pixel_id", "ts", "t", "y")


def filled_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.fill_gaps(panel_a(spark, sf_dir)).select("pixel_id", "ts", "t", F.col("filled").alias("y"))


def panel_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel_id, t, y): cells of the events by day, only where there are any."""
    e = load(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("pixel_id"), (F.dayofyear("ts") - 1).cast("int").alias("t"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return e.groupBy("pixel_id", "t").agg(F.sqrt(F.sum("cents") / (F.count(F.lit(1)) * 100.0)).alias("y"))


def flow_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, i, j): which nations' suppliers a nation's returned large lines came from."""
    lines = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 40").select("l_orderkey", "l_suppkey")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", _month("o_orderdate").alias("ts"))
    buyers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("i"))
    makers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("j"))
    met = lines.join(orders, "l_orderkey").join(buyers, "o_custkey").join(makers, "l_suppkey").filter("i <> j")
    return met.join(F.broadcast(months(spark, sf_dir)), "ts").select("t", "i", "j").distinct()


def shells5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shells(spatial.queen_adjacency(lattice5(spark, sf_dir), 1.0), DEPTH)


def upwind_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.upwind(flow_a(spark, sf_dir), shells5(spark, sf_dir))


def channels_a(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    values = materialise(filled_a(spark, sf_dir))
    baseline = panel.season_baseline(values, base_year=BASE_YEAR)
    w = upwind_a(spark, sf_dir)
    return ch.panel_channels(w.filter(F.col("k") <= depth), values, baseline, depth)


def sample_a(spark: SparkSession, sf_dir: str, depth: int = DEPTH, spec: ch.Spec = ch.SPECS[1]) -> DataFrame:
    return ch.sample(channels_a(spark, sf_dir, depth), spec, BASE_YEAR)


def raster_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, latitude, longitude, value): the events' cells by day as a field."""
    return panel_b(spark, sf_dir).join(lattice10(spark), "pixel_id").select("t", "latitude", "longitude", F.col("y").alias("value"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, user_id, n, pixel_id): cells in the order a user met them in a day, n from 0."""
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("pixel_id"), (F.dayofyear("ts") - 1).cast("int").alias("day"))
    order = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    return e.select("day", "user_id", (F.row_number().over(order) - 1).alias("n"), "pixel_id")


#: The same fixtures for DuckDB; every registered SQL begins with them.
SQL = """
WITH RECURSIVE lattice5 AS (SELECT n_nationkey::BIGINT pixel_id, (n_nationkey // 5)::DOUBLE latitude, (n_nationkey % 5)::DOUBLE longitude FROM nation),
lattice10 AS (SELECT k::BIGINT pixel_id, (k // 10)::DOUBLE latitude, (k % 10)::DOUBLE longitude FROM range(100) r(k)),
irregular AS (SELECT * FROM lattice10 WHERE NOT (latitude BETWEEN 4 AND 5 AND longitude BETWEEN 3 AND 6)),
months AS (SELECT ts, (row_number() OVER (ORDER BY ts) - 1)::INTEGER t FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP ts FROM orders)),
obs_a AS (SELECT c_nationkey::BIGINT pixel_id, date_trunc('month', o_orderdate)::TIMESTAMP ts, sqrt(sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE)) y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
panel_a AS (SELECT l.pixel_id, m.ts, m.t, o.y FROM lattice5 l CROSS JOIN months m LEFT JOIN obs_a o ON o.pixel_id = l.pixel_id AND o.ts = m.ts),
held_a AS (SELECT *, last_value(y IGNORE NULLS) OVER b y0, last_value(CASE WHEN y IS NOT NULL THEN ts END IGNORE NULLS) OVER b t0,
    first_value(y IGNORE NULLS) OVER a y1, first_value(CASE WHEN y IS NOT NULL THEN ts END IGNORE NULLS) OVER a t1 FROM panel_a
  WINDOW b AS (PARTITION BY pixel_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY pixel_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled_a AS (SELECT pixel_id, ts, t, coalesce(y, y0 + epoch(ts - t0)::DOUBLE / nullif(epoch(t1 - t0), 0) * (y1 - y0), y0, y1) y FROM held_a),
obs_b AS (SELECT (props->>'$.k')::BIGINT pixel_id, (dayofyear(ts) - 1)::INTEGER t, sqrt(sum(round(value * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE)) y FROM events GROUP BY 1, 2),
raster_b AS (SELECT t, latitude, longitude, y AS value FROM obs_b JOIN lattice10 USING (pixel_id)),
flow_a AS (SELECT DISTINCT m.t, c_nationkey::BIGINT i, s_nationkey::BIGINT j FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN months m ON m.ts = date_trunc('month', o_orderdate) WHERE l_returnflag = 'R' AND l_quantity >= 40 AND c_nationkey <> s_nationkey),
shells5 AS (SELECT a.pixel_id i, b.pixel_id j, greatest(abs(a.latitude - b.latitude), abs(a.longitude - b.longitude))::INTEGER k FROM lattice5 a, lattice5 b
  WHERE greatest(abs(a.latitude - b.latitude), abs(a.longitude - b.longitude)) BETWEEN 1 AND 3),
upwind_a AS (SELECT t, i, j, k FROM flow_a JOIN shells5 USING (i, j)),
season_own AS (SELECT pixel_id, month(ts) AS month, avg(y) own FROM filled_a WHERE year(ts) = 1995 GROUP BY 1, 2),
season_mean AS (SELECT pixel_id, avg(y) mean FROM filled_a WHERE year(ts) = 1995 GROUP BY 1),
season_a AS (SELECT l.pixel_id, m.k::INTEGER AS month, coalesce(own, mean, 0) y0 FROM lattice5 l CROSS JOIN range(1, 13) m(k)
  LEFT JOIN season_own o ON o.pixel_id = l.pixel_id AND o.month = m.k LEFT JOIN season_mean s ON s.pixel_id = l.pixel_id),
values_a AS (SELECT f.pixel_id, f.ts, f.t, f.y, s.y0 FROM filled_a f JOIN season_a s ON s.pixel_id = f.pixel_id AND s.month = month(f.ts)),
lag_sums AS (SELECT u.t, u.i, u.k, count(*) n, sum(coalesce(y, 0)) sy, avg(coalesce(y, 0)) m, avg(coalesce(y0, 0)) m0 FROM upwind_a u LEFT JOIN values_a v ON v.pixel_id = u.j AND v.t = u.t GROUP BY 1, 2, 3),
dense AS (SELECT v.pixel_id, v.ts, v.t, v.y, q.k::INTEGER k, coalesce(s.n, 0)::DOUBLE n, coalesce(s.m, 0) m, coalesce(s.m0, 0) m0
  FROM values_a v CROSS JOIN range(1, 4) q(k) LEFT JOIN lag_sums s ON s.i = v.pixel_id AND s.t = v.t AND s.k = q.k),
moved AS (SELECT *, lag(n) OVER o pn, lag(m) OVER o pm, lag(m0) OVER o pm0 FROM dense WINDOW o AS (PARTITION BY pixel_id, k ORDER BY t)),
split AS (SELECT pixel_id, ts, t, k, n * m - pn * pm dx, n * m0 - pn * pm0 dz, (n - pn) * (m + pm) / 2 xc, (m - pm) * (n + pn) / 2 xm,
  (n - pn) * (m0 + pm0) / 2 zc, (m0 - pm0) * (n + pn) / 2 zm FROM moved WHERE pn IS NOT NULL),
lags AS (SELECT pixel_id, ts, t, y, y - lag(y) OVER o dy, lag(y) OVER o - lag(y, 2) OVER o dyl, lag(y, 2) OVER o l2, lag(y, 3) OVER o l3 FROM filled_a WINDOW o AS (PARTITION BY pixel_id ORDER BY t)),
sample1 AS (SELECT l.pixel_id, l.ts, l.t, dy, dyl, l2, l3, dx, dz FROM lags l JOIN split s ON s.pixel_id = l.pixel_id AND s.t = l.t AND s.k = 1
  WHERE dy IS NOT NULL AND dyl IS NOT NULL AND l2 IS NOT NULL AND year(l.ts) > 1995),
centred AS (SELECT pixel_id, t, dy - avg(dy) OVER () y, dyl - avg(dyl) OVER () x1, dx - avg(dx) OVER () x2, l2 - avg(l2) OVER () z1, dz - avg(dz) OVER () z2 FROM sample1),
cross_products AS (SELECT count(*)::DOUBLE n, sum(z1 * x1) a11, sum(z1 * x2) a12, sum(z2 * x1) a21, sum(z2 * x2) a22, sum(z1 * y) b1, sum(z2 * y) b2, sum(z1 * z1) z11, sum(z1 * z2) z12, sum(z2 * z2) z22 FROM centred),
solved AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a21) alpha, (a11 * b2 - a21 * b1) / (a11 * a22 - a12 * a21) beta, a11 * a22 - a12 * a21 det FROM cross_products),
resid AS (SELECT c.*, c.y - s.alpha * c.x1 - s.beta * c.x2 e FROM centred c, solved s)
"""
