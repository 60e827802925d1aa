"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, spatial
from . import fixtures as fx
from .panel_queries import r6
from .registry import query

#: Weights of the shells where a query needs some.
BETA = {1: 0.08, 2: 0.04, 3: 0.02}


@query("SELECT DISTINCT l_suppkey % 25 AS i, l_partkey % 25 AS j FROM lineitem WHERE l_discount <> 0 AND l_suppkey % 25 <> l_partkey % 25")
def binarize(spark: SparkSession, d: str) -> DataFrame:
    entries = fx.load(spark, d, "lineitem").select((F.col("l_suppkey") % 25).alias("i"), (F.col("l_partkey") % 25).alias("j"), F.col("l_discount").alias("v"))
    return graph.binarize(entries)


_QUEEN = "queen AS (SELECT a.pixel_id i, b.pixel_id j FROM irregular a, irregular b WHERE a.pixel_id <> b.pixel_id AND abs(a.latitude - b.latitude) <= 1 AND abs(a.longitude - b.longitude) <= 1)"


@query("SELECT i, j FROM queen", _QUEEN)
def queen_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return spatial.queen_adjacency(fx.irregular(spark), 1.0)


@query("SELECT count(*) AS links, count(*)::DOUBLE / (SELECT count(*) FROM irregular) AS mean_degree FROM queen", _QUEEN)
def mean_degree(spark: SparkSession, d: str) -> DataFrame:
    grid = fx.irregular(spark)
    return spatial.queen_adjacency(grid, 1.0).agg(F.count(F.lit(1)).alias("links"), (F.count(F.lit(1)) / grid.count()).alias("mean_degree"))


@query(
    "SELECT i, j, min(k)::INTEGER k FROM steps WHERE i <> j GROUP BY 1, 2",
    _QUEEN + ", steps(i, j, k) AS (SELECT i, j, 1 FROM queen UNION SELECT s.i, q.j, s.k + 1 FROM steps s JOIN queen q ON q.i = s.j WHERE s.k < 5)",
)
def geodesic_shells(spark: SparkSession, d: str) -> DataFrame:
    return graph.shells(spatial.queen_adjacency(fx.irregular(spark), 1.0), 5)


_TRACKS = "tracks AS (SELECT (dayofyear(ts) - 1)::INTEGER AS day, user_id, row_number() OVER (PARTITION BY user_id, dayofyear(ts) ORDER BY ts, event_id) - 1 AS n, (props->>'$.k')::BIGINT AS pixel_id FROM events)"


@query("SELECT DISTINCT a.day, a.pixel_id AS i, b.pixel_id AS j FROM tracks a JOIN tracks b USING (day, user_id) JOIN irregular g ON g.pixel_id = b.pixel_id WHERE a.n = 0 AND b.n > 0 AND a.pixel_id <> b.pixel_id", _TRACKS)
def circulation_edges(spark: SparkSession, d: str) -> DataFrame:
    tracks = fx.tracks(spark, d)
    origin = tracks.filter("n = 0").select("day", "user_id", F.col("pixel_id").alias("i"))
    later = tracks.filter("n > 0").join(fx.lattice10(spark), "pixel_id")
    points = later.join(origin, ["day", "user_id"]).select("day", "i", (F.col("latitude") + 0.3).alias("lat"), (F.col("longitude") - 0.2).alias("lon"))
    met = spatial.nearest_cell(points, fx.irregular(spark), 1.0, ["day", "i"])
    return met.select("day", "i", F.col("cell").alias("j")).filter("i <> j").distinct()


@query("SELECT t, i, j, k FROM upwind_a")
def upwind_edges(spark: SparkSession, d: str) -> DataFrame:
    return fx.upwind_a(spark, d).select("t", "i", "j", "k")


@query("SELECT t, i, j FROM flow_a f WHERE NOT (i > j AND EXISTS (SELECT 1 FROM flow_a g WHERE g.t = f.t AND g.i = f.j AND g.j = f.i))")
def unidirectional_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.unidirectional(fx.flow_a(spark, d), ["t"])


@query("SELECT f.t, count(g.i)::DOUBLE / count(*) AS share FROM flow_a f LEFT JOIN flow_a g ON g.t = f.t AND g.i = f.j AND g.j = f.i GROUP BY 1")
def bidirectional_fraction(spark: SparkSession, d: str) -> DataFrame:
    return graph.bidirectional_share(fx.flow_a(spark, d), ["t"])


@query("SELECT t, i, j, k, 1::DOUBLE / count(*) OVER (PARTITION BY t, i, k) AS w FROM upwind_a")
def row_standardise(spark: SparkSession, d: str) -> DataFrame:
    return graph.row_standardised(fx.upwind_a(spark, d), ["t", "k"]).select("t", "i", "j", "k", "w")


@query("SELECT t, i, k, n FROM lag_sums")
def shell_counts(spark: SparkSession, d: str) -> DataFrame:
    return fx.upwind_a(spark, d).groupBy("t", "i", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT t, i, k, n, round(sy, 6) AS sum_y FROM lag_sums")
def spatial_lag_sum(spark: SparkSession, d: str) -> DataFrame:
    return graph.spatial_lag(fx.upwind_a(spark, d), fx.filled_a(spark, d), "t", ["y"]).select("t", "i", "k", "n", *r6("sum_y"))


@query("SELECT t, i, k, round(m, 6) AS mean_y FROM lag_sums")
def spatial_lag_mean(spark: SparkSession, d: str) -> DataFrame:
    return graph.spatial_lag(fx.upwind_a(spark, d), fx.filled_a(spark, d), "t", ["y"]).select("t", "i", "k", *r6("mean_y"))


_AVERAGED = "total AS (SELECT count(*)::DOUBLE AS months FROM months), averaged AS (SELECT i, j, k, count(*) / any_value(months) AS w FROM upwind_a, total GROUP BY 1, 2, 3), standard AS (SELECT i, j, k, sum(w) / any_value(months) AS w FROM (SELECT *, 1::DOUBLE / count(*) OVER (PARTITION BY t, i, k) AS w FROM upwind_a), total GROUP BY 1, 2, 3)"


def _averaged(spark: SparkSession, d: str, standardise: bool = False) -> DataFrame:
    return graph.time_average(fx.upwind_a(spark, d), fx.months(spark, d).count(), "t", standardise)


@query("SELECT i, j, k, round(w, 9) w FROM averaged", _AVERAGED)
def time_average_binary(spark: SparkSession, d: str) -> DataFrame:
    return _averaged(spark, d).select("i", "j", "k", F.round("w", 9).alias("w"))


@query("SELECT i, j, k, round(w, 7) w FROM standard", _AVERAGED)
def time_average_std(spark: SparkSession, d: str) -> DataFrame:
    return _averaged(spark, d, True).select("i", "j", "k", F.round("w", 7).alias("w"))


@query("SELECT k, round(sum(w) / 25, 6) AS mean_row_sum FROM averaged GROUP BY 1", _AVERAGED)
def mean_row_sums(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.lattice5(spark, d).count()
    return graph.mean_row_sums(_averaged(spark, d), cells).select("k", *r6("mean_row_sum"))


_WEIGHTED = _AVERAGED + ", a AS (SELECT i, j, sum(w * CASE k WHEN 1 THEN 0.08 WHEN 2 THEN 0.04 ELSE 0.02 END::DOUBLE) AS a FROM averaged GROUP BY 1, 2)"


@query("SELECT i, j, round(a, 9) a FROM a", _WEIGHTED)
def weighted_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.weighted_adjacency(_averaged(spark, d), BETA).select("i", "j", F.round("a", 9).alias("a"))


@query(
    "SELECT l.pixel_id, round(1 + coalesce(s1.v, 0) + coalesce(s2.v, 0) + coalesce(s3.v, 0), 9) AS total FROM lattice5 l LEFT JOIN s1 ON s1.i = l.pixel_id LEFT JOIN s2 ON s2.i = l.pixel_id LEFT JOIN s3 ON s3.i = l.pixel_id",
    _WEIGHTED + ", s1 AS (SELECT i, sum(a) AS v FROM a GROUP BY 1), s2 AS (SELECT a.i, sum(a.a * s1.v) AS v FROM a JOIN s1 ON s1.i = a.j GROUP BY 1), s3 AS (SELECT a.i, sum(a.a * s2.v) AS v FROM a JOIN s2 ON s2.i = a.j GROUP BY 1)",
)
def neumann_truncated(spark: SparkSession, d: str) -> DataFrame:
    a = graph.weighted_adjacency(_averaged(spark, d), BETA)
    return graph.neumann_sums(a, fx.lattice5(spark, d), 3).select("pixel_id", F.round("total", 9).alias("total"))


#: The two-fold series: term m counts m + 1 times, until the largest is below 1e-13.  It
#: diverges where the largest grows beyond 1e13 or over 500 terms does not fall: no margins.
_DIVERGES = "(largest > 1e13 OR m >= 1000 AND m % 500 = 0 AND largest > 0.999999 * mark)"
_SERIES = _WEIGHTED + f""", both_ways AS MATERIALIZED (SELECT i AS of_, j AS by_, a, 'r' AS side FROM a UNION ALL SELECT j, i, a, 'c' FROM a),
terms(m, side, of_, v, mark) AS (SELECT 0, s.side, pixel_id, 1.0::DOUBLE, NULL::DOUBLE FROM lattice5, (VALUES ('r'), ('c')) s(side) UNION ALL SELECT any_value(t.m) + 1, b.side, b.of_, sum(b.a * t.v), any_value(CASE WHEN t.m % 500 = 0 THEN t.largest ELSE t.mark END)
  FROM (SELECT *, max(abs(v)) OVER () AS largest FROM terms) t JOIN both_ways b ON b.by_ = t.of_ AND b.side = t.side WHERE (t.m + 1) * t.largest >= 1e-13 AND NOT {_DIVERGES} GROUP BY b.side, b.of_),
ends AS (SELECT bool_or({_DIVERGES}) AS diverges FROM (SELECT m, max(abs(v)) AS largest, any_value(mark) AS mark FROM terms GROUP BY 1))"""


@query("SELECT of_ AS pixel_id, CASE WHEN NOT any_value(diverges) THEN round(sum((m + 1) * v) FILTER (side = 'r'), 9) END AS row_margin, CASE WHEN NOT any_value(diverges) THEN round(sum((m + 1) * v) FILTER (side = 'c'), 9) END AS col_margin FROM terms, ends GROUP BY 1", _SERIES)
def omega_margins(spark: SparkSession, d: str) -> DataFrame:
    a, cells = graph.weighted_adjacency(_averaged(spark, d), BETA), fx.lattice5(spark, d)
    margins = graph.multiplier_margins(a, cells)
    if margins is None:
        none = F.lit(None).cast("double")
        return cells.select("pixel_id", none.alias("row_margin"), none.alias("col_margin"))
    return margins.select("pixel_id", *[F.round(c, 9).alias(c) for c in ("row_margin", "col_margin")])
