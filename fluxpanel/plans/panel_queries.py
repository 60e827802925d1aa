"""Queries of the panel operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel, spatial
from ..operators.panel import fill_gaps
from ..sources import readers
from . import fixtures as fx
from .registry import query


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query("SELECT pixel_id, latitude, longitude FROM lattice5 ORDER BY pixel_id")
def grid_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.grid(fx.lattice5(spark, d))


@query("SELECT o_orderdate AS time, o_orderkey AS key, o_totalprice AS value FROM orders")
def alias_projection(spark: SparkSession, d: str) -> DataFrame:
    roles = {"time": ["time", "valid_time", "o_orderdate"], "key": ["pixel_id", "o_orderkey"], "value": ["lai", "LAI", "o_totalprice"]}
    return spatial.column_alias(fx.load(spark, d, "orders"), roles)


@query("SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = fx.load(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = fx.load(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT (a * 9 + b)::BIGINT pixel_id, -4 + a * 0.25::DOUBLE latitude, -62 + b * 0.25::DOUBLE longitude FROM range(17) r(a), range(9) s(b)")
def lattice_cross(spark: SparkSession, d: str) -> DataFrame:
    return readers.lattice(spark, (-4.0, 0.0), (-62.0, -60.0), 0.25)


@query("SELECT (a * 8 + b)::BIGINT pixel_id, -4 + (a + 0.5::DOUBLE) * 0.25 latitude, -62 + (b + 0.5::DOUBLE) * 0.25 longitude FROM range(16) r(a), range(8) s(b)")
def lattice_offset(spark: SparkSession, d: str) -> DataFrame:
    return readers.lattice(spark, (-4.0, 0.0), (-62.0, -60.0), 0.25, offset=0.5)


@query("SELECT pixel_id, ts, t, round(y, 6) y FROM panel_a")
def balanced_spine(spark: SparkSession, d: str) -> DataFrame:
    return fx.panel_a(spark, d).select("pixel_id", "ts", "t", *r6("y"))


@query("SELECT pixel_id, ts, round(y, 6) y FROM filled_a")
def interpolate_gaps(spark: SparkSession, d: str) -> DataFrame:
    return fx.filled_a(spark, d).select("pixel_id", "ts", *r6("y"))


@query("SELECT (SELECT count(*) FROM panel_a WHERE y IS NULL) AS before, (SELECT count(*) FROM filled_a WHERE y IS NULL) AS after")
def gap_counts(spark: SparkSession, d: str) -> DataFrame:
    return panel.gap_counts(fill_gaps(fx.panel_a(spark, d)), "y", "filled")


@query("SELECT ts, count(y)::DOUBLE / count(*) AS share FROM panel_a GROUP BY ts")
def finite_share(spark: SparkSession, d: str) -> DataFrame:
    return panel.finite_share(fx.panel_a(spark, d), "y")


@query("SELECT pixel_id, t, round(dy, 6) dy, round(dyl, 6) dyl, round(l2, 6) l2 FROM lags WHERE dy IS NOT NULL AND dyl IS NOT NULL AND l2 IS NOT NULL")
def finite_mask(spark: SparkSession, d: str) -> DataFrame:
    return panel.finite_rows(panel.panel_lags(fx.filled_a(spark, d)), "dy", "dyl", "l2").select("pixel_id", "t", *r6("dy", "dyl", "l2"))


@query("SELECT pixel_id, t, round(dy, 6) dy FROM lags")
def first_difference(spark: SparkSession, d: str) -> DataFrame:
    return panel.panel_lags(fx.filled_a(spark, d)).select("pixel_id", "t", *r6("dy"))


@query("SELECT pixel_id, t, round(dy, 6) dy, round(dyl, 6) dyl, round(l2, 6) l2, round(l3, 6) l3 FROM lags")
def panel_lags(spark: SparkSession, d: str) -> DataFrame:
    return panel.panel_lags(fx.filled_a(spark, d)).select("pixel_id", "t", *r6("dy", "dyl", "l2", "l3"))


@query("SELECT a.pixel_id, a.t, round(a.y, 6) y, round(coalesce(b.y, 0), 6) lagged, b.y IS NOT NULL AS present FROM obs_b a LEFT JOIN obs_b b ON b.pixel_id = a.pixel_id AND b.t = a.t - 2")
def exact_lag(spark: SparkSession, d: str) -> DataFrame:
    held = fx.panel_b(spark, d).withColumn("lagged", panel.shift("y", 2, ["pixel_id"]))
    return held.select("pixel_id", "t", *r6("y"), F.round(F.coalesce("lagged", F.lit(0.0)), 6).alias("lagged"), F.col("lagged").isNotNull().alias("present"))


@query("SELECT ts, t FROM months")
def period_index(spark: SparkSession, d: str) -> DataFrame:
    return fx.months(spark, d)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) n FROM orders) WHERE n = 1")
def change_points(spark: SparkSession, d: str) -> DataFrame:
    return panel.change_points(fx.load(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT pixel_id, ts, round(y, 6) y FROM panel_a WHERE t < 12")
def first_n_periods(spark: SparkSession, d: str) -> DataFrame:
    return panel.first_periods(fx.panel_a(spark, d), 12).select("pixel_id", "ts", *r6("y"))


@query("SELECT pixel_id, k::INTEGER AS month, round(coalesce(y0, 0), 6) y0 FROM (SELECT pixel_id, arg_min(y, ts) FILTER (y IS NOT NULL) y0 FROM panel_a GROUP BY 1), range(1, 13) r(k)")
def first_obs_baseline(spark: SparkSession, d: str) -> DataFrame:
    return panel.first_observation(fx.panel_a(spark, d)).select("pixel_id", "month", *r6("y0"))


@query("SELECT pixel_id, month, round(y0, 6) y0 FROM season_a")
def season_baseline(spark: SparkSession, d: str) -> DataFrame:
    return panel.season_baseline(fx.filled_a(spark, d), base_year=fx.BASE_YEAR).select("pixel_id", "month", *r6("y0"))


@query("SELECT pixel_id, ts, round(y, 6) y, round(y0, 6) y0 FROM values_a")
def season_lookup(spark: SparkSession, d: str) -> DataFrame:
    filled = fx.filled_a(spark, d)
    return panel.with_baseline(filled, panel.season_baseline(filled, base_year=fx.BASE_YEAR)).select("pixel_id", "ts", *r6("y", "y0"))


@query("SELECT pixel_id, ts, round(y, 6) y FROM filled_a WHERE year(ts) > 1995")
def exclude_base_year(spark: SparkSession, d: str) -> DataFrame:
    return panel.after_base_year(fx.filled_a(spark, d), fx.BASE_YEAR).select("pixel_id", "ts", *r6("y"))


@query("SELECT * FROM (PIVOT (SELECT pixel_id, 't' || t AS name, round(y, 6) y FROM filled_a) ON name USING max(y) GROUP BY pixel_id)")
def panel_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A column for each month of the axis, as many as it has."""
    months = [r["t"] for r in fx.months(spark, d).select("t").distinct().orderBy("t").collect()]
    wide = fx.filled_a(spark, d).groupBy("pixel_id").pivot("t", months).agg(F.max("y"))
    return wide.select("pixel_id", *[F.round(f"`{k}`", 6).alias(f"t{k}") for k in months])


@query("SELECT pixel_id, t, 'dy' AS name, round(dy, 6) AS value FROM lags WHERE dy IS NOT NULL UNION ALL SELECT pixel_id, t, 'dyl', round(dyl, 6) FROM lags WHERE dyl IS NOT NULL")
def panel_unpivot(spark: SparkSession, d: str) -> DataFrame:
    wide = panel.panel_lags(fx.filled_a(spark, d)).select("pixel_id", "t", *r6("dy", "dyl"))
    return wide.unpivot(["pixel_id", "t"], ["dy", "dyl"], "name", "value").filter("value is not null")


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1, 2")
def monthly_resample(spark: SparkSession, d: str) -> DataFrame:
    return panel.monthly_mean(fx.load(spark, d, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority").select("month", "o_orderpriority", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("SELECT t, floor(latitude / 2.5)::BIGINT bin_lat, floor(longitude / 2.5)::BIGINT bin_lon, round(avg(value), 6) AS value, count(*) n FROM raster_b GROUP BY 1, 2, 3")
def spatial_bin_mean(spark: SparkSession, d: str) -> DataFrame:
    return panel.bin_mean(fx.raster_b(spark, d), 2.5, "value", "latitude", "longitude", "t").select("t", "bin_lat", "bin_lon", *r6("value"), "n")


@query("SELECT c_custkey, nullif(CASE WHEN c_acctbal < 0 THEN -9999 ELSE c_acctbal END, -9999) AS balance FROM customer")
def sentinel_null(spark: SparkSession, d: str) -> DataFrame:
    marked = fx.load(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, -9999.0).otherwise(F.col("c_acctbal")).alias("balance"))
    return panel.sentinel_null(marked, "balance")


@query("SELECT pixel_id, t, round(dy - avg(dy) OVER (), 6) dy, round(l2 - avg(l2) OVER (), 6) l2 FROM lags WHERE dy IS NOT NULL AND l2 IS NOT NULL")
def demean(spark: SparkSession, d: str) -> DataFrame:
    rows = panel.finite_rows(panel.panel_lags(fx.filled_a(spark, d)), "dy", "l2")
    return panel.demean(rows, "dy", "l2").select("pixel_id", "t", *r6("dy", "l2"))


@query("SELECT count(*) n, count(DISTINCT pixel_id) clusters, count(DISTINCT t) periods, count(l3) with_l3 FROM sample1")
def sample_counts(spark: SparkSession, d: str) -> DataFrame:
    return fx.sample_a(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pixel_id").alias("clusters"), F.count_distinct("t").alias("periods"), F.count("l3").alias("with_l3"))
