"""Queries of the channels and the estimators.

With one shell the model is just identified and two by two, so its estimates
and clustered errors have closed forms that SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators import estimation
from ..operators.panel import demean, shift
from ..tables import materialise
from . import closed_forms as cf
from . import fixtures as fx
from . import report
from .panel_queries import r6
from .registry import query


def _by_shell(rows: DataFrame, *names: str) -> DataFrame:
    """Arrays over shells as rows (pixel_id, t, k, ...)."""
    zipped = F.posexplode(F.arrays_zip(*names)).alias("p", "r")
    return rows.select("pixel_id", "t", zipped).select("pixel_id", "t", (F.col("p") + 1).alias("k"), *[F.round(f"r.{n}", 6).alias(n) for n in names])


@query("SELECT pixel_id, t, k, n, round(m, 6) m, round(m0, 6) m0 FROM dense")
def channels(spark: SparkSession, d: str) -> DataFrame:
    return _by_shell(fx.channels_a(spark, d), "n", "m", "m0")


_PARTS = ("dx", "dz", "xc", "xm", "zc", "zm")


def _moved(spark: SparkSession, d: str) -> DataFrame:
    return ch.differences(fx.channels_a(spark, d)).filter("dx is not null")


@query("SELECT pixel_id, t, k, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in _PARTS) + " FROM split")
def bennet_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_shell(_moved(spark, d), *_PARTS)
    return rows.select("pixel_id", "t", "k", *[(F.col(c) + 0).alias(c) for c in _PARTS])


@query("SELECT round(max(abs(xc + xm - dx)), 6) AS error_x, round(max(abs(zc + zm - dz)), 6) AS error_z FROM split")
def bennet_identity_error(spark: SparkSession, d: str) -> DataFrame:
    return ch.identity_error(_moved(spark, d)).select(*r6("error_x", "error_z"))


@query("SELECT pixel_id, t, k, round(dx, 6) + 0 AS dx, round(dz, 6) + 0 AS dz FROM split")
def diff_spatial_lag(spark: SparkSession, d: str) -> DataFrame:
    return _by_shell(_moved(spark, d), "dx", "dz").select("pixel_id", "t", "k", (F.col("dx") + 0).alias("dx"), (F.col("dz") + 0).alias("dz"))


def _one(spark: SparkSession, d: str) -> DataFrame:
    """The sample with one shell, its arrays as columns."""
    rows = fx.sample_a(spark, d, depth=1)
    return materialise(rows.select("pixel_id", "ts", "t", "dy", "dyl", "l2", "l3", F.col("dx")[0].alias("dx"), F.col("dz")[0].alias("dz")))


def _fit(rows: DataFrame, orders: tuple[int, ...] = ()) -> estimation.Fit:
    return estimation.fit_2sls(rows, "dy", ["dyl", "dx"], ["l2", "dz"], 1, orders)


@query("SELECT pixel_id, ts, t, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in ("dy", "dyl", "l2", "l3", "dx", "dz")) + " FROM sample1")
def estimation_sample(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d).select("pixel_id", "ts", "t", *[(F.round(c, 6) + 0).alias(c) for c in ("dy", "dyl", "l2", "l3", "dx", "dz")])


_COLUMNS = ("dy", "dyl", "dx", "l2", "dz")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}), 2) AS value FROM sample1" for k, a in enumerate(_COLUMNS) for b in _COLUMNS[k:]))
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return estimation.gram(_one(spark, d), list(_COLUMNS)).select("a", "b", F.round("value", 2).alias("value"))


@query("SELECT 'alpha' AS term, 0 AS k, round(alpha, 6) AS estimate FROM solved UNION ALL SELECT 'beta', 1, round(beta, 6) FROM solved")
def fd2sls(spark: SparkSession, d: str) -> DataFrame:
    fit = _fit(_one(spark, d))
    rows = [("alpha", 0, float(fit.coef[0])), ("beta", 1, float(fit.coef[1]))]
    return spark.createDataFrame(rows, "term string, k int, estimate double").select("term", "k", *r6("estimate"))


@query("SELECT pixel_id, round(sum(z1 * e), 4) + 0 AS s1, round(sum(z2 * e), 4) + 0 AS s2 FROM resid GROUP BY 1")
def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d)
    fit = _fit(rows)
    centred = demean(rows, "dy", "dyl", "dx", "l2", "dz")
    e = F.col("dy") - float(fit.coef[0]) * F.col("dyl") - float(fit.coef[1]) * F.col("dx")
    return centred.groupBy("pixel_id").agg(*[(F.round(F.sum(F.col(z) * e), 4) + 0).alias(n) for z, n in (("l2", "s1"), ("dz", "s2"))])


_ERRORS = "scores AS (SELECT pixel_id, sum(z1 * e) s1, sum(z2 * e) s2 FROM resid GROUP BY 1), meat AS (SELECT count(*)::DOUBLE g, sum(s1 * s1) m11, sum(s1 * s2) m12, sum(s2 * s2) m22 FROM scores), inv AS (SELECT a22 / det i11, -a12 / det i12, -a21 / det i21, a11 / det i22, n FROM solved), errors AS (SELECT sqrt(f * (i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22)) se_alpha, sqrt(f * (i21 * i21 * m11 + 2 * i21 * i22 * m12 + i22 * i22 * m22)) se_beta FROM (SELECT *, g / (g - 1) * (n - 1) / (n - 2) f FROM inv, meat))"


@query("SELECT 'alpha' AS term, round(se_alpha, 6) AS se FROM errors UNION ALL SELECT 'beta', round(se_beta, 6) FROM errors", _ERRORS)
def cluster_se(spark: SparkSession, d: str) -> DataFrame:
    fit = _fit(_one(spark, d))
    return spark.createDataFrame([("alpha", float(fit.se[0])), ("beta", float(fit.se[1]))], "term string, se double").select("term", *r6("se"))


@query(
    "SELECT o.k::INTEGER AS lag_order, round(sum(coalesce(b.e, 0) * a.e), 2) + 0 AS d, count(b.e) AS pairs FROM resid a CROSS JOIN range(1, 3) o(k) LEFT JOIN resid b ON b.pixel_id = a.pixel_id AND b.t = a.t - o.k GROUP BY 1"
)
def ab_cross_products(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d)
    fit = _fit(rows)
    centred = demean(rows, "dy", "dyl", "dx")
    e = centred.select("pixel_id", "t", (F.col("dy") - float(fit.coef[0]) * F.col("dyl") - float(fit.coef[1]) * F.col("dx")).alias("e"))
    held = e.withColumns({f"e{k}": shift("e", k, ["pixel_id"]) for k in (1, 2)})
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("lag_order"), F.col(f"e{k}").alias("v")) for k in (1, 2)])).alias("l")
    return held.select("e", both).groupBy("l.lag_order").agg((F.round(F.sum(F.coalesce("l.v", F.lit(0.0)) * F.col("e")), 2) + 0).alias("d"), F.count("l.v").alias("pairs"))


_BINARY_1 = f"{cf.SAMPLED}, {cf.model('p', ['dyl', 'dx1'], ['l2', 'dz1'])}, {cf.errors('p', 2)}"
_SPLIT_1 = f"{cf.model('s', ['dyl', 'xc1', 'xm1'], ['l2', 'zc1', 'zm1'])}, {cf.errors('s', 3)}"
_BINARY_3 = f"{cf.SAMPLED}, {cf.model('p', ['dyl', 'dx1', 'dx2', 'dx3'], ['l2', 'dz1', 'dz2', 'dz3'])}, {cf.errors('p', 4)}"
_OVER_1 = f"{cf.SAMPLED}, {cf.model('over', ['dyl', 'dx1'], ['l2', 'l3', 'dz1'], 'l3')}, {cf.overidentified('over', 2, 3)}"


@query(" UNION ALL ".join(f"SELECT {k} AS k, round(f{k}, 4) AS f FROM pv" for k in range(4)), _BINARY_3)
def sw_f(spark: SparkSession, d: str) -> DataFrame:
    """The conditional F of each regressor, with three shells."""
    fit = estimation.fit_2sls(materialise(fx.sample_a(spark, d)), "dy", ["dyl", "dx"], ["l2", "dz"], fx.DEPTH, ())
    return spark.createDataFrame([(k, float(f)) for k, f in enumerate(fit.sw_f)], "k int, f double").select("k", F.round("f", 4).alias("f"))


#: With one shell the instruments are two, and their condition number a formula.
_CONDITION = "sqrt((w00 + w11 + sqrt((w00 - w11) ** 2 + 4 * w01 ** 2)) / (w00 + w11 - sqrt((w00 - w11) ** 2 + 4 * w01 ** 2)))"
_STATS = [(i, m, e) for i, t, p in (("binary", "pv", 2), ("composition", "sv", 3)) for m, e in (("n", f"n FROM {t}"), ("clusters", f"g FROM {t}"), ("min_sw_f", f"least({', '.join(f'f{k}' for k in range(p))}) FROM {t}"), ("ar1_m", f"t1 FROM {t}"), ("ar2_m", f"t2 FROM {t}"))]
_STATS.append(("binary", "cond_z", f"{_CONDITION} FROM pv"))


@query(" UNION ALL ".join(f"SELECT '{i}' AS instrument, '{m}' AS metric, round({e.split(' FROM ')[0]}, 4) AS value FROM {e.split(' FROM ')[1]}" for i, m, e in _STATS), f"{_BINARY_1}, {_SPLIT_1}")
def fit_stats(spark: SparkSession, d: str) -> DataFrame:
    """What stands beside the estimates of both instruments, with one shell."""
    rows = materialise(fx.sample_a(spark, d, depth=1))
    out = []
    for name, fit in zip(("binary", "composition"), estimation.fit_models(rows, 1), strict=True):
        stats = {"n": float(fit.n), "clusters": float(fit.clusters), "min_sw_f": float(min(fit.sw_f)), "ar1_m": fit.ar[1][0], "ar2_m": fit.ar[2][0]}
        out += [(name, k, v) for k, v in (stats | ({"cond_z": fit.cond_z} if name == "binary" else {})).items()]
    return spark.createDataFrame(out, "instrument string, metric string, value double").select("instrument", "metric", F.round("value", 4).alias("value"))


_J = {"J": "j", "df": "1", "p": cf.chi2_tail_1("j"), "n": "n", "n_dropped": "(SELECT count(*) FROM sampled) - n", "alpha": "b0", "sum_beta": "b1"}


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, round(({e})::DOUBLE, 6) + 0 AS value FROM overj" for m, e in _J.items()), _OVER_1)
def gmm_j(spark: SparkSession, d: str) -> DataFrame:
    """Two-step GMM with one more instrument, with one shell."""
    out = estimation.fit_overidentified(materialise(fx.sample_a(spark, d, depth=1)), 1)
    rows = [(k, float(out[k])) for k in _J] if out else []
    return spark.createDataFrame(rows, "metric string, value double").select("metric", (F.round("value", 6) + 0).alias("value"))


@query(" UNION ALL ".join(f"SELECT '{'beta' if k else 'alpha'}' AS term, {k} AS k, round(b{k}, 6) + 0 AS estimate, round(sqrt(v{k}{k}_), 6) + 0 AS se FROM pv" for k in range(4)), _BINARY_3)
def fd2sls_nations(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: (term, k, estimate, se) of the binary instrument on the
    nation by month panel, with three shells."""
    fit = estimation.fit_2sls(materialise(fx.sample_a(spark, d)), "dy", ["dyl", "dx"], ["l2", "dz"], fx.DEPTH, ())
    rows = [("alpha" if k == 0 else "beta", k, float(b), float(s)) for k, (b, s) in enumerate(zip(fit.coef, fit.se, strict=True))]
    return spark.createDataFrame(rows, "term string, k int, estimate double, se double").select("term", "k", *[(F.round(c, 6) + 0).alias(c) for c in ("estimate", "se")])


_NOTES = " UNION ALL ".join(f"SELECT '{name}' AS spec, count(*) AS n, count(*) FILTER (year(ts) <= 1995) AS n_base FROM finite_a" for name in ("paper-literal", "season-matched", "authors-346"))


@query(_NOTES, "finite_a AS (SELECT l.ts FROM lags l JOIN split s ON s.pixel_id = l.pixel_id AND s.t = l.t AND s.k = 1 WHERE dy IS NOT NULL AND dyl IS NOT NULL AND l2 IS NOT NULL)")
def base_year_counts(spark: SparkSession, d: str) -> DataFrame:
    """Finite rows, and those of the baseline's own year, of each specification."""
    counts = ch.base_year_counts(ch.finite_sample(fx.channels_a(spark, d, depth=1)), fx.BASE_YEAR)
    return counts.select(F.explode(F.array(*[F.lit(spec.name) for spec in ch.SPECS])).alias("spec"), "n", "n_base")


#: Two made-up profiles beside the published one.
_PROFILES = [(name, k, b * f ** (k - 1) - s, b) for name, f, s in (("steep", 0.8, 0.0), ("mixed", 1.0, 0.004), ("published", 1.0, 0.0)) for k, b in enumerate(report.PUBLISHED_BETA, 1)]
_VALUES = "profiles(name, k, beta, reference) AS (VALUES " + ", ".join(f"('{n}', {k}, {b!r}::DOUBLE, {r!r}::DOUBLE)" for n, k, b, r in _PROFILES) + ")"


def _profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PROFILES, "name string, k int, beta double, reference double")


@query(
    "SELECT name, round(sum(beta), 6) AS sum_beta, round(arg_min(beta, k) / sum(beta), 6) AS share_1, round(sum(beta) * sum(beta) / sum(beta * beta), 6) AS effective_lags, round(corr(beta, reference), 6) AS correlation, count(*) FILTER (beta > 0) AS positive FROM profiles GROUP BY 1",
    _VALUES,
)
def profile_shape(spark: SparkSession, d: str) -> DataFrame:
    out = estimation.profile_shape(_profiles(spark), ["name"])
    return out.select("name", *r6("sum_beta", "share_1", "effective_lags", "correlation"), "positive")


@query(
    "SELECT k, any_value(reference) AS paper_beta, " + ", ".join(f"max(CASE WHEN name = '{n}' THEN beta END) AS {n}__binary__beta, max(CASE WHEN name = '{n}' THEN beta / 2 END) AS {n}__binary__se" for n in ("mixed", "published", "steep")) + " FROM profiles GROUP BY k",
    _VALUES,
)
def coef_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = _profiles(spark).select(F.col("name").alias("spec"), F.lit("binary").alias("instrument"), "k", "beta", (F.col("beta") / 2).alias("se"), "reference")
    return report.wide_coefficients(rows)


@query(
    "SELECT 'beta' AS \"column\", round(max(abs(a.beta - b.beta)), 9) AS deviation, arg_max(a.k, abs(a.beta - b.beta))::VARCHAR AS at FROM profiles a JOIN profiles b USING (k) WHERE a.name = 'steep' AND b.name = 'published'",
    _VALUES,
)
def coef_diff(spark: SparkSession, d: str) -> DataFrame:
    side = lambda n: _profiles(spark).filter(F.col("name") == n).select("k", "beta")
    return report.deviations(side("steep"), side("published"), ["k"]).select("column", F.round("deviation", 9).alias("deviation"), "at")
