"""Tables of estimates: wide coefficients, a summary, LaTeX, and comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.estimation import profile_shape
from .estimate import Result

#: The published coefficients, to compare with.
PUBLISHED_BETA = (
    0.0811, 0.0391, 0.0262, 0.0197, 0.0152, 0.0100, 0.0076, 0.0093, 0.0091, 0.0058,
    0.0050, 0.0043, 0.0028, 0.0036, 0.0026, 0.0029, 0.0028, 0.0050, 0.0017, 0.0040,
)
PUBLISHED = {"alpha": 0.22, "omega_mean": 2.0, "omega_max": 2.64, "n": 3_300_494, "clusters": 9_539}

#: The rows of the table, their labels and digits.
ROWS = (
    ("beta_1", "β₁", 4), ("beta_2", "β₂", 4), ("sum_beta", "Σβ", 4), ("alpha", "α", 4), ("share_1", "share k=1", 3),
    ("effective_lags", "effective lags", 2), ("correlation", "correlation", 3), ("positive", "positive", 0), ("omega_mean", "Ω² mean", 3),
)


def long_coefficients(spark: SparkSession, results: Sequence[Result]) -> DataFrame:
    """(spec, instrument, k, beta, se, reference)."""
    rows = [(r.spec, r.instrument, k, b, s, PUBLISHED_BETA[k - 1] if k <= len(PUBLISHED_BETA) else None) for r in results for k, (b, s) in enumerate(zip(r.beta, r.beta_se, strict=True), 1)]
    return spark.createDataFrame(rows, "spec string, instrument string, k int, beta double, se double, reference double")


def wide_coefficients(coefficients: DataFrame) -> DataFrame:
    """A row for each k, columns <spec>__<instrument>__beta and __se."""
    named = coefficients.withColumn("name", F.concat_ws("__", "spec", "instrument"))
    wide = named.groupBy("k", F.col("reference").alias("paper_beta")).pivot("name").agg(F.first("beta").alias("_beta"), F.first("se").alias("_se"))
    return wide.select(*[F.col(f"`{c}`").alias(c.replace("___", "__")) for c in wide.columns]).orderBy("k")


def summary(spark: SparkSession, results: Sequence[Result]) -> dict[str, dict[str, float]]:
    """Column by column (spec / instrument, then published) the rows of ROWS."""
    shapes = {(r["spec"], r["instrument"]): r for r in profile_shape(long_coefficients(spark, results), ["spec", "instrument"]).collect()}
    out = {}
    for r in results:
        s = shapes[r.spec, r.instrument]
        out[f"{r.spec} / {r.instrument}"] = {"beta_1": r.beta[0], "beta_2": r.beta[1] if len(r.beta) > 1 else math.nan, "alpha": r.fit.alpha, "omega_mean": r.omega.get("mean", math.nan), **{k: s[k] for k in ("sum_beta", "share_1", "effective_lags", "correlation", "positive")}}
    b = PUBLISHED_BETA[: len(results[0].beta)] if results else PUBLISHED_BETA
    total = sum(b)
    out["published"] = {"beta_1": b[0], "beta_2": b[1] if len(b) > 1 else math.nan, "sum_beta": total, "alpha": PUBLISHED["alpha"], "share_1": b[0] / total, "effective_lags": total**2 / sum(x * x for x in b), "correlation": 1.0, "positive": sum(x > 0 for x in b), "omega_mean": PUBLISHED["omega_mean"]}
    return out


def _shown(value: float | None, digits: int, missing: str) -> str:
    return missing if value is None or not math.isfinite(value) else f"{value:,.{digits}f}"


def as_text(table: dict[str, dict[str, float]]) -> str:
    """Aligned columns, "-" where there is nothing."""
    rows = [["", *table], *[[label, *[_shown(c[key], digits, "-") for c in table.values()]] for key, label, digits in ROWS]]
    width = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    return "\n".join("  ".join([r[0].ljust(width[0]), *[x.rjust(w) for x, w in zip(r[1:], width[1:], strict=True)]]) for r in rows) + "\n"


def as_latex(table: dict[str, dict[str, float]], results: Sequence[Result], mode: str = "demo") -> str:
    """A booktabs table with caption and label, "--" where there is nothing."""
    lines = [f"% Made by a --{mode} run; needs the package booktabs.", r"\begin{table}[htbp]", r"\centering\small"]
    lines += [r"\caption{Estimates by specification and instrument, beside the published ones.}", rf"\label{{tab:estimates-{mode}}}"]
    lines += [rf"\begin{{tabular}}{{l{'r' * len(table)}}}", r"\toprule", " & ".join(["", *table]) + r" \\", r"\midrule"]
    lines += [" & ".join([f"${_TEX[key]}$" if key in _TEX else label, *[_shown(c[key], digits, "--") for c in table.values()]]) + r" \\" for key, label, digits in ROWS]
    lines += [r"\midrule", " & ".join(["observations", *[f"{r.fit.n:,}" for r in results], f"{PUBLISHED['n']:,}"]) + r" \\", r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    return "\n".join(lines) + "\n"


#: Labels that are formulas.
_TEX = {"beta_1": r"\beta_1", "beta_2": r"\beta_2", "sum_beta": r"\sum_k \beta_k", "alpha": r"\alpha", "omega_mean": r"\overline{\Omega^2}"}


def fit_lines(results: Sequence[Result]) -> str:
    """A line for each estimate, then one for each over-identified diagnostic."""
    lines = []
    for r in results:
        f = r.fit
        ar = ", ".join(f"AR({o}) m={m:+.2f} p={p:.3f}" for o, (m, p) in sorted(f.ar.items()))
        lines.append(f"{r.spec} / {r.instrument}: n={f.n:,}, clusters={f.clusters:,}, alpha={f.alpha:.4f} ({f.se[0]:.4f}), min SW F={min(f.sw_f):.4g}, cond(Z)={f.cond_z:.2f}, {ar}")
    lines += [f"{s}: {note}" for s, note in dict.fromkeys((r.spec, r.note) for r in results if r.note)]
    lines += [f"{r.spec} over-identified: n={o['n']:,}, dropped={o['n_dropped']:,}, J={o['J']:.4f} ({o['df']} df), p={o['p']:.4f}, alpha={o['alpha']:.4f}, sum={o['sum_beta']:.4f}" for r in results if (o := r.overidentified)]
    return "\n".join(lines) + "\n"


def deviations(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(column, deviation, at): the largest absolute difference of each shared
    column of two coefficient tables, and the key where it is."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    if not shared:
        raise ValueError("the two tables have no column in common")
    a = left.select(*keys, *[F.col(f"`{c}`").alias(f"l{k}") for k, c in enumerate(shared)])
    b = right.select(*keys, *[F.col(f"`{c}`").alias(f"r{k}") for k, c in enumerate(shared)])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(f"l{k}") - F.col(f"r{k}")).alias("d")) for k, c in enumerate(shared)])).alias("s")
    at = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    return a.join(b, keys).select(at.alias("at"), stacked).groupBy(F.col("s.column").alias("column")).agg(F.max("s.d").alias("deviation"), F.max_by("at", "s.d").alias("at"))
