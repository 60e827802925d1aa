"""Count and composition channels, their differences, and the estimation sample."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import finite
from . import panel


@dataclass(frozen=True)
class Spec:
    """A specification: which baseline, and whether its year leaves the sample."""

    name: str
    season: bool
    drop_base_year: bool

    def baseline(self, values: DataFrame) -> DataFrame:
        return panel.season_baseline(values) if self.season else panel.first_observation(values)


#: The three specifications by name.
SPECS = (Spec("paper-literal", False, False), Spec("season-matched", True, True), Spec("authors-346", True, False))


def channels(w: DataFrame, values: DataFrame, depth: int) -> DataFrame:
    """(pixel_id, t, n, m, m0): arrays over k = 1 to `depth` of the number of
    neighbours and the means of y and y0 over them, zeros where there are none.

    `w` is (t, i, j, k), `values` the spine (pixel_id, t, y, y0).  The shells of
    a row are aggregated together, so the edges are scanned and shuffled once."""
    held = values.select(F.col("pixel_id").alias("j"), "t", "y", "y0")
    joined = w.join(held, ["t", "j"], "left")
    own = lambda k, v: F.when(F.col("k") == k, v)
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ks = range(1, depth + 1)
    sums = joined.groupBy("t", "i").agg(
        F.array(*[F.count(own(k, F.lit(1))).cast("double") for k in ks]).alias("n"),
        F.array(*[F.coalesce(F.avg(own(k, value("y"))), F.lit(0.0)) for k in ks]).alias("m"),
        F.array(*[F.coalesce(F.avg(own(k, value("y0"))), F.lit(0.0)) for k in ks]).alias("m0"),
    )
    zeros = F.array_repeat(F.lit(0.0), depth)
    rows = values.join(sums.withColumnRenamed("i", "pixel_id"), ["pixel_id", "t"], "left")
    return rows.withColumns({c: F.coalesce(c, zeros) for c in ("n", "m", "m0")})


def differences(rows: DataFrame) -> DataFrame:
    """`rows` with the changes of n*m and n*m0 (dx, dz), and each split exactly
    into a part of changing counts and one of changing composition (xc, xm, zc, zm)."""
    w = Window.partitionBy("pixel_id").orderBy("t")
    before = {f"__{c}": F.lag(c).over(w) for c in ("n", "m", "m0")}
    pick = lambda f: F.transform(F.arrays_zip("n", "m", "m0", "__n", "__m", "__m0"), f)
    new = {
        "dx": lambda r: r["n"] * r["m"] - r["__n"] * r["__m"],
        "dz": lambda r: r["n"] * r["m0"] - r["__n"] * r["__m0"],
        "xc": lambda r: (r["n"] - r["__n"]) * (r["m"] + r["__m"]) / 2,
        "xm": lambda r: (r["m"] - r["__m"]) * (r["n"] + r["__n"]) / 2,
        "zc": lambda r: (r["n"] - r["__n"]) * (r["m0"] + r["__m0"]) / 2,
        "zm": lambda r: (r["m0"] - r["__m0"]) * (r["n"] + r["__n"]) / 2,
    }
    held = rows.withColumns(before)
    absent = F.col("__n").isNull()
    return held.withColumns({c: F.when(~absent, pick(f)) for c, f in new.items()}).drop(*before)


def identity_error(rows: DataFrame) -> DataFrame:
    """The largest failure of xc + xm = dx and zc + zm = dz."""
    gap = lambda a, b, c: F.max(F.array_max(F.transform(F.arrays_zip(a, b, c), lambda r: F.abs(r[a] + r[b] - r[c]))))
    return rows.agg(gap("xc", "xm", "dx").alias("error_x"), gap("zc", "zm", "dz").alias("error_z"))


_SAMPLE = ("pixel_id", "ts", "t", "dy", "dyl", "l2", "l3", "dx", "dz", "xc", "xm", "zc", "zm")


def finite_sample(rows: DataFrame) -> DataFrame:
    """Differences and lags of y with the differenced channels, finite rows only.
    l3 may be missing; it is for the diagnostic only."""
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, finite)
    arrays = functools.reduce(lambda a, b: a & b, [whole(c) for c in ("dx", "dz", "xc", "xm", "zc", "zm")])
    return panel.finite_rows(panel.panel_lags(differences(rows)), "dy", "dyl", "l2").filter(arrays).select(*_SAMPLE)


def leaves_base_year(spec: Spec, presample: bool = False) -> bool:
    return spec.season and spec.drop_base_year and not presample


def sample(rows: DataFrame, spec: Spec, base_year: int | None, presample: bool = False) -> DataFrame:
    """The estimation sample: finite rows, and, where the baseline is of a year in
    the sample, only later years if the specification says so."""
    out = finite_sample(rows)
    return panel.after_base_year(out, base_year) if leaves_base_year(spec, presample) else out


def base_year_counts(finite: DataFrame, base_year: int) -> DataFrame:
    """(n, n_base): finite rows, and those of the baseline's own year, on which the
    excluded instrument is the endogenous regressor."""
    return finite.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.year("ts") <= base_year).alias("n_base"))


def base_year_note(spec: Spec, base_year: int, n: int, n_base: int, presample: bool = False) -> str:
    """What becomes of the baseline's year, in words; empty where there is none."""
    if not spec.season:
        return ""
    if presample:
        return "baseline from before the sample: no rows overlap, none leave"
    share = f"{n_base:,} of {n:,} rows ({n_base / max(n, 1):.2%})"
    return f"baseline year {base_year} left out: {share}" if spec.drop_base_year else f"baseline year {base_year} retained: {share}"


def panel_channels(w: DataFrame, values: DataFrame, baseline: DataFrame, depth: int) -> DataFrame:
    """Channels of a spine (pixel_id, ts, t, y) under a baseline (pixel_id, month, y0)."""
    return channels(w, panel.with_baseline(values, baseline), depth)


