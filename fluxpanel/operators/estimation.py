"""Two-stage least squares on differences, as distributed aggregates.

Several models on one table share two passes.  In the first, the rows of all
their columns are factored block by block (Householder QR in numpy), the
triangular factors again in groups, and the last few on the driver: the factor of
the whole table, with the accuracy of QR and never a cross product.  The factor
of any columns follows from it, and with it all estimates, the conditional F,
the condition number and, from the constant, means and the number of rows.  The
second pass walks the rows unit by unit in blocks of arrays, and sums up by unit the
scores that clustered errors, the serial correlation test and two-step GMM are made
of."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import chi2_tail, normal_tail

#: Groups in which the factors of partitions meet before the driver.
GROUPS = 16


def columns_of(df: DataFrame, names: list[str], depth: int) -> list[Column]:
    """Columns by name, arrays one column an element."""
    out = []
    for n in names:
        kind = df.schema[n].dataType.typeName()
        out += [F.col(n)[k] for k in range(depth)] if kind == "array" else [F.col(n)]
    return [c.cast("double") for c in out]


def _reduced(blocks, width: int):
    """The triangular factor of a stream of blocks of rows."""
    held = np.zeros((0, width))
    for block in blocks:
        held = np.linalg.qr(np.vstack([held, block]), mode="r")
    return held


def _square(r: np.ndarray) -> np.ndarray:
    return np.vstack([r, np.zeros((max(0, r.shape[1] - len(r)), r.shape[1]))])


def _sent(which: int, part: int, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([part], pa.int32()), pa.array([value.tobytes()], pa.binary())], ["which", "part", "value"])


_SENT = "which int, part int, value binary"


def triangular_factors(df: DataFrame, columns: list[Column], needs: list[int | None]) -> list[np.ndarray]:
    """R of the QR factorisation of the columns: for each of `needs`, of the rows
    in which the column of that index is there (None: of all rows).  Other
    missing values count as 0.  One pass serves all."""
    width = len(columns)

    def matrix(batch) -> np.ndarray:
        return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float, copy=False)

    def local(batches) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, width)) for _ in needs]
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch)
                for k, need in enumerate(needs):
                    own = rows if need is None else rows[np.isfinite(rows[:, need])]
                    held[k] = np.linalg.qr(np.vstack([held[k], np.nan_to_num(own, nan=0.0)]), mode="r")
        for k, r in enumerate(held):
            if len(r):
                yield _sent(k, TaskContext.get().partitionId() % GROUPS, r)

    def joint(batches) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                met[k] = np.linalg.qr(np.vstack([met.get(k, np.zeros((0, width))), np.frombuffer(v, np.float64).reshape(-1, width)]), mode="r")
        for k, r in met.items():
            yield _sent(k, 0, r)

    rows = df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)])
    parts = rows.mapInArrow(local, _SENT).repartition("part").mapInArrow(joint, _SENT).collect()
    return [_square(_reduced((np.frombuffer(p["value"], np.float64).reshape(-1, width) for p in parts if p["which"] == k), width)) for k in range(len(needs))]


def triangular_factor(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """R of the QR factorisation of the given columns of all rows."""
    return triangular_factors(df, columns, [None])[0]


@dataclass(frozen=True)
class _Scored:
    """What the second pass knows of a model: the places of its instruments, regressors
    and y among the columns, their means, the coefficients, the orders of the serial
    correlation test and the place of a column that must be there."""

    z: list[int]
    x: list[int]
    y: int
    means: np.ndarray
    coef: np.ndarray
    orders: tuple[int, ...]
    need: int | None

    @property
    def width(self) -> int:
        return 1 + len(self.z) + len(self.orders) * (1 + len(self.x))


def _scores(models: list[_Scored], unit: np.ndarray, t: np.ndarray, rows: np.ndarray, seen: int) -> np.ndarray:
    """A row of scores for each of the rows from `seen` on; those before are of the unit
    that goes on, and serve as earlier periods only.  Rows are in the order of unit and
    period.  The scores of a model: whether the row counts, each instrument times the
    residual, and for each order the earlier residual times the residual and the
    regressors."""
    start = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    number = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(unit))))
    span = int(t.max()) - int(t.min()) + 1 if len(t) else 1
    least = int(t.min()) if len(t) else 0
    reach = max((o for m in models for o in m.orders), default=0)
    key = number * (span + reach) + (t - least) + reach
    earlier = {}
    for o in {o for m in models for o in m.orders}:
        at = np.minimum(np.searchsorted(key, key - o), len(key) - 1)
        earlier[o] = np.where((key[at] == key - o) & (t - least >= o), at, -1)
    out = []
    for m in models:
        centred = np.nan_to_num(rows[:, [*m.z, *m.x, m.y]] - m.means)
        z, x, y = centred[:, : len(m.z)], centred[:, len(m.z) : -1], centred[:, -1]
        counts = np.isfinite(rows[:, m.need]) if m.need is not None else np.ones(len(rows), bool)
        e = np.where(counts, y - x @ m.coef, 0.0)
        out += [counts[:, None].astype(float), z * e[:, None]]
        for o in m.orders:
            lag = np.where(earlier[o] >= 0, e[earlier[o]], 0.0)
            out += [(lag * e)[:, None], x * lag[:, None]]
    return np.hstack(out)[seen:]


def _score_products(df: DataFrame, columns: list[Column], models: list[_Scored]) -> np.ndarray:
    """Sums over the units of products of all pairs of [1 | scores of the unit].

    Rows are dealt by unit and sorted by period; each task walks its units in blocks of
    arrays, carries the sums and the last periods of a unit over the edge of a block, and
    sends one matrix.  So no unit is held, however long, and no coefficient is an
    expression of the plan."""
    width = 1 + sum(m.width for m in models)
    counted = np.cumsum([0] + [m.width for m in models])[:-1]
    reach, n_columns = max((o for m in models for o in m.orders), default=0), len(columns)

    def local(batches) -> Iterator[pa.RecordBatch]:
        total, held, last = np.zeros((width, width)), np.zeros(width - 1), None
        tail = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, n_columns)))

        def finish(sums: np.ndarray) -> None:
            nonlocal total
            sums[:, counted] = sums[:, counted] > 0
            sums = np.column_stack([np.ones(len(sums)), sums])
            total += sums.T @ sums

        for batch in batches:
            if not batch.num_rows:
                continue
            unit, t = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]).astype(float, copy=False)
            if last is not None and last != unit[0]:
                finish(held[None].copy())
                held, tail = np.zeros(width - 1), tuple(v[:0] for v in tail)
            seen = len(tail[0])
            unit, t, rows = (np.concatenate((a, b)) for a, b in zip(tail, (unit, t, rows), strict=True))
            scores = _scores(models, unit, t, rows, seen)
            own = unit[seen:]
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sums = np.add.reduceat(scores, start, axis=0)
            sums[0] += held
            finish(sums[:-1])
            held, last = sums[-1], own[-1]
            going = (unit == last) & (t > t[-1] - reach) if reach else np.zeros(len(unit), bool)
            tail = unit[going], t[going], rows[going]
        if last is not None:
            finish(held[None].copy())
        yield _sent(0, TaskContext.get().partitionId() % GROUPS, total)

    def joint(batches) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(v, np.float64) for batch in batches for v in batch.column(2).to_pylist()]
        if found:
            yield _sent(0, 0, sum(found))

    rows = df.select("pixel_id", "t", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).repartition("pixel_id").sortWithinPartitions("pixel_id", "t")
    parts = rows.mapInArrow(local, _SENT).repartition("part").mapInArrow(joint, _SENT).collect()
    return sum((np.frombuffer(p["value"], np.float64).reshape(width, width) for p in parts), np.zeros((width, width)))


@dataclass
class Fit:
    """An estimate.  `extra` holds what the tests after it need."""

    coef: np.ndarray
    se: np.ndarray
    n: int
    clusters: int
    sw_f: np.ndarray
    cond_z: float
    ar: dict[int, tuple[float, float]] = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    @property
    def alpha(self) -> float:
        return float(self.coef[0])


def _solve(r: np.ndarray, q: int, p: int, n: int) -> dict:
    """From R of [1 | Z | X | y]: second stage by SVD with a rank cutoff, the
    conditional F of each regressor and the condition number of Z."""
    s = r[1:, 1:]
    zz, zx, zy, xx = s[:q, :q], s[:q, q : q + p], s[:q, q + p], s[q:, q : q + p]
    u, d, vt = np.linalg.svd(zx, full_matrices=False)
    keep = d > (d[0] if len(d) else 0) * max(n, p) * np.finfo(float).eps
    inv = np.where(keep, 1 / np.where(keep, d, 1), 0)
    coef = vt.T @ (inv * (u.T @ zy))
    bread = (vt.T * inv**2) @ vt
    f = np.full(p, np.nan)
    for j in range(p):
        slope = -bread[:, j] / bread[j, j]
        slope[j] = 1.0
        free = float(np.sum((xx @ slope) ** 2))
        held = float(np.sum((zx @ slope) ** 2))
        f[j] = held / max(q - p + 1, 1) / max(free / max(n - q - 1, 1), 1e-300)
    sv = np.linalg.svd(zz, compute_uv=False)
    first = np.linalg.lstsq(zz, zx, rcond=None)[0]
    return {"coef": coef, "bread": bread, "sw_f": f, "cond": float(sv[0] / max(sv[-1], 1e-300)), "first": first, "zz": zz, "zx": zx, "zy": zy}


@dataclass(frozen=True)
class Model:
    """Regressors and instruments by name, the orders of the serial correlation
    test, and a column that must be there for a row to count."""

    x: tuple[str, ...]
    z: tuple[str, ...]
    orders: tuple[int, ...] = (1, 2)
    need: str | None = None


def fit_many(df: DataFrame, y: str, models: list[Model], depth: int) -> list[Fit]:
    """Two-stage least squares of y on each model's x with its z, a constant
    partialled out, errors clustered by pixel_id, and the serial correlation
    test of the differenced residual.  Two passes over `df` serve all models."""
    names = list(dict.fromkeys(n for m in models for n in (*m.z, *m.x)))
    parts = {n: columns_of(df, [n], depth) for n in names}
    columns, place = [F.lit(1.0)], {}
    for n in names:
        place[n] = list(range(len(columns), len(columns) + len(parts[n])))
        columns += parts[n]
    columns.append(F.col(y).cast("double"))
    last = len(columns) - 1
    needs = list(dict.fromkeys(m.need for m in models))
    factors = dict(zip(needs, triangular_factors(df, columns, [place[n][0] if n else None for n in needs]), strict=True))

    fits, scored = [], []
    for m in models:
        zi, xi = ([i for n in group for i in place[n]] for group in (m.z, m.x))
        q, p = len(zi), len(xi)
        r = _square(np.linalg.qr(factors[m.need][:, [0, *zi, *xi, last]], mode="r"))
        # The first row holds the means, up to its corner, whose square counts the rows.
        n, means = round(r[0, 0] ** 2), r[0, 1:] / (r[0, 0] or 1.0)
        fits.append((n, q, p, _solve(r, q, p, n)))
        scored.append(_Scored(zi, xi, last, means, fits[-1][3]["coef"], m.orders, place[m.need][0] if m.need else None))
    total, at, begin = _score_products(df, columns, scored), {}, 1
    for k, m in enumerate(scored):
        q, p = len(m.z), len(m.x)
        at |= {f"g{k}": begin} | {f"s{k}_{i}": begin + 1 + i for i in range(q)}
        for o, order in enumerate(m.orders):
            first = begin + 1 + q + o * (1 + p)
            at |= {f"a{k}_{order}": first} | {f"c{k}_{order}_{i}": first + 1 + i for i in range(p)}
        begin += m.width

    out = []
    for k, (m, (n, q, p, solved)) in enumerate(zip(models, fits, strict=True)):
        bread, first = solved["bread"], solved["first"]
        s = [at[f"s{k}_{i}"] for i in range(q)]
        g, meat = round(total[0, at[f"g{k}"]]), total[np.ix_(s, s)]
        small = g / max(g - 1, 1) * (n - 1) / max(n - p, 1)
        vcov = small * bread @ first.T @ meat @ first @ bread
        fit = Fit(solved["coef"], np.sqrt(np.maximum(np.diag(vcov), 0)), n, g, solved["sw_f"], solved["cond"], extra=solved | {"meat": meat})
        for o in m.orders:
            a = at[f"a{k}_{o}"]
            c = total[0, [at[f"c{k}_{o}_{i}"] for i in range(p)]]
            v = total[a, a] - 2 * c @ bread @ (first.T @ total[a, s]) + c @ vcov @ c
            stat = total[0, a] / np.sqrt(v) if np.isfinite(v) and v > 0 else np.nan
            fit.ar[o] = (float(stat), 2 * normal_tail(abs(stat)) if stat == stat else np.nan)
        out.append(fit)
    return out


def fit_2sls(df: DataFrame, y: str, x: list[str], z: list[str], depth: int, orders: tuple[int, ...] = (1, 2)) -> Fit:
    """One model on all rows."""
    return fit_many(df, y, [Model(tuple(x), tuple(z), orders)], depth)[0]


def gmm_of(first: Fit) -> dict:
    """Two-step GMM with clustered weights and Hansen's J, from a first step;
    with as many regressors as instruments there is nothing to test and p is NaN."""
    e = first.extra
    weight = np.linalg.pinv(e["meat"])
    zx, zy = e["zz"].T @ e["zx"], e["zz"].T @ e["zy"]
    coef = np.linalg.solve(zx.T @ weight @ zx, zx.T @ weight @ zy)
    g = zy - zx @ coef
    j, df_j = float(g @ weight @ g), zx.shape[0] - zx.shape[1]
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(zx.T @ weight @ zx)), 0))
    return {"coef": coef, "se": se, "J": j, "df": df_j, "p": chi2_tail(j, df_j) if df_j > 0 else float("nan"), "n": first.n}


def fit_gmm(df: DataFrame, y: str, x: list[str], z: list[str], depth: int) -> dict:
    return gmm_of(fit_2sls(df, y, x, z, depth, ()))


#: The binary and the composition instrument, and the diagnostic with one more
#: instrument, on the rows that have it.
BINARY, SPLIT = Model(("dyl", "dx"), ("l2", "dz")), Model(("dyl", "xc", "xm"), ("l2", "zc", "zm"))
OVER = Model(("dyl", "dx"), ("l2", "l3", "dz"), (), "l3")


def _diagnosed(first: Fit, n: int, least: int) -> dict | None:
    if first.n < least:
        return None
    out = gmm_of(first)
    return out | {"n_dropped": n - first.n, "alpha": float(out["coef"][0]), "sum_beta": float(out["coef"][1:].sum())}


def fit_models(rows: DataFrame, depth: int) -> tuple[Fit, Fit]:
    """The binary and the composition instrument on one sample; of the second,
    the coefficients are alpha, the count block, the composition block."""
    binary, split = fit_many(rows, "dy", [BINARY, SPLIT], depth)
    return binary, split


def fit_overidentified(rows: DataFrame, depth: int, least: int = 100) -> dict | None:
    """The diagnostic; None with fewer than `least` rows that have l3."""
    binary, over = fit_many(rows, "dy", [Model(BINARY.x, BINARY.z, ()), OVER], depth)
    return _diagnosed(over, binary.n, least)


def fit_specification(rows: DataFrame, depth: int, least: int = 100) -> tuple[Fit, Fit, dict | None]:
    """Both instruments and the diagnostic, in two passes over the sample."""
    binary, split, over = fit_many(rows, "dy", [BINARY, SPLIT, OVER], depth)
    return binary, split, _diagnosed(over, binary.n, least)


def profile_shape(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Of coefficients (keys, k, beta, reference): the share of the first lag in
    the sum (null if the sum is 0), effective lags, correlation with the
    reference profile, and how many are positive."""
    total, squares = F.sum("beta"), F.sum(F.col("beta") * F.col("beta"))
    first = F.min_by("beta", "k")
    zero = F.abs(total) <= 1e-12
    return profile.groupBy(*keys).agg(
        total.alias("sum_beta"), F.when(~zero, F.try_divide(first, total)).alias("share_1"), F.try_divide(total * total, squares).alias("effective_lags"),
        F.when(F.count(F.lit(1)) > 1, F.corr("beta", "reference")).alias("correlation"), F.count_if(F.col("beta") > 0).alias("positive"),
    )


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, value): sums of products of every pair of columns, one aggregate."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    total = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("value")) for a, b in pairs]))
    return total.select(rows.alias("r")).select("r.*")
