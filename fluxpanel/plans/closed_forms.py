"""SQL of estimators that have closed forms: linear systems of two to four
unknowns, solved by cofactors.  It serves the comparison with DuckDB only."""

from __future__ import annotations

from itertools import product

Matrix = list[list[str]]


def named(name: str, rows: int, cols: int | None = None) -> Matrix:
    return [[f"{name}{i}{j}" for j in range(cols or rows)] for i in range(rows)]


def symmetric(name: str, size: int) -> Matrix:
    return [[f"{name}{min(i, j)}{max(i, j)}" for j in range(size)] for i in range(size)]


def determinant(m: Matrix) -> str:
    if len(m) == 1:
        return m[0][0]
    minors = ((-1) ** j * 1 for j in range(len(m)))
    return "(" + " ".join(f"{'+' if s > 0 else '-'} {m[0][j]} * {determinant([r[:j] + r[j + 1 :] for r in m[1:]])}" for j, s in enumerate(minors)) + ")"


def inverse(m: Matrix) -> Matrix:
    det = determinant(m)
    minor = lambda i, j: determinant([r[:j] + r[j + 1 :] for k, r in enumerate(m) if k != i]) if len(m) > 1 else "1"
    return [[f"({'-' if (i + j) % 2 else ''}{minor(j, i)} / {det})" for j in range(len(m))] for i in range(len(m))]


def times(a: Matrix, b: Matrix) -> Matrix:
    return [["(" + " + ".join(f"{a[i][k]} * {b[k][j]}" for k in range(len(b))) + ")" for j in range(len(b[0]))] for i in range(len(a))]


def turned(m: Matrix) -> Matrix:
    return [list(c) for c in zip(*m, strict=True)]


def select(columns: dict[str, str], table: str, keep: str = "*") -> str:
    return f"SELECT {keep}, " + ", ".join(f"{v} AS {n}" for n, v in columns.items()) + f" FROM {table}"


def cells(name: str, m: Matrix) -> dict[str, str]:
    return {f"{name}{i}{j}": v for (i, row) in enumerate(m) for j, v in enumerate(row)}


#: The sample with the differenced channels of three shells as columns.
SAMPLED = (
    "wide AS (SELECT pixel_id, t, " + ", ".join(f"max({c}) FILTER (WHERE k = {k}) AS {c}{k}" for c, k in product(("dx", "dz", "xc", "xm", "zc", "zm"), (1, 2, 3))) + " FROM split GROUP BY 1, 2), "
    "sampled AS (SELECT l.ts, l.dy, l.dyl, l.l2, l.l3, w.* FROM lags l JOIN wide w ON w.pixel_id = l.pixel_id AND w.t = l.t WHERE dy IS NOT NULL AND dyl IS NOT NULL AND l2 IS NOT NULL AND year(l.ts) > 1995)"
)


def model(tag: str, x: list[str], z: list[str], need: str | None = None) -> str:
    """Common table expressions of one model: {tag}c (centred rows), {tag}g (sums
    of products), {tag}b (coefficients b0..), {tag}e (residuals), {tag}u (sums by
    unit), {tag}m (their products and what clustered errors need)."""
    p, q = len(x), len(z)
    mean = lambda c, n: f"{c} - avg({c}) OVER () AS {n}"
    rows = ", ".join([mean("dy", "y"), *[mean(c, f"x{k}") for k, c in enumerate(x)], *[mean(c, f"z{k}") for k, c in enumerate(z)]])
    sums = {f"a{i}{j}": f"sum(z{i} * x{j})" for i in range(q) for j in range(p)}
    sums |= {f"w{i}{j}": f"sum(z{i} * z{j})" for i in range(q) for j in range(i, q)} | {f"v{i}{j}": f"sum(x{i} * x{j})" for i in range(p) for j in range(i, p)}
    sums |= {f"r{i}": f"sum(z{i} * y)" for i in range(q)}
    a, r = named("a", q, p), [[f"r{i}"] for i in range(q)]
    parts = [f"{tag}c AS (SELECT pixel_id, t, {rows} FROM sampled{f' WHERE {need} IS NOT NULL' if need else ''})", f"{tag}g AS ({select(sums, f'{tag}c', 'count(*)::DOUBLE AS n')})"]
    if p == q:
        parts.append(f"{tag}i AS ({select(cells('i', inverse(a)), f'{tag}g')})")
        solution = times(named("i", p), r)
    else:
        parts.append(f"{tag}h AS ({select(cells('h', inverse(symmetric('w', q))), f'{tag}g')})")
        parts.append(f"{tag}k AS ({select(cells('k', times(turned(a), named('h', q))), f'{tag}h')})")
        parts.append(f"{tag}l AS ({select(cells('m', times(named('k', p, q), a)) | cells('s', times(named('k', p, q), r)), f'{tag}k')})")
        parts.append(f"{tag}i AS ({select(cells('i', inverse(named('m', p))), f'{tag}l')})")
        solution = times(named("i", p), named("s", p, 1))
    parts.append(f"{tag}b AS ({select({f'b{j}': solution[j][0] for j in range(p)}, f'{tag}i')})")
    parts.append(f"{tag}e AS (SELECT c.*, c.y - (" + " + ".join(f"b.b{j} * c.x{j}" for j in range(p)) + f") AS e FROM {tag}c c, {tag}b b)")
    parts.append(f"{tag}f AS (SELECT a.*, coalesce(p1.e, 0) AS e1, coalesce(p2.e, 0) AS e2 FROM {tag}e a LEFT JOIN {tag}e p1 ON p1.pixel_id = a.pixel_id AND p1.t = a.t - 1 LEFT JOIN {tag}e p2 ON p2.pixel_id = a.pixel_id AND p2.t = a.t - 2)")
    own = {f"s{i}": f"sum(z{i} * e)" for i in range(q)} | {f"a{o}": f"sum(e{o} * e)" for o in (1, 2)} | {f"c{o}{j}": f"sum(e{o} * x{j})" for o in (1, 2) for j in range(p)}
    parts.append(f"{tag}u AS ({select(own, f'{tag}f', 'pixel_id')} GROUP BY 1)")
    total = {f"m{i}{j}": f"sum(s{i} * s{j})" for i in range(q) for j in range(i, q)} | {f"d{o}": f"sum(a{o})" for o in (1, 2)} | {f"aa{o}": f"sum(a{o} * a{o})" for o in (1, 2)}
    total |= {f"as{o}{i}": f"sum(a{o} * s{i})" for o in (1, 2) for i in range(q)} | {f"c{o}{j}": f"sum(c{o}{j})" for o in (1, 2) for j in range(p)}
    parts.append(f"{tag}m AS ({select(total, f'{tag}u', 'count(*)::DOUBLE AS g')})")
    return ", ".join(parts)


def errors(tag: str, p: int) -> str:
    """{tag}v: with p instruments for p regressors, the clustered covariance v00..,
    conditional F f0.. and the tests t1 and t2, beside the coefficients."""
    meat, inv = symmetric("m.m", p), [[f"b.i{i}{j}" for j in range(p)] for i in range(p)]
    w, v = symmetric("b.w", p), symmetric("b.v", p)
    spread = times(times(inv, meat), turned(inv))
    bread = times(times(inv, w), turned(inv))
    first = f"{tag}w AS (SELECT b.*, m.* EXCLUDE ({', '.join(f'm{i}{j}' for i in range(p) for j in range(i, p))}), g / (g - 1) * (n - 1) / (n - {p}) AS small, " + ", ".join(f"{e} AS {n}" for n, e in (cells("o", spread) | cells("q", bread)).items()) + f" FROM {tag}b b, {tag}m m)"
    fitted = inverse(named("q", p))
    second = f"{tag}y AS ({select(cells('j', fitted), f'{tag}w')})"
    out = {}
    for k in range(p):
        slope = [["1.0" if i == k else f"(-q{i}{k} / q{k}{k})"] for i in range(p)]
        held = times(times(turned(slope), named("j", p)), slope)[0][0]
        whole = times(times(turned(slope), symmetric("v", p)), slope)[0][0]
        out[f"f{k}"] = f"{held} / (({whole} - {held}) / (n - {p} - 1))"
    for o in (1, 2):
        moved = times([[f"c{o}{j}" for j in range(p)]], times(named("i", p), [[f"as{o}{i}"] for i in range(p)]))[0][0]
        again = times(times([[f"c{o}{j}" for j in range(p)]], named("o", p)), [[f"c{o}{j}"] for j in range(p)])[0][0]
        out[f"t{o}"] = f"d{o} / sqrt(aa{o} - 2 * {moved} + small * {again})"
    del v
    return f"{first}, {second}, {tag}v AS ({select(out | {f'v{k}{k}_': f'small * o{k}{k}' for k in range(p)}, f'{tag}y')})"


def overidentified(tag: str, p: int, q: int) -> str:
    """{tag}j: two-step coefficients b0.. and Hansen's J, weighted by the first
    step's residuals."""
    weight = inverse(symmetric("m", q))
    first = f"{tag}p AS (SELECT g.*, m.g AS units, {', '.join(f'{e} AS {n}' for n, e in cells('h', weight).items())} FROM {tag}g g, {tag}m m)"
    a, r, h = named("a", q, p), [[f"r{i}"] for i in range(q)], named("h", q)
    second = f"{tag}q AS ({select(cells('k', times(turned(a), h)), f'{tag}p')})"
    third = f"{tag}r AS ({select(cells('l', times(named('k', p, q), a)) | cells('s', times(named('k', p, q), r)), f'{tag}q')})"
    solved = times(inverse(named("l", p)), named("s", p, 1))
    fourth = f"{tag}s AS ({select({f'b{j}': solved[j][0] for j in range(p)}, f'{tag}r')})"
    gap = [["(r%d - (%s))" % (i, " + ".join(f"a{i}{j} * b{j}" for j in range(p)))] for i in range(q)]
    fifth = f"{tag}t AS ({select({f'g{i}': gap[i][0] for i in range(q)}, f'{tag}s')})"
    g = [[f"g{i}"] for i in range(q)]
    return f"{first}, {second}, {third}, {fourth}, {fifth}, {tag}j AS ({select({'j': times(times(turned(g), h), g)[0][0]}, f'{tag}t')})"


def chi2_tail_1(value: str) -> str:
    """The upper tail of chi-squared with one degree of freedom: one minus the
    error function, by a series of positive terms."""
    term = "exp(-v / 2 + k * ln(2) + (2 * k + 1) * ln(sqrt(v / 2)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))"
    return f"(SELECT 1 - 2 / sqrt(pi()) * sum({term}) FROM (SELECT {value} AS v), range(0, 400) s(k))"
