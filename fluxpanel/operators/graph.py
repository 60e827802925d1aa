"""Directed graphs as edge tables: (i, j), or (ts, i, j) month by month.

An edge is a row; its presence is its weight.  Row i receives from column j."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, materialise, small_side


def binarize(entries: DataFrame, value: str = "v", keys: list[str] | None = None) -> DataFrame:
    """Edges from weighted entries: zeros go first, then repeats collapse, and loops go."""
    keys = keys or []
    return entries.filter((F.col(value) != 0) & (F.col("i") != F.col("j"))).select(*keys, "i", "j").distinct()


#: Links up to which a graph is sent to the tasks that search it.
LOCAL_LINKS = 4_000_000

#: Pairs that a task holds at a time, about.
LOCAL_PAIRS = 1 << 20


def _searched(edges: DataFrame, depth: int) -> DataFrame:
    """(i, j, k) by breadth-first searches, each within a task: the sources are
    dealt to tasks, the links, 16 bytes each and so 64 MB at most, are with all of them."""
    import numpy as np
    import pyarrow as pa

    spark = edges.sparkSession
    table = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).toArrow()
    i, j = (table.column(c).to_numpy() for c in ("i", "j"))
    ids, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    order = np.argsort(place[: len(i)], kind="stable")
    ends, first = place[len(i) :][order], np.searchsorted(place[: len(i)][order], np.arange(len(ids) + 1))
    shipped = spark.sparkContext.broadcast((ids, ends, first))

    def search(batches):
        ids, ends, first = shipped.value
        n = len(ids)
        for batch in batches:
            mine = batch.column(0).to_numpy()
            mine = mine[first[mine + 1] > first[mine]]
            at, step = 0, max(1, LOCAL_PAIRS // (8 * depth * depth))
            while at < len(mine):
                own = mine[at : at + step]
                at += step
                front = reached = np.sort(own * n + own)
                for k in range(1, depth + 1):
                    node = front % n
                    size = first[node + 1] - first[node]
                    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    ahead = np.unique(np.repeat(front - node, size) + ends[np.repeat(first[node], size) + inner])
                    spot = np.minimum(np.searchsorted(reached, ahead), len(reached) - 1)
                    front = ahead[reached[spot] != ahead]
                    if not len(front):
                        break
                    reached = np.union1d(reached, front)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[front // n]), pa.array(ids[front % n]), pa.array(np.full(len(front), k, np.int32))], ["i", "j", "k"])

    return spark.range(len(ids)).mapInArrow(search, "i long, j long, k int")


def shells(adjacency: DataFrame, depth: int) -> DataFrame:
    """(i, j, k): pairs at graph distance exactly k = 1 to `depth`.

    A graph of at most LOCAL_LINKS links goes to the tasks, which search from
    their own sources and shuffle nothing.  Beyond that the frontier of all
    sources steps along the graph by joins and loses what was reached before: in
    a symmetric graph only the two last shells can be met again.  Shells are
    written, so the lineage stays one step long; an empty frontier ends the
    search."""
    g = materialise(adjacency.filter("i <> j").select("i", "j").distinct())
    if g.count() <= LOCAL_LINKS:
        out = _searched(g, depth)
        discard(g)
        return out
    step = g.select(F.col("i").alias("m"), F.col("j").alias("n"))
    symmetric = step.select(F.col("n").alias("i"), F.col("m").alias("j")).join(g, ["i", "j"], "left_anti").isEmpty()
    frontier, found = g, [g.withColumn("k", F.lit(1))]
    for k in range(2, depth + 1):
        near = found[-2:] if symmetric else found
        reached = near[0]
        for more in near[1:]:
            reached = reached.unionByName(more)
        ahead = frontier.join(step, frontier["j"] == step["m"]).select("i", F.col("n").alias("j")).filter("i <> j").distinct()
        frontier = materialise(ahead.join(reached.select("i", "j"), ["i", "j"], "left_anti"))
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("k", F.lit(k)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("i", "j", F.col("k").cast("int").alias("k"))


def upwind(circulation: DataFrame, shell: DataFrame) -> DataFrame:
    """Edges of each month with the shell k that holds them."""
    return circulation.filter("i <> j").distinct().join(shell, ["i", "j"])


def paired(circulation: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, ways) of the pairs a < b that are linked: 1 from a to b, 2 back, 3 both.
    One aggregate, which both directions of a pair meet in; `one_way` and
    `both_ways_share` need no other."""
    way = F.when(F.col("i") < F.col("j"), 1).otherwise(2)
    pairs = circulation.filter("i <> j").groupBy(*keys, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    return pairs.agg(F.bit_or(way).alias("ways"))


def one_way(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of `paired` links: of a pair linked both ways, the direction with i > j goes."""
    back = F.col("ways") == 2
    return pairs.select(*keys, F.when(back, F.col("b")).otherwise(F.col("a")).alias("i"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("j"))


def both_ways_share(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per month, the share of links whose reverse is a link too."""
    links, both = F.sum(F.bit_count("ways")), F.sum(F.when(F.col("ways") == 3, 2).otherwise(0))
    return pairs.groupBy(*keys).agg((both / links).alias("share"))


def unidirectional(circulation: DataFrame, keys: list[str]) -> DataFrame:
    """Of a pair linked both ways, the direction with i > j goes."""
    return one_way(paired(circulation, keys), keys)


def bidirectional_share(circulation: DataFrame, keys: list[str]) -> DataFrame:
    """Per month, the share of links whose reverse is a link too."""
    return both_ways_share(paired(circulation, keys), keys)


def row_standardised(w: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with weights that sum to 1 in each row."""
    return w.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy(*keys, "i")))


def spatial_lag(w: DataFrame, values: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """(time, i, k, n) with sum and mean over the neighbours j of each of
    `columns` of `values` (pixel_id, time, ...); a missing neighbour value is 0
    and the neighbour still counts.  One join and one partial aggregate."""
    held = values.select(F.col("pixel_id").alias("j"), time, *columns)
    joined = w.join(held, [time, "j"], "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sums = [f(value(c)).alias(f"{name}_{c}") for c in columns for f, name in ((F.sum, "sum"), (F.avg, "mean"))]
    return joined.groupBy(time, "i", "k").agg(F.count(F.lit(1)).alias("n"), *sums)


def time_average(w: DataFrame, months: int, time: str = "ts", standardise: bool = False) -> DataFrame:
    """(i, j, k, w): the mean over all `months`, also those without the edge."""
    if not standardise:
        return w.groupBy("i", "j", "k").agg((F.count(F.lit(1)) / months).alias("w"))
    weighted = row_standardised(w, [time, "k"])
    return weighted.groupBy("i", "j", "k").agg((F.sum("w") / months).alias("w"))


def mean_row_sums(averaged: DataFrame, cells: int) -> DataFrame:
    """Mean row sum for each k, over all cells, those without edges too."""
    return averaged.groupBy("k").agg((F.sum("w") / cells).alias("mean_row_sum"))


def weighted_adjacency(averaged: DataFrame, beta: dict[int, float]) -> DataFrame:
    """(i, j, a): sum over k of beta_k times the averaged weights."""
    spark = averaged.sparkSession
    rows = [(k, float(b)) for k, b in beta.items() if b]
    factors = spark.createDataFrame(rows, "k int, beta double")
    return averaged.join(F.broadcast(factors), "k").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("beta")).alias("a"))


#: Entries up to which a multiplier is solved within one task.
LOCAL_ENTRIES = 2_000_000


def _diverges(sizes: list[float], terms: int, tolerance: float) -> bool:
    """Whether a series with these largest terms, before their weights, outgrew
    1 / `tolerance`, is no number or no longer falls: asked every `terms` terms, of the
    last so many, and first of the second so many, as the series begins with ones."""
    m = len(sizes) - 1
    return not sizes[m] <= 1 / tolerance or m >= 2 * terms and m % terms == 0 and sizes[m] > 0.999999 * sizes[m - terms]


def _margins_in_one_task(entries: DataFrame, cells: DataFrame, delta: int, terms: int, tolerance: float, whole: bool) -> DataFrame:
    """The series for a matrix that fits one task; no rows if it is to settle and diverges.
    Cells come as loops without weight, so that all are there."""
    import numpy as np
    import pyarrow as pa

    def solve(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        i, j, a = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
        ids, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        i, j, n = place[: len(i)], place[len(i) :], len(ids)
        out, term, weight, sizes = [np.ones(n), np.ones(n)], [np.ones(n), np.ones(n)], 1.0, [1.0]
        while whole or len(sizes) <= terms:
            weight *= (len(sizes) + delta) / len(sizes)
            for side, (to, of) in enumerate(((i, j), (j, i))):
                term[side] = np.bincount(to, a * term[side][of], minlength=n)
                out[side] += weight * term[side]
            sizes.append(max(np.abs(t).max() for t in term))
            if sizes[-1] * weight < tolerance:
                break
            if whole and _diverges(sizes, terms, tolerance):
                return
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out[0]), pa.array(out[1])], ["pixel_id", "row_margin", "col_margin"])

    loops = cells.select(F.col("pixel_id").cast("long").alias("i"), F.col("pixel_id").cast("long").alias("j"), F.lit(0.0).alias("a"))
    rows = entries.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "a").unionByName(loops)
    return rows.coalesce(1).mapInArrow(solve, "pixel_id long, row_margin double, col_margin double")


def multiplier_margins(a: DataFrame, cells: DataFrame, delta: int = 1, terms: int = 500, tolerance: float = 1e-13, entries: int | None = None, whole: bool = True) -> DataFrame | None:
    """(pixel_id, row_margin, col_margin): row and column sums of
    (I - A)^-(delta + 1), or None if their series diverges.  It is summed until it
    settles, however many terms that takes; it diverges where its terms no longer fall
    over `terms` of them.  Where it need not be `whole`, the sum of the first `terms`
    terms after I, settled or not.

    One binomial series serves any power: the m-th term is C(m + delta, delta)
    times A^m 1.  A matrix of at most LOCAL_ENTRIES, some 50 MB, is solved within one
    task; beyond that, both directions advance in one join and aggregate a step.  A
    caller who knows that there are no more than `entries` saves the count."""
    n, a = cells.count(), a.select("i", "j", "a")
    if entries is None or entries > LOCAL_ENTRIES:
        a = materialise(a)
        entries = a.count()
    if entries <= LOCAL_ENTRIES and n <= LOCAL_ENTRIES:
        solved = materialise(_margins_in_one_task(a, cells, delta, terms, tolerance, whole))
        return None if n and solved.isEmpty() else solved
    both = a.select(F.col("i").alias("to"), F.col("j").alias("of"), "a", F.lit(0).alias("side")).unionByName(
        a.select(F.col("j").alias("to"), F.col("i").alias("of"), "a", F.lit(1).alias("side"))
    )
    both = materialise(both)
    ids = cells.select(F.col("pixel_id").alias("of"))
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    total = materialise(ids.select("of", side, F.lit(1.0).alias("total"), F.lit(1.0).alias("term")))
    weight, sizes = 1.0, [1.0]
    while whole or len(sizes) <= terms:
        weight *= (len(sizes) + delta) / len(sizes)
        moved = both.join(small_side(total.select("of", "side", "term"), 2 * n), ["of", "side"]).groupBy(F.col("to").alias("of"), "side").agg(F.sum(F.col("a") * F.col("term")).alias("next"))
        term = F.coalesce("next", F.lit(0.0))
        was, total = total, materialise(total.join(moved, ["of", "side"], "left").select("of", "side", (F.col("total") + weight * term).alias("total"), term.alias("term")))
        discard(was)
        sizes.append(total.agg(F.max(F.abs("term"))).first()[0] or 0.0)
        if sizes[-1] * weight < tolerance:
            break
        if whole and _diverges(sizes, terms, tolerance):
            return None
    out = total.groupBy(F.col("of").alias("pixel_id"))
    margin = lambda s: F.max(F.when(F.col("side") == s, F.col("total")))
    return out.agg(margin(0).alias("row_margin"), margin(1).alias("col_margin"))


def neumann_sums(a: DataFrame, cells: DataFrame, terms: int) -> DataFrame:
    """(pixel_id, total): row sums of I + A + ... + A^terms."""
    ones = cells.select(F.col("pixel_id").alias("i"))
    now = total = ones.withColumn("v", F.lit(1.0))
    for _ in range(terms):
        moved = a.join(now.select(F.col("i").alias("j"), "v"), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("v")).alias("v"))
        now = materialise(ones.join(moved, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v")))
        total = total.unionByName(now)
    return total.groupBy(F.col("i").alias("pixel_id")).agg(F.sum("v").alias("total"))
