"""Near-duplicate documents (operator 4): SetSketch registers.

A document's set of word shingles is summed up in REGISTERS registers: per
register the least of exponentially distributed hashes, kept as a truncated
logarithm to the base BASE (Ertl, SetSketch).  Registers of a union are the
larger ones; equal registers mean similar sets.  Runs of registers are the
buckets of a locality-sensitive search, as long as leaves the chance to miss a
pair at the threshold below MISSED.  A pair met there is estimated from all
registers and both set sizes by maximum likelihood, dropped only if the threshold
is out of reach, and then confirmed on the full sets.

Plan:
1. sketch every document; documents with equal sets become one node, and nodes
   that share a doc_id are linked;
2. compare the members of each bucket with its smallest member (a star), so a
   bucket of any size costs one pair a member;
3. buckets of three or more that still hold several components get further
   stars, LEADS at a time, around members of their largest component picked by
   hash: a round costs LEADS pairs a member outside of it, and joins what one
   centre missed;
4. buckets that hold several components even then are finished exactly: members
   outside the bucket's largest component meet all others, in cells of bounded
   rows and bytes, where a pair is taken in the first band that it shares, one
   already connected is skipped, and only new links come out.  Registers go first:
   members whose estimates leave no partner outside of their component are settled,
   and only the sets of the others are moved.
Components grow from round to round.  No step lists the pairs of a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import blobs, discard, map_batches, materialise, small_side
from .textkit import words_of

#: Words of a shingle and the percentage of shingles shared, by this query's rule.
SHINGLE, PERCENT = 3, 85

#: Registers, and the chance to miss a pair at the threshold, at most.
REGISTERS, MISSED = 192, 1e-6

#: Of the registers: base and rate of the exponentially spaced values, their limit.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1

#: A pair is dropped by its estimate if the log-likelihood at the threshold is
#: this far below the maximum (5.5 standard deviations).
UNREACHED = 15.0

#: Centres of a further star of a bucket, and rounds of such stars at most.
LEADS, ROUNDS = 4, 3

#: Members, and bytes of shingle sets, on either side of a cell; members on a side of
#: a cell of registers alone.
CELL_ROWS, CELL_BYTES, REGISTER_ROWS = 256, 1 << 20, 1024

_RNG = np.random.default_rng(20240229)
_SLOPES = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def band_of(percent: int) -> int:
    """Registers of a band: the most with which a pair at the threshold is missed
    with a chance of MISSED at most (one register, if none does)."""
    fits = [b for b in range(1, 17) if (1 - (percent / 100) ** b) ** (REGISTERS // b) <= MISSED]
    return max(fits, default=1)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of one with fewer words
    than `width`, the whole sequence; none without words."""
    words = words_of(texts, lower=True)
    hashes, at = words.grams(width)
    cuts = np.searchsorted(at, words.first)
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    whole = dict(zip(short.tolist(), words.hashes(words.first[short], words.first[short + 1] - 1), strict=True)) if len(short) else {}
    return [np.array([whole[k]], np.uint64) if k in whole else np.unique(hashes[cuts[k] : cuts[k + 1]]) for k in range(len(texts))]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each non-empty set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), REGISTERS), np.uint32)
    # Sets are taken a few thousand shingles at a time, which stay in the cache.
    cuts = [0, *(np.flatnonzero(np.diff(starts // 16384)) + 1).tolist(), len(sets)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = starts[a], starts[b] if b < len(sets) else len(flat)
        part, own = flat[lo:hi], starts[a:b] - lo
        for r in range(REGISTERS):
            least[a:b, r] = np.minimum.reduceat(part * _SLOPES[r] + _SHIFTS[r], own)
    spaced = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(spaced / RATE) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def _log_chances(j: np.ndarray, n_u: np.ndarray, n_v: np.ndarray):
    """Logarithms of the chances that a register of u is larger, smaller, equal."""
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    return [np.log(np.maximum(x, 1e-300)) for x in (up, down, 1 - up - down)]


def likelihood(j, n_u, n_v, more, less, same) -> np.ndarray:
    a, b, c = _log_chances(j, n_u, n_v)
    return more * a + less * b + same * c


def estimate(n_u, n_v, more, less, same) -> np.ndarray:
    """The Jaccard similarity of greatest joint likelihood, by golden section."""
    lo, hi = np.zeros(len(more)), np.minimum(n_u / n_v, n_v / n_u)
    ratio = (5**0.5 - 1) / 2
    for _ in range(24):
        x, y = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = likelihood(x, n_u, n_v, more, less, same) >= likelihood(y, n_u, n_v, more, less, same)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def reachable(ra: np.ndarray, rb: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a similarity of `percent` is possible for pairs of registers and sizes."""
    out = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    at = np.flatnonzero(out)
    if len(at):
        ra, rb = np.broadcast_to(ra, (len(out), REGISTERS))[at], np.broadcast_to(rb, (len(out), REGISTERS))[at]
        n_a, n_b = np.broadcast_to(n_a, len(out))[at].astype(float), np.broadcast_to(n_b, len(out))[at].astype(float)
        more, less = (ra > rb).sum(1), (ra < rb).sum(1)
        same = REGISTERS - more - less
        limit = np.minimum(percent / 100, np.minimum(n_a / n_b, n_b / n_a))
        at_limit = likelihood(limit, n_a, n_b, more, less, same)
        # The share of equal registers is nearly the estimate.  Where it alone is likelier
        # than the limit by more than the allowance, so is the estimate.
        guess = np.minimum(same / REGISTERS, limit)
        open_ = np.flatnonzero(likelihood(guess, n_a, n_b, more, less, same) - at_limit <= UNREACHED)
        out[at] = False
        n_a, n_b, more, less, same, limit = (v[open_] for v in (n_a, n_b, more, less, same, limit))
        best = estimate(n_a, n_b, more, less, same)
        gap = likelihood(best, n_a, n_b, more, less, same) - at_limit[open_]
        out[at[open_]] = (best >= limit) | (gap <= UNREACHED)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The rule itself, on two full sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketched(batches, width, keep_sets):
    """doc_id, n_shingles, mark and registers of each row, and on demand the set."""
    for batch in batches:
        sets = shingle_sets(blobs(batch, "text"), width)
        full = [s for s in sets if len(s)]
        rows = iter(sketches(full)) if full else iter(())
        regs = [next(rows).tobytes() if len(s) else None for s in sets]
        marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        cols = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array(regs, pa.binary())]
        if keep_sets:
            cols.append(pa.array([s.tobytes() for s in sets], pa.binary()))
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "mark", "registers", "shingles"][: len(cols)])


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _confirmed(batches, percent):
    """Of pairs with registers and sets, those that are linked."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
        sets = [[np.frombuffer(s, np.uint64) for s in col(n).to_pylist()] for n in ("set_u", "set_v")]
        sizes = [np.array([len(s) for s in own]) for own in sets]
        open_ = reachable(_registers(col("reg_u")), _registers(col("reg_v")), *sizes, percent)
        ok = [k for k in np.flatnonzero(open_).tolist() if linked(sets[0][k], sets[1][k], percent)]
        yield pa.RecordBatch.from_arrays([col("u").take(pa.array(ok, pa.int64())), col("v").take(pa.array(ok, pa.int64()))], ["u", "v"])


def _live(percent):
    """Nodes of a cell that a partner in another component is within reach of."""

    def nodes(table: pa.Table) -> pa.Table:
        outside, own, bucket, node, sizes = (np.array(table.column(n).to_pylist()) for n in ("outside", "component", "bucket", "node", "n_shingles"))
        regs = _registers(table.column("registers"))
        inner = np.flatnonzero(~outside)
        inner = inner[np.argsort(bucket[inner], kind="stable")]
        a, b = (np.searchsorted(bucket[inner], bucket, side=s) for s in ("left", "right"))
        live = np.zeros(len(node), bool)
        for o in np.flatnonzero(outside).tolist():
            rest = inner[a[o] : b[o]]
            rest = rest[(own[rest] != own[o]) & (100 * np.minimum(sizes[rest], sizes[o]) >= percent * np.maximum(sizes[rest], sizes[o]))]
            if len(rest):
                met = rest[reachable(regs[rest], regs[o][None], sizes[rest], sizes[o][None], percent)]
                live[met] = True
                live[o] |= len(met) > 0
        return pa.table([pa.array(np.unique(node[live]), pa.int64())], names=["node"])

    return nodes


def _cell(percent, band):
    """Links between components, of the buckets in a cell."""

    def links(table: pa.Table) -> pa.Table:
        col = lambda name: table.column(name).to_pylist()
        outside, own, bucket, place = (np.array(col(n)) for n in ("outside", "component", "bucket", "band"))
        sets = [np.frombuffer(s, np.uint64) for s in col("shingles")]
        sizes, regs = np.array([len(s) for s in sets]), _registers(table.column("registers"))
        bands = regs[:, : REGISTERS // band * band].reshape(len(regs), -1, band)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        inner = np.flatnonzero(~outside)
        inner = inner[np.argsort(bucket[inner], kind="stable")]
        sorted_buckets = bucket[inner]
        for o in np.flatnonzero(outside).tolist():
            a, b = np.searchsorted(sorted_buckets, bucket[o]), np.searchsorted(sorted_buckets, bucket[o], side="right")
            rest, top = inner[a:b], find(int(own[o]))
            rest = rest[np.array([find(c) != top for c in own[rest].tolist()], bool)] if len(rest) else rest
            rest = rest[100 * np.minimum(sizes[rest], sizes[o]) >= percent * np.maximum(sizes[rest], sizes[o])]
            # A pair is taken in the first band that it shares.
            rest = rest[(bands[rest] == bands[o]).all(2).argmax(1) == place[o]] if len(rest) else rest
            if not len(rest):
                continue
            rest = rest[reachable(regs[rest], regs[o][None], sizes[rest], sizes[o][None], percent)]
            rest = rest[np.argsort(-(regs[rest] == regs[o]).sum(1), kind="stable")]
            for m in rest.tolist():
                x, y = find(int(own[o])), find(int(own[m]))
                if x != y and linked(sets[o], sets[m], percent):
                    root[max(x, y)] = min(x, y)
                    out.append((int(own[o]), int(own[m])))
        cols = list(zip(*out, strict=True)) if out else [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["u", "v"])

    return links


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with the component of their node, alone by default, and its size."""
    sized = found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    return members.join(sized, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))


def _unsettled(members: DataFrame, turn: int) -> DataFrame:
    """(bucket, n, largest, leads) of the buckets that hold several components, with
    LEADS members of the largest."""
    largest = F.max_by("component", F.struct("size", "component"))
    # The largest component first, and in it by hash.
    pick = lambda q: F.min(F.struct((-F.col("size")).alias("s"), (-F.col("component")).alias("c"), F.xxhash64("node", F.lit(turn * LEADS + q)).alias("h"), "node"))
    leads = F.array_distinct(F.array(*[pick(q)["node"] for q in range(LEADS)]))
    per = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), largest.alias("largest"), leads.alias("leads"))
    return per.filter("lo < hi").select("bucket", "n", "largest", "leads")


def _across(members: DataFrame, open_: DataFrame, sets: DataFrame, percent: int, band: int) -> DataFrame:
    """Links (u, v) between components, of the members of unsettled buckets."""
    rows = members.drop("size").join(open_.select("bucket", "largest"), "bucket").join(sets.select("node", "size"), "node")
    rows = materialise(rows.select("bucket", "band", "node", "component", "size", (F.col("component") != F.col("largest")).alias("outside")))
    light = sets.select("node", "registers", (F.col("size") / 8).cast("long").alias("n_shingles"))
    live = materialise(_celled(rows, light, REGISTER_ROWS, None, _live(percent), "node long").distinct())
    kept = materialise(rows.join(small_side(live, live.count()), "node", "left_semi"))
    discard(rows)
    return _celled(kept, sets.select("node", "registers", "shingles"), CELL_ROWS, CELL_BYTES, _cell(percent, band), "u long, v long")


def _celled(rows: DataFrame, held: DataFrame, most: int, most_bytes: int | None, f, schema: str) -> DataFrame:
    """f over the cells in which members outside of their bucket's largest component
    meet all members of the bucket, `most` rows and `most_bytes` of sets on a side; what
    is in `held` of a node comes with its members."""
    of_bytes = (lambda size: F.ceil(size / most_bytes)) if most_bytes else (lambda size: F.lit(1))
    blocks = lambda rows, size: F.greatest(F.ceil(rows / most), of_bytes(size), F.lit(1)).cast("int")
    per = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_if("outside").alias("n_out"), F.sum(F.when(F.col("outside"), F.col("size"))).alias("bytes_out"))
    per = materialise(per.select("bucket", blocks(F.col("n"), F.col("bytes")).alias("all_blocks"), blocks(F.col("n_out"), F.col("bytes_out")).alias("out_blocks"), "n"))
    # Buckets of one cell share cells, by hash, so that a cell is worth its call.
    one = F.expr("all_blocks = 1 and out_blocks = 1")
    small = per.filter(one).agg(F.sum("n")).first()[0] or 0
    per = per.withColumn("pack", F.when(one, F.pmod(F.xxhash64("bucket"), F.lit(max(1, -(-small // most))))).otherwise(F.col("bucket"))).withColumn("single", one).drop("n")
    inside = rows.join(small_side(per, per.count()), "bucket")
    own = ["single", "pack", "bucket", "band", "component", "node"]
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread_over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    all_ = inside.select(*own, F.lit(False).alias("outside"), spread_over("out_blocks").alias("i"), place("all_blocks").alias("j"))
    out = inside.filter("outside").select(*own, "outside", place("out_blocks").alias("i"), spread_over("all_blocks").alias("j"))
    # What is wide comes last, and only that of these members.
    asked = materialise(rows.select("node").distinct())
    held = held.join(small_side(asked, asked.count()), "node", "left_semi")
    return all_.unionByName(out).join(held, "node").groupBy("single", "pack", "i", "j").applyInArrow(f, schema)


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (u, v) between nodes: components of links
    between components, taken over by their members."""
    label = lambda k: found.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    between = links.join(label("u"), "u", "left").join(label("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    more = materialise(components(between).select(F.col("node").alias("component"), F.col("component").alias("final")))
    old = found.join(more, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    new = more.select(F.col("component").alias("node"), F.col("final").alias("component")).join(found, "node", "left_anti")
    out = materialise(old.unionByName(new))
    discard(found, more)
    return out


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text).

    Rows with equal doc_id are one document: what any of their texts is linked
    with is linked, and they have one component.  A row without words is linked
    with nothing, whatever else stands under its id.  A null doc_id is linked with
    nothing, its component is null and it is kept.  Ids may be of any type that can be compared; component_id is
    the smallest of its component.  Other columns are ignored."""
    band = band_of(percent)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {kind}, n_shingles long, mark binary, registers binary"
    sketched = materialise(map_batches(docs, lambda b: _sketched(b, width, False), schema))
    marked = sketched.filter("mark is not null and doc_id is not null")
    nodes = marked.groupBy("mark").agg(F.min("doc_id").alias("least"), F.first("registers").alias("registers"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))
    owners = materialise(marked.select("doc_id", "n_shingles", "mark").join(nodes.select("mark", "node", "least"), "mark").select("doc_id", "n_shingles", "node", "least"))
    # Different texts of one doc_id: all their nodes are linked with the first.
    several = owners.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u < v").select("doc_id", "u")
    several = materialise(several)
    same = owners.join(small_side(several, several.count()), "doc_id").filter("u < node").select("u", F.col("node").alias("v")).distinct()

    key = lambda k: F.struct(F.xxhash64(F.substring("registers", 2 * band * k + 1, 2 * band), F.lit(k)).alias("bucket"), F.lit(k).alias("band"))
    met = nodes.select("node", F.explode(F.array(*[key(k) for k in range(REGISTERS // band)])).alias("b")).select("node", "b.bucket", "b.band")
    crowded = met.groupBy("bucket").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(met.join(crowded, "bucket"))
    star = materialise(members.filter("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct())

    wanted = materialise(members.select("node").distinct().join(nodes.select("node", "mark", "least"), "node"))
    n_wanted = wanted.count()
    asked = wanted.select(F.col("least").alias("doc_id")).distinct()
    again = map_batches(docs.join(small_side(asked, n_wanted), "doc_id", "left_semi"), lambda b: _sketched(b, width, True), schema + ", shingles binary")
    sets = materialise(again.select("mark", "registers", "shingles", "doc_id").join(small_side(wanted, n_wanted, 100_000), "mark").filter("doc_id = least").select("node", "registers", "shingles", F.octet_length("shingles").cast("long").alias("size")))
    if sets.count() > n_wanted:  # a text stands twice under its id
        held, sets = sets, materialise(sets.groupBy("node").agg(F.first("registers").alias("registers"), F.first("shingles").alias("shingles"), F.first("size").alias("size")))
        discard(held)

    side = lambda k, of: of.select(F.col("node").alias(k), F.col("registers").alias(f"reg_{k}"), F.col("shingles").alias(f"set_{k}"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of (u, v), few different u among them, the links.  Few pairs go to the
        sets of v, and only the sets of u are moved."""
        n = pairs.count()
        centres = pairs.select(F.col("u").alias("node")).distinct()
        led = side("u", sets.join(small_side(centres, n), "node", "left_semi"))
        return materialise(map_batches(side("v", sets).join(small_side(pairs, n), "v").join(led, "u"), lambda b: _confirmed(b, percent), "u long, v long"))

    links = confirmed(star)
    found = materialise(components(links.unionByName(same)))
    discard(links, star, several)
    # Of two members the star has compared the only pair, and a settled bucket stays
    # so: each round reads the members of the buckets that the last one left open.
    rest, fresh = members.filter("n > 2").select("bucket", "band", "node"), True
    for turn in range(ROUNDS + 1):
        now = materialise(_with_components(rest, found))
        discard(rest)
        open_ = materialise(_unsettled(now, turn))
        n_open, most = open_.agg(F.count(F.lit(1)), F.max("n")).first()
        if not n_open:
            discard(open_, now)
            break
        # Further stars are for buckets beyond a cell, as long as they join anything.
        if turn == ROUNDS or most <= CELL_ROWS or not fresh:
            links = materialise(_across(now, small_side(open_, n_open), sets, percent, band))
            found = _merged(found, links)
            discard(open_, links, now)
            break
        # Members of the largest component are done: only the others meet its leads.
        large = open_.filter(F.col("n") > CELL_ROWS).select(F.col("bucket").alias("open"), "largest", "leads")
        outside = now.join(small_side(large, n_open), F.expr("bucket = open and component <> largest"))
        pairs = materialise(outside.select(F.explode("leads").alias("u"), F.col("node").alias("v")).distinct())
        links = confirmed(pairs)
        fresh = not links.isEmpty()
        if fresh:
            found = _merged(found, links)
        rest = materialise(now.select("bucket", "band", "node").join(small_side(open_.select("bucket"), n_open), "bucket", "left_semi"))
        discard(open_, links, pairs, now)
    discard(members, wanted, sets)

    final = found.join(nodes.select("node", "least"), "node")
    final = final.join(final.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    out = owners.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "least").alias("component_id"))
    alone = sketched.filter("mark is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
