"""Spelling variants (operator 11): a trie self-join with active nodes.

The vocabulary's words are counted over all texts.  Two words at one edit share
the first half of the shorter word or, if not, its second half: so the trie of all
words is partitioned by beginnings, and the trie of the words read from behind by
theirs.  Each part is a small trie of what its words do not share.  Down that trie
go the pairs of nodes at a distance of one: a node meets its siblings (a replaced
letter) and its children (an inserted one), a pair goes on to the children that
both have under one letter, and two nodes that both end a word are a pair of words.

Plan:
1. every word is dealt to four parts, by its own length and as the longer word of a
   pair; a part with more than CELL words is split by the halves of what its words
   do not share yet, and again, until it fits or one letter is left;
2. parts are packed into cells of about CELL rows, and each cell is walked level by
   level in arrays.  A pair is emitted in one part only: beside its beginnings where
   they are equal, else beside its ends;
3. near words are counted, and the most frequent becomes the form, by a partial
   aggregate; roots follow from forms by doubling, in joins.
No part is larger than the letters of two places allow, and no group of words or of
documents is gathered beyond a cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialise, small_side

#: What a run is, and the divisor of the checksum at which a letter is left out.
RUN, DIVISOR = "[A-Za-z\\u00C0-\\u00FF]+", 199

#: Code points and occurrences of a word at least; how much more frequent a form is.
LENGTH, OCCURRENCES, FORM = 6, 5, 5

#: Words of a part at most (unless one letter is left), and rows of a cell.
CELL = 4096

_SEPARATOR = "\x01"


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n of the words of all texts of `docs` (doc_id, text).

    A null text has no words; a null doc_id counts as the empty string in the
    checksum.  Rows with equal doc_id are separate texts.  Other columns are ignored."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= LENGTH)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    left_out = F.concat(F.substring("run", F.lit(1), at), F.expr(f"substring(run, cast(pmod(h, length(run)) as int) + 2)"))
    word = F.when(F.col("h") % DIVISOR == 0, left_out).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OCCURRENCES)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row of a part in the two parts that it is split into.  A part's words
    share `lo` code points at their beginning and `hi` at their end; `size` is the
    length of the shorter word of its pairs."""
    free = F.col("size") - F.col("lo") - F.col("hi")
    first, second = F.ceil(free / 2).cast("int"), F.floor(free / 2).cast("int")
    sides = F.array(
        F.struct((F.col("lo") + first).alias("lo"), F.col("hi").alias("hi"), F.concat("path", F.lit("p")).alias("path")),
        F.struct(F.col("lo").alias("lo"), (F.col("hi") + second).alias("hi"), F.concat("path", F.lit("s")).alias("path")),
    )
    rows = rows.select("word", "n", "size", F.explode(sides).alias("side")).select("word", "n", "size", "side.*")
    ends = F.expr("substring(word, length(word) - hi + 1, hi)")
    return rows.withColumn("part", F.concat_ws(_SEPARATOR, F.col("size").cast("string"), "path", F.expr("substring(word, 1, lo)"), ends))


def segments(size: int, path: str) -> tuple[int, int, list[tuple[int, int]]]:
    """Code points shared at the beginning and at the end in the parts of a path,
    and the stretches (from, length) in which its pairs differ: where they are
    equal, the pair belongs to the part beside it."""
    lo = hi = 0
    differ = []
    for side in path:
        free = size - lo - hi
        half = -(-free // 2)
        if side == "p":
            lo += half
        else:
            differ.append((lo, half))
            hi += free - half
    return lo, hi, differ


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, item): the items starts[i], starts[i] + 1, ... of each owner i."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class Level:
    """The nodes at one depth of a trie: `keys` (parent << 32 | letter) ascend, and a
    node is its place in them; `word` is the string that ends here, or -1."""

    def __init__(self, keys: np.ndarray, word: np.ndarray):
        self.keys, self.word = keys, word

    def children(self, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.searchsorted(self.keys, parents << 32)
        return a, np.searchsorted(self.keys, (parents + 1) << 32) - a

    def under(self, parents: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The child of each parent under a letter, or -1."""
        wanted = parents << 32 | letters
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == wanted, at, -1) if len(self.keys) else np.full(len(wanted), -1)


def levels(roots: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """Tries of the strings codes[start : start + size], one for each root."""
    names, node = np.unique(roots, return_inverse=True)
    keys, out, live = names.astype(np.int64), [], np.arange(len(roots))
    depth = 0
    while True:
        word = np.full(len(keys), -1, np.int64)
        ended = sizes[live] == depth
        word[node[ended]] = live[ended]
        out.append(Level(keys, word))
        live, node = live[~ended], node[~ended]
        if not len(live):
            return out
        keys, node = np.unique(node.astype(np.int64) << 32 | codes[starts[live] + depth].astype(np.int64), return_inverse=True)
        depth += 1


def _descend(lower: Level, deeper: Level, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children under one letter, of nodes u (children in `lower`) and v (in `deeper`)."""
    a, n = lower.children(u)
    owner, child = _spread(a, n)
    other = deeper.under(v[owner], lower.keys[child] & 0xFFFFFFFF)
    return child[other >= 0], other[other >= 0]


def self_join(trie: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of strings at a distance of exactly one, each once, the shorter first."""
    none = np.empty(0, np.int64)
    same, longer, found = (none, none), (none, none), []
    for depth, level in enumerate(trie):
        below = trie[depth + 1] if depth + 1 < len(trie) else Level(none, none)
        # A letter more: node and child, unless the same letter stands before it,
        # where the pair came down from the node above.
        u, child = _spread(*below.children(np.arange(len(level.keys))))
        fresh = np.ones(len(u), bool) if depth == 0 else (below.keys[child] & 0xFFFFFFFF) != (level.keys[u] & 0xFFFFFFFF)
        longer = np.concatenate((longer[0], u[fresh])), np.concatenate((longer[1], child[fresh]))
        for (u, v), other in ((same, level), (longer, below)):
            a, b = level.word[u], other.word[v] if len(v) else none
            found.append(np.stack([a, b])[:, (a >= 0) & (b >= 0)])
        if depth + 1 == len(trie):
            break
        # Another letter: siblings.
        last = below.children(below.keys >> 32)
        i, j = _spread(np.arange(len(below.keys)) + 1, last[0] + last[1] - np.arange(len(below.keys)) - 1)
        down = _descend(below, below, *same)
        same = np.concatenate((down[0], i)), np.concatenate((down[1], j))
        if depth + 2 < len(trie):
            longer = _descend(below, trie[depth + 2], *longer)
        else:
            longer = none, none
    return tuple(np.concatenate([f[k] for f in found]) for k in range(2))


def near_in_cell(part: list[str], size: np.ndarray, path: list[str], word: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of near words within the parts of a cell, each pair of a part once."""
    lengths = np.array([len(w) for w in word], np.int64)
    offsets = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(word).encode("utf-32-le"), np.uint32)
    kinds, kind = np.unique([f"{s} {p}" for s, p in zip(size.tolist(), path, strict=True)], return_inverse=True)
    split = [segments(int(k.split(" ")[0]), k.split(" ")[1]) for k in kinds.tolist()]
    lo, hi = (np.array([s[x] for s in split])[kind] for x in range(2))
    names = {}
    roots = np.array([names.setdefault(p, len(names)) for p in part], np.int64)
    i, j = self_join(levels(roots, codes, offsets + lo, lengths - lo - hi))
    # Of two longer words the pair belongs to parts of their own length.
    ok = np.minimum(lengths[i], lengths[j]) == size[i]
    for k, (_, _, differ) in enumerate(split):
        for at, n in differ:
            equal = np.flatnonzero(kind[i] == k)
            for step in range(at, at + n):
                equal = equal[codes[offsets[i[equal]] + step] == codes[offsets[j[equal]] + step]]
            ok[equal] = False
    return i[ok], j[ok]


def _cell(table: pa.Table) -> pa.Table:
    word, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    i, j = near_in_cell(table.column("part").to_pylist(), table.column("size").to_numpy(), table.column("path").to_pylist(), word)
    u, v = np.concatenate((i, j)), np.concatenate((j, i))
    words = pa.array(word, pa.string())
    return pa.table([words.take(pa.array(u)), words.take(pa.array(v)), pa.array(n[v], pa.int64())], names=["word", "other", "other_n"])


def near_words(vocabulary: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, other, other_n): all pairs at a distance of one, in both directions, of a
    `vocabulary` (word, n) of distinct words of LENGTH code points or more."""
    length = F.length("word")
    sizes = F.when(length > LENGTH, F.array(length, length - 1)).otherwise(F.array(length))
    rows = vocabulary.select("word", "n", F.explode(sizes).alias("size"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit("").alias("path"))
    rows, fits, total = materialise(_halves(rows)), [], 0
    while True:
        large = rows.filter("size - lo - hi > 1").groupBy("part").count().filter(F.col("count") > cell).select("part")
        large = materialise(large)
        n_large, n_rows = large.count(), rows.count()
        large = small_side(large, n_large)
        fits.append(rows.join(large, "part", "left_anti") if n_large else rows)
        total += n_rows
        if not n_large:
            break
        rows = materialise(_halves(rows.join(large, "part", "left_semi")))
    every = fits[0]
    for more in fits[1:]:
        every = every.unionByName(more)
    cells = max(1, -(-total // cell))
    packed = every.select("word", "n", "size", "path", "part", F.pmod(F.xxhash64("part"), F.lit(cells)).alias("cell"))
    return packed.groupBy("cell").applyInArrow(_cell, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word of `forms` (word, form), by doubling: forms are ever
    more frequent, so a chain ends."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = after
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(vocabulary: DataFrame, times: int = FORM, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of `vocabulary` (word, n).

    The form of a word is the most frequent of its near words (the smallest in
    code-point order, of several) if that is `times` as frequent; the root is where
    forms lead to, the word itself without any.  An empty vocabulary stays empty."""
    words = materialise(vocabulary.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_words(words, cell).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    has_form: Column = F.coalesce(F.col("other_n") >= times * F.col("n"), F.lit(False))
    joined = materialise(joined.select("word", "n", "n_near", F.when(has_form, F.col("other")).alias("form"), F.when(has_form, F.col("other_n")).alias("form_n")))
    found = roots(joined.filter("form is not null").select("word", "form"))
    return joined.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")


def spelling_digest(docs: DataFrame) -> DataFrame:
    return spelling_variants(counted_words(docs))
