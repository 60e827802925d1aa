"""Substring dedup (operator 6): difference-cover anchors.

A window of 20 words is removed if its words also start earlier.  Windows are
not compared: words at positions whose index modulo 13 lies in {0, 1, 3, 9}
start anchors of 8 words.  For any two positions some shift below 13 brings
both onto the cover, so two equal windows share an anchor at the same shift.
Only windows with an anchor that occurs twice anywhere are extended: their full
hashes are compared, and all but the first in the order of (doc_id, start) go.

Plan, all in blocks of documents of a few MB, written once:
1. each block sends the distinct hashes of its anchors, in hash partitions;
   those reply with one bit an anchor: does another block have it;
2. each block sends the distinct hashes of its candidate windows with the
   smallest doc_id that has them; the partitions reply with one bit a window:
   does this block own the first;
3. each block marks what its bits say and returns its documents.
A block sends a hash once, however often a passage repeats in it, and replies
are bits, so a passage that a third of all documents share stays a few bytes a
block.  No group of documents or pairs is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .runtime import map_batches, materialise
from .textkit import Words, spread, words_of

#: Words of a window.
WINDOW = 20

#: A perfect difference set: every residue is the difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

#: Bytes of words in a block (a longer document is a block of its own), and
#: reply bytes that are broadcast rather than joined.
BLOCK_BYTES, REPLY_BYTES = 4 << 20, 32 << 20

#: Hashes in a hash partition: the lesser number up to PARTS partitions, then as
#: many as keep to PARTS, then the greater number.  So a block's share of a
#: partition stays worth a row, and a partition fits a task, at every size.
PART_HASHES, PARTS = (1 << 18, 1 << 23), 1024

_ANCHOR_SEED, _WINDOW_SEED, _SECOND_SEED = 11, 12, 13
_NULL_ID = np.iinfo(np.int64).min
_BLOCK = "block long, ids binary, known binary, counts binary, words binary, n_words long"


def partitions(hashes: int) -> int:
    each = min(max(hashes // PARTS, PART_HASHES[0]), PART_HASHES[1])
    return max(1, -(-hashes // each))


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """Documents in blocks, each in the order of doc_id (null first)."""
    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        held.sort(key=lambda d: d[0])
        words = words_of([d[2] for d in held])
        row = [
            task << 32 | made,
            np.array([d[0] for d in held], np.int64).tobytes(),
            np.array([d[1] for d in held], bool).tobytes(),
            words.counts.tobytes(),
            zstandard.ZstdCompressor(level=3).compress(words.buffer.tobytes()),
            len(words.starts),
        ]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], _names(_BLOCK))

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for doc, text in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if held and size + len(text or b"") > BLOCK_BYTES:
                yield flush()
                made, held, size = made + 1, [], 0
            held.append((_NULL_ID if doc is None else doc, doc is not None, text))
            size += len(text or b"") + 64
    if held:
        yield flush()


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class Block:
    block: int
    ids: np.ndarray
    known: np.ndarray
    words: Words

    @classmethod
    def read(cls, row: dict) -> Block:
        counts = np.frombuffer(row["counts"], np.int64)
        buffer = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["words"]), np.uint8)
        ends = np.flatnonzero(buffer == 32)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        first = np.concatenate(([0], np.cumsum(counts)))
        return cls(row["block"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), Words(buffer, starts, ends, first))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchors and their first words."""
        w = self.words
        n = len(w.starts) - ANCHOR + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        owner = w.owner()
        local = np.arange(n) - w.first[owner[:n]]
        at = np.flatnonzero(np.isin(local % PERIOD, COVER) & (owner[:n] == owner[ANCHOR - 1 :]))
        return w.hashes(at, at + ANCHOR - 1, _ANCHOR_SEED), at

    def candidates(self, bits: dict[int, bytes], parts: int) -> np.ndarray:
        """First words of the windows with an anchor that occurs elsewhere or twice here."""
        hashes, at = self.anchors()
        distinct, place, times = np.unique(_by_part(hashes, parts), return_inverse=True, return_counts=True)
        repeated = (times > 1) | _unpack(distinct, bits, parts)
        w = self.words
        n = len(w.starts)
        near = spread(np.maximum(at[repeated[place]] - (PERIOD - 1), 0), PERIOD, n) if len(at) else np.zeros(n, bool)
        owner = w.owner()
        whole = owner[: max(0, n - WINDOW + 1)] == owner[WINDOW - 1 :]
        return np.flatnonzero(near[: len(whole)] & whole)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 16 bits of hash of the windows from the words `at` on, by independent
        halves of the words' hashes: of n distinct windows, two share all 80 bits with a
        chance below n^2 / 2^81, one in 2,000 for the 3e10 windows of a terabyte."""
        first = self.words.hashes(at, at + WINDOW - 1, _WINDOW_SEED)
        return first, (self.words.hashes(at, at + WINDOW - 1, _SECOND_SEED) >> np.uint64(48)).astype(np.uint16)


def _by_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition in the upper bits, 40 bits of hash below."""
    return (hashes >> np.uint64(40)) % np.uint64(parts) << np.uint64(40) | hashes & np.uint64((1 << 40) - 1)


def _ranges(sorted_keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(partition, from, to) of keys made by _by_part, sorted."""
    cuts = np.searchsorted(sorted_keys >> np.uint64(40), np.arange(parts + 1))
    for part in range(parts):
        if cuts[part + 1] > cuts[part]:
            yield part, int(cuts[part]), int(cuts[part + 1])


def _unpack(distinct: np.ndarray, bits: dict[int, bytes], parts: int) -> np.ndarray:
    out = np.zeros(len(distinct), bool)
    for part, a, b in _ranges(distinct, parts):
        out[a:b] = np.unpackbits(np.frombuffer(bits[part], np.uint8), count=b - a).astype(bool)
    return out


def _rows(batches) -> Iterator[tuple[Block, dict]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield Block.read(row), row


def _bits(row: dict, name: str) -> dict[int, bytes]:
    return {r["part"]: r["bits"] for r in row[name] or ()}


_SENT = "part int, block long, hashes binary, second binary, owner binary, ids binary"
_SENT_KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 4]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _SENT_KINDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SENT_KINDS, strict=True)], _names(_SENT))


def _low40(keys: np.ndarray) -> bytes:
    return keys.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from40(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _send_anchors(batches, parts):
    for block, _ in _rows(batches):
        keys = np.unique(_by_part(block.anchors()[0], parts))
        yield _sent([(part, block.block, _low40(keys[a:b]), None, None, None) for part, a, b in _ranges(keys, parts)])


def _replies(table: pa.Table, wanted: list[np.ndarray], flags: np.ndarray) -> pa.Table:
    """One packed row of flags for each sender."""
    cuts = np.cumsum([len(w) for w in wanted])[:-1]
    split = np.split(flags, cuts)
    return pa.table([table.column("block"), table.column("part"), pa.array([np.packbits(f).tobytes() for f in split], pa.binary()), pa.array([int(f.sum()) for f in split], pa.int64())], names=["block", "part", "bits", "set"])


def _answer_anchors(table: pa.Table) -> pa.Table:
    sent = [_from40(b) for b in table.column("hashes").to_pylist()]
    _, place, times = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    return _replies(table, sent, times[place] > 1)


def _ordered_windows(block: Block, bits: dict[int, bytes], parts: tuple[int, int]):
    """The candidate windows' first words and, for each distinct window in the
    order sent: key, hash parts and the place of its first occurrence.  `parts`
    are the partitions of anchors and of windows."""
    at = block.candidates(bits, parts[0])
    full, second = block.windows(at)
    order = np.lexsort((second, full, _by_part(full, parts[1]) >> np.uint64(40)))
    f, s = full[order], second[order]
    fresh = np.concatenate(([True], (f[1:] != f[:-1]) | (s[1:] != s[:-1]))) if len(f) else np.zeros(0, bool)
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return at, group, f[fresh], s[fresh], order[fresh]


def _send_windows(batches, parts):
    for block, row in _rows(batches):
        at, _, full, second, lead = _ordered_windows(block, _bits(row, "anchor_bits"), parts)
        owner = block.words.owner()[at[lead]]
        rows = []
        for part, a, b in _ranges(_by_part(full, parts[1]) & ~np.uint64((1 << 40) - 1), parts[1]):
            docs, index = np.unique(owner[a:b], return_inverse=True)
            rows.append((part, block.block, full[a:b].tobytes(), second[a:b].tobytes(), index.astype(np.uint32 if len(docs) > 65535 else np.uint16).tobytes(), block.ids[docs].tobytes()))
        yield _sent(rows)


def _answer_windows(table: pa.Table) -> pa.Table:
    full, second, docs, blocks = [], [], [], []
    for row in table.to_pylist():
        ids = np.frombuffer(row["ids"], np.int64)
        full.append(np.frombuffer(row["hashes"], np.uint64))
        second.append(np.frombuffer(row["second"], np.uint16))
        docs.append(ids[np.frombuffer(row["owner"], np.uint32 if len(ids) > 65535 else np.uint16)])
        blocks.append(np.full(len(docs[-1]), row["block"], np.int64))
    f, s = np.concatenate(full), np.concatenate(second)
    order = np.lexsort((np.concatenate(blocks), np.concatenate(docs), s, f))
    f, s = f[order], s[order]
    owns = np.empty(len(order), bool)
    owns[order] = np.concatenate(([True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])))
    return _replies(table, full, owns)


def _finish(batches, parts):
    for block, row in _rows(batches):
        at, group, full, _, lead = _ordered_windows(block, _bits(row, "anchor_bits"), parts)
        owned = _unpack(_by_part(full, parts[1]) & ~np.uint64((1 << 40) - 1), _bits(row, "window_bits"), parts[1])
        keep = np.zeros(len(at), bool)
        keep[lead[owned]] = True
        w = block.words
        gone = spread(at[~keep], WINDOW, len(w.starts)) if len(at) else np.zeros(len(w.starts), bool)
        total = np.concatenate(([0], np.cumsum(gone)))
        raw = w.buffer.tobytes()
        cols = [[], [], [], []]
        for k in range(len(block.ids)):
            a, b = int(w.first[k]), int(w.first[k + 1])
            removed = int(total[b] - total[a])
            edges = np.flatnonzero(np.diff(np.concatenate(([1], gone[a:b], [1])).astype(np.int8))) + a
            text = b" ".join(raw[w.starts[x] : w.ends[y - 1]] for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
            for col, value in zip(cols, (int(block.ids[k]) if block.known[k] else None, b - a, removed, text.decode()), strict=True):
                col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.large_string() if len(raw) > 1 << 30 else pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_text"])


def _with_bits(blocks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """Blocks with their replies.  Replies are bits; they are broadcast while
    their measured size allows, and joined by a shuffle beyond that."""
    size = replies.agg(F.sum(F.octet_length("bits") + 32)).first()[0] or 0
    each = replies.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias(name))
    return blocks.join(F.broadcast(each) if size <= REPLY_BYTES else each, "block", "left")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words left, one space
    between them) of every row of `docs` (doc_id, text).

    Null and empty texts have no words and an empty kept_text.  Rows with equal
    doc_id count as separate documents, in an order that depends on how the input
    is split into tasks; a null doc_id comes before all others.  An id that is no
    integer is an error.  Other columns are ignored."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("documents are ordered by doc_id, which must be an integer")
    blocks = materialise(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _blocks, _BLOCK))
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = partitions(total * len(COVER) // PERIOD)

    def answered(sent: DataFrame, n: int, f) -> DataFrame:
        # As many tasks as partitions, so that a task's share does not grow with the input.
        return materialise(sent.repartition(n, "part").groupBy("part").applyInArrow(f, "block long, part int, bits binary, set long"))

    first = answered(map_batches(blocks, lambda b: _send_anchors(b, parts), _SENT), parts, _answer_anchors)
    # Between repeated anchors lie at most PERIOD windows for len(COVER) anchors.
    repeated = first.agg(F.sum("set")).first()[0] or 0
    both = (parts, partitions(repeated * PERIOD // len(COVER)))
    seen = _with_bits(blocks, first, "anchor_bits")
    second = answered(map_batches(seen, lambda b: _send_windows(b, both), _SENT), both[1], _answer_windows)
    return map_batches(_with_bits(seen, second, "window_bits"), lambda b: _finish(b, both), "doc_id long, n_words long, n_removed long, kept_text string")


def passage_digest(docs: DataFrame) -> DataFrame:
    out = dedup_passages(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
