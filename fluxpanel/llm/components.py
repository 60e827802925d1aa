"""Connected components by alternating large and small stars (Kiveris et al.,
Connected Components in MapReduce and Beyond): all joins and partial
aggregations, in a number of rounds logarithmic in the size of a component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialise

#: Edges up to which components are found within one task, some 50 MB of it.
LOCAL_EDGES = 500_000


def _in_one_task(batches):
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(2))
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, label = place[: len(u)], place[len(u) :], np.arange(len(ids))
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not (label[label] == label).all():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): of each node of `edges` (u, v) the smallest node it is
    connected with.  Loops, repeated and reversed edges change nothing; nodes
    without an edge to another are absent."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    e, was = materialise(e.distinct()), None
    if e.count() <= LOCAL_EDGES:
        return e.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least neighbours are written before the join, so that a centre with any
        # share of the edges is split between tasks: the join stands alone.
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct())
        root = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        before, e = e, materialise(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        discard(before, large, least, root)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == was or not now[0]:
            break
        was = now
    # Stars: every node but the centre has one edge, to the centre.
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
