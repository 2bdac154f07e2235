"""Connected components of a link table, and links inside keyed groups that may be very large.

Everything stays in DataFrames: minima are pre-aggregated before each shuffle, and the joins back
are plain equi-joins that adaptive execution can split where one node has very many links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, saved, whole_groups


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)`` with component one id of those reachable, the same for all of them.

    Each round moves every node to one of its neighbours or itself, the first by a hash, and keeps the
    distinct links between the places so reached, until none is left. A star takes two rounds and a
    chain loses about half of its nodes in each, as hashes know nothing of the order of ids. The moves
    are then followed from the last round back. A round's moves are saved before the links meet them, so that adaptive execution can split the
    links of a node that has very many. Nodes without a link to another node do not appear; loops and
    repeated rows are harmless.
    """
    now = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not now.isEmpty():
        first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        both = now.union(now.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(first("b")).alias("m")).select(F.col("a").alias("id"), F.least("m", first("a"))["to"].alias("to"))
        moves.append(saved(nearest))
        left, right = moves[-1].toDF("a", "_a"), moves[-1].toDF("b", "_b")
        ends = now.join(left, "a").join(right, "b").where("_a <> _b")
        new = saved(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        dropped(now)
        now = new
    if not moves:
        return now.toDF("id", "component")
    dropped(now)
    named = moves.pop().toDF("id", "component")
    for step in reversed(moves):
        last = named.toDF("to", "component")
        named = saved(step.join(last, "to", "left").select("id", F.coalesce("component", "to").alias("component")))
    return named


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """A forest over the rows of a symmetric boolean matrix: each row beside the smallest of its component."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return [(i, int(x)) for i, x in enumerate(label) if x != i]
        label = low


#: (left table, right table or None for left against itself) -> index pairs that connect all linked rows.
Kernel = Callable[[pa.Table, pa.Table | None], list[tuple[int, int]]]


def links_in_groups(rows: DataFrame, kernel: Kernel, block: int) -> DataFrame:
    """Links ``(a, b)`` that connect, within each ``key``, all rows the kernel finds linked.

    ``rows`` has ``key``, ``n`` (rows of the key), ``id`` (binary) and payload columns; it should be a
    saved table, as it is read twice. Keys of up to ``block`` rows are one group. Larger keys are dealt
    into salted blocks; after the blocks' own links are joined up, only rows outside the largest
    component of their key still need comparing, and they meet every block of the key, block by block.
    No pair of different components is left uncompared, and no task holds more than two blocks.
    """
    blocks = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    dealt = rows.where("n > 1").withColumn("part", F.when(F.col("n") <= block, 0).otherwise(F.pmod(F.xxhash64("id"), blocks)).cast("int"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["key", "part"]):
            if group.num_rows > 1:
                yield _edges(group, None, kernel)

    grouped = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    first = saved(grouped.mapInArrow(within, "a binary, b binary").distinct())
    hot = dealt.where(F.col("n") > block)
    if hot.isEmpty():
        return first
    labels = connected_components(first)
    named = hot.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    most = named.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("most"))
    named = saved(named.join(most, "key").withColumn("own", F.col("component") == F.col("most")).drop("most"))
    stray = named.where("not own")
    if stray.isEmpty():
        return first
    strays = stray.groupBy("key").agg(F.count("*").alias("strays"))
    counted = named.join(strays, "key").withColumn("lots", F.ceil(F.col("strays") / F.lit(float(block))).cast("int"))
    right = counted.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).withColumn("side", F.lit(1))
    left = counted.where("not own").withColumn("lot", F.pmod(F.xxhash64("id", F.lit(7)), F.col("lots")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(0))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["key", "part", "lot"]):
            side = np.asarray(group.column("side"))
            if 0 < side.sum() < len(side):
                yield _edges(group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1)), kernel)

    met = left.unionByName(right).repartition("key", "part", "lot").sortWithinPartitions("key", "part", "lot", "side")
    return first.union(met.mapInArrow(across, "a binary, b binary").distinct())


def _edges(left: pa.Table, right: pa.Table | None, kernel: Kernel) -> pa.RecordBatch:
    pairs = kernel(left, right)
    a, b = left.column("id").to_pylist(), (left if right is None else right).column("id").to_pylist()
    return pa.RecordBatch.from_arrays([pa.array([a[i] for i, _ in pairs], pa.binary()), pa.array([b[j] for _, j in pairs], pa.binary())], ["a", "b"])
