"""The trie of conversation prefixes, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is named by its depth and by the sum (xor) of one
128-bit digest a turn, which holds the turn's place, role and text; such sums need no order and no
whole conversation in one task, so a conversation of very many turns is summed block by block.

Subtree totals go up by time-forward processing. Conversations are dealt into shards; a node belongs
to the shard of its smallest member, and the shard also holds the path to the root of each of its
conversations. Spark sorts a shard externally by reverse level order; one pass then takes what was
sent to the node at hand from a priority queue, adds the node's own values and sends the sum to its
parent. The queue writes sorted runs to the shared folder when it grows. What the shards know of the
nodes that several of them share is added up across shards at the end. Levels are cut into bands:
the roots of a deeper band send their totals to the next one.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, saved, shared_dir

#: Levels of one band, turns of one shard (both bound a task), and messages a queue holds in memory.
BAND, SHARD, HELD = 50_000, 200_000, 200_000
#: Messages of a block of a run, runs of a queue before they are joined, characters of a piece of an id list.
BLOCK, RUNS, PIECE = 8192, 32, 1 << 16
#: Words of a text: everything between ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "s1", "s2"]


class SpillingQueue:
    """A priority queue of equally long integer tuples, smallest first; sorted runs go to ``folder`` beyond ``held`` of them.

    A run is read back block by block. Beyond ``RUNS`` runs these are joined into one.
    """

    def __init__(self, folder: str, held: int = HELD):
        self.folder, self.held = folder, held
        self.heap: list[tuple] = []
        self.runs: list[tuple[tuple, int, Iterator[tuple]]] = []
        self.paths: list[tuple[fs.FileSystem, str]] = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            if len(self.runs) >= RUNS:
                self._write(self._drain())
            self._write(iter(sorted(self.heap)))
            self.heap = []

    def _write(self, items: Iterator[tuple]) -> None:
        store, folder = fs.FileSystem.from_uri(self.folder)
        store.create_dir(folder, recursive=True)
        path = f"{folder}/{uuid.uuid4().hex}"
        writer = None
        with store.open_output_stream(path) as out:
            while block := list(islice(items, BLOCK)):
                batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*block, strict=True)], [str(i) for i in range(len(block[0]))])
                writer = writer or pa.ipc.new_stream(out, batch.schema)
                writer.write_batch(batch)
            if writer is not None:
                writer.close()
        self.paths.append((store, path))
        self._open(self._read(store, path))

    @staticmethod
    def _read(store: fs.FileSystem, path: str) -> Iterator[tuple]:
        with store.open_input_stream(path) as given, pa.ipc.open_stream(given) as blocks:
            for batch in blocks:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def _open(self, run: Iterator[tuple]) -> None:
        first = next(run, None)
        if first is not None:
            heapq.heappush(self.runs, (first, id(run), run))

    def _drain(self) -> Iterator[tuple]:
        runs, self.runs = self.runs, []
        return heapq.merge(*([x] for x, _, _ in runs), *(r for _, _, r in runs)) if runs else iter(())

    def top(self) -> tuple | None:
        """The smallest item, which stays."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, run = heapq.heappop(self.runs)
            self._open(run)
            return item
        return heapq.heappop(self.heap)

    def close(self) -> None:
        """Removes the files; those of lost tasks go with the folder."""
        self.heap, self.runs = [], []
        for store, path in self.paths:
            store.delete_file(path)
        self.paths = []


def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", scratch: list | None = None) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, d1, d2, words)``, the turns of each conversation numbered from 1, and ``(conv_id, n)``, how many it has.

    Order: turn (null first), then a digest of role and text; null roles and texts are empty. Repeated
    rows are turns of their own. Rows without a conversation id belong to none. Texts do not go through a
    shuffle. A conversation may fill many partitions: rows are dealt by ranges, and what stands in earlier
    ranges is added to the place inside one. Tables that may go once the result is written are added to
    ``scratch``.
    """
    said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), half(1).alias("d1"), half(16).alias("d2"), F.regexp_count(said[1], F.lit(WORDS)).cast("long").alias("words"))
    order = [F.asc_nulls_first("turn"), F.asc("d1"), F.asc("d2"), F.asc("tie")]
    dealt = saved(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    if scratch is not None:
        scratch.append(dealt)
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("ahead", ahead).where("ahead > 0").select("conv_id", "part", "ahead")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).cast("long")
    placed = dealt.withColumn("inside", inside).join(before, ["conv_id", "part"], "left")
    out = placed.select("conv_id", (F.col("inside") + F.coalesce("ahead", F.lit(0))).alias("pos"), "d1", "d2", "words")
    return out, counts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def shared_heads(rows: DataFrame, convs: DataFrame, group: int = 20, most: int = 4, scratch: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first of their ``group`` ids, h being crc32(id) modulo ``most``.

    The others follow after their own first h. The remainder has the sign of the id, as in SQL. Returns ``(conv_id, depth, d1, d2, words, size)`` and
    ``(conv_id, size)``; a conversation may be left without turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    known = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("given"))
    plan = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(known, "base", "left")
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    plan = saved(plan.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    if scratch is not None:
        scratch.append(plan)
    own = rows.join(plan.select("conv_id", "h", "taken", "size"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "d1", "d2", "words", "size")
    first = rows.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "d1", "d2", "words")
    lent = plan.where("taken > 0").join(first, "base").where("depth <= taken").select("conv_id", "depth", "d1", "d2", "words", "size")
    return own.union(lent), plan.select("conv_id", "size")


def prefix_trie(rows: DataFrame, convs: DataFrame, band: int = BAND, shard: int = SHARD, held: int = HELD) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``rows(conv_id, depth, d1, d2, words, size)`` are turns by place, ``convs(conv_id, size)`` all
    conversations. ``conv_id`` is the smallest member of the node, ``saved_tokens`` what its subtree
    saves if each node's last text is kept once, ``ends_sha256`` the digest of the ids that end there.
    Without conversations there is no node; conversations without turns are members of the root.
    """
    spark = rows.sparkSession
    whole = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("size").alias("deepest"), F.sum("size").alias("turns")).first()
    deepest, top = whole["deepest"] or 0, whole["least"]
    scratch: list[DataFrame] = []
    rows = saved(_prefixes(rows, deepest, band, scratch))
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), (F.max("size") == F.col("depth")).alias("leaf"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("deepest")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in NODE), "conv_id", "n_convs", zero.alias("words"), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")), (F.col("deepest") == 0).alias("leaf"))
    nodes = saved(nodes.union(root))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(whole["turns"] or 0) // shard))
    totals = _subtree_totals(rows, nodes, max(-(-deepest // band), 1), band, parts, held, scratch)
    summed = totals.groupBy(*NODE).agg(*(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")))
    # The children of the root are told its conversation; no join meets that one key.
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id")).where("depth > 1")
    inner = nodes.where("depth > 1").join(above, ["depth", "p1", "p2"])
    outer = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top).cast("long")))
    named = saved(inner.select(*NODE, "conv_id", "parent_conv_id", "n_convs").union(outer.select(*NODE, "conv_id", "parent_conv_id", "n_convs")))
    ended = rows.where("depth = size").select(*NODE, "conv_id").union(convs.where("size = 0").select(*(zero.alias(c) for c in NODE), "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    out = named.join(summed, NODE, "left").join(_id_digests(ended), NODE, "left")
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", *(F.coalesce(c, zero).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    result = saved(out)
    dropped(rows, nodes, named, *scratch)
    return result


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", heads: tuple[int, int] | None = None, **how) -> DataFrame:
    """``prefix_trie`` of a table of turns; with ``heads`` (ids of a group, turns below which they share) of ``shared_heads``.

    ``turn_rows`` says what nulls, ties and repeated rows give; other columns are not looked at.
    """
    scratch: list[DataFrame] = []
    rows, convs = turn_rows(conversations, conv, turn, role, text, scratch)
    if heads:
        rows, convs = shared_heads(rows, convs, *heads, scratch)
    else:
        rows, convs = rows.join(convs, "conv_id").select("conv_id", F.col("pos").alias("depth"), "d1", "d2", "words", F.col("n").alias("size")), convs.withColumnRenamed("n", "size")
    out = prefix_trie(rows, convs, **how)
    dropped(*scratch)
    return out


def _prefixes(rows: DataFrame, deepest: int, band: int, scratch: list) -> DataFrame:
    """Turns with the name of their node (``s1``, ``s2``) and of its parent (``p1``, ``p2``)."""
    tag = lambda seed: F.xxhash64(F.lit(seed), F.col("d1"), F.col("d2"), F.col("depth"))
    block = F.expr(f"(depth - 1) DIV {int(band)}")
    given = rows.select("conv_id", "depth", "words", "size", tag(1).alias("g1"), tag(2).alias("g2"), block.alias("block"))
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = given.select("*", *(F.bit_xor(f"g{i}").over(upto).alias(f"s{i}") for i in (1, 2)))
    if deepest > band:
        given = saved(given)
        scratch.append(given)
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = given.groupBy("conv_id", "block").agg(F.bit_xor("g1").alias("t1"), F.bit_xor("g2").alias("t2"))
        ahead = blocks.select("conv_id", "block", F.bit_xor("t1").over(earlier).alias("a1"), F.bit_xor("t2").over(earlier).alias("a2")).where("block > 0")
        named = given.select("*", *(F.bit_xor(f"g{i}").over(upto).alias(f"l{i}") for i in (1, 2))).join(ahead, ["conv_id", "block"], "left")
        named = named.withColumns({f"s{i}": F.col(f"l{i}").bitwiseXOR(F.coalesce(f"a{i}", F.lit(0))) for i in (1, 2)})
    return named.select("conv_id", "depth", "words", "size", "s1", "s2", *(F.col(f"s{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)))


def _subtree_totals(rows: DataFrame, nodes: DataFrame, bands: int, band: int, parts: int, held: int, scratch: list) -> DataFrame:
    """What each shard knows of a node: ``(depth, s1, s2, n_leaves, saved_tokens, n_children)``; the sum over shards is the node's total."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    shard = F.pmod(F.xxhash64("conv_id"), F.lit(parts)).cast("long")
    fields = [*NODE, "p1", "p2"]
    zero = F.lit(0).cast("long")
    values: list[Column] = [F.col("leaf").cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), zero.alias("n_children"), F.lit(1).cast("long").alias("own")]
    given = nodes.select(shard.alias("shard"), *fields, *values).union(rows.select(shard.alias("shard"), *fields, *[zero] * 4))
    done: list[DataFrame] = []
    sent = None
    for at in reversed(range(bands)):
        low, high = at * band, (at + 1) * band
        part = given.where(F.col("depth").between(low + 1 if at else 0, high))
        if sent is not None:
            part = part.union(sent.select("shard", *NODE, F.lit(None).cast("long"), F.lit(None).cast("long"), "n_leaves", "saved_tokens", "n_children", zero))

        def run(batches: Iterator[pa.RecordBatch], low: int = low) -> Iterator[pa.RecordBatch]:
            yield from _time_forward(batches, low, SpillingQueue(folder, held))

        ordered = part.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("depth"), "s1", "s2")
        out = saved(ordered.mapInArrow(run, "up boolean, shard long, depth long, s1 long, s2 long, n_leaves long, saved_tokens long, n_children long"))
        scratch.append(out)
        done.append(out.where("not up").select(*NODE, "n_leaves", "saved_tokens", "n_children"))
        sent = out.where("up")
    _remove(spark, folder)
    total = done[0]
    for more in done[1:]:
        total = total.union(more)
    return total


def _remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _time_forward(batches: Iterator[pa.RecordBatch], low: int, queue: SpillingQueue) -> Iterator[pa.RecordBatch]:
    """Rows in reverse level order -> totals of each node that are not zero, and (``up``) messages for the band above ``low``.

    A queue item is (shard, -depth, s1, s2, leaves, saved, children). A message for a node without a row
    here, such as the root of another shard, is this shard's whole share of the node.
    """
    out: list[tuple] = []

    def flushed(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least and out:
            kinds = [pa.bool_(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["up", "shard", *NODE, "n_leaves", "saved_tokens", "n_children"])
            out.clear()

    def settle(key: tuple, node: list) -> None:
        """``node``: parent and values summed over the rows of ``key``; its messages are in the queue."""
        p1, p2, leaves, saved_tokens, children, own = node
        while (head := queue.top()) is not None and head[:4] == key:
            _, _, _, _, a, b, c = queue.pop()
            leaves, saved_tokens, children = leaves + a, saved_tokens + b, children + c
        shard, depth = key[0], -key[1]
        if leaves or saved_tokens or children:
            out.append((False, shard, depth, key[2], key[3], leaves, saved_tokens, children))
        if p1 is not None and (leaves or saved_tokens or own):
            if depth == low + 1 and low:
                out.append((True, shard, depth - 1, p1, p2, leaves, saved_tokens, own))
            else:
                queue.push((shard, 1 - depth, p1, p2, leaves, saved_tokens, own))

    def orphans(before: tuple | None) -> None:
        """Messages for nodes that have no row here."""
        while (head := queue.top()) is not None and (before is None or head[:4] < before):
            settle(head[:4], [None, None, 0, 0, 0, 0])

    key, node = None, None
    try:
        for batch in batches:
            for shard, depth, s1, s2, p1, p2, leaves, saved_tokens, children, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (shard, -depth, s1, s2):
                    if key is not None:
                        settle(key, node)
                    key, node = (shard, -depth, s1, s2), [None, None, 0, 0, 0, 0]
                    orphans(key)
                if p1 is not None:
                    node[0], node[1] = p1, p2
                node[2], node[3], node[4], node[5] = node[2] + leaves, node[3] + saved_tokens, node[4] + children, node[5] + own
            yield from flushed(BLOCK)
        if key is not None:
            settle(key, node)
        orphans(None)
        yield from flushed(1)
    finally:
        queue.close()


def _id_digests(ended: DataFrame) -> DataFrame:
    """``(depth, s1, s2, ends_sha256)``: SHA-256 of the ids that end at a node, ascending, joined by commas.

    Ids are sorted in ranges and written as pieces of text first, so that the one task that reads a
    node's digest off sees few rows, piece after piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, first, ids, size = None, 0, [], 0
        for batch in batches:
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (now != key or size > PIECE):
                    out.append((*key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = now, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(out) >= 1024:
                yield _rows(out, 4, ["first", "ids"])
                out = []
        if ids:
            out.append((*key, first, ",".join(ids)))
        if out:
            yield _rows(out, 4, ["first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield _rows(out, 3, ["ends_sha256"])
        if key is not None:
            yield _rows([(*key, state.hexdigest())], 3, ["ends_sha256"])

    cut = ended.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    cut = cut.mapInArrow(pieces, "depth long, s1 long, s2 long, first long, ids string")
    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth long, s1 long, s2 long, ends_sha256 string")


def _rows(rows: list[tuple], numbers: int, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64() if i < numbers else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
    return pa.RecordBatch.from_arrays(columns, [*NODE, *names])
