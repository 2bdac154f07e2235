"""Near-duplicates among embeddings through a pivot-permutation index.

Reference vectors (pivots) are chosen from a bounded sample, after its mean is taken off all vectors.
Every vector is described by its nearest pivots in order; the inverted lists are keyed by pairs of
those pivots, so that two vectors meet in a list exactly if they share two pivots or more. How many
pivots there are and how many describe a vector is fitted on the sample, so that vectors moved to the
smallest cosine of a link still meet. In each list, and in blocks where a list is long, cosines are
verified in double precision. A pair that meets in several lists is counted in the one of its two
smallest shared pivots. Equal vectors are one class and are never paired up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, spanning_links
from .shared import dropped, saved, whole_groups

#: The smallest cosine of a link.
COSINE = 0.95
#: Vectors drawn for choosing pivots, at most, by the order of a hash.
SAMPLE = 20_000
#: Nearest pivots that describe a vector: at least and at most.
PREFIX = (5, 8)
#: Pivots at most (they are broadcast), and the least that is tried.
MOST_PIVOTS, LEAST_PIVOTS = 8192, 16
#: Share of the pairs tried that must meet in a list, and how many are tried.
RECALL, TRIED = 0.995, 2000
#: Sample vectors that are compared with all others at once.
CHUNK = 100
#: Rows of a list that are compared at once; longer lists are compared block by block.
BLOCK = 1024


def _classes(df: DataFrame, vector: str) -> DataFrame:
    """Every row with ``_cls`` (digest of the vector, null if invalid) and ``_vec`` (its packed doubles)."""
    single = "float" in df.schema[vector].dataType.simpleString()
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            column = column.cast(pa.list_(column.type.value_type)) if not pa.types.is_list(column.type) else column
            # All components in one buffer (nulls become NaN), and before each place the zeros and bad ones so far.
            ends = np.asarray(column.offsets)
            flat = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=kind)
            bad, full = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(flat), flat != 0))
            fine = np.asarray(column.is_valid()) & (bad[ends[1:]] == bad[ends[:-1]]) & (full[ends[1:]] > full[ends[:-1]])
            flat = flat + kind(0)  # turns -0.0 into 0.0
            packed = [flat[i:j].tobytes() if ok else None for i, j, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), fine.tolist(), strict=True)]
            digests = [None if raw is None else hashlib.md5(raw).digest() for raw in packed]
            rest = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != vector]
            names = [n for n in batch.schema.names if n != vector]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], [*names, "_cls", "_vec"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != vector)
    return df.mapInArrow(run, f"{schema}, _cls binary, _vec binary")


def _unit(packed: list[bytes], width: int) -> np.ndarray:
    """Rows scaled to length 1, in doubles (scaled by the largest component first, against overflow)."""
    m = np.frombuffer(b"".join(packed), np.float32 if width == 4 else np.float64).astype(np.float64).reshape(len(packed), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


@dataclass
class Pivots:
    """The fitted index of one vector length: pivots (rows of length 1), the mean, and the pivots that describe a vector."""

    points: np.ndarray
    mean: np.ndarray
    prefix: int

    def nearest(self, units: np.ndarray) -> np.ndarray:
        """For each row the numbers of its nearest pivots, in ascending order."""
        order = np.argsort(-(_centred(units, self.mean) @ self.points.T), axis=1, kind="stable")
        return np.sort(order[:, : self.prefix], axis=1)


def _centred(units: np.ndarray, mean: np.ndarray) -> np.ndarray:
    moved = units - mean
    return moved / np.maximum(np.sqrt((moved * moved).sum(axis=1, keepdims=True)), 1e-12)


def _apart(rows: np.ndarray, most: int) -> np.ndarray:
    """The first rows that are not close to an earlier one; where these are few, others that differ."""
    chosen: list[int] = []
    for limit, wanted in ((0.8, most), (1 - 1e-9, min(most, LEAST_PIVOTS))):
        nearest = (rows @ rows[chosen].T).max(axis=1) if chosen else np.full(len(rows), -2.0)
        for i in range(len(rows)):
            if len(chosen) >= wanted:
                break
            if nearest[i] < limit:
                chosen.append(i)
                nearest = np.maximum(nearest, rows @ rows[i])
    return rows[chosen]


def fit_pivots(units: np.ndarray, pivots: int, cosine: float) -> Pivots:
    """Pivots of a sample: as many as asked for and as few nearest ones as let vectors at the smallest
    cosine of a link meet; where no number of nearest ones does, half as many pivots, and so on. Tried
    are pairs of the sample just above that cosine, and sample vectors with a copy moved to it."""
    mean = units.mean(axis=0)
    points = _apart(_centred(units, mean), pivots)
    tried = units[:TRIED]
    noise = np.random.default_rng(len(units)).normal(size=tried.shape)
    noise -= (noise * tried).sum(axis=1, keepdims=True) * tried
    noise /= np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-12)
    moved = cosine * tried + math.sqrt(max(1 - cosine * cosine, 0)) * noise
    close = []
    for at in range(0, len(tried), CHUNK):
        sims = tried[at : at + CHUNK] @ units.T
        i, j = np.nonzero((sims >= cosine) & (sims < cosine + (1 - cosine) / 5))
        close.append(np.stack([i + at, j], axis=1))
    close = np.concatenate(close)[:TRIED]
    pairs = [(tried, moved)] + ([(units[close[:, 0]], units[close[:, 1]])] if len(close) >= LEAST_PIVOTS else [])
    while True:
        for prefix in range(PREFIX[0], PREFIX[1] + 1):
            fitted = Pivots(points, mean, prefix)
            met = [(fitted.nearest(a)[:, :, None] == fitted.nearest(b)[:, None, :]).any(axis=2).sum(axis=1) >= 2 for a, b in pairs]
            if min(m.mean() for m in met) >= RECALL:
                return fitted
        if len(points) <= LEAST_PIVOTS:
            return fitted
        points = points[: max(LEAST_PIVOTS, len(points) // 2)]


def choose_pivots(classes: DataFrame, width: int, pivots: int, cosine: float = COSINE, sample: int = SAMPLE) -> dict[int, Pivots]:
    """The index of each vector length (in bytes) in a sample by the order of a hash."""
    drawn = classes.orderBy(F.xxhash64("_cls"), "_cls").select("_vec").limit(sample).toArrow().column("_vec").to_pylist()
    by_size: dict[int, list[bytes]] = {}
    for row in drawn:
        by_size.setdefault(len(row), []).append(row)
    return {size: fit_pivots(_unit(packed, width), pivots, cosine) for size, packed in by_size.items()}


def near_vectors(df: DataFrame, key: str, vector: str, cosine: float = COSINE, pivots: int | None = None, exact: bool = False, block: int = BLOCK) -> DataFrame:
    """``(key, n_links, component_id, kept)``: one row for each row of ``df``.

    Links join vectors of one length whose cosine is at least ``cosine``. ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest key reachable by links, itself included.
    Null vectors, zero vectors and such with null or non-finite components link with nothing; so do
    vectors of different lengths. Equal vectors link with each other. Rows that repeat a key are rows
    of their own; a null key is never the smallest unless all are null. Other columns are left out; a
    key named like a column returned gets an underscore behind its name.

    ``pivots`` defaults to half the square root of the number of distinct vectors, ``MOST_PIVOTS`` at
    most, which keeps the work on lists in proportion to the table. The pairs found are those that
    share two of their nearest pivots. ``exact`` leaves the index out and compares all distinct vectors
    of a length, block by block. Vectors whose length the sample lacks are compared so too.
    """
    given = df.select(F.col(key).alias("_key"), F.col(vector).alias("_given"))
    width = 4 if "float" in given.schema["_given"].dataType.simpleString() else 8
    rows = saved(_classes(given, "_given"))
    classes = saved(rows.where("_cls IS NOT NULL").groupBy("_cls").agg(F.first("_vec").alias("_vec"), F.count("*").alias("_size"), F.min("_key").alias("_low")))
    n = classes.count()
    wanted = pivots or min(max(LEAST_PIVOTS, math.ceil(math.sqrt(n) / 2)), MOST_PIVOTS)
    sent = df.sparkSession.sparkContext.broadcast(choose_pivots(classes, width, wanted, cosine) if n and not exact else {})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("_vec").to_pylist()
            lists: list[list[int]] = [[] for _ in vectors]
            near: list[list[int]] = [[] for _ in vectors]
            for size in set(map(len, vectors)):
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                base = size // width << 40
                if size not in sent.value or len(sent.value[size].points) < 2:
                    for i in at:
                        near[i], lists[i] = [0, 1], [base | 1]
                    continue
                for i, row in zip(at, sent.value[size].nearest(_unit([vectors[i] for i in at], width)).tolist(), strict=True):
                    near[i] = row
                    lists[i] = [base | a << 20 | b for a, b in combinations(row, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("_cls"), batch.column("_vec"), batch.column("_size"), pa.array(near, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int64()))], ["id", "vec", "size", "near", "lists"])

    described = saved(classes.select("_cls", "_vec", "_size").mapInArrow(describe, "id binary, vec binary, size long, near array<int>, lists array<long>"))
    members = described.select("id", "vec", "size", "near", F.explode("lists").alias("key"))
    # Saved, as are the smallest keys below: joins of a table with its own totals can then be split.
    lengths = saved(described.select(F.explode("lists").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = members.join(lengths, "key").withColumn("blocks", F.ceil(F.col("n") / F.lit(float(block))).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # A row of block b meets every block: the part (i, j) with i <= j holds the rows of both.
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "vec", "size", "near")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["key", "i", "j"]):
            if group.num_rows < 2:
                continue
            list_key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
            units = _unit(group.column("vec").to_pylist(), width)
            linked = units @ units.T >= cosine
            np.fill_diagonal(linked, False)
            if i != j:
                own = np.asarray(group.column("own"))
                linked &= own[:, None] != own[None, :]
            a, b = np.nonzero(linked)
            if not len(a):
                continue
            ids, size = group.column("id").to_pylist(), np.asarray(group.column("size"))
            near = np.array(group.column("near").to_pylist(), np.int64)
            # The two smallest shared pivots name the list in which the pair counts.
            shared = np.where((near[a][:, :, None] == near[b][:, None, :]).any(axis=2), near[a], 1 << 30)
            shared.sort(axis=1)
            here = (shared[:, 0] << 20 | shared[:, 1]) == (list_key & (1 << 40) - 1)
            counts = np.bincount(a[here], weights=size[b[here]], minlength=len(ids)).astype(np.int64)
            forest = spanning_links(linked)
            some = np.nonzero(counts)[0].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[x] for x, _ in forest] + [ids[x] for x in some], pa.binary()), pa.array([ids[y] for _, y in forest] + [None] * len(some), pa.binary()), pa.array([0] * len(forest) + counts[some].tolist(), pa.int64())],
                ["a", "b", "links"],
            )

    found = saved(members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(verify, "a binary, b binary, links long"))
    dropped(described, lengths)
    links = found.where("b IS NULL").groupBy(F.col("a").alias("_cls")).agg(F.sum("links").alias("_links"))
    joined = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("_cls", "_size", "_low").join(joined, F.col("_cls") == F.col("id"), "left").withColumn("component", F.coalesce("component", "_cls"))
    named = saved(named.select("_cls", "_size", "_low", "component"))
    lows = saved(named.groupBy("component").agg(F.min("_low").alias("_component")))
    known = named.join(lows, "component").join(links, "_cls", "left").select("_cls", (F.col("_size") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"), "_component")
    out = rows.select("_key", "_cls").join(known, "_cls", "left").select("_key", F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("_component", "_key").alias("_component"))
    own = key + "_" if key.lower() in ("n_links", "component_id", "kept") else key
    return out.select(F.col("_key").alias(own), F.col("_links").cast("long").alias("n_links"), F.col("_component").alias("component_id"), F.col("_key").eqNullSafe(F.col("_component")).alias("kept"))
