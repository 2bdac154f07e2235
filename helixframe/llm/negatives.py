"""Hard negatives among labelled vectors: exact integer scores by Strassen's multiplication, bounded heaps.

Anchors come in chunks of a bounded size. A chunk is broadcast and meets all rows tile by tile, twice:
first each task keeps the best rows of an anchor's own label, then, with the merged positives known,
the best rows of other labels in the window of each positive. What tasks keep is merged by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

#: Positives of an anchor, negatives of a positive, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, WINDOW = 5, 10, (30, 90)
#: Components are floor(SCALE * x).
SCALE = 256
#: Anchors and bytes of a chunk at most; anchors and rows of a tile.
CHUNK, CHUNK_BYTES, TILE = 16_384, 32 << 20, (1024, 2048)
#: Sides up to which matrices are multiplied directly.
LEAF = 32
#: Rows whose squared length is this or more could overflow 64 bits in the window's bounds.
LONGEST = 1 << 56
#: Below every score.
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices. Odd sides are padded with zeros; sums wrap, so a product that fits is exact."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return _direct(a, b)
    even = lambda x: np.pad(x, [(0, s % 2) for s in x.shape]) if any(s % 2 for s in x.shape) else x
    a, b = even(a), even(b)
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The plain product; in doubles where every partial sum is an integer that a double holds."""
    if a.size and b.size and a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of int32 components as int64, shorter ones padded with zeros."""
    parts = [np.frombuffer(x, np.int32) for x in packed]
    out = np.zeros((len(parts), max([width, *map(len, parts)])), np.int64)
    for row, part in zip(out, parts, strict=True):
        row[: len(part)] = part
    return out


def integer_rows(vectors: DataFrame, key: str, label: str, vector: str, flip: int = 7, labels: int = 10) -> DataFrame:
    """``(id, label, ints)``: each distinct valid row with packed integer components.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, and neither do
    those so long that scores could leave 64 bits (squared length of 2^56 after scaling). Every
    ``flip``-th id gets the next of ``labels`` labels. Repeated rows are one.
    """
    given = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    moved = F.when(F.col(key) % flip == 0, (F.col(label) + 1) % labels).otherwise(F.col(label))
    given = given.select(F.col(key).cast("long").alias("id"), moved.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            ends = np.asarray(column.offsets).tolist()
            flat = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)
            with np.errstate(all="ignore"):
                scaled = np.floor(flat * SCALE)
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(scaled) | (np.abs(scaled) >= 1 << 28))])
            packed: list[bytes | None] = []
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                ints = scaled[i:j].astype(np.int64) if bad[i] == bad[j] else None
                packed.append(None if ints is None or int((ints * ints).astype(object).sum() if j - i > 64 else (ints * ints).sum()) >= LONGEST else ints.astype(np.int32).tobytes())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "label", "ints"])
            yield out.filter(out.column(2).is_valid())

    return given.mapInArrow(run, "id long, label long, ints binary").distinct()


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and components of at most TILE[1] rows at a time, ids ascending."""
    for batch in batches:
        for at in range(0, batch.num_rows, TILE[1]):
            part = batch.slice(at, TILE[1])
            ids, labels = (part.column(i).to_numpy() for i in (0, 1))
            order = np.argsort(ids, kind="stable")
            yield ids[order], labels[order], _matrix(part.column(2).to_pylist(), width)[order]


class Chunk:
    """Anchors with ids, labels and components, and the positives' scores once they are known."""

    def __init__(self, rows: list):
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.ints = _matrix([bytes(r["ints"]) for r in rows], 0)
        self.positives = np.full((len(rows), POSITIVES), NONE)

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each tile: the anchors, ids, scores, whether labels are equal and whether it is the anchor's own row."""
        for ids, labels, ints in _tiles(batches, self.ints.shape[1]):
            for at in range(0, len(self.ids), TILE[0]):
                part = slice(at, at + TILE[0])
                mine = np.pad(self.ints[part], [(0, 0), (0, ints.shape[1] - self.ints.shape[1])])
                scores = strassen(mine, ints.T)
                same = labels[None, :] == self.labels[part][:, None]
                own = np.zeros(same.shape, bool)
                for i, j in np.argwhere((ids[None, :] == self.ids[part][:, None]) & same):
                    own[i, j] = np.array_equal(mine[i], ints[j])
                yield part, ids, scores, same, own


def _merge(scores: np.ndarray, ids: np.ndarray, more_scores: np.ndarray, more_ids: np.ndarray) -> None:
    """Keeps in place, along the last axis, the best of both: higher scores first, then smaller ids."""
    k = scores.shape[-1]
    s, i = np.concatenate([scores, more_scores], -1), np.concatenate([ids, more_ids], -1)
    order = np.lexsort((i, ~s), -1)[..., :k]
    scores[...], ids[...] = np.take_along_axis(s, order, -1), np.take_along_axis(i, order, -1)


def _best_positives(batches: Iterator[pa.RecordBatch], chunk: Chunk) -> Iterator[pa.RecordBatch]:
    scores, ids = (np.full((len(chunk.ids), POSITIVES), x) for x in (NONE, np.iinfo(np.int64).max))
    for part, tile_ids, found, same, own in chunk.scored(batches):
        found = np.where(same & ~own, found, NONE)
        k = min(POSITIVES, len(tile_ids))
        order = np.argsort(~found, 1, kind="stable")[:, :k]
        _merge(scores[part], ids[part], np.take_along_axis(found, order, 1), tile_ids[order])
    at = np.argwhere(scores > NONE)
    yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(scores[tuple(at.T)]), pa.array(ids[tuple(at.T)])], ["anchor", "score", "id"])


def _best_negatives(batches: Iterator[pa.RecordBatch], chunk: Chunk) -> Iterator[pa.RecordBatch]:
    known = chunk.positives > NONE
    least, most = WINDOW
    # The window in whole scores; none where there is no positive.
    low = np.where(known, -(-np.where(known, chunk.positives, 0) * least // 100), 1)
    high = np.where(known, np.where(known, chunk.positives, 0) * most // 100, 0)
    scores, ids = (np.full((*low.shape, NEGATIVES), x) for x in (NONE, np.iinfo(np.int64).max))
    for part, tile_ids, found, same, _ in chunk.scored(batches):
        found = np.where(same, NONE, found)
        order = np.argsort(~found, 1, kind="stable")  # best first, equal ones by id
        ranked = np.take_along_axis(found, order, 1)
        start = np.array([np.searchsorted(~r, ~h, "left") for r, h in zip(ranked, high[part], strict=True)])
        at = start[..., None] + np.arange(NEGATIVES)
        there = at < len(tile_ids)
        at = np.minimum(at, len(tile_ids) - 1)
        rows = np.arange(len(ranked))[:, None, None]
        picked, picked_ids = ranked[rows, at], tile_ids[order][rows, at]
        fit = there & (picked >= low[part][..., None]) & (picked > NONE)
        _merge(scores[part], ids[part], np.where(fit, picked, NONE), np.where(fit, picked_ids, np.iinfo(np.int64).max))
    at = np.argwhere(scores > NONE)
    yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(scores[tuple(at.T)]), pa.array(ids[tuple(at.T)])], ["anchor", "positive", "score", "id"])


def hard_negatives(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 100) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for anchors, the ids divisible by ``every``.

    An anchor's positives are the ``POSITIVES`` other rows of its label with the highest scores; the
    negatives of a positive are the ``NEGATIVES`` best rows of other labels whose score lies in the window
    of its own, bounds included (none for a negative score). Ties go to the smaller id. ``integer_rows``
    says which rows take part; vectors of different lengths are padded with zeros. Anchors without
    positives, and positives without negatives, give no row.
    """
    rows = saved(integer_rows(vectors, key, label, vector))
    spark, anchors = rows.sparkSession, rows.where(F.col("id") % every == 0)
    size = anchors.agg(F.count("*").alias("n"), F.max(F.length("ints")).alias("bytes")).first()
    chunks = max(-(-size["n"] // min(CHUNK, max(CHUNK_BYTES // (2 * (size["bytes"] or 1)), 1))), 1)
    best = lambda by, k: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")) <= k
    out: list[DataFrame] = []
    for at in range(chunks):
        # Driver and tasks hold one chunk of anchors at a time.
        chunk = Chunk(anchors.where(F.pmod(F.xxhash64("id", "label", "ints"), F.lit(chunks)) == at).collect())
        if not len(chunk.ids):
            continue
        sent = spark.sparkContext.broadcast(chunk)
        found = rows.mapInArrow(lambda b, sent=sent: _best_positives(b, sent.value), "anchor long, score long, id long")
        found = found.withColumn("best", best(["anchor"], POSITIVES)).where("best").select("anchor", "score", "id").collect()
        positive_ids = np.zeros(chunk.positives.shape, np.int64)
        place = [0] * len(chunk.ids)
        for anchor, score, other in sorted(found, key=lambda r: (r[0], -r[1], r[2])):
            chunk.positives[anchor, place[anchor]], positive_ids[anchor, place[anchor]] = score, other
            place[anchor] += 1
        again = spark.sparkContext.broadcast(chunk)
        met = rows.mapInArrow(lambda b, again=again: _best_negatives(b, again.value), "anchor long, positive long, score long, id long")
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= NEGATIVES)
        pairs = [(i, j, int(chunk.ids[i]), int(positive_ids[i, j]), int(chunk.positives[i, j])) for i in range(len(place)) for j in range(place[i])]
        named = spark.createDataFrame(pairs, "anchor long, positive long, anchor_id long, positive_id long, positive_score long")
        done = ranked.join(F.broadcast(named), ["anchor", "positive"])  # no more pairs than POSITIVES a chunk's anchor
        out.append(saved(done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result
