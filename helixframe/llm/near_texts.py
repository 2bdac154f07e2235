"""Near-duplicate texts by DartMinHash signatures, banded joining and exact verification.

Every element of a weighted set owns an endless, hashed sequence of darts over its weight axis. A set
keeps the darts that land below an element's weight and before a limit on their rank, and in each of
``COORDINATES`` coordinates the earliest. Two sets agree in a coordinate with a chance equal to
their weighted Jaccard similarity, and the work is in proportion to darts, not to coordinates times
elements. A shingle weighs 1 plus the logarithm of its count in the text. Rows whose signatures agree
in a band become candidates; candidates are joined up by the share of agreeing coordinates, and the
clusters so found are verified on their shingles.

Equal texts are one class from the start. No stage emits all pairs of a group: groups give forests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, links_in_groups, spanning_links
from .shared import dropped, free_name, saved, slices

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 28, 5
COORDINATES = BANDS * ROWS
#: Share of agreeing coordinates from which candidates are joined into one cluster (SIMILAR less over four standard deviations).
AGREE = 0.64
#: Rows compared at once, by signatures and by shingles.
BLOCK, EXACT_BLOCK = 256, 128
REMEMBERED = 250_000
MIX1, MIX2, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        out = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return out


@cache
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of ``words`` words (lower case, split at white space) and their counts.

    A text of fewer words is one shingle; one without words has none.
    """
    known = _word_hashes()
    if len(known) > REMEMBERED:
        known.clear()
    parts = (text or "").lower().split()
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    if not len(h):
        return h, np.zeros(0)
    span = min(words, len(h))
    out = np.zeros(len(h) - span + 1, np.uint64)
    for i in range(span):
        out = mixed(out * np.uint64(STEP) + h[i : len(h) - span + 1 + i])
    found, counts = np.unique(out, return_counts=True)
    return found, counts.astype(np.float64)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def dart_signatures(elements: list[np.ndarray], weights: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """Earliest darts of each non-empty set, one 64-bit name for each coordinate.

    The weight axis of an element is cut into regions [0, 1), [1, 2), [2, 4), ... with a Poisson
    sequence of darts each, so that a set only looks at regions below its weights and thinning by
    weight keeps signatures consistent between sets. Sets with an empty coordinate double their
    limit on rank and throw on.
    """
    n = len(elements)
    out = np.zeros((n, coordinates), np.uint64)
    limits = np.array([coordinates * (np.log(coordinates) + 2) / w.sum() for w in weights])
    todo = np.arange(n)
    while len(todo):
        best = np.full(len(todo) * coordinates, np.inf)
        names = np.zeros(len(todo) * coordinates, np.uint64)
        element = np.concatenate([elements[i] for i in todo])
        weight = np.concatenate([weights[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(elements[i]) for i in todo])
        limit, low, width, region = limits[todo], 0.0, 1.0, 0
        while len(element):
            seed = mixed(element + np.uint64((region + 1) * STEP % (1 << 64)))
            rank, own, heavy, dart = np.zeros(len(seed)), owner, weight, seed
            while len(dart):
                dart = mixed(dart + np.uint64(STEP))
                rank = rank - np.log(_uniform(dart)) / width
                soon = rank < limit[own]
                rank, own, heavy, dart = rank[soon], own[soon], heavy[soon], dart[soon]
                place = mixed(dart ^ np.uint64(MIX1))
                hit = low + width * _uniform(mixed(dart ^ np.uint64(MIX2))) < heavy
                at = own[hit] * coordinates + (place[hit] % np.uint64(coordinates)).astype(np.int64)
                r = rank[hit]
                order = np.argsort(-r, kind="stable")
                at, r = at[order], r[order]
                better = r < best[at]
                at, r = at[better], r[better]
                # Ranks fall along the arrays: of several darts in one coordinate the earliest is written last.
                best[at], names[at] = r, dart[hit][order][better]
            low, width = low + width, width * (1 if region == 0 else 2)
            region += 1
            more = weight > low
            element, weight, owner = element[more], weight[more], owner[more]
        full = np.isfinite(best.reshape(len(todo), coordinates)).all(axis=1)
        out[todo[full]] = names.reshape(len(todo), coordinates)[full]
        todo = todo[~full]
        limits[todo] *= 2
    return out


def damped(counts: np.ndarray) -> np.ndarray:
    """Weights of shingles by their counts in a text."""
    return 1 + np.log(counts)


def _signed(docs: DataFrame, text: str) -> DataFrame:
    """Signature rows: the class of the text, its bands (64-bit keys) and one byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = [shingles(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            at = [i for i, (s, _) in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            brief: list = [None] * len(sets)
            if at:
                darts = dart_signatures([sets[i][0] for i in at], [damped(sets[i][1]) for i in at])
                keys = np.zeros((len(at), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mixed(keys * np.uint64(STEP) + darts[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
                small = (mixed(darts) & np.uint64(255)).astype(np.uint8)
                for k, i in enumerate(at):
                    bands[i], brief[i] = keys[k].view(np.int64), small[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("cls"), pa.array(bands, pa.list_(pa.int64())), pa.array(brief, pa.binary())], ["_key", "cls", "bands", "sig"])

    kind = docs.schema["_key"].dataType.simpleString()
    return docs.mapInArrow(run, f"_key {kind}, cls binary, bands array<long>, sig binary")


def _agreeing(left: pa.Table, right: pa.Table | None) -> list[tuple[int, int]]:
    """Kernel of ``links_in_groups`` on signatures."""
    matrix = lambda t: np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    a = matrix(left)
    b = a if right is None else matrix(right)
    same = np.stack([(row == b).mean(axis=1) for row in a]) >= AGREE
    if right is None:
        return spanning_links(same)
    return _first_links(same)


def _first_links(same: np.ndarray) -> list[tuple[int, int]]:
    """Enough pairs of a left-by-right matrix to connect all that it connects."""
    n = len(same)
    whole = np.zeros((n + same.shape[1],) * 2, bool)
    whole[:n, n:], whole[n:, :n] = same, same.T
    group = {}
    for x, low in spanning_links(whole):
        group.setdefault(low, [low]).append(x)
    out = []
    for members in group.values():
        inside = np.array(sorted(members))
        lefts, rights = inside[inside < n], inside[inside >= n] - n
        # Breadth first over the component: each newly reached row gives one pair.
        seen_l, seen_r, front = {int(lefts[0])}, set(), [int(lefts[0])]
        while front:
            reached = []
            for i in front:
                for j in rights[same[i, rights]].tolist():
                    if j not in seen_r:
                        seen_r.add(j)
                        out.append((i, j))
                        for k in lefts[same[lefts, j]].tolist():
                            if k not in seen_l:
                                seen_l.add(k)
                                out.append((k, j))
                                reached.append(k)
            front = reached
    return out


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether the Jaccard similarity of two sets of shingles, plain or weighted, is ``SIMILAR`` or more."""
    sizes = [(len(a[0]), len(b[0])), (a[1].sum(), b[1].sum())]
    if all(min(pair) < SIMILAR * max(pair) for pair in sizes):
        return False
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = (len(i), np.minimum(a[1][i], b[1][j]).sum())
    return any(own >= SIMILAR * (sum(pair) - own) * (1 - 1e-12) for pair, own in zip(sizes, shared, strict=True))


def _similar(left: pa.Table, right: pa.Table | None) -> list[tuple[int, int]]:
    """Kernel of ``links_in_groups`` on whole shingle sets: pairs that are ``alike``, as a forest."""
    n = left.num_rows
    sets = []
    for table in (left, right) if right is not None else (left,):
        for names, counts in zip(table.column("set").to_pylist(), table.column("counts").to_pylist(), strict=True):
            sets.append((np.frombuffer(names, np.uint64), damped(np.frombuffer(counts, np.uint32)).astype(np.float32)))
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(n):
        for j in range(i + 1 if right is None else n, len(sets)):
            a, b = top(i), top(j)
            if a != b and alike(sets[i], sets[j]):
                root[max(a, b)] = min(a, b)
                out.append((i, j if right is None else j - n))
    return out


def near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, _cls, _component, class_id, kept, copies)``: one row for each distinct key and text.

    Texts are linked if the Jaccard similarity of their five-word shingles is at least 0.8, weighted by
    damped counts or as plain sets (the same where no shingle repeats);
    ``class_id`` is the smallest key that links and equal texts reach, ``kept`` marks the row of that
    key, and ``copies`` counts the input rows of the key and text. ``_cls`` is the md5
    of the text, ``_component`` a digest that all of its group share.

    Texts without words (null, empty, blank) are linked only with texts equal to them, null counting
    as empty. A null key is never the smallest unless all of its class are null. Very long texts are
    used whole. A key named like one of the other columns returned gets an underscore behind its name.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(F.col(key).alias("_key"), F.unhex(F.md5(body)).alias("cls"), body.alias("_text"))
    signed = saved(_signed(given, "_text"))
    rows = signed.groupBy("_key", "cls").agg(F.count("*").alias("copies"))
    classes = saved(signed.groupBy("cls").agg(F.min("_key").alias("low"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))

    banded = classes.where("bands IS NOT NULL").select(F.explode("bands").alias("key"), F.col("cls").alias("id"))
    # Saved, as are the smallest keys below: joins of a table with its own totals can then be split.
    shared = saved(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = saved(banded.join(shared, "key").join(classes.select(F.col("cls").alias("id"), "sig"), "id").select("key", "n", "id", "sig"))
    clusters = saved(connected_components(links_in_groups(members, _agreeing, BLOCK)))
    dropped(shared, members)

    # The texts of clusters once more, each class by one of its rows, as whole shingle sets.
    sizes = saved(clusters.groupBy("component").agg(F.count("*").alias("n")))
    wanted = clusters.join(sizes, "component").join(classes.select(F.col("cls").alias("id"), "low"), "id")
    texts = given.join(wanted, (F.col("cls") == F.col("id")) & F.col("_key").eqNullSafe(F.col("low"))).select(F.col("component").alias("key"), "n", "id", "_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [(names.tobytes(), counts.astype(np.uint32).tobytes()) for names, counts in map(shingles, batch.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), batch.column("id"), *(pa.array([f[k] for f in found], pa.binary()) for k in (0, 1))], ["key", "n", "id", "set", "counts"])

    exact = saved(texts.mapInArrow(sets, "key binary, n long, id binary, set binary, counts binary").dropDuplicates(["id"]))
    dropped(clusters, sizes)
    linked = connected_components(links_in_groups(exact, _similar, EXACT_BLOCK))

    named = classes.select("cls", "low").join(linked, F.col("cls") == F.col("id"), "left").withColumn("component", F.coalesce("component", "cls"))
    named = saved(named.select("cls", "low", "component"))
    dropped(exact)
    lows = saved(named.groupBy("component").agg(F.min("low").alias("class_id")))
    known = named.join(lows, "component").select("cls", F.col("component").alias("_component"), "class_id")
    out = rows.join(known, "cls")
    own = key + "_" if key.lower() in ("_cls", "_component", "class_id", "kept", "copies") else key
    return out.select(F.col("_key").alias(own), F.col("cls").alias("_cls"), "_component", "class_id", F.col("_key").eqNullSafe(F.col("class_id")).alias("kept"), "copies")


def without_near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The input less all but one row of each group of near-duplicates; all columns are kept.

    The row with the smallest key stays; of several rows with that key one of those with the smallest
    text digest does. Texts without words go only if they repeat.
    """
    own, cls = free_name(docs, "_key"), free_name(docs, "_cls")
    found = near_duplicates(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k", "t")
    found = saved(found.select(F.col("k").alias(own), F.col("_cls").alias(cls), "_component", "kept", "copies"))
    first = saved(found.where("kept").groupBy("_component").agg(F.min(cls).alias("_first")))
    marked = found.join(first, "_component").withColumn("kept", F.col("kept") & (F.col(cls) == F.col("_first"))).where("not kept or copies > 1")
    gone = free_name(docs, "_gone")
    marked = saved(marked.select(own, cls, (~F.col("kept")).alias(gone)))
    same = F.col(key).eqNullSafe(F.col(own)) & (F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))) == F.col(cls))
    # Always by a merge join: the texts are shuffled once at any size, and nothing that grows is broadcast.
    out = docs.join(marked.hint("merge"), same, "left_anti")
    repeated = marked.where(~F.col(gone))
    if repeated.isEmpty():
        return out
    return out.union(docs.join(repeated, same).dropDuplicates([own, cls]).select(*docs.columns))
