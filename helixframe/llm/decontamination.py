"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment.

If a passage of m characters occurs in a text with at most k edits, text and passage share at least
m + 1 - q (k + 1) q-grams whose diagonals (text position less passage position) differ by at most k.
Diagonals are cut into overlapping bands wide enough that such a set lies in one of them; bands with
that many shared q-grams are kept and verified by an alignment limited to their diagonals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import dropped, free_name, saved, slices

Q = 8
#: Edits allowed for each character of a passage, and the shortest passage that is searched with edits: one edit leaves two
#: runs, of which one has Q characters.
RATE, LEAST = 0.1, 2 * Q
#: Characters of passages in one block of the index (about 16 bytes of index each), and blocks that a worker holds at once.
PASS_CHARS, HELD = 2_000_000, 4
#: Bits of the first test of a q-gram.
TABLE_BITS = 22
#: Pairs of equal q-grams that are looked at together (about 50 bytes each).
TOGETHER = 4_000_000
HITS = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType())]))


def folded(text: str) -> str:
    """Lower case, each white-space character a space; character for character."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """32-bit hashes of all q-grams, doubling their length step by step."""
    h, base, length = codes, 0x9E3779B1, 1
    while length < Q:
        h = h[:-length] * np.uint32(base) + h[length:]
        base, length = base * base % (1 << 32), length * 2
    return h ^ (h >> np.uint32(15))


@dataclass
class Passages:
    """The q-gram index of a bounded set of passages."""

    ids: list[int]
    texts: list[str]

    def __post_init__(self):
        grams = [_grams(_codes(t)) for t in self.texts]
        sizes = np.array([len(t) for t in self.texts])
        self.sizes, self.edits = sizes, np.minimum((sizes * RATE).astype(np.int64), (sizes - Q) // Q)
        self.least = sizes + 1 - Q * (self.edits + 1)
        self.band = self.edits + 1
        self.masks: dict[int, dict[str, int]] = {}
        self.halves: tuple[Passages, Passages] | None = None
        hashes = np.concatenate(grams)
        order = np.argsort(hashes, kind="stable")
        self.item = np.repeat(np.arange(len(sizes)), [len(g) for g in grams])[order]
        self.at = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.known, self.first = np.unique(hashes[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(hashes)))
        self.table = np.zeros(1 << TABLE_BITS, np.bool_)
        self.table[hashes >> np.uint32(32 - TABLE_BITS)] = True

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each folded text the (passage, begin, end, edits) found: of each passage the place of
        fewest edits, of those that are found the earliest."""
        return [[(self.ids[t], begin, end, edits) for t, (edits, begin, end) in sorted(best.items())] for best in self._best(texts)]

    def _best(self, texts: list[str]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text {passage: (edits, begin, end)}.

        Where equal q-grams would make more than ``TOGETHER`` pairs, the texts are halved, then a
        single text is cut into windows that overlap by the longest place, then the passages are.
        """
        lengths = np.array([len(t) + 1 for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        codes = _codes("\0".join(texts))
        if len(codes) < Q:
            return [{} for _ in texts]
        hashes = _grams(codes)
        places = np.nonzero(self.table[hashes >> np.uint32(32 - TABLE_BITS)])[0]
        found = np.minimum(np.searchsorted(self.known, hashes[places]), len(self.known) - 1)
        real = self.known[found] == hashes[places]
        places, found = places[real], found[real]
        doc = np.searchsorted(starts, places, side="right") - 1
        # A text with too few known q-grams for any passage goes no further.
        enough = np.bincount(doc, minlength=len(texts)) >= self.least.min()
        keep = enough[doc]
        places, found, doc = places[keep], found[keep], doc[keep]
        total = int(self.many[found].sum())
        reach = int((self.sizes + self.edits).max()) + Q
        if total > TOGETHER and len(texts) > 1:
            half = len(texts) // 2
            return self._best(texts[:half]) + self._best(texts[half:])
        if total > TOGETHER and len(texts[0]) > 4 * reach:
            middle = len(texts[0]) // 2
            first, second = self._best([texts[0][: middle + reach]])[0], self._best([texts[0][middle:]])[0]
            for t, (edits, begin, end) in second.items():
                first[t] = min(first.get(t, (len(texts[0]) + 1, 0, 0)), (edits, begin + middle, end + middle))
            return [first]
        if total > TOGETHER and len(self.texts) > 1:
            half = len(self.texts) // 2
            if self.halves is None:
                self.halves = Passages(self.ids[:half], self.texts[:half]), Passages(self.ids[half:], self.texts[half:])
            first, second = (part._best(texts)[0] for part in self.halves)
            return [first | {t + half: place for t, place in second.items()}]
        return self._together(texts, lengths, starts, places, found, doc)

    def _together(self, texts: list[str], lengths: np.ndarray, starts: np.ndarray, places: np.ndarray, found: np.ndarray, doc: np.ndarray) -> list[dict[int, tuple[int, int, int]]]:
        """``_best`` by way of all pairs of equal q-grams at once."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        many = self.many[found]
        total = int(many.sum())
        if not total:
            return out
        entry = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
        item, doc, place = self.item[entry], np.repeat(doc, many), np.repeat(places, many)
        both = doc * len(self.sizes) + item
        _, which, shared = np.unique(both, return_inverse=True, return_counts=True)
        keep = shared[which] >= self.least[item]
        entry, item, doc, place, both = entry[keep], item[keep], doc[keep], place[keep], both[keep]
        diagonal = place - starts[doc] - self.at[entry] + self.sizes[item]
        wide = self.band[item]
        low = diagonal // wide
        # Bands overlap by half: each diagonal lies in two.
        key = np.concatenate([both, both]) * (int(lengths.max() + self.sizes.max()) + 2) + np.concatenate([low, low - 1]) + 1
        keys, at, counts = np.unique(key, return_index=True, return_counts=True)
        at = at % len(item)
        good = counts >= self.least[item[at]]
        span = int(lengths.max() + self.sizes.max()) + 2
        for one, i in zip(keys[good].tolist(), at[good].tolist(), strict=True):
            d, t = int(doc[i]), int(item[i])
            if out[d].get(t, (1, 0, 0))[0] == 0:
                continue
            left = (one % span - 1) * int(self.band[t]) - int(self.sizes[t])
            match = self._verified(texts[d], t, left, left + 2 * int(self.band[t]))
            if match and (t not in out[d] or match < out[d][t]):
                out[d][t] = match
        return out

    def _within(self, region: str, t: int, k: int) -> bool:
        """Whether the passage occurs anywhere in ``region`` with at most ``k`` edits (bit-parallel columns)."""
        passage = self.texts[t]
        if t not in self.masks:
            own = self.masks[t] = {}
            for i, c in enumerate(passage):
                own[c] = own.get(c, 0) | 1 << i
        places, full, high = self.masks[t], (1 << len(passage)) - 1, 1 << len(passage) - 1
        up, down, score = full, 0, len(passage)
        for c in region:
            equal = places.get(c, 0)
            across = (((equal & up) + up) ^ up) | equal
            plus, minus = down | (full & ~(across | up)), up & across
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
                if score <= k:
                    return True
            plus, minus, across = plus << 1 & full, minus << 1 & full, equal | down
            up, down = minus | (full & ~(across | plus)), plus & across
        return score <= k

    def _verified(self, text: str, t: int, low: int, high: int) -> tuple[int, int, int] | None:
        """Fewest edits of passage ``t`` within the diagonals, with its place, or None if over the budget."""
        passage, k = self.texts[t], int(self.edits[t])
        low, high = low - k, high + k
        begin, end = max(0, low), min(len(text), high + len(passage))
        region = text[begin:end]
        exact = region.find(passage)
        if exact >= 0:
            return 0, begin + exact, begin + exact + len(passage)
        if not self._within(region, t, k):
            return None
        # cost[d]: fewest edits that end on diagonal low + d after the rows so far; start[d]: where it began.
        width, codes = high - low + 1, _codes(text)
        steps = np.arange(width)
        far = len(passage) + 1
        cost = np.where((steps + low >= 0) & (steps + low <= len(text)), 0, far)
        start = steps + low
        for row, c in enumerate(_codes(passage), 1):
            column = steps + low + row  # characters of the text used
            inside = (column >= 1) & (column <= len(text))
            same = np.zeros(width, bool)
            same[inside] = codes[column[inside] - 1] == c
            diagonal = np.where(inside, cost + ~same, far)
            above = np.append(cost[1:] + 1, far)  # the passage's character is left out
            above = np.where((column >= 0) & (column <= len(text)), above, far)
            new = np.minimum(diagonal, above)
            begun = np.where(diagonal <= above, start, np.append(start[1:], 0))
            # A character of the text is left out: costs run to the right.
            slid = new - steps
            low_run = np.minimum.accumulate(slid)
            source = np.maximum.accumulate(np.where(slid == low_run, steps, 0))
            cost, start = low_run + steps, begun[source]
        at = int(np.argmin(np.where((steps + low + len(passage) >= 0) & (steps + low + len(passage) <= len(text)), cost, far)))
        if cost[at] > k:
            return None
        return int(cost[at]), int(start[at]), int(at + low + len(passage))


class Short:
    """Passages too short for any edit under the lemma, found exactly and between word boundaries.

    Each is looked up by its longest word, at the places of that word in a text; one without any word
    is searched as it stands.
    """

    WORD = re.compile(r"\w+")

    def __init__(self, items: list[tuple[int, str]]):
        self.by_word: dict[str, list[tuple[int, str, int]]] = {}
        self.plain: list[tuple[int, str]] = []
        for i, passage in items:
            word = max(self.WORD.finditer(passage), key=lambda m: len(m[0]), default=None)
            if word is None:
                self.plain.append((i, passage))
            else:
                self.by_word.setdefault(word[0], []).append((i, passage, word.start()))

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each folded text the (passage, begin, end, 0) found: the first place of each passage."""
        out = []
        for text in texts:
            found = {(i, p): at for i, p in self.plain if (at := text.find(p)) >= 0}
            for m in self.WORD.finditer(text) if self.by_word else ():
                for i, passage, offset in self.by_word.get(m[0], ()):
                    at = m.start() - offset
                    if (i, passage) not in found and at >= 0 and text.startswith(passage, at) and self._apart(text, passage, at):
                        found[i, passage] = at
            out.append([(i, at, at + len(p), 0) for (i, p), at in sorted(found.items())])
        return out

    def _apart(self, text: str, passage: str, at: int) -> bool:
        """Whether no word of the text runs on over either end of the passage."""
        end, word = at + len(passage), self.WORD.match
        before = at > 0 and word(passage[0]) and word(text[at - 1])
        return not before and not (end < len(text) and word(passage[-1]) and word(text[end]))


def find_passages(df: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, keep: list[str] | None = None) -> DataFrame:
    """Adds ``hits``: for each row the benchmark items found in its text, as (item, begin, end, edits).

    A passage is found where it occurs, apart from case and kind of white space, with at most
    ``RATE`` edits for each of its characters; ``begin`` and ``end`` are character positions of its
    best place. Whole texts are searched.

    The edits are those for which the lemma asks for a shared q-gram, one from 16
    characters, two from 24, three from 32. Items shorter than ``LEAST`` characters, for which it allows none, are
    found as they stand (but for case and kind of white space), between word boundaries, at their first place.

    Null and empty texts have no hits. Items that are null or nothing but white space are not searched;
    items of equal text are all reported. Repeated rows are searched each. ``keep`` names
    the input columns to return (default all); a clashing added name ends in an underscore.

    The benchmark is a stated query set of any size: it passes through the driver in blocks of
    ``PASS_CHARS`` characters, of which ``HELD`` are broadcast at a time and held against all rows.
    For a larger benchmark the rows and what was found in them are saved before the next blocks.
    """
    spark = df.sparkSession
    name = free_name(df, "hits")
    columns = keep if keep is not None else df.columns
    held = df.select(*dict.fromkeys([*columns, text]), F.array().cast(HITS).alias(name))
    blocks = _passes(benchmark, item, item_text)
    source: DataFrame | None = None
    while part := list(islice(blocks, HELD)):
        if source is not None:
            table = saved(held)
            sent.destroy()
            if source is not df:
                dropped(source)
            held, source = table, table
        else:
            source = df
        sent = spark.sparkContext.broadcast(part)
        held = held.mapInArrow(partial(_with_hits, sent, text, name), held.schema)
    return held.select(*columns, name)


def _with_hits(sent: Broadcast, text: str, name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the hits of some blocks added to those they have."""
    for batch in slices(batches, text):
        texts = [folded(x) if x else "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        at = batch.schema.get_field_index(name)
        hits = batch.column(at).to_pylist()
        for block in sent.value:
            for own, found in zip(hits, block.search(texts), strict=True):
                own += [dict(zip(("item", "begin", "end", "edits"), h, strict=True)) for h in found]
        yield batch.set_column(at, name, pa.array(hits, HIT_TYPE))


HIT_TYPE = pa.list_(pa.struct([("item", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def _passes(benchmark: DataFrame, item: str, item_text: str) -> Iterator[Passages | Short]:
    """The benchmark in runs of at most ``PASS_CHARS`` characters (a longer item stands alone)."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    short: list[tuple[int, str]] = []
    short_held = 0
    for row in benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL").distinct().toLocalIterator():
        if len(row["t"]) < LEAST:
            if passage := folded(row["t"].replace("\0", " ")).strip():
                short.append((row["i"], passage))
                short_held += len(passage)
            if short_held > PASS_CHARS:
                yield Short(short)
                short, short_held = [], 0
            continue
        if texts and held + len(row["t"]) > PASS_CHARS:
            yield Passages(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row["i"])
        texts.append(folded(row["t"].replace("\0", " ")))
        held += len(row["t"])
    if texts:
        yield Passages(ids, texts)
    if short:
        yield Short(short)
