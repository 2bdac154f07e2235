"""Language of a text: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are the runs of one to four letters of a text's words, a word's edge counting as a letter. Each
is hashed to a row of an embedding table; a text is the mean of its rows. Table and softmax are trained
together by stochastic gradient descent in numpy, on a bounded sample. As everything up to the softmax
is linear, tasks only need the product of the two: one number for each bucket and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, slices

#: Labelled texts drawn at most, in equal parts of each language as far as there are (rare ones are kept whole).
SAMPLE = 2000
#: Buckets (a power of two), components of an embedding, letters of a subword.
BITS, WIDTH, GRAMS = 14, 16, (1, 2, 3, 4)
#: Passes over the sample, texts of a step, first step width.
EPOCHS, BATCH, RATE = 20, 32, 5.0
#: Share of the sample that calibrates, and how many of the accepted texts must be right there.
HELD, PRECISION = 0.2, 0.99
#: Characters of a text that are worked on at once.
BLOCK = 1 << 19
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for what is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[codes], codes, 0).astype(np.uint64)


def subwords(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and starts of all subwords of each length. Only their first or last letter may be a word's edge (0)."""
    for n in GRAMS:
        count = len(codes) - n + 1
        if count < 1:
            continue
        hashed = np.full(count, n, np.uint64)
        fine = codes[:count] > 0 if n == 1 else (codes[:count] > 0) | (codes[1 : count + 1] > 0)
        for j in range(n):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + count] * np.uint64(0xC2B2AE3D27D4EB4F)
            if 0 < j < n - 1:
                fine = fine & (codes[j : j + count] > 0)
        start = np.nonzero(fine)[0]
        hashed = hashed[start]
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield (hashed >> np.uint64(64 - BITS)).astype(np.int64), start


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all subwords and the number of their text, in pieces of about ``BLOCK`` characters.

    Pieces of a long text overlap, so that each subword is seen once, whole.
    """
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0

    def done() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes, rows = np.concatenate(held), np.concatenate(owner)
        for bucket, start in subwords(codes):
            yield bucket, rows[start]

    edge, overlap = np.zeros(1, np.uint64), max(GRAMS) - 1
    for i, text in enumerate(texts):
        codes = np.concatenate([edge, _codes(text), edge])
        if len(codes) > BLOCK:
            # A subword belongs to the piece that it starts in.
            for at in range(0, len(codes), BLOCK):
                for bucket, start in subwords(codes[at : at + BLOCK + overlap]):
                    bucket = bucket[start < BLOCK]
                    yield bucket, np.full(len(bucket), i)
            continue
        held.append(codes)
        owner.append(np.full(len(codes), i))
        size += len(codes)
        if size > BLOCK:
            yield from done()
            held, owner, size = [], [], 0
    if held:
        yield from done()


@dataclass
class LanguageModel:
    """Learned values, ``logits`` (buckets by languages, already scaled by the temperature), and the score that is accepted."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    accept: float

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities by text and language, and whether the text has a letter."""
        total = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        for bucket, row in blocks([t or "" for t in texts]):
            count += np.bincount(row, minlength=len(texts))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(row, weights=self.logits[k][bucket], minlength=len(texts))
        z = total / np.maximum(count, 1)[:, None] + self.bias
        return _softmax(z), count > 0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), 1 << BITS), np.float32)
    for row, (bucket, share) in zip(out, rows, strict=True):
        row[bucket] = share
    return out


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str], seed: int = 11) -> LanguageModel:
    """Gradient descent on the cross-entropy, in shuffled steps of ``BATCH``; the last fifth of the sample calibrates.

    ``features`` are buckets with their share of a text's subwords. Languages weigh alike. The
    temperature has the least cross-entropy on the texts held back; of the scores at which the texts held
    back are right to ``PRECISION``, the lowest is accepted (with none held back, every score).
    """
    rng, n = np.random.default_rng(seed), len(features)
    order = rng.permutation(n)
    fit, check = order[: n - int(n * HELD)], order[n - int(n * HELD) :]
    table = (rng.standard_normal((1 << BITS, WIDTH)) / WIDTH).astype(np.float32)
    weight, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    often = np.bincount(labels[fit], minlength=len(langs))
    care = (len(fit) / np.maximum(often, 1) / max((often > 0).sum(), 1)).astype(np.float32)
    steps, step = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            part = fit[at : at + BATCH]
            x, y = _dense([features[i] for i in part]), labels[part]
            mean = x @ table
            slope = _softmax(mean @ weight + bias).astype(np.float32)
            slope[np.arange(len(part)), y] -= 1
            slope *= care[y][:, None] / len(part)
            rate = np.float32(RATE * (1 - step / steps))
            down = slope @ weight.T
            weight -= rate * (mean.T @ slope)
            bias -= rate * slope.sum(axis=0) * np.float32(0.01)
            used = np.nonzero(x.any(axis=0))[0]
            table[used] -= rate * (x[:, used].T @ down)
            step += 1
    logits = (table @ weight).astype(np.float64)
    heat, accept = 1.0, 0.0
    if len(check):
        z = np.array([share @ logits[bucket] for bucket, share in (features[i] for i in check)]) + bias
        y = labels[check]
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        heat = min(np.geomspace(0.05, 20, 121), key=loss)
        p = _softmax(z / heat)
        best = p.max(axis=1)
        down_from = np.argsort(-best, kind="stable")
        right = np.cumsum((p.argmax(axis=1) == y)[down_from]) / np.arange(1, len(y) + 1)
        good = np.nonzero(right >= PRECISION)[0]
        accept = float(best[down_from[good[-1]]]) if len(good) else 1.0
    return LanguageModel(langs, np.ascontiguousarray((logits / heat).T), (bias / heat).astype(np.float64), accept)


def held_out(key: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for null ids."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """A model of the languages of ``docs``; None if no row teaches one.

    Rows with a null id, text or language, without a letter, or held out do not teach. Of the distinct
    others at most ``sample`` are drawn: by turns one of each language, in the order of a hash. Rows that are
    equal in id, text and language count once. The driver holds the drawn texts' features, 2^BITS for
    each at most.
    """
    spark = docs.sparkSession
    mark = F.xxhash64(key, text)
    able = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(key)).select(F.col(lang).alias("lang"), mark.alias("mark"), F.col(text).alias("text"))
    keys = able.select("lang", "mark").distinct()
    turns = keys.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("mark"), "mark"))).where(F.col("rank") <= sample)
    drawn = turns.orderBy("rank", F.xxhash64("lang"), "lang").limit(sample).select("lang", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(2).to_pylist()
            parts = [np.unique(row << BITS | bucket, return_counts=True) for bucket, row in blocks(texts)]
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([c for _, c in parts]))
            ends = np.searchsorted(keys, np.arange(len(texts) + 1) << BITS)
            spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            buckets = [(keys[i:j] & (1 << BITS) - 1).astype(np.uint16).tobytes() for i, j in spans]
            shares = [(counts[i:j] / max(counts[i:j].sum(), 1)).astype(np.float32).tobytes() for i, j in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], ["lang", "mark", "buckets", "shares"])

    whole = able.join(F.broadcast(drawn), ["lang", "mark"]).dropDuplicates(["lang", "mark"])  # no more rows than the sample
    rows = sorted(whole.select("lang", "mark", "text").mapInArrow(run, "lang string, mark long, buckets binary, shares binary").collect(), key=lambda r: (r["lang"], r["mark"]))
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    features = [(np.frombuffer(r["buckets"], np.uint16).astype(np.int64), np.frombuffer(r["shares"], np.float32)) for r in rows]
    return train(features, np.array([langs.index(r["lang"]) for r in rows]), langs)


def identify_language(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """All columns but ``text``, with ``lang_pred``, ``score`` (its calibrated probability) and ``lang_accepted``.

    Null texts and texts without a letter, and all if nothing was learned, are ``und`` with score 0 and not
    accepted. Others get the most likely learned language; the score says how sure it is, and
    ``lang_accepted`` whether that is enough. Added names are made longer where the input has them. Texts
    are read whole, in pieces if very long; repeated rows stay.
    """
    spark = docs.sparkSession
    names = []
    for name in ("lang_pred", "score", "lang_accepted"):
        names.append(free_name(docs, name))
    keep = [f for f in docs.schema if f.name != text]
    given = docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col(f"`{text}`").alias("_text"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, "_text"):
            langs, best, sure = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if model is not None:
                p, lettered = model.scores(batch.column(len(keep)).to_pylist())
                best = np.where(lettered, p.max(axis=1), 0.0)
                langs = [model.langs[i] if ok else UNKNOWN for i, ok in zip(p.argmax(axis=1), lettered, strict=True)]
                sure = lettered & (best >= model.accept)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(best), pa.array(sure)], [*(f.name for f in keep), *names])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return given.mapInArrow(run, f"{fields}{names[0]} string, {names[1]} double, {names[2]} boolean")
