"""Document quality by co-training a text view and a metadata view.

Two logistic classifiers learn from the same labelled sample, one from the text alone and one from
the metadata alone. In each round both score all unlabelled documents; either takes those that it
ranks surest as good and as bad and hands them to the other. What a rank is worth is measured on labelled
documents that no view has learnt from: the share of the label among those ranked as high is the
label handed over, and its gain on the label's share overall is what the document counts, so that a
weak view hands over no more certainty than it has shown, and nothing where the gain is small. All documents are scored by the calibrated
log-odds of both views together.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, slices

#: Bound of the labelled sample, half of it for either label, taken by the order of a hash of the id.
LABELLED = 8_000
#: Rounds of co-training, and the documents that a view hands over for either label in each.
ROUNDS, HANDED = 3, 100
#: Times that the odds of a label, as held-out documents show them, must exceed its odds overall for a document to be
#: handed over, and the held-out documents at least that are looked at for that.
LIFT, SHOWN = 1.5, 20
SHAPES, PAIRS, PLACES = 12, 256, 64
TEXT_WIDTH = SHAPES + PAIRS
#: Parts in which the surest documents of all tasks are first ranked.
RANKED = 256
#: Rows that a fit holds as doubles at once.
CHUNK = 1024


def text_features(texts: list[str]) -> np.ndarray:
    """One row for each text: shape ratios, then square roots of character-pair shares in ``PAIRS`` buckets."""
    n = len(texts)
    lengths = np.array([len(t) for t in texts])
    shape = np.zeros((n, SHAPES))
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split("\n")
        count = max(len(words), 1)
        shape[i, :6] = (np.log1p(len(t)), np.log1p(len(words)), len(set(words)) / count, len(set(lines)) / len(lines), np.log1p(len(t) / count), sum(map(eq, words, words[1:])) / count)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    if len(codes):
        row = np.repeat(np.arange(n), lengths)
        share = lambda mask: np.bincount(row[mask], minlength=n) / np.maximum(lengths, 1)
        upper, digit, space = (codes >= 65) & (codes <= 90), (codes >= 48) & (codes <= 57), codes == 32
        sign = (codes < 128) & (codes > 32) & ~upper & ~digit & ~((codes >= 97) & (codes <= 122))
        same = np.zeros(len(codes), bool)
        same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
        for k, mask in enumerate((upper, digit, space, sign, codes == 10, same & sign), 6):
            shape[:, k] = share(mask)
        pair = (codes[:-1] * np.uint32(31) + codes[1:]) * np.uint32(0x9E3779B1) >> np.uint32(24)
        counts = np.bincount((row[:-1] * PAIRS + pair)[row[:-1] == row[1:]], minlength=n * PAIRS).reshape(n, PAIRS)
        pairs = np.sqrt(counts / np.maximum(lengths, 1)[:, None])
    else:
        pairs = np.zeros((n, PAIRS))
    return np.hstack([shape, pairs])


def metadata_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Language and source in hashed places, and the logarithm of the stated size in steps and as a number."""
    out = np.zeros((len(langs), 2 * PLACES + 13))
    for i, (lang, source, size) in enumerate(zip(langs, sources, sizes, strict=True)):
        out[i, zlib.crc32(f"lang {lang}".encode()) % PLACES] = 1
        out[i, PLACES + zlib.crc32(f"source {source}".encode()) % PLACES] = 1
        log = np.log1p(max(float(size or 0), 0.0))
        out[i, 2 * PLACES] = log
        out[i, 2 * PLACES + 1 + min(int(log), 11)] = 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, fitted by Newton steps over chunks of rows."""

    ridge: float = 1.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        """``y`` may lie anywhere between 0 and 1; ``weight`` says what each row counts (default 1)."""
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64)
        self.scale = np.where(self.scale > 1e-6, self.scale, np.inf)
        penalty = np.full(x.shape[1] + 1, self.ridge)
        penalty[0] = 1e-6
        w = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            curve, slope = np.diag(penalty + 1e-9), penalty * w
            for at in range(0, len(x), CHUNK):
                z = np.hstack([np.ones((len(x[at : at + CHUNK]), 1)), (x[at : at + CHUNK] - self.mean) / self.scale])
                p = _chance(z @ w)
                own = weight[at : at + CHUNK]
                curve += (z * (own * p * (1 - p))[:, None]).T @ z
                slope += z.T @ (own * (p - y[at : at + CHUNK]))
            step = np.linalg.solve(curve, slope)
            w = w - step
            if np.abs(step).max() < 1e-4:
                break
        self.weights = w
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[1:] + self.weights[0]


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


#: Gives the pool's surest documents under a model: features of both views, and for each row the view that chose it and the label it gives.
Choose = Callable[["CoTrained"], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class CoTrained:
    """Both views, their calibrations (slope, offset) and the log-odds of the labels.

    ``shift`` is added to the log-odds where the sample holds the labels in other shares than the
    table it was drawn from. ``handed`` has, for each round, how many documents either view has got
    from the other so far.
    """

    text: Logistic = field(default_factory=lambda: Logistic(5.0))
    metadata: Logistic = field(default_factory=lambda: Logistic(20.0))
    calibration: list[tuple[float, float]] = field(default_factory=list)
    ranks: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    prior: float = 0.0
    shift: float = 0.0
    handed: list[tuple[int, int]] = field(default_factory=list)

    def fit(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, choose: Choose | None = None, rounds: int = ROUNDS) -> CoTrained:
        """``y`` is 1, 0 or NaN; rows of NaN are the pool where ``choose`` gives none.

        Every fifth row of either label is kept for calibration; of a label with fewer than five rows the
        first one calibrates and teaches as well. Both labels must occur.
        """
        of = [np.nonzero(y == c)[0] for c in (0, 1)]
        held = np.concatenate([rows[::5] for rows in of])
        learn = np.sort(np.concatenate([rows if len(rows) < 5 else np.setdiff1d(rows, rows[::5]) for rows in of]))
        choose = choose or _chooser(text, meta, np.nonzero(np.isnan(y))[0])
        share = np.clip(y[held].mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(share / (1 - share)))
        x = [text[learn], meta[learn]]
        labels, weights = [y[learn], y[learn]], [np.ones(len(learn))] * 2
        at_hand = (text[held], meta[held])

        def refit() -> None:
            for v, view in enumerate((self.text, self.metadata)):
                view.fit(x[v], labels[v], weights[v])
            self.calibration = [self._calibrated(view, own, y[held]) for view, own in zip((self.text, self.metadata), at_hand, strict=True)]
            self.ranks = [_ranked(lift, y[held]) for lift in self.lifts(*at_hand)]

        refit()
        got = [0, 0]
        for _ in range(rounds):
            *more, view, chance = choose(self)
            for v in (0, 1):
                given = view == 1 - v
                x[v] = np.concatenate([x[v], more[v][given]])
                labels[v] = np.concatenate([labels[v], chance[given]])
                gain = np.maximum((chance[given] - share) / (1 - share), (share - chance[given]) / share)
                weights[v] = np.concatenate([weights[v], gain])
                got[v] += int(given.sum())
            self.handed.append((got[0], got[1]))
            refit()
        return self

    @staticmethod
    def _calibrated(view: Logistic, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        w = Logistic(0.1).fit(view.odds(x)[:, None], y)
        slope = float(w.weights[1] / w.scale[0])
        return slope, float(w.weights[0] - slope * w.mean[0])

    def lifts(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views above the prior: 0 where a view tells nothing."""
        (a, b), (c, d) = self.calibration
        return a * self.text.odds(text) + b - self.prior, c * self.metadata.odds(meta) + d - self.prior

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Chance of good quality: calibrated log-odds of both views, the prior counted once."""
        first, second = self.lifts(text, meta)
        return _chance(first + second + self.prior + self.shift)


def _ranked(lift: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Held-out lifts from the lowest up, and the labels in that order, summed."""
    order = np.argsort(lift, kind="stable")
    return lift[order], np.concatenate([[0], np.cumsum(y[order])])


def surest(model: CoTrained, text: np.ndarray, meta: np.ndarray, handed: int, ties: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each view and label (view, label, rows, lifts towards the label, chances of good): at most ``handed`` rows, the surest first, of equal ones those of smaller ``ties``."""
    ties = np.zeros(len(text)) if ties is None else ties
    share = 1 / (1 + np.exp(-model.prior))
    for view, lift in enumerate(model.lifts(text, meta)):
        known, good = model.ranks[view]
        for label, towards in ((1, lift), (0, -lift)):
            rows = np.lexsort((ties, -towards))[:handed]
            # The held-out documents that are at least as sure of the label, SHOWN at least (of few a fifth).
            shown = min(SHOWN, max(len(known) // 5, 3), len(known))
            if label:
                many = np.clip(len(known) - np.searchsorted(known, lift[rows]), shown, None)
                hits = good[-1] - good[len(known) - many]
            else:
                many = np.clip(np.searchsorted(known, lift[rows], side="right"), shown, None)
                hits = good[many]
            chance = (hits + 2 * share) / (many + 2)
            odds = np.log(chance / (1 - chance)) - model.prior
            sure = (odds if label else -odds) >= np.log(LIFT)
            yield view, label, rows[sure], towards[rows][sure], chance[sure]


def _chooser(text: np.ndarray, meta: np.ndarray, pool: np.ndarray) -> Choose:
    """Chooses from rows at hand; a row is handed over once."""
    free = set(pool.tolist())

    def choose(model: CoTrained) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.array(sorted(free), dtype=int)
        chosen = [(int(at[row]), view, p) for view, _, rows, _, chance in surest(model, text[at], meta[at], HANDED) for row, p in zip(rows, chance, strict=True)]
        free.difference_update(row for row, _, _ in chosen)
        rows = np.array([row for row, _, _ in chosen], dtype=int)
        return text[rows], meta[rows], np.array([view for _, view, _ in chosen]), np.array([p for _, _, p in chosen])

    return choose


def _features(batch: pa.RecordBatch, names: tuple[str, str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    text, lang, source, size = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)
    return text_features([t or "" for t in text]), metadata_features(lang, source, size)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x.astype(np.float32)], pa.binary())


def _unpacked(table: pa.Table) -> np.ndarray:
    """The feature rows of a fetched table as one matrix of floats, straight from its buffers."""
    column = table.column("x").to_pylist()
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int | None = None, rounds: int = ROUNDS, handed: int = HANDED, key: str = "doc_id", label: str = "quality", columns: tuple[str, str, str, str] = ("text", "lang", "source", "n_chars")) -> CoTrained | None:
    """Co-trains on at most ``labelled`` labelled documents, half for either label, and all unlabelled ones.

    Labels of one id count by majority; ids with a tie, a null id or no document teach nothing. A single
    document of a label is enough; None if there is none of either, as nothing tells them apart. Each round reads all documents once
    and fetches at most ``handed`` of them for either view and label; ties go by a hash of the id.
    Labelled documents beyond the bound count as unlabelled, documents with a null id are never
    handed over. ``pool`` may bound the unlabelled documents looked at (default: all).
    """
    spark = docs.sparkSession
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("_y")).where("_y <> 0.5")
    votes = votes.join(docs.select(F.col(key).alias("_id")), "_id", "left_semi").select("_id", F.round("_y").alias("_y"))
    tally = {row["_y"]: row["count"] for row in votes.groupBy("_y").count().collect()}
    halves = [votes.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(labelled // 2) for y in (0.0, 1.0)]
    given = docs.select(F.col(key).alias("_id"), *columns)
    kind = docs.schema[key].dataType.simpleString()

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, columns[0]):
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), _packed(np.hstack(_features(batch, columns)))], ["_id", "_y", "x"])

    # At most ``labelled`` ids: a bounded table to broadcast, and a bounded number of feature rows to fetch.
    sample = given.join(F.broadcast(halves[0].union(halves[1])), "_id").mapInArrow(fetched, f"_id {kind}, _y double, x binary").toArrow()
    order = np.argsort([zlib.crc32(str(i).encode()) for i in sample.column("_id").to_pylist()], kind="stable")
    if not len(order):
        return None
    x, y = _unpacked(sample)[order], np.asarray(sample.column("_y"))[order]
    if y.min() == y.max():
        return None
    taken = sample.select(["_id"])

    def choose(model: CoTrained) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        nonlocal taken
        free = given.where("_id IS NOT NULL").withColumn("_tie", F.xxhash64("_id")).join(F.broadcast(spark.createDataFrame(taken.to_pandas(), f"_id {kind}")), "_id", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {}
            for batch in slices(batches, columns[0]):
                text, meta = _features(batch, columns)
                both = np.hstack([text, meta]).astype(np.float32)
                ids, ties = batch.column("_id").to_pylist(), np.asarray(batch.column("_tie"))
                for view, side, rows, lifts, chance in surest(model, text, meta, handed, ties):
                    held = best.setdefault((view, side), [])
                    held += zip(lifts.tolist(), (ids[i] for i in rows), both[rows], chance.tolist(), ties[rows].tolist(), strict=True)
                    held.sort(key=lambda row: (-row[0], row[4], row[1]))
                    del held[handed:]
            for (view, side), held in best.items():
                if held:
                    lift, own, rows, chance, _ = zip(*held, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own, batch_kind), pa.array([view] * len(own), pa.int32()), pa.array([side] * len(own), pa.int32()), pa.array(lift), pa.array(chance), _packed(np.array(rows))], ["_id", "view", "side", "lift", "chance", "x"])

        batch_kind = sample.schema.field("_id").type
        if pool is not None:
            free = free.orderBy(F.xxhash64("_id"), "_id").limit(pool)
        found = free.mapInArrow(run, f"_id {kind}, view int, side int, lift double, chance double, x binary")
        first = [F.desc("lift"), F.xxhash64("_id"), "_id"]
        part = F.pmod(F.xxhash64("_id"), F.lit(RANKED))
        few = found.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("view", "side", "part").orderBy(*first))).where(F.col("at") <= handed)
        few = few.withColumn("at", F.row_number().over(Window.partitionBy("view", "side").orderBy(*first))).where(F.col("at") <= handed)
        got = few.select("_id", "view", "side", "at", "chance", "x").toArrow().sort_by([("view", "ascending"), ("side", "ascending"), ("at", "ascending")])
        if not got.num_rows:
            return np.zeros((0, TEXT_WIDTH)), np.zeros((0, x.shape[1] - TEXT_WIDTH)), np.zeros(0), np.zeros(0)
        taken = pa.concat_tables([taken, got.select(["_id"])])
        more = _unpacked(got)
        return more[:, :TEXT_WIDTH], more[:, TEXT_WIDTH:], np.asarray(got.column("view")), np.asarray(got.column("chance"))

    model = CoTrained().fit(x[:, :TEXT_WIDTH], x[:, TEXT_WIDTH:], y, choose, rounds)
    model.shift = float(np.log(tally[1.0] / tally[0.0]) - np.log((y == 1).sum() / (y == 0).sum()))
    return model


def score_quality(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5, columns: tuple[str, str, str, str] = ("text", "lang", "source", "n_chars"), keep: list[str] | None = None) -> DataFrame:
    """Adds ``quality_score`` (0 to 1) and ``accepted`` (score at least ``threshold``) to every row.

    Null and empty texts, null languages, sources and sizes are feature values of their own. Repeated
    rows score alike. Without a model (labels of one kind only) every row scores 1. ``keep`` names the input
    columns to return (default all); a clashing added name ends in an underscore.
    """
    kept = keep if keep is not None else docs.columns
    names = [free_name(docs, n) for n in ("quality_score", "accepted")]
    if model is None:
        return docs.select(*kept, F.lit(1.0).alias(names[0]), F.lit(True).alias(names[1]))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, columns[0]):
            score = model.score(*_features(batch, columns))
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array(score >= threshold)], [*kept, *names])

    return docs.mapInArrow(run, schema)
