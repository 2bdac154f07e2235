"""Token counts under a unigram model, by one dynamic program over a trie of pre-tokens.

A text falls into pre-tokens that no piece crosses. The distinct pre-tokens of a slice of rows form
a trie; walking it depth first, in sorted order, the best forward score and its number of tokens
are computed once for each prefix that pre-tokens share, and the count at each terminal is stored.
Only the path from the root to the current node is held.

A unigram model file gives its log-probabilities itself, and counts are those of its own encoder. The
scores in a BPE file are merge ranks; there the probability of a piece follows from its rank by
Zipf's law, and counts are those of a unigram model with this vocabulary and these probabilities,
which is not the file's own segmentation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from math import log
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import LONGEST, NEVER, REMEMBERED, PieceModel
from .shared import free_name, slices

#: An unknown character scores so much below the lowest piece.
UNKNOWN_PENALTY = 10.0


def unigram_scores(model: PieceModel) -> dict[str, float]:
    """Log-probabilities of the model's pieces: its own, or of the n-th best merge 1 / n, normalised."""
    if model.unigram:
        return dict(model.scores)
    ranked = sorted(model.scores, key=lambda p: -model.scores[p])
    total = log(sum(1 / n for n in range(1, len(ranked) + 1)))
    return {piece: -log(n) - total for n, piece in enumerate(ranked, 1)}


class UnigramCounter(dict):
    """pre-token -> tokens on its best path (highest sum of piece scores; of equals the longest last piece).

    Characters that no piece covers cost their UTF-8 bytes in tokens.
    """

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.steps = 0
        #: The pieces as a trie of dicts; the score of a piece is at "" of its node.
        self.pieces: dict = {}
        for piece, score in scores.items():
            node = self.pieces
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score

    def learn(self, pretokens: Iterable[str]) -> None:
        """Stores the terminal counts of all ``pretokens``."""
        if len(self) > REMEMBERED:
            self.clear()
        root, unknown = self.pieces, self.unknown
        # For each prefix on the path: best score, its tokens, and the pieces under way with the state before them.
        path: list[tuple[float, int, list]] = [(0.0, 0, [])]
        before = ""
        for word in sorted(set(pretokens) - self.keys()):
            shared = len(commonprefix((word, before)))
            del path[shared + 1 :]
            for c in word[shared:]:
                total, count, begun = path[-1]
                going, most, tokens = [], NEVER, 0
                for node, score, n in (*begun, (root, total, count)):
                    if (below := node.get(c)) is not None:
                        going.append((below, score, n))
                        if (own := below.get("")) is not None and score + own > most:
                            most, tokens = score + own, n + 1
                if "" not in root.get(c, ()) and total + unknown > most:
                    most, tokens = total + unknown, count + len(c.encode("utf-8", "replace"))
                path.append((most, tokens, going))
            self.steps += len(word) - shared
            self[word] = path[-1][1]
            before = word


@cache
def _counter(model_path: str) -> tuple[PieceModel, UnigramCounter]:
    """One for each worker process."""
    model = PieceModel(model_path)
    return model, UnigramCounter(unigram_scores(model))


def count_tokens(df: DataFrame, text: str, model_path: str) -> DataFrame:
    """Adds ``n_tokens`` and ``n_pretokens`` to every row, under the pieces and probabilities of a model file.

    Null and empty texts count 0. Repeated rows count alike; texts of any length are counted whole.
    Pre-tokens over ``LONGEST`` characters are counted but not remembered. Input columns are kept; an
    added column whose name clashes ends in an underscore.
    """
    names = [free_name(df, n) for n in ("n_tokens", "n_pretokens")]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counter = _counter(model_path)
        for batch in slices(batches, text):
            parts = [model.chunk.findall(model.normalized(value or "")[0]) for value in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            counter.learn(c for p in parts for c in p)
            counts = [sum(map(counter.__getitem__, p)) for p in parts]
            for long in [c for c in {c for p in parts for c in p if len(c) > LONGEST}]:
                del counter[long]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array([len(p) for p in parts], pa.int64())], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)
