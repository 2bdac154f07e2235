"""SentencePiece BPE encoding with source spans, and decoding.

Normalisation walks the model's compiled character map (a double-array trie over UTF-8 bytes) and
replaces the longest matching prefix at each place, recording for every normalised character the
source byte it begins at. Pieces found on the normalised text are projected through that record to
byte spans of the original text; the spans of a text tile it.

No vocabulary piece has a space mark behind another character, so merges never cross the start of a
run of marks. A text therefore falls into chunks that are merged alone, and the merges of frequent
chunks are remembered in a bounded table of each task.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, slices

MARK = "▁"
#: Chunks that a task remembers at most between slices of its rows, and the longest that it remembers.
REMEMBERED, SHORT, LONGEST = 400_000, 32, 256
NEVER = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharMap:
    """The compiled character map: ``longest(data, at)`` gives (bytes matched, replacement) or None."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        units, found = self.units, None
        unit = units[0]
        node = self._offset(unit)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])].decode()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class PieceModel:
    """A SentencePiece model with byte fallback, read from its file: BPE, or unigram for counts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        types = [p.type for p in proto.pieces]
        self.unigram = proto.trainer_spec.model_type == 1
        if proto.trainer_spec.model_type not in (1, 2) or not proto.trainer_spec.byte_fallback or USER in types or UNUSED in types:
            raise ValueError("a BPE or unigram model with byte fallback and without user-defined or unused pieces is needed")
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("space marks are needed, before their words")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.side_by_side = {a + b for p in self.ids for a, b in pairwise(p)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.end = types.index(CONTROL) if proto.trainer_spec.eos_id < 0 else proto.trainer_spec.eos_id
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece has a space mark behind another character: texts do not fall into chunks")
        spec = proto.normalizer_spec
        self.map, self.dummy, self.squeeze = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.chunk = re.compile(self._chunks())

    def _chunks(self) -> str:
        """A pattern of chunks: space marks with a run of letters or of other characters, if no piece mixes these."""
        lone = "" if any("\n" in p for p in self.ids) else "\n"
        tail = "|\n+" if lone else ""
        letter = re.compile(r"[^\W\d_]")
        unlike = lambda odd: [p for p in self.side_by_side if MARK not in p and len({bool(letter.match(c)) and c not in odd for c in p}) == 2]
        odd = {c for p in unlike(()) for c in p if letter.match(c)}
        if len(odd) > 20 or unlike(odd):
            return f"{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+{tail}"
        held = re.escape("".join(sorted(odd)))
        return rf"{MARK}*[^\W\d_{held}]+|{MARK}*(?:[^\w{MARK}{lone}]|[\d_{held}])+|{MARK}+{tail}"

    def normalized(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the source byte it begins at."""
        if not text:
            return "", np.zeros(1, np.int32)
        if not self.map and not self.squeeze:
            codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            starts = np.zeros(len(codes) + 1 + self.dummy, np.int32)
            np.cumsum(width, out=starts[1 + self.dummy :])
            return MARK * self.dummy + text.replace(" ", MARK), starts
        data = text.encode("utf-8", "replace")
        out: list[str] = []
        starts: list[int] = []
        at = 0
        if self.squeeze:
            while at < len(data):
                used, new = self._prefix(data, at)
                if new != " ":
                    break
                at += used
        if at == len(data):
            return "", np.array([at], np.int32)
        if self.dummy:
            out.append(MARK)
            starts.append(at)
        spaced = self.squeeze
        while at < len(data):
            used, new = self._prefix(data, at)
            if self.squeeze and spaced:
                new = new.lstrip(" ")
            out += new.replace(" ", MARK)
            starts += [at] * len(new)
            spaced = self.squeeze and (new.endswith(" ") if new else spaced)
            at += used
        end = at
        while self.squeeze and out and out[-1] == MARK:
            out.pop()
            end = starts.pop()
        return "".join(out), np.array([*starts, end], np.int32)

    def _prefix(self, data: bytes, at: int) -> tuple[int, str]:
        if self.map and (found := self.map.longest(data, at)):
            return found
        first = data[at]
        used = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return used, data[at : at + used].decode("utf-8", "replace")

    def merged(self, chunk: str) -> list[str]:
        """The symbols left when the best-scored adjacent pair, the leftmost of equals, is joined until none is a piece."""
        if len(chunk) > 64:
            return self._merged_long(chunk)
        get, symbols = self.scores.get, list(chunk)
        pairs = [get(x + y, NEVER) for x, y in pairwise(symbols)]
        while pairs and (best := max(pairs)) > NEVER:
            i = pairs.index(best)
            symbols[i] += symbols.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(symbols[i] + symbols[i + 1], NEVER)
            if i:
                pairs[i - 1] = get(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _merged_long(self, chunk: str) -> list[str]:
        """As ``merged``, with a heap of pairs: time in proportion to n log n."""
        scores = self.scores
        left, right = list(range(-1, len(chunk) - 1)), [*range(1, len(chunk)), -1]
        symbols: list[str] = list(chunk)
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0:
                joined = symbols[i] + symbols[right[i]]
                if (score := scores.get(joined)) is not None:
                    heapq.heappush(heap, (-score, i, joined))

        for i in range(len(chunk) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i] if symbols[i] else -1
            if j < 0 or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [s for s in symbols if s]

    def encoded(self, chunk: str) -> bytes:
        """Ids of a chunk, each followed by the characters it covers, as packed 32-bit integers.

        Of the byte pieces of one character the last covers it and the others nothing.
        """
        out = array("i")
        for symbol in self.merged(chunk):
            known = self.ids.get(symbol)
            if known is not None:
                out.extend((known, len(symbol)))
            else:
                raw = symbol.encode("utf-8", "replace")
                for b in raw[:-1]:
                    out.extend((self.bytes[b], 0))
                out.extend((self.bytes[raw[-1]], len(symbol)))
        return out.tobytes()


class Encoder(dict):
    """chunk -> packed ids and covers; forgets all once it holds more than ``REMEMBERED`` chunks."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) <= SHORT:
            out = self[chunk] = self.model.encoded(chunk)
            return out
        cut = [0, *(i for i, pair in enumerate(map("".join, pairwise(chunk)), 1) if pair not in self.model.side_by_side), len(chunk)]
        if len(cut) > 2:  # no merge crosses characters that no piece has side by side
            out = b"".join([self[chunk[i:j]] for i, j in pairwise(cut)])
        else:
            out = self.model.encoded(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = out
        return out

    def text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids without an end id, and the source byte that each piece begins at and the end of the last."""
        if len(self) > REMEMBERED:
            self.clear()
        normal, starts = self.model.normalized(text or "")
        found = np.frombuffer(b"".join(map(self.__getitem__, self.model.chunk.findall(normal))), np.int32).reshape(-1, 2)
        return found[:, 0], starts[np.concatenate([np.zeros(1, np.int64), np.cumsum(found[:, 1])])]


@cache
def _encoder(model_path: str) -> Encoder:
    """One for each worker process, so that later tasks find the chunks of earlier ones."""
    model = PieceModel(model_path)
    if model.unigram:
        raise ValueError("a BPE model is needed")
    return Encoder(model)


def encode_texts(df: DataFrame, text: str, model_path: str) -> DataFrame:
    """Adds ``ids`` (with the end id), ``begins`` and ``ends`` (source byte spans of the pieces) and ``decoded``.

    Null and empty texts get the end id alone and decode to "". The end id's span is empty at the end
    of the text. Every row is encoded whole, repeated rows each. Input columns are kept; an added
    column whose name clashes ends in an underscore. ``model_path`` must exist on the executors.
    """
    names = [free_name(df, n) for n in ("ids", "begins", "ends", "decoded")]
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.StringType() if n == names[3] else ints) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        encoder, library = _encoder(model_path), SentencePieceProcessor(model_file=model_path)
        last = np.array([encoder.model.end], np.int32)
        for batch in slices(batches, text):
            ids, begins, ends, decoded = [], [], [], []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                found, edges = encoder.text(value)
                ids.append(np.concatenate([found, last]))
                begins.append(edges)
                ends.append(np.concatenate([edges[1:], edges[-1:]]))
                decoded.append(library.decode(ids[-1].tolist()))
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (ids, begins, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array(decoded, pa.string())], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def ids_digest(ids: str):
    """SHA-256 of the decimal ids joined by single spaces."""
    return F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")), 256)
