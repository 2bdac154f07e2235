"""k-mers as 64-bit integers: two bits a base, in the order A, C, G, T, for k up to 31.

Windows are cut and counted batch by batch in Arrow, so that a key is eight bytes in every shuffle and
repeated windows of a batch are one row. The order of packed k-mers is that of their strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 31
#: Bases of a slice of rows that is worked on at once (about 100 bytes each), and of one whose windows are counted.
SLICE, COUNTED = 1_000_000, 4_000_000
#: Bits of the buckets of windows.
BUCKET_BITS = 20
BASES = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    BASES[ord(_c)] = BASES[ord(_c.lower())] = _i


def packed(kmer: Column | str) -> Column:
    """The integer of a k-mer over A, C, G and T."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpacked(kmer: Column | str, k: int) -> Column:
    """The k-mer of an integer."""
    text = F.col(kmer) if isinstance(kmer, str) else kmer
    return F.translate(F.lpad(F.conv(text.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def windows_of(codes: np.ndarray, k: int, opposite: bool = False) -> np.ndarray:
    """All windows of ``k`` codes as integers, or their reverse complements."""
    part, out, length, size = (3 - codes if opposite else codes).astype(np.int64), None, 1, 0
    join = (lambda a, na, b, nb: b << 2 * na | a) if opposite else (lambda a, na, b, nb: a << 2 * nb | b)
    while True:
        if k & length:
            if out is None:
                out, size = part, length
            else:
                n = len(codes) - size - length + 1
                out, size = join(out[:n], size, part[size : size + n], length), size + length
        if length * 2 > k:
            return out
        n = len(part) - length
        part, length = join(part[:n], length, part[length : length + n], length), length * 2


def turned_windows(codes: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of all windows."""
    return windows_of(codes, k, True)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    part, length = values, 1
    while length * 2 <= width:
        part, length = np.minimum(part[:-length], part[length:]), length * 2
    n = len(values) - width + 1
    return np.minimum(part[:n], part[width - length : width - length + n])


def word_length(k: int) -> int:
    """Bases of the words that name the buckets of k-mers: odd, so that no word is its own opposite strand."""
    return max(2 * k - MOST, min(k, 11) - 1 | 1)


def oriented(codes: np.ndarray, k: int) -> np.ndarray:
    """``(bucket, code, side, place)`` of all windows, with one code for a window and its reverse complement.

    The bucket is the least hash of a window's words on either strand, so neighbours mostly share it. The
    code is the strand on which that word is the smaller one of its two strands (if it occurs both ways, the
    smaller window): ``side`` is 0 if the window is its code, 1 if it is the other strand's, 2 if both are the same.
    """
    length = word_length(k)
    own, other = windows_of(codes, length), windows_of(codes, length, True)
    turned, hashed = own > other, scattered(~np.minimum(own, other), BUCKET_BITS).astype(np.int64) << 1
    plain, opposite = (_least(hashed | x, k - length + 1) for x in (turned, ~turned))
    own, other = windows_of(codes, k), windows_of(codes, k, True)
    flip = np.where((plain | opposite) & 1 == 0, own > other, plain & 1 == 1)
    return np.stack([plain >> 1, np.where(flip, other, own), np.where(own == other, 2, flip), np.arange(len(own))], axis=1)


def cut(column: pa.Array, k: int, windows: Callable[[np.ndarray, int], np.ndarray] = windows_of, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slice by slice the row number and the integer of every window of A, C, G and T within the strings of a column."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(int(np.searchsorted(ends, ends[at] + size, side="right")) - 1, at + 1)
        codes = BASES[data[ends[at] : ends[to]]]
        if len(codes) >= k:
            bad = np.concatenate([[0], np.cumsum(codes > 3)])
            row = np.repeat(np.arange(at, to), np.diff(ends[at : to + 1]))
            start = np.arange(len(codes) - k + 1)
            fine = (bad[k:] == bad[:-k]) & (ends[1:][row[: len(start)]] - ends[at] >= start + k)
            yield row[: len(start)][fine], windows(np.minimum(codes, 3), k)[fine]
        at = to


def _counted(batch: pa.RecordBatch, k: int, windows: Callable[[np.ndarray, int], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice of the last column a row, a window and how often it occurs in rows with the other columns of that row."""
    column, kept = batch.column(batch.num_columns - 1), batch.columns[:-1]
    known: dict = {}
    own = np.array([known.setdefault(key, len(known)) for key in zip(*(c.to_pylist() for c in kept), strict=True)], np.int64) if kept else np.zeros(len(column), np.int64)
    _, first = np.unique(own, return_index=True)
    for row, kmer in cut(column, k, windows, COUNTED):
        if not len(kmer):
            continue
        group = own[row]
        least, bits = int(group.min()), int(kmer.max()).bit_length()
        if bits + (int(group.max()) - least).bit_length() < 64 and kmer.min() >= 0:
            both = np.sort(group - least << bits | kmer)
            group, kmer = (both >> bits) + least, both & (1 << bits) - 1
        else:
            order = np.lexsort((kmer, group))
            group, kmer = group[order], kmer[order]
        starts = np.nonzero(np.concatenate([[True], (kmer[1:] != kmer[:-1]) | (group[1:] != group[:-1])]))[0]
        yield first[group[starts]], kmer[starts], np.diff(np.append(starts, len(kmer)))


def _given(rows: DataFrame, k: int, keep: list[str], seq: str) -> DataFrame:
    if not 0 < k <= MOST:
        raise ValueError(f"k must be between 1 and {MOST}")
    return rows.select(*keep, F.coalesce(F.col(seq), F.lit("")).alias("_seq"))


def kmer_rows(rows: DataFrame, k: int, keep: list[str], seq: str = "seq", windows: Callable[[np.ndarray, int], np.ndarray] = windows_of) -> DataFrame:
    """``(keep..., kmer, times)``: windows of A, C, G and T (either case) in ``seq``, as ``windows`` makes integers of them
    (``turned_windows``: of their reverse complements).

    Rows of a batch with equal ``keep`` and window are one; the same window may come from several
    batches, so sum ``times``. Nulls and strings below ``k`` have no windows.
    """
    given = _given(rows, k, keep, seq)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema if f.name != "_seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, kmer, times in _counted(batch, k, windows):
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[:-1]), pa.array(kmer), pa.array(times, pa.int64())], [*keep, "kmer", "times"])

    return given.mapInArrow(run, f"{fields}kmer long, times long")


def _oriented_sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slice by slice the row numbers and ``oriented`` rows of a column's windows, each once for a string and side."""
    for row, found in cut(column, k, oriented):
        if not len(row):
            continue
        kept = []
        keys = (found[:, 1] << 2 | found[:, 2]).view(np.uint64)
        starts = np.nonzero(np.diff(row, prepend=-1))[0]
        for at, to in zip(starts, [*starts[1:], len(row)], strict=True):
            order = np.argsort(keys[at:to])
            kept.append(at + order[np.nonzero(np.concatenate([[True], np.diff(keys[at:to][order]) != 0]))[0]])
        kept = np.sort(np.concatenate(kept))
        yield row[kept], found[kept]


def run_rows(rows: DataFrame, k: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """``(keep..., bucket, run, many, side)``: the distinct ``oriented`` windows of each row, neighbours of one bucket
    and side as one run of bases that fits an integer. ``run_codes`` makes windows of it.

    A shuffle by bucket brings equal codes together at a few bytes a window.
    """
    given = _given(rows, k, keep, seq)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema if f.name != "_seq")
    most = min(MOST - k + 1, k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in _oriented_sets(batch.column(batch.num_columns - 1), k):
                bucket, code, side, place = found.T
                breaks = (np.diff(row) != 0) | (np.diff(place) != 1) | (np.diff(bucket) != 0) | (np.diff(side) != 0)
                starts = np.nonzero(np.concatenate([[True], breaks]))[0]
                since = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
                starts = np.nonzero(since % most == 0)[0]
                many = np.diff(np.append(starts, len(row)))
                ends = starts + many - 1
                # On the other strand the last window comes first.
                first, last = (np.where(side[starts] == 1, code[x], code[y]) for x, y in ((ends, starts), (starts, ends)))
                bases = first << 2 * (many - 1) | last & (1 << 2 * (many - 1)) - 1
                # Equal runs of several rows stand together, which a shuffle packs.
                order = np.lexsort((bases, bucket[starts]))
                starts, bases, many = starts[order], bases[order], many[order]
                columns = [pa.array(bucket[starts], pa.int32()), pa.array(bases), pa.array(many, pa.int32()), pa.array(side[starts], pa.int8())]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row[starts])) for c in batch.columns[:-1]), *columns], [*keep, "bucket", "run", "many", "side"])

    return given.mapInArrow(run, f"{fields}bucket int, run long, many int, side byte")


def _by_ends(codes: np.ndarray, k: int) -> np.ndarray:
    """``(head, tail, kmer, place)`` of all windows: the buckets of their first and of their last k-1 bases."""
    length = word_length(k - 1)
    words = np.minimum(windows_of(codes, length), windows_of(codes, length, True))
    buckets = _least(scattered(~words, BUCKET_BITS).astype(np.int64), k - length)
    kmer = windows_of(codes, k)
    return np.stack([buckets[:-1], buckets[1:], kmer, np.arange(len(kmer))], axis=1)


def end_rows(rows: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """``(bucket, run, many, ends, times)``: windows of A, C, G and T as runs of neighbours in the bucket of an end of k-1 bases.

    A window comes to the buckets of both its ends, once if they are the same, so a bucket has all windows
    that meet at an end of its own. Bit 0 of ``ends`` tells whether the first window begins, bit 1 whether
    the last one ends with such an end; all others within a run do both. Equal runs of a batch are one row,
    with their number.
    """
    if k < 2:
        raise ValueError("k must be 2 at least")
    given = _given(rows, k, [], seq)
    most = min(MOST - k + 1, k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in cut(batch.column(0), k, _by_ends, COUNTED):
                if not len(row):
                    continue
                head, tail, kmer, place = found.T
                twice = 1 + (head != tail)
                at = np.repeat(np.arange(len(row)), twice)
                later = np.concatenate([[False], at[1:] == at[:-1]])
                bucket = np.where(later, tail[at], head[at])
                breaks = later[1:] | (np.diff(row[at]) != 0) | (np.diff(place[at]) > 1) | (np.diff(bucket) != 0)
                starts = np.nonzero(np.concatenate([[True], breaks]))[0]
                since = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
                starts = np.nonzero(since % most == 0)[0]
                many = np.diff(np.append(starts, len(at)))
                first, last = at[starts], at[starts + many - 1]
                bases = kmer[first] << 2 * (many - 1) | kmer[last] & (1 << 2 * (many - 1)) - 1
                kind = many << 2 | (tail[last] == bucket[starts]) << 1 | (head[first] == bucket[starts])
                order = np.lexsort((kind, bases))
                bases, kind, bucket = bases[order], kind[order], bucket[starts][order]
                new = np.nonzero(np.concatenate([[True], (np.diff(bases) != 0) | (np.diff(kind) != 0)]))[0]
                columns = [pa.array(bucket[new], pa.int32()), pa.array(bases[new]), pa.array(kind[new] >> 2, pa.int32()), pa.array(kind[new] & 3, pa.int32()), pa.array(np.diff(np.append(new, len(bases))), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "run", "many", "ends", "times"])

    return given.mapInArrow(run, "bucket int, run long, many int, ends int, times long")


def _by_word(codes: np.ndarray, k: int) -> np.ndarray:
    """``(bucket, kmer, place)`` of all windows: the bucket is the least hash of a window's words, so neighbours mostly share it."""
    length = word_length(k)
    kmer = windows_of(codes, k)
    buckets = _least(scattered(~windows_of(codes, length), BUCKET_BITS).astype(np.int64), k - length + 1)
    return np.stack([buckets, kmer, np.arange(len(kmer))], axis=1)


def word_rows(rows: DataFrame, k: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """``(keep..., bucket, run, many)``: all windows of A, C, G and T of each row, neighbours of one bucket as one run of
    bases that fits an integer. Equal windows are in one bucket."""
    given = _given(rows, k, keep, seq)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema if f.name != "_seq")
    most = min(MOST - k + 1, k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in cut(batch.column(batch.num_columns - 1), k, _by_word):
                if not len(row):
                    continue
                bucket, kmer, place = found.T
                breaks = (np.diff(row) != 0) | (np.diff(place) != 1) | (np.diff(bucket) != 0)
                starts = np.nonzero(np.concatenate([[True], breaks]))[0]
                since = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
                starts = np.nonzero(since % most == 0)[0]
                many = np.diff(np.append(starts, len(row)))
                bases = kmer[starts] << 2 * (many - 1) | kmer[starts + many - 1] & (1 << 2 * (many - 1)) - 1
                columns = [pa.array(bucket[starts], pa.int32()), pa.array(bases), pa.array(many, pa.int32())]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row[starts])) for c in batch.columns[:-1]), *columns], [*keep, "bucket", "run", "many"])

    return given.mapInArrow(run, f"{fields}bucket int, run long, many int")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Some whole buckets at a time of runs that come in the order of buckets, with ``times``.

    Of a bucket that is larger than that, equal rows are joined up.
    """
    held, n, limit = [], 0, COUNTED
    for batch in batches:
        held.append(batch if "times" in batch.schema.names else batch.append_column("times", pa.array(np.ones(batch.num_rows, np.int64))))
        n += int(batch["many"].to_numpy().sum())
        if n < limit:
            continue
        table = pa.Table.from_batches(held)
        start = int(np.searchsorted(table["bucket"].to_numpy(), batch["bucket"][-1].as_py()))
        if start:
            yield table.slice(0, start)
            table, limit = table.slice(start), COUNTED
        else:
            names = table.column_names
            table = table.group_by([c for c in names if c != "times"]).aggregate([("times", "sum")]).rename_columns({"times_sum": "times"}).select(names)
        n = int(table["many"].to_numpy().sum())
        held, limit = table.combine_chunks().to_batches(), max(limit, 2 * n)
    if held:
        yield pa.Table.from_batches(held)


def _expanded(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of runs, the row of each and its place in the run."""
    run, many = table["run"].to_numpy(), table["many"].to_numpy()
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return run[row] >> 2 * (many[row] - 1 - place) & (1 << 2 * k) - 1, row, place


def counted_runs(runs: DataFrame, k: int, key: str, min_count: int) -> DataFrame:
    """``(key, n_kmers, total)`` in parts, to be added up: windows of ``word_rows`` and the sum of their counts over all
    rows, of which those below ``min_count`` are 0. Buckets come to a task in order and are counted some at a time."""
    kind = runs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            known = table[key].combine_chunks().dictionary_encode("encode")
            kmer, row, _ = _expanded(table, k)
            order = np.argsort(kmer)
            kmer, row = kmer[order], row[order]
            own, weight = known.indices.to_numpy()[row], table["times"].to_numpy()[row]
            starts = np.nonzero(np.diff(kmer, prepend=-1))[0]
            sums = np.repeat(np.add.reduceat(weight, starts), np.diff(np.append(starts, len(kmer))))
            size = len(known.dictionary)
            n_kmers, total = (np.bincount(own, x, size).astype(np.int64) for x in (weight, np.where(sums >= min_count, weight * sums, 0)))
            yield pa.RecordBatch.from_arrays([known.dictionary, pa.array(n_kmers), pa.array(total)], [key, "n_kmers", "total"])

    return runs.mapInArrow(run, f"`{key}` {kind}, n_kmers long, total long")


def counted_ends(runs: DataFrame, k: int, min_count: int) -> DataFrame:
    """``(kmer, cnt, n_out, n_in)`` of the windows of ``end_rows`` that occur ``min_count`` times, once for each end of
    theirs: with ``n_in`` for the first and ``n_out`` for the last k-1 bases, the other null.

    Buckets come to a task in order. All windows of a first end are in its bucket, and so are those of a last one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            kmer, row, place = _expanded(table, k)
            ends, many, times = (table[c].to_numpy() for c in ("ends", "many", "times"))
            sides = []
            for here in ((place > 0) | (ends[row] & 1 == 1), (place < many[row] - 1) | (ends[row] & 2 == 2)):
                found, weight = kmer[here], times[row[here]]
                order = np.argsort(found)
                found = found[order]
                starts = np.nonzero(np.diff(found, prepend=-1))[0]
                cnt = np.add.reduceat(weight[order], starts) if len(starts) else weight
                kept = cnt >= min_count
                sides.append((found[starts][kept], cnt[kept]))
            (first, first_cnt), (last, last_cnt) = sides
            heads, tails = first >> 2, last & (1 << 2 * (k - 1)) - 1
            met = lambda asked, given: pa.array(np.searchsorted(given, asked, "right") - np.searchsorted(given, asked), pa.int64())
            none = lambda n: pa.nulls(n, pa.int64())
            names = ["kmer", "cnt", "n_out", "n_in"]
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(first_cnt), none(len(first)), met(heads, np.sort(tails))], names)
            yield pa.RecordBatch.from_arrays([pa.array(last), pa.array(last_cnt), met(tails, heads), none(len(last))], names)

    return runs.mapInArrow(run, "kmer long, cnt long, n_out long, n_in long")


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = values.astype(np.uint64) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def counted_lists(runs: DataFrame, k: int, by: list[str], common: int) -> DataFrame:
    """``(by..., c, x0, x1, often, w, code)`` in parts: lists of holders of the codes of ``run_rows(cls, side)`` that have a
    holder on either strand, each by its length and two sums of hashes, with the number of codes that have it and the
    least of these. Codes of more than ``common`` holders stand alone, in ``often`` too.

    Buckets come to a task in order and are counted some at a time.
    """
    fields = "".join(f"`{c}` {runs.schema[c].dataType.simpleString()}, " for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            code, row, _ = _expanded(table, k)
            group = table[by[0]].combine_chunks().dictionary_encode("encode") if by else None
            own = group.indices.to_numpy()[row] if by else np.zeros(len(row), np.int8)
            order = np.lexsort((code, own)) if by else np.argsort(code)
            code, row, own = code[order], row[order], own[order]
            side = table["side"].to_numpy()[row].astype(np.int64)
            holder = table["cls"].to_numpy()[row] << 2 | side
            starts = np.nonzero((np.diff(code, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))[0]
            low, high = np.minimum.reduceat(side, starts), np.maximum.reduceat(side, starts)
            both = (low != high) | (high == 2)
            c = np.diff(np.append(starts, len(code)))[both]
            x0, x1 = (np.bitwise_xor.reduceat(_mixed(holder, seed), starts)[both].view(np.int64) for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
            code, own = code[starts][both], own[starts][both].astype(np.int64)
            # Equal lists stand together, and their codes in order.
            often = np.where(c > common, code, -1)
            order = np.lexsort((code, x1, x0, often, c, own))
            own, c, often, x0, x1, code = (x[order] for x in (own, c, often, x0, x1, code))
            new = np.zeros(len(code), bool)
            new[:1] = True
            for x in (own, c, often, x0, x1):
                new[1:] |= x[1:] != x[:-1]
            at = np.nonzero(new)[0]
            w = np.diff(np.append(at, len(code)))
            names = [group.dictionary.take(pa.array(own[at]))] if by else []
            columns = [pa.array(c[at], pa.int64()), pa.array(x0[at]), pa.array(x1[at]), pa.array(often[at], pa.int64(), mask=often[at] < 0), pa.array(w, pa.int64()), pa.array(code[at])]
            yield pa.RecordBatch.from_arrays([*names, *columns], [*by, "c", "x0", "x1", "often", "w", "code"])

    return runs.mapInArrow(run, f"{fields}c long, x0 long, x1 long, often long, w long, code long")


def run_codes(runs: DataFrame, k: int) -> DataFrame:
    """The windows of ``run_rows`` one by one, with their ``code`` for ``run`` and ``many``. Rows stay in their partition."""
    kept = [c for c in runs.columns if c not in ("run", "many")]
    each = runs.select("*", F.explode(F.sequence(F.lit(1), "many")).alias("_i"))
    return each.select(*kept, F.expr(f"shiftright(run, 2 * (many - _i)) & {(1 << 2 * k) - 1}L").alias("code"))


#: Bits of a filter of codes (16 MB).
FILTER_BITS = 27


def code_filter(codes: DataFrame) -> np.ndarray:
    """A bit for each hash of ``codes(code)``, in words of 64 bits. Tasks fill it, so the driver holds one filter whatever the table."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
        for batch in batches:
            at = scattered(batch.column(0).to_numpy(zero_copy_only=False), FILTER_BITS)
            np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        some = np.nonzero(bits)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(bits[some].view(np.int64))], ["at", "word"])

    found = codes.select("code").mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return out


def code_rows(rows: DataFrame, k: int, keep: list[str], seq: str, wanted: np.ndarray) -> DataFrame:
    """``(keep..., n, code, side)``: the distinct ``oriented`` windows of each row that a ``code_filter`` lets pass, which
    includes some others, and ``n``, the number of all of them."""
    given = _given(rows, k, keep, seq)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema if f.name != "_seq")
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for row, found in _oriented_sets(batch.column(batch.num_columns - 1), k):
                n = np.bincount(row, minlength=batch.num_rows)
                at = scattered(np.ascontiguousarray(found[:, 1]), FILTER_BITS)
                may = np.nonzero(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))[0]
                columns = [pa.array(n[row[may]], pa.int64()), pa.array(found[may, 1]), pa.array(found[may, 2], pa.int8())]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row[may])) for c in batch.columns[:-1]), *columns], [*keep, "n", "code", "side"])

    return given.mapInArrow(run, f"{fields}n long, code long, side byte")


def scattered(kmer: np.ndarray, bits: int) -> np.ndarray:
    """A number of so many bits for each k-mer, about equally often each."""
    return (kmer.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
