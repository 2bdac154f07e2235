"""Windows that travel as runs of bases."""

import random

import numpy as np
import pytest
from helixframe.functions.packed import BASES, FILTER_BITS, code_filter, code_rows, end_rows, oriented, run_codes, run_rows, scattered, windows_of
from helixframe.operators import kmers


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def opposite(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@pytest.mark.parametrize("k", [1, 2, 4, 12, 13, 21, 30, 31])
def test_windows_and_their_opposites_share_code_and_bucket(k):
    for s in (dna(400, k), "A" * 50, "AT" * 40, "ACGT" * 20):
        codes = BASES[np.frombuffer(s.encode(), np.uint8)]
        turned = BASES[np.frombuffer(opposite(s).encode(), np.uint8)]
        here, there = oriented(codes, k), oriented(turned, k)[::-1]
        assert np.array_equal(here[:, :2], there[:, :2])
        own, other = windows_of(codes, k), windows_of(codes, k, True)
        assert np.array_equal(here[:, 2] == 2, own == other)
        assert np.array_equal(here[:, 2] != there[:, 2], own != other)
        assert np.array_equal(here[:, 1], np.where(here[:, 2] == 1, other, own))


@pytest.mark.parametrize("k", [4, 21, 30, 31])
def test_runs_hold_the_distinct_windows_of_a_row_in_fewer_rows(spark, k):
    seqs = [dna(900, 1) + "N" + dna(300, 2), opposite(dna(900, 1)), dna(40, 3) * 5 + "ATAT" * 9, "ACG", "", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
    want = set()
    for i, s in enumerate(seqs):
        for part in (s or "").split("N"):
            if len(part) >= k:
                want |= {(i, int(b), int(c), int(x)) for b, c, x, _ in oriented(BASES[np.frombuffer(part.encode(), np.uint8)], k)}
    runs = run_rows(df, k, ["id"])
    got = [(r.id, r.bucket, r.code, r.side) for r in run_codes(runs, k).collect()]
    assert sorted(got) == sorted(want)
    if k == 21:  # what is shuffled
        assert runs.count() < len(got) / 4
    some = spark.createDataFrame([(c,) for _, _, c, _ in sorted(want)[::7]], "code long")
    bits = code_filter(some)
    rows = code_rows(df, k, ["id"], "seq", bits).collect()
    asked = {r.code for r in some.collect()}
    assert {(r.id, r.code, r.side) for r in rows if r.code in asked} == {(i, c, x) for i, _, c, x in want if c in asked}
    assert len(rows) == len({(r.id, r.code, r.side) for r in rows})
    assert {r.id: r.n for r in rows} == {i: sum(w[0] == i for w in want) for i in {r.id for r in rows}}
    at = scattered(np.array(sorted(asked), np.int64), FILTER_BITS)
    assert (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all()


@pytest.mark.parametrize("k", [2, 3, 12, 21, 30, 31])
def test_degrees_by_buckets_of_ends_are_those_of_the_counted_graph(spark, k):
    seqs = [dna(700, 1) + "N" + dna(300, 2), dna(700, 1)[200:650] + dna(60, 4), opposite(dna(700, 1)), dna(40, 3) * 5 + "ATAT" * 9, "a" * 60, "ACG", "", None]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    for least in (1, 2):
        want = kmers.debruijn_degrees(kmers.count_kmers(df, k, least, as_text=False), k)
        got = kmers.own_degrees(df, k, least)
        assert got.columns == ["kmer", "cnt", "n_out", "n_in"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_degrees_shuffle_runs_and_not_windows(spark):
    df = spark.createDataFrame([(dna(20_000, 5),)], "seq string")
    runs = end_rows(df, 21)
    assert runs.count() < 19_980 / 3
    plan = kmers.own_degrees(df, 21)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # runs by bucket, then what is known of a k-mer


@pytest.mark.parametrize("counted", [50, 4_000_000])
def test_coverage_by_runs_is_that_of_the_counted_windows(spark, monkeypatch, counted):
    """Also where a bucket is larger than what is counted at once."""
    from helixframe.functions import packed

    monkeypatch.setattr(packed, "COUNTED", counted)
    seqs = [dna(700, 1) + "N" + dna(300, 2), dna(700, 1)[200:650] + dna(60, 4), "A" * 900, "a" * 60, dna(40, 3) * 5, "ACG", "", None]
    df = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(seqs)], "contig_id string, seq string")
    for k, least in ((2, 1), (21, 2), (31, 1)):
        want = kmers.mean_coverage(df, kmers.count_kmers(df, k, least, as_text=False), k)
        got = kmers.own_coverage(df, k, least)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_coverage_shuffles_runs_and_not_windows(spark):
    df = spark.createDataFrame([(1, dna(20_000, 5))], "contig_id int, seq string")
    plan = kmers.own_coverage(df, 21)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(bucket" in plan


def test_degrees_count_buckets_without_a_window_over_all(spark, monkeypatch):
    """Also where a bucket is larger than what is counted at once."""
    from helixframe.functions import packed

    monkeypatch.setattr(packed, "COUNTED", 50)
    df = spark.createDataFrame([(s,) for s in (dna(700, 1), dna(700, 1)[200:650] + dna(60, 4), "A" * 900, "ATAT" * 90)], "seq string")
    got = kmers.own_degrees(df, 21, 2)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = kmers.debruijn_degrees(kmers.count_kmers(df, 21, 2, as_text=False), 21)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_lists_of_holders_are_those_of_codes_met_one_by_one(spark, monkeypatch):
    """Some buckets at a time, also where one is larger than that, and group by group."""
    from helixframe.functions import packed

    seqs = [dna(300, 1), opposite(dna(300, 1)[40:260]), dna(300, 1)[100:] + dna(50, 2), "A" * 90 + "T" * 90, "ACGT" * 30]
    df = spark.createDataFrame([(i, s, g) for i, s in enumerate(seqs) for g in ("x", None)], "cls long, s string, by string")
    for counted, by, common in ((40, [], 3), (4_000_000, [], 50), (40, ["by"], 2)):
        monkeypatch.setattr(packed, "COUNTED", counted)
        runs = run_rows(df if by else df.where("by = 'x'"), 21, ["cls", *by], "s")
        holders = {}
        for r in run_codes(runs, 21).collect():
            holders.setdefault((r["by"] if by else None, r.code), []).append((r.cls, r.side))
        lists = {}
        for (group, code), held in holders.items():
            if {s for _, s in held} & {2} or len({s for _, s in held}) > 1:
                lists.setdefault((group, tuple(sorted(held)), code if len(held) > common else None), []).append(code)
        want = sorted((str(g), len(held), str(often), len(codes), min(codes)) for (g, held, often), codes in lists.items())
        parts = packed.counted_lists(runs.repartition(*by, "bucket").sortWithinPartitions("bucket"), 21, by, common).collect()
        got = {}
        for r in parts:
            got.setdefault((r["by"] if by else None, r.c, r.x0, r.x1, r.often), []).append((r.w, r.code))
        assert sorted((str(g), c, str(often), sum(w for w, _ in x), min(code for _, code in x)) for (g, c, _, _, often), x in got.items()) == want


def test_frequent_sets_are_sent_by_blocks_and_not_by_pairs(spark, monkeypatch):
    """Pairs that share frequent k-mers only, whose sets lie in many blocks."""
    base = dna(400, 11)
    seqs = [opposite(s) if i % 2 else s for i, s in enumerate(base[: 200 + 9 * i] + dna(100, 20 + i) for i in range(12))]
    df = spark.createDataFrame(list(enumerate(seqs)), "contig_id long, seq string")
    want = sorted(map(tuple, kmers.antisense_pairs(df).collect()))
    monkeypatch.setattr(kmers, "SETS", 2)
    out = kmers.antisense_pairs(df, common=2)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect())) == want and len(want) == 36
