import random

import pytest
import simulate
from pyspark import cloudpickle
from pyspark.sql import functions as F

from helixframe.functions import register_functions
from helixframe.operators import identify
from helixframe.plans import pipelines, views
from helixframe.streaming import bounded_kmer_counts, drain, held_counts, kmer_count_stream

cloudpickle.register_pickle_by_value(simulate)  # workers do not see this folder


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def opposite(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_corpus_is_seeded_and_labelled(spark):
    a = simulate.calibration_corpus(spark, 7, 3, 4, 2, 4)
    rows = {r.id: r for r in a.collect()}
    assert rows == {r.id: r for r in simulate.calibration_corpus(spark, 7, 3, 4, 2, 4).repartition(5).collect()}
    assert sum(not r.is_true_positive for r in rows.values()) == 10 and {r.element_id for r in rows.values() if r.is_true_positive} == {"POS000", "POS001", "POS002"}
    assert all(r.seq.startswith("ATG") and r.seq[-3:] in ("TAA", "TAG", "TGA") for r in rows.values() if r.kind == "coding_decoy")


def test_sweep_and_calibration(spark):
    corpus = simulate.calibration_corpus(spark, 11, 2, 4, 1, 3, (1, 2), 1.0).cache()
    out = pipelines.sweep(corpus.select("id", "seq"), "id", "seq", 8).cache()
    best = out.join(corpus.select(F.col("id").alias("rep"), "is_true_positive", "kind"), "rep").collect()
    found = [r for r in best if r.is_true_positive]
    assert len(found) == 2 and all(r.has_sas and r.members >= 2 for r in found)
    assert min(r.combined_score for r in found) > max(r.combined_score for r in best if r.kind == "coding_decoy")
    report = pipelines.calibrate(out.join(corpus.select(F.col("id").alias("rep"), "is_true_positive", "kind"), "rep").drop("q_value", "reject"), "is_true_positive", "p_value", "combined_score", "kind")
    assert report["ranking"].first().roc_auc > 0.8 and report["calls"].first().tp >= 1 and report["by_kind"].count() >= 2


def test_hunt_gates_runs_before_reads(spark):
    circle = dna(300, 3)
    reads = [("good", (circle * 2)[i : i + 100]) for i in range(300)] + [("dna", (circle * 2)[i : i + 100]) for i in range(300)]
    runs = spark.createDataFrame([("good", "RNA-Seq", "cDNA", "TRANSCRIPTOMIC"), ("dna", "WGS", "", "GENOMIC")], "accession string, library_strategy string, library_selection string, library_source string")
    got = pipelines.hunt(spark.createDataFrame(reads, "accession string, seq string"), runs, spark.createDataFrame([("A" * 21,)], "kmer string"), 31, 5, 200).collect()
    assert [(r.accession, r.is_cycle, r.verdict) for r in got] == [("good", True, "candidate")]


def test_signature_takes_either_axis_and_rods(spark):
    arm = dna(90, 31)
    rod, plain = arm + "GAAA" + opposite(arm) + "GAAA", dna(190, 32)
    end = rod[:15] + ("A" if rod[15] != "A" else "C")
    one_off = rod + "ACGTA" + end  # the 16 bases of overlap differ in one
    lone, small = dna(400, 34), dna(100, 35)
    known = dna(300, 36)
    rows = [("r1", "rod", one_off), ("r1", "flat", plain + plain[:30]), ("r1", "line", lone), ("r1", "sense", known[:50] + plain), ("r1", "anti", opposite(known[:50] + plain)), ("r1", "small", small + small[:30])]
    rows += [("r2", "other", opposite(lone))]
    df = spark.createDataFrame(rows, "run string, contig_id string, seq string")
    got = {r.contig_id: r for r in pipelines.signature(df, spark.createDataFrame([("A" * 21,)], "kmer string"), shuffles=2, by="run").collect()}
    assert got["rod"].circular and got["rod"].unit_length == len(rod) + 5 and got["rod"].is_rodlike and got["rod"].shortlisted
    assert got["flat"].verdict == "candidate" and not got["flat"].is_rodlike and not got["flat"].shortlisted
    assert got["sense"].verdict == got["anti"].verdict == "candidate" and got["sense"].has_sas and not got["sense"].circular
    assert got["small"].verdict == "size" and got["small"].structure_z is None
    assert got["line"].verdict == got["other"].verdict == "not circular or paired" and not got["other"].has_sas
    assert all(r.structure_z is not None and r.orphan_score is not None for r in got.values() if r.verdict == "candidate")
    refs = spark.createDataFrame([(rod[i : i + 21],) for i in range(len(rod) - 20)], "kmer string")
    again = {r.contig_id: r for r in pipelines.signature(df.where("contig_id = 'rod'"), refs, shuffles=2).collect()}
    assert again["rod"].verdict == "known" and again["rod"].is_rodlike and not again["rod"].shortlisted


def test_characterise(spark):
    unit = dna(40, 5) + "ATG" + "GCT" * 20 + "TAA" + dna(20, 8)
    got = pipelines.characterise(spark.createDataFrame([("x", unit + unit[:20])], "id string, seq string"), "id", "seq", 5).first()
    assert got.is_circular and got.unit_length == len(unit) and got.n_orfs >= 1 and got.top_orfs[0].aa >= 21


def test_sql_functions(spark):
    register_functions(spark)
    unit = dna(100, 6)
    got = spark.sql(f"SELECT revcomp('ACGU') AS r, gc_content('GC') AS g, kmers('ACGT', 2) AS k, circular_unit('{unit + unit[:30]}', 12) AS u, circular_unit('{unit}', 12) AS v").first()
    assert (got.r, got.g, got.k, got.u, got.v) == ("ACGT", 1.0, ["AC", "CG", "GT"], 100, None)


def test_identification(spark):
    def client():
        def search(service, seq):
            if service == "nucleotide":
                raise OSError("offline")
            return [{"accession": "F1", "description": "family", "score": 5.0}] if service == "family" and seq == "A" else []

        return search

    found = identify.look_up(spark.createDataFrame([(1, "A"), (2, "C")], "id int, seq string"), "id", "seq", client)
    assert found.where("error LIKE '%offline%'").count() == 2
    got = {r.id: (r.verdict, r.best) for r in identify.verdicts(found, "id").collect()}
    assert got == {1: ("known family", "family"), 2: ("unresolved", None)}


def test_kmer_stream_equals_batch(spark, tmp_path):
    reads = [(dna(60, i % 7),) for i in range(40)]
    spark.createDataFrame(reads, "seq string").repartition(4).write.parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
    got = {r.kmer: r.cnt for r in drain(kmer_count_stream(stream, 21)).collect()}
    batch = {}
    for (s,) in reads:
        for i in range(40):
            batch[s[i : i + 21]] = batch.get(s[i : i + 21], 0) + 1
    assert got == batch


ROCKS = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(ROCKS, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(ROCKS)


@pytest.mark.parametrize("most", [10, 60, 5000])
def test_bounded_counts_hold_their_bounds(spark, tmp_path, rocks, most):
    rng = random.Random(most)
    often = [dna(30, i) for i in range(3)]
    reads = [(rng.choice(often) if rng.random() < 0.5 else dna(rng.randint(5, 40), 100 + i),) for i in range(200)] + [(None,), ("ACGN",), ("",)]
    spark.createDataFrame(reads, "seq string").repartition(5).write.parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
    updates = drain(bounded_kmer_counts(stream, 11, most, buckets=2), "update")
    truth = {}
    for (s,) in reads:
        for i in range(len(s or "") - 10):
            truth[s[i : i + 11]] = truth.get(s[i : i + 11], 0) + 1
    floors = {r.bucket: (r.floor, r.n_pruned) for r in updates.groupBy("bucket").agg(F.max("floor").alias("floor"), F.max("n_pruned").alias("n_pruned")).collect()}
    bucket = {r.kmer: r.b for r in spark.createDataFrame([(x,) for x in truth], "kmer string").select("kmer", F.expr("pmod(xxhash64(CAST(conv(translate(kmer, 'ACGT', '0123'), 4, 10) AS LONG)), 2)").alias("b")).collect()}
    held = {r.kmer: r for r in held_counts(updates).collect()}
    assert updates.select("batch").distinct().count() == 5
    for kmer, n in truth.items():
        if kmer in held:
            assert held[kmer].cnt <= n <= held[kmer].upper and held[kmer].bucket == bucket[kmer]
        else:
            assert n <= floors[bucket[kmer]][0]
    assert set(held) <= set(truth)
    for b in (0, 1):
        assert sum(r.bucket == b for r in held.values()) <= most
    if most == 5000:
        assert {x: r.cnt for x, r in held.items()} == truth and set(floors.values()) == {(0, 0)}
    else:
        assert all(f > 0 and p > 0 for f, p in floors.values())
    if most == 60:  # what is often there stays, whatever passes by
        assert {s[i : i + 11] for s in often for i in range(20)} <= set(held)


def test_bounded_counts_go_on_after_a_restart(spark, tmp_path, rocks):
    source, state, rows = tmp_path / "reads", tmp_path / "state", []
    for i in range(3):
        reads = [(dna(40, j % 5 + i),) for j in range(20)]
        rows += reads
        spark.createDataFrame(reads, "seq string").coalesce(1).write.mode("append").parquet(str(source))
        stream = bounded_kmer_counts(spark.readStream.schema("seq string").parquet(str(source)), 15, buckets=3)
        keep = lambda out, n: out.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        stream.writeStream.outputMode("update").option("checkpointLocation", str(state)).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
        truth = {}
        for (s,) in rows:
            for at in range(26):
                truth[s[at : at + 15]] = truth.get(s[at : at + 15], 0) + 1
        assert {r.kmer: r.cnt for r in held_counts(spark.read.parquet(f"{tmp_path}/out")).collect()} == truth


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    turns = spark.createDataFrame([(i, "a text of some words") for i in range(9)], "conv_id long, text string")
    turns.repartition(3).write.parquet(str(tmp_path / "many" / "turns.parquet"))
    (tmp_path / "one").mkdir()
    turns.coalesce(1).write.parquet(str(tmp_path / "source"))
    next((tmp_path / "source").glob("part-*.parquet")).rename(tmp_path / "one" / "turns.parquet")
    for kind in ("one", "many"):
        assert drain(views.streamed(spark, str(tmp_path / kind), "turns"), "append").count() == 9


def test_labels_of_clusters(spark):
    members = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("e", "e"), ("f", "f")], "cluster_id string, id string")
    labels = spark.createDataFrame([("a", False, None, "decoy"), ("b", True, "P1", "rod"), ("c", True, "P2", "rod"), ("d", False, "P1", "plain"), ("f", None, None, None)], "id string, is_true_positive boolean, element_id string, kind string")
    got = {r[0]: tuple(r)[1:] for r in pipelines.cluster_truth(members, labels).collect()}
    assert got == {"a": (3, True, 2, "decoy"), "d": (1, False, 0, "plain"), "e": (1, False, 0, None), "f": (1, False, 0, None)}
    assert pipelines.cluster_truth(members.where("false"), labels).count() == 0
