import http.server
import random
import socket
import threading

import pytest
from pyspark.sql import functions as F

from helixframe.functions import register_functions
from helixframe.operators import coding, graph, kmers, quality
from helixframe.sources import append_results, read_fastq, run_metadata, stream_fastq, write_fasta


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def opposite(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def fastq(n, seed=0):
    """Records whose quality lines may begin with "@" or "+"."""
    rng = random.Random(seed)
    return [(f"@r{i}/{seed}", dna(rng.randint(1, 30), i + 1000 * seed), "+" + rng.choice(["", f"r{i}"]), rng.choice("@+I") + "I" * rng.randint(0, 30)) for i in range(n)]


def test_ranges_of_a_plain_file_are_the_whole_read_at_every_cut(spark, tmp_path):
    from helixframe.sources.sequence_files import FastqReader

    rows = fastq(40)
    for name, end in (("a.fastq", "\n"), ("b.fastq", "\r\n")):
        (tmp_path / name).write_bytes(end.join(x for r in rows for x in r).encode())
        for size in range(1, 400, 7):
            reader = FastqReader({"paths": str(tmp_path / name), "part_bytes": str(size)})
            assert [r[3] for part in reader.partitions() for r in reader.read(part)] == [r[1] for r in rows], (name, size)
    got = read_fastq(spark, [str(tmp_path / "a.fastq"), f"file://{tmp_path}/b.fastq"], part_bytes=200)
    assert got.rdd.getNumPartitions() >= 1
    for name in ("a", "b"):
        assert [(r.read_idx, r.seq) for r in got.where(F.contains("path", F.lit(f"{name}.fastq"))).orderBy("read_idx").collect()] == [(i, r[1]) for i, r in enumerate(rows)]
    (tmp_path / "empty.fastq").write_text("")
    assert read_fastq(spark, [str(tmp_path / "empty.fastq")]).count() == 0


def test_stream_restarts_without_loss_or_repeats(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    want = []
    for i in range(3):
        rows = fastq(25, i)
        want += [r[1] for r in rows]
        (folder / f"{i}.fastq").write_text("\n".join(x for r in rows for x in r) + "\n")
        query = stream_fastq(spark, [str(folder)]).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(r.seq for r in spark.read.parquet(str(out)).collect()) == sorted(want)


def test_a_reset_connection_keeps_the_reads_so_far(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Length", "10000000")
            self.end_headers()
            self.wfile.write("".join("\n".join(r) + "\n" for r in fastq(500)).encode())
            self.wfile.flush()
            self.connection.setsockopt(socket.SOL_SOCKET, socket.SO_LINGER, b"\1\0\0\0\0\0\0\0")
            self.connection.close()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a.fastq"
    try:
        assert read_fastq(spark, [url], min_useful=10).count() >= 10
        with pytest.raises(Exception):
            read_fastq(spark, [url]).count()
    finally:
        server.shutdown()


def test_results_written_twice_stand_once_and_failures_leave_the_old(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda v: spark.createDataFrame([("A", v), ("A", v + 1)], "accession string, n int")
    append_results(spark.createDataFrame([("B", 9)], "accession string, n int"), path)
    for v in (1, 1, 5):
        append_results(rows(v), path)
    bad = rows(7).select("accession", F.when(F.col("n") == 8, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("n")).alias("n"))
    with pytest.raises(Exception, match="stop"):
        append_results(bad, path)
    assert sorted((r.accession, r.n) for r in spark.read.parquet(path).collect()) == [("A", 5), ("A", 6), ("B", 9)]
    failing = spark.range(20).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 13, F.raise_error(F.lit("stop"))).otherwise(F.lit("ACGT")).alias("seq"))
    with pytest.raises(Exception, match="stop"):
        write_fasta(failing.repartition(4), str(tmp_path / "fasta"))
    assert not list((tmp_path / "fasta").glob("part-*"))


def test_orf_map_in_sql_equals_orf_islands(spark):
    register_functions(spark)
    seqs = [(i, dna(3 * i * i, i).lower() if i % 2 else dna(900, i).replace("T", "U")) for i in range(14)] + [(90, None), (91, "ATGNNNTAA"), (92, "")]
    df = spark.createDataFrame(seqs, "contig_id int, seq string")
    df.createOrReplaceTempView("orf_input")
    got = spark.sql("SELECT contig_id, o.* FROM orf_input, LATERAL orf_map(seq) AS o")
    want = coding.orf_islands(df).collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert len(want) > 50


def test_antisense_pairs_stay_within_their_group(spark):
    a, b = dna(300, 5), dna(280, 6)
    rows = [("r1", 1, a), ("r1", 2, opposite(a)), ("r2", 3, opposite(a)), ("r2", 4, b), (None, 5, opposite(b)), (None, 6, b), ("r3", 7, a), ("r3", 8, a), ("r3", 9, opposite(a))]
    df = spark.createDataFrame(rows, "run string, contig_id int, seq string")
    for common in (50, 1):
        got = {(r.sense, r.antisense) for r in kmers.antisense_pairs(df, by="run", common=common).collect()}
        assert got == {(1, 2), (5, 6), (7, 9), (8, 9)}


def test_run_metadata_by_pushed_accessions_with_backoff(spark):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.split("accession=")[1].split("&")[0]
            asked.append(name)
            if name == "R2" and asked.count("R2") < 3 or name == "R3":
                self.send_error(503)
                return
            head = "run_accession\tlibrary_strategy\tread_count\n"
            body = {"R1": head + "R1\tRNA-Seq\t12\n", "R2": head + "R2\tWGS\tmany\n", "R4": head}.get(name, "")
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    how = {"url": f"http://127.0.0.1:{server.server_port}/search", "pause": 0.01, "runs": 2}
    pushdown = "spark.sql.python.filterPushdown.enabled"
    try:
        spark.conf.set(pushdown, "false")
        with pytest.raises(ValueError, match="filterPushdown"):
            run_metadata(spark, ["R1"], **how)
        spark.conf.set(pushdown, "true")
        got = {r.accession: (r.library_strategy, r.library_source, r.read_count, r.fetched) for r in run_metadata(spark, ["R1", "R2", "R3", "R4", "R1"], **how).collect()}
        assert got == {"R1": ("RNA-Seq", "", 12, True), "R2": ("WGS", "", None, True), "R3": (None, None, None, False), "R4": (None, None, None, False)}
        assert (asked.count("R1"), asked.count("R2"), asked.count("R3")) == (1, 3, 3)
        with pytest.raises(Exception, match="name the runs"):
            spark.read.format("run_metadata").options(**how).load().count()
    finally:
        spark.conf.unset(pushdown)
        server.shutdown()


def test_known_names_of_several_searches_are_counted(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    known = quality.known_names({"rRNA(bac)": names("a", "b"), "rRNA(euk)": names("b"), "tRNA": names("z")})
    contigs = spark.createDataFrame([("a len=1",), ("b",), ("c x",)], "id string")
    assert [r.name for r in quality.without_known(contigs, known).collect()] == ["c"]
    assert quality.known_report(contigs, known).first().asDict() == {"n_input": 3, "n_kept": 1, "n_dropped": 2, "by_kind": {"rRNA(bac)": 2, "rRNA(euk)": 1}}
    assert quality.known_report(contigs.limit(0), known).first().asDict() == {"n_input": 0, "n_kept": 0, "n_dropped": 0, "by_kind": {}}


def test_removed_nodes_are_counted(spark):
    line = dna(300, 13)
    df = spark.createDataFrame([("x", line)] * 3 + [("x", line[:150] + dna(20, 14))] * 3, "run string, seq string")
    nodes = graph.count_kmers(df, 21, 2, ["run"])
    left = graph.without_tips(nodes, 21, ["run"])
    assert [tuple(r) for r in graph.removed_nodes(nodes, left, ["run"]).collect()] == [("x", nodes.count(), nodes.count() - left.count())]
    assert left.count() == 280
