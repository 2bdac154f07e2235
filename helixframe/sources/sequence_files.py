"""FASTA, FASTQ and the text tables around sequencing runs, as DataFrames.

FASTA is split at record starts by Spark's own text reader, so a large plain file is read by many
tasks. FASTQ goes through a Python data source: plain files are read in byte ranges by many tasks, a
gzip stream, which can only be read from its start, by one.
"""

from __future__ import annotations

import gzip
import http.client
import io
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import header_coverage, leading_token


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(id, name, seq, n, coverage, path)``: one row for each record with a header, bases in upper case.

    Blank lines are skipped, lines joined. A file must begin with a header (leading blank lines aside). ``id`` is the whole
    header, ``name`` its first word, ``coverage`` what the header states.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("path", F.input_file_name())
    # The first record of a file still has its ">".
    marked = raw.select("path", F.regexp_replace("value", r"^\s*>", "").alias("t")).where(F.length(F.trim("t")) > 0)
    lines = F.split("t", "\r?\n")
    seq = F.upper(F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), ""))
    out = marked.select(F.trim(F.element_at(lines, 1)).alias("id"), seq.alias("seq"), "path")
    return out.select("id", leading_token("id").alias("name"), "seq", F.length("seq").alias("n"), header_coverage("id").alias("coverage"), "path")


def write_fasta(df: DataFrame, path: str, header: str = "id", seq: str = "seq", wrap: int = 70) -> None:
    """Records with lines of ``wrap`` bases, one file for each partition."""
    body = F.regexp_replace(seq, f"(.{{{wrap}}})(?!$)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("value")).write.text(path)


def append_results(df: DataFrame, path: str, by: str = "accession") -> None:
    """Puts result rows under their run's folder; a run that is written again replaces its own rows only.

    Folders change when the whole write is done, so finished runs stay as they were when a later write fails.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines; null fields are written, so that every row has all keys."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


#: Bytes of a plain FASTQ file that one task reads.
PART_BYTES = 64 << 20
#: What a transfer that breaks off raises.
BROKEN = (EOFError, OSError, zlib.error, http.client.HTTPException)


class FastqSource(DataSource):
    """Sequences of FASTQ files (records of four lines), plain or gzip, as a table or as a stream.

    Options: ``paths`` (comma-separated files, of a stream folders), ``limit`` (reads of each file, the
    reader stops there), ``min_useful`` (a stream of bytes that breaks off after so many reads ends there
    instead of failing), ``part_bytes`` (of a plain file that one task reads). ``part`` numbers the ranges of
    a file, ``read_idx`` counts the reads within one.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "path string, part int, read_idx long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FastqStream(dict(self.options))


class FilePart(InputPartition):
    """Bytes ``begin`` to ``end`` of a file (to its end if ``end`` is None); a record belongs to the part that it begins in."""

    def __init__(self, path: str, number: int = 0, begin: int = 0, end: int | None = None):
        self.path, self.number, self.begin, self.end = path, number, begin, end


class FastqParts:
    """How files are cut and read; what table and stream have in common."""

    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.paths = [p for p in low.get("paths", low.get("path", "")).split(",") if p]
        self.limit, self.min_useful = int(low.get("limit", 0)), int(low.get("min_useful", 0))
        self.part_bytes = int(low.get("part_bytes", PART_BYTES))

    def parts_of(self, path: str) -> list[InputPartition]:
        """Ranges of a plain file; gzip, transfers over http and reads up to a limit go through one task."""
        if self.limit or urlsplit(path).path.endswith(".gz") or re.match("https?://", path):
            return [FilePart(path)]
        files, inner = _file_system(path)
        size = files.get_file_info(inner).size or 0
        cuts = list(range(0, max(size, 1), self.part_bytes))
        return [FilePart(path, i, at, at + self.part_bytes if i + 1 < len(cuts) else None) for i, at in enumerate(cuts)]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        found = 0
        try:
            for seq in self._sequences(partition):
                yield partition.path, partition.number, found, seq
                found += 1
                if self.limit and found >= self.limit:
                    return
        except BROKEN:
            if not self.min_useful or found < self.min_useful:
                raise

    def _sequences(self, part: FilePart) -> Iterator[str]:
        if not part.begin and part.end is None:
            with _opened(part.path) as raw:
                stream = gzip.open(raw) if urlsplit(part.path).path.endswith(".gz") else raw
                for i, line in enumerate(io.TextIOWrapper(io.BufferedReader(stream), errors="replace")):
                    if i % 4 == 1:
                        yield line.strip()
            return
        files, inner = _file_system(part.path)
        with files.open_input_file(inner) as raw:
            raw.seek(max(part.begin - 1, 0))
            stream = io.BufferedReader(raw)
            at = part.begin
            if part.begin:
                at += len(stream.readline()) - 1  # the line that the cut lies in, none if it lies between two
            held: list[bytes] = []
            if part.begin:
                # A record begins at a line with "@" whose second next has "+"; no other line of a record is followed so.
                while True:
                    while len(held) < 3 and (line := stream.readline()):
                        held.append(line)
                    if len(held) < 3:
                        return  # no whole record begins here
                    if held[0].startswith(b"@") and held[2].startswith(b"+"):
                        break
                    at += len(held.pop(0))
            while part.end is None or at < part.end:
                while len(held) < 4 and (line := stream.readline()):
                    held.append(line)
                if len(held) < 2:
                    return
                yield held[1].decode("utf-8", "replace").strip()
                at += sum(map(len, held))
                held = []


class FastqReader(FastqParts, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [part for path in self.paths for part in self.parts_of(path)]


class FastqStream(FastqParts, DataSourceStreamReader):
    """New files of folders, in the order of their names. A file must be whole when it appears, as under a rename.

    The offset holds the name and size of every file that was seen, so that a restart from a checkpoint
    neither loses nor repeats a read.
    """

    def initialOffset(self) -> dict:
        return {"seen": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        seen = {}
        for folder in self.paths:
            files, inner = _file_system(folder)
            prefix = folder[: len(folder.rstrip("/")) - len(inner.rstrip("/"))]
            for info in files.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True)):
                if info.type == fs.FileType.File and re.search(r"\.(fastq|fq)(\.gz)?$", info.path):
                    seen[prefix + info.path] = info.size
        return {"seen": json.dumps(seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = json.loads(start["seen"]), json.loads(end["seen"])
        return [part for path in sorted(now.keys() - before.keys()) for part in self.parts_of(path)]

    def commit(self, end: dict) -> None:
        pass


def _file_system(path: str):
    """Arrow's file system of a path, and the path inside it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _opened(path: str):
    """A byte stream of a file: over http(s) as the reader goes on, so that a limit ends the transfer, else through Arrow's file systems."""
    if re.match("https?://", path):
        return urlopen(path, timeout=300)
    files, path = _file_system(path)
    return files.open_input_stream(path, compression=None)


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_fastq(spark: SparkSession, paths: list[str], limit: int = 0, min_useful: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(path, read_idx, seq)`` of FASTQ files; names and qualities are not kept.

    Where a file is read in several ranges, these are counted first, so that ``read_idx`` counts within the file.
    """
    register_sources(spark)
    options = {"paths": ",".join(paths), "limit": limit, "min_useful": min_useful, "part_bytes": part_bytes}
    rows = spark.read.format("fastq").options(**options).load()
    if len(FastqReader({k: str(v) for k, v in options.items()}).partitions()) <= len(paths):
        return rows.drop("part")
    counts = rows.groupBy("path", "part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range: as many as tasks.
    ahead = counts.select("path", "part", ahead.alias("ahead"))
    return rows.join(F.broadcast(ahead), ["path", "part"]).select("path", (F.col("read_idx") + F.col("ahead")).alias("read_idx"), "seq")


def stream_fastq(spark: SparkSession, folders: list[str]) -> DataFrame:
    """A stream of ``(path, part, read_idx, seq)`` of the FASTQ files that appear in folders."""
    register_sources(spark)
    return spark.readStream.format("fastq").option("paths", ",".join(folders)).load()


def _size(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file or folder on whatever file system the path names, or None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(at).getLength() if files.exists(at) else None


def read_reference(spark: SparkSession, path: str, least: int = 1000) -> DataFrame:
    """As ``read_fasta``, of a cached reference; no rows where the file is absent or holds ``least`` bytes or fewer.

    An empty reference screens nothing out, so what depends on it goes on without.
    """
    if (_size(spark, path) or 0) > least:
        return read_fasta(spark, path)
    return spark.createDataFrame([], "id string, name string, seq string, n int, coverage double, path string")


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """One ``accession`` for each line that is not blank; where there is no such file, ``path`` itself is the one accession."""
    if _size(spark, path) is None:
        return spark.createDataFrame([(path.strip(),)], "accession string")
    return spark.read.text(path).select(F.trim("value").alias("accession")).where("accession <> ''")


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Archive metadata as tab-separated text with a header; all columns are strings."""
    return spark.read.csv(path, sep="\t", header=True)


def with_metadata(accessions: DataFrame, metadata: DataFrame, accession: str = "accession") -> DataFrame:
    """Every accession with its metadata and ``fetched``: false, and nulls, where the archive gave none."""
    known = metadata.withColumn("fetched", F.lit(True)).dropDuplicates([accession])
    return accessions.join(known, accession, "left").fillna({"fetched": False})


def run_urls(metadata: DataFrame, accession: str, column: str) -> DataFrame:
    """``(accession, mate, url)``: the semicolon-separated files of each run."""
    parts = metadata.select(accession, F.posexplode(F.split(F.coalesce(column, F.lit("")), ";")).alias("mate", "p")).where("trim(p) <> ''")
    return parts.select(accession, "mate", F.concat(F.lit("https://"), F.trim("p")).alias("url"))


def read_feature_names(spark: SparkSession, path: str, comments: str = "#") -> DataFrame:
    """``name``: the first column of a feature table (GFF or tabular), without comments and table heads."""
    first = F.element_at(F.split(F.trim("value"), r"\s+"), 1)
    rows = spark.read.text(path).where(F.trim("value") != "").where(~F.startswith(F.trim("value"), F.lit(comments)))
    return rows.select(first.alias("name")).where(~F.col("name").isin("Sequence", "Name") & ~F.startswith("name", F.lit("---"))).distinct()


def junction_evidence(alignments: DataFrame, suffix: str = "_junction") -> DataFrame:
    """``(sseqid, n_reads)``: distinct reads that align to each subject of that name ending."""
    return alignments.where(F.endswith("sseqid", F.lit(suffix))).groupBy("sseqid").agg(F.count_distinct("qseqid").alias("n_reads"))


def write_labels(df: DataFrame, path: str, key: str, label: str) -> None:
    """Ground truth as JSON lines of ``id`` and ``label``, sorted by id within each file."""
    df.select(F.col(key).alias("id"), F.col(label).cast("boolean").alias("label")).sortWithinPartitions("id").write.json(path)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Tabular alignments without a header, nine columns."""
    return spark.read.csv(path, sep="\t", schema="qseqid string, sseqid string, pident double, length int, qstart int, qend int, sstart int, send int, evalue double")


def read_blast_report(reports: DataFrame, key: str, report: str, most: int = 10) -> DataFrame:
    """``(key, rank, accession, description, score, evalue, identity)``: the description tables of text reports.

    The table starts below "Sequences producing significant alignments" and ends at ``ALIGNMENTS`` or at
    a line that starts with ``>``. Reports that state that nothing significant was found have no rows.
    """
    text = F.col(report)
    table = F.regexp_extract(text, r"(?s)Sequences producing significant alignments[^\n]*\n(.*?)(?:\nALIGNMENTS|\n>|\z)", 1)
    found = F.when(F.contains(text, F.lit("No significant similarity found")), F.lit("")).otherwise(table)
    lines = reports.select(key, F.posexplode(F.split(found, "\r?\n")).alias("line", "t")).select(key, "line", F.trim("t").alias("t"))
    words = lines.where("t <> '' AND NOT startswith(t, '(')").withColumn("w", F.split("t", r"\s+")).where("size(w) >= 3")
    rest = F.when(F.endswith(F.element_at("w", -1), F.lit("%")), F.slice("w", 1, F.size("w") - 1)).otherwise(F.col("w"))
    identity = F.when(F.endswith(F.element_at("w", -1), F.lit("%")), F.regexp_replace(F.element_at("w", -1), "%", "")).try_cast("double")
    rows = words.select(key, "line", identity.alias("identity"), rest.alias("w")).where("size(w) >= 3")
    # With a percentage last, coverage columns may stand between; score and e-value are the last two numbers.
    evalue, score = F.element_at("w", -1).try_cast("double"), F.element_at("w", -2).try_cast("double")
    hits = rows.select(key, "line", F.element_at("w", 1).alias("accession"), F.array_join(F.slice("w", 2, F.size("w") - 3), " ").alias("description"), score.alias("score"), evalue.alias("evalue"), "identity").where("score IS NOT NULL AND evalue IS NOT NULL")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("line"))).where(F.col("rank") <= most).drop("line")
