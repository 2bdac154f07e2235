"""Helpers that the operators share: table access, shared scratch tables, safe column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path is only ever opened by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and the master is local.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and reads it back: a stable input whose
    lineage is cut, so that a lost executor costs no recomputation and every reader sees equal rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of ``saved`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where the input already has a column of that name (any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows whose ``text`` column holds about ``chars`` bytes at most
    (a single longer row stands alone), so that a task's memory does not follow the batch size."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = held = 0
        for i, size in enumerate(pc.binary_length(column).to_pylist()):
            if i > start and (held + (size or 0) > chars or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of a partition sorted by ``keys``: one Arrow table for each run of equal keys.

    Only the rows of the batch at hand and of the one open group are held.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns, strict=True)):
            if last is not None and key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start = [], i
            last = key
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
