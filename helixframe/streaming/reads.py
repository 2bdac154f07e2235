"""Structured Streaming over reads and events: exact and bounded k-mer counts, prefix counts, tumbling windows.

State is Spark's own keyed state, spilled and checkpointed by the engine, and counts are exact. A stream
without end sees ever new k-mers (every misread base makes k of them): ``bounded_kmer_counts`` keeps its
state below a bound, and says of each count by how much it may be short.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import kmers
from ..functions.packed import kmer_rows, unpacked
from ..scratch import shared_dir


def kmer_count_stream(reads: DataFrame, k: int, min_count: int = 1, seq: str = "seq") -> DataFrame:
    """Running ``(kmer, cnt)`` of a stream of reads; use in complete or update mode."""
    rows = reads.select(F.explode(kmers(F.upper(seq), k, "ACGT")).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count)


def bounded_kmer_counts(reads: DataFrame, k: int, most: int = 1 << 17, buckets: int = 1024, seq: str = "seq") -> DataFrame:
    """Running counts of a stream of reads within a bound: ``(bucket, kmer, cnt, upper, floor, n_pruned)``, in update mode.

    k-mers are dealt into ``buckets`` by hash, and a bucket holds at most ``most`` of them (24 bytes each),
    in its state and in memory. One more makes its floor rise until a tenth is free: what cannot have
    occurred more often than the floor is pruned. The true count of a k-mer lies between ``cnt`` and ``upper``,
    which differ only if the k-mer first came, or came back, after a floor had risen; of a k-mer that is not held
    it is at most the floor. Until a bucket is full all its counts are exact.

    Each batch gives the k-mers that it counted and that are held after it, and for each bucket that it touched
    a row with a null ``kmer``, so that a floor is known even where nothing is left; ``n_pruned`` is how many
    k-mers the bucket has pruned so far. ``held_counts`` puts batches together. The session must keep state in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``). Null and short reads have no k-mers.
    """
    if most < 10 or buckets < 1:
        raise ValueError("a bucket needs room for ten k-mers, and there must be one")
    rows = kmer_rows(reads, k, [], seq).select(F.expr(f"CAST(pmod(xxhash64(kmer), {buckets}) AS INT)").alias("bucket"), "kmer", "times")
    counted = rows.groupBy("bucket").transformWithStateInPandas(
        _BoundedCounts(most), "bucket int, kmer long, cnt long, upper long, floor long, n_pruned long", outputMode="Update", timeMode="None"
    )
    return counted.withColumn("kmer", unpacked("kmer", k))


class _BoundedCounts(StatefulProcessor):
    """The k-mers of one bucket, sorted, their counts, and what each may have lost before it was held."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "kmers binary, counts binary, lost binary, floor long, pruned long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kmers, counts, lost, floor, pruned = self._load()
        touched = np.zeros(len(kmers), bool)
        for batch in rows:
            for at in range(0, len(batch), self.most):
                part = batch.iloc[at : at + self.most]
                new, where = np.unique(part["kmer"].to_numpy(np.int64), return_inverse=True)
                times = np.bincount(where, part["times"].to_numpy(np.int64), len(new)).astype(np.int64)
                joined, first = np.unique(np.concatenate([kmers, new]), return_index=True)
                old = np.searchsorted(joined, kmers)
                sums, short, seen = np.zeros(len(joined), np.int64), np.full(len(joined), floor), np.zeros(len(joined), bool)
                sums[old], short[old], seen[old] = counts, lost, touched
                added = np.searchsorted(joined, new)
                sums[added] += times
                seen[added] = True
                kmers, counts, lost, touched = joined, sums, short, seen
                if len(kmers) > self.most:
                    upper, free = counts + lost, len(kmers) - self.most + self.most // 10
                    floor = max(floor, int(np.partition(upper, free - 1)[free - 1]))
                    stay = upper > floor
                    pruned += int(len(stay) - stay.sum())
                    kmers, counts, lost, touched = kmers[stay], counts[stay], lost[stay], touched[stay]
        self.state.update((kmers.tobytes(), counts.tobytes(), lost.tobytes(), floor, pruned))
        size = int(touched.sum())
        none = np.arange(size + 1) == size  # the bucket's own row
        last = pd.DataFrame({
            "kmer": pd.arrays.IntegerArray(np.append(kmers[touched], 0), none),
            "cnt": np.append(counts[touched], 0),
            "upper": np.append((counts + lost)[touched], floor),
        })
        last.insert(0, "bucket", key[0])
        yield last.assign(floor=floor, n_pruned=pruned)

    def _load(self):
        if not self.state.exists():
            return *(np.zeros(0, np.int64) for _ in range(3)), 0, 0
        *arrays, floor, pruned = self.state.get()
        return *(np.frombuffer(bytes(x), np.int64) for x in arrays), int(floor), int(pruned)

    def close(self) -> None:
        pass


def held_counts(updates: DataFrame, batch: str = "batch") -> DataFrame:
    """``(bucket, kmer, cnt, upper)`` that are held after the last of the batches of ``bounded_kmer_counts``: of each k-mer the last row, if the floor has not reached it since."""
    floors = updates.groupBy("bucket").agg(F.max("floor").alias("_floor"))  # a row for each bucket
    last = updates.where("kmer IS NOT NULL").groupBy("bucket", "kmer").agg(F.max_by(F.struct("cnt", "upper"), batch).alias("v"))
    return last.select("bucket", "kmer", "v.*").join(floors, "bucket").where("upper > _floor").drop("_floor")


def prefix_profile_stream(reads: DataFrame, by: list[str], seq: str = "seq", prefix: int = 20) -> DataFrame:
    """Running ``(by..., prefix, n)`` of a stream of reads."""
    s = F.upper(F.trim(F.col(seq)))
    return reads.where(F.length(s) >= prefix).groupBy(*by, F.substring(s, 1, prefix).alias("prefix")).agg(F.count("*").alias("n"))


def tumbling_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``(start, by..., n)`` of tumbling windows; rows later than ``late`` behind the newest are dropped in append mode."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), *by, "n")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all input there is, keeps the result in the shared folder and reads it.

    In complete mode the last batch stays; else all do, each in a folder of its own, so that a batch that is run
    again replaces its rows. In update mode the number of each row's ``batch`` is added.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows" + ("" if mode == "complete" else f"/batch={number}"))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    numbered = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/rows")
    return numbered if mode == "update" else numbered.drop("batch")
