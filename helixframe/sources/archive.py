"""Library metadata of sequencing runs from an archive's search service, as a data source.

The accessions come by filter pushdown, so that a query names the runs that it wants:
``spark.read.format("run_metadata").option("url", ...).load().where("accession IN (...)")``. The session
needs ``spark.sql.python.filterPushdown.enabled``. One request is sent for each run, by many tasks.
"""

from __future__ import annotations

import csv
import time
import urllib.parse
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .services import http, tried

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Columns of the archive's answer, in its spelling.
COLUMNS = ["library_strategy", "library_selection", "library_source", "instrument_platform", "scientific_name", "study_accession"]
RESULT, KEY, READS = "read_run", "run_accession", "read_count"


class RunMetadataSource(DataSource):
    """One row for each accession asked for; ``fetched`` is false, and the rest null, where the archive gave none.

    Options: ``url`` of the service, ``attempts`` and ``pause`` (seconds, growing with each attempt) of a
    request, ``timeout``, ``runs`` that one task asks for.
    """

    @classmethod
    def name(cls) -> str:
        return "run_metadata"

    def schema(self) -> str:
        return ", ".join(["accession string", *(f"{c} string" for c in COLUMNS), "read_count long", "fetched boolean"])

    def reader(self, schema) -> DataSourceReader:
        return RunMetadataReader(dict(self.options))


class Runs(InputPartition):
    def __init__(self, accessions: list[str]):
        self.accessions = accessions


class RunMetadataReader(DataSourceReader):
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.url, self.attempts, self.pause = low["url"], int(low.get("attempts", 3)), float(low.get("pause", 2))
        self.timeout, self.runs = float(low.get("timeout", 30)), int(low.get("runs", 20))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("accession",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.wanted is None:
            raise ValueError(f"name the runs: a filter on accession is needed, and {PUSHDOWN} must be true")
        names = sorted(x for x in self.wanted if x)
        return [Runs(names[i : i + self.runs]) for i in range(0, len(names), self.runs)] or [Runs([])]

    def read(self, partition: Runs) -> Iterator[tuple]:
        send = http(timeout=self.timeout)
        for accession in partition.accessions:
            asked = urllib.parse.urlencode({"accession": accession, "result": RESULT, "format": "tsv", "fields": ",".join([KEY, *COLUMNS, READS])})
            try:
                text = tried(lambda: send(f"{self.url}?{asked}", None), self.attempts, self.pause, time.sleep)
            except OSError:
                text = ""
            row = next(csv.DictReader((line for line in text.splitlines() if line.strip()), delimiter="\t"), None)
            if row is None:
                yield (accession, *[None] * len(COLUMNS), None, False)
            else:
                reads = row.get(READS) or ""
                yield (accession, *(row.get(c) or "" for c in COLUMNS), int(reads) if reads.isdigit() else None, True)


def run_metadata(spark: SparkSession, accessions: list[str], url: str, **options) -> DataFrame:
    """The source's rows for a list of accessions; fails where the session does not push filters down."""
    if spark.conf.get(PUSHDOWN, "false") != "true":
        raise ValueError(f"set {PUSHDOWN} to true")
    spark.dataSource.register(RunMetadataSource)
    rows = spark.read.format("run_metadata").options(url=url, **options).load()
    return rows.where(rows["accession"].isin(list(accessions)))
