"""Database identification with a client of the caller's choice, and the verdict over what came back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIT = "struct<accession: string, description: string, score: double, evalue: double, identity: double>"
SERVICES = ("family", "nucleotide", "protein")


def look_up(records: DataFrame, key: str, seq: str, client: Callable[[], Callable[[str, str], list[dict]]], services: tuple[str, ...] = SERVICES) -> DataFrame:
    """``(key, service, hits, error)``: what each service says of each sequence.

    ``client()`` is called once in a task and gives ``search(service, seq) -> hits``. A failed search
    leaves an error and no hits, which differs from a search that found nothing. A null or empty sequence
    is not sent: it has the error "no sequence".
    """
    rows = records.select(key, seq, F.explode(F.array(*map(F.lit, services))).alias("service"))
    schema = T.StructType([records.schema[key], T.StructField("service", T.StringType()), T.StructField("hits", T.ArrayType(T._parse_datatype_string(HIT))), T.StructField("error", T.StringType())])
    fields = ("accession", "description", "score", "evalue", "identity")
    kind = pa.list_(pa.struct([(f, pa.string() if f in fields[:2] else pa.float64()) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = client()
        for batch in batches:
            hits, errors = [], []
            for service, text in zip(batch.column("service").to_pylist(), batch.column(seq).to_pylist(), strict=True):
                if not text:
                    hits.append([])
                    errors.append("no sequence")
                    continue
                try:
                    hits.append([{f: h.get(f) for f in fields} for h in search(service, text)])
                    errors.append(None)
                except (OSError, ValueError) as e:
                    hits.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("service"), pa.array(hits, kind), pa.array(errors, pa.string())], [key, "service", "hits", "error"])

    return rows.mapInArrow(run, schema)


def ask_families(records: DataFrame, key: str, seq: str, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``(key, answer, error)``: the JSON that a family search gives for each sequence, for ``sources.family_hits``.

    ``client()`` is called once in a task and gives ``answer(seq) -> text``. A failed search has an error and
    a null answer; null and empty sequences are not sent.
    """
    schema = T.StructType([records.schema[key], T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = client()
        for batch in batches:
            texts, errors = [], []
            for text in batch.column(1).to_pylist():
                got, error = None, None if text else "no sequence"
                try:
                    got = answer(text) if text else None
                except (OSError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                texts.append(got)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], [key, "answer", "error"])

    return records.select(key, seq).mapInArrow(run, schema)


def verdicts(found: DataFrame, key: str) -> DataFrame:
    """``(key, verdict, best)``: family before protein before nucleotide before failure before nothing."""
    of = lambda service: F.max(F.when((F.col("service") == service) & (F.size("hits") > 0), F.element_at("hits", 1)))
    rows = found.groupBy(key).agg(of("family").alias("f"), of("protein").alias("p"), of("nucleotide").alias("n"), F.count("error").alias("errors"))
    verdict = F.when(F.col("f").isNotNull(), "known family").when(F.col("p").isNotNull(), "protein-coding").when(F.col("n").isNotNull(), "known sequence").when(F.col("errors") > 0, "unresolved").otherwise("no match")
    return rows.select(key, verdict.alias("verdict"), F.coalesce("f.description", "p.description", "n.description").alias("best"))
