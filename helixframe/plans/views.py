"""Sequence views over the given tables: texts mapped letter by letter onto A, C, G and T.

``fenced`` passes a computed column through a generator. The optimizer does not push expressions
through one, so the mapping is computed once for each row instead of once for each later use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import revcomp
from ..operators.quality import ADAPTERS

LETTERS, MAPPED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of them; a stream takes a file's path only as a pattern."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def mapped(text: str) -> Column:
    return F.translate(F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]", "")), LETTERS, MAPPED)


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    names = list(columns)
    kept = df.columns
    out = df.select("*", F.explode(F.array(F.struct(*(columns[n].alias(n) for n in names)))).alias("_fenced"))
    return out.select(*(c for c in kept if c not in names), *(F.col(f"_fenced.{n}").alias(n) for n in names))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(contig_id, source, lang, seq)``: every document, whole."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig_id"), "source", "lang", "text")
    return fenced(docs, seq=mapped("text")).drop("text")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(contig_id, kind, seq)``: each contig plain, reverse-complemented, and with its first 40 bases again at its end."""
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("seq").alias("s")),
        F.struct(F.lit(1).alias("kind"), revcomp("seq").alias("s")),
        F.struct(F.lit(2).alias("kind"), F.concat("seq", F.substring("seq", 1, 40)).alias("s")),
    )
    return contigs(spark, sf_dir).select("contig_id", F.explode(kinds).alias("x")).select((F.col("contig_id") * 4 + F.col("x.kind")).alias("contig_id"), "x.kind", F.col("x.s").alias("seq"))


def adapter_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(contig_id, kind, seq)``: each contig plain, with a whole adapter, with a cut-off adapter and with a run of A."""
    pick = F.element_at(F.array(*map(F.lit, ADAPTERS)), (F.pmod("contig_id", F.lit(len(ADAPTERS))) + 1).cast("int"))
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), s.alias("s")) for i, s in enumerate((F.col("seq"), F.concat("seq", pick, F.lit("CG")), F.concat("seq", F.substring(pick, 1, 12)), F.concat("seq", F.lit("A" * 12))))))
    return contigs(spark, sf_dir).select("contig_id", F.explode(kinds).alias("x")).select("contig_id", "x.kind", F.col("x.s").alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(lang, seq)``: documents with their language and conversation turns under ``chat``."""
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("lang"), "text")
    return fenced(docs.unionByName(turns), seq=mapped("text")).drop("text")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, seq)``: the benchmark, standing in for a panel of known sequences."""
    return fenced(table(spark, sf_dir, "benchmark").select("item_id", "text"), seq=mapped("text")).drop("text")
