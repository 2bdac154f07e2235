"""The corpus pipeline: quality, near-duplicates, benchmark passages, pieces.

Every stage takes the documents that its predecessor kept and is written and read again before the
next. All but the last return the columns of ``documents``, further columns of any name included.
Empty tables pass through every stage; rows are taken as they come, whatever is null in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.decontamination import find_passages
from helixframe.llm.near_texts import without_near_duplicates
from helixframe.llm.pieces import encode_texts, ids_digest
from helixframe.llm.quality import fit_quality, score_quality
from helixframe.llm.queries import MODEL_PATH
from helixframe.llm.shared import free_name, saved, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Null and empty texts and null metadata are judged as such; repeated rows go or stay together. Where
    ``labels`` has documents of one kind only, all are kept.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where(F.col(free_name(docs, "accepted"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, of repeated rows one.

    Null, empty and blank texts are duplicates only of equal ones (null counts as empty); a row with a
    null id stays only where all of its group have none.
    """
    return without_near_duplicates(docs, "doc_id", "text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none, and an empty benchmark finds nothing."""
    found = find_passages(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.where(F.size(free_name(docs, "hits")) == 0).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with digests of the ids and of the text they decode to; a null or empty text is the end id alone."""
    out = encode_texts(docs.select("doc_id", "text"), "text", MODEL_PATH)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", ids_digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
