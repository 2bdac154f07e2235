"""Labelled synthetic contigs: each row draws from its own seed, so any partitioning gives the same table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import STOPS, revcomp

LETTERS = np.array(list("ACGT"))
SENSE = np.array([a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in STOPS])


def _random(rng: np.random.Generator, n: int, gc: float = 0.5) -> np.ndarray:
    return rng.choice(4, n, p=[(1 - gc) / 2, gc / 2, gc / 2, (1 - gc) / 2])


def _changed(rng: np.random.Generator, codes: np.ndarray, rate: float) -> np.ndarray:
    """Each base replaced by another one with chance ``rate``."""
    hit = rng.random(len(codes)) < rate
    return np.where(hit, (codes + rng.integers(1, 4, len(codes))) % 4, codes)


def stem_loop(rng: np.random.Generator, stem: int, loop: int, mismatch: float = 0.05) -> np.ndarray:
    """An arm, a loop, and the arm's opposite strand with a few mismatches."""
    arm = _random(rng, stem)
    return np.concatenate([arm, _random(rng, loop), _changed(rng, 3 - arm[::-1], mismatch)])


def rod(rng: np.random.Generator, hairpins: int, stem: int = 14, loop: int = 5, linker: int = 3) -> np.ndarray:
    """Stem-loops in a row with linkers between them."""
    return np.concatenate([p for i in range(hairpins) for p in ([_random(rng, linker)] if i else []) + [stem_loop(rng, stem, loop)]])


def reading_frame(rng: np.random.Generator, codons: int, bias: float = 3.0) -> str:
    """ATG, codons of skewed usage, a stop."""
    weights = 1.0 / np.arange(1, len(SENSE) + 1) ** (bias / 10)
    return "ATG" + "".join(rng.choice(rng.permutation(SENSE), codons, p=weights / weights.sum())) + str(rng.choice(STOPS))


def _text(codes: np.ndarray) -> str:
    return "".join(LETTERS[codes])


def _molecule(kind: str, seed: int) -> str:
    rng = np.random.default_rng(seed & (1 << 63) - 1)
    if kind.startswith("rod_sas"):
        return _text(rod(rng, int(rng.integers(3, 6)), 10, 4, 2))
    if kind == "coding_decoy":
        return reading_frame(rng, int(rng.integers(30, 91)))
    if kind == "structured_coding_decoy":
        orf, hairpin = reading_frame(rng, int(rng.integers(30, 71))), _text(stem_loop(rng, 12, 5))
        return orf + hairpin if rng.random() < 0.5 else hairpin + orf
    return _text(_random(rng, int(rng.integers(120, 401))))


def molecules(kind: Column, seed: Column) -> Column:
    """A sequence of the given kind for each row."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, seeds in batches:
            yield pd.Series([_molecule(k, int(s)) for k, s in zip(kinds, seeds, strict=True)], dtype="object")

    return run(kind, seed.cast("long"))


def mutated(seq: Column, seed: Column, rate: float = 0.03) -> Column:
    """Each base replaced by another one with chance ``rate``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, seeds in batches:
            yield pd.Series([_text(_changed(np.random.default_rng(int(s) & (1 << 63) - 1), np.array(["ACGT".index(c) for c in t], int), rate)) for t, s in zip(texts, seeds, strict=True)], dtype="object")

    return run(seq, seed.cast("long"))


def circularized(seq: Column, share: float) -> Column:
    """The start of a molecule once more at its end, as assemblers write circles."""
    return F.concat(seq, F.substring(seq, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(seq) * share).cast("int"))))


def calibration_corpus(spark: SparkSession, seed: int, positives: int = 12, coding: int = 60, structured: int = 20, plain: int = 60, replicates: tuple[int, int] = (2, 4), circular: float = 0.5) -> DataFrame:
    """``(id, seq, is_true_positive, element_id, kind)``: rods in sense and antisense replicates, some circular, and three kinds of decoys."""
    draw = lambda *of: F.xxhash64(F.lit(seed), *of)
    share = lambda h: F.pmod(h, F.lit(1_000_000)) / 1_000_000
    kind = F.when(share(draw("n", F.lit("circle"))) < circular, "rod_sas_circular").otherwise("rod_sas")
    elements = spark.range(positives).withColumnRenamed("id", "n").select(F.format_string("POS%03d", "n").alias("element_id"), kind.alias("kind"), (F.pmod(draw("n", F.lit("copies")), F.lit(replicates[1] - replicates[0] + 1)) + replicates[0]).alias("copies"))
    copies = elements.withColumn("monomer", molecules(F.col("kind"), draw("element_id"))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    both = copies.withColumn("strand", F.explode(F.array(F.lit("sense"), F.lit("antisense"))))
    strands = both.withColumn("s", mutated(F.col("monomer"), draw("element_id", "r", "strand")))
    turned = strands.withColumn("s", F.when(F.col("strand") == "antisense", revcomp("s")).otherwise(F.col("s")))
    rods = turned.select(F.concat_ws("_", "element_id", F.concat(F.lit("rep"), "r"), "strand").alias("id"), F.when(F.col("kind") == "rod_sas_circular", circularized(F.col("s"), 0.08)).otherwise(F.col("s")).alias("seq"), F.lit(True).alias("is_true_positive"), "element_id", "kind")
    out = rods
    for name, prefix, count in (("coding_decoy", "CODE", coding), ("structured_coding_decoy", "STRCODE", structured), ("plain_null", "NULL", plain)):
        ids = spark.range(count).select(F.format_string(f"{prefix}%03d", "id").alias("id"))
        out = out.union(ids.select("id", molecules(F.lit(name), draw("id")).alias("seq"), F.lit(False).alias("is_true_positive"), F.col("id").alias("element_id"), F.lit(name).alias("kind")))
    return out
