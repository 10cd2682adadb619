"""The corpus pipeline: each stage works on what its predecessor kept and is written before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, jaccard, quality, secrets
from lodestone.llm.common import bounded_batches, table, written

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the fertility bands reject; null and empty texts are among them.

    Repeated rows get the same verdict each, doc_ids play no part, an empty table stays empty.
    """
    return quality.quality(docs).where("kept").select(*docs.columns)


def jaccard_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies the document with the smallest doc_id, those without one last.

    Rows with equal doc_id (or none) and equal text count as one document, of which the row with the smallest other
    columns stays. Different texts under one doc_id are different documents; the smaller hash of doc_id and text goes first.
    """
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    odd = docs.where("doc_id IS NULL").select("doc_id").union(repeated)
    if odd.isEmpty():
        keep = jaccard.similarity_classes(docs).where("doc_id = component_id").select("doc_id")
        return docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    strange = docs.where("doc_id IS NULL").unionByName(docs.join(repeated, "doc_id", "left_semi"))
    strange = strange.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*")
    plain = docs.where("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti")
    # Each document gets a key of its own: its doc_id where that is unique, else a hash.
    keyed = written(plain.withColumn("key", F.col("doc_id")).unionByName(strange.withColumn("key", F.xxhash64("doc_id", "text"))), "keyed")
    classes = jaccard.similarity_classes(keyed.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"]
    keep = keyed.select("key", "doc_id").join(classes, "key").groupBy("component_id").agg(first.alias("key")).select("key")
    return keyed.join(keep, "key", "left_semi").select(*docs.columns)


def benchmark_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; a null text stays null, every row stays, also repeated ones."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("text", F.col("clean")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks what the forest takes for a secret; a null text stays null, every row stays, also repeated ones."""
    out = secrets.scan(docs, secrets.trained(spark))
    return out.withColumn("text", F.col("masked")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids) of each text that is left; ids are little-endian unsigned 32-bit integers.

    A null text has no ids; rows are independent.
    """
    out = bpe.round_trip(docs)
    return out.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def entered(stage: Callable) -> Callable:
    """``stage`` with small Arrow batches, whichever stage a session begins with."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable]] = [
    ("quality rules", entered(quality_rules)),
    ("n-gram Jaccard join", entered(jaccard_classes)),
    ("benchmark decontamination", entered(benchmark_removal)),
    ("secret scans", entered(secret_masking)),
    ("BPE encoding", entered(token_ids)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENTS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
