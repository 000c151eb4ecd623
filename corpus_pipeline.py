"""From raw documents to token ids: five stages, each on all that its predecessor kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame.  All but the last
return the columns of documents; rows that a stage rejects are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pactframe.llm import bpe_codec, lsi_decontam, quality_forest, secret_links, simhash_dedup
from pactframe.llm.common import table
from pactframe.llm.queries import RANKS
from pactframe.sources.tables import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are not anomalous."""
    # other names meanwhile, so that a document's own columns are never taken for the operator's
    own = docs.toDF(*[f"in_{c}" for c in docs.columns])
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "in_doc_id")
    judged = quality_forest.judge(own, labels, key="in_doc_id", text="in_text")
    return judged.where("kept").select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    return simhash_dedup.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return lsi_decontam.without_items(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text."""
    clean = secret_links.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    import public_tokenizers

    done = bpe_codec.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

# SimHash, the forest and the encoder are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
