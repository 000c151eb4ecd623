"""The registered query of each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pactframe.llm import bag_search, bpe_codec, chat_format, html_blocks, license_dice, lsi_decontam, pii_sanitise, quality_forest, secret_links, simhash_dedup, turn_repair, url_templates, vector_dedup
from pactframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS = "byte_bpe_multi_50k.tiktoken"


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.link_documents(table(spark, sf_dir, "documents"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_codec.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True, keep_text=False)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_sanitise.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False, everywhere=True)

    def of(*wanted: str):
        return F.filter("spans", lambda s: s["kind"].isin(*wanted))

    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii_sanitise.BASE],
        F.sha2(secret_links.joined_spans(of(*pii_sanitise.BASE)), 256).alias("base_sha256"),
        secret_links.joined_spans(F.col("spans")).alias("spans"))


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_templates.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op4_url_filter"] = url_templates.ORACLE


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    # each row is a record of its own layout; a missing turn number must not change that
    record = F.to_json(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "role", "text"))
    turns = chat_format.canonical_turns(rows.select("conv_id", "turn", record.alias("record")))
    # rows of one turn number, which should not be, go by their formatted text
    read = chat_format.digests(chat_format.format_turns(turns), "conv_id", ("turn", "segment"))
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep_page=False)


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    kinds = ("assign", "access", "hex")

    def of(*wanted: str):
        return F.filter("secrets", lambda s: s["kind"].isin(*wanted))

    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(secret_links.joined_spans(of(*kinds)), 256).alias("base_sha256"),
        secret_links.joined_spans(F.col("secrets")).alias("spans"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_forest.judge(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return judged.select("doc_id", *quality_forest.COUNTS, "base_failed", "kept", "score")


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_dice.find_licenses(table(spark, sf_dir, "documents"))


ORACLES["op9_license_scan"] = license_dice.ORACLE


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lsi_decontam.find_items(docs, table(spark, sf_dir, "benchmark"))


@query
def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vector_dedup.near_duplicates(rows).select("vec_id", "n_links", "component_id", "kept")


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_ranked_search"] = bag_search.ORACLE


@query
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, turns = turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")))
    hashed = turn_repair.digests(turns).withColumnRenamed("conv_id", "c")
    return planned.join(hashed, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *turn_repair.PLAN, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
