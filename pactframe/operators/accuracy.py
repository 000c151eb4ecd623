"""Review tiers, verification state and measured accuracy of data points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pactframe.functions.columns import confidence_tier, half_up, percent
from pactframe.functions.spread import newest_per_key
from pactframe.operators.tenancy import in_scope


def tiered_points(points: DataFrame) -> DataFrame:
    """Adds the review tier.  Write it with the row: later thresholds must not rewrite history."""
    return points.withColumn("tier", confidence_tier(F.col("confidence")))


def _accuracy(rows: DataFrame, *by: Column) -> DataFrame:
    labelled = rows.filter(F.col("was_correct").isNotNull())
    sums = labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_if("was_correct").alias("_right"),
        F.sum("confidence").alias("_confidence"),
    )
    return sums.select(
        *[c for c in sums.columns if c not in ("sampled", "_right", "_confidence")],
        "sampled",
        percent(F.col("_right"), F.col("sampled")).alias("measured_accuracy_pct"),
        half_up(F.col("_confidence"), F.col("sampled"), 1).alias("mean_self_reported_confidence"),
    )


def accuracy_by_tier(points: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Sample size, percent correct and mean confidence per tier."""
    return _accuracy(in_scope(points, scope), F.col("tier"))


def calibration_curve(points: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """The same per confidence decile; 100 falls into the decile of 90."""
    decile = F.least(F.floor(F.col("confidence") / 10), F.lit(9)).cast("int") * 10
    return _accuracy(in_scope(points, scope), decile.alias("decile"))


def verification_queue(points: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Pending points, deep tier first and least confident first."""
    depth = F.when(F.col("tier") == "deep", 0).when(F.col("tier") == "light", 1).otherwise(2)
    return in_scope(points, scope).filter(F.col("status") == "pending").orderBy(depth, "confidence", "id")


def latest_data_points(points: DataFrame, n: int, scope: DataFrame | None = None) -> DataFrame:
    """The n newest points per contract.

    The rank filter is applied in the map tasks too, so a contract with many
    points sends at most n rows per task through the shuffle.
    """
    recency = W.partitionBy("contract_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return in_scope(points, scope).withColumn("recency", F.row_number().over(recency)).filter(F.col("recency") <= n)


def verification_state(points: DataFrame, audit: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Status of each point after replaying its audit log.

    The newest action decides; ``reopened`` puts the point back to pending,
    without a corrected value and with who reopened it, and a point without
    audit rows keeps its own status.
    """
    newest = newest_per_key(
        audit.select("data_point_id", "id", "user_id", "action", "value_after", "created_at"), ["data_point_id"], ["created_at", "id"]
    ).select(
        F.col("data_point_id"),
        F.when(F.col("action") == "reopened", "pending").otherwise(F.col("action")).alias("_replayed"),
        F.when(F.col("action") != "reopened", F.col("user_id")).alias("verified_by"),
        F.when(F.col("action") != "reopened", F.col("created_at")).alias("verified_at"),
        F.when(F.col("action") == "corrected", F.col("value_after")).alias("corrected_value"),
        F.when(F.col("action") == "reopened", F.col("user_id")).alias("reopened_by"),
    )
    rows = in_scope(points, scope).select(F.col("id").alias("data_point_id"), F.col("status").alias("_own"))
    return rows.join(newest, "data_point_id", "left").select(
        "data_point_id", F.coalesce("_replayed", "_own").alias("status"), "verified_by", "verified_at",
        "corrected_value", "reopened_by",
    )


def score_findings(points: DataFrame, answers: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Fills ground_truth and was_correct from an answer key.

    ``answers`` has (contract_id, field, expected), unique per contract and
    field.  Values compare trimmed and without case; a point with no answer
    stays unlabelled, a missing value with an answer is wrong.
    """
    key = answers.select("contract_id", "field", F.col("expected").alias("ground_truth"))

    def normal(c: Column) -> Column:
        return F.lower(F.trim(c))

    right = F.coalesce(normal(F.col("value")) == normal(F.col("ground_truth")), F.lit(False))
    rows = in_scope(points, scope).drop("ground_truth", "was_correct")
    return rows.join(key, ["contract_id", "field"], "left").withColumn(
        "was_correct", F.when(F.col("ground_truth").isNotNull(), right)
    )


def ocr_profile(documents: DataFrame, points: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Scanned and OCR-read documents per type, and the points that rest on OCR text.

    A point rests on OCR when any document of its contract was read by OCR.
    Points and documents are both counted per contract first, so the join is
    one row per contract on either side.
    """
    docs = in_scope(documents, scope)
    mix = docs.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("scanned").alias("scanned"),
        F.count_if("ocr_applied").alias("ocr_applied"),
    )
    per_contract = points.groupBy("contract_id").agg(F.count(F.lit(1)).alias("_points"))
    per_type = docs.filter(F.col("contract_id").isNotNull()).groupBy("contract_id", "doc_type").agg(
        F.max(F.coalesce("ocr_applied", F.lit(False))).alias("_ocr")
    )
    backed = (
        per_type.join(per_contract, "contract_id")
        .groupBy(F.col("doc_type").alias("_type"))
        .agg(
            F.sum("_points").alias("points"),
            F.sum(F.when(F.col("_ocr"), F.col("_points")).otherwise(0)).alias("ocr_points"),
        )
    )
    return mix.join(backed, F.col("doc_type").eqNullSafe(F.col("_type")), "left").select(
        "doc_type",
        "documents",
        "scanned",
        "ocr_applied",
        percent(F.col("ocr_applied"), F.col("documents")).alias("ocr_pct"),
        F.coalesce("points", F.lit(0)).alias("points"),
        F.coalesce("ocr_points", F.lit(0)).alias("ocr_points"),
    )
