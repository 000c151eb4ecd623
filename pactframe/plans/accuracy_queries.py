"""Review-tier, verification and accuracy queries."""

from pyspark.sql import functions as F

from pactframe.operators import accuracy
from pactframe.plans.registry import register

TIER = "case when confidence <= 50 then 'deep' when confidence <= 80 then 'light' else 'auto' end"
# whole tenths from integer counts, half up, divided once
MEASURES = """count(*) as sampled,
      ((2000 * sum(case when was_correct then 1 else 0 end) + count(*)) // (2 * count(*))) / 10.0 as measured_accuracy_pct,
      ((20 * sum(confidence) + count(*)) // (2 * count(*))) / 10.0 as mean_self_reported_confidence"""


def tiered(t):
    return accuracy.tiered_points(t("dom_data_points"))


@register("tiered_points", f"select id, contract_id, field, confidence, {TIER} as tier from dom_data_points")
def tiered_points(t):
    return tiered(t).select("id", "contract_id", "field", "confidence", "tier")


@register(
    "accuracy_by_tier",
    f"select {TIER} as tier, {MEASURES} from dom_data_points where was_correct is not null group by 1",
)
def accuracy_by_tier(t):
    return accuracy.accuracy_by_tier(tiered(t))


@register(
    "calibration_curve",
    f"""select cast(least(confidence // 10, 9) * 10 as integer) as decile, {MEASURES}
    from dom_data_points where was_correct is not null group by 1""",
)
def calibration_curve(t):
    return accuracy.calibration_curve(t("dom_data_points"))


@register(
    "verification_queue",
    f"select id, contract_id, field, confidence, {TIER} as tier from dom_data_points where status = 'pending'",
)
def verification_queue(t):
    return accuracy.verification_queue(tiered(t)).select("id", "contract_id", "field", "confidence", "tier")


@register(
    "latest_data_points",
    """select contract_id, id, field, created_at, cast(recency as integer) as recency from (
      select *, row_number() over (partition by contract_id order by created_at desc, id desc) as recency
      from dom_data_points) x where recency <= 3""",
)
def latest_data_points(t):
    points = t("dom_data_points").select("contract_id", "id", "field", "created_at")
    return accuracy.latest_data_points(points, 3)


@register(
    "verification_state",
    """with newest as (select * from (select *, row_number() over (partition by data_point_id order by created_at desc, id desc) as rn
      from dom_verification_audit) x where rn = 1)
    select p.id as data_point_id,
      case when n.action = 'reopened' then 'pending' else coalesce(n.action, p.status) end as status,
      case when n.action <> 'reopened' then n.user_id end as verified_by,
      case when n.action <> 'reopened' then n.created_at end as verified_at,
      case when n.action = 'corrected' then n.value_after end as corrected_value, case when n.action = 'reopened' then n.user_id end as reopened_by
    from dom_data_points p left join newest n on n.data_point_id = p.id""",
)
def verification_state(t):
    return accuracy.verification_state(t("dom_data_points"), t("dom_verification_audit"))


@register(
    "score_findings",
    """with found as (select *, case when marker % 5 = 0 then null when marker % 2 = 0 then ' F' else 'o ' end as value from dom_data_points)
    select p.id, p.contract_id, p.field, p.value, k.expected as ground_truth,
      case when k.expected is not null then coalesce(lower(trim(p.value)) = lower(trim(k.expected)), false) end as was_correct
    from found p left join dom_answer_key k on k.contract_id = p.contract_id and k.field = p.field""",
)
def score_findings(t):
    value = F.when(F.col("marker") % 5 == 0, None).when(F.col("marker") % 2 == 0, " F").otherwise("o ")
    found = t("dom_data_points").select("id", "contract_id", "field", value.alias("value"))
    return accuracy.score_findings(found, t("dom_answer_key")).select(
        "id", "contract_id", "field", "value", "ground_truth", "was_correct"
    )


@register(
    "ocr_profile",
    """with docs as (select doc_type, count(*) as documents, count(*) filter (where scanned) as scanned,
        count(*) filter (where ocr_applied) as ocr_applied from dom_documents group by doc_type),
    kinds as (select contract_id, doc_type, bool_or(ocr_applied) as ocr from dom_documents
        where contract_id is not null group by contract_id, doc_type),
    points as (select k.doc_type, count(*) as points, count(*) filter (where k.ocr) as ocr_points
        from kinds k join dom_data_points p on p.contract_id = k.contract_id group by k.doc_type)
    select d.doc_type, documents, scanned, ocr_applied, round(100.0 * ocr_applied / documents, 1) as ocr_pct,
      coalesce(points, 0) as points, coalesce(ocr_points, 0) as ocr_points
    from docs d left join points p on p.doc_type is not distinct from d.doc_type""",
)
def ocr_profile(t):
    docs = t("dom_documents").select("doc_type", "contract_id", "scanned", "ocr_applied")
    return accuracy.ocr_profile(docs, t("dom_data_points").select("contract_id"))
