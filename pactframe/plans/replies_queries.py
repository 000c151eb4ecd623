"""Reply parsing queries."""

from pyspark.sql import functions as F

from pactframe.operators import replies
from pactframe.plans.registry import register

# Lines of a message become its blocks: every third is not text, empty ones have no text.
LINES = "conv_id * 100 + turn as job_id, str_split(text, chr(10)) as lines"

# Two more reply shapes than the bound table: upper-case tags with prose, and two objects.
SHAPED = """select *, case job_id % 5 when 3 then 'Note ```JSON ' || reply || ' ```' when 4 then reply || ' {"n":7}' else reply end as text
    from dom_replies"""
PART = """select *, trim(regexp_replace(regexp_replace(trim(text, ' ' || chr(10)), '^```(json)?', '', 'i'), '```$', ''), ' ' || chr(10)) as bare from ({rows}) a"""
CUT = """select *, case when regexp_matches(bare, '(?s)\\{.*\\}') then regexp_extract(bare, '(?s)(\\{.*\\})', 1) else bare end as part from ({rows}) b"""
PARTS = CUT.replace("{rows}", PART.replace("{rows}", SHAPED))


def shaped(t):
    text = (
        F.when(F.col("job_id") % 5 == 3, F.concat(F.lit("Note ```JSON "), F.col("reply"), F.lit(" ```")))
        .when(F.col("job_id") % 5 == 4, F.concat(F.col("reply"), F.lit(' {"n":7}')))
        .otherwise(F.col("reply"))
    )
    return t("dom_replies").withColumn("text", text).drop("reply")


@register(
    "reply_text",
    f"""select job_id, array_to_string(list_transform(list_filter(list_zip(lines, range(0, len(lines))), lambda b: b[2] % 3 <> 2), lambda b: b[1]), chr(10)) as text
    from (select {LINES} from conversations) x""",
)
def reply_text(t):
    blocks = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.when(i % 3 == 2, "tool_use").otherwise("text").alias("type"), F.when(line != "", line).alias("text")
        ),
    )
    rows = t.base("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("job_id"), blocks.alias("content"))
    return replies.reply_text(rows).select("job_id", "text")


@register(
    "extract_json",
    f"""select job_id, json_valid(part) as valid, case when json_valid(part) then cast(json_extract(part, '$.n') as integer) end as n,
      case when not json_valid(part) then part end as quarantine from ({PARTS}) c""",
)
def extract_json(t):
    return replies.extract_json(shaped(t)).select(
        "job_id",
        F.col("parsed").isNotNull().alias("valid"),
        F.try_variant_get("parsed", "$.n", "int").alias("n"),
        "quarantine",
    )


@register(
    "reply_results",
    f"""select job_id, kind, case when kind not in ('analysis', 'reanalysis') then null
        when json_valid(part) then cast(json_extract(part, '$.n') as integer) end as n,
      case when kind not in ('analysis', 'reanalysis') then text end as text,
      kind in ('analysis', 'reanalysis') and not json_valid(part) as failed from ({PARTS}) c""",
)
def reply_results(t):
    return replies.reply_results(shaped(t)).select(
        "job_id",
        "kind",
        F.try_variant_get("result", "$.n", "int").alias("n"),
        F.try_variant_get("result", "$.text", "string").alias("text"),
        "failed",
    )


@register(
    "analysis_to_data_points",
    """select id as contract_id, 'extraction' as kind, 'supplier' as field, supplier as value, cast(50 + users_count as integer) as confidence, 'read' as reasoning, ref as source from dom_contracts
    union all
    select id, 'extraction', 'endDate', strftime(end_date, '%Y-%m-%d'), cast(90 as integer), null, ref from dom_contracts
    union all
    select id, 'clause', category, 'present', cast(40 as integer), null, null from dom_contracts
    union all
    select id, 'risk', 'autoRenewal', 'high', cast(70 as integer), null, null from dom_contracts where auto_renew""",
)
def analysis_to_data_points(t):
    def point(field, value, confidence, reasoning=None, source=None):
        return F.struct(
            field.alias("field"), value.alias("value"), confidence.alias("confidence"),
            F.lit(reasoning).cast("string").alias("reasoning"), (F.lit(None).cast("string") if source is None else source).alias("source"),
        )

    analysis = F.to_json(
        F.struct(
            F.array(
                point(F.lit("supplier"), F.col("supplier"), F.col("users_count") + 50, "read", F.col("ref")),
                point(F.lit("endDate"), F.col("end_date").cast("string"), F.lit(90), None, F.col("ref")),
            ).alias("extractions"),
            F.array(point(F.col("category"), F.lit("present"), F.lit(40))).alias("clauses"),
            F.when(F.col("auto_renew"), F.array(point(F.lit("autoRenewal"), F.lit("high"), F.lit(70)))).alias("risks"),
        )
    )
    rows = t("dom_contracts").select(F.col("id").alias("contract_id"), analysis.alias("analysis"))
    return replies.analysis_to_data_points(rows).select(
        "contract_id", "kind", "field", "value", "confidence", "reasoning", "source"
    )
