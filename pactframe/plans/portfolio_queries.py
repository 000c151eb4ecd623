"""Renewal, supplier, clause, commitment and licence queries."""

from pyspark.sql import functions as F

from pactframe.functions.text import STOP_WORDS
from pactframe.operators import portfolio
from pactframe.plans.registry import register
from pactframe.plans.times import RENEWALS_AS_OF

TODAY = f"date '{RENEWALS_AS_OF}'"
RUNWAY = f"""runway as (select *, end_date - coalesce(notice_period_days, 90) as deadline,
    end_date - coalesce(notice_period_days, 90) < {TODAY} as missed from dom_contracts)"""
KEYED = """keyed as (select supplier, trim(array_to_string(list_filter(str_split(regexp_replace(lower(supplier), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '),
    lambda w: w not in ('ltd', 'limited', 'inc', 'gmbh', 'plc', 'llc', 'the', '')), ' ')) as supplier_key from dom_suppliers)"""
# the other two clauses of the test points count as further ones
FIELDS = [f"field{i}" for i in range(10)]


@register(
    "renewal_runway",
    f"""with {RUNWAY} select id, supplier, end_date, notice_period_days, deadline, missed,
      cast(deadline - {TODAY} as integer) as days_left from runway""",
)
def renewal_runway(t):
    return portfolio.renewal_runway(t("dom_contracts"), RENEWALS_AS_OF).select(
        "id", "supplier", "end_date", "notice_period_days", "deadline", "missed", "days_left"
    )


@register(
    "renewal_calendar",
    f"""with {RUNWAY} select cast(date_trunc('month', deadline) as date) as month, missed, count(*) as contracts,
      count(*) filter (where auto_renew) as auto_renewing, cast(sum(annual_value) as double) as annual_value
    from runway group by 1, 2""",
)
def renewal_calendar(t):
    return portfolio.renewal_calendar(t("dom_contracts"), RENEWALS_AS_OF)


@register(
    "supplier_portfolio",
    f"""with {RUNWAY} select supplier, category, count(*) as contracts, cast(sum(annual_value) as double) as annual_value,
      min(deadline) filter (where not missed) as next_deadline, cast(grouping(supplier, category) as bigint) as level
    from runway group by rollup(supplier, category)""",
)
def supplier_portfolio(t):
    return portfolio.supplier_portfolio(t("dom_contracts"), RENEWALS_AS_OF, ["category"])


@register(
    "supplier_merge",
    f"""with {KEYED} select supplier_key, min(supplier) as name, count(distinct supplier) as variants, count(*) as rows
    from keyed group by supplier_key""",
)
def supplier_merge(t):
    return portfolio.supplier_merge(t("dom_suppliers"))


NAMES = """names as (select distinct k.supplier_key || case when s.s_suppkey % 3 = 0 then ' trading' when s.s_suppkey % 3 = 1 then ' tradings' else ' works' end
      || case when s.s_suppkey % 7 = 0 then cast(s.s_suppkey % 1000 as varchar) else '' end as supplier_key
    from keyed k join supplier s on s.s_suppkey % 25 = cast(substr(k.supplier_key, 6) as integer))"""


@register(
    "supplier_near_misses",
    f"""with {KEYED}, {NAMES}
    select a.supplier_key, min(case when b.supplier_key < a.supplier_key then b.supplier_key end) as near_miss_before,
      max(case when b.supplier_key > a.supplier_key then b.supplier_key end) as near_miss_after
    from names a join names b on a.supplier_key <> b.supplier_key and levenshtein(a.supplier_key, b.supplier_key) <= 2
    group by a.supplier_key""",
)
def supplier_near_misses(t):
    return portfolio.supplier_near_misses(like_names(t))


def like_names(t):
    ending = F.when(F.col("id") % 3 == 0, " trading").when(F.col("id") % 3 == 1, " tradings").otherwise(" works")
    number = F.when(F.col("id") % 7 == 0, (F.col("id") % 1000).cast("string")).otherwise("")
    return t("dom_suppliers").select(F.concat(portfolio.supplier_key(F.col("supplier")), ending, number).alias("supplier"))


@register(
    "near_miss_classes",
    f"""with recursive {KEYED}, {NAMES},
  near as (select a.supplier_key as a, b.supplier_key as b from names a join names b
    on a.supplier_key <> b.supplier_key and levenshtein(a.supplier_key, b.supplier_key) <= 2),
  reached as (select a, b from near union select r.a, n.b from reached r join near n on n.a = r.b),
  least as (select a, least(a, min(b)) as class from reached group by a)
    select l.a as supplier_key, l.class, count(*) as links from least l join near n on n.a = l.a group by l.a, l.class""",
)
def near_miss_classes(t):
    return portfolio.near_miss_classes(like_names(t))


@register(
    "clause_matrix",
    "select c.id as contract_id, "
    + ", ".join(f"cast(max(case when field = '{f}' then 1 else 0 end) as integer) as {f}" for f in FIELDS)
    + f""", count(distinct case when field not in ({", ".join(f"'{f}'" for f in FIELDS)}) then field end) as other_clauses
    from dom_contracts c left join dom_data_points p on p.contract_id = c.id and p.kind = 'clause' group by c.id""",
)
def clause_matrix(t):
    return portfolio.clause_matrix(t("dom_contracts"), t("dom_data_points"), FIELDS)


@register(
    "clause_gaps",
    f"""with present as (select distinct contract_id, field from dom_data_points where kind = 'clause'),
    counted as (select c.id as contract_id, count(p.field) filter (where p.field in ({", ".join(f"'{f}'" for f in FIELDS)})) as n
      from dom_contracts c left join present p on p.contract_id = c.id group by c.id)
    select 'contract' as axis, contract_id as name, {len(FIELDS)} - n as missing from counted
    union all
    select 'clause', f.name, (select count(*) from counted) - count(p.contract_id)
    from (values {", ".join(f"('{f}')" for f in FIELDS)}) f(name) left join present p on p.field = f.name group by f.name""",
)
def clause_gaps(t):
    return portfolio.clause_gaps(t("dom_contracts"), t("dom_data_points"), FIELDS)


STOPPED = ", ".join(f"'{w}'" for w in STOP_WORDS)


def words(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')), lambda w: w not in ({STOPPED}))"


@register(
    "verbal_commitments",
    f"""with spoken as (select conv_id, turn, conv_id - conv_id % 3 as c, case turn % 3 when 0 then 'We will ' || text when 1 then text || ' I promise this. And shall we?' else text end as text from conversations),
    pieces as (select conv_id, turn, 'c' || cast(c as varchar) as contract_id, regexp_split_to_array(text, '[.!?\\n]+') as ps from spoken),
    said as (select conv_id, turn, contract_id, cast(i as integer) as sentence_ix, s as sentence, {words("s")} as ws
      from (select conv_id, turn, contract_id, unnest(ps) as s, unnest(range(0, len(ps))) as i from pieces) x
      where regexp_matches(s, '(?i)\\b(i|we)\\s+(will|shall|promise|agree|commit|guarantee)\\b')),
    texts as (select contract_id, extracted_text as body from dom_documents union all select contract_id, obligation from dom_obligations_raw),
    written as (select distinct contract_id, unnest({words("body")}) as term from texts where contract_id is not null),
    found as (select s.conv_id, s.turn, s.sentence_ix, count(w.term) as found from (select *, unnest(ws) as term from said) s
      join written w on w.contract_id = s.contract_id and w.term = s.term group by 1, 2, 3)
    select s.conv_id, s.turn, s.contract_id, s.sentence_ix, trim(s.sentence) as sentence, cast(len(s.ws) as integer) as terms, coalesce(f.found, 0) as found
    from said s left join found f using (conv_id, turn, sentence_ix) where coalesce(f.found, 0) < 3""",
)
def verbal_commitments(t):
    # the test texts hold no promises, so some turns get one
    spoken = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("We will "), "text")).when(
        F.col("turn") % 3 == 1, F.concat("text", F.lit(" I promise this. And shall we?"))).otherwise(F.col("text"))
    contract = F.concat(F.lit("c"), (F.col("conv_id") - F.col("conv_id") % 3).cast("string"))
    turns = t.base("conversations").select("conv_id", "turn", spoken.alias("text"), contract.alias("contract_id"))
    texts = t("dom_documents").select("contract_id", F.col("extracted_text").alias("text")).unionByName(
        t("dom_obligations_raw").select("contract_id", F.col("obligation").alias("text")))
    return portfolio.verbal_commitments(turns, texts)


@register(
    "needs_ocr",
    """select id, page_count, length(extracted_text) / page_count as chars_per_page, length(extracted_text) < page_count * 50 as needs_ocr
    from dom_documents""",
)
def needs_ocr(t):
    docs = t("dom_documents").select("id", "page_count", "extracted_text")
    return portfolio.needs_ocr(docs).drop("extracted_text")


@register(
    "licence_usage",
    f"""with counted as (select contract_id, count(*) as listed,
        count(*) filter (where last_active is null or last_active < {TODAY} - 90) as idle from dom_contract_users group by contract_id)
    select c.id as contract_id, c.supplier, c.users_count, coalesce(listed, 0) as listed, coalesce(idle, 0) as idle,
      coalesce(listed, 0) - c.users_count as over_licence
    from dom_contracts c left join counted u on u.contract_id = c.id""",
)
def licence_usage(t):
    return portfolio.licence_usage(t("dom_contract_users"), t("dom_contracts"), RENEWALS_AS_OF)
