"""URL verdicts from rules and from a tree of path templates.

Paths become templates: digits and long codes in a segment are variable.  Per
host, the templates form a tree; branches whose share of blocked labelled
pages does not differ from that of their siblings are merged into a wildcard.
A template's purity is its blocked share, smoothed towards the node above it,
up to the host and to all hosts; pure templates are rejected.  The labels are
the pages that rules judge, and any further ones given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pactframe.llm.common import without
from pactframe.sources.tables import stored

DEPTH = 3  # levels settled one after the other; all deeper ones are settled together
SMOOTHING = 5.0
LEAST_PURITY = 0.8
SIMILAR_Z = 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (verdict, host and path)
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in small letters and path of a URL; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain and the start of the path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, start = text.split("/", 1)
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def generalised(part: Column) -> Column:
    """A segment with its variable parts replaced."""
    code = part.rlike("^[0-9a-fA-F-]{8,}$") & part.rlike("[0-9]")
    return F.when(code, F.lit("{x}")).otherwise(F.regexp_replace(part, "[0-9]+", "{n}"))


def segment(path: Column, n: int) -> Column:
    """The n-th segment, generalised; empty if there is none."""
    return generalised(F.coalesce(F.get(F.split(path, "/"), F.lit(n)), F.lit("")))


def deeper_segments(path: Column) -> Column:
    """The segments beyond DEPTH, generalised, with / between them; empty if there are none."""
    parts = F.split(path, "/")
    deeper = F.transform(F.slice(parts, F.lit(DEPTH + 2), F.size(parts)), generalised)
    return F.coalesce(F.regexp_replace(F.concat_ws("/", deeper), "/+$", ""), F.lit(""))


def unlike_siblings(leaves: DataFrame, above: list[str], name: str) -> DataFrame:
    """(above, name) of the branches below ``above`` whose share of bad pages differs from that of their siblings.

    A branch is compared with all its siblings together by a two-sample test of
    proportions; one without labelled pages, or without labelled siblings, is alike.
    """
    branch = leaves.groupBy(*above, name).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    parent = branch.groupBy(*above).agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
    other_l, other_b = F.col("all_l") - F.col("l"), F.col("all_b") - F.col("b")
    pooled = F.col("all_b") / F.col("all_l")
    error = F.sqrt(pooled * (1 - pooled) * (1.0 / F.col("l") + 1.0 / other_l))
    z = F.abs(F.col("b") / F.col("l") - other_b / other_l) / error
    differs = F.when((F.col("l") > 0) & (other_l > 0) & (F.col("all_b") > 0) & (F.col("all_b") < F.col("all_l")), z >= SIMILAR_Z).otherwise(False)
    return branch.join(parent, above).where(differs).select(*above, name)


def merge_similar(leaves: DataFrame, above: list[str], name: str) -> DataFrame:
    """Replace segment ``name`` by a wildcard in the branches below ``above`` that are like their siblings."""
    own = unlike_siblings(leaves, above, name).withColumn("own", F.lit(True))
    marked = leaves.join(own, [*above, name], "left")
    return marked.withColumn(name, F.when(F.col("own"), F.col(name)).otherwise(F.lit("*"))).drop("own")


def further_levels(tree: DataFrame, names: list[str]) -> DataFrame:
    """The tree with all levels beyond DEPTH, in a fixed number of passes however deep the paths are.

    All levels are settled at once.  A segment stays in the template if its
    pages differ from those of the other segments at its level of the template
    above, or from those below the same parent segment; else it is a wildcard.
    The first test sees through wildcards between, the second finds segments
    that mean one thing here and another there.  Only levels that a path has
    count, so neither template nor purity depends on how deep other paths go.
    """
    leaf = F.md5(F.to_json(F.struct("host", *names, "rest")))
    deeper = tree.where("rest != ''").select("*", leaf.alias("leaf"), F.split("rest", "/").alias("parts"))
    deeper = stored(deeper, "url-deeper")
    under = F.slice(F.concat(F.array(F.lit("")), "parts"), F.lit(1), F.size("parts"))
    steps = F.arrays_zip(F.col("parts").alias("part"), under.alias("under"))
    levels = deeper.select("leaf", "host", "template", "labelled", "bad", F.posexplode(steps).alias("k", "step"))
    levels = levels.select("leaf", "host", "template", "k", "step.*", "labelled", "bad")
    for mark, above in (("__level", ["host", "template", "k"]), ("__under", ["host", "template", "k", "under"])):
        own = unlike_siblings(levels.where("labelled > 0").select(*above, "part", "labelled", "bad"), above, "part")
        levels = levels.join(own.withColumn(mark, F.lit(True)), [*above, "part"], "left")
    part = F.when(F.coalesce("__level", "__under", F.lit(False)), F.col("part")).otherwise(F.lit("*"))
    paths = levels.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("k", part.alias("part")))).alias("path"))
    nodes = F.aggregate("path", F.array().cast("array<bigint>"), lambda made, step: F.concat(
        made, F.array(F.xxhash64(F.coalesce(F.get(made, F.size(made) - 1), F.lit(0)), step["part"]))))
    paths = paths.select("leaf", F.concat_ws("/", F.col("path.part")).alias("further"), nodes.alias("nodes"))
    deeper = stored(deeper.drop("parts").join(paths, "leaf"), "url-further")
    places = deeper.select("leaf", "host", "template", "labelled", "bad", F.posexplode("nodes").alias("k", "node"))
    node = ["host", "template", "k", "node"]
    counts = places.groupBy(*node).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    counts = places.select("leaf", *node).join(counts, node).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("k", "l", "b"))).alias("counts"))
    purity = F.aggregate("counts", F.col("purity"), lambda p, n: (n["b"] + SMOOTHING * p) / (n["l"] + SMOOTHING))
    settled = deeper.join(counts, "leaf").withColumn("purity", purity).withColumn("template", F.concat_ws("/", "template", "further"))
    return tree.where("rest = ''").unionByName(settled.select(*tree.columns))


def template_tree(labelled: DataFrame) -> DataFrame:
    """(host, s1.., rest, template, purity): every branch with its place in the merged tree and its smoothed purity.

    ``labelled`` has host, s1.., rest, labelled, bad; the counts may come in parts.
    """
    names = [f"s{d}" for d in range(1, DEPTH + 1)]
    leaves = labelled.groupBy("host", *names, "rest").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    leaves = stored(leaves, "url-templates")
    tree = leaves.select("*", *[F.col(s).alias(f"raw_{s}") for s in names])
    for depth, name in enumerate(names):
        tree = merge_similar(tree, ["host", *names[:depth]], name)
    tree = stored(tree, "url-tree")
    whole = leaves.agg(
        ((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("p"),
        F.coalesce(F.bool_or(F.col("rest") != ""), F.lit(False)).alias("deeper")).first()
    purity: Column = F.lit(whole.p)
    scored = tree
    for depth in range(DEPTH + 1):
        keys = ["host", *names[:depth]]
        node = tree.groupBy(*keys).agg(F.sum("labelled").alias(f"l{depth}"), F.sum("bad").alias(f"b{depth}"))
        scored = scored.join(node, keys)
        purity = (F.col(f"b{depth}") + SMOOTHING * purity) / (F.col(f"l{depth}") + SMOOTHING)
    scored = scored.select("host", *[F.col(f"raw_{s}").alias(s) for s in names], "rest", "labelled", "bad",
                           F.concat_ws("/", F.lit(""), *names).alias("template"), purity.alias("purity"))
    if whole.deeper:
        scored = further_levels(stored(scored, "url-scored"), names)
    return scored.drop("labelled", "bad")


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, labels: DataFrame | None = None,
               least_purity: float = LEAST_PURITY) -> DataFrame:
    """The rows with host, path, rule, template, purity and verdict.

    The longest fitting rule decides, else the purity of the page's template:
    ``block`` from ``least_purity`` on.  ``labels`` (key, bad 0 or 1) adds
    labelled pages where no rule fits.  A null URL or one without :// has an
    empty host and path; same-named input columns are replaced; repeated rows
    count and are judged alike.  All counts are aggregates that map tasks
    reduce, so one host with very many pages is no hot key.
    """
    out = ("host", "path", "rule", "template", "purity", "verdict")
    rows = without(pages, *out)
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, action = matching_rule(rules, F.col("host"), F.col("path"))
    names = [f"s{d}" for d in range(1, DEPTH + 1)]
    rows = rows.select("*", rule.alias("rule"), action.alias("__action"), *[segment(F.col("path"), n).alias(f"__s{n}") for n in range(1, DEPTH + 1)],
                       deeper_segments(F.col("path")).alias("__rest"))
    bad = F.when(F.col("__action") == "block", 1).when(F.col("__action") == "allow", 0)
    marked = rows
    if labels is not None:
        known = labels.where("bad in (0, 1)").groupBy(key).agg(F.max("bad").alias("__bad"))
        marked = rows.join(known, key, "left")
        bad = F.coalesce(bad, F.col("__bad"))
    counted = marked.select("host", *[F.col(f"__{s}").alias(s) for s in [*names, "rest"]], bad.isNotNull().cast("long").alias("labelled"),
                            F.coalesce(bad, F.lit(0)).cast("long").alias("bad"))
    names.append("rest")
    tree = template_tree(counted).select(F.col("host").alias("__host"), *[F.col(s).alias(f"__t{s}") for s in names], "template", "purity")
    same = reduce(lambda a, b: a & b, [F.col(f"__{s}") == F.col(f"__t{s}") for s in names], F.col("host") == F.col("__host"))
    judged = F.coalesce(F.col("__action"), F.when(F.col("purity") >= least_purity, "block").otherwise("allow"))
    kept = [f"`{c}`" for c in without(pages, *out).columns]
    return rows.join(tree, same).select(*kept, "host", "path", "rule", "template", "purity", judged.alias("verdict"))


def allowed(pages: DataFrame, **options) -> DataFrame:
    """The pages whose verdict is allow, with their own columns."""
    judged = judge_urls(pages, **options)
    return judged.where("verdict = 'allow'").select(*[f"`{c}`" for c in pages.columns if c in judged.columns])


def _oracle() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1]))

    def case(value) -> str:
        arms = " ".join(
            f"when (host = '{t.split('/', 1)[0]}' or ends_with(host, '.{t.split('/', 1)[0]}')) and starts_with(path, '/{t.split('/', 1)[1]}') then '{value(a, t)}'"
            for a, t in cases)
        return f"case {arms} end"

    segments = ", ".join(
        f"""case when regexp_matches(x{n}, '^[0-9a-fA-F-]{{8,}}$') and regexp_matches(x{n}, '[0-9]') then '{{x}}'
        else regexp_replace(x{n}, '[0-9]+', '{{n}}', 'g') end as s{n}""" for n in range(1, DEPTH + 1))
    text = f"""
with cut as (select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from pages),
parsed as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
ruled as (select *, {case(lambda a, t: t)} as rule, {case(lambda a, t: a)} as act,
  {", ".join(f"coalesce(split_part(path, '/', {n + 1}), '') as x{n}" for n in range(1, DEPTH + 1))} from parsed),
p as (select page_id, host, path, rule, act, {segments}, (act is not null)::int as l, (act is not null and act = 'block')::int as b from ruled),
t0 as (select *, '' as t0 from p)"""
    for d in range(1, DEPTH + 1):
        above = ", ".join(["host", *(f"t{k}" for k in range(1, d))])
        text += f""",
c{d} as (select {above}, s{d}, sum(l) as cl, sum(b) as cb from t{d - 1} group by all),
d{d} as (select *, sum(cl) over (partition by {above}) as al, sum(cb) over (partition by {above}) as ab from c{d}),
e{d} as (select {above}, s{d}, case when cl > 0 and al > cl and ab > 0 and ab < al then
    abs(cb / cl - (ab - cb) / (al - cl)) / sqrt((ab / al) * (1 - ab / al) * (1.0::double / cl + 1.0::double / (al - cl))) >= {SIMILAR_Z} else false end as own from d{d}),
t{d} as (select t{d - 1}.*, case when own then s{d} else '*' end as t{d} from t{d - 1} join e{d} using ({above}, s{d}))"""
    above, purity = "", "(sum(b) over () + 1) / (sum(l) over () + 2)"
    for d in range(DEPTH + 1):
        above = ", ".join(["host", *(f"t{k}" for k in range(1, d + 1))])
        purity = f"((sum(b) over (partition by {above}) + {SMOOTHING}::double * {purity}) / (sum(l) over (partition by {above}) + {SMOOTHING}::double))"
    return text + f""",
z as (select *, {purity} as purity from t{DEPTH})
select page_id, host, path, rule, coalesce(act, case when purity >= {LEAST_PURITY} then 'block' else 'allow' end) as verdict from z"""


ORACLE = _oracle()
