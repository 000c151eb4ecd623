"""From model replies to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STRUCTURED_KINDS = ("analysis", "reanalysis")
_SENTINEL = "end-of-reply"


def _strip(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def joined_text(blocks: Column) -> Column:
    """Text blocks joined by line ends; a text block without text adds an empty line."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "\n", "")


def reply_text(replies: DataFrame, content: str = "content") -> DataFrame:
    return replies.withColumn("text", joined_text(F.col(content)))


def _json_part(text: Column) -> Column:
    """Without code fences, cut from the first opening to the last closing brace."""
    bare = _strip(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(bare, r"^```(?i:json)?", "")
    bare = _strip(F.regexp_replace(bare, r"```\z", ""))
    first = F.locate("{", bare)
    last = F.length(bare) - F.locate("}", F.reverse(bare)) + 1
    cut = F.substr(bare, first, last - first + 1)
    return F.when((first > 0) & F.contains(bare, F.lit("}")) & (last > first), cut).otherwise(bare)


def strict_json(text: Column) -> Column:
    """The text as a variant, NULL unless it is exactly one JSON value.

    The parser ignores what follows a complete value, so the text is parsed as
    the first of two array elements: anything left over breaks the array or
    changes its length.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{_SENTINEL}"]')))
    whole = F.try_variant_get(pair, "$[1]", "string") == _SENTINEL
    return F.when(whole & F.try_variant_get(pair, "$[2]", "variant").isNull(), F.try_parse_json(text))


def extract_json(replies: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``parsed`` (variant), and ``quarantine`` with the text that is not valid JSON."""
    part = _json_part(F.col(text))
    parsed = replies.withColumn("_part", part).withColumn("parsed", strict_json(F.col("_part")))
    return parsed.withColumn("quarantine", F.when(F.col("parsed").isNull(), F.col("_part"))).drop("_part")


def reply_results(replies: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``result`` and ``failed``: analyses are parsed, other kinds wrapped as {text}.

    ``failed`` marks an analysis whose reply is not valid JSON; it never succeeds later.
    """
    structured = F.col("kind").isin(*STRUCTURED_KINDS)
    wrapped = F.parse_json(F.to_json(F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"))))
    rows = extract_json(replies, text)
    return rows.select(
        *replies.columns,
        F.when(structured, F.col("parsed")).otherwise(wrapped).alias("result"),
        (structured & F.col("parsed").isNull()).alias("failed"),
    )


# confidence is read as text first, so that a value of another kind is seen and not lost
POINT = "struct<field:string,value:string,confidence:string,reasoning:string,source:string>"
# Section of an analysis and the kind of its points.
SECTIONS = {"extractions": "extraction", "clauses": "clause", "risks": "risk", "obligations": "obligation"}


def analysis_to_data_points(analyses: DataFrame) -> DataFrame:
    """One row per finding of an analysis; ``analysis`` is a variant or JSON text.

    The four sections hold objects with field, value, confidence, reasoning and
    source.  A section of another shape gives no rows.  A finding that is no
    valid point stays, with the reason in ``quarantine``: no field, or a
    confidence that is missing, no whole number, or outside 0 to 100.
    """
    none = F.array().cast(f"array<{POINT}>")
    if dict(analyses.dtypes)["analysis"] == "string":
        shape = "struct<" + ",".join(f"{section}:array<{POINT}>" for section in SECTIONS) + ">"
        rows = analyses.withColumn("_read", F.from_json("analysis", shape))
        found = {section: F.col(f"_read.{section}") for section in SECTIONS}
    else:
        rows = analyses
        found = {section: F.try_variant_get("analysis", f"$.{section}", f"array<{POINT}>") for section in SECTIONS}
    tagged = [F.transform(F.coalesce(found[section], none), _tagger(kind)) for section, kind in SECTIONS.items()]
    keep = [c for c in analyses.columns if c != "analysis"]
    points = rows.select(*keep, F.inline(F.concat(*tagged)))
    number = F.col("confidence").try_cast("int")
    reason = F.when(F.col("field").isNull(), "no field").when(
        ~F.coalesce((number == F.col("confidence").try_cast("double")) & number.between(0, 100), F.lit(False)), "confidence")
    return points.withColumn("quarantine", reason).withColumn("confidence", F.when(reason.isNull(), number))


def _tagger(kind: str):
    def tag(point: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            *[point[c].alias(c) for c in ("field", "value", "confidence", "reasoning", "source")],
        )

    return tag
