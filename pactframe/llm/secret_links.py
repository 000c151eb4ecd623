"""Secrets in texts: strong patterns, and weak parts that complement one another.

Strong patterns are reported wherever they occur.  Weak parts (account names,
short or unnamed secrets, endpoints) are common in harmless text, so one is
reported only when the scope around it holds a part that completes it to a
credential: a secret beside an identifier or an endpoint.  The parts of a text
are rows, and an interval join over (text, scope bucket) brings them together.
Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from pactframe.llm.common import without
from pactframe.sources.tables import stored

SCOPE = 200  # characters between two parts of one credential

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Part:
    """One kind of part: how it looks, when a match counts, and its role in a credential."""

    kind: str
    role: str
    strong: bool
    pattern: str
    words: tuple[str, ...] = ()  # small letters; every match holds one of them, in either case
    least: int = 0  # characters of the value (group 1 if there is one)
    mixed: bool = False  # the match must hold capitals, small letters and digits


# In the order in which spans that start together are listed.
PARTS = (
    Part("assign", "secret", True, rf"(?i:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)", ("password", "passwd", "secret", "token", "api"), 6),
    Part("access", "id", True, r"AKIA[A-Z0-9]{16,}", ("akia",)),
    Part("hex", "secret", True, r"[0-9a-f]{24,}"),
    Part("id", "id", False, rf"(?i:client_?id|key_?id|account(?:_?id)?|user(?:_?name)?|login){_VALUE}([A-Za-z0-9_.@-]+)",
         ("client", "key", "account", "user", "login"), 3),
    Part("short", "secret", False, rf"(?i:passphrase|pass|pwd|auth|credentials?|private_?key|signature){_VALUE}([A-Za-z0-9+/_.=-]+)",
         ("pass", "pwd", "auth", "credential", "private", "signature"), 4),
    Part("random", "secret", False, r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])", mixed=True),
    Part("endpoint", "endpoint", False, r"(?i:https?|ftps?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+", ("://",)),
    Part("host", "endpoint", False, rf"(?i:host(?:_?name)?|endpoint|server){_VALUE}([A-Za-z0-9.-]+)", ("host", "endpoint", "server"), 4),
)
COMPLETES = {"id": ("secret",), "endpoint": ("secret",), "secret": ("id", "endpoint")}
FOUND = "array<struct<gap:int,size:int,counts:boolean>>"


def counts(part: Part, match: Column) -> Column:
    if part.mixed:
        return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    if part.least:
        return F.length(F.regexp_extract(match, part.pattern, 1)) >= part.least
    return F.lit(True)


def matches(part: Part, text: Column, small: Column) -> Column:
    """Leftmost matches, each with the characters before it since the last one; null if there are none.

    ``small`` is the text in small letters; the plain search for a word of the
    pattern there spares most texts the pattern.
    """
    found = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(0))
    before = F.split(text, part.pattern, -1)
    rows = F.zip_with(
        found, F.slice(before, F.lit(1), F.size(found)),
        lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), counts(part, m).alias("counts")),
    )
    has = text.rlike(part.pattern)
    if part.words:
        has = reduce(or_, (F.contains(small, F.lit(w)) for w in part.words)) & has
    return F.when(has, rows).cast(FOUND)


def find_parts(docs: DataFrame, text: str) -> DataFrame:
    """The rows with the matches of every kind, and the hash of texts that have any.  No shuffle."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumn("__small", F.lower(whole))
    rows = rows.select("*", *[matches(p, whole, F.col("__small")).alias(f"__{p.kind}") for p in PARTS])
    some = F.greatest(*[F.col(f"__{p.kind}").isNotNull() for p in PARTS])
    return rows.withColumn("__text", F.when(some, F.sha2(whole, 256)))


def part_spans(rows: DataFrame) -> DataFrame:
    """(text, rank, kind, role, strong, start, end) of the matches that count, once per distinct text.

    Starts are running sums over the matches of one kind in one text.
    """

    def ranked(n: int, kind: str) -> Column:
        found = F.coalesce(F.col(f"__{kind}"), F.array().cast(FOUND))
        return F.transform(found, lambda m, i: F.struct(
            F.lit(n).alias("rank"), i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), m["counts"].alias("counts")))

    one = [ranked(n, p.kind) for n, p in enumerate(PARTS)]
    each = (
        rows.where("__text is not null").select(F.col("__text").alias("text"), F.explode(F.concat(*one)).alias("m"))
        .select("text", "m.*").dropDuplicates(["text", "rank", "i"])
    )
    running = F.sum(F.col("gap") + F.col("size")).over(
        Window.partitionBy("text", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    names = F.array(*[F.struct(F.lit(p.kind).alias("kind"), F.lit(p.role).alias("role"), F.lit(p.strong).alias("strong")) for p in PARTS])
    return (
        each.withColumn("end", running).where("counts")
        .select("text", "rank", names[F.col("rank")].alias("p"), (F.col("end") - F.col("size")).alias("start"), "end")
        .select("text", "rank", "p.*", "start", "end")
    )


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong parts, and the weak parts with a complementary part within ``scope`` characters.

    Both sides are dealt by text and scope bucket, so that a text with very
    many parts is no single key; only the existence of a partner is asked for.
    """
    wide = F.lit(2 * scope)
    bucket = lambda c: F.floor(c / wide).cast("int")
    completes = F.create_map(*[x for role, others in COMPLETES.items() for x in (F.lit(role), F.array(*map(F.lit, others)))])
    weak = parts.where("not strong").withColumn(
        "bucket", F.explode(F.sequence(bucket(F.greatest(F.col("start") - scope, F.lit(0))), bucket(F.col("end") + scope)))
    ).withColumn("needed", F.explode(completes[F.col("role")])).alias("w")
    other = parts.select(
        "text", "role", "start", "end", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("bucket")).alias("o")
    met = weak.join(
        other,
        (F.col("w.text") == F.col("o.text")) & (F.col("w.bucket") == F.col("o.bucket")) & (F.col("w.needed") == F.col("o.role"))
        & (F.col("o.start") <= F.col("w.end") + scope) & (F.col("o.end") >= F.col("w.start") - scope),
        "left_semi",
    )
    return parts.where("strong").unionByName(met.select(parts.columns).distinct())


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE, keep_text: bool = True) -> DataFrame:
    """The rows with ``secrets``, their spans as (kind, start, end) by start and then kind.

    Positions count code points, ends are exclusive.  Spans of different kinds
    may overlap.  A null or empty text has none; repeated rows get the same
    spans; a same-named input column is replaced.  The matches are found once
    and written to the shared folder; only texts with matches go on from there.
    """
    rows = find_parts(without(docs, "secrets"), text)
    kept = [c for c in without(docs, "secrets").columns if keep_text or c != text]
    rows = stored(rows.select(*[f"`{c}`" for c in kept], "__text", *[f"__{p.kind}" for p in PARTS]), "secret-parts")
    spans = linked(stored(part_spans(rows), "secret-spans"), scope)
    listed = spans.groupBy("text").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("secrets"))
    plain = rows.select(*[f"`{c}`" for c in kept], "__text")
    none = F.array().cast(listed.schema["secrets"].dataType)
    hit = plain.where("__text is not null").join(listed.withColumnRenamed("text", "__found"), F.col("__text") == F.col("__found"), "left")
    hit = hit.select(*[f"`{c}`" for c in kept], F.coalesce("secrets", none).alias("secrets"))
    return plain.where("__text is null").select(*[f"`{c}`" for c in kept], none.alias("secrets")).unionByName(hit)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The rows with every span of their secrets replaced by ``mark``; overlapping spans become one mark.

    A null text stays null.  Other columns are unchanged.
    """
    # other names meanwhile, so that an own column of the rows is never taken for the operator's
    found = scan(docs.toDF(*[f"in_{c}" for c in docs.columns]), f"in_{text}", scope)
    whole = F.col(f"`in_{text}`")
    start_of = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))

    def add(done, span):
        piece = F.when(span["start"] < done["at"], F.lit("")).otherwise(
            F.concat(F.substring(whole, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")), F.lit(mark)))
        return F.struct(F.concat(done["out"], F.array(piece)).alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    clean = F.aggregate(
        "secrets", start_of, add,
        lambda done: F.concat(F.array_join(done["out"], ""), F.substring(whole, (done["at"] + 1).cast("int"), F.length(whole))))
    out = [F.when((F.size("secrets") > 0) & whole.isNotNull(), clean).otherwise(whole).alias(c) if c == text else F.col(f"`in_{c}`").alias(c) for c in docs.columns]
    return found.select(*out)
