"""Renewals, suppliers, clauses, commitments and licences across the portfolio."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pactframe.functions.columns import day
from pactframe.functions.text import content_tokens
from pactframe.operators.components import classes
from pactframe.operators.tenancy import in_scope
from pactframe.sources.tables import stored

DEFAULT_NOTICE_DAYS = 90
OCR_CHARS_PER_PAGE = 50
IDLE_DAYS = 90


# ---- renewals ------------------------------------------------------------


def renewal_runway(contracts: DataFrame, as_of, scope: DataFrame | None = None) -> DataFrame:
    """Adds the notice deadline, whether it has passed, and the days left."""
    deadline = F.date_sub("end_date", F.coalesce("notice_period_days", F.lit(DEFAULT_NOTICE_DAYS)))
    return in_scope(contracts, scope).select(
        "*",
        deadline.alias("deadline"),
        (deadline < day(as_of)).alias("missed"),
        F.datediff(deadline, day(as_of)).alias("days_left"),
    )


def renewal_calendar(contracts: DataFrame, as_of, scope: DataFrame | None = None) -> DataFrame:
    """Contracts and value per month of the notice deadline."""
    return (
        renewal_runway(contracts, as_of, scope)
        .groupBy(F.trunc("deadline", "month").alias("month"), "missed")
        .agg(
            F.count(F.lit(1)).alias("contracts"),
            F.count_if("auto_renew").alias("auto_renewing"),
            F.sum("annual_value").alias("annual_value"),
        )
    )


def supplier_portfolio(contracts: DataFrame, as_of, by: list[str], scope: DataFrame | None = None) -> DataFrame:
    """Spend, contracts and next notice deadline per supplier, with subtotals of ``by``."""
    runway = renewal_runway(contracts, as_of, scope)
    return runway.rollup("supplier", *by).agg(
        F.count(F.lit(1)).alias("contracts"),
        F.sum("annual_value").alias("annual_value"),
        F.min(F.when(~F.col("missed"), F.col("deadline"))).alias("next_deadline"),
        F.grouping_id().alias("level"),
    )


# ---- suppliers -----------------------------------------------------------

# Words that do not tell two suppliers apart.
LEGAL_WORDS = ("ltd", "limited", "inc", "gmbh", "plc", "llc", "the")


def supplier_key(name: Column) -> Column:
    """Lower case, letters and digits only, without legal forms."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "), " ")
    legal = F.array(*[F.lit(w) for w in (*LEGAL_WORDS, "")])
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(legal, w)), " ")


def supplier_merge(suppliers: DataFrame) -> DataFrame:
    """Name variants that share a key: one row per key.

    Names are counted per spelling first, so a supplier with a third of the rows
    is a handful of rows when its key is grouped.
    """
    spellings = suppliers.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"))
    return (
        spellings.groupBy(supplier_key(F.col("supplier")).alias("supplier_key"))
        .agg(F.min("supplier").alias("name"), F.count(F.lit(1)).alias("variants"), F.sum("n").alias("rows"))
    )


def _but(text: Column, place: Column) -> Column:
    """The text without the character at a place counted from 1."""
    return F.concat(F.substr(text, F.lit(1), place - 1), F.substr(text, place + 1))


def _masked(text: Column, place: Column) -> Column:
    return F.concat(F.substr(text, F.lit(1), place - 1), F.lit("\u0001"), F.substr(text, place + 1))


def _each(text: Column, change) -> Column:
    """The text changed at each of its places."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.transform(places, lambda i: change(text, i))


def _twice(text: Column, first, second) -> Column:
    return F.array_distinct(F.flatten(F.transform(_each(text, first), lambda t: _each(t, second))))


BASE = 0x9E3779B97F4A7C15  # odd; variants are hashed in 64 bits and every pair is verified
ROWS_OUT = 1 << 18


def _left_out(name: str):
    """Arrays of the hashes of a name, and of it with one and with two characters left out, a part at a time.

    A hash of a text with gaps follows from the hashes of its beginnings, so
    none of these texts is built.
    """
    size = len(name)
    codes = np.frombuffer(name.encode("utf-32-le"), np.uint32).astype(np.uint64)
    power, start = np.ones(size + 1, np.uint64), np.zeros(size + 1, np.uint64)
    for n in range(size):
        power[n + 1] = power[n] * np.uint64(BASE)
        start[n + 1] = start[n] * np.uint64(BASE) + codes[n] + np.uint64(1)

    def between(i, j):
        return start[j] - start[i] * power[j - i]

    places = np.arange(size)
    yield start[size:]
    yield start[places] * power[size - 1 - places] + between(places + 1, np.full(size, size))
    for i in range(size - 1):
        j = np.arange(i + 1, size)
        yield (start[i] * power[size - 2 - i] + between(np.full(len(j), i + 1), j) * power[size - 1 - j] + between(j + 1, np.full(len(j), size)))


def _variants(keys: DataFrame) -> DataFrame:
    """(variant, supplier_key): hashes of each key with up to two characters left out."""

    def run(batches):
        def put(waiting):
            sizes = [len(h) for _, h in waiting]
            names = pa.array([k for k, _ in waiting]).take(pa.array(np.repeat(np.arange(len(waiting)), sizes)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for _, h in waiting]).view(np.int64)), names], names=["variant", "supplier_key"])

        waiting, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with np.errstate(over="ignore"):
                    for hashes in _left_out(name):
                        waiting.append((name, np.unique(hashes)))
                        size += len(hashes)
                        if size >= ROWS_OUT:
                            yield put(waiting)
                            waiting, size = [], 0
        if waiting:
            yield put(waiting)

    return keys.select("supplier_key").mapInArrow(run, "variant long, supplier_key string").distinct()


def near_miss_links(names: DataFrame) -> DataFrame:
    """(a, b): all pairs of supplier keys within two edits, a before b.

    Names within two edits share a form with at most two characters left out of
    each.  Names meet on the hashes of these forms and are then compared.
    """
    keys = names.select(supplier_key(F.col("supplier")).alias("supplier_key")).distinct().filter(F.length("supplier_key") > 0)
    variants = _variants(keys)
    shared = variants.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("variant")
    met = stored(variants.join(shared, "variant", "left_semi"), "near-variants")
    other = met.select("variant", F.col("supplier_key").alias("b"))
    pairs = met.withColumnRenamed("supplier_key", "a").join(other, "variant").filter(F.col("a") < F.col("b")).select("a", "b").distinct()
    return pairs.filter(F.levenshtein("a", "b", 2) >= 0)


def near_miss_classes(names: DataFrame) -> DataFrame:
    """(supplier_key, class, links) of the supplier keys that have a near miss.

    ``links`` are the other keys within two edits, and ``class`` is the first
    key in name order that steps of two edits lead to.  A name of length L
    makes L * L / 2 numbers, no texts, so long names are no danger.
    """
    links = stored(near_miss_links(names), "near-misses")
    counts = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    return classes(links).join(counts, "node").select(F.col("node").alias("supplier_key"), "class", "links")


def supplier_near_misses(names: DataFrame) -> DataFrame:
    """Supplier keys within two edits of another key.

    Gives, per flagged key, the first near miss before it and the last one after
    it in name order (either may be NULL).

    No two names are paired.  Two names are at most two edits apart exactly when
    one of these patterns agrees: both with one character left out; both with
    two characters masked; one with two left out and the other whole; one with
    one left out and one masked and the other with one masked.  Each name lists
    its patterns, and least and greatest name per pattern are plain aggregates.
    """
    keys = names.select(supplier_key(F.col("supplier")).alias("supplier_key")).distinct().filter(F.length("supplier_key") > 0)
    k = F.col("supplier_key")
    # (pattern set, role, pattern): a name only meets names of the set's other role; role 0 meets itself
    kinds = [
        (0, 0, F.array_distinct(_each(k, _but))),
        (1, 0, _twice(k, _masked, _masked)),
        (2, 1, _twice(k, _but, _but)),
        (2, 2, F.array(k)),
        (3, 1, _twice(k, _but, _masked)),
        (3, 2, F.array_distinct(_each(k, _masked))),
    ]
    rows = reduce(
        lambda a, b: F.concat(a, b),
        [
            F.transform(
                patterns,
                _pattern_row(kind, role),
            )
            for kind, role, patterns in kinds
        ],
    )
    spread = keys.select("supplier_key", F.inline(rows))
    group = ["kind", "pattern"]

    def other(fn, role: int, sees: int) -> Column:
        return fn(F.when(F.col("role") == role, F.col("supplier_key"))).alias(f"{fn.__name__}{sees}")

    # what a member of role r sees: role 0 sees role 0, 1 sees 2, 2 sees 1
    seen = spread.groupBy(*group).agg(
        *[other(fn, role, sees) for fn in (F.min, F.max) for sees, role in ((0, 0), (1, 2), (2, 1))]
    )
    low = F.when(F.col("role") == 0, F.col("min0")).when(F.col("role") == 1, F.col("min1")).otherwise(F.col("min2"))
    high = F.when(F.col("role") == 0, F.col("max0")).when(F.col("role") == 1, F.col("max1")).otherwise(F.col("max2"))
    return (
        spread.join(seen, group)
        .select("supplier_key", low.alias("low"), high.alias("high"))
        .groupBy("supplier_key")
        .agg(
            F.min(F.when(F.col("low") < k, F.col("low"))).alias("near_miss_before"),
            F.max(F.when(F.col("high") > k, F.col("high"))).alias("near_miss_after"),
        )
        .filter(F.col("near_miss_before").isNotNull() | F.col("near_miss_after").isNotNull())
    )


def _pattern_row(kind: int, role: int):
    def row(pattern: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), pattern.alias("pattern"))

    return row


# ---- clauses -------------------------------------------------------------


def clause_matrix(contracts: DataFrame, points: DataFrame, fields: list[str], scope: DataFrame | None = None) -> DataFrame:
    """One row per contract, one 0/1 column per listed clause, and ``other_clauses``, its other distinct ones.

    A contract without any clause has a row of zeros.
    """
    clauses = points.filter(F.col("kind") == "clause")
    found = clauses.groupBy("contract_id").agg(
        *[F.max(F.when(F.col("field") == f, 1)).alias(f) for f in fields],
        F.count_distinct(F.when(~F.col("field").isin(*fields), F.col("field"))).alias("other_clauses"),
    )
    owned = in_scope(contracts, scope).select(F.col("id").alias("contract_id"))
    return owned.join(found, "contract_id", "left").fillna(0, [*fields, "other_clauses"])


def clause_gaps(contracts: DataFrame, points: DataFrame, fields: list[str], scope: DataFrame | None = None) -> DataFrame:
    """Missing clauses both ways: per contract across its row, per clause down its column."""
    matrix = clause_matrix(contracts, points, fields, scope)
    total = reduce(Column.__add__, [F.col(f) for f in fields])
    by_contract = matrix.select(
        F.lit("contract").alias("axis"), F.col("contract_id").alias("name"), (F.lit(len(fields)) - total).cast("long").alias("missing")
    )
    columns = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f"m{i}").alias("missing")) for i, f in enumerate(fields)])
    by_clause = matrix.agg(
        *[F.sum(F.lit(1) - F.col(f)).cast("long").alias(f"m{i}") for i, f in enumerate(fields)]
    ).select(F.lit("clause").alias("axis"), F.inline(columns))
    return by_contract.unionByName(by_clause)


# ---- commitments ---------------------------------------------------------

# First person and a promise.
COMMITMENT = r"(?i)\b(i|we)\s+(will|shall|promise|agree|commit|guarantee)\b"


def verbal_commitments(
    turns: DataFrame, contract_texts: DataFrame, cue: str = COMMITMENT, shared_terms: int = 3, scope: DataFrame | None = None
) -> DataFrame:
    """Sentences that promise something neither the contract nor its obligations reflect.

    ``turns`` has (conv_id, turn, contract_id, text); ``contract_texts`` has
    (contract_id, text), the texts of documents and of obligations alike.  A sentence counts as reflected when at least
    ``shared_terms`` of its content words occur in the contract's texts.
    """
    said = in_scope(turns, scope).select(
        "conv_id", "turn", "contract_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sentence_ix", "sentence")
    )
    said = said.filter(F.col("sentence").rlike(cue)).withColumn("terms", content_tokens(F.col("sentence")))
    written = (
        contract_texts.join(said.select("contract_id").distinct(), "contract_id", "left_semi")
        .select("contract_id", F.explode(content_tokens(F.col("text"))).alias("term"))
        .distinct()
        .withColumn("_written", F.lit(1))
    )
    key = ["conv_id", "turn", "contract_id", "sentence_ix"]
    found = (
        said.select(*key, F.explode("terms").alias("term"))
        .join(written, ["contract_id", "term"])
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("found"))
    )
    # the counts are joined back by key, so the sentences are not carried through the term join
    return (
        said.join(found, key, "left")
        .select(*key, F.trim("sentence").alias("sentence"), F.size("terms").alias("terms"), F.coalesce("found", F.lit(0)).alias("found"))
        .filter(F.col("found") < shared_terms)
    )


# ---- documents and licences ----------------------------------------------


def needs_ocr(documents: DataFrame, chars_per_page: int = OCR_CHARS_PER_PAGE, scope: DataFrame | None = None) -> DataFrame:
    """Adds characters per page and whether that is too little for a text layer."""
    chars = F.length(F.coalesce("extracted_text", F.lit("")))
    pages = F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1))
    return in_scope(documents, scope).select(
        "*", (chars / pages).alias("chars_per_page"), (chars < pages * chars_per_page).alias("needs_ocr")
    )


def licence_usage(
    users: DataFrame, contracts: DataFrame, as_of, idle_days: int = IDLE_DAYS, scope: DataFrame | None = None
) -> DataFrame:
    """Listed and idle users per contract next to the number of licences.

    A user is idle when last active more than ``idle_days`` ago, or never.
    """
    idle = F.coalesce(F.col("last_active") < F.date_sub(day(as_of), idle_days), F.lit(True))
    counted = users.groupBy("contract_id").agg(F.count(F.lit(1)).alias("listed"), F.count_if(idle).alias("idle"))
    owned = in_scope(contracts, scope).select(F.col("id").alias("contract_id"), "supplier", "users_count")
    return owned.join(counted, "contract_id", "left").select(
        "contract_id",
        "supplier",
        "users_count",
        F.coalesce("listed", F.lit(0)).alias("listed"),
        F.coalesce("idle", F.lit(0)).alias("idle"),
        (F.coalesce("listed", F.lit(0)) - F.coalesce("users_count", F.lit(0))).alias("over_licence"),
    )
