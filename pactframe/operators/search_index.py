"""A stored search index that follows its documents, and BM25 ranking from it.

The index is a folder of tables in segments.  ``build`` writes the first one;
``apply_changes`` adds a segment with the postings of the new and changed
documents alone, and the ids of the documents whose earlier rows are dead.
Readers merge: a row counts unless a later segment declares its document dead.
``compact`` writes the live postings of some ranges of terms as one segment.

    postings/segment=/span=   doc_id, field, term, tf, positions, length, slot, tenths (weighted count, once a document)
    blocks/segment=/span=     term, slot, n, most (weighted count), least (length)
    docs/segment=             doc_id, content (a hash), length, terms
    stats/segment=            term, n: change in documents with it; the null term has the totals
    dead/segment=             doc_id
    manifest/                 one row per published state; the latest counts

A segment counts once the manifest names it, so a change that fails on the way
leaves the former state, and is repeated by running it again.  One writer at a
time is assumed.

Spans are ranges of terms with about equal numbers of postings.  A slot holds
about ``SLOT_DOCS`` documents, by hash; the postings of a term in a slot are a
block, whose bounds say what a document in it can score at most.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pactframe.functions.text import POSTINGS, fields_postings, tokens
from pactframe.operators.search import WEIGHT_TENTHS, parse_query, query_terms, search_match
from pactframe.sources.tables import stored

SPANS = 16
SLOT_DOCS = 64
FIRST_SLOTS = 64  # at least so many, and two for each wanted document, are read to find the score that the others must reach
LISTED_SLOTS = 10_000  # slots named in a filter that reaches the scan; more are joined
PART_WORDS = 2_000_000  # words a task sorts when postings are written
BLOCKS = "term string, slot int, n long, most long, least long, segment int, span int"
POSTING = ["doc_id", "field", "term", "tf", "positions"]


# ---- states ----------------------------------------------------------------


def state_of(spark: SparkSession, path: str) -> dict:
    """The latest published state."""
    try:
        row = spark.read.schema("version long, body string").parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
    except AnalysisException as missing:
        raise FileNotFoundError(f"no search index in {path}") from missing
    return json.loads(row["body"])


def publish(spark: SparkSession, path: str, state: dict) -> None:
    row = spark.createDataFrame([(state["version"], json.dumps(state))], "version long, body string")
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def span_of(term: Column, bounds: list[str]) -> Column:
    return reduce(Column.__add__, [(term >= b).cast("int") for b in bounds], F.lit(0))


def term_bounds(terms: DataFrame) -> list[str]:
    """Ends of term ranges with about equal numbers of postings, at the first two letters of terms."""
    counts = sorted((r[0], r[1]) for r in terms.groupBy(F.substring("term", 1, 2)).count().toLocalIterator())
    total, so_far, bounds = sum(n for _, n in counts), 0, []
    for prefix, n in counts:
        if bounds or so_far:
            if so_far >= total * (len(bounds) + 1) / SPANS:
                bounds.append(prefix)
        so_far += n
    return bounds


def parts(spark: SparkSession, path: str, kind: str, places: list[str], schema: str) -> DataFrame:
    """Rows of some folders below one kind, with segment (and span) as columns."""
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/{p}" for p in places])


def _segments(spark, path, kind, segments, schema):
    return parts(spark, path, kind, [f"segment={s}" for s in segments], schema)


def dead_rows(spark: SparkSession, path: str, state: dict) -> DataFrame:
    """(dead_id, since): rows of the document in segments before ``since`` are dead."""
    dead = _segments(spark, path, "dead", state["dead"], f"doc_id {state['id_type']}, segment int")
    return dead.groupBy(F.col("doc_id").alias("dead_id")).agg(F.max("segment").alias("since"))


def _alive(rows: DataFrame, spark, path, state) -> DataFrame:
    if not state["dead"]:
        return rows
    dead = dead_rows(spark, path, state)
    return rows.join(dead, (rows["doc_id"] == dead["dead_id"]) & (rows["segment"] < dead["since"]), "left_anti")


def live_docs(spark: SparkSession, path: str, state: dict | None = None) -> DataFrame:
    """(doc_id, content, length, terms, segment) of the documents as the index knows them."""
    state = state or state_of(spark, path)
    schema = f"doc_id {state['id_type']}, content long, length long, terms array<string>, segment int"
    return _alive(_segments(spark, path, "docs", state["docs"], schema), spark, path, state)


def live_postings(spark: SparkSession, path: str, named: frozenset[str] | None = None, state: dict | None = None, slots: list[int] | None = None) -> DataFrame:
    """Postings (doc_id, field, term, tf, positions, length, tenths, slot, segment, span), of the given terms alone if any are given.

    Only folders of the terms' ranges are read, and of those the parts that a
    pushed filter on term and slot lets through.
    """
    state = state or state_of(spark, path)
    rows = parts(spark, path, "postings", _places(state, named), _schema(state))
    if named is not None:
        rows = rows.filter(F.col("term").isin(*sorted(named)))
    if slots is not None:
        rows = rows.filter(F.col("slot").isin(*slots))
    return _alive(rows, spark, path, state)


def _schema(state) -> str:
    return f"doc_id {state['id_type']}, field string, term string, tf int, positions array<int>, length long, tenths long, slot int, segment int, span int"


def _places(state: dict, named: frozenset[str] | None) -> list[str]:
    wanted = None if named is None else {sum(t >= b for b in state["bounds"]) for t in named}
    return [f"segment={s}/span={k}" for k, ss in sorted(state["parts"].items(), key=lambda x: int(x[0])) if wanted is None or int(k) in wanted for s in ss]


# ---- writing ---------------------------------------------------------------


def _content(name: str, text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))


def _write(rows: DataFrame, path: str, kind: str, segment: int, by_span: bool = False) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("span") if by_span else writer).parquet(f"{path}/{kind}/segment={segment}")


def _write_postings(rows: DataFrame, path: str, segment: int, state: dict, words: int | None = None) -> list[str]:
    """Postings and their blocks by term range; the ranges that have any.

    Postings are shuffled once, without what follows from the term or the
    document, into parts of about ``PART_WORDS`` if the number of words is
    known; the blocks are counted where their range puts them.
    """
    spark = rows.sparkSession
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(state["slots"])).cast("int")
    ranged = rows.select("doc_id", "field", "term", "positions", "length", "tenths")
    parts = [] if words is None else [max(spark.sparkContext.defaultParallelism, words // PART_WORDS)]
    ranged = ranged.repartitionByRange(*parts, F.col("term"), slot).select(
        "doc_id", "field", "term", F.size("positions").alias("tf"), "positions", "length", "tenths", slot.alias("slot"), span_of(F.col("term"), state["bounds"]).alias("span"))
    _write(ranged.sortWithinPartitions("span", "term", "slot", "doc_id", "field"), path, "postings", segment, by_span=True)
    try:
        written = spark.read.parquet(f"{path}/postings/segment={segment}")
    except AnalysisException:  # no postings, so no files
        return []
    block = ["span", "term", "slot"]
    blocks = written.select(*block, "tenths", "length").repartitionByRange(*parts, *map(F.col, block)).groupBy(*block).agg(
        F.count("tenths").alias("n"), F.max("tenths").alias("most"), F.min("length").alias("least"))
    _write(blocks.sortWithinPartitions(*block), path, "blocks", segment, by_span=True)
    return sorted(str(r["span"]) for r in spark.read.parquet(f"{path}/blocks/segment={segment}").select("span").distinct().collect())


def _new_rows(docs: DataFrame, name: str, text: str, english: bool) -> tuple[DataFrame, DataFrame]:
    """Postings with length and weighted count, and the docs rows; a text is read once and its terms are counted in its row."""
    fields = {"A": F.coalesce(F.col(name), F.lit("")), "B": F.coalesce(F.col(text), F.lit(""))}
    words = docs.select(F.col("id").alias("doc_id"), _content(name, text).alias("content"), *[tokens(fields[f]).alias(f) for f in WEIGHT_TENTHS])
    id_type = docs.schema["id"].dataType.simpleString()
    whole = stored(words.mapInArrow(fields_postings(english, WEIGHT_TENTHS), f"doc_id {id_type}, content long, length long, postings {POSTINGS}"), "new-postings")
    rows = whole.select("doc_id", "content", "length", F.array_distinct("postings.term").alias("terms"))
    return whole.select("doc_id", "length", F.inline("postings")), rows


def _stats(added: DataFrame, gone: DataFrame | None, blocks: DataFrame) -> DataFrame:
    """(term, n, length): changes in documents by term, and in the null term those of all documents and their length.

    The documents of each added term are counted from the blocks.
    """
    zero = F.lit(0).cast("long").alias("length")

    def totals(rows, sign):
        return rows.select(F.lit(None).cast("string").alias("term"), F.lit(sign).cast("long").alias("n"), (sign * F.col("length")).alias("length"))

    rows = totals(added, 1).unionByName(blocks.select("term", "n", zero))
    if gone is not None:
        rows = rows.unionByName(totals(gone, -1)).unionByName(gone.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("n"), zero))
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).filter("n <> 0 or length <> 0")


def _blocks(spark: SparkSession, path: str, segment: int, held: list[str]) -> DataFrame:
    return parts(spark, path, "blocks", [f"segment={segment}/span={k}" for k in held], BLOCKS)


def build(docs: DataFrame, path: str, name: str = "name", text: str = "extracted_text", english: bool = True) -> dict:
    """A new index of documents with id (unique, not null), a name and a text; the published state."""
    spark = docs.sparkSession
    postings, rows = _new_rows(docs, name, text, english)
    size = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tenths")).first()
    slots = 2 ** max(0, math.ceil(math.log2(max(1, size["docs"]) / SLOT_DOCS)))
    state = {"version": 0, "segment": 0, "slots": slots, "bounds": term_bounds(postings.select("term")), "docs": [0], "stats": [0], "dead": [],
             "english": english, "id_type": docs.schema["id"].dataType.simpleString()}
    _write(rows, path, "docs", 0)
    held = _write_postings(postings, path, 0, state, size["tenths"] // min(WEIGHT_TENTHS.values()))
    _write(_stats(rows, None, _blocks(spark, path, 0, held)), path, "stats", 0)
    state["parts"] = {k: [0] for k in held}
    publish(spark, path, state)
    return state


def apply_changes(path: str, changed: DataFrame, removed: DataFrame | None = None, name: str = "name", text: str = "extracted_text") -> dict:
    """A segment with the documents of ``changed`` (new or changed: id, name, text), and without those of ``removed`` (id).

    What is written grows with the changes, not with the index.
    """
    spark = changed.sparkSession
    state = state_of(spark, path)
    segment = state["segment"] + 1
    postings, rows = _new_rows(changed, name, text, state["english"])
    ids = rows.select("doc_id")
    if removed is not None:
        ids = ids.unionByName(removed.select(F.col("id").alias("doc_id"))).distinct()
    gone = stored(live_docs(spark, path, state).join(ids, "doc_id", "left_semi").select("doc_id", "length", "terms"), "gone-docs")
    if rows.isEmpty() and gone.isEmpty():
        return state
    _write(gone.select("doc_id"), path, "dead", segment)
    _write(rows, path, "docs", segment)
    held = _write_postings(postings, path, segment, state)
    _write(_stats(rows, gone, _blocks(spark, path, segment, held)), path, "stats", segment)
    parts_now = {**state["parts"], **{k: state["parts"].get(k, []) + [segment] for k in held}}
    state = {**state, "version": state["version"] + 1, "segment": segment, "parts": parts_now,
             **{k: state[k] + [segment] for k in ("docs", "stats", "dead")}}
    publish(spark, path, state)
    return state


def refresh(docs: DataFrame, path: str, name: str = "name", text: str = "extracted_text") -> dict:
    """Bring the index up to the documents: those with another content are indexed anew, those missing go.

    Ids and hashes of contents are compared; postings are neither read nor
    written but for the documents that changed.
    """
    spark = docs.sparkSession
    known = live_docs(spark, path).select(F.col("doc_id").alias("known_id"), F.col("content").alias("known"))
    now = docs.select(F.col("id").alias("now_id"), _content(name, text).alias("now"))
    both = stored(now.join(known, F.col("now_id") == F.col("known_id"), "full").filter("not (now <=> known)").select("now_id", "known_id"), "changed-ids")
    changed = docs.join(both.select(F.col("now_id").alias("id")).where("id is not null"), "id", "left_semi")
    return apply_changes(path, changed, both.where("now_id is null").select(F.col("known_id").alias("id")), name, text)


def compact(spark: SparkSession, path: str, spans: list[int] | None = None) -> dict:
    """Live postings of some ranges of terms as one segment; of all ranges, documents and counts as well.

    Ranges that are in one segment already are left as they are unless all are asked for.
    """
    state = state_of(spark, path)
    asked = [k for k, ss in state["parts"].items() if spans is None or (int(k) in spans and len(ss) > 1)]
    if not asked and spans is not None:
        return state
    segment = state["segment"] + 1
    some = {**state, "parts": {k: state["parts"][k] for k in asked}}
    held = _write_postings(live_postings(spark, path, state=some).drop("segment", "span"), path, segment, state)
    kept = {k: ss for k, ss in state["parts"].items() if k not in asked}
    new = {**state, "version": state["version"] + 1, "segment": segment, "parts": {**kept, **{k: [segment] for k in held}}}
    if spans is None:
        docs = live_docs(spark, path, state).drop("segment")
        _write(docs, path, "docs", segment)
        _write(_stats(docs, None, _blocks(spark, path, segment, held)), path, "stats", segment)
        new |= {"docs": [segment], "stats": [segment], "dead": []}
    publish(spark, path, new)
    return new


# ---- counts and ranking ------------------------------------------------------


def term_counts(spark: SparkSession, path: str, named: frozenset[str] | None = None) -> DataFrame:
    """(term, n, length): documents that hold a term now; the null term has all documents and their weighted length."""
    state = state_of(spark, path)
    rows = _segments(spark, path, "stats", state["stats"], "term string, n long, length long, segment int")
    if named is not None:
        rows = rows.filter(F.col("term").isNull() | F.col("term").isin(*sorted(named)))
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).filter("n > 0")


class _Scores:
    """BM25 as column expressions for the wanted terms of one query."""

    def __init__(self, spark, path, query, state, k1, b):
        alternatives = parse_query(query, state["english"])
        if any(not any(o.wanted for o in a) for a in alternatives):
            raise ValueError("a query of unwanted terms alone has no ranking")
        self.wanted = frozenset(t for a in alternatives for o in a if o.wanted for t, _ in o.terms)
        counts = {r["term"]: r for r in term_counts(spark, path, self.wanted).collect()}
        total = counts.pop(None, None)
        self.documents = total["n"] if total else 0
        self.mean = total["length"] / 10 / total["n"] if total and total["length"] else 1.0
        self.k1, self.b = k1, b
        self.idf = {t: math.log(1 + (self.documents - c["n"] + 0.5) / (c["n"] + 0.5)) for t, c in counts.items()}

    def of(self, tenths: Column, length: Column) -> Column:
        """A term's score, from the weighted count and length in tenths."""
        tf = tenths / F.lit(10.0)
        norm = F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * (length / F.lit(10.0)) / F.lit(self.mean))
        idf = F.coalesce(*[F.when(F.col("term") == t, F.lit(v)) for t, v in sorted(self.idf.items())], F.lit(0.0))
        return idf * tf * F.lit(self.k1 + 1) / (tf + norm)


def slot_bounds(spark: SparkSession, path: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(slot, bound, blocks): the most a document of a slot can score, and the blocks of wanted terms there."""
    state = state_of(spark, path)
    return _slot_bounds(spark, path, state, _Scores(spark, path, query, state, k1, b))


def _slot_bounds(spark, path, state, scores: _Scores) -> DataFrame:
    blocks = parts(spark, path, "blocks", _places(state, scores.wanted), BLOCKS).filter(F.col("term").isin(*sorted(scores.wanted)))
    # a document's live postings are in one segment, so the largest bound of the segments holds
    per_term = blocks.withColumn("bound", scores.of(F.col("most"), F.col("least"))).groupBy("slot", "term").agg(F.max("bound").alias("bound"), F.count("*").alias("blocks"))
    return per_term.groupBy("slot").agg(F.sum("bound").alias("bound"), F.sum("blocks").alias("blocks"))


def _scored(rows: DataFrame, query: str, scores: _Scores, english: bool) -> DataFrame:
    """(doc_id, score) of the matching documents among the postings of some slots, which are complete for them."""
    weight = F.when(F.col("field") == "A", WEIGHT_TENTHS["A"]).otherwise(WEIGHT_TENTHS["B"])
    matched = search_match(rows.select(*POSTING), query, english=english).select("doc_id")
    per_term = rows.filter(F.col("term").isin(*sorted(scores.wanted))).groupBy("doc_id", "term").agg(
        F.sum(weight * F.col("tf")).alias("tenths"), F.first("length").alias("length"))
    per_doc = per_term.groupBy("doc_id").agg(F.round(F.sum(scores.of(F.col("tenths"), F.col("length"))), 6).alias("score"))
    return per_doc.join(matched, "doc_id", "left_semi")


def bm25(spark: SparkSession, path: str, query: str, n: int = 40, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The n matching documents with the highest BM25 scores: (doc_id, score), best first, ties by id.

    Counts and lengths weigh name and text as the plain score does.  The slots
    with the highest bounds are read first; the n-th score there is one that
    the others must be able to reach, and only their blocks are read then.
    """
    state = state_of(spark, path)
    named = query_terms(query, state["english"])
    scores = _Scores(spark, path, query, state, k1, b)
    if not scores.idf:
        return spark.createDataFrame([], f"doc_id {state['id_type']}, score double")
    slots = stored(_slot_bounds(spark, path, state, scores), "slot-bounds")
    reads = surviving(slots, spark, path, query, n, state, named, scores)
    few = [r["slot"] for r in reads.select("slot").limit(LISTED_SLOTS + 1).collect()]
    if len(few) <= LISTED_SLOTS:
        rows = live_postings(spark, path, named, state, few)
    else:
        rows = live_postings(spark, path, named, state).join(reads.select("slot"), "slot", "left_semi")
    return _scored(rows, query, scores, state["english"]).orderBy(F.desc("score"), "doc_id").limit(n)


def surviving(slots: DataFrame, spark, path, query, n, state, named, scores) -> DataFrame:
    """The slots that can hold one of the n best documents."""
    first = [r["slot"] for r in slots.orderBy(F.desc("bound"), "slot").limit(max(FIRST_SLOTS, 2 * n)).collect()]
    best = _scored(live_postings(spark, path, named, state, first), query, scores, state["english"]).orderBy(F.desc("score")).limit(n).collect()
    floor = min(r["score"] for r in best) if len(best) == n else 0.0
    return slots.filter(F.col("bound") >= floor - 1e-5)


def blocks_read(spark: SparkSession, path: str, query: str, n: int = 40, k1: float = 1.2, b: float = 0.75) -> tuple[int, int]:
    """How many blocks of the wanted terms ``bm25`` reads, and how many there are."""
    state = state_of(spark, path)
    scores = _Scores(spark, path, query, state, k1, b)
    slots = _slot_bounds(spark, path, state, scores)
    total = F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")
    reads = surviving(slots, spark, path, query, n, state, query_terms(query, state["english"]), scores)
    return reads.agg(total).first()["n"], slots.agg(total).first()["n"]
