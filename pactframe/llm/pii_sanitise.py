"""Personal data in texts, and the terms that give it away.

Patterns find the protected entities: addresses, card and phone numbers.  How
much a term reveals of an entity is measured over the whole corpus, by the
documents that hold both anywhere in their texts: the pointwise mutual information of the two against the information content of the
entity, log2(N n(t,e) / n(t) n(e)) / log2(N / n(e)).  It is 1 for a term that
occurs with the entity only and near 0 for one that occurs anywhere.  Terms
above a threshold are reported in the documents that hold the entity, or
everywhere, to be generalised, or removed above a second one.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pactframe.llm.common import extended, map_batches, raw, without
from pactframe.sources.tables import stored

KINDS = ("email", "ip", "card", "phone", "term")
BASE = KINDS[:4]
SUPPORT = 3  # documents of distinct words in which term and entity meet
GENERALISE = 0.8  # share of the entity's information from which a term is generalised
REMOVE = 0.95
HELD = 100_000  # terms that each task may hold; more are joined

# The quantifiers that never give back are those whose next character could not be one of them;
# they find the same and stay linear in the text.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W\d_]{3,}")


# ---------------------------------------------------------------- patterns


def emails(text: str) -> list[tuple[int, int]]:
    """For each @, the run of address characters before it that no earlier match has taken, and the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def good_ip(value: str) -> bool:
    parts = [p.lstrip("0") for p in value.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def good_card(value: str) -> bool:
    digits = NOT_DIGIT.sub("", value)
    return 14 <= len(digits) <= 19 and luhn(digits)


def good_phone(value: str) -> bool:
    return 10 <= len(NOT_DIGIT.sub("", value)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start and then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for kind, pattern, good in ((1, IP, good_ip), (2, CARD, good_card), (3, PHONE, good_phone)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if good(m.group())]
    out.sort()
    return out


# ---------------------------------------------------------------- contexts


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def entity_of(kind: int, value: str) -> int:
    """A number for the entity, the same for all ways to write a number."""
    plain = value.lower() if kind == 0 else NOT_DIGIT.sub("", value) if kind > 1 else value
    return signed(xxhash.xxh64_intdigest(f"{kind}:{plain}".encode()))


def words_outside(text: str, taken: list[tuple[int, int]]):
    """(start, end, word in small letters) of the words outside the spans already taken."""
    n = 0
    for m in WORD.finditer(text):
        while n < len(taken) and taken[n][1] <= m.start():
            n += 1
        if n == len(taken) or taken[n][0] >= m.end():
            yield m.start(), m.end(), m.group().lower()


def inspect(text: str) -> tuple[list[dict], list[int], int | None, list[str]]:
    """Base spans, entities, a number for the words outside the spans, and these words; no words without spans."""
    spans = base_spans(text)
    if not spans:
        return [], [], None, []
    words = sorted({w for _, _, w in words_outside(text, merged([(a, b) for a, _, b in spans]))})
    place = signed(xxhash.xxh64_intdigest("\x00".join(words).encode()))
    entities = sorted({entity_of(k, text[a:b]) for a, k, b in spans})
    return [{"kind": k, "start": a, "end": b} for a, k, b in spans], entities, place, words


def found_contexts(docs: DataFrame, text: str) -> DataFrame:
    """(row, context, entities, words) of the texts that have base spans, numbered by ``row``."""

    def start():
        def step(batch):
            found = [f for f in (inspect(t.decode("utf-8", "replace")) for t in batch.column("raw").to_pylist()) if f[0]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            columns = [pa.array([f[n] for f in found], kind) for n, kind in zip((2, 1, 3), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["context", "entities", "words"])

        return step

    found = map_batches(docs.select(raw(text).alias("raw")), start, "context long, entities array<long>, words array<string>")
    return found.withColumn("row", F.monotonically_increasing_id())


# --------------------------------------------------------------- disclosure


def term_counts(docs: DataFrame, text: str, wanted: frozenset[str] | None = None) -> DataFrame:
    """(term, n) per task and about every 200,000 terms: documents with the term, to be summed; of ``wanted`` terms if given."""

    def run(batches):
        count: Counter[str] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["term", "n"])

        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                for t in batch.column("raw").slice(part, 256).to_pylist():
                    terms = set(WORD.findall(t.decode("utf-8", "replace").lower()))
                    count.update(terms if wanted is None else terms & wanted)
                if len(count) > 200_000:
                    yield rows()
                    count.clear()
        yield rows()

    return docs.select(raw(text).alias("raw")).mapInArrow(run, "term string, n long")


def disclosing_terms(contexts: DataFrame, words: DataFrame, docs: DataFrame, text: str, support: int, threshold: float, held: int) -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal at least ``threshold`` of an entity.

    ``contexts`` has row, entity, context, and ``words`` the row and its terms.
    Equal contexts count once, so copies of a document are no evidence.
    Terms are counted over all texts of ``docs``; tasks count only those that
    meet an entity while these are no more than ``held``.
    """
    places = contexts.groupBy("entity", "context").agg(F.min("row").alias("row"))
    # an entity in fewer places than the support cannot meet any term often enough
    own = stored(places.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support), "entity-places")
    met = places.join(own.select("entity"), "entity").join(words, "row")
    pairs = met.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    pairs = stored(pairs.where(F.col("n_te") >= support), "term-entity-pairs")
    terms = stored(pairs.select("term").distinct(), "paired-terms")
    few = frozenset(r["term"] for r in terms.toLocalIterator()) if terms.count() <= held else None
    # summed first, so that the join meets each term once
    seen = term_counts(docs, text, few).groupBy("term").agg(F.sum("n").alias("n_t")).join(terms, "term", "left_semi")
    total = F.lit(float(max(docs.count(), 1)))
    # a term cannot be counted less often than it meets the entity
    n_t = F.greatest("n_t", "n_te")
    content = F.log2(total / F.col("n_e"))
    shared = F.log2(total * F.col("n_te") / (n_t * F.col("n_e")))
    scored = pairs.join(seen, "term").join(own, "entity").withColumn("disclosure", F.when(content > 0, shared / content).otherwise(0.0))
    return scored.where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


PACKED = 500_000  # (row, term) pairs that a task packs by term at a time


def terms_of_rows(rows: DataFrame) -> DataFrame:
    """(term, rows): the distinct terms of each whole text, each with the rows of a task that hold it, packed."""

    def run(batches):
        held: dict[str, list[int]] = {}
        pairs = 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.list_(pa.int64()))], names=["term", "rows"])

        for batch in batches:
            for row, t in zip(batch.column("row").to_pylist(), batch.column("raw").to_pylist()):
                for term in {w.lower() for w in WORD.findall(t.decode("utf-8", "replace"))}:
                    held.setdefault(term, []).append(row)
                    pairs += 1
                if pairs > PACKED:
                    yield packed()
                    held, pairs = {}, 0
        yield packed()

    return rows.select("row", "raw").mapInArrow(run, "term string, rows array<long>")


def term_spans(text: str, terms: dict[str, float], taken: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, disclosure) of the terms outside the spans already taken."""
    return [(a, b, terms[w]) for a, b, w in words_outside(text, taken) if w in terms]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


FULL_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64())]))
FULL_KIND = "array<struct<kind:string,start:int,end:int,disclosure:double>>"


def spans_of(text: str, terms: dict[str, float], revealed: dict[int, dict[str, float]] | None = None) -> list[dict]:
    """All spans of a text: the base ones, and those of ``terms``, or of the terms that ``revealed`` gives for its entities."""
    base = base_spans(text)
    if revealed is not None:
        terms = {}
        for e in {entity_of(k, text[a:b]) for a, k, b in base}:
            for term, value in revealed.get(e, {}).items():
                terms[term] = max(value, terms.get(term, 0.0))
    out = [(a, k, b, None) for a, k, b in base]
    if terms:
        out += [(a, 4, b, v) for a, b, v in term_spans(text, terms, merged([(a, b) for a, _, b in base]))]
    return [{"kind": KINDS[k], "start": a, "end": b, "disclosure": v} for a, k, b, v in sorted(out, key=lambda x: x[:3])]


def add_spans(rows: DataFrame, spans) -> DataFrame:
    """The rows without ``__raw`` and ``__terms`` but with ``spans``, the value of spans(text, terms of the row)."""
    fields = without(rows, "__raw", "__terms", "__spans").schema.names
    own_terms = "__terms" in rows.columns

    def start():
        def step(batch):
            texts = (t.decode("utf-8", "replace") for t in batch.column("__raw").to_pylist())
            terms = batch.column("__terms").to_pylist() if own_terms else [None] * batch.num_rows
            out = pa.array([spans(t, own) for t, own in zip(texts, terms)], FULL_SPAN)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), out], names=[*fields, "__spans"])

        return step

    return map_batches(rows, start, extended(rows.select(*fields), __spans=FULL_KIND))


def scan(docs: DataFrame, text: str = "text", support: int = SUPPORT, threshold: float = GENERALISE, keep_text: bool = True,
         everywhere: bool = False, held: int = HELD) -> DataFrame:
    """The rows with ``spans``: (kind, start, end, disclosure) by start and then kind.

    Kinds are those of KINDS; only terms have a disclosure.  A term is reported
    in the documents that hold an entity it reveals, and with ``everywhere`` in
    all documents.  Positions count code points, ends are exclusive.  A null or
    empty text has no spans; repeated rows get the same spans; a same-named
    input column is replaced, all others are passed on.

    Texts are read three times and never stored or shuffled while the terms in
    question are no more than ``held``: tasks then look them up.  More of them are
    joined to the terms of the texts, which are packed by task; rows are found
    again by a number given when they are written.  The result is the same.
    """
    kept = [c for c in without(docs, "spans").columns if keep_text or c.lower() != text.lower()]
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(kept)], raw(text).alias("__raw"))

    hits = stored(found_contexts(docs, text), "personal-contexts")
    contexts = hits.select("row", F.explode("entities").alias("entity"), "context")
    words = hits.select("row", F.col("words").alias("terms"))
    reveals = stored(disclosing_terms(contexts, words, docs, text, support, threshold, held), "revealing-terms")
    asked = reveals.groupBy("term").agg(F.max("disclosure").alias("disclosure")) if everywhere else reveals
    if asked.count() <= held:
        terms: dict = {}
        for r in asked.toLocalIterator():
            if everywhere:
                terms[r["term"]] = r["disclosure"]
            else:
                terms.setdefault(r["entity"], {})[r["term"]] = r["disclosure"]
        if everywhere:
            found = add_spans(named, lambda t, _: spans_of(t, terms))
        else:
            found = add_spans(named, lambda t, _: spans_of(t, {}, terms))
    else:
        rows = stored(named.withColumn("__row", F.monotonically_increasing_id()), "numbered-texts")
        packed = terms_of_rows(rows.select(F.col("__row").alias("row"), F.col("__raw").alias("raw")))
        met = packed.join(asked, "term")
        if everywhere:
            met = met.select("term", "disclosure", F.explode("rows").alias("__row"))
        else:
            # the entities of a row, to keep the terms that reveal one of them
            own = entities_of_rows(rows).withColumnRenamed("row", "__row")
            met = met.select("entity", "term", "disclosure", F.explode("rows").alias("__row")).join(own, ["__row", "entity"], "left_semi")
        of_row = met.groupBy("__row", "term").agg(F.max("disclosure").alias("disclosure")).groupBy("__row").agg(
            F.collect_list(F.struct("term", "disclosure")).alias("__terms"))
        marked = rows.join(stored(of_row, "terms-of-rows"), "__row", "left").drop("__row")
        found = add_spans(marked, lambda t, own: spans_of(t, {x["term"]: x["disclosure"] for x in own or ()}))
    return found.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(kept)], F.col("__spans").alias("spans"))


def entities_of_rows(rows: DataFrame) -> DataFrame:
    """(row, entity) of the base spans of the texts."""

    def start():
        def step(batch):
            found = [inspect(t.decode("utf-8", "replace"))[1] for t in batch.column("__raw").to_pylist()]
            owner = pa.array([n for n, es in enumerate(found) for _ in es], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("__row").take(owner), pa.array([e for es in found for e in es], pa.int64())], names=["row", "entity"])

        return step

    return map_batches(rows.select("__row", "__raw"), start, "row long, entity long")


def replacement(kind: str, value: str, disclosure: float | None) -> str:
    """What a span becomes: the name of its kind; a term the kind of word it is, or nothing."""
    if kind != "term":
        return f"[{kind.upper()}]"
    if disclosure >= REMOVE:
        return ""
    return "[NAME]" if value[:1].isupper() else "[TERM]"


def replaced(text: str | None, spans: list[dict]) -> str | None:
    """The text with its spans replaced; of overlapping spans the first one counts."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], replacement(s["kind"], text[s["start"] : s["end"]], s["disclosure"])]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, threshold: float = GENERALISE, everywhere: bool = False) -> DataFrame:
    """The rows with personal data replaced in the text; a null text stays null."""
    rows = scan(docs, text, support, threshold, everywhere=everywhere)
    fields = [c for c in rows.columns if c != "spans"]

    def start():
        def step(batch):
            clean = list(map(replaced, batch.column(text).to_pylist(), batch.column("spans").to_pylist()))
            columns = [pa.array(clean, pa.string()) if c == text else batch.column(c) for c in fields]
            return pa.RecordBatch.from_arrays(columns, names=fields)

        return step

    return map_batches(rows, start, rows.select(*[f"`{c}`" for c in fields]).schema)
