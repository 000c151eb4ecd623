"""Ranked lexical search by classes of equal bags.

Only the words of the items matter to their scores, so each document becomes
its bag: how often it holds each of those words, and its length value m.
Documents with equal bags score alike.  They form one class, found by hash and
compared in full, which is scored once; its members follow by ascending doc_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pactframe.llm.common import map_batches
from pactframe.sources.tables import stored

# A term is a run of letters, digits of ASCII and all that is beyond it; only A-Z change case.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = bytes(ord(chr(b).lower()) if chr(b) in LETTERS else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
TOP = 50
BLOCK_CHARS = 1_000_000  # characters of items in one pass over the documents
CELLS = 1 << 20  # scores held at a time in a task
LAST = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def item_blocks(items: DataFrame, chars: int = BLOCK_CHARS):
    """Lists of (item_id, set of terms), a bounded number of characters at a time; rows of one id are one item."""
    rows = items.where("text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator(prefetchPartitions=False)
    block, size = {}, 0
    for item, text in rows:
        if size + len(text) > chars and block and item not in block:
            yield list(block.items())
            block, size = {}, 0
        block.setdefault(item, set()).update(terms_of(text))
        size += len(text)
    if block:
        yield list(block.items())


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): the document's terms in all, and those of the vocabulary in order with their number."""
    known = dict(vocabulary)

    def start():
        def bag(text):
            words = terms_of(text)
            found = [t for t in map(known.get, words) if t is not None]
            numbers, counts = np.unique(np.array(found, np.int32), return_counts=True)
            return len(words), numbers, counts.astype(np.int32)

        def step(batch):
            n, terms, counts = zip(*map(bag, batch.column(1).to_pylist()))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "counts"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), start, "doc_id long, n long, terms array<int>, counts array<int>")


def document_frequencies(held: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; tasks send their sums."""
    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for term, df in held.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df")).toLocalIterator():
        out[term] = df
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The TOP classes of each item so far, by falling score and then by smallest document."""

    def __init__(self, items: int):
        self.floor = np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, first document, hash
        self.waiting: list[list[np.ndarray]] = []

    def add(self, scores: np.ndarray, first: np.ndarray, classes: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        self.waiting.append([item, scores[row, item], first[row], classes[row]])
        if sum(len(w[0]) for w in self.waiting) > CELLS:
            self.settle()

    def settle(self) -> None:
        columns = [np.concatenate(c) for c in zip(self.rows, *self.waiting)]
        item, score, first, cls = columns
        order = np.lexsort((cls, first, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.rows = [c[order[place < TOP]] for c in columns]
        self.floor[item[place == TOP - 1]] = score[order[place == TOP - 1]]
        self.waiting = []


def score_classes(classes: DataFrame, holders: list[np.ndarray], weight: np.ndarray, items: int) -> DataFrame:
    """(item, score, hash, first): the classes of each task that can be among an item's first TOP.

    ``holders`` are the items that hold each term.  An item's first TOP documents
    lie in its first TOP classes by score and smallest member, since each of
    those has a document before any member of a later class.
    """
    starts = np.cumsum([0, *map(len, holders)])
    flat = np.concatenate([*holders, np.zeros(0, np.int64)]).astype(np.int64)
    # sums stay exact in doubles below 2 ** 53; a term adds at most a million times its weight
    exact = int(weight.sum()) * 1_000_000 < 1 << 53
    fan_of = np.diff(starts)

    def pieces(batch):
        """The batch cut so that a piece's scores and summands are about CELLS."""
        lists = batch.column(3)
        summands = np.cumsum(np.r_[0, fan_of[lists.flatten().to_numpy(zero_copy_only=False)]])
        offsets = lists.offsets.to_numpy()
        load = np.cumsum(np.diff(summands[offsets - offsets[0]]) + items)
        cuts = [0, *(np.flatnonzero(np.diff(load // CELLS)) + 1), batch.num_rows]
        return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]

    def run(batches):
        best = Best(items)
        for whole in batches:
            for batch in pieces(whole):
                lists, tf = batch.column(3), batch.column(4)
                sizes = np.diff(lists.offsets.to_numpy())
                term = lists.flatten().to_numpy(zero_copy_only=False)
                tf = tf.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = np.repeat(batch.column(2).to_numpy(), sizes)
                row = np.repeat(np.arange(batch.num_rows), sizes)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                fan = fan_of[term]
                where = np.repeat(starts[term] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
                cell = np.repeat(row, fan) * items + flat[where]
                spread = np.repeat(value, fan)
                if exact:
                    scores = np.bincount(cell, spread, batch.num_rows * items).astype(np.int64)
                else:
                    scores = np.zeros(batch.num_rows * items, np.int64)
                    np.add.at(scores, cell, spread)
                best.add(scores.reshape(-1, items), batch.column(1).to_numpy(), batch.column(0).to_numpy())
        best.settle()
        item, score, first, hashes = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(score), pa.array(hashes), pa.array(first)],
                                         names=["item", "score", "hash", "first"])

    return classes.select("hash", "first", "m", "terms", "counts").mapInArrow(run, "item int, score long, hash long, first long")


def search_block(docs: DataFrame, block: list, kind: str) -> DataFrame | None:
    """The first TOP documents of each item of a block; None if no document has a term."""
    spark = docs.sparkSession
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*(terms for _, terms in block))))}
    ids = [item for item, _ in block]
    holders = [[] for _ in vocabulary]
    for n, (_, terms) in enumerate(block):
        for t in terms:
            holders[vocabulary[t]].append(n)
    held = stored(bags(docs, vocabulary), "bags")
    size = held.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    if not size["N"]:
        return None
    weight = weights(document_frequencies(held, len(vocabulary)), size["N"])

    length = F.expr(f"50 + ((50 * n * {size['N']}L) div {size['L']}L)")
    alike = held.where("size(terms) > 0").select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("at"), length.alias("m"), "terms", "counts")
    members = stored(alike.withColumn("hash", F.xxhash64("m", "terms", "counts")), "members")
    bag = ["hash", "m", "terms", "counts"]
    classes = members.groupBy(*bag).agg(F.min("at").alias("first"))
    found = stored(score_classes(classes, [np.array(h, np.int64) for h in holders], weight, len(ids)), "scored")

    def top(rows, key, *order):
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= TOP)

    # by parts first, so that no task takes the candidates of all tasks for an item
    order = F.desc("score"), "first", "hash"
    best = top(found.withColumn("part", F.struct("item", F.pmod(F.xxhash64("hash", "first"), F.lit(64)))), "part", *order)
    best = stored(top(best, "item", *order).select("item", "score", "hash", "first"), "best")
    # a class's own bag is that of its first document; the first TOP members are found in parts and then over the parts
    bags_of = members.join(best.select("hash", F.col("first").alias("at")).distinct(), ["hash", "at"]).select(*bag, F.col("at").alias("first")).distinct()
    wanted = members.join(bags_of, bag).select(F.struct("hash", "first").alias("class"), "at", "doc_id")
    wanted = top(wanted.withColumn("part", F.struct("class", F.pmod(F.xxhash64("at"), F.lit(64)))), "part", "at")
    wanted = top(wanted, "class", "at").select("class.*", "at", "doc_id")
    ranked = top(best.join(wanted, ["hash", "first"]), "item", F.desc("score"), "at")
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
    return ranked.join(names, "item").select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the 50 best documents of each item.

    ``docs`` has doc_id (an integer) and text, ``items`` item_id and text; other columns are
    ignored.  A null or empty text has no terms: such a document is not counted
    and never found, such an item finds nothing.  Rows of one item_id are one
    item with the terms of all.  Rows of one doc_id are documents of their own.
    Equal scores go by ascending doc_id, a null one last.  Scores of 0 are left
    out.  Items are taken in blocks of a million characters; each block reads
    the documents once.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    found = [f for f in (search_block(docs, block, kind) for block in item_blocks(items)) if f is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


ORACLE = rf"""
with words as (
  select r, doc_id, unnest(regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'), '{PATTERN}')) as term
  from (select row_number() over () as r, doc_id, text from documents)),
lengths as (select r, doc_id, count(*) as n from words group by all),
total as (select count(*) as N_docs, sum(n)::bigint as L_terms from lengths),
wanted as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'), '{PATTERN}')) as term from benchmark),
tf as (select r, term, count(*) as tf from words where term in (select term from wanted) group by all),
w as (select term, floor(1000 * ln((2 * N_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, total group by term, N_docs),
m as (select r, doc_id, 50 + ((50 * n * N_docs) // L_terms) as m from lengths, total),
scores as (
  select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from tf join wanted using (term) join w using (term) join m using (r) group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {TOP}
"""
