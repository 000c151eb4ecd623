"""Benchmark passages inside documents, by latent semantic retrieval.

Documents are read as overlapping windows of words.  Term weights come from
document counts over the whole table; a randomised SVD of the weighted term
matrix, computed as Spark jobs over passages and benchmark items, gives a
latent space in which windows and items are compared by cosine.  Candidates
are then checked exactly: the longest common subsequence of window and item
must hold most of the item's weight, and enough of its answer, so that
reworded and slightly edited items are found and chance resemblance is not.

Only words that occur in the benchmark can add to any of these values, so all
others are dropped when a text is read.  The benchmark is worked off in blocks
of bounded size; the documents are never collected.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pactframe.llm.common import chunks, raw, without
from pactframe.sources.tables import stored

RANK = 128
EXTRA = 16  # random directions beyond the rank
POWER = 1  # further passes of the sketch
FIT_DOCUMENTS = None  # documents whose passages the latent space is fitted on; all of them without a number
PASSAGE = 48  # words of such a passage
BLOCK_CHARS = 1_000_000  # characters of benchmark text worked off at a time
LEAST_COSINE = 0.3
LEAST_SHARE = 0.7  # of an item's weight that a window must hold in order
LEAST_ANSWER = 0.5
SMALLEST_WINDOW = 16
HITS = 1 << 16  # words of windows compared at a time

# Letters and digits of ASCII stay, capitals become small, the rest parts words; bytes of other scripts stay.
PLAIN = bytes(
    b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words in small letters; ASCII punctuation parts them."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(PLAIN).split()


def answer_of(text: str) -> str:
    """What follows the last answer mark; else the last sentence, or the last third of a single one."""
    marked = re.split(r"(?i)\banswer\s*:", text)
    if len(marked) > 1 and marked[-1].strip():
        return marked[-1]
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    if len(sentences) > 1:
        return sentences[-1]
    words = text.split()
    return " ".join(words[-max(1, len(words) // 3):])


@dataclass
class Block:
    """Benchmark items of one block as numbers of its vocabulary."""

    keys: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: dict[bytes, int]


def read_blocks(items: DataFrame, key: str, text: str, block_chars: int) -> list[list]:
    """The items in blocks whose texts have about ``block_chars`` characters; an item is never cut."""
    rows = items.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-total // block_chars))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)))
    for n in range(blocks):
        yield sorted(((r.key, r.text) for r in placed.where(F.col("block") == n).collect()), key=repr)


def make_block(rows: list) -> Block:
    vocabulary: dict[bytes, int] = {}

    def numbers(text: str) -> np.ndarray:
        return np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text.encode())], np.int32)

    block = Block([], [], [], vocabulary)
    for key, text in rows:
        words = numbers(text)
        if len(words):
            block.keys.append(key)
            block.words.append(words)
            block.answers.append(numbers(answer_of(text)))
    return block


# ------------------------------------------------- counts and latent space


def numbered(docs: DataFrame, block: Block, fit_documents: int | None) -> DataFrame:
    """The rows with ``line``, the vocabulary's number of each word of ``raw`` or -1, instead of it, and ``fit``.

    With ``fit_documents`` only about so many documents are fitted on, chosen by
    the hash of the text, so copies are among them together or not at all.
    """
    fit = F.lit(True)
    if fit_documents is not None:
        fit = F.xxhash64("raw") / F.lit(2.0**64) + 0.5 < min(1.0, fit_documents / max(docs.count(), 1))
    rows = docs.select("doc", fit.alias("fit"), "raw")
    vocabulary = block.vocabulary

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                lines = pa.array([line_of(t, vocabulary).tobytes() for t in part.column("raw").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("fit"), lines], names=["doc", "fit", "line"])

    return rows.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, fit boolean, line binary")


def line_of(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(vocabulary.get, words, itertools.repeat(-1)), "<i4", len(words))


def count_terms(lines: DataFrame, size: int) -> DataFrame:
    """(term, n): documents with the term, by task, to be summed."""

    def run(batches):
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for line in batch.column("line").to_pylist():
                counts[np.unique(np.frombuffer(line, "<i4"))] += 1
        some = np.flatnonzero(counts[:size])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["term", "n"])

    return lines.select("line").mapInArrow(run, "term int, n long")


def passages_of(line: bytes) -> list[np.ndarray]:
    """The vocabulary's words in each PASSAGE words of a line."""
    ids = np.frombuffer(line, "<i4")
    parts = (ids[at : at + PASSAGE] for at in range(0, len(ids), PASSAGE))
    return [p for p in (p[p >= 0] for p in parts) if len(p)]


def passages_in(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``passages_of`` all the lines at once: the words of all passages, words by passage, passages by line."""
    ids = np.frombuffer(b"".join(lines), "<i4")
    words = np.fromiter(map(len, lines), np.int64, len(lines)) // 4
    parts = -(-words // PASSAGE)
    passage = np.arange(len(ids)) + np.repeat((np.cumsum(parts) - parts) * PASSAGE - (np.cumsum(words) - words), words)
    kept = ids >= 0
    sizes = np.bincount(passage[kept] // PASSAGE, minlength=parts.sum())
    held = sizes > 0
    return ids[kept], sizes[held], np.bincount(np.repeat(np.arange(len(lines)), parts)[held], minlength=len(lines))


TOGETHER = 4096  # passages whose products are formed at a time, and the rest of their last line


def groups_of(lines: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and sizes of the passages of whole lines, ``TOGETHER`` or a little more at a time."""
    ids, sizes, count = [], [], 0
    while some := list(itertools.islice(lines, 256)):
        words, lengths, by_line = passages_in(some)
        done = np.r_[0, np.cumsum(by_line)]
        starts, at = np.r_[0, np.cumsum(lengths)], 0
        while count + done[-1] - at >= TOGETHER:
            end = done[np.searchsorted(done, at + TOGETHER - count)]
            yield np.concatenate([*ids, words[starts[at] : starts[end]]]), np.concatenate([*sizes, lengths[at:end]])
            ids, sizes, count, at = [], [], 0, end
        ids.append(words[starts[at] :])
        sizes.append(lengths[at:])
        count += done[-1] - at
    if count:
        yield np.concatenate(ids), np.concatenate(sizes)


DENSE = 64  # a term in more than one of so many passages gets a column of a dense matrix


def gram_times(passages: list[np.ndarray], weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """(transposed A) A matrix for the rows of A that the passages are, each a unit vector of term weights."""
    if not passages:
        return np.zeros_like(matrix)
    return gram_of(np.concatenate(passages), np.fromiter(map(len, passages), np.int64, len(passages)), weight, matrix)


def gram_of(ids: np.ndarray, sizes: np.ndarray, weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``gram_times`` for passages given as their words in a row and the number of words of each."""
    out = np.zeros_like(matrix)
    row = np.repeat(np.arange(len(sizes)), sizes)
    cell, times = np.unique(row * len(weight) + ids, return_counts=True)
    row, ids = np.divmod(cell, len(weight))
    value = times * weight[ids]
    norm = np.sqrt(np.bincount(row, value * value, len(sizes)))
    value = (value / np.maximum(norm[row], 1e-12)).astype(matrix.dtype)
    # products with the frequent terms as a dense matrix, with the others term by term
    often = np.flatnonzero(np.bincount(ids, minlength=len(weight)) * DENSE > len(sizes))
    place = np.full(len(weight), -1)
    place[often] = np.arange(len(often))
    column = place[ids]
    dense = column >= 0
    cells = np.zeros((len(sizes), len(often)), matrix.dtype)
    cells[row[dense], column[dense]] = value[dense]
    projected = cells @ matrix[often]
    row, ids, value = row[~dense], ids[~dense], value[~dense, None]
    if len(ids):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        projected[row[starts]] += np.add.reduceat(matrix[ids] * value, starts, axis=0)
        order = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        out[ids[order][firsts]] = np.add.reduceat(projected[row[order]] * value[order], firsts, axis=0)
    out[often] = cells.T @ projected
    return out


ROWS_AT_ONCE = 2048


LEVEL = 64  # partial sums of a slice that one task adds at the first level, as a share of all


def sketch(lines: DataFrame, items: list[np.ndarray], weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``gram_times`` over the passages of the lines as a Spark job, and over the items.

    Sums are formed per slice of terms, in two levels; each task adds its
    partial sums as a stream and holds one sum per slice.
    """
    wide = matrix.shape[1]

    def pieces(sums):
        for n, total in sorted(sums.items()):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([total.astype(matrix.dtype).tobytes()], pa.binary())],
                                             names=["slice", "sums"])

    def run(batches):
        total = np.zeros_like(matrix)
        for ids, sizes in groups_of(line for batch in batches for line in batch.column("line").to_pylist()):
            total += gram_of(ids, sizes, weight, matrix)
        slices = ((n, total[at : at + ROWS_AT_ONCE]) for n, at in enumerate(range(0, len(total), ROWS_AT_ONCE)))
        yield from pieces({n: piece for n, piece in slices if piece.any()})

    def add(batches):
        sums = {}
        for batch in batches:
            for n, part in zip(*(batch.column(c).to_pylist() for c in ("slice", "sums"))):
                part = np.frombuffer(part, matrix.dtype).astype(np.float64)
                sums[n] = sums[n] + part if n in sums else part
        yield from pieces(sums)

    out = gram_times(items, weight, matrix)
    schema = "slice int, sums binary"
    made = lines.where("fit").select("line").mapInArrow(run, schema)
    level = made.withColumn("part", F.pmod(F.xxhash64("sums"), F.lit(LEVEL))).repartition("slice", "part").select("slice", "sums").mapInArrow(add, schema)
    for r in level.repartition("slice").mapInArrow(add, schema).collect():
        piece = np.frombuffer(r.sums, matrix.dtype).reshape(-1, wide)
        out[r.slice * ROWS_AT_ONCE : r.slice * ROWS_AT_ONCE + len(piece)] += piece
    return out


def latent_space(lines: DataFrame, block: Block, weight: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors of the weighted term matrix, terms by at most ``rank`` directions."""
    wide = min(rank + EXTRA, len(weight))
    basis = np.random.default_rng(seed).standard_normal((len(weight), wide)).astype(np.float32)
    for _ in range(POWER):
        basis = np.linalg.qr(sketch(lines, block.words, weight, basis))[0]
    image = sketch(lines, block.words, weight, basis)
    small = basis.T @ image
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


# ----------------------------------------------------------------- search


def common_weight(item: np.ndarray, window: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest common subsequence."""
    best = np.zeros(len(window) + 1)
    for w in item:
        step = best.copy()
        np.maximum(step[1:], np.where(window == w, best[:-1] + weight[w], 0), out=step[1:])
        best = np.maximum.accumulate(step)
    return float(best[-1])


class Finder:
    """Searches texts for the items of a block; one per task."""

    def __init__(self, block: Block, weight: np.ndarray, space: np.ndarray):
        self.block, self.weight = block, weight
        self.scaled = space * weight[:, None].astype(np.float32)
        self.mass = np.array([weight[w].sum() for w in block.words])
        queries = np.stack([self.scaled[w].sum(0) for w in block.words])
        self.queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
        sizes = np.array(list(map(len, block.words)))
        # the smallest of the windows 16, 24, 32, 48, 64 ... that holds the item wherever it lies, at steps of a quarter
        doubled = 2 ** np.ceil(np.log2(np.maximum(sizes * 4 / 3, SMALLEST_WINDOW) / SMALLEST_WINDOW)).astype(int) * SMALLEST_WINDOW
        window = np.where((doubled > SMALLEST_WINDOW) & (sizes * 4 <= doubled * 9 // 4), doubled * 3 // 4, doubled)
        self.classes = [(int(w), np.flatnonzero(window == w)) for w in np.unique(window)]
        self.kinds = [(k, n * weight[k]) for k, n in (np.unique(w, return_counts=True) for w in block.words)]

    def find_in(self, texts: list[bytes]):
        return self.find([line_of(t, self.block.vocabulary) for t in texts])

    def find(self, lines: list[np.ndarray]) -> list[list[tuple[int, float, float, float]]]:
        """For each line its items with cosine, weight share in order, and share of the answer."""
        found: list[list] = [[] for _ in lines]
        gap = self.classes[-1][0]
        ids, starts, at = [], [], 0
        for own in lines:
            starts.append(at)
            ids += [own, np.full(gap, -1, np.int32)]
            at += len(own) + gap
        if not at:
            return found
        line = np.concatenate(ids)
        starts = np.array(starts)
        hits = np.flatnonzero(line >= 0)
        terms = line[hits]
        total = np.r_[0.0, np.cumsum(self.weight[terms])]
        best: dict[tuple[int, int], list] = {}
        for size, members in self.classes:
            left = np.arange(0, len(line), size // 4)
            low, high = np.searchsorted(hits, left), np.searchsorted(hits, left + size)
            # a window lighter than the share of the lightest item cannot hold any item's share
            heavy = np.flatnonzero(total[high] - total[low] >= LEAST_SHARE * self.mass[members].min() - 1e-6)
            # parts of about HITS words, however many each window holds
            for part in np.split(heavy, np.flatnonzero(np.diff(np.cumsum(high[heavy] - low[heavy]) // HITS)) + 1):
                last = -1
                for window, item, cosine in self.near(terms, low[part], high[part], members):
                    if window != last:
                        w, last = part[window], window
                        inside = terms[low[w] : high[w]]
                        there = np.unique(inside)
                    share = self.overlap(item, there) / self.mass[item]
                    if share >= LEAST_SHARE:
                        doc = int(np.searchsorted(starts, hits[high[w] - 1], "right") - 1)  # the gap keeps others out
                        best.setdefault((doc, item), []).append((share, cosine, inside))
        for (doc, item), windows in best.items():
            windows.sort(key=lambda x: (-x[0], -x[1]))
            for _, cosine, inside in windows:
                checked = self.check(item, inside)
                if checked:
                    found[doc].append((item, float(cosine), *checked))
                    break
        return found

    def near(self, terms, low, high, members):
        """Windows and items of a class at LEAST_COSINE or more in the latent space.

        What lies between the ends of windows is summed once for all windows it is in.
        """
        some = high > low
        if not some.any():
            return
        where = np.flatnonzero(some)
        low, high = low[some], high[some]
        cuts = np.unique(np.r_[low, high])
        first, last = np.searchsorted(cuts, low), np.searchsorted(cuts, high)
        inside = np.cumsum(np.bincount(first, minlength=len(cuts)) - np.bincount(last, minlength=len(cuts)))
        held = np.flatnonzero(inside > 0)
        sizes = cuts[held + 1] - cuts[held]
        ends = np.cumsum(sizes)
        flat = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(cuts[held], sizes)
        sums = np.zeros((len(cuts), self.scaled.shape[1]), self.scaled.dtype)
        sums[held] = np.add.reduceat(self.scaled[terms[flat]], ends - sizes, axis=0)
        image = sums[first]
        for n in range(1, (last - first).max()):
            more = first + n < last
            image[more] += sums[first[more] + n]
        image /= np.maximum(np.linalg.norm(image, axis=1, keepdims=True), 1e-9)
        cosines = image @ self.queries[members].T
        for window, item in zip(*np.nonzero(cosines >= LEAST_COSINE)):
            yield where[window], int(members[item]), cosines[window, item]

    def overlap(self, item: int, there: np.ndarray) -> float:
        """Weight of the item's words that a window has, in any order: a bound of the ordered one."""
        kinds, masses = self.kinds[item]
        return float(masses[there[np.minimum(there.searchsorted(kinds), len(there) - 1)] == kinds].sum())

    def check(self, item: int, inside: np.ndarray) -> tuple[float, float] | None:
        words, answer = self.block.words[item], self.block.answers[item]
        own = inside[np.isin(inside, words)]
        share = common_weight(words, own, self.weight) / self.mass[item]
        if share < LEAST_SHARE:
            return None
        answered = common_weight(answer, own, self.weight) / max(float(self.weight[answer].sum()), 1e-12)
        return (share, answered) if answered >= LEAST_ANSWER else None


def fitted(docs: DataFrame, items: DataFrame, item_key: str, item_text: str, rank: int, fit_documents: int | None, block_chars: int):
    """For each block of the benchmark the parts of a Finder (block, weights, latent space) and the lines of ``docs`` (doc, raw).

    Texts are taken apart once a block; all later steps read the stored lines.
    """
    for rows in read_blocks(items, item_key, item_text, block_chars):
        block = make_block(rows)
        if not block.keys:
            continue
        lines = stored(numbered(docs, block, fit_documents), "benchmark-lines")
        number = max(lines.count(), 1)
        seen = np.zeros(len(block.vocabulary))
        for r in count_terms(lines, len(seen)).groupBy("term").agg(F.sum("n").alias("n")).collect():
            seen[r.term] = r.n
        # squared, so that rare words carry a passage and common ones hardly count
        weight = np.log((number + 2) / (seen + 1)) ** 2
        yield (block, weight, latent_space(lines, block, weight, rank)), lines


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
               rank: int = RANK, fit_documents: int | None = FIT_DOCUMENTS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_key, cosine, share, answer_share) of every benchmark item found in a document.

    ``share`` is the part of the item's term weight that a window holds in the
    item's order.  Null and empty texts hold nothing, items without words are
    never found, repeated rows give repeated pairs, and with an empty table on
    either side the result is empty.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc"), raw(text).alias("raw"))
    doc_kind, item_kind = (df.schema[k].dataType.simpleString() for df, k in ((docs, key), (items, item_key)))
    schema = f"doc {doc_kind}, item {item_kind}, cosine double, share double, answer_share double"
    out = docs.sparkSession.createDataFrame([], schema)
    key_type = items.select(item_key).limit(0).toArrow().schema.field(0).type
    for parts, lines in fitted(rows, items, item_key, item_text, rank, fit_documents, block_chars):

        def run(batches, parts=parts):
            finder = Finder(*parts)
            for batch in batches:
                for part in chunks(batch):
                    found = finder.find([np.frombuffer(line, "<i4") for line in part.column("line").to_pylist()])
                    owner = [n for n, f in enumerate(found) for _ in f]
                    flat = [f for fs in found for f in fs]
                    columns = [part.column("doc").take(pa.array(owner, pa.int64()))]
                    columns.append(pa.array([finder.block.keys[f[0]] for f in flat], key_type))
                    columns += [pa.array([f[k] for f in flat], pa.float64()) for k in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "item", "cosine", "share", "answer_share"])

        out = out.unionByName(lines.select("doc", "line").mapInArrow(run, schema))
    return out.select(F.col("doc").alias(key), F.col("item").alias(item_key), "cosine", "share", "answer_share")


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  rank: int = RANK, fit_documents: int | None = FIT_DOCUMENTS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no benchmark item is found, with their columns.  No shuffle of documents."""
    out, rows = docs, docs.select(F.lit(0).alias("doc"), raw(text).alias("raw"))
    for parts, _ in fitted(rows, items, item_key, item_text, rank, fit_documents, block_chars):

        def run(batches, parts=parts):
            finder = Finder(*parts)
            for batch in batches:
                for part in chunks(batch):
                    clean = [not f for f in finder.find_in(part.column("__raw").to_pylist())]
                    yield part.filter(pa.array(clean, pa.bool_())).drop_columns(["__raw"])

        schema = without(out, "__raw").schema
        out = out.withColumn("__raw", raw(text)).mapInArrow(run, schema)
    return out
