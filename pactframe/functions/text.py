"""Tokens, stop words and stems of document text."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from pactframe.functions.stemmer import IRREGULAR, stem

# Fixed value: what a token is.
TOKEN = r"([\p{L}\p{N}]+)"

# Fixed value: English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don should now
""".split()
_STOPPED = frozenset(STOP_WORDS)


def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def content_tokens(text: Column) -> Column:
    """Distinct tokens that are not stop words."""
    stopped = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.array_distinct(tokens(text)), stopped)


@functools.lru_cache(maxsize=1 << 17)
def normal_term(token: str, english: bool = True) -> str | None:
    """Search term of a token: its stem, or None for a stop word."""
    if not english:
        return token
    return None if token in _STOPPED else stem(token)


def word_starts(terms: frozenset[str]) -> list[str]:
    """What a word must start with to have one of the stems: its first two letters.

    Only a few irregular words differ from their stem that early.
    """
    return sorted({t[:2] for t in terms} | {w[:2] for w, t in IRREGULAR.items() if t in terms})


def group_terms(english: bool, only: frozenset[str] | None = None):
    """Function for mapInArrow: (keys..., words, places) to (keys..., term, tf, positions).

    ``places`` are the positions of the words, or NULL when the words are a whole
    text.  Terms are grouped within one row, so nothing is shuffled and memory is
    bound by one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, words_name, places_name = batch.schema.names
            words, places = batch.column(words_name), batch.column(places_name)
            lengths = words.value_lengths().fill_null(0).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            if places.null_count:
                starts = np.cumsum(lengths) - lengths
                position = np.arange(len(row)) - np.repeat(starts, lengths) + 1
            else:
                position = places.flatten().to_numpy()

            # each distinct word of the batch is normalised once
            encoded = words.flatten().dictionary_encode()
            known: dict[str, int] = {}
            term_of_word = np.full(len(encoded.dictionary) + 1, -1)
            for code, word in enumerate(encoded.dictionary.to_pylist()):
                term = normal_term(word, english)
                if term is not None and (only is None or term in only):
                    term_of_word[code] = known.setdefault(term, len(known))
            term = term_of_word[encoded.indices.to_numpy()]

            kept = term >= 0
            row, term, position = row[kept], term[kept], position[kept]
            group = row * max(len(known), 1) + term
            order = np.argsort(group, kind="stable")
            group = group[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(first, len(group))
            picked = batch.select(keys).take(pa.array(row[order][first]))
            names = pa.array(list(known), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    *picked.columns,
                    names.take(pa.array(term[order][first])),
                    pa.array(np.diff(ends).astype(np.int32)),
                    pa.ListArray.from_arrays(ends.astype(np.int32), position[order].astype(np.int32)),
                ],
                names=[*keys, "term", "tf", "positions"],
            )

    return run


POSTINGS = "array<struct<field:string,term:string,tf:int,positions:array<int>,tenths:bigint>>"
ROWS_AT_ONCE = 1_000


def fields_postings(english: bool, weights: dict[str, int]):
    """Function for mapInArrow: (keys..., words of each field) to (keys..., length, postings).

    A document stays one row, so its weighted length and its terms are known
    without a shuffle.  ``tenths`` is the weighted count of the term in all
    fields, in the first posting of the term alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                yield grouped(whole.slice(start, ROWS_AT_ONCE))

    def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_rows, n_fields = batch.num_rows, len(weights)
        keys = batch.schema.names[:-n_fields]
        terms, row, field, term, tf, places, position = _groups(batch, n_fields, english, False)
        counted = np.array(list(weights.values()))[field] * tf
        opens = (np.diff(row, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0)
        tenths = np.zeros(len(row), np.int64)
        if len(row):
            tenths[opens] = np.add.reduceat(counted, np.flatnonzero(opens))
        postings = pa.StructArray.from_arrays(
            [*_posting(weights, terms, field, term, tf, places, position), pa.array(tenths, mask=~opens)],
            ["field", "term", "tf", "positions", "tenths"],
        )
        ends = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
        length = np.bincount(row, weights=counted, minlength=n_rows).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in keys], pa.array(length), pa.ListArray.from_arrays(ends, postings)],
            names=[*keys, "length", "postings"],
        )

    return run


def weighted_terms(english: bool, weights: dict[str, int]):
    """Function for mapInArrow: (keys..., words of each field) to (keys..., term, tenths), a row per term of a row.

    ``tenths`` is the weighted count of the term in all fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                yield counted(whole.slice(start, ROWS_AT_ONCE))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.schema.names[:-len(weights)]
        terms, row, field, term, tf, _, _ = _groups(batch, len(weights), english, False)
        tenths = np.array(list(weights.values()))[field] * tf
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0))
        if len(first):
            tenths = np.add.reduceat(tenths, first)
        return pa.RecordBatch.from_arrays(
            [*batch.select(keys).take(pa.array(row[first])).columns, pa.array(terms, pa.string()).take(pa.array(term[first])), pa.array(tenths.astype(np.int64))],
            names=[*keys, "term", "tenths"],
        )

    return run


def _groups(batch: pa.RecordBatch, n_fields: int, english: bool, by_term: bool):
    """The terms, and per posting its row, field, term, count and the place of its positions, and the positions.

    The last columns are the words of the fields.  Postings are in order of row, or of term.
    """
    n_rows = batch.num_rows
    columns = [batch.column(f) for f in batch.schema.names[-n_fields:]]
    lengths = [c.value_lengths().to_numpy() for c in columns]
    row = np.concatenate([np.repeat(np.arange(n_rows), n) for n in lengths])
    field = np.repeat(np.arange(n_fields), [n.sum() for n in lengths])
    position = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1 for n in lengths])

    # each distinct word is normalised once
    encoded = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
    normal = [normal_term(word, english) for word in encoded.dictionary.to_pylist()]
    terms = sorted({t for t in normal if t is not None})
    codes = {t: i for i, t in enumerate(terms)}
    term = np.array([codes.get(t, -1) for t in normal] + [-1])[encoded.indices.to_numpy()]

    kept = term >= 0
    row, field, term, position = row[kept], field[kept], term[kept], position[kept]
    major = term * n_rows + row if by_term else row * max(len(terms), 1) + term
    group = major * n_fields + field
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    places = np.append(first, len(group))
    picked = order[first]
    return terms, row[picked], field[picked], term[picked], np.diff(places), places, position[order]


def _posting(fields, terms, field, term, tf, places, position) -> list[pa.Array]:
    return [
        pa.array(list(fields), pa.string()).take(pa.array(field)),
        pa.array(terms, pa.string()).take(pa.array(term)),
        pa.array(tf.astype(np.int32)),
        pa.ListArray.from_arrays(places.astype(np.int32), position.astype(np.int32)),
    ]


RUN_WORDS = 1_000_000


def term_runs(english: bool, fields: list[str]):
    """Function for mapInArrow: (keys..., words of each field) to (keys..., field, term, tf, positions) in runs ordered by term.

    A run holds the rows of about ``RUN_WORDS`` words, or of one batch's slice if
    that has more, so memory is bound and nothing is shuffled or spilled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(start, ROWS_AT_ONCE)
                held.append(part)
                words += sum(len(part.column(f).flatten()) for f in part.schema.names[-len(fields):])
                if words >= RUN_WORDS:
                    yield ordered(held)
                    held, words = [], 0
        if held:
            yield ordered(held)

    def ordered(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(parts)
        keys = batch.schema.names[:-len(fields)]
        terms, row, field, term, tf, places, position = _groups(batch, len(fields), english, True)
        picked = batch.select(keys).take(pa.array(row))
        return pa.RecordBatch.from_arrays(
            [*picked.columns, *_posting(fields, terms, field, term, tf, places, position)],
            names=[*keys, "field", "term", "tf", "positions"],
        )

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def english_terms(words: pd.Series) -> pd.Series:
    """Distinct search terms of each token list."""
    known: dict[str, str | None] = {}

    def term(word: str) -> str | None:
        if word not in known:
            known[word] = normal_term(word)
        return known[word]

    return words.map(lambda ws: None if ws is None else list(dict.fromkeys(filter(None, map(term, ws)))))
