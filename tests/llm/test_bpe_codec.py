"""The codec against the rank file's own library, and exact round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from pactframe.llm import bpe_codec as bc
from pactframe.llm.queries import QUERIES, RANKS
from tests.llm.conftest import EDGES, FOLDER

PATH = public_tokenizers.path(RANKS)


def library_encoding():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = library_encoding()
CODEC = bc.Codec(*bc.codec_parts(PATH), public_tokenizers.PATTERN)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("ab '\n\t  st<|>.0é \u0085\x1c", max_size=40)))
def test_same_ids_as_the_library(text):
    packed = CODEC.encode(text)
    assert ids(packed) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(packed) == text.encode()


def test_every_token_of_the_vocabulary_is_one_token():
    assert sorted(CODEC.bytes_of) == list(range(len(CODEC.bytes_of)))
    assert all(ids(CODEC.encode(t)) == LIBRARY.encode_ordinary(t) for t in ["'s", " the", "\n\n", "ther", "\u00e9"])


def test_query(spark, documents):
    rows = QUERIES["op2_byte_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r.doc_id] or ""
        want = LIBRARY.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edges(docs):
    special = [(6, "<|endoftext|> is ordinary text"), (7, "a" * 300_000), (8, " " * 5000 + "\n\n x")]
    done = bc.encode(docs(EDGES + special, "ids"), PATH, public_tokenizers.PATTERN, decoded=True)
    assert done.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    rows = done.collect()
    assert len(rows) == len(EDGES) + 3
    for r in rows:
        assert r.n_tokens == len(r.ids) // 4
        assert bytes(r.decoded) == (r.text or "").encode()
        if len(r.text or "") < 10_000:
            assert ids(bytes(r.ids)) == LIBRARY.encode_ordinary(r.text or "")


def test_empty_table_and_decode(docs):
    none = bc.encode(docs([]), PATH, public_tokenizers.PATTERN)
    assert none.count() == 0 and bc.decode(none, PATH, public_tokenizers.PATTERN).count() == 0
    some = bc.encode(docs([(1, "round trip"), (2, None)]), PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in bc.decode(some, PATH, public_tokenizers.PATTERN).collect()} == {1: b"round trip", 2: b""}
