"""Byte-level BPE through a sentencepiece model that is written from a rank file.

The vocabulary of a rank file (one base64 token and its rank per line) becomes
a sentencepiece BPE model: each byte is mapped to one printable character, a
piece scores its negative rank, and normalisation is the identity.  Merges then
happen in rank order, as in the rank file's own library.
"""

from __future__ import annotations

import base64
import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pactframe.llm.common import extended, map_batches, raw, without

CACHED = 400_000  # pieces of text remembered per task; the cache starts anew beyond that

# Fixed value: the pattern of the rank files for which a text may be cut before each space that a
# visible character follows.  No match goes on over such a place, and none looks past it.
SPACE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNEVEN_SPACE = re.compile(r" (?=\s|$)|^ ")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece 0 is unknown, piece r + 1 is the token of the r-th lowest rank."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    to_char = byte_characters()
    model = proto.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(map(to_char.__getitem__, token)), score=-float(rank))
    spec = model.trainer_spec
    spec.model_type = proto.TrainerSpec.BPE
    spec.vocab_size = len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = 0, -1, -1, -1
    rules = model.normalizer_spec
    rules.name = "identity"
    rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder over one model, held by a task."""

    def __init__(self, model: bytes, ranks: list[int], pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        self.rank_of_piece = np.array([0, *ranks], "<u4")
        self.split = regex.compile(pattern).findall
        self.by_space = pattern == SPACE_PATTERN
        chars = byte_characters()
        self.to_char = dict(enumerate(chars))
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {
            int(self.rank_of_piece[p]): bytes(map(back.__getitem__, self.model.id_to_piece(p)))
            for p in range(1, self.model.get_piece_size())
        }
        self.cache: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        # A whole pre-token that is in the vocabulary is one token, even if no merges lead to it.
        names = [self.model.id_to_piece(p) for p in range(1, self.model.get_piece_size())]
        self.whole = {n: p for p, (n, ids) in enumerate(zip(names, self.model.encode(names)), 1) if ids != [p]}

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces of text, each a pre-token or several of them."""
        parts = [self.split(p) for p in pieces]
        tokens = list({t for p in parts for t in p if t not in self.tokens})
        names = [t.encode().decode("latin-1").translate(self.to_char) for t in tokens]
        ids = self.model.encode(names, num_threads=1)
        if self.whole:
            ids = [[self.whole[n]] if n in self.whole else i for n, i in zip(names, ids)]
        flat = self.rank_of_piece[list(chain.from_iterable(ids))].tobytes()
        ends = list(accumulate(4 * len(i) for i in ids))
        self.tokens.update(zip(tokens, (flat[a:b] for a, b in zip([0, *ends], ends))))
        known = self.tokens
        for piece, part in zip(pieces, parts):
            self.cache[piece] = known[part[0]] if len(part) == 1 else b"".join([known[t] for t in part])

    def pieces(self, text: str) -> list[str]:
        """The text cut at places where pre-tokens end."""
        if not self.by_space or not text or UNEVEN_SPACE.search(text):
            return self.split(text)
        return text.replace(" ", "\x00 ").split("\x00") if "\x00" not in text else self.split(text)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit numbers."""
        pieces = self.pieces(text)
        kinds = set(pieces)
        new = [t for t in kinds if t not in self.cache]
        if new:
            if len(self.cache) > CACHED:
                self.cache.clear()
                self.tokens.clear()
                new = list(kinds)
            self.learn(new)
        return b"".join(map(self.cache.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec_parts(path: str) -> tuple[bytes, list[int]]:
    ranks = read_ranks(path)
    return model_bytes(ranks), sorted(ranks.values())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False,
           keep_text: bool = True) -> DataFrame:
    """The rows with ``n_tokens`` and ``ids``; with ``decoded`` also the bytes those ids stand for.

    ``ids`` holds the token ids as little-endian unsigned 32-bit numbers.  The
    vocabulary file is read on the driver and travels with the job; its size
    does not depend on the data.  A null or empty text has no tokens; strings
    of special tokens are ordinary text.  Same-named input columns are
    replaced.  No shuffle.
    """
    model, ranks = codec_parts(path)
    rows = docs.withColumn("__raw", raw(text))
    added = {"n_tokens": "long", "ids": "binary"} | ({"decoded": "binary"} if decoded else {})
    kept = without(rows, "__raw", *added, *([] if keep_text else [text]))
    fields = kept.schema.names
    schema = extended(kept, **added)
    names = schema.names

    def start():
        codec = Codec(model, ranks, pattern)

        def step(batch):
            ids = [codec.encode(t.decode("utf-8", "replace")) for t in batch.column("__raw").to_pylist()]
            columns = [*(batch.column(c) for c in fields), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(codec.decode, ids), pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    return map_batches(rows.select("__raw", *fields), start, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes that the ids of ``encode`` stand for; null ids give none."""
    model, ranks = codec_parts(path)
    kept = without(rows, "decoded")
    fields = kept.schema.names

    def start():
        codec = Codec(model, ranks, pattern)

        def step(batch):
            out = [codec.decode(i or b"") for i in batch.column(ids).to_pylist()]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(out, pa.binary())], names=[*fields, "decoded"])

        return step

    return map_batches(kept, start, extended(kept, decoded="binary"))
