"""Near-duplicate documents by SimHash, linked through meeting balls of variants.

Two fingerprints differ in at most four bits exactly when some value lies
within two bits of both.  So each fingerprint can emit every variant within two
bits, 2,081 of them, and fingerprints that share a variant are linked.

Most fingerprints have no partner.  A first round finds those that may have
one with the same idea on two thirds of the bits: of three blocks of bits, the
two with fewest differences hold at most two, so for one of the three pairs of
blocks the variants within one bit meet; that is 131 variants in place of
2,081.  Colliding pairs are verified in full.  Where more than CROWD
fingerprints collide on one of these shorter keys, they go to the round over
all bits, where a variant is shared by at most 2,081 fingerprints whatever the
data, and every collision is a link.  Nothing is lost in either round.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pactframe.llm.common import map_batches, raw
from pactframe.llm.components import components
from pactframe.sources.tables import stored

SHINGLE = 4
SEED = 42
LINK_BITS = 4
CROWD = 64
BUCKET_ENTRIES = 1_000_000  # variants per bucket; the number of buckets follows the data
EMIT = 8192  # fingerprints whose variants are sorted into buckets at a time
BLOCKS = ((0, 21), (21, 42), (42, 64))
BYTES_AT_ONCE = 1 << 16


# ----------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``width`` words of a lower-cased text, or of all its words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = list(map(len, words))
    ends = list(itertools.accumulate(s + 1 for s in sizes))
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])]
    return np.array(found, np.uint64)


def fingerprint(text: bytes) -> int:
    """Bits set in over half of the shingle hashes; zero for a text without words."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BYTES_AT_ONCE):
        part = hashes[at : at + BYTES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) per row; a null or empty text has fingerprint 0.  No shuffle."""
    rows = docs.select(F.col(f"`{key}`").alias("doc"), raw(text).alias("raw"))
    kind = rows.schema["doc"].dataType.simpleString()

    def start():
        def step(batch):
            found = pa.array(map(fingerprint, batch.column("raw").to_pylist()), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc"), found], names=["doc", "fp"])

        return step

    return map_batches(rows, start, f"doc {kind}, fp long")


# -------------------------------------------------------------- variants


def block_variants() -> tuple[np.ndarray, np.ndarray]:
    """Masks of the kept bits and of the flipped bit, for each of the 131 short variants.

    The dropped block holds a mark of its own, so that the three kinds of keys stay apart.
    """
    keep, flip = [], []
    for low, high in BLOCKS:
        kept = sum(1 << b for b in range(64) if not low <= b < high)
        for b in (None, *(b for b in range(64) if not low <= b < high)):
            keep.append(kept)
            flip.append((1 << low) | (0 if b is None else 1 << b))
    return np.array(keep, np.uint64), np.array(flip, np.uint64)


def ball_variants() -> tuple[np.ndarray, np.ndarray]:
    """The same for the 2,081 variants of all 64 bits within two flips."""
    flip = [0, *(1 << b for b in range(64)), *((1 << b) | (1 << c) for b, c in itertools.combinations(range(64), 2))]
    return np.full(len(flip), 2**64 - 1, np.uint64), np.array(flip, np.uint64)


def emit(fps: DataFrame, masks: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Variants of each fingerprint, packed per bucket of variants: (bucket, fps, idx).

    A variant travels as its fingerprint and the number of the mask, from which
    the bucket makes it again.
    """
    keep, flip = masks

    def run(batches):
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), max(1, EMIT * 131 // len(flip))):
                fp = all_fps[at : at + max(1, EMIT * 131 // len(flip))]
                bucket = bucket_of((fp[:, None] & keep) ^ flip, buckets).ravel()
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                owner, number = np.divmod(order, len(flip))
                groups = [(bucket[g[0]], fp[o].tobytes(), n.astype("<u2").tobytes())
                          for g, o, n in zip(np.split(order, cuts), np.split(owner, cuts), np.split(number, cuts))]
                b, f, n = zip(*groups)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b, pa.int32()), pa.array(f, pa.binary()), pa.array(n, pa.binary())], names=["bucket", "fps", "idx"])

    return fps.mapInArrow(run, "bucket int, fps binary, idx binary")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each key, from the high bits of a multiplicative hash."""
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def unpack(rows: pa.Table, masks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of a bucket in the order of their variants, and the bounds of equal variants."""
    keep, flip = masks
    fps = np.concatenate([np.frombuffer(v, "<u8") for v in rows.column("fps").to_pylist()])
    idx = np.concatenate([np.frombuffer(v, "<u2") for v in rows.column("idx").to_pylist()])
    keys = (fps & keep[idx]) ^ flip[idx]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return fps[order], starts, np.diff(np.r_[starts, len(keys)])


def pairs_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Distinct pairs; equal members mark a crowded fingerprint."""
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0).view(np.int64)
    return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})


def linked(members: np.ndarray) -> np.ndarray:
    """For up to CROWD fingerprints, the position of the first one in the same component."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= LINK_BITS
    label = np.arange(len(members))
    while True:
        new = np.where(near, label[None, :], len(members)).min(1)
        if (new == label).all():
            return label
        label = new


def verified_links(masks):
    """Links among the fingerprints of a bucket that share a short variant, and the members of crowds."""

    def of_bucket(rows: pa.Table) -> pa.Table:
        fps, starts, sizes = unpack(rows, masks)
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= LINK_BITS]
        a, b = [fps[near]], [fps[near + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            members = fps[s : s + n]
            a.append(members)
            b.append(members[linked(members)] if n <= CROWD else members)
            if n <= CROWD:
                own = a[-1] != b[-1]
                a[-1], b[-1] = a[-1][own], b[-1][own]
        return pairs_table(np.concatenate(a), np.concatenate(b))

    return of_bucket


def ball_links(masks):
    """Links of the fingerprints that share a variant to the smallest of them."""

    def of_bucket(rows: pa.Table) -> pa.Table:
        fps, starts, sizes = unpack(rows, masks)
        least = np.repeat(np.minimum.reduceat(fps, starts), sizes)
        own = fps != least
        return pairs_table(fps[own], least[own])

    return of_bucket


def meet(fps: DataFrame, count: int, masks, find) -> DataFrame:
    """Pairs (a, b) from the buckets of all variants of the fingerprints."""
    buckets = max(1, -(-count * len(masks[1]) // BUCKET_ENTRIES))
    packed = emit(fps, masks, buckets)
    return packed.groupBy("bucket").applyInArrow(find(masks), "a long, b long").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within LINK_BITS of one another."""
    pairs = stored(meet(fps, fps.count(), block_variants(), verified_links), "links")
    crowd = stored(pairs.where("a = b").select(F.col("a").alias("fp")), "crowd")
    crowded = crowd.count()
    edges = pairs.where("a <> b")
    if crowded:
        edges = edges.unionByName(meet(crowd, crowded, ball_variants(), ball_links))
    return edges


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row.

    ``fingerprint`` is 16 hex digits.  ``component_id`` is the smallest key
    among the documents reachable over links of LINK_BITS or fewer differing
    bits, the row's own included.  A null or empty text has fingerprint zero
    and is linked like any other; null keys never become a component id, so a
    component of null keys alone has none.  Repeated rows give repeated rows.
    """
    marked = stored(fingerprints(docs, key, text), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc").alias("least")), "fingerprint-nodes")
    found = components(links(nodes.select("fp")))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(
        F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest key; rows without a key stay.

    Rows of one key with differing texts are documents of their own: each goes
    or stays with its own component, where equal keys go by a hash of the text.
    """
    place = F.when(F.col(f"`{key}`").isNotNull(), F.struct(F.col(f"`{key}`").alias("key"), F.xxhash64(raw(text)).alias("hash")))
    named = link_documents(docs.select(place.alias("place"), F.col(f"`{text}`").alias("text")), "place", "text")
    chosen = named.where(F.col("place") == F.col("component_id")).select("place.*").distinct()
    rows = docs.where(F.col(f"`{key}`").isNotNull()).withColumn("__hash", F.xxhash64(raw(text)))
    kept = rows.join(chosen, (rows[f"`{key}`"] == chosen["key"]) & (rows["__hash"] == chosen["hash"]), "left_semi").dropDuplicates([key, "__hash"])
    return kept.drop("__hash").unionByName(docs.where(F.col(f"`{key}`").isNull()))
