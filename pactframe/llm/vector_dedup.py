"""Near-duplicate vectors by sorted projection passes.

Each pass puts the different vectors of a label in the order of some random
hashes, one after the other, and compares each with the ``WINDOW`` vectors
before it.  Pairs above the threshold are verified links, of which a pass keeps
a spanning forest; the forests of all passes are united into components.  What
a pass misses, another with its own hashes finds.

A hash is the axis, with its sign, along which a random rotation of the vector
is longest: vectors at a cosine of 0.93 share it far more often than signs of
single projections of the same information.

Links are counted inside components, in blocks of bounded size, so counts are
whole where a window is too small for a crowd of near copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from pactframe.llm.common import extended, without
from pactframe.llm.components import components
from pactframe.sources.tables import stored

THRESHOLD = 0.93
PASSES = 12
WINDOW = 48
HASHES = 5  # concatenated in one sort key
AXES = 64  # of a random rotation; 2 * AXES values of a hash
BLOCK = 4096  # vectors of a component compared in one group
STEP = 512  # rows of one matrix product


def digested(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """The rows with ``__vec``, the vector as bytes, or null where it links with nothing."""
    kept = [c for c in rows.columns if c != "__in"]

    def raw(v):
        if not v or None in v:
            return None
        x = np.array(v, kind) + kind.type(0)  # no negative zeros
        return x.tobytes() if x.any() and np.isfinite(x).all() else None

    def run(batches):
        for batch in batches:
            made = list(map(raw, batch.column(len(kept)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in range(len(kept))), pa.array(made, pa.binary())], names=[*kept, "__vec"])

    return rows.select(*kept, "__in").mapInArrow(run, extended(rows.select(*kept), __vec="binary"))


def unit(pieces: list[bytes], kind: np.dtype) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in doubles; first by their largest part, so that no square overflows."""
    x = np.frombuffer(b"".join(pieces), kind).reshape(len(pieces), -1).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def keyed(classes: DataFrame, number: int, form: np.dtype) -> DataFrame:
    """The classes with ``key``, the sort key of a pass: its hashes as digits of one number."""
    def rotation(dims):
        return np.random.default_rng([number, dims]).standard_normal((dims, HASHES * AXES))

    def run(batches):
        rotations = {}
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("vec")).to_pylist()
            dims = np.array([len(v) // form.itemsize for v in raw])
            keys = np.zeros(len(raw), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in rotations:
                    rotations[d] = rotation(int(d))
                for begin in range(0, len(at), STEP):
                    some = at[begin : begin + STEP]
                    turned = (unit([raw[i] for i in some], form) @ rotations[d]).reshape(len(some), HASHES, AXES)
                    axis = np.abs(turned).argmax(2)
                    sign = np.take_along_axis(turned, axis[:, :, None], 2)[:, :, 0] < 0
                    digits = 2 * axis + sign
                    for h in range(HASHES):
                        keys[some] = keys[some] * 2 * AXES + digits[:, h]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "key"])

    return classes.mapInArrow(run, extended(classes, key="long"))


class Forest:
    """Union of linked places; its edges span what the links join."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)

    def edges(self):
        return [(i, r) for i in range(len(self.up)) if (r := self.root(i)) != i]


def window_edges(group: list, raw: list[bytes], fresh: int, form: np.dtype) -> list[tuple[int, int]]:
    """Spanning edges of the links between rows less than WINDOW + 1 places apart, in sorted order.

    Rows of differing ``group`` (label and length) are not compared, nor pairs
    of which both stand before ``fresh``.
    """
    forest = Forest(len(group))
    begin = 0
    while begin < len(group):
        end = begin
        while end < len(group) and group[end] == group[begin]:
            end += 1
        x = unit(raw[begin:end], form)
        for at in range(0, end - begin, STEP):
            rows = x[at : at + STEP]
            near = rows @ x[at : at + STEP + WINDOW].T >= THRESHOLD
            i, j = np.nonzero(near)
            good = (j > i) & (j - i <= WINDOW) & (begin + at + j >= fresh)
            for a, b in zip((begin + at + i[good]).tolist(), (begin + at + j[good]).tolist()):
                forest.join(a, b)
        begin = end
    return forest.edges()


EDGE = "a string, b string"


def pass_edges(classes: DataFrame, number: int, form: np.dtype) -> DataFrame:
    """(a, b): a spanning forest of the links one pass finds.

    Tasks compare their part of the order as a stream.  For the seams between
    parts they hand on their first and last WINDOW rows with their place in the
    part; places in the whole order follow from the parts' sizes, so a seam
    compares the pairs that one long stream would, even if parts are tiny.
    """
    spark = classes.sparkSession
    order = ["label", "dims", "key", "class"]
    sorted_rows = keyed(classes, number, form).repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "vec")

    def run(batches):
        part, place, before = TaskContext.get().partitionId(), 0, []
        names = ["a", "b", "part", "place", "label", "dims", "class", "vec"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary()]

        def put(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

        for batch in batches:
            new = list(zip(*(c.to_pylist() for c in batch.columns)))
            rows = before + [(place + n, r) for n, r in enumerate(new)]
            links = window_edges([(r[0], r[1]) for _, r in rows], [r[4] for _, r in rows], len(before), form)
            out = [(rows[i][1][3], rows[j][1][3], None, None, None, None, None, None) for i, j in links]
            out += [(None, None, part, at, r[0], r[1], r[3], r[4]) for at, r in rows[len(before):] if at < WINDOW]
            yield put(out)
            place += len(new)
            before = rows[-WINDOW:]
        yield put([(None, None, part, at, r[0], r[1], r[3], r[4]) for at, r in before if at >= WINDOW])
        # a part's size, as the place after its last row
        yield put([(None, None, part, place, None, None, None, None)])

    found = stored(sorted_rows.mapInArrow(run, EDGE + ", part int, place long, label string, dims int, class string, vec binary"), "pass")
    sizes = sorted((r["part"], r["place"]) for r in found.where("part is not null and class is null").select("part", "place").toLocalIterator())
    starts = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist()))
    seams = np.unique([starts[p] for p, n in sizes if n])[1:]
    edges = found.where("a is not null").select("a", "b")
    if not len(seams):
        return edges

    def near_seams(batches):
        for batch in batches:
            part, place, *rest = batch.columns
            at = np.array([starts[p] for p in part.to_pylist()], np.int64) + place.to_numpy()
            lo, hi = np.searchsorted(seams, at - WINDOW, "right"), np.searchsorted(seams, at + WINDOW, "right")
            take = np.repeat(np.arange(len(at)), hi - lo)
            seam = np.concatenate([np.zeros(0, np.int64), *(seams[a:b] for a, b in zip(lo, hi))])
            yield pa.RecordBatch.from_arrays([pa.array(seam), pa.array(at[take]), *(c.take(pa.array(take)) for c in rest)],
                                             names=["seam", "at", "label", "dims", "class", "vec"])

    ends = found.where("class is not null").select("part", "place", "label", "dims", "class", "vec").mapInArrow(
        near_seams, "seam long, at long, label string, dims int, class string, vec binary")

    def across(group: pa.Table) -> pa.Table:
        rows = group.sort_by("at")
        seam, at = rows["seam"][0].as_py(), rows["at"].to_numpy()
        fresh = int(np.searchsorted(at, seam))
        names = rows["class"].to_pylist()
        links = window_edges(list(zip(rows["label"].to_pylist(), rows["dims"].to_pylist())), rows["vec"].to_pylist(), fresh, form)
        return pa.table({"a": pa.array([names[i] for i, _ in links], pa.string()), "b": pa.array([names[j] for _, j in links], pa.string())})

    return edges.unionByName(ends.groupBy("seam").applyInArrow(across, EDGE))


def link_counts(members: DataFrame, form: np.dtype) -> DataFrame:
    """(class, links): vectors of other classes of the component that a class links with.

    ``members`` has root, class, n (copies) and vec.  A component larger than
    BLOCK is cut into blocks by hash, and every two blocks meet in one group.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocked = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    met = blocked.select("*", other.alias("other")).select(
        "root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "class", "n", "vec")

    def count(group: pa.Table) -> pa.Table:
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        block = np.array(group["block"].to_pylist())
        x, n = unit(group["vec"].to_pylist(), form), group["n"].to_numpy()
        links = np.zeros(len(n), np.int64)
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        for at in range(0, len(left), STEP):
            rows = left[at : at + STEP]
            near = x[rows] @ x[right].T >= THRESHOLD
            if p == q:
                near[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
                links[rows] += near @ n[right]
            else:
                links[rows] += near @ n[right]
                links[right] += n[rows] @ near
        return pa.table({"class": group["class"], "links": pa.array(links)})

    return met.groupBy("root", "p", "q").applyInArrow(count, "class string, links long").groupBy("class").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The rows without the vector, with n_links, component_id and kept.

    Vectors of equal, not null labels and equal length link at a cosine of at
    least THRESHOLD.  A vector that is null, empty, zero or holds a null or
    non-finite part links with nothing.  ``component_id`` is the smallest key
    reachable, and the row is ``kept`` if that is its own.  Each row is a vector
    of its own, also where keys repeat: equal rows link.  A row without links
    has its own key as component; one with a null key is kept unless linked.
    Columns of the names added are replaced; others are passed on.

    Equal vectors of one label are one class with a count, before any pass.
    """
    kept = [c for c in without(rows, "n_links", "component_id", "kept").columns if c != vector]
    named = rows.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(kept)], F.col(f"`{label}`").cast("string").alias("__label"),
                        F.col(f"`{key}`").alias("__key"), F.col(f"`{vector}`").alias("__in"))
    usable = F.col("__vec").isNotNull() & F.col("__label").isNotNull()
    form = np.dtype(np.float32 if rows.schema[vector].dataType.elementType == T.FloatType() else np.float64)
    name = F.sha2(F.concat(F.col("__label").cast("binary"), F.lit("\n").cast("binary"), "__vec"), 256)
    all_rows = stored(digested(named, form).withColumn("class", F.when(usable, name)), "vectors")
    classes = stored(all_rows.where("class is not null").groupBy("class").agg(
        F.count("*").alias("n"), F.min("__key").alias("key0"), F.first("__label").alias("label"), F.first("__vec").alias("vec")).withColumn(
        "dims", (F.length("vec") / form.itemsize).cast("int")), "classes")

    edges = None
    for number in range(PASSES):
        found = pass_edges(classes.select("label", "dims", "class", "vec"), number, form)
        edges = found if edges is None else edges.unionByName(found)
    # one writing of the edges; each pass gives no more than one a vector
    roots = components(edges.distinct()).withColumnRenamed("node", "class")
    members = stored(classes.select("class", "n", "key0", "vec").join(roots, "class"), "members")
    least = members.groupBy("root").agg(F.min("key0").alias("least"))
    joined = members.select("class", "root").join(least, "root").join(link_counts(members.select("root", "class", "n", "vec"), form), "class")
    by_class = classes.select("class", "n", "key0").join(joined, "class", "left").select(
        "class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "key0").alias("component_id"))
    by_class = stored(by_class, "by_class")
    out = all_rows.drop("__vec").join(by_class, "class", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))).withColumn(
        "component_id", F.coalesce("component_id", "__key"))
    return out.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(kept)], "n_links", "component_id",
                      F.col("__key").eqNullSafe(F.col("component_id")).alias("kept"))
