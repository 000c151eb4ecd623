"""Constraint checks, consent checks and erasure over whole tables."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType, StringType, StructType

from pactframe.functions.bits import bit_rows, key_bits, may_match, run_of
from pactframe.operators.asof import asof_join
from pactframe.operators.tenancy import by_account, in_scope
from pactframe.session import new_folder
from pactframe.sources.files import CODING, ERASED, PLACE, marked_rows, numbered_files, published, read_places, rewrite
from pactframe.sources.tables import no_rows, stored

# Ids that are broadcast to the rows that may name them.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Reference:
    """child.column must name an existing parent.key; NULL refers to nothing."""

    child: str
    column: str
    parent: str
    key: str = "id"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fk_orphans(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """Rows per reference whose target does not exist.

    Each table is read once and gives its keys, as parent and as child, as rows
    (target, key as text, slot), where the slot numbers the references to one
    target and -1 is the target itself.  Slots are counted per key before the
    only shuffle of keys, so one that fills a third of a table arrives as one
    row per map task, and no list of a key's rows is ever built.
    """
    targets = sorted({(r.parent, r.key) for r in references})
    asking = {t: [r for r in references if (r.parent, r.key) == t] for t in targets}
    place = {r: (n, i) for n, t in enumerate(targets) for i, r in enumerate(asking[t])}
    rows = []
    for name, df in tables.items():
        keys = [(n, key, -1) for n, (parent, key) in enumerate(targets) if parent == name]
        keys += [(n, r.column, i) for r, (n, i) in place.items() if r.child == name]
        if keys:
            each = F.array(*[F.struct(F.lit(n).alias("target"), F.col(c).cast("string").alias("key"), F.lit(i).alias("slot")) for n, c, i in keys])
            rows.append(df.select(F.inline(each)).filter(F.col("key").isNotNull()))
    slots = range(max(map(len, asking.values())))
    by_key = _union(rows).groupBy("target", "key").agg(
        F.bool_or(F.col("slot") == -1).alias("known"), *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in slots])
    missing = by_key.filter(~F.col("known")).groupBy("target").agg(
        *[F.count_if(F.col(f"n{i}") > 0).alias(f"keys{i}") for i in slots], *[F.sum(f"n{i}").alias(f"rows{i}") for i in slots])
    each = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"keys{i}").alias("orphan_keys"), F.col(f"rows{i}").alias("orphan_rows")) for i in slots])
    named = F.array(*[
        F.struct(F.lit(f"{r.child}.{r.column}").alias("reference"), F.lit(r.parent).alias("parent"), F.lit(n).alias("target"), F.lit(i).alias("slot"))
        for r, (n, i) in place.items()])
    listed = rows[0].sparkSession.range(1).select(F.inline(named))
    found = listed.join(missing.select("target", F.inline(each)), ["target", "slot"], "left")
    return found.select("reference", "parent", "orphan_keys", "orphan_rows").fillna(0, ["orphan_keys", "orphan_rows"])


@dataclass(frozen=True)
class Unique:
    """A declared unique key; rows with a NULL key column never collide."""

    table: str
    columns: tuple[str, ...]
    only: str = "true"


def unique_violations(tables: dict[str, DataFrame], keys: list[Unique]) -> DataFrame:
    """Per declared key: how many key values repeat, and how many rows they hold."""
    reports = []
    for key in keys:
        complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in key.columns])
        repeated = (
            tables[key.table].filter(complete & F.expr(key.only))
            .groupBy(*key.columns).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        )
        reports.append(
            repeated.agg(
                F.count(F.lit(1)).alias("repeated_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_in_them")
            ).select(
                F.lit(key.table).alias("table_name"),
                F.lit(",".join(key.columns)).alias("key_columns"),
                "repeated_keys",
                "rows_in_them",
            )
        )
    return _union(reports)


@dataclass(frozen=True)
class Check:
    """A rule each row must pass; NULL passes, as in a table constraint."""

    table: str
    rule: str
    passes: str


def check_violations(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """Rows checked and rows failing per rule; each table is scanned once."""
    reports = []
    for name in dict.fromkeys(c.table for c in checks):
        rules = [c for c in checks if c.table == name]
        counts = [F.count_if(~F.expr(r.passes)).alias(f"r{i}") for i, r in enumerate(rules)]
        one = tables[name].agg(F.count(F.lit(1)).alias("total"), *counts)
        pairs = F.array(
            *[F.struct(F.lit(r.rule).alias("rule"), F.col(f"r{i}").alias("failing")) for i, r in enumerate(rules)]
        )
        reports.append(one.select(F.lit(name).alias("table_name"), "total", F.inline(pairs)))
    return _union(reports).select("table_name", "rule", "total", "failing")


def one_of(column: str, values: list[str]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


# ---- consent -------------------------------------------------------------


def transcripts_without_consent(documents: DataFrame, consents: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Transcripts with no consent id, or with one that is not on file."""
    transcripts = in_scope(documents, scope).filter(F.col("is_transcript"))
    on_file = consents.select(F.col("id").alias("consent_id"))
    return transcripts.join(on_file, "consent_id", "left_anti").select(
        *documents.columns, F.when(F.col("consent_id").isNull(), "missing").otherwise("unknown").alias("problem")
    )


def consent_asof(documents: DataFrame, consents: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Transcripts with the newest consent of their account not later than the upload.

    ``documents`` needs account_id and created_at; both consent columns are NULL
    where none had been given yet.
    """
    transcripts = in_scope(documents, scope).filter(F.col("is_transcript"))
    given = consents.select("account_id", "accepted_at", F.col("id").alias("consent_in_force"), F.col("version").alias("consent_version"))
    return asof_join(
        transcripts, given, ["account_id"], "created_at", "accepted_at", ["consent_in_force", "consent_version"]
    )


# ---- erasure -------------------------------------------------------------


def _marked(rows: DataFrame, name: str, gone: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """The rows of a table with ``erased``, from the ids that go from the tables they refer to."""
    if name == "accounts":
        own = gone["accounts"].select(F.col("_gone").alias("account_id"), F.lit(True).alias("_hit"))
        return by_account(rows).join(own, "account_id", "left").withColumn("erased", F.col("_hit").isNotNull()).drop("_hit")
    columns, hits = rows.columns, []
    for n, ref in enumerate(r for r in references if r.child == name):
        named = gone[ref.parent].select(F.col("_gone").alias(ref.column), F.lit(True).alias(f"_hit{n}"))
        rows = rows.join(named, ref.column, "left")
        hits.append(F.col(f"_hit{n}").isNotNull())
    return rows.select(*columns, reduce(Column.__or__, hits, F.lit(False)).alias("erased"))


def _mark_all(tables: dict[str, DataFrame], accounts_gone: DataFrame, references: list[Reference]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The marked tables, and the stored ids (_gone) that go from each table that others refer to."""
    parents = {r.parent for r in references}
    gone = {"accounts": stored(accounts_gone.select(F.col(accounts_gone.columns[0]).alias("_gone")).distinct(), "gone-accounts")}
    marked = {"accounts": _marked(tables["accounts"], "accounts", gone, references)}
    for child in dict.fromkeys(r.child for r in references):
        rows = marked[child] = _marked(tables[child], child, gone, references)
        if child in parents and "id" in rows.columns:
            gone[child] = stored(rows.filter("erased").select(F.col("id").alias("_gone")).distinct(), f"gone-{child}")
    return marked, gone


def erasure_marks(tables: dict[str, DataFrame], accounts_gone: DataFrame, references: list[Reference]) -> dict[str, DataFrame]:
    """The tables with a column ``erased``: whether the row goes when accounts and all that depends on them go.

    ``references`` lists the cascading references, parents first.  A row goes
    when the row it refers to goes, through as many steps as there are.  The ids
    that go from a table that others refer to are written to the shared folder
    once; each table is then read in one pass.
    """
    return _mark_all(tables, accounts_gone, references)[0]


def erase_in_files(
    spark: SparkSession, root: str, schemas: dict[str, StructType], accounts_gone: DataFrame, references: list[Reference],
    users_gone: DataFrame | None = None, user_columns: dict[str, list[str]] | None = None,
) -> dict[str, tuple[int, int]]:
    """Erase accounts and all that depends on them from stored tables, and blank references to erased users.

    The tables are those of ``sources.files`` under ``root``.  Only files that
    hold a row to erase or to blank are written anew; per table, how many those
    were and how many were left.  Done twice, the second time changes nothing.

    Rows to change are found from the columns that name an id, and marked by a
    bit at their place in the files; whole rows are read once, to be written,
    and never shuffled, however many ids go.
    """
    version = published(spark, root)
    numbers = {name: numbered_files(spark, root, name, version) for name in schemas}
    blanks = {name: columns for name, columns in (user_columns or {}).items() if name in schemas} if users_gone is not None else {}
    gone = {"accounts": _Gone(accounts_gone, "gone-accounts")}
    users = None if users_gone is None else _Gone(users_gone, "gone-users")
    parents, marks = {r.parent for r in references}, {}
    for name in dict.fromkeys(["accounts", *[r.child for r in references], *schemas]):
        names = schemas[name].names
        if name == "accounts":
            asked = [(ERASED, "account_id" if "account_id" in names else "id", gone["accounts"])]
        else:
            asked = [(ERASED, r.column, gone[r.parent]) for r in references if r.child == name]
        asked += [(column, column, users) for column in blanks.get(name, [])]
        marks[name] = _marks(spark, numbers[name], schemas[name], asked, name)
        if name in parents and name != "accounts" and "id" in names:
            keys = StructType([schemas[name]["id"]])
            folder, ids = new_folder(spark, f"gone-{name}"), no_rows(spark, keys)
            for _, rows in marked_rows(spark, numbers[name], keys, marks[name].where(F.col("kind") == ERASED), [ERASED]):
                rows.where(f"_is_{ERASED}").select("id").write.mode("append").options(**CODING).parquet(folder)
                ids = spark.read.schema(keys).parquet(folder)
            gone[name] = _Gone(ids)
    return rewrite(spark, root, schemas, marks, blanks)


class _Gone:
    """Ids that go: a column, how many, and the bits of their hashes once these are needed."""

    def __init__(self, ids: DataFrame, name: str | None = None):
        ids = ids.select(F.col(ids.columns[0]).alias("_gone"))
        self.ids = stored(ids.distinct(), name) if name else ids
        self.count = self.ids.count()

    @functools.cached_property
    def bits(self) -> tuple[DataFrame, int]:
        bits, mask = key_bits(self.ids, self.count)
        return stored(bits, "gone-bits"), mask

    def found(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows that name one of the ids; of many ids only rows of two columns are shuffled, after most others went by the bits."""
        same = F.col(column) == F.col("_gone")
        if self.count <= BROADCAST_IDS:
            return rows.join(F.broadcast(self.ids), same, "left_semi")
        kind = rows.schema[column].dataType
        if kind == self.ids.schema["_gone"].dataType and isinstance(kind, (StringType, IntegralType)):
            # the planner would move the join in front of the bits; it leaves a projection that is not deterministic where it is
            rows = may_match(rows, [F.col(column)], *self.bits).withColumn(PLACE, F.col(PLACE) + F.spark_partition_id() * 0)
        return rows.join(self.ids.hint("merge"), same, "left_semi")


def _marks(spark: SparkSession, numbers: dict[str, int], schema: StructType, asked: list[tuple[str, str, _Gone]], name: str) -> DataFrame:
    """The places of the rows that name an id, as rows of bits per kind of mark."""
    hits = []
    for kind, column, gone in asked if numbers else []:
        rows = read_places(spark, numbers, StructType([schema[column]]))
        found = gone.found(rows, column).select(F.lit(kind).alias("kind"), PLACE)
        # scattered by the join, so that bits gathered before the next shuffle would be few in each row
        hits.append(found if gone.count <= BROADCAST_IDS else found.repartition(run_of(PLACE)))
    if not hits:
        return no_rows(spark, StructType.fromDDL("kind string, _run long, _words array<long>"))
    return stored(bit_rows(_union(hits), PLACE, "kind"), f"marks-{name}")


def erase_accounts(tables: dict[str, DataFrame], accounts_gone: DataFrame, references: list[Reference]) -> dict[str, DataFrame]:
    """Tables left after accounts and everything that depends on them are erased."""
    marked = erasure_marks(tables, accounts_gone, references)
    left = {name: rows.filter(~F.col("erased")).drop("erased") for name, rows in marked.items()}
    return tables | left


def unlink_users(rows: DataFrame, users_gone: DataFrame, columns: list[str]) -> DataFrame:
    """Blanks references to erased users in the given columns; the rows stay."""
    gone = users_gone.select(F.col(users_gone.columns[0]).alias("_user")).distinct()
    out = rows
    for n, column in enumerate(columns):
        named = gone.select(F.col("_user").alias(column), F.lit(True).alias(f"_gone{n}"))
        out = out.join(named, column, "left")
    blanked = {c: F.when(F.col(f"_gone{n}").isNull(), F.col(c)).alias(c) for n, c in enumerate(columns)}
    return out.select(*[blanked.get(c, F.col(c)) for c in rows.columns])
