"""Tables as sets of Parquet files that are changed by writing the touched files anew.

    <root>/<table>/version=N/   files that version N added
    <root>/manifest/            (version, table, file): the files of every table, per published version
    <root>/published/           (version): versions whose manifest is complete

A change marks the rows to change by their place in the files, from the columns
that tell them alone, writes what is left of the files that hold one, and publishes a version whose manifest names the new files and the
untouched old ones.  Until it is published, readers see the version before; a
change that failed on the way is repeated by running it again.  Old files stay
for readers of old versions; ``orphaned`` lists those to remove.  One writer at
a time is assumed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pactframe.functions.bits import RUN_BITS, holds, run_of

FILE, PLACE = "_file", "_place"
ERASED = "_erased"

# Bits of a place for the row in its file.
ROW_BITS = 40

# Rows of marks, of 4 kB each, that are broadcast at once.
RUNS_AT_ONCE = 4_096

# Stored tables are kept twice while they change, so ids that follow each other are stored as differences, and packed.
CODING = {"compression": "zstd", "parquet.writer.version": "v2"}
MANIFEST = "version long, table string, file string"


def published(spark: SparkSession, root: str) -> int:
    """The latest version that is complete."""
    try:
        found = spark.read.schema("version long").parquet(f"{root}/published").agg(F.max("version")).first()[0]
    except AnalysisException as missing:
        raise FileNotFoundError(f"no tables in {root}") from missing
    return found


def files_of(spark: SparkSession, root: str, table: str, version: int | None = None) -> list[str]:
    version = published(spark, root) if version is None else version
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where((F.col("version") == version) & (F.col("table") == table))
    return sorted(r["file"] for r in rows.select("file").toLocalIterator())


def read_files(spark: SparkSession, files: list[str], schema: StructType) -> DataFrame:
    """The rows of some files with ``_file``, the file each stands in."""
    if not files:
        return spark.createDataFrame([], schema).withColumn(FILE, F.lit(None).cast("string"))
    return spark.read.schema(schema).parquet(*files).withColumn(FILE, F.col("_metadata.file_path"))


def read_versioned(spark: SparkSession, root: str, table: str, schema: StructType, version: int | None = None) -> DataFrame:
    """A table as of a version, the latest without one."""
    return read_files(spark, files_of(spark, root, table, version), schema).drop(FILE)


def _added(spark: SparkSession, folder: str, schema: StructType) -> list[str]:
    """Files that a version wrote; empty ones, which only carry a schema, are left out."""
    try:
        rows = spark.read.schema(schema).parquet(folder)
    except AnalysisException:
        return []
    return sorted(r[0] for r in rows.select(F.col("_metadata.file_path")).distinct().collect())


def _publish(spark: SparkSession, root: str, version: int, files: dict[str, list[str]]) -> None:
    rows = [(version, table, file) for table, fs in files.items() for file in fs]
    # a failed attempt may have left rows of this version behind in a folder of its own
    folder = f"{root}/manifest/attempt={version}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(folder)
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/published")


def write_versioned(root: str, tables: dict[str, DataFrame], by: dict[str, str] | None = None, parts: int | None = None) -> None:
    """Store tables as version 0; those named in ``by`` ordered by a column, so that rows that go together share files.

    Without ``parts``, the number of files of such a table, it follows from its size.
    """
    spark, files = None, {}
    for name, rows in tables.items():
        spark, folder = rows.sparkSession, f"{root}/{name}/version=0"
        if by and name in by:
            ranged = rows.repartitionByRange(by[name]) if parts is None else rows.repartitionByRange(parts, by[name])
            rows = ranged.sortWithinPartitions(by[name])
        rows.write.mode("overwrite").options(**CODING).parquet(folder)
        files[name] = _added(spark, folder, rows.schema)
    _publish(spark, root, 0, files)


def read_places(spark: SparkSession, numbers: dict[str, int], schema: StructType) -> DataFrame:
    """The rows of some files, each with a number, and ``_place``: the number of the file and the row in it as one number."""
    numbered = F.broadcast(spark.createDataFrame([(f, n << ROW_BITS) for f, n in numbers.items()], f"{FILE} string, _base long"))
    rows = spark.read.schema(schema).parquet(*numbers).select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias("_row"))
    base = F.coalesce("_base", F.raise_error(F.concat(F.lit("no number for "), F.col(FILE))).cast("long"))
    return rows.join(numbered, FILE, "left").select(*schema.names, (base + F.col("_row")).alias(PLACE))


def numbered_files(spark: SparkSession, root: str, table: str, version: int) -> dict[str, int]:
    return {f: n for n, f in enumerate(files_of(spark, root, table, version))}


def _groups(marks: DataFrame) -> list[list[int]]:
    """The numbers of the files that hold a mark, in groups whose marks are few enough to be broadcast."""
    file = F.shiftright("_run", ROW_BITS - RUN_BITS)
    groups, held = [], 0
    # collected, as a local iterator runs a job for each partition
    for r in sorted(marks.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if not groups or held + r["n"] > RUNS_AT_ONCE:
            groups.append([])
            held = 0
        groups[-1].append(r["file"])
        held += r["n"]
    return groups


def marked_rows(spark: SparkSession, numbers: dict[str, int], schema: StructType, marks: DataFrame, kinds: list[str]) -> Iterator[tuple[list[str], DataFrame]]:
    """Files that hold a mark, in groups, and their rows with a boolean ``_is_<kind>`` for each kind of mark.

    The marks of one group are broadcast, and no row is shuffled.
    """
    names = {n: f for f, n in numbers.items()}
    for group in _groups(marks):
        files = {names[n]: n for n in group}
        part = marks.where(F.col("_run").between(group[0] << (ROW_BITS - RUN_BITS), ((group[-1] + 1) << (ROW_BITS - RUN_BITS)) - 1))
        rows = read_places(spark, files, schema).withColumn("_run", run_of(PLACE))
        for kind in kinds:
            words = part.where(F.col("kind") == kind).select("_run", F.col("_words").alias(f"_words_{kind}"))
            rows = rows.join(F.broadcast(words), "_run", "left")
        yield sorted(files), rows.select(*schema.names, *[holds(f"`_words_{kind}`", PLACE).alias(f"_is_{kind}") for kind in kinds])


def rewrite(spark: SparkSession, root: str, schemas: dict[str, StructType], marks: dict[str, DataFrame], blanks: dict[str, list[str]]) -> dict[str, tuple[int, int]]:
    """Write what is left of the marked files and publish it; (files written anew, files left) per table.

    ``marks`` are rows (kind, _run, _words) of bits of the places of a table,
    where the files are numbered as ``numbered_files`` does.  Rows marked as
    ``ERASED`` go; the kinds named in ``blanks`` are columns, NULL where marked.
    """
    version = published(spark, root)
    files, report = {}, {}
    for name, schema in schemas.items():
        numbers = numbered_files(spark, root, name, version)
        folder, touched, columns = f"{root}/{name}/version={version + 1}", set(), blanks.get(name, [])
        for some, rows in marked_rows(spark, numbers, schema, marks[name], [ERASED, *columns]):
            values = [F.when(~F.col(f"_is_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in schema.names]
            rest = rows.where(~F.col(f"_is_{ERASED}")).select(*values)
            rest.write.mode("append" if touched else "overwrite").options(**CODING).parquet(folder)
            touched.update(some)
        files[name] = [f for f in numbers if f not in touched] + (_added(spark, folder, schema) if touched else [])
        report[name] = len(touched), len(numbers) - len(touched)
    if any(n for n, _ in report.values()):
        _publish(spark, root, version + 1, files)
    return report


def orphaned(spark: SparkSession, root: str) -> DataFrame:
    """(file): files of published versions that the latest one no longer names, which hold the erased rows."""
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    done = spark.read.schema("version long").parquet(f"{root}/published")
    known = rows.join(done, "version", "left_semi")
    return known.select("file").distinct().join(known.where(F.col("version") == published(spark, root)).select("file"), "file", "left_anti")
