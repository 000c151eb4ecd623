"""Erasure from stored files: what is left, what is written anew, and what a failure leaves."""

import pytest

from pactframe.operators import quality
from pactframe.operators.quality import Reference
from pactframe.sources import files

REFERENCES = [Reference("contracts", "account_id", "accounts", "account_id"), Reference("points", "contract_id", "contracts"),
              Reference("audit", "point_id", "points")]


@pytest.fixture
def stored(frame, tmp_path):
    """root, schemas: 40 accounts of 3 contracts of 2 points of one audit row each."""
    tables = {
        "accounts": frame([(a, f"n{a}") for a in range(40)], "account_id long, name string"),
        "contracts": frame([(3 * a + c, a) for a in range(40) for c in range(3)], "id long, account_id long"),
        "points": frame([(2 * c + p, c, c % 7) for c in range(120) for p in range(2)] + [(999, None, 3)], "id long, contract_id long, verified_by long"),
        "audit": frame([(p, p % 5) for p in range(240)] + [(5000, 1), (None, 2)], "point_id long, user_id long"),
    }
    root = str(tmp_path / "tables")
    files.write_versioned(root, tables, {"accounts": "account_id", "contracts": "account_id", "points": "contract_id", "audit": "point_id"}, 8)
    return root, {n: rows.schema for n, rows in tables.items()}


def erase(frame, stored, accounts, users=(), **more):
    root, schemas = stored
    spark = frame([], "x int").sparkSession
    return quality.erase_in_files(spark, root, schemas, frame([(a,) for a in accounts], "account_id long"), REFERENCES,
                                  frame([(u,) for u in users], "id long"), {"points": ["verified_by"], "audit": ["user_id"]})


def contents(spark, stored):
    root, schemas = stored
    return {n: sorted(map(tuple, files.read_versioned(spark, root, n, s).collect()), key=repr) for n, s in schemas.items()}


def expected(before, accounts, users):
    contracts = {i for i, a in before["contracts"] if a in accounts}
    points = {i for i, c, _ in before["points"] if c in contracts}
    out = {
        "accounts": [r for r in before["accounts"] if r[0] not in accounts], "contracts": [r for r in before["contracts"] if r[0] not in contracts],
        "points": [(i, c, None if u in users else u) for i, c, u in before["points"] if i not in points],
        "audit": [(p, None if u in users else u) for p, u in before["audit"] if p not in points]}
    return {n: sorted(rows, key=repr) for n, rows in out.items()}


def test_erasure_cascades_and_writes_touched_files_only(frame, spark, stored):
    root, schemas = stored
    before, names = contents(spark, stored), {n: set(files.files_of(spark, root, n)) for n in schemas}
    report = erase(frame, stored, {5})
    assert contents(spark, stored) == expected(before, {5}, ())
    for n in schemas:
        now = set(files.files_of(spark, root, n))
        written, left = report[n]
        assert written >= 1 and left == len(names[n] & now) == len(names[n]) - written
    assert sum(left for _, left in report.values()) >= 8
    gone = {r.file for r in files.orphaned(spark, root).collect()}
    assert gone == set().union(*names.values()) - set().union(*(files.files_of(spark, root, n) for n in schemas))
    assert files.read_versioned(spark, root, "accounts", schemas["accounts"], 0).count() == 40


def test_users_are_blanked_and_a_second_run_changes_nothing(frame, spark, stored):
    before = contents(spark, stored)
    erase(frame, stored, {1, 2}, {3, 4})
    assert contents(spark, stored) == expected(before, {1, 2}, {3, 4})
    version = files.published(spark, stored[0])
    assert all(written == 0 for written, _ in erase(frame, stored, {1, 2}, {3, 4}).values())
    assert files.published(spark, stored[0]) == version == 1


def test_a_failure_leaves_the_version_before_and_can_be_repeated(frame, spark, stored, monkeypatch):
    before = contents(spark, stored)
    with monkeypatch.context() as m:
        real = files._publish
        m.setattr(files, "_publish", lambda spark, root, version, fs: real(spark, root, version, {}) if version == 0 else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            erase(frame, stored, {0, 7})
    assert contents(spark, stored) == before
    erase(frame, stored, {0, 7, 8})
    assert contents(spark, stored) == expected(before, {0, 7, 8}, ())


def test_everything_can_go(frame, spark, stored):
    erase(frame, stored, range(40))
    left = contents(spark, stored)
    assert left["accounts"] == left["contracts"] == [] and left["points"] == [(999, None, 3)]
    assert left["audit"] == [(5000, 1), (None, 2)]


def test_many_ids_and_many_marks_give_the_same_rows(frame, spark, stored, monkeypatch):
    before = contents(spark, stored)
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    monkeypatch.setattr(files, "RUNS_AT_ONCE", 2)
    written = []
    real = files.marked_rows

    def seen(*args):
        for some, rows in real(*args):
            written.append(rows._jdf.queryExecution().executedPlan().toString())
            yield some, rows

    monkeypatch.setattr(files, "marked_rows", seen)
    report = erase(frame, stored, {1, 2, 5, 30, 31}, {3, 4})
    assert contents(spark, stored) == expected(before, {1, 2, 5, 30, 31}, {3, 4})
    assert len(written) > 4 and sum(n for n, _ in report.values()) > 8
    # what is written comes as it was read
    assert not any("Exchange" in plan.replace("BroadcastExchange", "") for plan in written)


def test_rows_of_two_columns_are_shuffled_after_most_went_by_the_bits(frame, spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    gone = quality._Gone(frame([(f"k{n}",) for n in range(50)] * 2, "id string"), "gone")
    rows = frame([(f"k{n % 900}", n) for n in range(2_000)] + [(None, 1)], f"key string, {files.PLACE} long")
    found = gone.found(rows, "key")
    assert sorted(r[files.PLACE] for r in found.collect()) == [n for n in range(2_000) if n % 900 < 50]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [line for line in plan if "Join " in line]
    assert "LeftSemi" in joins[0] and "Inner" in joins[1] and len(joins) == 2
    # ids of another type are compared as before
    numbers = frame([(n, n) for n in range(60)], f"key int, {files.PLACE} long")
    wide = quality._Gone(frame([(3,), (70,), (None,)], "id long"), "gone")
    assert [r.key for r in wide.found(numbers, "key").collect()] == [3]


def test_odd_keys(frame, spark, tmp_path, monkeypatch):
    tables = {
        "accounts": frame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "id long, name string"),
        "contracts": frame([("x", 1), ("x", 2), (None, 1), ("y", None), ("z", 2)], "id string, account_id long"),
        "points": frame([(1, "x", 9), (1, "z", None), (2, None, 9), (3, "y", 8), (3, "x", 8)], "id long, contract_id string, verified_by long"),
        "audit": frame([(1, 9), (None, 9), (2, 8), (2, None)], "point_id long, user_id long"),
        "other": frame([(1,), (2,)], "n int"),
    }
    for n, many in enumerate((500_000, 0)):
        monkeypatch.setattr(quality, "BROADCAST_IDS", many)
        root = str(tmp_path / str(n))
        files.write_versioned(root, tables)
        stored = root, {name: rows.schema for name, rows in tables.items()}
        report = erase(frame, stored, [1, 1, None], [9, None])
        left = contents(spark, stored)
        assert left["accounts"] == [(2, "d"), (None, "c")] and left["contracts"] == [("x", 2), ("y", None), ("z", 2)]
        assert left["points"] == [(1, "z", None), (2, None, None), (3, "y", 8)]
        assert left["audit"] == [(2, 8), (2, None), (None, None)]
        assert list(report) == list(tables) and report["other"][0] == 0 and left["other"] == [(1,), (2,)]


def test_stored_values_come_back_and_are_packed(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(3_000).selectExpr(
        "id", "concat('p', id, '-x') as name", "cast(id as decimal(30,3)) as wide", "cast(id / 7 as decimal(12,2)) as price", "id % 3 = 0 as flag",
        "if(id % 5 = 0, null, cast(id as int)) as n", "id / 3 as part", "cast(cast(id as string) as binary) as raw", "timestamp_micros(id * 1000001) as at",
        "date_add(date '2024-01-01', cast(id as int)) as day", "array(id, null) as list", "struct(id as a, cast(id as string) as b) as pair")
    root = str(tmp_path / "t")
    files.write_versioned(root, {"t": rows})
    assert sorted(files.read_versioned(spark, root, "t", rows.schema).collect()) == sorted(rows.collect())
    names = files.files_of(spark, root, "t")
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0) for f in names]
    assert {c.compression for c in found} == {"ZSTD"} and names


def test_no_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.published(spark, str(tmp_path))
