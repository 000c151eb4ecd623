"""Run registered queries next to their checking SQL and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int",
    "double": "double", "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "date": "date",
    "timestamp_ntz": "time", "timestamp": "time",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def row_keys(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both sides give the same columns, types and rows."""
    found = []
    described = con.execute(f"describe {sql}").fetchall()
    oracle_types = {r[0]: r[1].lower() for r in described}
    spark_types = dict(df.dtypes)
    if set(oracle_types) != set(spark_types):
        return [f"columns {sorted(spark_types)} vs {sorted(oracle_types)}"]
    for name in sorted(spark_types):
        a, b = KINDS.get(spark_types[name], spark_types[name]), KINDS.get(oracle_types[name], oracle_types[name])
        if a != b:
            found.append(f"type of {name}: {spark_types[name]} vs {oracle_types[name]}")
    ours = row_keys(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs = row_keys([d[0] for d in cursor.description], cursor.fetchall())
    if ours != theirs:
        only_ours = sorted(set(ours) - set(theirs))[:3]
        only_theirs = sorted(set(theirs) - set(ours))[:3]
        found.append(f"{len(ours)} vs {len(theirs)} rows; ours only {only_ours}; theirs only {only_theirs}")
    elif not ours:
        found.append("both sides are empty")
    return found


def main() -> None:
    """Usage: compare.py folder [key ...]"""
    import __spark_entry__ as entry
    from pactframe.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in queries:
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = queries[key](spark, folder)
            if key in oracles:
                found = differences(df, con, oracles[key])
                state = "ok" if not found else "DIFF"
            else:
                found, state = [], f"rows-only {df.count()}"
        except Exception as error:
            found, state = [str(error)[:1500]], "ERROR"
        bad += bool(found)
        print(f"{key:32s} {state:14s} {time.time() - start:6.2f}s", *found, sep="\n      " if found else " ", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
