"""Every query with SQL against DuckDB on the small test data; the others at least run."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="session")
def db(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


CORE = [n for m in entry.MODULES for n in __import__(m, fromlist=["QUERIES"]).QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query(name, spark, sf, db):
    got = entry.queries()[name](spark, sf)
    rows = got.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.columns
        return
    want = db.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=key)
    theirs = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in want.fetchall()), key=key)
    assert len(ours) == len(theirs) and all(a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4 * max(1, abs(x))) for x, y in zip(a, b)) for a, b in zip(ours, theirs))


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "date"


def test_streaming(spark, tmp_path):
    """A second call takes in only what has come since, late days included."""
    from tapeline.streaming import daily

    def arrive(name, rows):
        spark.createDataFrame(rows, "ts timestamp_ntz, kind string").coalesce(1).write.parquet(str(tmp_path / "t.parquet" / name))

    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d, 12)
    arrive("a", [(at(1), "x"), (at(1), "y"), (at(5), "x")])
    schema = "ts timestamp_ntz, kind string"
    stream = lambda: daily.daily_counts(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "t.parquet")), "ts")
    run = lambda: daily.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    arrive("b", [(at(1), "late"), (at(9), "x")])
    run()
    assert {(str(r.day), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("2024-01-01", 3), ("2024-01-05", 1), ("2024-01-09", 1)}


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "tapeline"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tapeline.llm" in p.read_text()]
