"""Every registered query against its oracle, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from timberline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    r = con.execute(registry.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=str)


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())


def test_stream(spark, tmp_path):
    from timberline.streaming.tail import read_stream, recognized_stream, severity_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("2019-06-27T12:34:01Z FATAL x\n  more\n2019-06-27T12:34:50Z WARN y\n2019-06-27T12:36:00Z WARN z\n")
    q = severity_counts(recognized_stream(read_stream(spark, str(tmp_path / "in")))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.severity, r.n) for r in spark.table("counts").collect())
    assert got == [("FATAL", 1), ("WARN", 1), ("WARN", 1)]
