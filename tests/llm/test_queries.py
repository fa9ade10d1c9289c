import pytest

from timberline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    """Every query runs over its whole table; those with an oracle give the same rows."""
    import duckdb

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "embeddings", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        r = con.execute(ORACLES[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=str)
