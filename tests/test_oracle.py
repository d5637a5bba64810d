"""Every query against its SQL in DuckDB, over whole tables; those without SQL against a schema and some rows."""

import duckdb
import pytest

from pulsegrid.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def ordered(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, con):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name not in registry.ORACLE:
        assert len(got) > 0
        return
    want = con.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    got, want = ordered(got), ordered(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head(3).tolist(), want[c][~same].head(3).tolist())


def test_every_oracle_has_a_query():
    assert registry.ORACLE.keys() <= registry.QUERIES.keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql().keys() <= e.queries().keys()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], timeout=300).returncode == 0
