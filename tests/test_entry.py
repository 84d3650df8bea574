"""The catalogue: names, columns, and rows equal to those of the SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test data")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset_name", "rec_id", "seq"] and df.count() > 0


#: what tests of their own cover on fixtures; the rest is compared here
OWN = ("index_", "ivf_", "store_", "stream_", "client_", "pipeline_", "p1_", "p3_", "p4_", "p5_", "p6_", "p7_", "p8_", "p9_")
KEPT = ("store_scan", "stream_acks", "pipeline_linear", "client_by_ids", "ivf_filtered")


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith(OWN) or k in KEPT))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    df = entry.queries()[name](spark, FOLDER)
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    show = lambda rows: sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert show(map(tuple, df.select(*cols).collect())) == show(want.fetchall())
