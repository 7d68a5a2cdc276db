"""Every query of the catalogue against its SQL on the smallest tables, and the stream against the batch."""

import os

import duckdb
import pytest

from optiqal.plans import catalog
from optiqal.streaming import shapes as stream
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list):
        return tuple(map(plain, v))
    return 0.0 if isinstance(v, float) and v == 0 else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_stream_equals_batch(spark, tmp_path):
    from optiqal.plans import views

    views.shapes(spark, SF).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    q = stream.write(stream.prepared(stream.read_shapes(spark, str(tmp_path / "in"), batch.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == stream.prepared(batch).count()
    for kind in ("timestamp_ntz", "timestamp"):
        rows = stream.read_shapes(spark, str(tmp_path / "in"), batch.schema)
        n = stream.class_counts(rows.withColumn("l_shipdate", rows["l_shipdate"].cast(kind)), "l_shipdate", "365 days", "100000 days")
        m = n.writeStream.format("memory").queryName(f"n_{kind}").outputMode("complete").trigger(availableNow=True).start()
        m.awaitTermination(120)
        assert spark.sql(f"select sum(n) from n_{kind}").first()[0] == batch.count()
