"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from herald.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def shown(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def same(df, sql, sf_dir, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(sql)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    got = sorted(repr([shown(r[c]) for c in names]) for r in df.collect())
    index = {c: i for i, c in enumerate(want.columns)}
    expected = sorted(repr([shown(r[index[c]]) for c in names]) for r in want.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_form_encoding(spark, sf_dir):
    from urllib.parse import quote_plus

    from pyspark.sql import functions as F

    from herald.functions.columns import encode_form

    texts = ["a b*~", "#{name} é", "", "x=1&y=2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", encode_form(F.col("t")).alias("e")).collect()
    assert {r["t"]: r["e"] for r in rows} == {t: quote_plus(t, safe="*") .replace("~", "%7E") for t in texts}


def test_batches_are_cut_without_absent_numbers(spark, sf_dir, tmp_path):
    """1003 recipients of a request, four without a number: two batches, not three."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet")) if t not in ("customer", "orders") else None
    spark.sql("select 1L as c_custkey, 'Customer 1' as c_name, 1 as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.sql("select id as o_orderkey, 1L as o_custkey, cast(id as double) as o_totalprice, '5-LOW' as o_orderpriority from range(1, 1004)").write.parquet(str(tmp_path / "orders.parquet"))
    name = "a4_batch_failover_flag"
    got = registry.queries()[name](spark, str(tmp_path))
    assert got.count() == 2
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(map(tuple, got.select("request_id", "batch_index", "failover").collect())) == sorted(con.sql(registry.oracle_sql()[name]).fetchall())
