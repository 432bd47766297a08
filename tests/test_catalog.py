"""Every query of the catalog against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwright.operators import scan
from loomwright.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(str, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_like_its_sql(spark, duck, name):
    got = canonical(catalog.QUERIES[name](spark, SF).toPandas())
    assert got == canonical(duck.execute(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    found = entry.queries()
    assert set(catalog.QUERIES) <= set(found) and set(entry.oracle_sql()) <= set(found)
    assert entry.entry(spark).count() > 0


def test_scans_read_only_what_they_need(spark):
    plan = catalog.QUERIES["incremental_hits"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan
    plan = catalog.QUERIES["alias_resolve"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_imports_of_every_page_are_resolved(spark, tmp_path):
    urls = [f"https://h{i % 3}.org/{'x/' * (i % 2)}d{i % 5}/p{i % 7}{('', '.ts', '/', '?q=1')[i % 4]}" for i in range(60)]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    paths = [u.split("://")[1].split("?")[0].removesuffix("/") for u in urls]
    named = lambda source, path: ("/" + path.removesuffix(".ts")).endswith("/" + source)
    want = [(i, j) for i, p in enumerate(paths) for j, q in enumerate(paths) if named("/".join(p.split("/")[-2:]), q)]
    got = catalog.QUERIES["import_suffix_join"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == want and {i % 10 for i, _ in want} > {0}


def test_programs_of_one_row_group_are_read_by_many_tasks(spark, tmp_path):
    n = 3 * scan.TEXTS_IN_TASK * spark.sparkContext.defaultParallelism
    part = spark.range(n).selectExpr("id AS p_partkey", "concat('n ', id) AS p_name", "'B#1' AS p_brand", "'T T' AS p_type").coalesce(1)
    part.write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.QUERIES["value_positions"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("p_partkey").alias("n")).collect()
    assert sum(r["n"] for r in got) == n and max(r["n"] for r in got) <= 1.2 * scan.TEXTS_IN_TASK
