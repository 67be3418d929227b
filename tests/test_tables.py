"""The builds table in hash buckets."""

import os
import random

from pyspark.sql import functions as F

from buildlark import schemas
from buildlark.operators import rollups, tables

DDL = "job_name string, build_number long, status string, build_url string, is_demo boolean, synced_at timestamp"


def builds(spark, rows):
    return spark.createDataFrame(rows, DDL.replace("timestamp", "string")).withColumn("synced_at", F.col("synced_at").cast("timestamp"))


def files(path):
    return {(d.rsplit("=", 1)[-1], f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def shown(df):
    return sorted((r.job_name, r.build_number, r.status, r.build_url, r.is_demo) for r in df.collect())


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "builds")
    rows = [("j", i, "SUCCESS", f"u/{i}", False, "2024-01-01") for i in range(400)]
    tables.store_builds(builds(spark, rows), path, 8)
    bucket = {r.build_number: r.bucket for r in tables.stored_builds(spark, path).collect()}
    assert set(bucket.values()) == set(range(8))
    some = [i for i in bucket if bucket[i] == 5][:4]
    before = files(path)
    touched = tables.merge_builds(builds(spark, [("j", i, "FAILURE", "again", True, "2024-01-02") for i in some]), path, 8)
    after = files(path)
    assert touched == [5]
    assert {f for f in before if f[0] != "5"} == {f for f in after if f[0] != "5"}
    assert not {f for f in before if f[0] == "5"} & after
    want = sorted(("j", i, "FAILURE" if i in some else "SUCCESS", f"u/{i}", False) for i in range(400))
    assert shown(tables.stored_builds(spark, path)) == want


def test_a_filter_on_the_bucket_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "builds")
    tables.store_builds(builds(spark, [("j", i, "SUCCESS", "u", False, "2024-01-01") for i in range(200)]), path, 8)
    one = tables.stored_builds(spark, path).where(F.col("bucket").isin([3]))
    one.write.format("noop").mode("overwrite").save()
    plan = one._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(bucket" in plan.toString() or "PartitionFilters: [(bucket" in plan.toString()
    read = plan.collectLeaves().head().metrics().get("numPartitions").get().value()
    one.collect()
    assert {r.bucket for r in one.collect()} == {3} and read <= 1


def test_many_merges_equal_one_table_in_memory(spark, tmp_path):
    rng, path, state = random.Random(2), str(tmp_path / "builds"), {}
    tables.store_builds(builds(spark, []), path, 4)
    for day in range(1, 5):
        rows = [("ab"[rng.randrange(2)], rng.randrange(12), f"S{day}{k}", f"u{day}{k}", k % 2 == 0, f"2024-01-0{day} 00:00:{k:02d}") for k in range(10)]
        for j, n, status, url, demo, _ in rows:
            first = state.get((j, n), (None, url, demo))
            state[j, n] = status, first[1], first[2]
        for _ in range(2 if day == 3 else 1):  # a merge that is done twice changes nothing more
            tables.merge_builds(builds(spark, rows), path, 4)
    assert shown(tables.stored_builds(spark, path)) == sorted((*k, *v) for k, v in state.items())


def test_nothing_comes_in(spark, tmp_path):
    path = str(tmp_path / "builds")
    tables.store_builds(builds(spark, [("j", 1, "S", "u", None, None), ("j", None, "S", "u", None, None), (None, 1, "S", "u", None, None)]), path, 4)
    before = files(path)
    assert tables.merge_builds(builds(spark, []), path, 4) == [] and files(path) == before
    assert set(tables.stored_builds(spark, path).columns) == {*tables.conform(builds(spark, []), schemas.TABLES["builds"]).columns, "bucket"}


def test_inventory_shows_a_whole_row(spark):
    rows = spark.createDataFrame([(2, "b", None), (1, "z", 2.5), (1, "a", None)], "k int, s string, v double")
    got = {r.table_name: r for r in rollups.table_inventory({"some": (rows, "k"), "none": (rows.limit(0), "k")}).collect()}
    assert (got["some"].n_rows, got["some"].sample_key) == (3, "1")
    assert got["some"].sample_row == '{"k":1,"s":"a","v":null}'
    assert (got["none"].n_rows, got["none"].sample_key, got["none"].sample_row) == (0, None, None)
