import random
import time

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from ratelantern import adapters, driver_queries, session
from ratelantern.operators import matching
from ratelantern.operators.joins import lookup_join, skew_join, tasks_for
from ratelantern.operators.ordered import mark_runs, row_chunk, running_offset
from ratelantern.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_runs_match_a_simple_loop(spark, chunk):
    rng = random.Random(chunk)
    data = [(rng.choice("ab"), i, rng.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(data, "f string, at bigint, k string")
    got = mark_runs(df, ["f"], ["at"], ["k"], row_chunk(F.col("at"), chunk))
    expected, last, number = {}, {}, {}
    for f, at, k in data:
        if f not in last or last[f] != k:
            number[f] = number.get(f, 0) + 1
        last[f] = k
        expected[at] = number[f]
    assert {r["at"]: r.run for r in got.collect()} == expected


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_offsets_match_a_simple_loop(spark, chunk):
    rng = random.Random(chunk)
    data = [(rng.choice("ab"), i, rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(data, "f string, at bigint, n bigint")
    got = running_offset(df, ["f"], ["at"], "n", row_chunk(F.col("at"), chunk))
    totals, expected = {}, {}
    for f, at, n in data:
        expected[at] = totals.get(f, 0)
        totals[f] = totals.get(f, 0) + n
    assert {r["at"]: r.offset for r in got.collect()} == expected


@pytest.mark.parametrize("small_group", [0, 3, 10**6])
def test_quantiles_match_numpy(spark, small_group):
    rng = np.random.default_rng(1)
    groups = {
        "hot": rng.lognormal(5, 3, 4000).round(2),
        "same": np.full(500, 7.25),
        "signed": rng.normal(0, 100, 501),
        "one": np.array([3.0]),
        "two": np.array([1.0, 2.0]),
        "zero": np.array([0.0, -0.0, 1e12, -1e12]),
    }
    data = [(k, float(v)) for k, values in groups.items() for v in values]
    data += [("hot", None), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    wanted = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", wanted, small_group).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k].n_values == len(values)
        for name, p in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-6), (k, name)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, n int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("k9", 4), ("zz", 5)], "k string, v int")
    plain = rows(left.join(right, "k", how))
    for threshold in (0, 10, 10**9):
        salted = skew_join(left, right, ["k"], how, spread=["n"], hot_rows=threshold, salts=5)
        assert rows(salted.select(left.join(right, "k", how).columns)) == plain
    with pytest.raises(ValueError):
        skew_join(left, right, ["k"], "full", spread=["n"])


def test_hot_rows_are_spread(spark):
    left = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("n"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    plan = skew_join(left, right, ["k"], spread=["n"], hot_rows=10)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_lookup_join_both_ways(spark):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "k string, n int")
    lookup = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    small = lookup_join(left, lookup, ["k"], lookup_bytes=10, spread=["n"])
    large = lookup_join(left, lookup, ["k"], lookup_bytes=10**12, spread=["n"])
    assert rows(small, "k", "n", "v") == rows(large, "k", "n", "v")


def test_stages_are_compressed_and_the_session_keeps_its_settings(spark):
    before = spark.conf.get(session.METHOD_LIMIT)
    spark.conf.set(session.METHOD_LIMIT, "65535")
    try:
        stored = session.write_stage(spark.range(10), "compressed")
        assert spark.conf.get(session.METHOD_LIMIT) == "65535"
    finally:
        spark.conf.set(session.METHOD_LIMIT, before)
    assert all(f.endswith(".zstd.parquet") for f in stored.inputFiles()) and stored.count() == 10


def test_a_stage_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and "shuffle_" in f}

    before = held()
    stored = session.write_stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and stored.count() == 7
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"


def test_json_files_do_not_grow_with_the_tables(spark, tmp_path, monkeypatch):
    assert adapters.json_file_count(150_000) == 8
    for orders in (1, 160_001, 9_000_000, 54_000_000):
        files = adapters.json_file_count(orders)
        assert files % 8 == 0 and orders / files <= adapters.ORDERS_PER_FILE
    monkeypatch.setattr(adapters, "ORDERS_PER_FILE", 10)
    documents = adapters.hospital_documents(spark, "/root/testdata/sf0.001").where("split(source_file, '-')[1] < 200")
    n = documents.count()
    adapters.write_hospital_json_files(documents, str(tmp_path / "json"))
    assert n > 80 and len(list((tmp_path / "json").glob("file=*"))) > 8


def test_json_files_of_repeated_keys(spark, tmp_path):
    """Elements that share the first place of their array, elements without text, and an array without elements."""
    header = spark.createDataFrame([(f, '{"name":"x"}') for f in (0, 1)], "file bigint, text string")
    elements = [(0, at, f'{{"n":{at}}}') for at in (2, 1, 1, 2)] + [(0, 0, None), (None, 1, '{"n":9}')]
    arrays = {"a": spark.createDataFrame(elements, "file bigint, at bigint, text string")}
    adapters.write_json_files(header, arrays | {"b": arrays["a"]}, str(tmp_path / "files"))
    read = spark.read.schema("name string, a array<struct<n: int>>, b array<struct<n: int>>").options(multiLine=True, mode="FAILFAST").json(f"{tmp_path}/files/*")
    assert rows(read.selectExpr("name", "a.n", "b.n")) == [("x", [1, 1, 2, 2], [1, 1, 2, 2]), ("x", [], [])]
    npis = spark.createDataFrame([(7,), (7,), (8,), (None,)], "npi bigint")
    adapters.write_npi_list(npis, str(tmp_path / "npis"))
    assert rows(spark.read.options(multiLine=True, mode="FAILFAST").json(f"{tmp_path}/npis/part*")) == [("7",), ("7",), ("8",)]


def test_tasks_grow_with_rows():
    assert [tasks_for(n, 10) for n in (0, 1, 10, 11, 1000)] == [1, 1, 1, 2, 100]


def test_skew_join_in_tasks(spark):
    left = spark.createDataFrame([(n % 3, n) for n in range(60)], "k int, n int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k int, v string")
    joined = skew_join(left, right, ["k"], spread=["n"], hot_rows=5, tasks=7)
    assert rows(joined, "k", "n", "v") == rows(left.join(right, "k"), "k", "n", "v")
    assert ", 7)" in joined._jdf.queryExecution().executedPlan().toString()


def test_skew_join_broadcasts_no_side(spark):
    """Without hot keys their list is empty, and a side joined to it looked empty to the optimizer."""
    left = session.write_stage(spark.createDataFrame([(n % 30, n) for n in range(60)], "k int, n int"), "left")
    right = session.write_stage(spark.createDataFrame([(n, "x" * 50) for n in range(30)], "k int, v string"), "right")
    joined = skew_join(left, right, ["k"], spread=["n"], hot_rows=5, tasks=7)
    assert len(joined.collect()) == 60
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k" in plan and "_salt" in plan.split("SortMergeJoin [k")[1].splitlines()[0]


def test_item_codes_by_number_of_rows(spark, monkeypatch):
    """Items are dealt to tasks by their number, and links are counted before they meet the codes."""
    columns = ", ".join(f"{c} string" for c in driver_queries.CODE_COLUMNS.values())
    n = len(driver_queries.CODE_COLUMNS)
    charges = [(f"item-{i % 4}", *["x" if i % 2 else None], *[None] * (n - 2), f"c{i % 4}") for i in range(12)]
    stored = spark.createDataFrame(charges, f"item_id string, {columns}")
    monkeypatch.setattr(driver_queries, "charge_rows", lambda spark, sf_dir: stored)
    monkeypatch.setattr(driver_queries, "ITEM_ROWS_PER_TASK", 2)
    found = driver_queries.item_codes(spark, "")
    assert sorted((r.code, r.linked_items) for r in found.collect()) == [("c0", 1), ("c1", 1), ("c2", 1), ("c3", 1), ("x", 2)]
    assert "hashpartitioning(item_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 6), REPARTITION_BY_NUM" in plan


def test_plans_are_dealt_by_number(spark, tmp_path, monkeypatch):
    """However few row groups a file has; combinations of attributes too."""
    part = "p_partkey long, p_name string, p_type string, p_brand string, p_size int"
    data = [(n, "small ring", "TIN", "Brand#11", 4) for n in range(1, 41)]
    spark.createDataFrame(data, part).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    index = adapters.match_index(spark, str(tmp_path))
    assert index.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    given = "input_id int, issuer_name string, plan_name string, state string, metal_level string, plan_type string, employer_name string, employer_ein string"
    inputs = spark.createDataFrame([(n, "Brand 11", "small ring tin", r.state, None, None, None, None) for n, r in enumerate(index.where("state is not null").collect())], given)
    expected = rows(matching.find_plans(index, inputs), "input_id", "rank", "plan_id", "match_score")
    monkeypatch.setattr(matching, "OPTIONS_PER_TASK", 10)
    asked = []
    monkeypatch.setattr(matching, "skew_join", lambda *a, **kw: asked.append(kw["tasks"]) or skew_join(*a, **kw))
    assert rows(matching.find_plans(index, inputs), "input_id", "rank", "plan_id", "match_score") == expected
    assert expected and asked[0] > 1


def test_orders_are_dealt_by_number(spark, tmp_path):
    """A scan has as many tasks as its file has splits, but only those with a row group have rows."""
    orders = spark.range(1, 1001).coalesce(1)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    read = spark.read.parquet(f"{tmp_path}/orders.parquet")
    sizes = adapters.dealt(read, 50).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert len(sizes) == 20 and max(sizes) <= 60 and sum(sizes) == 1000
