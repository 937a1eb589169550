"""Plans and skew: no cross joins, early group limits, exact results when blocks and groups split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from balsam.operators import registry_build, retrieval, store, windows
from balsam.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ranks_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    assert "WindowGroupLimit" in plan(windows.keep_first(df, "k", "id"))
    assert "WindowGroupLimit" in plan(windows.top_k(df, "k", "id", 5))


def test_scan_reads_only_needed_columns(spark):
    text = contract.queries()["keep_first"](spark, SF_DIR)
    schema = plan(text).split("ReadSchema: ")[1].split("\n")[0]
    assert "l_comment" not in schema and "l_extendedprice" not in schema


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_vectors_equal_brute_force_when_a_cell_is_crowded(spark, block_rows):
    rng = np.random.default_rng(0)
    base = np.array([1.0, 0.2, 0.1, 0.0])
    docs = np.vstack([base + rng.normal(0, 0.05, (60, 4)), rng.normal(size=(60, 4))])
    queries = np.vstack([base + rng.normal(0, 0.05, (10, 4)), rng.normal(size=(20, 4))])

    def frame(m, key):
        return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, vector array<float>")

    got = retrieval.vector_retrieve(frame(queries, "query_id"), frame(docs, "row"), 5, 0.75, block_rows)
    got = {(r.query_id, r.rank): r.row for r in got.collect()}
    f32 = lambda m: m.astype(np.float32).astype(np.float64)
    unit = lambda m: f32(m) / np.linalg.norm(f32(m), axis=1, keepdims=True)
    scores = unit(queries) @ unit(docs).T
    want = {}
    for q in range(len(queries)):
        hits = [d for d in np.argsort(-scores[q], kind="stable") if scores[q][d] >= 0.75][:5]
        want.update({(q, i + 1): int(d) for i, d in enumerate(hits)})
    assert got == want


def test_exact_index_is_cut_per_key(spark):
    docs = spark.createDataFrame([(i, "Water", f"e{i}", "", None) for i in range(50)],
                                 "row long, ingredient_kor_name string, ingredient_eng_name string, cas_no string, synonym string")
    queries = spark.createDataFrame([(1, "wa ter"), (2, "WATER"), (3, "wat"), (4, "E7")], "query_id long, query string")
    got = retrieval.exact_retrieve(queries, docs, 3).collect()
    assert {(r.query_id, r.row, r.match_score) for r in got} == {
        (1, 0, 100.0), (1, 1, 100.0), (1, 2, 100.0), (2, 0, 100.0), (2, 1, 100.0), (2, 2, 100.0), (4, 7, 95.0)}


def test_forward_fill_crosses_blocks(spark):
    df = spark.createDataFrame([("t", i, "v" + str(i) if i in (0, 25) else None) for i in range(60)], "g string, n long, v string")
    got = {r.n: r.v for r in registry_build.carry_forward(df, "g", "n", "v", block_rows=8).collect()}
    assert all(got[i] == ("v0" if i < 25 else "v25") for i in range(60))


def test_global_number_is_contiguous_over_gaps(spark):
    df = spark.range(100).select((F.col("id") * 17 + 3).alias("id"))
    rows = windows.global_number(df, "id", "n", bucket_rows=50).orderBy("id").collect()
    assert [r.n for r in rows] == list(range(1, 101))


def test_contains_join_equals_brute_force(spark):
    texts = ["abcabc", "xbcx", "a", "ab", "", "zzz", "한글 크림", "크림"]
    needles = ["a", "bc", "zzzz", "크림", "cab", "b"]
    got = store.contains_join(
        spark.createDataFrame([(t,) for t in texts], "t string"), "t",
        spark.createDataFrame([(n,) for n in needles], "n string"), "n").collect()
    assert {(r.t, r.n) for r in got} == {(t, n) for t in texts for n in needles if n in t}


def test_related_products_leave_out_the_request_and_fill_its_place(spark):
    n = 8
    products = spark.createDataFrame(
        [(i, "s", str(i), "c" if i < 4 else "d", "top > x" if i % 2 else "top > y") for i in range(n)],
        "product_id long, source string, external_id string, category string, category_path string"
    ).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    until = F.lit("2030-01-01").cast("timestamp_ntz")
    records = products.select("product_id", F.lit("o").alias("option_id"), until.alias("expires_at"))
    items = products.select("product_id", F.lit("o").alias("option_id"), F.lit(1).alias("position"),
                            F.lit("Water").alias("ingredient_name"), F.lit("water").alias("normalized_name"))
    states = products.select("product_id", F.lit("ready").alias("status"), F.lit(1).alias("option_count"), until.alias("expires_at"))
    requests = products.select(F.col("product_id").alias("request_id"), "product_id", "category", "category_path")
    seeds = requests.select("request_id", F.lit(0).alias("seed_pos"), F.lit("water").alias("name"))
    got = store.related_products(requests, seeds, products, states, records, items, "2025-01-01", limit=5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.request_id, r.rank)):
        by.setdefault(r.request_id, []).append(r.product_id)
    assert by[0] == [1, 2, 3, 4, 5] and by[2] == [0, 1, 3, 4, 5] and by[7] == [4, 5, 6, 0, 1]
