"""Broadcasts by measured sizes, and searches cut per key."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from balsam.operators import evaluate, matching, quality, store
from balsam.plans import session


def test_a_side_that_explodes_is_not_broadcast_by_its_estimate(spark, tmp_path):
    path = str(tmp_path / "names")
    spark.range(150_000).select("id", F.concat_ws("-", F.sha2(F.col("id").cast("string"), 256), "id").alias("name")).coalesce(1).write.parquet(path)
    try:
        session.prepare_tables(spark)
        names = spark.read.parquet(path)
        ends = names.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.substr("name", i, F.lit(40)))).alias("end"))
        joined = names.join(ends.groupBy("id", "end").agg(F.count("*").alias("n")), "id", "left")
        joined.write.format("noop").mode("overwrite").save()
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        session.prepare(spark)


def test_the_cluster_settings_come_back(spark):
    before = [spark.conf.get(n, None) for n in session.BEFORE]
    session.prepare_tables(session.prepare_tables(spark))
    assert spark.conf.get(session.STATIC) == session.ESTIMATED_LIMIT and spark.conf.get(session.MEASURED) == before[0]
    session.prepare(spark)
    assert [spark.conf.get(n, None) for n in session.BEFORE] == before


def test_cached_results_are_cut_per_key_before_queries_meet_them(spark, monkeypatch):
    moment = "TIMESTAMP '2030-01-01 00:00:00'"
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.lit("red").alias("query"), F.lit(99).alias("result_limit"))
    searches = spark.sql(f"SELECT 'red' AS query_key, {moment} AS searched_at, {moment} AS expires_at")
    results = spark.range(300).select(F.lit("red").alias("query_key"), F.col("id").alias("product_id"), (299 - F.col("id")).cast("int").alias("rank"))
    products = spark.sql(f"SELECT id AS product_id, 'n' AS product_name, 'n' AS name_key, 'b' AS brand_name, {moment} AS updated_at FROM range(3)")
    states = spark.sql(f"SELECT id AS product_id, 'ready' AS status, {moment} AS expires_at FROM range(3)")
    met, plain = [], store.cached_search
    monkeypatch.setattr(store, "cached_search", lambda q, s, r, as_of: met.append(r.count()) or plain(q, s, r, as_of))
    out = store.resolve_searches(asked, products, searches, results, states, "2020-01-01 00:00:00").collect()
    assert met == [10] and len(out) == 400
    assert sorted(r.product_id for r in out if r.query_id == 7) == list(range(290, 300))


def test_regulation_totals_meet_one_row_per_item_and_agree_with_the_lists(spark):
    registry = spark.sql("""SELECT id AS seq, 'Red Bolt' AS ingredient_kor_name, IF(id % 4 = 0, '', concat('c', id % 2)) AS chemical_name,
        CASE id % 3 WHEN 0 THEN 'restricted' WHEN 1 THEN 'prohibited' END AS regulation_type, 'x' AS category, '1' AS cas_no, id AS source_row,
        concat('S', id % 2) AS source_id, IF(id % 5 = 0, '1%', NULL) AS max_concentration, '' AS product_scope,
        CAST(NULL AS STRING) AS use_conditions, '' AS warning_text FROM range(40)""")
    items = spark.sql("""SELECT id % 5 AS product_id, id AS position, element_at(array('red bolt', 'C1', 'c0', 'none'), CAST(id % 4 + 1 AS INT)) AS name
        FROM range(17)""")
    lists = matching.match_regulations(items, registry).withColumn("basis", quality.has_basis()).collect()
    totals = {r.product_id: r for r in matching.regulation_totals(items, registry, quality.has_basis()).collect()}
    assert totals.keys() == {r.product_id for r in lists} and len(totals) == 5
    for product, r in totals.items():
        own = [m for m in lists if m.product_id == product]
        counts = Counter()
        for c in r.type_counts:
            counts[c.value] += c.n
        assert r.match_count == len(own) and counts == Counter(m.regulation_type for m in own if m.regulation_type)
        assert sorted(r.matched_names) == sorted({m.matched_name for m in own}) and sorted(r.source_ids) == sorted({m.source_id for m in own})
        assert sorted(r.match_types) == sorted({m.match_type for m in own}) and set(r.decision_basis_flags) == {m.basis for m in own}
        assert len(r.type_counts) <= 2 * 4  # two types a key, however many rows of the registry share it


def test_counted_lists_compare_as_multisets(spark):
    kind = "array<struct<value:string,n:bigint>>"
    cases = [([("a", 1), ("a", 1), ("b", 1)], ["b", "a", "a"], True), ([("a", 1)], ["a", "a"], False), ([("a", 1)], ["a", "b"], False),
             ([("a", 1), ("b", 1)], ["a"], False), ([], [], True), ([], ["a"], False), ([("a", 3_000_000_000)], ["a"], False)]
    got = spark.createDataFrame([(i, c, w) for i, (c, w, _) in enumerate(cases)], f"i int, c {kind}, w array<string>").select(
        "i", evaluate.counted_equal(F.col("c"), F.col("w")).alias("same")).collect()
    assert {r.i: r.same for r in got} == {i: same for i, (_, _, same) in enumerate(cases)}


def test_shuffle_partitions_grow_with_the_files_and_tasks_do_not(spark, tmp_path, monkeypatch):
    before = [spark.conf.get(n, None) for n in session.BEFORE]
    monkeypatch.setattr(session, "INPUT_BYTES", 1_000)
    (tmp_path / "small.parquet").write_bytes(b"x" * 900)
    (tmp_path / "large.parquet").mkdir()
    (tmp_path / "large.parquet" / "part").write_bytes(b"x" * 999_100)
    try:
        for _ in range(2):
            session.prepare_tables(spark, str(tmp_path))
            assert spark.conf.get(session.PARTITIONS) == "1000" and spark.conf.get(session.ADVISORY) == str(session.TASK_BYTES)
        rows = spark.range(3_000_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name")).repartition("id")
        assert rows.rdd.getNumPartitions() > 12  # 200 MB of names; no task takes more than 8
    finally:
        session.prepare(spark)
    assert [spark.conf.get(n, None) for n in session.BEFORE] == before
