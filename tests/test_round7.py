"""Work that grows with pairs: what is dealt per item, per option and per pair of vector packs."""

import __spark_entry__ as contract
from balsam.operators import skin

SF_DIR = "/root/testdata/sf0.001"


def _skin(spark):
    rules = spark.createDataFrame(
        [("r1", "Aqua", ["Water"], ["oily"], ["dry"], ["c"], "if", "B", "say 1", ["S1", "S0"]),
         ("r2", "Aqua", None, None, ["dry"], ["d"], "if", "B", "say 2", ["S9"])],
        "rule_id string, display_name_ko string, aliases array<string>, caution_for array<string>, beneficial_for array<string>, "
        "possible_concerns array<string>, condition string, evidence_level string, user_message_ko string, source_ids array<string>")
    profiles = spark.createDataFrame(
        [(1, "oily", [("WATER (x)",)]), (2, "oily", [("",), (None,)]), (3, "dry", None), (4, "normal", [("aqua",)]), (5, "normal", [])],
        "request_id long, skin_type string, previous_reactions array<struct<ingredient_name:string>>").selectExpr(
        "*", "false AS sensitive", "false AS dehydration", "false AS barrier_impaired", "CAST(NULL AS array<string>) AS concerns")
    items = spark.createDataFrame(
        [(r, p, n) for r in range(1, 7) for p, n in enumerate(["aqua", "Water", "ＡＱＵＡ", "none", None, ""])], "request_id long, position int, name string")
    sources = spark.createDataFrame([("S0", "t0", "u0"), ("S1", "t1", "u1")], "source_id string, title string, url string")
    return items, rules, profiles, sources


def test_skin_notices_of_owners_with_and_without_reactions(spark):
    out = skin.evaluate_skin(*_skin(spark), reason="again")
    got = {(r.request_id, r.position, r.rule_id): (r.level, r.matched_profiles, r.reason, r.source_titles) for r in out.collect()}
    one = {(r, p, "r1") for r in (1, 2) for p in (0, 1, 2)}
    assert set(got) == one | {(3, p, "r1") for p in (0, 1, 2)} | {(3, p, "r2") for p in (0, 2)} | {(4, p, r) for p in (0, 2) for r in ("r1", "r2")}
    assert got[1, 1, "r1"] == ("high", ["oily"], "again", ["t1", "t0"]) and got[1, 0, "r1"][0] == got[2, 1, "r1"][0] == "caution"
    assert got[3, 2, "r2"] == ("beneficial", ["dry"], "say 2", []) and got[4, 2, "r2"][:3] == ("high", [], "again")


def test_skin_notices_are_not_dealt_by_owner(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = contract.queries()["evaluate_skin"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # A notice for every item and rule of a name: users and their reactions meet the items before that.
    assert "hashpartitioning(request_id" not in plan
    # Lists are written out once per notice, not per item.
    assert "array_join" not in plan.split("SortMergeJoin")[0]


def test_packs_fill_up_whatever_a_worker_gets_at_once_and_travel_in_small_rows(spark, monkeypatch):
    import numpy as np

    from balsam.operators import retrieval

    rng = np.random.default_rng(3)
    docs = np.round(rng.normal(size=(400, 16)), 1)
    docs[200:300] = docs[:100]

    def frame(m, key):
        return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, vector array<double>")

    monkeypatch.setattr(retrieval, "ROW_BYTES", 7 * 8 * 16, raising=False)
    monkeypatch.setattr(retrieval, "PACK_BYTES", 60 * 8 * 16)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        index = retrieval.vector_index(frame(docs, "row"), 64)
        packs = retrieval.query_packs(frame(docs[:120], "query_id"), index, 0.2, 60).collect()
        got = retrieval.vector_retrieve(frame(docs[:120], "query_id"), frame(docs, "row"), 5, 0.2, 64).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(i for r in packs for i in r.ids) == list(range(120))
    # Two ranges of about 60 queries, each of one pack or two; no row holds more than 7 vectors.
    assert len({r.pack for r in packs}) <= 4 and max(len(r.vectors) for r in packs) <= 7 * 8 * 16
    unit = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    scores = np.round(unit[:120] @ unit.T, 12)
    want = {(q, n + 1): int(d) for q, row in enumerate(scores)
            for n, d in enumerate([d for d in np.lexsort((np.arange(400), -row)) if row[d] >= 0.2][:5])}
    assert {(r.query_id, r["rank"]): r.row for r in got} == want


def test_bound_of_the_best_scores_is_reached_by_k_of_them():
    import numpy as np

    from balsam.operators import retrieval

    scores = np.round(np.random.default_rng(4).normal(size=(50, 1000)), 1)
    least = retrieval._at_least(scores, 8, -9.0)
    assert (np.sum(scores >= least[:, None], axis=1) >= 8).all() and (np.sum(scores >= least[:, None], axis=1) < 200).all()
    assert (retrieval._at_least(scores[:, :40], 8, 0.5) == 0.5).all()


def _results(spark, rows):
    return spark.createDataFrame(rows, "product_id long, position int, option_id string, status string, ingredients array<string>")


def test_parser_choice_on_repeats_null_ids_and_missing_products(spark):
    from balsam.operators import options

    p = _results(spark, [(1, 0, "a", "ready", ["x"]), (1, 1, "b", "empty", []), (2, 0, "a", "ready", ["x"]), (2, 1, "a", "ready", ["x"]),
                         (3, 0, None, "ready", ["x"]), (3, 1, "b", "ready", ["x", "y"]), (4, 0, "a", "ready", ["x"]), (None, 0, "a", "ready", ["x"]),
                         (5, 1, "a", "ready", ["x"]), (5, 0, "b", "ready", ["x"]), (6, 0, "a", None, None), (7, 0, "a", "empty", ["x"])])
    c = _results(spark, [(1, 0, "a", "ready", ["x"]), (1, 1, "b", "ready", ["z"]), (2, 0, "a", "ready", ["x"]), (3, 0, None, "ready", ["x"]),
                         (3, 1, "b", "ready", ["y", "x"]), (None, 0, "a", "ready", ["x"]), (5, 0, "b", "empty", []), (6, 0, "a", "ready", ["x"]),
                         (7, 0, "a", "empty", ["other"]), (9, 0, "a", "ready", ["x"])])
    chosen = options.select_safe_result(p, c)
    got = {r.product_id: (r.selected, r.reason) for r in chosen.collect()}
    better = ("candidate", "candidate_increases_ready_options_without_regression")
    assert got == {
        1: better, 2: ("production", "duplicate_option_id_detected"), 3: ("production", "production_option_missing_in_candidate"),
        4: ("production", "candidate_result_unavailable"), None: ("production", "candidate_result_unavailable"),
        5: ("production", "production_ready_option_not_ready_in_candidate"), 6: better, 7: ("production", "no_safe_improvement_detected")}
    canonical = spark.createDataFrame(
        [(1, "b", "B"), (1, "z", "Z"), (2, "a", "A"), (3, None, "N"), (None, "a", "A"), (6, "a", "A"), (6, "a", "A2"), (8, "a", "A")],
        "product_id long, option_key string, option_name string")
    out = options.effective_options(canonical, p, c, chosen)
    assert sorted(map(str, ((r.product_id, r.option_name, r.status, r.ingredients, r.provenance, r.analysis_available) for r in out.collect()))) == sorted(map(str, [
        (1, "B", "ready", ["z"], "candidate", True), (1, "Z", "error", [], None, False), (2, "A", "ready", ["x"], "production", True),
        (2, "A", "ready", ["x"], "production", True), (3, "N", "error", [], None, False), (None, "A", "error", [], None, False),
        (6, "A", "ready", ["x"], "candidate", True), (6, "A2", "ready", ["x"], "candidate", True), (8, "A", "error", [], None, False)]))


def test_parser_rows_are_dealt_by_product_once(spark):
    from balsam.operators import options

    p = _results(spark, [(1, 0, "a", "ready", ["x"])])
    chosen = options.select_safe_result(p, p)
    canonical = spark.createDataFrame([(1, "a", "A")], "product_id long, option_key string, option_name string")
    picked = spark.createDataFrame([(1, "production")], "product_id long, selected string")
    for df in (chosen, options.effective_options(canonical, p, p, picked)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_seeds_of_related_products_travel_once_and_without_their_positions(spark):
    import re

    df = contract.queries()["related_products"](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "names" in plan and not re.search(r"struct\(seed_pos, seed_pos#\d+L?\)", plan)
