"""Queries of skin rules, questions, prompts, categories and the evaluation suites."""

from pyspark.sql import functions as F

from ..operators import classify, context, evaluate, quality, requests, skin
from . import views  # noqa: F401
from .queries_matching import _ITEMS, _REG_INDEX
from .queries_retrieval import _EXACT
from .registry import query, view

# --- skin rules ---------------------------------------------------------------------------------
# Rules come from `part`, sources from `region` and `nation`, users from `customer` with the
# ingredients of their orders.


def _lists(opening: str, closing: str) -> dict[str, str]:
    return {
        "skin_rules": f"""
SELECT 'r' || CAST(p_partkey AS STRING) AS rule_id, p_type AS canonical_group,
       p_name || ' ' || p_brand AS display_name_ko,
       {opening}p_brand || ' ' || p_type || ' - ' || CAST(p_size AS STRING), upper(p_name) || p_brand{closing} AS aliases,
       CASE WHEN p_size % 3 = 0 THEN {opening}'oily', 'sensitive'{closing} WHEN p_size % 3 = 1
            THEN {opening}'acne_prone'{closing} ELSE {opening}'none'{closing} END AS caution_for,
       CASE WHEN p_size % 2 = 0 THEN {opening}'dry', 'dehydrated_oily'{closing}
            ELSE {opening}'barrier_impaired'{closing} END AS beneficial_for,
       {opening}'concern'{closing} AS possible_concerns, 'condition' AS condition, 'B' AS evidence_level,
       'low' AS severity_default, 'message ' || p_type AS user_message_ko,
       {opening}'S' || CAST(p_size % 7 AS STRING), 'S' || CAST(p_size % 5 AS STRING){closing} AS source_ids
FROM {{part}}""",
        "skin_profiles": f"""
SELECT c_custkey AS request_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'oily' WHEN 'MACHINERY' THEN 'dry'
         WHEN 'HOUSEHOLD' THEN '' ELSE 'normal' END AS skin_type,
       c_acctbal < 0 AS sensitive, c_acctbal > 5000 AS dehydration, c_custkey % 9 = 0 AS barrier_impaired,
       CASE WHEN c_custkey % 4 = 0 THEN {opening}'acne_prone'{closing} WHEN c_custkey % 4 = 1
            THEN {opening}'barrier_impaired', 'redness'{closing} ELSE {opening}'redness'{closing} END AS concerns,
       {opening}'nuts', 'milk'{closing} AS known_allergies, p_name || ' ' || p_brand AS reacted
FROM {{customer}} JOIN {{part}} ON p_partkey = c_custkey""",
    }


for _name, _sql in _lists("array(", ")").items():
    view(_name, _sql, _lists("[", "]")[_name])
view("skin_sources", "SELECT 'S' || CAST(r_regionkey AS STRING) AS source_id, r_name AS title, "
     "'http://x/' || r_name AS url FROM {region}")
view("skin_items", """
SELECT o_custkey AS request_id, l_orderkey * 10 + l_linenumber AS position,
       CASE WHEN l_linenumber = 7 THEN p_brand || ' ' || p_type || '.-' || CAST(p_size AS STRING)
            ELSE p_name || ' ' || p_brand || CASE WHEN l_linenumber = 1 THEN ' (x)' ELSE '' END END AS name
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
""")
_RULE_KEY = "lower(regexp_replace(regexp_replace({x}, '\\([^)]*\\)', '', 'g'), '[\\s_\\-./]+', '', 'g'))"


def _rk(x):
    return _RULE_KEY.replace("{x}", x)


_RULES = f"""
idx AS (SELECT DISTINCT rule_id, {_rk('n')} AS key FROM (
  SELECT rule_id, unnest(list_concat([display_name_ko], aliases)) AS n FROM {{skin_rules}})),
hit AS (SELECT DISTINCT name, rule_id FROM (SELECT DISTINCT name, {_rk('name')} AS key FROM {{skin_items}}) JOIN idx USING (key))"""


def _profiles(t):
    return t.skin_profiles.withColumn("previous_reactions", F.when(
        F.col("request_id") % 3 == 0, F.array(F.struct(
            F.col("reacted").alias("ingredient_name"), F.lit("p").alias("product_name"),
            F.lit("red").alias("reaction"), F.lit("low").alias("severity")))).otherwise(F.from_json(
                F.lit("[]"), "array<struct<ingredient_name:string,product_name:string,reaction:string,severity:string>>")))


@query("match_rules", f"WITH {_RULES} SELECT name, rule_id FROM hit")
def _(t):
    return skin.match_rules(t.skin_items, t.skin_rules)


_ACTIVE = """
act AS (SELECT request_id, reacted, list_distinct(list_filter([nullif(skin_type, ''),
    CASE WHEN skin_type = 'oily' AND dehydration THEN 'dehydrated_oily' END, CASE WHEN sensitive THEN 'sensitive' END,
    CASE WHEN list_contains(concerns, 'acne_prone') THEN 'acne_prone' END,
    CASE WHEN barrier_impaired OR list_contains(concerns, 'barrier_impaired') THEN 'barrier_impaired' END],
    lambda x: x IS NOT NULL)) AS active FROM {skin_profiles})"""


@query("active_profiles", f"""
WITH {_ACTIVE} SELECT request_id, array_to_string(list_sort(active), ',') AS active FROM act""")
def _(t):
    return skin.active_profiles(t.skin_profiles).select("request_id", F.array_join("active", ",").alias("active"))


_NOTICES = f"""{_RULES}, {_ACTIVE},
rows AS (SELECT i.request_id, position, name, h.rule_id, r.user_message_ko, r.source_ids,
    list_filter(active, lambda x: list_contains(caution_for, x)) AS c, list_filter(active, lambda x: list_contains(beneficial_for, x)) AS b,
    i.request_id % 3 = 0 AND {_rk('reacted')} = {_rk('name')} AS before
  FROM {{skin_items}} i JOIN hit h USING (name) JOIN {{skin_rules}} r ON r.rule_id = h.rule_id JOIN act ON act.request_id = i.request_id),
notices AS (SELECT *, CASE WHEN before THEN 'high' WHEN len(c) > 0 THEN 'caution' WHEN len(b) > 0 THEN 'beneficial' END AS level FROM rows)"""


@query("evaluate_skin", f"""
WITH {_NOTICES}
SELECT request_id, position, name AS ingredient_name, rule_id, level,
  array_to_string(list_sort(CASE WHEN len(c) > 0 THEN c ELSE b END), ',') AS matched_profiles,
  coalesce((SELECT string_agg(title, ',' ORDER BY i) FROM (SELECT unnest(source_ids) AS source_id,
    generate_subscripts(source_ids, 1) AS i) u JOIN {{skin_sources}} s USING (source_id)), '') AS source_titles
FROM notices WHERE level IS NOT NULL""")
def _(t):
    return skin.evaluate_skin(t.skin_items, t.skin_rules, _profiles(t), t.skin_sources, derived={
        c: F.array_join(c, ",") for c in ("matched_profiles", "source_titles")
    }).select("request_id", "position", "ingredient_name", "rule_id", "level", "matched_profiles", "source_titles")


@query("sort_notices", f"""
WITH {_NOTICES}
SELECT request_id, ingredient_name, rule_id, level_rank FROM (SELECT request_id, name AS ingredient_name, rule_id,
  CASE level WHEN 'high' THEN 0 WHEN 'caution' THEN 1 ELSE 3 END AS level_rank FROM notices WHERE level IS NOT NULL)""")
def _(t):
    out = skin.evaluate_skin(
        t.skin_items, t.skin_rules, _profiles(t), t.skin_sources, derived={"level_rank": skin.level_rank()})
    return skin.sort_notices(out, rank="level_rank").select("request_id", "ingredient_name", "rule_id", "level_rank")


@query("check_rule_dataset", """
WITH al AS (SELECT DISTINCT rule_id, trim(regexp_replace(lower(a), '\\s+', ' ', 'g')) AS value
            FROM (SELECT rule_id, unnest(aliases) AS a FROM {skin_rules}))
SELECT 'shared alias' AS check, value FROM al GROUP BY value HAVING count(*) > 1
UNION ALL SELECT 'unknown group', n_name FROM {nation}
UNION ALL SELECT 'alias missing', 'r0: absent'
UNION ALL SELECT 'alias forbidden', 'r0: ' || lower(p_name || p_brand) FROM {part} WHERE p_partkey = 0
  AND lower(p_name || p_brand) = 'small ringbrand#2'""")
def _(t):
    profiles = t.nation.select(
        F.array("n_name").alias("helpful_function_groups"), F.array(F.lit("PROMO")).alias("caution_function_groups"))
    return quality.check_rule_dataset(
        t.skin_rules, profiles, must_have={"r0": ["absent"]}, must_not_have={"r0": ["small ringbrand#2"]})


_PROFILE_LABELS = {
    "skin_type": {"oily": "지성", "dry": "건성", "normal": "중성"},
    "flags": {"sensitive": "민감함", "dehydration": "수분 부족", "barrier_impaired": "피부 장벽 약화"},
    "concerns": {"acne_prone": "여드름", "redness": "홍조"},
    "heading": {"skin": "피부", "allergies": "알레르기", "reactions": "반응"},
}


@query("profile_text", """
SELECT request_id, array_to_string(parts, ' · ') AS summary, concat_ws('\n', CASE WHEN len(parts) > 0 THEN '피부: ' || array_to_string(parts, ', ') END,
       '알레르기: nuts, milk', CASE WHEN request_id % 3 = 0 THEN '반응: ' || reacted END) AS routine
FROM (SELECT *, list_filter(list_concat([CASE skin_type WHEN 'oily' THEN '지성' WHEN 'dry' THEN '건성' WHEN 'normal' THEN '중성' ELSE '' END,
    CASE WHEN sensitive THEN '민감함' END, CASE WHEN dehydration THEN '수분 부족' END, CASE WHEN barrier_impaired THEN '피부 장벽 약화' END],
    list_transform(concerns, lambda x: CASE x WHEN 'acne_prone' THEN '여드름' WHEN 'redness' THEN '홍조' ELSE x END)),
    lambda x: coalesce(x, '') <> '') AS parts FROM {skin_profiles})""")
def _(t):
    return context.profile_text(_profiles(t), _PROFILE_LABELS).select("request_id", "summary", "routine")


# --- questions --------------------------------------------------------------------------------------
_DANGER, _ROUTINE = ("the and", "nicht", "une"), ("with", "para", "les")


def _any(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_SAID = f"lower(text || ' ' || CASE WHEN conv_id % 3 = 0 THEN 'Water Glycerin' ELSE '' END || ' ')"
_ROUTES = f"""
routed AS (SELECT conv_id, turn, CASE WHEN {_any(_SAID, _DANGER)} THEN 'safety_warning'
    WHEN conv_id % 3 = 0 THEN 'ingredient_rag' WHEN {_any(_SAID, _ROUTINE)} THEN 'routine_check'
    ELSE 'general_answer' END AS route, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END AS ingredient_count
  FROM {{conversations}} WHERE role = 'user')"""


def _routed(t):
    asked = t.conversations.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question"), F.lit(None).cast("string").alias("current_routine"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("Water,Glycerin")).alias("ingredient_list"),
        F.array().cast("array<string>").alias("ingredients"))
    named = requests.resolve_ingredients(asked, "ingredients", "ingredient_list")
    return requests.route_questions(named, _DANGER, _ROUTINE)


@query("route_questions", f"""
WITH {_ROUTES} SELECT *, CAST(route = 'safety_warning' AS INT) AS n_warnings FROM routed""")
def _(t):
    return _routed(t).select("conv_id", "turn", "route", "ingredient_count", F.size("warnings").alias("n_warnings"))


@query("route_questions_default_words", """
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'safety_warning' WHEN turn % 2 = 0 THEN 'routine_check'
  ELSE 'general_answer' END AS route FROM {conversations}""")
def _(t):
    asked = t.conversations.select(
        "conv_id", "turn", F.concat(F.regexp_replace("text", "(?i)aha|bha", ""), F.when(
            F.col("conv_id") % 2 == 0, " 부종").otherwise("")).alias("question"),
        F.when(F.col("turn") % 2 == 0, "저녁 루틴").alias("current_routine"),
        F.array().cast("array<string>").alias("ingredient_names"))
    return requests.route_questions(asked).select("conv_id", "turn", "route")


@query("context_flags", """
SELECT doc_id, length(trim(text)) AS context_char_count, n_chars % 4 = 0 AS context_empty,
       n_chars % 4 <> 0 AS used_rag_context FROM {documents}""")
def _(t):
    rows = t.documents.select("doc_id", F.col("text").alias("context"), (F.col("n_chars") % 4).alias("retrieved_doc_count"))
    return requests.context_flags(rows).select("doc_id", "context_char_count", "context_empty", "used_rag_context")


@query("merge_warnings", """
SELECT l_orderkey, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS merged
FROM (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS a,
             list_sort(list_distinct(list(CASE WHEN l_linestatus = 'O' THEN 'A' ELSE l_linestatus END))) AS b
      FROM {lineitem} GROUP BY 1)""")
def _(t):
    status = F.when(F.col("l_linestatus") == "O", "A").otherwise(F.col("l_linestatus"))
    g = t.lineitem.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set("l_returnflag")).alias("a"), F.sort_array(F.collect_set(status)).alias("b"))
    # Blanks are dropped, so the marker in front leaves no trace.
    return requests.merge_warnings(g.withColumn("b", F.concat(F.array(F.lit("")), "b")), "a", "b", "m").select(
        "l_orderkey", F.array_join("m", ",").alias("merged"))


@query("assemble_prompts", """
SELECT conv_id, turn, 'Be careful.\n\n' || CASE WHEN turn % 2 = 0 THEN 'routine' ELSE 'general' END ||
  '\n\n[사용자 입력]\n\n질문/피부 반응:\n' || text || '\n\n피부 타입:\n입력 없음\n\n전성분표:\nwater\n\n현재 루틴:\n입력 없음'
  || '\n\n[검색된 성분 근거]\n\nctx' || CASE WHEN conv_id % 2 = 0 THEN '\n\nreg' ELSE '' END AS prompt
FROM {conversations}""")
def _(t):
    rows = t.conversations.select(
        "conv_id", "turn", F.col("text").alias("question"), F.lit(" ").alias("skin_type"),
        F.lit("water").alias("ingredient_list"), F.lit(None).cast("string").alias("current_routine"),
        F.lit("ctx").alias("context"), F.when(F.col("conv_id") % 2 == 0, " reg ").alias("regulation_context"),
        F.lit("").alias("allergen_context"),
        F.when(F.col("turn") % 2 == 0, "routine_check").otherwise("unknown").alias("route"))
    out = context.assemble_prompts(
        rows, {"general_answer": "general", "routine_check": "routine"}, ["Be careful."], "Give both limits.")
    return out.select("conv_id", "turn", "prompt")


# --- categories ----------------------------------------------------------------------------------------
_PATHS = {"color_makeup": ("promo",), "skincare": ("economy",), "other": ("small",)}
_NAMES = {"color_makeup": ("red", "blue"), "skincare": ("bolt", "plate"), "other": ("ring",)}
_CLASS = """
CASE WHEN p_type = 'PROMO' THEN 'color_makeup' WHEN p_type = 'ECONOMY' THEN 'skincare' WHEN p_type = 'SMALL' THEN 'other'
     WHEN p_name = 'hot gear' THEN 'color_makeup' WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' THEN 'color_makeup'
     WHEN p_name LIKE '%bolt%' OR p_name LIKE '%plate%' THEN 'skincare' WHEN p_name LIKE '%ring%' THEN 'other'
     ELSE 'unknown' END"""


def _wares(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("product_name"), F.col("p_type").alias("category_path"),
                         F.when(F.col("p_size") % 2 == 0, "unknown").otherwise("known").alias("category"))


_WORDS = {"path_words": _PATHS, "name_words": _NAMES, "color_words": ("hot",), "lip_words": ("gear",)}


@query("classify_products", f"SELECT p_partkey, {_CLASS} AS category FROM {{part}}")
def _(t):
    return classify.classify_products(_wares(t), **_WORDS).select("p_partkey", "category")


@query("fill_category", f"""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN {_CLASS} ELSE 'known' END AS category FROM {{part}}""")
def _(t):
    return classify.fill_category(_wares(t), **_WORDS).select("p_partkey", "category")


@query("next_action", f"""
SELECT p_partkey, CASE {_CLASS} WHEN 'skincare' THEN 'extract_ingredients' WHEN 'color_makeup'
  THEN 'select_product_option' ELSE 'manual_review' END AS action FROM {{part}}""")
def _(t):
    return classify.classify_products(_wares(t), **_WORDS).select("p_partkey", classify.next_action().alias("action"))


@query("public_option_status", """
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'unavailable' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'ready' END AS public_status,
  CASE WHEN o_custkey % 3 = 0 THEN 'product_data_unavailable' ELSE 'extract_ingredients' END AS next_action FROM {orders}""")
def _(t):
    rows = t.orders.select(
        "o_orderkey", (F.col("o_custkey") % 3 > 0).alias("can_analyze"), F.lit("ready").alias("status"),
        F.when(F.col("o_orderstatus") == "P", "partial").otherwise("ready").alias("collection_status"),
        F.lit("skincare").alias("category"))
    return classify.public_option_status(rows).select("o_orderkey", "public_status", "next_action")


@query("analysis_eligible", """
SELECT page_id, h = 'example.com' OR h LIKE '%.example.com' AS can_analyze,
       CASE WHEN NOT (h = 'example.com' OR h LIKE '%.example.com') THEN 'host not allowed' END AS reason
FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h FROM {pages})""")
def _(t):
    rows = t.pages.select("page_id", F.lit("shop").alias("source"), F.col("url").alias("product_url"))
    return classify.analysis_eligible(rows, "shop", "example.com").select("page_id", "can_analyze", "reason")


# --- evaluation ----------------------------------------------------------------------------------------
# Gold is put beside the outputs so that each metric fails for a known part of the rows.

@query("evaluate_retrieval", f"""
WITH {_EXACT.replace('THRESHOLD', '0')}, named AS (
  SELECT e.query_id, count(*) AS n, bool_or(d.ingredient_kor_name = 'Name-' || e.query_id) AS found,
         bool_or(d.ingredient_kor_name = 'Name-7') AS forbidden
  FROM exact e JOIN {{docs}} d ON d.row = e.row GROUP BY 1)
SELECT q.query_id AS case_id, n IS NOT NULL AS type_correct, coalesce(found, false) AS name_found,
       NOT coalesce(forbidden, false) AS forbidden_absent,
       n IS NOT NULL AND coalesce(found, false) AND NOT coalesce(forbidden, false) AS case_correct
FROM {{search_queries}} q LEFT JOIN named USING (query_id)""")
def _(t):
    from ..operators.retrieval import exact_retrieve

    hits = exact_retrieve(t.search_queries, t.docs).join(t.docs.drop("vector"), "row")
    outputs = hits.groupBy(F.col("query_id").alias("case_id")).agg(
        F.collect_list("retrieval_type").alias("retrieval_types"),
        F.collect_list("ingredient_kor_name").alias("document_names"))
    gold = t.search_queries.select(
        F.col("query_id").alias("case_id"), F.lit("exact_match").alias("expected_retrieval_type"),
        F.concat(F.lit("Name-"), F.col("query_id").cast("string")).alias("expected_name"),
        F.array(F.lit("Name-7")).alias("forbidden_names"))
    return evaluate.evaluate(outputs, gold, evaluate.retrieval_metrics())


@query("evaluate_routing", f"""
WITH {_ROUTES}
SELECT conv_id * 1000 + turn AS case_id, route = 'general_answer' AS route_correct, route <> 'safety_warning' AS warning_correct,
       route = 'general_answer' AS case_correct FROM routed""")
def _(t):
    rows = _routed(t).withColumn("case_id", F.col("conv_id") * 1000 + F.col("turn"))
    gold = rows.select("case_id", F.lit("general_answer").alias("expected_route"), F.lit(False).alias("expected_has_warning"))
    outputs = rows.select("case_id", "route", (F.size("warnings") > 0).alias("has_warning"))
    return evaluate.evaluate(outputs, gold, evaluate.routing_metrics())


@query("evaluate_regulation", f"""
WITH {_REG_INDEX}, {_ITEMS},
m AS (SELECT product_id, count(*) AS n, bool_and(matched_name = 'red bolt Brand#1') AS named,
        bool_and(source_id = 'SRC-1') AS sourced, bool_and(max_concentration IS NOT NULL OR product_scope IS NOT NULL
          OR use_conditions IS NOT NULL OR warning_text IS NOT NULL) AS based,
        n = 1 AND bool_and(regulation_type = 'restricted') AS typed
      FROM item_keys JOIN reg_index USING (key) GROUP BY 1),
c AS (SELECT product_id AS case_id, coalesce(n, 0) = 5 AS count_correct, coalesce(named, false) AS names_correct,
             coalesce(typed, false) AS types_correct, coalesce(sourced, true) AS source_correct,
             coalesce(based, true) AS basis_correct, true AS match_types_allowed
      FROM {{requests}} LEFT JOIN m USING (product_id))
SELECT *, count_correct AND names_correct AND types_correct AND source_correct AND basis_correct AS case_correct FROM c""")
def _(t):
    from ..operators.matching import regulation_totals

    outputs = regulation_totals(t.items, t.regulations, quality.has_basis()).withColumnRenamed("product_id", "case_id")
    gold = t.requests.select(
        F.col("product_id").alias("case_id"), F.lit(5).alias("expected_match_count"),
        F.array(F.lit("red bolt Brand#1")).alias("expected_names"),
        F.array(F.lit("restricted")).alias("expected_regulation_types"),
        F.lit("SRC-1").alias("expected_source_id"), F.lit(True).alias("expected_has_decision_basis"))
    metrics = evaluate.regulation_metrics(counted=True)
    return evaluate.evaluate(outputs, gold, metrics).select("case_id", *metrics, "case_correct")


# Gold that repeats the outputs for even products and differs for odd ones.
@query("evaluate_allergen", """
SELECT product_id AS case_id, product_id % 2 = 0 AS names_correct, product_id % 2 = 0 AS case_correct
FROM (SELECT DISTINCT product_id FROM {mixed_items} JOIN {allergens} ON name = cas_numbers[1])""")
def _(t):
    from ..operators.matching import match_allergens_by_cas

    m = match_allergens_by_cas(t.mixed_items, t.allergens)
    outputs = m.groupBy(F.col("product_id").alias("case_id")).agg(
        F.count("*").alias("match_count"), F.collect_list("ingredient_kor_name").alias("matched_names"),
        F.collect_list("match_type").alias("match_types"), F.collect_list("source_id").alias("source_ids"),
        F.collect_list("rinse_off_threshold").alias("rinse_off_thresholds"),
        F.collect_list(F.coalesce("leave_on_threshold", F.lit(""))).alias("leave_on_thresholds"))
    gold = outputs.select(
        "case_id", F.col("match_count").alias("expected_match_count"),
        F.when(F.col("case_id") % 2 == 0, F.reverse("matched_names")).otherwise(
            F.concat("matched_names", F.array(F.lit("y")))).alias("expected_names"),
        F.col("match_types").alias("expected_match_types"), F.lit("ALG-1").alias("expected_source_id"),
        F.col("rinse_off_thresholds").alias("expected_rinse_off_thresholds"),
        F.reverse("leave_on_thresholds").alias("expected_leave_on_thresholds"))
    return evaluate.evaluate(outputs, gold, evaluate.allergen_metrics()).select("case_id", "names_correct", "case_correct")


@query("evaluate_state", """
WITH c AS (SELECT doc_id AS case_id, quality = 1 AS route_correct, true AS ingredient_count_correct, doc_id % 5 > 0 AS answer_exists,
  true AS retrieval_counts_consistent, quality = 1 OR doc_id % 3 > 0 AS context_consistent, quality = 1 AS rag_usage_correct FROM {labels})
SELECT *, route_correct AND answer_exists AND context_consistent AS case_correct FROM c""")
def _(t):
    rag = F.col("quality") == 1
    rows = t.labels.select(
        F.col("doc_id").alias("case_id"), F.when(rag, "ingredient_rag").otherwise("general_answer").alias("route"),
        F.lit(2).alias("ingredient_count"), (F.col("doc_id") % 5 > 0).alias("answer_exists"),
        F.when(rag, 3).alias("retrieved_doc_count"), F.when(rag, 1).alias("exact_match_count"),
        F.when(rag, 2).alias("vector_fallback_count"), F.when(rag, False).alias("context_empty"),
        F.when(rag, 40).when(F.col("doc_id") % 3 == 0, 1).alias("context_char_count"), rag.alias("used_rag_context"))
    gold = t.labels.select(
        F.col("doc_id").alias("case_id"), F.lit("ingredient_rag").alias("expected_route"),
        F.lit(2).alias("expected_ingredient_count"), F.lit(True).alias("expected_uses_rag"))
    return evaluate.evaluate(rows, gold, evaluate.state_metrics()).select(
        "case_id", *evaluate.state_metrics(), "case_correct")


@query("evaluate_report", """
WITH r AS (SELECT product_id, count(*) AS n FROM {mixed_items} JOIN {regulations} ON
  list_contains(regexp_extract_all(cas_no, '[0-9]{2,7}-[0-9]{2}-[0-9]'), name) GROUP BY 1)
SELECT product_id AS case_id, product_id % 3 > 0 AS regulation_count_consistent, true AS regulations_correct, true AS empty_arrays_correct FROM r""")
def _(t):
    from ..operators.matching import match_regulations_by_cas

    m = match_regulations_by_cas(t.mixed_items, t.regulations)
    item = F.struct("matched_name", "regulation_type", "max_concentration", "source_id")
    outputs = m.groupBy(F.col("product_id").alias("case_id")).agg(
        F.collect_list(item).alias("regulations"), F.count("*").alias("regulation_count"),
        F.collect_list(F.size(quality.missing_fields(m, quality.REGULATION_PROVENANCE)) == 0).alias("regulation_source_flags"),
        F.collect_list(quality.has_basis()).alias("regulation_basis_flags"))
    none = F.from_json(F.lit("[]"), "array<struct<ingredient_kor_name:string,source_id:string>>")
    outputs = outputs.withColumns({
        "allergens": none, "allergen_count": F.lit(0), "allergen_source_flags": F.array().cast("array<boolean>"),
        "allergen_thresholds": none, "status_code": F.lit(200), "schema_valid": F.lit(True),
        "required_fields_present": F.lit(True)})
    gold = outputs.select(
        "case_id", F.lit(200).alias("expected_status_code"), F.reverse("regulations").alias("expected_regulations"),
        (F.col("regulation_count") + F.when(F.col("case_id") % 3 == 0, 1).otherwise(0)).alias("expected_regulation_count"),
        none.alias("expected_allergens"), F.lit(0).alias("expected_allergen_count"),
        none.alias("expected_allergen_thresholds"), F.array(F.lit("allergens")).alias("expected_empty_fields"))
    return evaluate.evaluate(outputs, gold, evaluate.report_metrics()).select(
        "case_id", "regulation_count_consistent", "regulations_correct", "empty_arrays_correct")


@query("evaluate_response", """
WITH c AS (SELECT conv_id * 1000 + turn AS case_id, true AS route_correct, conv_id % 2 = 0 AS warning_priority_correct,
  contains(text, 'the') OR contains(text, 'la') AS guidance_present, true AS no_definitive_diagnosis,
  turn % 3 > 0 AS no_guaranteed_causation, true AS regulation_language_correct, true AS allergen_language_correct,
  contains(text, 'en') OR contains(text, 'is') AS limitations_present, conv_id % 7 > 0 AS no_needless_warning FROM {conversations})
SELECT *, warning_priority_correct AND guidance_present AND no_guaranteed_causation AND limitations_present AND no_needless_warning
  AS case_correct FROM c""")
def _(t):
    rows = t.conversations.withColumn("case_id", F.col("conv_id") * 1000 + F.col("turn"))
    answer = F.concat(F.when(F.col("conv_id") % 2 == 0, "사용을 중단하세요. ").otherwise(""), "text",
                      F.when(F.col("turn") % 3 == 0, " 명백한  원인").otherwise(""))
    none = F.array().cast("array<string>")
    outputs = rows.select(
        "case_id", F.lit("safety_warning").alias("route"), F.lit(True).alias("has_warning"),
        F.array(F.lit("w")).alias("warnings"), answer.alias("answer"), none.alias("regulation_types"),
        none.alias("allergen_names"), none.alias("allergen_thresholds"))
    gold = rows.select(
        "case_id", F.lit("safety_warning").alias("expected_route"), F.lit(True).alias("expected_has_warning"),
        F.lit("emergency").alias("case_category"),
        F.array(F.array(F.lit("the"), F.lit("la"))).alias("required_guidance_groups"),
        F.array(F.array(F.lit("en"), F.lit("is"))).alias("required_limitation_groups"),
        F.lit(None).cast("string").alias("expected_regulation_type"), none.alias("expected_allergen_names"),
        (F.col("conv_id") % 7 == 0).alias("expected_no_unnecessary_warning"))
    return evaluate.evaluate(outputs, gold, evaluate.response_metrics()).select(
        "case_id", *evaluate.response_metrics(), "case_correct")


@query("suite_summary", """
SELECT 'q' AS metric, count(*) AS n_cases, avg(CAST(quality AS DOUBLE)) AS rate FROM {labels} UNION ALL
SELECT 't', count(*), avg(CAST(toxic AS DOUBLE)) FROM {labels}""")
def _(t):
    return evaluate.suite_summary(t.labels.select(
        F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")))


