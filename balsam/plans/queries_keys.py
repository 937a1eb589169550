"""Queries of the normalisation policies, the splitters and the shared window and set helpers."""

from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import normalise, windows
from . import views  # noqa: F401
from .duck import clean, comma_chunks, dictionary_key, fold, item_key, registry_key, retrieval_key, rule_key, squeeze
from .registry import query, view

# Names in the shapes the policies care about, from the whole part table.
view("names", f"""
SELECT p_partkey,
       CASE WHEN p_size % 8 = 0 THEN '[' || p_type || '] [New] ' || p_name || ' ' || p_brand
            WHEN p_size % 8 = 1 THEN ' ' || upper(p_name) || '  /  ' || p_brand || '  '
            WHEN p_size % 8 = 2 THEN p_name || '·' || p_brand || ', No. ' || CAST(p_size AS STRING)
            WHEN p_size % 8 = 3 THEN p_name || ' (CI ' || CAST(10000 + p_partkey AS STRING) || ')'
            WHEN p_size % 8 = 4 THEN '[' || p_brand || ']'
            WHEN p_size % 8 = 5 THEN p_name || '–' || p_type || '_' || p_brand || ' (' || p_type || ')'
            WHEN p_size % 8 = 6 THEN '0' || CAST(p_size AS STRING) || '호 ' || p_name
            ELSE 'Straße ' || p_name || ' ' || {views.cas('p_partkey')} || ' / ' || {views.cas('p_size')}
       END AS name
FROM {{part}}
""")

# Option names with promotion words, package words, shade codes and units.
view("option_names", """
SELECT p_partkey,
       CASE WHEN p_size % 6 = 0 THEN '[기획] ' || lpad(CAST(p_size AS STRING), 3, '0') || '호 ' || p_name
            WHEN p_size % 6 = 1 THEN '단품 ' || p_brand || '_' || p_name || ' 본품+리필'
            WHEN p_size % 6 = 2 THEN '[' || p_brand || '] ' || p_name || ' (리필)'
            WHEN p_size % 6 = 3 THEN 'N0' || CAST(p_size AS STRING)
            WHEN p_size % 6 = 4 THEN '0' || CAST(p_size AS STRING) || 'n'
            ELSE p_name END AS name
FROM {part}
""")


def _policy(name: str, sql: str | None, source: str = "names"):
    @query(name, sql and f"SELECT p_partkey, {sql} AS key FROM {{{source}}}")
    def _(t):
        return normalise.add_keys(getattr(t, source), {"key": ("name", name)}).select(
            "p_partkey", "key")


_BLOCKS = "'^(?:[ ]*\\[[^\\[\\]]*\\])+[ ]*'"
_policy("clean_text", clean("name"))
_policy("retrieval_key", retrieval_key("name"))
_policy("registry_key", registry_key("name"))
_policy("cas_key", f"replace({clean('name')}, ' ', '')")
_policy("item_key", item_key("name"))
_policy("product_name_key",
        f"coalesce(nullif(trim(regexp_replace({fold(clean('name'))}, {_BLOCKS}, '')), ''), "
        f"{fold(clean('name'))})")
_policy("rule_key", rule_key("name"))
_policy("dictionary_key", dictionary_key("name"))
_policy("full_label_key", squeeze(fold("trim(name)")))
_LABEL = f"regexp_replace({fold('name')}, '[\\s\\[\\](){{}}·ㆍ_/,.\\\\\\-:;]+', '', 'g')"
_policy("option_label_key", _LABEL)
_policy("header_label_key", "trim(regexp_replace(regexp_replace(trim(" + fold(clean("name"))
        + ", '[](){}:;·-–—.,★# '), '^0+([0-9])', '\\1'), '([0-9])\\s*호(\\s|$)', '\\1\\2', 'g'))")

# Marketing text removed case by case, as the shapes of `option_names` require.
_BARE = """CASE WHEN p_size % 6 = 0 THEN lpad(CAST(p_size AS STRING), 3, '0') || SEP || p_name
     WHEN p_size % 6 = 1 THEN p_brand || SEP || p_name
     WHEN p_size % 6 = 2 THEN LEFTB || p_brand || RIGHTB || SEP || p_name
     WHEN p_size % 6 = 3 THEN 'N0' || CAST(p_size AS STRING)
     WHEN p_size % 6 = 4 THEN '0' || CAST(p_size AS STRING) || 'n'
     ELSE regexp_replace(p_name, '^new ', '') END"""


def _bare(sep, left, right):
    return _BARE.replace("SEP", f"'{sep}'").replace("LEFTB", f"'{left}'").replace("RIGHTB", f"'{right}'")


_MAPPED = f"lower(replace(replace({_bare('', '', '')}, ' ', ''), '#', '#'))"


@query("option_mapping_key", f"SELECT p_partkey, {_MAPPED} AS key FROM {{part}}")
def _(t):
    return t.option_names.select("p_partkey", keys.option_mapping_key("name").alias("key"))


@query("option_display_name", f"SELECT p_partkey, {_bare(' ', '[', ']')} AS key FROM {{part}}")
def _(t):
    return t.option_names.select("p_partkey", keys.option_display_name("name").alias("key"))


@query("shade_code_key", """
SELECT p_partkey, CASE WHEN p_size % 6 = 3 THEN 'n' || CAST(p_size AS STRING)
     WHEN p_size % 6 = 4 THEN CAST(p_size AS STRING) || 'n'
     WHEN p_size % 6 = 0 THEN CAST(p_size AS STRING) || replace(p_name, ' ', '')
     ELSE """ + _MAPPED + " END AS key FROM {part}")
def _(t):
    return t.option_names.select("p_partkey", keys.shade_code_key("name").alias("key"))


@query("split_cas", f"""
SELECT p_partkey, array_to_string(regexp_extract_all({clean('name')},
       '\\b[0-9]{{2,7}}-[0-9]{{2}}-[0-9]\\b'), '|') AS numbers
FROM {{names}}""")
def _(t):
    return t.names.select("p_partkey", F.array_join(keys.split_cas("name"), "|").alias("numbers"))


@query("rule_match_keys", f"""
SELECT DISTINCT p_partkey, key FROM (
  SELECT p_partkey, {rule_key('name')} AS key FROM {{names}} UNION ALL
  SELECT p_partkey, replace(lower(unnest(regexp_extract_all(name, '(?i)\\bCI\\s*[0-9:]+\\b'))), ' ', '')
  FROM {{names}})
WHERE key <> ''""")
def _(t):
    return t.names.select("p_partkey", F.explode(keys.rule_match_keys("name")).alias("key"))


@query("dictionary_key_without_code", """
SELECT p_partkey, CASE WHEN p_size % 8 = 3 THEN replace(p_name, ' ', '') END AS key FROM {part}""")
def _(t):
    return t.names.select("p_partkey", keys.dictionary_key_without_code("name").alias("key"))


@query("search_intent_query", """
SELECT conv_id, turn, trim(regexp_replace(replace(text, '"', ''), '\\s+', ' ', 'g')) AS query
FROM {conversations} WHERE role = 'user'""")
def _(t):
    asked = t.conversations.filter("role = 'user'").select(
        "conv_id", "turn", F.concat(
            F.lit('"'), "text", F.lit('"'),
            F.when(F.col("conv_id") % 2 == 0, "을 성분 분석해 줘?").otherwise(" 괜찮은지 알려줘"),
        ).alias("text"))
    return asked.select("conv_id", "turn", keys.search_intent_query("text").alias("query"))


@query("parse_price", """
SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS sale_price,
       CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) * 1000
            ELSE CAST(floor(p_retailprice) AS BIGINT) END AS original_price
FROM {part}""")
def _(t):
    shown = t.part.select(
        "p_partkey", F.concat(F.format_number(F.floor("p_retailprice"), 0), F.lit("원")).alias("cur"),
        F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit(",000 won"))).otherwise("-").alias("org"))
    sale = keys.parse_price("cur")
    return shown.select("p_partkey", sale.alias("sale_price"),
                        F.coalesce(keys.parse_price("org"), sale).alias("original_price"))


@query("coerce_flag", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true
                  WHEN 3 THEN false END AS flag FROM {part}""")
def _(t):
    words = F.array(*[F.lit(w) for w in (" Y", "n ", "TRUE", "0", "maybe", "")])
    return t.part.select("p_partkey", keys.coerce_flag(
        F.get(words, F.col("p_size") % 6)).alias("flag"))


@query("key_collisions", f"""
WITH spelt AS (SELECT name AS spelling, {registry_key('name')} AS key, count(*) AS n_rows
               FROM {{items}} GROUP BY 1, 2)
SELECT key, spelling, n_rows, n_spellings FROM (
  SELECT *, count(*) OVER (PARTITION BY key) AS n_spellings FROM spelt WHERE key <> '')
WHERE n_spellings > 1""")
def _(t):
    return normalise.key_collisions(t.items, "name", "registry_key")


# --- splitting -----------------------------------------------------------------------------

# Documents whose every third comma is put in brackets and every fifth between digits.
@query("split_simple", f"""
SELECT doc_id, pos, name FROM (
  SELECT doc_id, unnest(parts) AS name, generate_subscripts(parts, 1) AS pos FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: {clean('x')}),
                               lambda x: x <> '') AS parts FROM {{documents}}))""")
def _(t):
    parts = text.split_simple(F.regexp_replace("text", ",", "，"))
    return t.documents.select("doc_id", F.posexplode(parts).alias("p", "name")).select(
        "doc_id", (F.col("p") + 1).alias("pos"), "name")


@query("split_ingredients", f"""
WITH source AS (SELECT doc_id, regexp_replace(replace(text, 'the', '1,2-diol, the'), '([a-z]), ([a-z]+)',
                  '\\1 (x, [y, z], \\2) ', 'g') AS text FROM {{documents}}),{comma_chunks('source')}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS pos, name FROM (
  SELECT doc_id, chunk_index, regexp_replace(chunk, '^\\s+|\\s+$', '', 'g') AS name FROM c) WHERE name <> ''""")
def _(t):
    source = F.regexp_replace(
        F.replace("text", F.lit("the"), F.lit("1,2-diol, the")),
        "([a-z]), ([a-z]+)", "$1 (x, [y, z], $2) ")
    return t.documents.select(
        "doc_id", F.posexplode(text.split_ingredients(source)).alias("p", "name")
    ).select("doc_id", (F.col("p") + 1).alias("pos"), "name")


@query("resolve_ingredients", f"""
WITH lists AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN string_split(text, ' ')
         ELSE string_split(text, ',') END AS parts FROM {{conversations}}),
names AS (
  SELECT conv_id, turn, {clean('name')} AS name, pos FROM (
    SELECT conv_id, turn, unnest(parts) AS name, generate_subscripts(parts, 1) AS pos FROM lists))
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY first_pos) AS pos, name
FROM (SELECT conv_id, turn, name, min(pos) AS first_pos FROM names WHERE name <> ''
      GROUP BY ALL)""")
def _(t):
    from ..operators.requests import resolve_ingredients

    asked = t.conversations.select(
        "conv_id", "turn", "text",
        F.when(F.col("role") == "user", F.split("text", " ")).alias("ingredients"))
    out = resolve_ingredients(asked, "ingredients", "text")
    return out.select("conv_id", "turn", F.posexplode("ingredient_names").alias("p", "name")).select(
        "conv_id", "turn", (F.col("p") + 1).alias("pos"), "name")


# --- windows and sets --------------------------------------------------------------------------

_POS = "CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 10000 + l_suppkey"
view("lines", f"SELECT l_orderkey, {_POS} AS pos, l_linenumber, l_returnflag, l_linestatus, "
     "CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS mark FROM {lineitem}")


@query("forward_fill", """
SELECT l_orderkey, pos, last_value(mark IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos) AS mark
FROM {lines}""")
def _(t):
    return windows.forward_fill(t.lines, "l_orderkey", "pos", ["mark"]).select(
        "l_orderkey", "pos", "mark")


@query("keep_first", """
SELECT l_orderkey, l_returnflag, min(pos) AS pos FROM {lines} GROUP BY 1, 2""")
def _(t):
    return windows.keep_first(t.lines, ["l_orderkey", "l_returnflag"], "pos").select(
        "l_orderkey", "l_returnflag", "pos")


@query("top_k_per_key", """
SELECT l_returnflag, pos, row_number() OVER (PARTITION BY l_returnflag ORDER BY pos, l_orderkey) AS rank
FROM {lines} QUALIFY rank <= 5""")
def _(t):
    return windows.top_k(t.lines, "l_returnflag", ["pos", "l_orderkey"], 5, rank_col="rank").select(
        "l_returnflag", "pos", "rank")


@query("next_boundary", """
SELECT l_orderkey, pos, coalesce(lead(pos) OVER (PARTITION BY l_orderkey ORDER BY pos), -1) AS next_pos
FROM {lines}""")
def _(t):
    return windows.next_boundary(t.lines, "l_orderkey", "pos", F.lit(-1), "next_pos").select(
        "l_orderkey", "pos", "next_pos")


@query("running_groups", """
SELECT l_orderkey, pos, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (
  PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_id FROM {lines}""")
def _(t):
    return windows.running_groups(
        t.lines, "l_orderkey", "pos", F.col("l_returnflag") == "R", "section_id"
    ).select("l_orderkey", "pos", "section_id")


_PARTS_BY_BRAND = "SELECT p_brand, p_partkey, p_size, p_type FROM {part}"


@query("restart_groups", """
WITH m AS (SELECT *, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
             lag(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM {part})
SELECT p_brand, p_partkey, sum(CASE WHEN p_size <= top AND p_type IS DISTINCT FROM before THEN 1 ELSE 0 END)
  OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS group_id FROM m""")
def _(t):
    return windows.restart_groups(
        t.part, "p_brand", "p_partkey", "p_size", "p_type", "group_id"
    ).select("p_brand", "p_partkey", "group_id")


@query("contiguous_numbers", """
SELECT l_orderkey, count(*) AS n_rows, bool_and(l_linenumber = n) AS is_contiguous FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS n FROM {lines}) GROUP BY 1""")
def _(t):
    return windows.contiguous(t.lines, "l_orderkey", "pos", "l_linenumber")


@query("monotonic_numbers", """
SELECT p_brand, count(*) AS n_rows, bool_and(coalesce(p_size >= before, true)) AS is_monotonic FROM (
  SELECT *, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM {part}) GROUP BY 1""")
def _(t):
    return windows.monotonic(t.part, "p_brand", "p_partkey", "p_size")


@query("global_number", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM {orders}""")
def _(t):
    return windows.global_number(t.orders, "o_orderkey", "n", bucket_rows=1000).select("o_orderkey", "n")


_SETS_SPARK = """
SELECT l_orderkey, collect_list(l_returnflag) AS a, collect_list(l_linestatus) AS b FROM {lines}
GROUP BY 1"""


@query("array_set_semantics", """
WITH s AS (SELECT l_orderkey, list(l_returnflag) AS a, list(l_linestatus) AS b FROM {lines} GROUP BY 1)
SELECT l_orderkey, list_sort(a) = list_sort(b) AS same_multiset,
       list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same_set,
       len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset,
       array_to_string(list_sort(list_distinct(list_concat(a, b))), '') AS united,
       array_to_string(list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x)))), '') AS common,
       array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), '') AS only_a
FROM s""")
def _(t):
    s = t.sql(_SETS_SPARK)
    return s.select(
        "l_orderkey", windows.multiset_equal("a", "b").alias("same_multiset"),
        windows.set_equal("a", "b").alias("same_set"), windows.is_subset("a", "b").alias("subset"),
        F.array_join(F.sort_array(windows.ordered_union("a", "b")), "").alias("united"),
        F.array_join(F.sort_array(F.array_intersect("a", "b")), "").alias("common"),
        F.array_join(F.sort_array(F.array_except("a", "b")), "").alias("only_a"),
    )


@query("tables_equal", """
WITH a AS (SELECT p_name, p_type, count(*) AS n FROM {part} GROUP BY 1, 2),
b AS (SELECT p_name, p_type, count(*) AS n FROM {part} WHERE p_size <> 7 GROUP BY 1, 2)
SELECT count(*) AS n_differences, count(*) = 0 AS is_equal
FROM a FULL JOIN b USING (p_name, p_type) WHERE a.n IS DISTINCT FROM b.n""")
def _(t):
    a = t.part.select("p_name", "p_type")
    return windows.tables_equal(a, t.part.filter("p_size <> 7").select("p_name", "p_type"))
