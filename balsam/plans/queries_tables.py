"""Queries of the readers and of the table changes."""

import uuid

from pyspark.sql import functions as F

from ..functions import keys
from ..functions.settle import checkpoint_dir
from ..operators.store import OPTION_METADATA  # noqa: F401
from ..sources import readers, writers
from . import views  # noqa: F401
from .duck import clean
from .registry import query, view
from .views import AS_OF

_NOW = f"TIMESTAMP '{AS_OF}'"
_UNTIL = "1999-12-31 00:00:00"
_END = f"TIMESTAMP '{_UNTIL}'"

# --- API pages ------------------------------------------------------------------------------------
# Fifty parts make a page; the page before the last is empty, so the last one is not read.
_FIELDS = "p_name AS INGR_KOR_NAME, ' ' || p_brand || '  x' AS INGR_ENG_NAME, CAST(p_partkey AS STRING) AS CAS_NO"
_LAST_SQL = "(SELECT CAST(floor(max(p_partkey) / 50) AS INT) - 1 FROM {part})"


def _pages(t, kind: str):
    rows = t.part.select(
        F.floor(F.col("p_partkey") / 50).cast("int").alias("page_no"), "p_partkey",
        F.struct(F.col("p_name").alias("INGR_KOR_NAME"), F.concat(F.lit(" "), "p_brand", F.lit("  x")).alias("INGR_ENG_NAME"),
                 F.col("p_partkey").cast("string").alias("CAS_NO")).alias("item"))
    last = t.part.agg(F.floor(F.max("p_partkey") / 50).cast("int") - 1).first()[0]
    grouped = rows.groupBy("page_no").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "item"))).alias("l")).select(
        "page_no", F.when(F.col("page_no") == last, F.slice("l", 1, 0)).otherwise(F.col("l")).alias("l")).select(
        "page_no", F.transform("l", lambda x: x["item"]).alias("items"))
    if kind == "json":
        items = F.to_json("items")
        one = F.to_json(F.get("items", F.lit(0)))
        n = F.col("page_no") % 4
        payload = (
            F.when(n == 0, F.concat(F.lit('{"response":{"body":{"items":'), items, F.lit("}}}")))
            .when(n == 1, F.concat(F.lit('{"items":{"item":'), items, F.lit("}}")))
            .when(n == 2, F.concat(F.lit('{"body":{"items":'), items, F.lit("}}")))
            .otherwise(F.concat(F.lit('{"response":{"body":{"items":{"item":'), one, F.lit("}}}}"))))
    else:
        body = F.array_join(F.transform("items", lambda i: F.concat(
            F.lit("<item><INGR_KOR_NAME>"), i["INGR_KOR_NAME"], F.lit("</INGR_KOR_NAME><INGR_ENG_NAME>"), i["INGR_ENG_NAME"],
            F.lit("</INGR_ENG_NAME><CAS_NO>"), i["CAS_NO"], F.lit("</CAS_NO></item>"))), "")
        code = F.when((F.col("page_no") % 7 == 3) & (F.col("page_no") != last), "99").otherwise("00")
        payload = F.concat(F.lit("<response><header><resultCode>"), code, F.lit("</resultCode><resultMsg>m</resultMsg></header><body><items>"),
                           body, F.lit("</items></body></response>"))
    return grouped.select("page_no", payload.alias("payload"))


def _page_sql(keep: str, single: str) -> str:
    return f"""
SELECT page_no, item_no, ingredient_kor_name, ingredient_eng_name, cas_no FROM (
  SELECT CAST(floor(p_partkey / 50) AS INT) AS page_no, CAST(p_partkey % 50 AS INT) AS item_no, p_name AS ingredient_kor_name,
         p_brand || ' x' AS ingredient_eng_name, CAST(p_partkey AS STRING) AS cas_no FROM {{part}})
WHERE page_no < {_LAST_SQL} AND {keep} AND ({single})"""


_ITEM = ["page_no", "item_no", "ingredient_kor_name", "ingredient_eng_name", "cas_no"]


@query("parse_json_pages", _page_sql("true", "page_no % 4 <> 3 OR item_no = 0"))
def _(t):
    return readers.parse_json_pages(_pages(t, "json")).select(*_ITEM)


@query("parse_xml_pages", _page_sql("page_no % 7 <> 3", "true"))
def _(t):
    return readers.parse_xml_pages(_pages(t, "xml"), on_error="skip").select(*_ITEM)


@query("xml_errors", """
SELECT DISTINCT CAST(floor(p_partkey / 50) AS INT) AS page_no, '99' AS result_code, 'm' AS result_msg FROM {part}
WHERE CAST(floor(p_partkey / 50) AS INT) % 7 = 3 AND CAST(floor(p_partkey / 50) AS INT) <> """ + _LAST_SQL)
def _(t):
    return readers.xml_errors(_pages(t, "xml"))


@query("parse_pages", _page_sql("(page_no % 2 = 0 OR page_no % 7 <> 3)", "true"))
def _(t):
    mixed = _pages(t, "json").filter("page_no % 2 = 0").unionByName(_pages(t, "xml").filter("page_no % 2 = 1"))
    return readers.parse_pages(mixed, on_error="skip").select(*_ITEM)


# --- manifests and pages -----------------------------------------------------------------------------------
_M = "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'elsewhere' ELSE ' shop ' END AS source, " \
     "CASE WHEN p_size % 10 = 2 THEN 'twice' ELSE CAST(p_partkey AS STRING) END AS external_product_id, " \
     "'https://' || CASE WHEN p_size % 10 = 1 THEN 'evil.com' ELSE 'www.shop.test' END || '/goods/detail.do?x=1&goodsNo=' || " \
     "CASE WHEN p_size % 10 = 2 THEN 'twice' WHEN p_size % 10 = 3 THEN 'other' ELSE CAST(p_partkey AS STRING) END AS product_url FROM {part}"


@query("check_manifest", """
SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'source not supported' WHEN 1 THEN 'url not supported'
  WHEN 3 THEN 'url id differs' WHEN 2 THEN 'duplicate entry' END AS reason FROM {part}""")
def _(t):
    return readers.check_manifest(
        t.sql(_M), sources=["shop"], host="shop.test", path_suffix="/goods/detail.do", id_parameter="goodsNo"
    ).select("p_partkey", "reason")


# Title, heading and language of the raw pages; the id is the page number in the url's query.
@query("extract_page_fields", f"""
SELECT page_id, nullif({clean("replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), '&#39;', '''')")}, '') AS product_name,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS external_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS brand_name,
  CASE WHEN regexp_extract(html, '<title>(.*?)</title>', 1) = '' THEN 'url or name missing'
       WHEN regexp_extract(url, '[?&]page=([^&#]*)', 1) = '' THEN 'product id missing' END AS reason
FROM {{pages}}""")
def _(t):
    rules = {
        "product_url": F.col("url"),
        "product_name": F.nullif(readers.html_text(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)), F.lit("")),
        "brand_name": readers.attribute("html", "lang", "html"),
        "image_url": readers.attribute("html", "src", "img"),
        "category_path": readers.class_text("html", "ad"),
        "original_price": readers.class_text("html", "org"), "sale_price": readers.class_text("html", "cur"),
    }
    return readers.extract_page_fields(t.pages, rules, "http://example.com", "page").select(
        "page_id", "product_name", "external_id", "brand_name", "reason")


# Product cards written around the parts.
view("cards", """
SELECT p_partkey AS rank, '<li class="item"><a class="x prd_thumb" href="/store/d.do?goodsNo=A' || CAST(p_partkey AS STRING)
  || '"><img src="//img/' || CAST(p_partkey AS STRING) || '.jpg"></a><p class="tx_brand">' || p_brand || '</p><p class="tx_name">'
  || p_name || ' &amp; co</p>' || CASE WHEN p_size % 2 = 0 THEN '<span class="tx_org">1,' || lpad(CAST(p_size AS STRING), 3, '0') || '원</span>' ELSE '' END
  || '<span class="tx_cur">' || CAST(p_size AS STRING) || '00원</span></li>' AS html, p_brand AS search_query FROM {part}
""")


@query("extract_card_fields", """
SELECT p_partkey AS rank, p_brand AS search_query, 'https://shop.test/store/d.do?goodsNo=A' || CAST(p_partkey AS STRING) AS product_url,
  'A' || CAST(p_partkey AS STRING) AS external_id, p_name || ' & co' AS product_name, p_brand AS brand_name,
  'https://img/' || CAST(p_partkey AS STRING) || '.jpg' AS image_url,
  CASE WHEN p_size % 2 = 0 THEN 1000 + p_size ELSE p_size * 100 END AS original_price, p_size * 100 AS sale_price FROM {part}""")
def _(t):
    rules = {
        "product_url": readers.attribute("html", "href", "a"), "product_name": readers.class_text("html", "tx_name"),
        "brand_name": readers.class_text("html", "tx_brand"), "image_url": readers.attribute("html", "src", "img"),
        "category_path": readers.attribute("html", "data-category", "li"),
        "original_price": readers.class_text("html", "tx_org"), "sale_price": readers.class_text("html", "tx_cur"),
    }
    return readers.extract_page_fields(t.cards, rules, "https://shop.test", "goodsNo").drop("category_path", "reason")


# Scripts with the options of a product nested under it; every third script hides them in a string,
# and every fifth product's options have no owner.
def _scripts(t):
    option = F.struct(
        F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("optionNumber"), F.col("p_name").alias("optionName"),
        F.when(F.col("p_size") % 2 == 0, "Y").otherwise("N").alias("soldOutFlag"),
        F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("sortSeq"), F.array("p_type").alias("combinationOptionName"))
    rows = t.part.select(F.floor(F.col("p_partkey") / 5).cast("bigint").alias("product_id"), "p_partkey", option.alias("o"))
    lists = rows.groupBy("product_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("p_partkey", "o"))), lambda x: x["o"])).alias("o"))
    owner = F.when(F.col("product_id") % 5 == 0, "").otherwise(
        F.concat(F.lit('"goodsNumber":"'), F.col("product_id").cast("string"), F.lit('",')))
    body = F.concat(F.lit('{"product":{'), owner, F.lit('"combinationOptionFlag":true,"optionList":'), "o", F.lit("}}"))
    hidden = F.concat(F.lit(readers.PUSH_MARKER + '[1,"5:'), F.replace(body, F.lit('"'), F.lit('\\"')), F.lit('"])'))
    other = F.lit('var x = {"product":{"goodsNumber":"other","optionList":[{"optionNumber":"Z","optionName":"z"}]}};')
    return lists.select("product_id", F.posexplode(F.array(
        other, F.when(F.col("product_id") % 3 == 0, hidden).otherwise(F.concat(F.lit("window.data = "), body, F.lit(";"))))).alias(
        "script_no", "script"))


@query("extract_embedded_json", """
SELECT CAST(floor(p_partkey / 5) AS BIGINT) AS product_id, row_number() OVER (PARTITION BY floor(p_partkey / 5)
    ORDER BY CASE WHEN p_size % 5 > 0 THEN p_size END NULLS LAST, 'N' || CAST(p_partkey AS STRING)) AS seq,
  'N' || CAST(p_partkey AS STRING) AS option_number, p_name AS option_name, p_size % 2 = 0 AS sold_out_flag,
  CASE WHEN p_size % 5 > 0 THEN p_size END AS sort_order, true AS combination_option_flag, p_type AS group_path FROM {part}""")
def _(t):
    return readers.extract_embedded_json(_scripts(t)).select(
        "product_id", "seq", "option_number", "option_name", "sold_out_flag", "sort_order", "combination_option_flag",
        F.array_join("group_path", ">").alias("group_path"))


@query("split_rule_documents", """
SELECT 'r' || CAST(p_partkey AS STRING) AS rule_id, p_type AS canonical_group, p_name AS alias, 0 AS n_caution FROM {part}""")
def _(t):
    document = t.part.select(F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_type").alias("canonical_group"),
        F.array("p_name").alias("aliases"))).alias("rules"))).alias("j"))
    parsed = document.select(F.from_json("j", readers.RULE_DOCUMENT).alias("d")).select("d.*")
    _s, _p, rules = readers.split_rule_documents(parsed)
    return rules.select("rule_id", "canonical_group", F.element_at("aliases", 1).alias("alias"),
                        F.size("caution_for").alias("n_caution"))


# --- corpus texts -------------------------------------------------------------------------------------------

@query("text_corpus", """
SELECT row_number() OVER (ORDER BY doc_id) AS n, '[성분 데이터 ' || CAST(row_number() OVER (ORDER BY doc_id) AS STRING) || ']\n'
  || text || '\n' AS value FROM {documents}""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("row"), F.col("text").alias("content"))
    return writers.text_corpus(docs, bucket_rows=128)


@query("backfill_derived", """
SELECT o_orderkey AS product_id, lower(o_orderpriority) AS name_key FROM {orders} WHERE o_custkey % 4 > 0""")
def _(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("product_id"), F.col("o_orderpriority").alias("product_name"),
        F.when(F.col("o_custkey") % 4 == 0, F.lower("o_orderpriority")).when(F.col("o_custkey") % 4 == 1, "old").alias("name_key"))
    return writers.backfill_derived(rows, "name_key", keys.product_name_key("product_name")).select("product_id", "name_key")


# --- products ---------------------------------------------------------------------------------------------
_INCOMING = "SELECT l_partkey * 100 + l_linenumber AS seq, ' shop' || CAST(o_custkey % 2 AS STRING) AS source, CASE WHEN l_linenumber = 7 " \
            "THEN 'new' || CAST(l_orderkey AS STRING) ELSE CAST(l_orderkey AS STRING) || ' ' END AS external_id, CAST(NULL AS STRING) AS brand_name, " \
            "'[x] Part ' || CAST(l_partkey AS STRING) || ' ' || CAST(l_linenumber AS STRING) AS product_name, 'c' AS category, 'p' AS category_path, 'u' AS product_url, 'i' AS image_url " \
            "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_quantity > 25"


@query("upsert_products", f"""
WITH inc AS (SELECT trim(source) AS source, trim(external_id) AS external_id, max(product_name) FILTER (true) AS x,
    max_by(product_name, seq) AS product_name FROM ({_INCOMING}) GROUP BY 1, 2)
SELECT coalesce(p.source, i.source) AS source, coalesce(p.external_id, i.external_id) AS external_id,
  CASE WHEN i.source IS NULL THEN p.product_name ELSE i.product_name END AS product_name,
  CASE WHEN i.source IS NULL THEN p.brand_name END AS brand_name,
  CASE WHEN i.source IS NULL THEN p.name_key ELSE lower(substr(i.product_name, 5)) END AS name_key,
  CASE WHEN i.source IS NULL THEN p.updated_at ELSE {_NOW} END AS updated_at, i.source IS NOT NULL AS changed
FROM {{products}} p FULL JOIN inc i ON p.source = i.source AND p.external_id = i.external_id""")
def _(t):
    return writers.upsert_products(t.products, t.sql(_INCOMING), AS_OF).select(
        "source", "external_id", "product_name", "brand_name", "name_key", "updated_at", "changed")


# --- records and items -------------------------------------------------------------------------------------
# One extraction per order: its lines are the new list, with a blank in the middle.
def _extractions(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    names = F.transform("l", lambda x: F.concat(F.lit(" Item "), x["l_partkey"].cast("string")))
    k = F.col("l_orderkey")
    return lines.select(
        k.alias("product_id"), F.when(k % 4 == 0, " AF").otherwise("").alias("option_id"), F.lit("n").alias("option_name"),
        F.when(k % 5 == 1, "  ").otherwise(F.concat(F.lit(" raw "), k.cast("string"))).alias("raw_ingredients"),
        F.when(k % 5 == 2, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit(" ")), names)).alias("ingredients"),
        (k % 5 != 3).alias("success"), F.when(k % 5 == 4, -k).otherwise(k).alias("result_product_id"),
        F.lit("m").alias("extraction_method"))


@query("check_records", """
SELECT DISTINCT l_orderkey AS product_id, CASE l_orderkey % 5 WHEN 3 THEN 'extraction failed' WHEN 1 THEN 'raw text blank'
  WHEN 2 THEN 'no ingredients' WHEN 4 THEN 'product differs' END AS reason FROM {lineitem}""")
def _(t):
    return writers.check_records(_extractions(t)).select("product_id", "reason")


_TOUCHED = """
touched AS (SELECT DISTINCT l_orderkey AS product_id, CASE WHEN l_orderkey % 4 = 0 THEN 'AF' ELSE '' END AS option_id
  FROM {lineitem} WHERE l_orderkey % 5 = 0)"""


@query("replace_records", f"""
WITH {_TOUCHED}
SELECT product_id, option_id, expires_at, NULL AS ingredient_hash FROM {{records}} ANTI JOIN touched USING (product_id, option_id)
UNION ALL SELECT product_id, option_id, {_END}, sha256('raw ' || CAST(product_id AS STRING)) FROM touched""")
def _(t):
    good = writers.check_records(_extractions(t)).filter("reason IS NULL")
    return writers.replace_records(t.records, good, AS_OF, _UNTIL).select(
        "product_id", "option_id", "expires_at", "ingredient_hash")


_NEW_ITEMS = """
SELECT product_id, option_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY l_linenumber, l_partkey) + 1 AS BIGINT) AS position,
  'Item ' || CAST(l_partkey AS STRING) AS ingredient_name, 'item' || CAST(l_partkey AS STRING) AS normalized_name
FROM touched JOIN {lineitem} ON l_orderkey = product_id"""


@query("replace_items", f"""
WITH {_TOUCHED}
SELECT * FROM {{record_items}} ANTI JOIN touched USING (product_id, option_id) UNION ALL {_NEW_ITEMS}""")
def _(t):
    good = writers.check_records(_extractions(t)).filter("reason IS NULL")
    return writers.replace_items(t.record_items, good)


# --- collections ----------------------------------------------------------------------------------------------
_HEADS = "SELECT o_orderkey AS product_id, CASE WHEN o_custkey % 10 = 0 THEN 'partial' WHEN o_orderkey % 4 = 0 THEN 'ready' " \
         "ELSE 'not_applicable' END AS status, 'v4' AS parser_version, '[]' AS options_json FROM {orders} WHERE o_orderkey % 5 IN (0, 1)"
_GOOD_C = """
good AS (SELECT o_orderkey AS product_id, CASE WHEN o_orderkey % 4 = 0 THEN 'ready' ELSE 'not_applicable' END AS status,
    CASE WHEN o_orderkey % 4 = 0 THEN 'AF' ELSE '' END AS option_id
  FROM {orders} WHERE o_orderkey % 5 = 0 AND o_custkey % 10 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM {lineitem}))"""


def _collected(t):
    return writers.replace_collection(
        t.records, t.record_items, t.states, t.queue, t.sql(_HEADS), _extractions(t), AS_OF, _UNTIL)


@query("check_collections", """
SELECT o_orderkey AS product_id, CASE WHEN o_custkey % 10 = 0 THEN 'status not finished' WHEN n IS NULL THEN 'no entries'
  WHEN o_orderkey % 5 = 1 THEN 'entry incomplete' END AS reason
FROM {orders} LEFT JOIN (SELECT DISTINCT l_orderkey AS n FROM {lineitem}) l ON n = o_orderkey WHERE o_orderkey % 5 IN (0, 1)""")
def _(t):
    return writers.check_collections(t.sql(_HEADS), _extractions(t)).select("product_id", "reason")


@query("replace_collection_records", f"""
WITH {_GOOD_C}
SELECT product_id, option_id, expires_at FROM {{records}} WHERE product_id NOT IN (SELECT product_id FROM good)
UNION ALL SELECT product_id, option_id, {_END} FROM good""")
def _(t):
    return _collected(t)["records"].select("product_id", "option_id", "expires_at")


@query("replace_collection_items", f"""
WITH {_GOOD_C}, touched AS (SELECT product_id, option_id FROM good)
SELECT * FROM {{record_items}} WHERE product_id NOT IN (SELECT product_id FROM good) UNION ALL {_NEW_ITEMS}""")
def _(t):
    return _collected(t)["items"]


@query("replace_collection_states", f"""
WITH {_GOOD_C}
SELECT product_id, status, option_count, parser_version, expires_at FROM {{states}} WHERE product_id NOT IN (SELECT product_id FROM good)
UNION ALL SELECT product_id, status, CASE WHEN option_id = '' THEN 0 ELSE 1 END, 'v4', {_END} FROM good""")
def _(t):
    return _collected(t)["states"].select("product_id", "status", "option_count", "parser_version", "expires_at")


@query("replace_collection_queue", f"""
WITH {_GOOD_C}
SELECT product_id, CASE WHEN g IS NULL THEN status ELSE 'complete' END AS status, CASE WHEN g IS NULL THEN next_retry_at END AS next_retry_at,
  attempt_count FROM {{queue}} LEFT JOIN (SELECT product_id AS g FROM good) ON g = product_id
UNION ALL SELECT product_id, 'complete', NULL, 0 FROM good WHERE product_id NOT IN (SELECT product_id FROM {{queue}})""")
def _(t):
    return _collected(t)["queue"].select("product_id", "status", "next_retry_at", "attempt_count")


_FIN = "SELECT o_orderkey AS product_id, 'ready' AS status, 'v5' AS parser_version, '[]' AS options_json FROM {orders} WHERE o_custkey % 2 = 0"


def _final(t):
    heads = t.sql(_FIN)
    ids = heads.select("product_id", F.explode(F.array(F.lit(" AF"), F.lit("RF "), F.lit("AF"))).alias("option_id"))
    return writers.finalize_collection(t.records, t.states, heads, ids, AS_OF, _UNTIL)


@query("finalize_collection_records", """
SELECT product_id, option_id FROM {records} JOIN {orders} ON o_orderkey = product_id
WHERE o_custkey % 2 = 1 OR option_id IN ('AF', 'RF')""")
def _(t):
    return _final(t)["records"].select("product_id", "option_id")


@query("finalize_collection_states", """
SELECT product_id, status, option_count, s.parser_version FROM {states} s JOIN {orders} ON o_orderkey = product_id WHERE o_custkey % 2 = 1
UNION ALL SELECT o_orderkey, 'ready', 2, 'v5' FROM {orders} WHERE o_custkey % 2 = 0""")
def _(t):
    return _final(t)["states"].select("product_id", "status", "option_count", "parser_version")


# Snapshots of the open orders' options, one of them new.
_SNAP = "SELECT o_orderkey AS product_id, CASE WHEN o_custkey % 2 = 0 THEN 'AF' ELSE 'ZZ' END AS option_id, 'snap' AS option_name, " \
        "CASE WHEN o_custkey % 3 = 0 THEN 'unmapped' ELSE 'ready' END AS status FROM {orders} WHERE o_orderstatus = 'O'"


def _snap(t):
    results = t.sql(_SNAP).withColumn("ingredients", F.when(F.col("status") == "ready", F.array(F.lit("Aqua"), F.lit(" "), F.lit("Oil x"))))
    records = t.records.withColumn("raw_ingredients", F.lit("old"))
    return writers.snapshot_option_status(records, t.record_items, t.states, results, "v6", AS_OF, _UNTIL)


@query("snapshot_records", f"""
SELECT coalesce(r.product_id, s.product_id) AS product_id, coalesce(r.option_id, s.option_id) AS option_id,
  CASE WHEN s.product_id IS NULL THEN r.option_name ELSE 'snap' END AS option_name,
  CASE WHEN s.product_id IS NULL THEN 'old' WHEN s.status = 'ready' THEN 'Aqua,  , Oil x' ELSE '' END AS raw_ingredients,
  CASE WHEN s.product_id IS NULL THEN r.expires_at ELSE {_END} END AS expires_at,
  CASE WHEN s.product_id IS NOT NULL THEN s.status WHEN coalesce(o.o_orderstatus, '') <> 'O' OR r.option_id = '' THEN r.cache_status END AS cache_status
FROM {{records}} r FULL JOIN ({_SNAP}) s ON s.product_id = r.product_id AND s.option_id = r.option_id
LEFT JOIN {{orders}} o ON o.o_orderkey = r.product_id""")
def _(t):
    return _snap(t)["records"].select("product_id", "option_id", "option_name", "raw_ingredients", "expires_at", "cache_status")


@query("snapshot_items", f"""
WITH s AS ({_SNAP})
SELECT * FROM {{record_items}} ANTI JOIN s USING (product_id, option_id)
UNION ALL SELECT product_id, option_id, 1, 'Aqua', 'aqua' FROM s WHERE status = 'ready'
UNION ALL SELECT product_id, option_id, 3, 'Oil x', 'oilx' FROM s WHERE status = 'ready'""")
def _(t):
    return _snap(t)["items"]


@query("snapshot_states", f"""
WITH s AS ({_SNAP})
SELECT coalesce(t.product_id, s.product_id) AS product_id, coalesce(t.status, 'mapping_failed') AS status, coalesce(option_count, 0) AS option_count,
  CASE WHEN s.product_id IS NULL THEN cache_collection_status WHEN s.status = 'ready' THEN 'ready' ELSE 'failed' END AS cache_collection_status,
  CASE WHEN s.product_id IS NULL THEN cache_option_count ELSE 1 END AS cache_option_count,
  CASE WHEN s.product_id IS NOT NULL THEN CAST(s.status = 'ready' AS INT) END AS cache_ready_count
FROM {{states}} t FULL JOIN s ON s.product_id = t.product_id""")
def _(t):
    return _snap(t)["states"].select("product_id", "status", "option_count", "cache_collection_status",
                                     "cache_option_count", "cache_ready_count")


# Search results: the orders of the customers who asked.
_FOUND = "SELECT query_key, o_orderkey AS product_id, o_orderkey % 1000 * 100 + query_id % 100 AS place FROM {queries} JOIN {orders} ON o_custkey = query_id WHERE query_id % 3 = 0"


def _saved(t):
    return writers.save_search_results(
        t.searches, t.search_results.withColumn("rank", F.col("rank").cast("bigint")), t.queue, t.states, t.sql(_FOUND), AS_OF, _UNTIL)


@query("save_search_results", f"""
WITH f AS ({_FOUND})
SELECT query_key, product_id, rank FROM {{search_results}} WHERE query_key NOT IN (SELECT query_key FROM f)
UNION ALL SELECT query_key, product_id, min(place) FROM f GROUP BY 1, 2""")
def _(t):
    return _saved(t)["results"].select("query_key", "product_id", "rank")


@query("save_search_queries", f"""
WITH f AS (SELECT DISTINCT query_key FROM ({_FOUND}))
SELECT query_key, expires_at FROM {{searches}} ANTI JOIN f USING (query_key) UNION ALL SELECT query_key, {_END} FROM f""")
def _(t):
    return _saved(t)["searches"].select("query_key", "expires_at")


@query("save_search_queue", f"""
SELECT product_id, status FROM {{queue}} UNION ALL
SELECT f.product_id, CASE WHEN s.expires_at > {_NOW} THEN 'complete' ELSE 'pending' END FROM (SELECT DISTINCT product_id FROM ({_FOUND})) f
LEFT JOIN {{states}} s USING (product_id) WHERE f.product_id NOT IN (SELECT product_id FROM {{queue}})""")
def _(t):
    return _saved(t)["queue"].select("product_id", "status")


# --- round trips through files ---------------------------------------------------------------------

def _folder(t, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("jsonl_round_trip", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS p_brand FROM {part}")
def _(t):
    rows = t.part.select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("p_brand"))
    path = _folder(t, "jsonl")
    writers.write_jsonl(rows, path)
    return readers.read_jsonl(t.spark, path, rows.schema)


@query("publish_documents", "SELECT p_partkey, p_name FROM {part} WHERE p_partkey % 2 = 1")
def _(t):
    """The second of two publications is what the collection holds."""
    path = _folder(t, "published")
    writers.publish_documents(t.part.select("p_partkey", "p_name"), path)
    writers.publish_documents(t.part.filter("p_partkey % 2 = 1").select("p_partkey", "p_name"), path)
    return t.spark.read.parquet(path)
