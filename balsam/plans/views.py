"""Views that give the driver tables the roles of the data model.

They are plain projections and joins of whole tables, in SQL that Spark and DuckDB share."""

from .registry import view

_CAS = (
    "CAST(10000 + {k} AS STRING) || '-' || lpad(CAST({k} % 100 AS STRING), 2, '0') || '-' || "
    "CAST({k} % 10 AS STRING)"
)


def cas(key: str) -> str:
    """A registry-number-shaped text made from an integer key."""
    return _CAS.replace("{k}", key)


# Ingredient items of a product, in several spellings of the registry names.
view("items", """
SELECT l_orderkey AS product_id,
       CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey AS position,
       CASE WHEN l_linenumber = 7 THEN p_brand || ' ' || p_type || ' – ' || CAST(p_size AS STRING)
            WHEN l_linenumber % 3 = 0 THEN upper(p_name) || '  ' || p_brand
            WHEN l_linenumber % 3 = 1 THEN ' ' || p_name || '/' || p_brand
            ELSE p_name || ' ' || p_brand END AS name
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
""")

# The same items written as registry numbers; every fourth one keeps its name.
view("mixed_items", f"""
SELECT l_orderkey AS product_id,
       CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey AS position,
       CASE WHEN l_linenumber % 4 = 0 THEN p_name || ' ' || p_brand
            ELSE {cas('p_partkey')} END AS name
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
""")

_REGULATION_COLUMNS = f"""
       p_partkey AS seq,
       p_name || ' ' || p_brand AS ingredient_kor_name,
       CAST(NULL AS STRING) AS ingredient_eng_name,
       CASE WHEN p_size = 1 THEN '-'
            WHEN p_size % 3 = 0 THEN {cas('p_partkey')} || ' / ' || {cas('(p_partkey + 1)')}
            ELSE {cas('p_partkey')} END AS cas_no,
       p_brand || '·' || p_type || '-' || CAST(p_size AS STRING) AS chemical_name,
       CASE WHEN p_size % 2 = 0 THEN 'prohibited' ELSE 'restricted' END AS regulation_type,
       CASE WHEN p_size % 2 = 0 THEN 'prohibited' WHEN p_size % 3 = 0 THEN 'uv_filter'
            ELSE 'preservative' END AS category,
       CASE WHEN p_size % 5 = 1 THEN CAST(p_size AS STRING) || '%' END AS max_concentration,
       CASE WHEN p_size % 2 = 0 THEN 'all_cosmetics' END AS product_scope,
       CASE WHEN p_size % 2 = 0 THEN 'not allowed' WHEN p_size % 7 = 1 THEN 'rinse-off only' END
         AS use_conditions,
       CASE WHEN p_size % 11 = 1 THEN 'keep away from eyes' END AS warning_text,
       'SRC-' || CAST(p_size % 2 AS STRING) AS source_id,
       'authority' AS source_authority,
       'notice ' || p_type AS source_document,
       'N-' || CAST(p_size AS STRING) AS notice_number,
       'label' AS notice_label,
       '2024-01-01' AS notice_date,
       'annex ' || CAST(p_size % 4 AS STRING) AS source_section,
       CAST(p_size % 4 + 1 AS INT) AS source_table,
       p_partkey AS source_row
"""
view("regulations", f"SELECT {_REGULATION_COLUMNS} FROM {{part}}")

_ALLERGEN = """
SELECT p_partkey AS seq,
       p_name || ' ' || p_brand AS ingredient_kor_name,
       CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_name || ' ' || p_type END
         AS ingredient_eng_name,
       CASE WHEN p_size % 3 = 0 THEN p_type || ' ' || p_name || ' ' || p_brand END AS inci_name,
       {open}{cas}{close} AS cas_numbers,
       {open}p_brand || '·' || p_type || '-' || CAST(p_size AS STRING), p_brand || p_name{close}
         AS aliases,
       'fragrance_allergen' AS allergen_type,
       CASE WHEN p_size = 50 THEN 'withdrawn' ELSE 'labeling_required' END AS legal_status,
       'KR' AS jurisdiction, 'fragrance_component' AS evidence_scope,
       {open}'contact'{close} AS reaction_types,
       CAST(NULL AS STRING) AS sensitization_note, CAST(NULL AS STRING) AS oxidation_note,
       '0.01%' AS rinse_off_threshold,
       CASE WHEN p_size % 4 <> 0 THEN '0.001%' END AS leave_on_threshold,
       'ALG-1' AS source_id, 'authority' AS source_authority,
       'guide ' || p_type AS source_document, '1' AS source_document_version,
       '2024-01-01' AS source_document_date,
       CASE WHEN p_size % 5 <> 0 THEN 'annex' END AS source_section,
       CAST(6 AS INT) AS source_page, p_partkey AS source_row
FROM PART
"""


def _allergens(opening: str, closing: str) -> str:
    return (
        _ALLERGEN.replace("{open}", opening).replace("{close}", closing)
        .replace("{cas}", cas("p_partkey")).replace("FROM PART", "FROM {part}")
    )


view("allergens", _allergens("array(", ")"), _allergens("[", "]"))

# Ingredient dictionary records.
view("ingredients", f"""
SELECT p_partkey AS row, p_name || ' ' || p_brand AS ingredient_kor_name,
       CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand || ' ' || p_type || '-' ||
            CAST(p_size AS STRING) END AS ingredient_eng_name,
       {cas('p_partkey')} AS cas_no,
       CASE WHEN p_size % 3 = 0 THEN 'origin  of ' || p_name END AS origin_description,
       CASE WHEN p_size % 5 = 0 THEN p_type || ' ' || p_name || ' ' || p_brand || ', ' || p_brand
            || ' ' || CAST(p_size AS STRING)
            WHEN p_size % 5 = 1 THEN p_name || CAST(p_size AS STRING) END AS synonym
FROM {{part}}
""")

# Requested products.
view("requests", "SELECT o_orderkey AS product_id, o_orderpriority AS category FROM {orders}")

# --- retrieval -------------------------------------------------------------------------------
_DOC = """
SELECT vec_id AS row,
       CASE WHEN vec_id % 5 = 4 THEN '' ELSE 'Name-' || CAST(vec_id AS STRING) END
         AS ingredient_kor_name,
       'label ' || CAST(label AS STRING) AS ingredient_eng_name,
       CAS AS cas_no, CASE WHEN vec_id % 3 = 0 THEN 'Name (' || CAST(vec_id + 1 AS STRING) || ')'
       END AS synonym, CAST(NULL AS STRING) AS origin_description,
       'content of ' || CAST(vec_id AS STRING) AS content, 'corpus' AS source,
       embedding AS vector
FROM {embeddings}
""".replace("CAS AS", cas("vec_id") + " AS")
view("docs", _DOC)

# Every second query names a document; the others can only be found by vector.
view("search_queries", f"""
SELECT vec_id AS query_id,
       CASE WHEN vec_id % 6 = 0 THEN 'NAME ' || CAST(vec_id AS STRING)
            WHEN vec_id % 6 = 2 THEN {cas('vec_id')}
            WHEN vec_id % 6 = 4 THEN 'Label ' || CAST(label AS STRING)
            ELSE 'free text ' || CAST(vec_id AS STRING) END AS query,
       embedding AS vector
FROM {{embeddings}}
""")

# Requests of up to five queries each: ingredients (one hit each) or one free text (eight hits).
view("document_requests", """
SELECT query_id - query_id % 5 AS request_id, query_id % 5 AS position, query, vector,
       CASE WHEN query LIKE 'free%' THEN 8 ELSE 1 END AS search_k
FROM {search_queries}
""")

# --- registry builds ---------------------------------------------------------------------------


def _rows(width: int, opening: str, closing: str) -> str:
    number, chem = cas("p_partkey"), "p_brand || ' ' || CAST(p_size AS STRING)"
    full = ("p_name", number, chem) if width == 3 else ("p_name", "p_type", "p_brand", number, chem)

    def arr(*cells: str) -> str:
        return opening + ", ".join(cells) + closing

    return f"""
SELECT CAST(p_size % 4 + 1 AS INT) AS source_table, p_partkey + 1 AS source_row,
       CASE WHEN p_partkey % 7 IN (2, 3) THEN {arr(number, chem)}
            WHEN p_partkey % 7 = 5 THEN {arr("' ' || p_name || '  only '")}
            WHEN p_partkey % 7 = 6 THEN {arr(full[0], *full[1:-2], "'-'", "''")}
            ELSE {arr(*full)} END AS cells
FROM {{part}}"""


for _w, _n in ((3, "prohibited_rows"), (5, "restricted_rows")):
    view(_n, _rows(_w, "array(", ")"), _rows(_w, "[", "]"))

_PAGE_ROW = (
    "CAST(p_partkey % 50 + 1 AS STRING) || ' ' || p_name || CASE WHEN p_size > 25 THEN ' ' || p_type "
    f"ELSE '' END || ' CAS No ' || {cas('p_partkey')}"
)
view("numbered_pages", f"""
SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS page_id,
       'intro 연번 성분명 CAS 등록번호 ' || listagg({_PAGE_ROW}, ' ') WITHIN GROUP (ORDER BY p_partkey)
         AS text
FROM {{part}} GROUP BY 1
""", f"""
SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS page_id,
       'intro 연번 성분명 CAS 등록번호 ' || string_agg({_PAGE_ROW}, ' ' ORDER BY p_partkey) AS text
FROM {{part}} GROUP BY 1
""")
view("metadata", "SELECT 'SRC-' || CAST(max(r_regionkey) AS STRING) AS source_id, "
     "'registry of ' || max(r_name) AS document_title, CAST(count(*) AS STRING) AS dataset_version, "
     "'' AS notice_number FROM {region}")

# --- product store -----------------------------------------------------------------------------
AS_OF = "1999-06-01 00:00:00"
OPTION = "CASE WHEN o_orderstatus = 'F' THEN '' ELSE l_returnflag || l_linestatus END"

view("products", """
SELECT o_orderkey AS product_id, 'shop' || CAST(o_custkey % 2 AS STRING) AS source,
       CAST(o_orderkey AS STRING) AS external_id,
       'Item ' || o_orderpriority || ' ' || CAST(o_custkey % 100 AS STRING) AS product_name,
       lower('Item ' || o_orderpriority || ' ' || CAST(o_custkey % 100 AS STRING)) AS name_key,
       'Brand ' || CAST(o_custkey % 37 AS STRING) AS brand_name,
       o_orderpriority AS category, 'all > ' || o_orderstatus || ' > ' || o_orderpriority AS category_path,
       'http://shop/' || CAST(o_orderkey AS STRING) AS product_url, CAST(NULL AS STRING) AS image_url,
       o_orderdate AS updated_at
FROM {orders}
""")
view("records", f"""
SELECT l_orderkey AS product_id, {OPTION} AS option_id, 'Option ' || max(l_returnflag) AS option_name,
       max(l_shipdate) + INTERVAL '400' DAY AS expires_at,
       CASE WHEN max(o_orderstatus) = 'P' THEN
         CASE WHEN min(l_linenumber) = 6 THEN 'unmapped' WHEN min(l_linenumber) < 7 THEN 'ready' END END
         AS cache_status,
       CASE WHEN max(o_orderstatus) = 'P' THEN 'v4' END AS cache_version
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY 1, 2
""")
view("record_items", f"""
SELECT l_orderkey AS product_id, {OPTION} AS option_id,
       CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey AS position, p_name AS ingredient_name,
       replace(p_name, ' ', '') AS normalized_name
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey
WHERE l_quantity > 5
""")
view("states", f"""
SELECT o_orderkey AS product_id,
       CASE WHEN o_orderstatus = 'F' THEN 'not_applicable' WHEN o_custkey % 11 = 0 THEN 'mapping_failed'
            ELSE 'ready' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(n AS INT) END AS option_count,
       CASE WHEN o_custkey % 13 = 0 THEN 'v3' ELSE 'v4' END AS parser_version,
       CASE WHEN o_custkey % 7 = 0 THEN 'not json'
            ELSE '[' || chr(123) || '"internal_option_key":"AF","availability":"sold_out","sort_order":'
                 || CAST(o_custkey % 9 AS STRING) || ',"raw_option_name":"[new] Shade ' || o_orderstatus
                 || '"' || chr(125) || ']' END AS options_json,
       o_orderdate + INTERVAL '500' DAY AS expires_at,
       CASE WHEN o_orderstatus = 'P' THEN 'partial' END AS cache_collection_status,
       CASE WHEN o_orderstatus = 'P' THEN CAST(n AS INT) END AS cache_option_count,
       CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 > 0 THEN 'v4' END AS cache_version
FROM {{orders}} JOIN (SELECT product_id, count(*) AS n FROM {{records}} GROUP BY 1) c
  ON c.product_id = o_orderkey
WHERE o_custkey % 17 > 0
""")

_QUERY = """CASE WHEN c_custkey % 5 = 0 THEN 'Brand ' || CAST(c_custkey % 40 AS STRING)
            WHEN c_custkey % 5 = 1 THEN upper('urgent ' || CAST(c_custkey % 100 AS STRING))
            WHEN c_custkey % 5 = 2 THEN c_mktsegment
            WHEN c_custkey % 5 = 3 THEN CAST(c_custkey % 100 AS STRING)
            ELSE 'Item 5-LOW ' || CAST(c_custkey % 100 AS STRING) END"""
view("queries", f"""
SELECT c_custkey AS query_id, CASE WHEN c_custkey % 5 = 4 THEN '[ad] ' ELSE '' END || {_QUERY} AS query,
       lower({_QUERY}) AS query_key, CAST(c_custkey % 15 - 1 AS INT) AS result_limit
FROM {{customer}}
""")
view("searches", f"""
SELECT query_key, TIMESTAMP '1999-05-01 00:00:00' AS searched_at,
       TIMESTAMP '{AS_OF}' + CASE WHEN max(query_id) % 2 = 0 THEN INTERVAL '1' DAY
                                  ELSE INTERVAL '0' DAY END AS expires_at
FROM {{queries}} WHERE length(query_key) % 2 = 0 GROUP BY 1
""", f"""
SELECT query_key, TIMESTAMP '1999-05-01 00:00:00' AS searched_at,
       TIMESTAMP '{AS_OF}' + CASE WHEN max(query_id) % 2 = 0 THEN INTERVAL '1' DAY
                                  ELSE INTERVAL '0' DAY END AS expires_at
FROM {{queries}} WHERE length(query_key) % 2 = 0 GROUP BY 1
""")
view("search_results", """
SELECT DISTINCT query_key, o_orderkey AS product_id, CAST(o_orderkey AS INT) AS rank
FROM {queries} JOIN {orders} ON o_custkey = query_id WHERE length(query_key) % 2 = 0 AND query_id % 4 <> 2
""")

# A request per product, with the product's own ingredients as seeds: one name per part, and a base ingredient that a
# third of all products hold.
view("related_requests", "SELECT product_id AS request_id, product_id, category, category_path FROM {products}")
view("related_items", """
SELECT product_id, option_id, position, ingredient_name || ' ' || CAST(position % 100000000000 AS STRING) AS ingredient_name,
       normalized_name || CAST(position % 100000000000 AS STRING) AS normalized_name
FROM {record_items}
UNION ALL SELECT product_id, option_id, 0, CASE WHEN product_id % 2 = 0 THEN 'Base Water' ELSE 'base  water' END, 'basewater'
FROM {records} WHERE product_id % 3 = 0
""")
view("seeds", """
SELECT product_id AS request_id, min(position) AS seed_pos, normalized_name AS name FROM {related_items} GROUP BY 1, 3
""")

# Queue: the events of a user are the history of one product; its last event is the queue row.
view("queue", """
SELECT user_id AS product_id, CASE WHEN max_by(event_type, event_id) = 'view' THEN 'pending'
         WHEN max_by(event_type, event_id) = 'click' THEN 'collecting'
         WHEN max_by(event_type, event_id) = 'error' THEN 'failed' ELSE 'complete' END AS status,
       CAST(count(*) % 40 AS INT) AS attempt_count,
       CASE WHEN user_id % 6 > 0 THEN max(ts) END AS last_attempt_at,
       CASE WHEN user_id % 3 > 0 THEN max(ts) + INTERVAL '1' HOUR END AS next_retry_at,
       max(ts) AS updated_at
FROM {events} GROUP BY user_id
""")
