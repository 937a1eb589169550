"""Queries of the product store, the cache rules and the collection queue."""

from pyspark.sql import functions as F

from ..operators import cache, store
from . import views  # noqa: F401
from .registry import query, view
from .views import AS_OF

_NOW = f"TIMESTAMP '{AS_OF}'"
_VALID = f"""
valid AS (SELECT r.* FROM {{records}} r WHERE expires_at > {_NOW} AND EXISTS (
  SELECT 1 FROM {{record_items}} i WHERE i.product_id = r.product_id AND i.option_id = r.option_id))"""
_COUNTS = """
counts AS (SELECT product_id, count(*) FILTER (option_id = '') AS n_common,
                  count(*) FILTER (option_id <> '') AS n_options FROM valid GROUP BY 1)"""
_COMPLETE = f"""{_VALID}, {_COUNTS},
complete AS (
  SELECT product_id, status AS kind FROM {{states}} JOIN counts USING (product_id)
  WHERE expires_at > {_NOW} AND (
    (status = 'not_applicable' AND option_count = 0 AND n_common = 1)
    OR (status = 'ready' AND n_options = option_count)))"""
_NAME_BRAND = """
hits AS (SELECT query_id, p.* FROM {queries} JOIN USABLE p
         ON contains(name_key, query_key) OR contains(lower(brand_name), BRAND))"""


@query("valid_records", f"WITH {_VALID} SELECT product_id, option_id FROM valid")
def _(t):
    return store.valid_records(t.records, t.record_items, AS_OF).select("product_id", "option_id")


@query("complete_products", f"WITH {_COMPLETE} SELECT product_id, kind FROM complete")
def _(t):
    return store.complete_products(t.states, t.records, t.record_items, AS_OF)


@query("complete_products_with_legacy", f"""
WITH {_COMPLETE} SELECT product_id, kind FROM complete UNION ALL
SELECT product_id, 'legacy' FROM counts WHERE product_id NOT IN (SELECT product_id FROM {{states}})""")
def _(t):
    return store.complete_products(t.states, t.records, t.record_items, AS_OF, include_legacy=True)


_REQUESTED = "SELECT product_id AS request_id, ' ' || source AS source, external_id || ' ' AS external_id, " \
             "CASE WHEN product_id % 3 = 0 THEN 'AF ' WHEN product_id % 3 = 1 THEN 'RF' END AS option_id " \
             "FROM {products}"


@query("cached_ingredients", """
SELECT product_id AS request_id, product_id, option_id, position, ingredient_name, r.expires_at
FROM {record_items} JOIN {records} r USING (product_id, option_id)
WHERE option_id = CASE WHEN product_id % 3 = 0 THEN 'AF' WHEN product_id % 3 = 1 THEN 'RF' ELSE '' END""")
def _(t):
    return store.cached_ingredients(t.sql(_REQUESTED), t.products, t.records, t.record_items)


view("named_requests", "SELECT p_partkey AS request_id, upper(p_name) || ' ' AS name FROM {part}")


@query("products_with_ingredient", """
WITH best AS (
  SELECT normalized_name, product_id FROM (SELECT DISTINCT normalized_name, product_id FROM {record_items})
  QUALIFY row_number() OVER (PARTITION BY normalized_name ORDER BY product_id) <= 10)
SELECT request_id, product_id FROM {named_requests}
JOIN best ON normalized_name = lower(replace(name, ' ', ''))""")
def _(t):
    return store.products_with_ingredient(t.named_requests, t.record_items)


# Brute force over all pairs of request and candidate.
@query("related_products", f"""
WITH {_COMPLETE.replace("record_items", "related_items")},
usable AS (SELECT v.product_id, option_id FROM valid v JOIN complete USING (product_id)
           WHERE (kind = 'ready') = (option_id <> '')),
asked AS (SELECT request_id, name, min(seed_pos) AS seed_pos FROM {{seeds}} GROUP BY 1, 2),
held AS (SELECT i.* FROM {{related_items}} i JOIN usable USING (product_id, option_id)),
hits AS (
  SELECT request_id, product_id, count(DISTINCT name) AS n_matched, count(DISTINCT nullif(option_id, '')) AS n_options
  FROM held JOIN asked ON name = normalized_name GROUP BY 1, 2),
ranked AS (
  SELECT q.request_id, p.product_id, n_matched, n_options,
         CASE WHEN q.category = p.category THEN 'same_category'
              WHEN split_part(q.category_path, ' > ', 2) = split_part(p.category_path, ' > ', 2)
              THEN 'same_parent_path' ELSE 'other_category' END AS category_match_level,
         row_number() OVER (PARTITION BY q.request_id ORDER BY
           CASE WHEN q.category = p.category THEN 0
                WHEN split_part(q.category_path, ' > ', 2) = split_part(p.category_path, ' > ', 2)
                THEN 1 ELSE 2 END,
           n_matched DESC, n_options DESC, p.updated_at DESC, p.source, p.external_id) AS rank
  FROM {{related_requests}} q JOIN hits h USING (request_id)
  JOIN {{products}} p ON p.product_id = h.product_id WHERE p.product_id <> q.product_id
  QUALIFY rank <= 5),
spelled AS (
  SELECT request_id, rank, option_id, normalized_name, seed_pos,
         first(ingredient_name ORDER BY position, ingredient_name) AS spelling
  FROM ranked JOIN held USING (product_id) JOIN asked USING (request_id) WHERE name = normalized_name GROUP BY ALL),
per_option AS (
  SELECT request_id, rank, option_id, string_agg(spelling, '|' ORDER BY seed_pos, normalized_name) AS names
  FROM spelled WHERE option_id <> '' GROUP BY ALL),
options AS (
  SELECT request_id, rank, string_agg(option_id || '/' || option_name || '=' || names, ';' ORDER BY option_id) AS matched_options
  FROM per_option JOIN ranked USING (request_id, rank) JOIN {{records}} USING (product_id, option_id) GROUP BY ALL),
firsts AS (
  SELECT request_id, rank, normalized_name, seed_pos, first(spelling ORDER BY option_id) AS spelling FROM spelled GROUP BY ALL),
whole AS (
  SELECT request_id, rank, string_agg(spelling, ',' ORDER BY seed_pos, normalized_name) AS matched_ingredients FROM firsts GROUP BY ALL)
SELECT request_id, rank, product_id, category_match_level, n_matched, n_options,
       coalesce(matched_options, '') AS matched_options, matched_ingredients
FROM ranked JOIN whole USING (request_id, rank) LEFT JOIN options USING (request_id, rank)""")
def _(t):
    out = store.related_products(
        t.related_requests, t.seeds, t.products, t.states, t.records, t.related_items, AS_OF)
    option = lambda o: F.concat(o["option_id"], F.lit("/"), o["option_name"], F.lit("="), F.array_join(o["matched_ingredients"], "|"))
    return out.withColumns({"matched_options": F.array_join(F.transform("matched_options", option), ";"),
                            "matched_ingredients": F.array_join("matched_ingredients", ",")})


@query("category_match_level", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'same_category'
         WHEN o_orderstatus = 'F' THEN 'same_parent_path' ELSE 'other_category' END AS level
FROM {orders}""")
def _(t):
    return t.products.select(
        F.col("product_id").alias("o_orderkey"), store.category_match_level(
            F.lit("1-URGENT"), F.lit("all>F > x"), "category", "category_path").alias("level"))


def _newest(limit):
    return f"""
SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, product_id)
       AS rank FROM hits QUALIFY rank <= {limit}"""


@query("search_complete", f"""
WITH {_COMPLETE}, usable AS (SELECT * FROM {{products}} WHERE product_id IN (SELECT product_id FROM complete)),
{_NAME_BRAND.replace('USABLE', 'usable').replace('BRAND', 'query_key')}
{_newest(5)}""")
def _(t):
    return store.search_complete(t.queries, t.products, t.states, t.records, t.record_items, AS_OF)


_USABLE = f"""
usable AS (SELECT * FROM {{products}} WHERE product_id IN (
  SELECT product_id FROM {{search_results}} JOIN {{searches}} USING (query_key) WHERE expires_at > {_NOW}
  UNION SELECT product_id FROM {{states}} WHERE expires_at > {_NOW} AND status IN ('ready', 'not_applicable')))"""
_STORED = f"{_USABLE}, {_NAME_BRAND.replace('USABLE', 'usable').replace('BRAND', 'lower(query)')}"


@query("search_products", f"WITH {_STORED} {_newest(10)}")
def _(t):
    return store.search_products(
        t.queries, t.products, t.searches, t.search_results, t.states, AS_OF)


_CACHED = f"""
cached AS (SELECT query_id, q.query_key, product_id, rank, searched_at
  FROM {{queries}} q JOIN {{searches}} s ON q.query_key = s.query_key AND s.expires_at > {_NOW}
  LEFT JOIN {{search_results}} r ON r.query_key = q.query_key)"""


@query("cached_search", f"WITH {_CACHED} SELECT * FROM cached")
def _(t):
    return store.cached_search(t.queries, t.searches, t.search_results, AS_OF)


@query("resolve_searches", f"""
WITH {_CACHED}, {_STORED}, stored AS ({_newest(10)}),
merged AS (
  SELECT query_id, product_id, rank, 'search_cache' AS provider, true AS cache_hit FROM cached
  UNION ALL SELECT query_id, product_id, rank, 'product_cache', true FROM stored
  WHERE query_id NOT IN (SELECT query_id FROM cached)
  UNION ALL SELECT query_id, NULL, NULL, 'search_cache', false FROM {{queries}}
  WHERE query_id NOT IN (SELECT query_id FROM cached) AND query_id NOT IN (SELECT query_id FROM stored)),
shown AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank NULLS LAST, product_id) AS shown_at
          FROM merged)
SELECT shown.* FROM shown JOIN {{queries}} USING (query_id)
WHERE shown_at <= greatest(1, least(10, result_limit))""")
def _(t):
    return store.resolve_searches(
        t.queries, t.products, t.searches, t.search_results, t.states, AS_OF)


@query("clamp_limit", """
SELECT query_id, greatest(1, least(10, result_limit)) AS n FROM {queries}""")
def _(t):
    return t.queries.select("query_id", store.clamp_limit("result_limit").alias("n"))


@query("restore_options", """
SELECT product_id, option_id, option_name,
       CASE WHEN good AND option_id = 'AF' THEN 'sold_out' ELSE 'unknown' END AS availability,
       CASE WHEN good AND option_id = 'AF' THEN sort_order END AS sort_order,
       coalesce(cache_status, 'ready') AS status
FROM {records} LEFT JOIN (SELECT product_id, options_json <> 'not json' AS good,
  CAST(CASE WHEN options_json <> 'not json' THEN json_extract(options_json, '$[0].sort_order') END AS INT)
    AS sort_order FROM {states}) s USING (product_id)
WHERE option_id <> ''""")
def _(t):
    return store.restore_options(t.records, t.states).select(
        "product_id", "option_id", "option_name", "availability", "sort_order", "status")


_ENTRIES = "SELECT o_orderkey AS entry_no, CASE WHEN o_custkey % 3 = 0 THEN 'shop9' ELSE " \
           "' shop' || CAST(o_custkey % 2 AS STRING) END AS source, CAST(o_orderkey AS STRING) AS external_id, " \
           "' http://x/' || o_orderpriority AS product_url, CASE WHEN o_custkey % 4 = 0 THEN 'label' END AS label, " \
           "'' AS product_name, CASE WHEN o_custkey % 5 = 0 THEN 'B' END AS brand_name, " \
           "CAST(NULL AS STRING) AS category, '' AS category_path, CAST(NULL AS STRING) AS image_url FROM {orders}"


@query("enrich_candidates", """
SELECT CASE WHEN o_custkey % 3 = 0 THEN 'shop9' ELSE source END AS source, external_id,
       'http://x/' || o_orderpriority AS product_url,
       CASE WHEN o_custkey % 4 = 0 THEN 'label' WHEN known THEN product_name END AS product_name,
       CASE WHEN o_custkey % 5 = 0 THEN 'B' WHEN known THEN brand_name END AS brand_name,
       CASE WHEN known THEN category ELSE 'unknown' END AS category,
       CASE WHEN known THEN category_path END AS category_path, CAST(NULL AS STRING) AS image_url,
       CASE WHEN o_custkey % 4 <> 0 AND NOT known THEN 'product name or label required' END AS reason
FROM (SELECT *, o_custkey % 3 <> 0 AS known FROM {orders} JOIN {products} ON product_id = o_orderkey)""")
def _(t):
    return store.enrich_candidates(t.sql(_ENTRIES), t.products)


# --- cache rules ----------------------------------------------------------------------------------

view("lookups", "SELECT product_id AS request_id, product_id, CASE WHEN product_id % 4 = 0 THEN ' ' "
     "WHEN product_id % 4 = 1 THEN 'AF' WHEN product_id % 4 = 2 THEN 'RO ' ELSE 'NF' END AS option_id "
     "FROM {products}")


@query("cache_decision", f"""
SELECT request_id, l.product_id, trim(l.option_id) AS option_id,
       coalesce(expires_at <= {_NOW}, false) AS cache_expired,
       coalesce(expires_at > {_NOW}, false) AS cache_hit,
       CASE WHEN expires_at > {_NOW} THEN 'hit' ELSE 'extract' END AS action
FROM {{lookups}} l LEFT JOIN {{records}} r ON r.product_id = l.product_id AND r.option_id = trim(l.option_id)""")
def _(t):
    return cache.cache_decision(t.lookups, t.records, AS_OF)


@query("accept_extractions", f"""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'extraction failed'
         WHEN text NOT LIKE '%,%' THEN 'no ingredients' END AS reason,
       role <> 'system' AND text LIKE '%,%' AS accepted,
       CASE WHEN role <> 'system' AND text LIKE '%,%' THEN {_NOW} + INTERVAL '30' DAY END AS expires_at
FROM {{conversations}}""")
def _(t):
    results = t.conversations.select(
        "conv_id", "turn", (F.col("role") != "system").alias("success"),
        F.when(F.col("text").contains(","), F.split("text", ",")).alias("ingredients"))
    return cache.accept_extractions(results, AS_OF, 30).select(
        "conv_id", "turn", "reason", "accepted", "expires_at")


_PLAIN = f"""{_VALID}, {_COUNTS},
plain AS (SELECT product_id, status, option_count, parser_version FROM {{states}} JOIN counts USING (product_id)
  WHERE expires_at > {_NOW} AND ((status = 'not_applicable' AND option_count = 0 AND n_common > 0)
    OR (status = 'ready' AND n_options = option_count)))"""
_LEVEL = f"""
whole AS (SELECT product_id, count(*) AS n, bool_and(cache_status IS NOT NULL AND cache_version IS NOT NULL
    AND (cache_status <> 'ready' OR EXISTS (SELECT 1 FROM {{record_items}} i
         WHERE i.product_id = r.product_id AND i.option_id = r.option_id))) AS filled
  FROM {{records}} r WHERE expires_at > {_NOW} AND option_id <> '' GROUP BY 1),
level AS (SELECT product_id, cache_collection_status AS status, cache_option_count AS option_count,
       s.cache_version AS parser_version FROM {{states}} s LEFT JOIN whole USING (product_id)
  WHERE expires_at > {_NOW} AND cache_collection_status IS NOT NULL AND cache_version IS NOT NULL
    AND cache_option_count IS NOT NULL AND coalesce(n, 0) = cache_option_count AND coalesce(filled, true)),
prep AS (SELECT *, 'option' AS level FROM level UNION ALL
  SELECT *, 'product' FROM plain WHERE product_id NOT IN (SELECT product_id FROM level))"""


@query("cached_preparation", f"WITH {_PLAIN} SELECT * FROM plain")
def _(t):
    return cache.cached_preparation(t.states, t.records, t.record_items, AS_OF)


@query("option_cache_preparation", f"WITH {_PLAIN}, {_LEVEL} SELECT * FROM prep")
def _(t):
    return cache.option_cache_preparation(t.states, t.records, t.record_items, AS_OF)


# Mapping keys come from the option name, or for option AF from the stored raw name, without the
# '[new]' block that marks a promotion.
_USABLE_PREP = f"""
names AS (SELECT r.product_id, CASE WHEN r.option_id = 'AF' AND s.options_json <> 'not json'
    THEN 'shade' || lower(substr(s.options_json, strpos(s.options_json, 'Shade ') + 6, 1))
    ELSE lower(replace(option_name, ' ', '')) END AS key
  FROM {{records}} r LEFT JOIN {{states}} s USING (product_id)
  WHERE r.option_id <> '' AND r.expires_at > {_NOW}),
broken AS (SELECT DISTINCT product_id FROM (
  SELECT product_id, key FROM names GROUP BY 1, 2 HAVING count(*) > 1)),
usable_prep AS (SELECT product_id, status, option_count, parser_version, level FROM prep
  WHERE status = 'not_applicable' OR (status IN ('ready', 'partial') AND parser_version = 'v4'
    AND product_id NOT IN (SELECT product_id FROM broken)))"""


@query("usable_preparation", f"WITH {_PLAIN}, {_LEVEL}, {_USABLE_PREP} SELECT * FROM usable_prep")
def _(t):
    preps = cache.option_cache_preparation(t.states, t.records, t.record_items, AS_OF)
    return cache.usable_preparation(preps, t.records, t.states, AS_OF, "v4")


@query("resolve_option_lookups", f"""
WITH {_PLAIN}
SELECT request_id, product_id, option_id, CASE
    WHEN option_id = '' THEN 'blank option key'
    WHEN product_id NOT IN (SELECT product_id FROM plain) OR status IS NULL OR status <> 'ready'
      THEN 'option not ready'
    WHEN expires_at IS NULL THEN 'no record' WHEN expires_at <= {_NOW} THEN 'expired'
    WHEN NOT has_items THEN 'empty list' ELSE 'hit' END AS outcome
FROM (SELECT request_id, l.product_id, trim(l.option_id) AS option_id, expires_at,
             CASE WHEN r.option_id <> '' THEN coalesce(cache_status, 'ready') END AS status,
             EXISTS (SELECT 1 FROM {{record_items}} i WHERE i.product_id = r.product_id
                     AND i.option_id = r.option_id) AS has_items
      FROM {{lookups}} l LEFT JOIN {{records}} r
        ON r.product_id = l.product_id AND r.option_id = trim(l.option_id))""")
def _(t):
    preps = cache.cached_preparation(t.states, t.records, t.record_items, AS_OF)
    options = store.restore_options(t.records, t.states)
    asked = t.lookups.withColumnRenamed("option_id", "option_key")
    return cache.resolve_option_lookups(asked, preps, options, t.records, t.record_items, AS_OF)


# --- queue ------------------------------------------------------------------------------------------

_QNOW = "2024-01-30 22:00:00"
_QTS = f"TIMESTAMP '{_QNOW}'"
_LEASE = 3600
_DUE = f"(status = 'failed' AND (next_retry_at IS NULL OR next_retry_at <= {_QTS}))"
_STALE = f"(status = 'collecting' AND last_attempt_at < {_QTS} - INTERVAL '{_LEASE}' SECOND)"


@query("claim_attempts", f"""
WITH m AS (
  SELECT coalesce(q.product_id, w.product_id) AS product_id, coalesce(status, 'pending') AS status,
         coalesce(attempt_count, 0) AS attempt_count, last_attempt_at, next_retry_at, updated_at,
         w.product_id IS NOT NULL AS wanted
  FROM {{queue}} q FULL JOIN (SELECT c_custkey AS product_id FROM {{customer}}) w ON w.product_id = q.product_id),
c AS (SELECT *, wanted AND (status NOT IN ('collecting', 'failed') OR {_DUE} OR coalesce({_STALE}, false))
        AS claimed FROM m)
SELECT product_id, CASE WHEN claimed THEN 'collecting' ELSE status END AS status,
       attempt_count + CAST(claimed AS INT) AS attempt_count,
       CASE WHEN claimed THEN {_QTS} ELSE last_attempt_at END AS last_attempt_at,
       CASE WHEN NOT claimed THEN next_retry_at END AS next_retry_at,
       CASE WHEN claimed THEN {_QTS} ELSE updated_at END AS updated_at, claimed FROM c""")
def _(t):
    return cache.claim_attempts(
        t.queue, t.customer.select(F.col("c_custkey").alias("product_id")), _QNOW, _LEASE)


view("outcomes", "SELECT c_custkey AS product_id, c_acctbal > 0 AS success FROM {customer}")


@query("finish_attempts", f"""
WITH m AS (
  SELECT coalesce(q.product_id, o.product_id) AS product_id, q.status, success, next_retry_at, updated_at,
         coalesce(attempt_count, CASE WHEN success THEN 0 ELSE 1 END) AS attempt_count,
         CASE WHEN q.product_id IS NULL AND NOT success THEN {_QTS} ELSE last_attempt_at END AS last_attempt_at
  FROM {{queue}} q FULL JOIN {{outcomes}} o ON o.product_id = q.product_id)
SELECT product_id, CASE WHEN success IS NULL THEN status WHEN success THEN 'complete' ELSE 'failed' END AS status,
       attempt_count, last_attempt_at,
       CASE WHEN success IS NULL THEN next_retry_at WHEN NOT success THEN {_QTS} + to_seconds(least(
         86400, 60 * CAST(pow(2, least(greatest(attempt_count - 1, 0), 20)) AS BIGINT))) END AS next_retry_at,
       CASE WHEN success IS NOT NULL THEN {_QTS} ELSE updated_at END AS updated_at FROM m""")
def _(t):
    return cache.finish_attempts(t.queue, t.outcomes, _QNOW, 60, 86400)


@query("due_queue", f"""
SELECT product_id, status FROM {{queue}} WHERE status = 'pending' OR {_DUE} OR {_STALE}
ORDER BY updated_at, product_id LIMIT 50""")
def _(t):
    return cache.due_queue(t.queue, _QNOW, 50, _LEASE).select("product_id", "status")


view("manifest", "SELECT o_orderkey AS entry_no, o_orderkey AS product_id FROM {orders}")
_PLAN = f"""
{_PLAIN},
planned AS (SELECT entry_no, product_id, CASE WHEN product_id IN (SELECT product_id FROM plain) THEN 'cache_hit'
  WHEN coalesce(ok, false) THEN 'collected' ELSE 'failed' END AS status
  FROM {{manifest}} LEFT JOIN (SELECT c_custkey AS product_id, c_acctbal > -900 AS ok FROM {{customer}})
  USING (product_id))"""


def _plan(t, **kw):
    preps = cache.cached_preparation(t.states, t.records, t.record_items, AS_OF)
    outcomes = t.customer.select(
        F.col("c_custkey").alias("product_id"), (F.col("c_acctbal") > -900).alias("success"))
    return cache.plan_prefetch(t.manifest, preps, outcomes, **kw)


@query("plan_prefetch", f"""
WITH {_PLAN} SELECT * FROM planned
WHERE entry_no <= (SELECT min(entry_no) FROM planned WHERE status = 'failed')""")
def _(t):
    return _plan(t)


@query("prefetch_summary", f"""
WITH {_PLAN}
SELECT count(*) FILTER (status = 'collected') AS collected, count(*) FILTER (status = 'cache_hit') AS cache_hit,
       0 AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM planned""")
def _(t):
    return cache.prefetch_summary(_plan(t, continue_on_error=True), t.manifest)


@query("queue_run_summary", """
SELECT count(*) AS selected, count(*) FILTER (success) AS complete,
       count(*) FILTER (NOT success) AS failed FROM {outcomes}""")
def _(t):
    return cache.queue_run_summary(t.outcomes)


# Timestamps with and without a zone.
@query("to_utc", """
SELECT event_id, ts AS at FROM {events}""")
def _(t):
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.concat(F.date_format(
        F.col("ts") + F.make_dt_interval(hours=F.lit(9)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+09:00"))
    text = F.when(F.col("event_id") % 2 == 0, shifted).otherwise(plain)
    return t.events.select("event_id", cache.to_utc(text).alias("at"))
