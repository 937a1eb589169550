"""Queries of the retrieval operators."""

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import context, retrieval
from . import views  # noqa: F401
from .duck import clean, retrieval_key
from .registry import query

_EXACT = f"""
entries AS (
  SELECT row, key, score FROM (
    SELECT row, {retrieval_key('ingredient_kor_name')} AS key, 100 AS score, 1 AS f FROM {{docs}}
    UNION ALL SELECT row, {retrieval_key('ingredient_eng_name')}, 95, 2 FROM {{docs}}
    UNION ALL SELECT row, {retrieval_key('synonym')}, 90, 3 FROM {{docs}}
    UNION ALL SELECT row, {retrieval_key('cas_no')}, 90, 4 FROM {{docs}})
  WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY row, key ORDER BY f) = 1),
exact AS (
  SELECT query_id, row, CAST(score AS DOUBLE) AS match_score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row) AS rank,
         'exact_match' AS retrieval_type
  FROM {{search_queries}} JOIN entries ON {retrieval_key('query')} = key
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row) <= 8)"""

_VECTOR = """
scored AS (
  SELECT query_id, d.row, list_cosine_similarity(q.vector::DOUBLE[], d.vector::DOUBLE[]) AS s
  FROM {search_queries} q, {docs} d),
vec AS (
  SELECT query_id, row, round(s * 100, 2) AS match_score,
         row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row) AS rank,
         'vector_search' AS retrieval_type
  FROM scored WHERE s >= THRESHOLD
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row) <= 8)"""

_HYBRID = """
hybrid AS (
  SELECT * FROM exact UNION ALL
  SELECT * FROM vec WHERE query_id NOT IN (SELECT query_id FROM exact))"""

_COLS = "query_id, row, match_score, rank, retrieval_type"


def _sql(threshold, body, *parts):
    return "WITH " + ",".join(parts).replace("THRESHOLD", str(threshold)) + body


@query("exact_retrieve", _sql(0, f" SELECT {_COLS} FROM exact", _EXACT))
def _(t):
    return retrieval.exact_retrieve(t.search_queries, t.docs)


@query("vector_retrieve", _sql(0.75, f" SELECT {_COLS} FROM vec", _VECTOR))
def _(t):
    return retrieval.vector_retrieve(t.search_queries, t.docs)


@query("vector_retrieve_low_threshold", _sql(0.2, f" SELECT {_COLS} FROM vec", _VECTOR))
def _(t):
    return retrieval.vector_retrieve(t.search_queries, t.docs, threshold=0.2)


@query("hybrid_retrieve", _sql(0.3, f" SELECT {_COLS} FROM hybrid", _EXACT, _VECTOR, _HYBRID))
def _(t):
    return retrieval.hybrid_retrieve(t.search_queries, t.docs, threshold=0.3)


_REQUEST_DOCS = """
hits AS (
  SELECT r.request_id, r.position, r.query AS query_ingredient, h.rank AS hit_rank, h.match_score,
         h.retrieval_type, d.*
  FROM {document_requests} r JOIN {search_queries} q ON r.request_id + r.position = q.query_id
  JOIN hybrid h ON h.query_id = q.query_id AND h.rank <= r.search_k JOIN {docs} d ON d.row = h.row),
uniq AS (
  SELECT *, coalesce(nullif(ingredient_kor_name, ''), nullif(ingredient_eng_name, ''),
                     substr(content, 1, 100)) AS k FROM hits
  QUALIFY row_number() OVER (PARTITION BY request_id, k ORDER BY position, hit_rank, row) = 1),
found AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY position, hit_rank, row) AS rank
  FROM uniq QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY position, hit_rank, row) <= 10)"""
_PARTS = (_EXACT, _VECTOR, _HYBRID, _REQUEST_DOCS)


def _found(t):
    return retrieval.retrieve_for_ingredients(t.document_requests, t.docs, threshold=0.3)


# A text is searched once; texts that need a vector are unique in this input.
@query("retrieve_for_ingredients", _sql(0.3, """
SELECT request_id, rank, row, query_ingredient, match_score, retrieval_type FROM found""", *_PARTS))
def _(t):
    return _found(t).select(
        "request_id", "rank", "row", "query_ingredient", "match_score", "retrieval_type")


@query("retrieval_counts", _sql(0.3, """
SELECT request_id, count(*) FILTER (retrieval_type = 'exact_match') AS exact_match_count,
       count(*) FILTER (retrieval_type = 'vector_search') AS vector_fallback_count,
       count(row) AS retrieved_doc_count
FROM (SELECT DISTINCT request_id FROM {document_requests}) LEFT JOIN found USING (request_id)
GROUP BY 1""", *_PARTS))
def _(t):
    return retrieval.retrieval_counts(t.document_requests, _found(t))


@query("build_context", _sql(0.3, """
SELECT request_id,
       coalesce(string_agg('[근거 문서 ' || CAST(rank AS VARCHAR) || ']\n출처: ' || source
         || '\n성분명: ' || CASE WHEN ingredient_kor_name = '' THEN '정보 없음' ELSE ingredient_kor_name END
         || '\n영문명: ' || ingredient_eng_name || '\n' || content, '\n\n' ORDER BY rank),
         '검색된 성분 정보가 없습니다.') AS context,
       count(row) AS retrieved_doc_count
FROM (SELECT DISTINCT request_id FROM {document_requests}) LEFT JOIN found USING (request_id)
GROUP BY 1""", *_PARTS))
def _(t):
    return context.build_context(t.document_requests.select("request_id").distinct(), _found(t))


@query("build_sources", """
SELECT doc_id, source, substr(text, 1, 500) AS content FROM {documents}""")
def _(t):
    docs = t.documents.select("doc_id", "source", F.col("text").alias("content"))
    return context.build_sources(docs)


_DEDUP_DOCS = """
SELECT l_orderkey AS request_id, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey AS rank,
       p_name AS ingredient_kor_name, CASE WHEN p_size % 2 = 0 THEN p_type END AS ingredient_eng_name,
       '' AS cas_no, p_brand AS content
FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("dedup_documents", f"""
SELECT request_id, rank, ingredient_kor_name, content FROM ({_DEDUP_DOCS}) QUALIFY row_number() OVER (
  PARTITION BY request_id, ingredient_kor_name, ingredient_eng_name, content ORDER BY rank) = 1""")
def _(t):
    docs = t.sql(_DEDUP_DOCS.replace("lineitem", "{lineitem}").replace(" part ", " {part} "))
    return retrieval.dedup_documents(docs, ["request_id"], "rank").select(
        "request_id", "rank", "ingredient_kor_name", "content")


@query("dedup_documents_by_name", f"""
SELECT request_id, rank, ingredient_kor_name, content FROM ({_DEDUP_DOCS}) QUALIFY row_number() OVER (
  PARTITION BY request_id, ingredient_kor_name ORDER BY rank) = 1""")
def _(t):
    docs = t.sql(_DEDUP_DOCS.replace("lineitem", "{lineitem}").replace(" part ", " {part} "))
    return retrieval.dedup_documents(docs, ["request_id"], "rank", by="name").select(
        "request_id", "rank", "ingredient_kor_name", "content")


_RENDER = f"""concat_ws('\n', '화장품 원료성분 정보',
  CASE WHEN {clean('ingredient_kor_name')} <> '' THEN '성분명: ' || {clean('ingredient_kor_name')} END,
  CASE WHEN {clean('ingredient_eng_name')} <> '' THEN '영문명: ' || {clean('ingredient_eng_name')} END,
  CASE WHEN {clean('cas_no')} <> '' THEN 'CAS 번호: ' || {clean('cas_no')} END,
  CASE WHEN {clean('origin_description')} <> '' THEN '원료 설명: ' || {clean('origin_description')} END,
  CASE WHEN {clean('synonym')} <> '' THEN '동의어: ' || {clean('synonym')} END)"""


@query("render_item_text", f"SELECT row, {_RENDER} AS content FROM {{ingredients}}")
def _(t):
    return t.ingredients.select("row", context.render_item_text().alias("content"))


@query("dedup_corpus", f"""
WITH named AS (
  SELECT row, {_RENDER} AS content, 'ingredient-' || md5(lower({clean('ingredient_kor_name')} || '|' ||
         {clean('ingredient_eng_name')} || '|')) AS document_id
  FROM {{ingredients}} WHERE {clean('ingredient_kor_name')} || {clean('ingredient_eng_name')} <> '')
SELECT row, content, document_id FROM named
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY row) = 1""")
def _(t):
    # The number is left out of the identity, so that equal names do collide in this input.
    out = retrieval.dedup_corpus(
        t.ingredients.withColumnRenamed("cas_no", "shown").withColumn("cas_no", F.lit("")))
    full = out.drop("cas_no").withColumnRenamed("shown", "cas_no")
    return full.select("row", context.render_item_text().alias("content"), "document_id")


@query("content_keys", f"""
SELECT row, 'ingredient-' || md5(lower({clean('ingredient_kor_name')} || '|' ||
       {clean('ingredient_eng_name')} || '|' || {clean('cas_no')})) AS document_id,
       sha256(trim(coalesce(origin_description, ''))) AS record_hash,
       substr(sha256(lower(replace(ingredient_kor_name, ' ', ''))), 1, 16) AS option_key
FROM {{ingredients}}""")
def _(t):
    return t.ingredients.select(
        "row", keys.document_id("ingredient_kor_name", "ingredient_eng_name", "cas_no")
        .alias("document_id"),
        keys.record_hash(F.coalesce("origin_description", F.lit(""))).alias("record_hash"),
        keys.option_key(keys.full_label_key("ingredient_kor_name")).alias("option_key"),
    )
