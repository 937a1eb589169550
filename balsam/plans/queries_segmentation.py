"""Queries of both parsers.  Their documents are put together from the rows of `part`, so the
sections cut out of a text must be those rows again; that is what the SQL side states."""

from pyspark.sql import functions as F

from ..functions.settle import settle
from ..operators import hierarchy, segmentation
from . import views  # noqa: F401
from .duck import clean, comma_chunks
from .registry import query, view

_LABEL = ("CASE WHEN p_size % 6 = 0 THEN '0' || CAST(p_size AS STRING) || '호 ' || p_name "
          "ELSE CAST(p_size AS STRING) || ' ' || p_name END")
_KEY = ("replace(CASE WHEN p_size % 6 = 0 THEN '0' || CAST(p_size AS STRING) || p_name "
        "ELSE CAST(p_size AS STRING) || p_name END, ' ', '')")
_LONG = "p_name || ', ' || p_brand || ' (a, b), ' || p_type || ', 1,2-diol'"
view("label_rows", f"""
SELECT p_partkey, CAST(floor(p_partkey / 8) AS BIGINT) AS doc_id, CAST(p_partkey % 8 AS INT) AS n,
       p_size, p_name, p_brand, {_KEY} AS label_key, {_LABEL} AS label,
       CASE WHEN p_size % 4 = 2 THEN '★ ' || {_LABEL} || ' :' WHEN p_size % 4 = 3 THEN '[' || {_LABEL} || ')'
            ELSE '[' || {_LABEL} || ']' END AS header,
       CASE WHEN p_size % 4 = 2 THEN 'star_colon' WHEN p_size % 4 = 3 THEN 'malformed_bracket'
            ELSE 'bracketed' END AS grammar,
       CASE WHEN p_size % 11 = 0 THEN 'only ' || p_brand ELSE {_LONG} END AS body,
       {_LONG} AS long_body,
       CASE WHEN p_size % 11 = 0 THEN 'only ' || p_brand
            ELSE p_name || '|' || p_brand || ' (a, b)|' || p_type || '|1,2-diol' END AS ingredients
FROM {{part}}
""")


def _docs(name: str, piece: str, sep: str, source: str = "{label_rows}", order: str = "p_partkey",
          before: str = "''") -> None:
    text = f"SELECT doc_id, {before} || AGG AS text FROM {source} GROUP BY doc_id"
    view(name, text.replace("AGG", f"listagg({piece}, {sep}) WITHIN GROUP (ORDER BY {order})"),
         text.replace("AGG", f"string_agg({piece}, {sep} ORDER BY {order})"))


_docs("label_docs", "header || ' ' || body", "' '")
_docs("long_docs", "header || ' ' || long_body", "' '")
view("label_options", """
SELECT doc_id, n AS option_pos, 'id' || CAST(n AS STRING) AS source_option_id,
       CASE WHEN p_size % 7 = 0 THEN '[기획] ' || label WHEN p_size % 7 = 1 THEN 'other' ELSE label END
         AS raw_option_name
FROM {label_rows}
UNION ALL
SELECT doc_id, n + 8, CAST(NULL AS STRING), '단품 ' || label FROM {label_rows} WHERE p_size % 9 = 0
""")
# Canonical options by key, as SQL.
_CANON = """
opt AS (
  SELECT doc_id, n AS pos, CASE WHEN p_size % 7 = 1 THEN 'other' ELSE label_key END AS key,
         CASE WHEN p_size % 7 = 0 THEN '[기획] ' || label WHEN p_size % 7 = 1 THEN 'other' ELSE label END AS raw,
         'id' || CAST(n AS STRING) AS sid FROM {label_rows}
  UNION ALL SELECT doc_id, n + 8, label_key, '단품 ' || label, NULL FROM {label_rows} WHERE p_size % 9 = 0),
canon AS (SELECT doc_id, key, min(pos) AS option_pos, count(*) AS n_sources FROM opt GROUP BY 1, 2)"""


@query("extract_headers", """
SELECT doc_id, CAST(before + 0 AS INT) AS start, CAST(before + length(header) AS INT) AS "end",
       header AS raw_header, label, grammar, label_key, grammar = 'malformed_bracket' AS malformed
FROM (SELECT *, coalesce(sum(length(header) + length(body) + 2) OVER (PARTITION BY doc_id ORDER BY n
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {label_rows})""")
def _(t):
    return segmentation.extract_headers(t.label_docs)


@query("cut_sections", """
SELECT doc_id, header AS raw_header, label_key, body, ingredients, p_size % 11 <> 0 AS valid FROM {label_rows}""")
def _(t):
    return segmentation.cut_sections(t.label_docs).select(
        "doc_id", "raw_header", "label_key", "body", F.array_join("ingredients", "|").alias("ingredients"),
        "valid")


@query("canonicalize_options", f"""
WITH {_CANON}
SELECT doc_id, option_pos, key AS mapping_key, n_sources,
       (SELECT string_agg(raw, '|' ORDER BY pos) FROM (SELECT raw, min(pos) AS pos FROM opt o
        WHERE o.doc_id = c.doc_id AND o.key = c.key GROUP BY raw)) AS source_names,
       coalesce((SELECT string_agg(sid, '|' ORDER BY pos) FROM opt o
        WHERE o.doc_id = c.doc_id AND o.key = c.key AND sid IS NOT NULL), '') AS source_ids,
       substr(sha256(key), 1, 16) AS option_key
FROM canon c""")
def _(t):
    return segmentation.canonicalize_options(t.label_options).select(
        "doc_id", "option_pos", "mapping_key", "n_sources", "option_key",
        F.array_join("source_names", "|").alias("source_names"),
        F.array_join("source_ids", "|").alias("source_ids"))


_GOOD = """
good AS (SELECT doc_id, label_key AS key, count(*) AS n_headers, min(header) AS header, min(grammar) AS grammar,
         min(ingredients) AS ingredients, bool_and(p_size % 11 <> 0) AS valid
         FROM {label_rows} WHERE grammar <> 'malformed_bracket' GROUP BY 1, 2),
bad AS (SELECT DISTINCT doc_id, label_key AS key FROM {label_rows} WHERE grammar = 'malformed_bracket'),
mapped AS (
  SELECT doc_id, option_pos, key,
         CASE WHEN n_headers > 1 THEN 'ambiguous' WHEN n_headers IS NULL THEN 'unmatched'
              WHEN valid THEN 'matched' ELSE 'unsupported' END AS mapping_status,
         CASE WHEN n_headers > 1 THEN 'duplicate_explicit_headers'
              WHEN n_headers IS NULL AND bad.key IS NOT NULL THEN 'malformed_explicit_header'
              WHEN n_headers IS NULL THEN 'unmatched_sale_option'
              WHEN valid THEN 'explicit_' || grammar || '_exact' ELSE 'invalid_ingredient_section' END
           AS mapping_method,
         CASE WHEN n_headers = 1 THEN header END AS matched_header,
         CASE WHEN n_headers = 1 AND valid THEN ingredients ELSE '' END AS ingredients
  FROM canon LEFT JOIN good USING (doc_id, key) LEFT JOIN bad USING (doc_id, key))"""


@query("header_option_candidates", f"""
WITH {_CANON}
SELECT DISTINCT doc_id, header AS raw_header, option_pos FROM {{label_rows}} JOIN canon c USING (doc_id)
WHERE label_key = key""")
def _(t):
    headers = segmentation.extract_headers(t.label_docs)
    aliases = segmentation.option_aliases(segmentation.canonicalize_options(t.label_options))
    hits = segmentation.header_option_candidates(headers, aliases)
    return hits.join(headers, ["doc_id", "start"]).select("doc_id", "raw_header", "option_pos").distinct()


@query("map_options", f"""
WITH {_CANON}, {_GOOD}
SELECT doc_id, option_pos, mapping_status, mapping_method, matched_header, ingredients FROM mapped""")
def _(t):
    mapped, _h = segmentation.map_options(
        segmentation.cut_sections(t.label_docs), segmentation.canonicalize_options(t.label_options))
    return mapped.select("doc_id", "option_pos", "mapping_status", "mapping_method", "matched_header",
                         F.array_join("ingredients", "|").alias("ingredients"))


@query("header_statuses", f"""
WITH {_CANON}, {_GOOD}
SELECT doc_id, header AS raw_header, n, CASE WHEN r.grammar = 'malformed_bracket' THEN 'malformed'
         WHEN g.n_headers > 1 AND c.key IS NOT NULL THEN 'ambiguous'
         WHEN c.key IS NOT NULL THEN 'matched' ELSE 'orphan' END AS status
FROM (SELECT doc_id, header, grammar, label_key AS key, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n
      FROM {{label_rows}}) r
LEFT JOIN canon c USING (doc_id, key) LEFT JOIN (SELECT doc_id, key, n_headers FROM good) g USING (doc_id, key)""")
def _(t):
    from pyspark.sql import Window

    _m, headers = segmentation.map_options(
        segmentation.cut_sections(t.label_docs), segmentation.canonicalize_options(t.label_options))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    return headers.withColumn("n", n).select("doc_id", "raw_header", "n", "status")


# Every label document is flat: its headers all fit options or none, and none of them nest.
@query("parse_option_sections", f"""
WITH {_CANON}, {_GOOD}
SELECT doc_id, option_pos, mapping_status, mapping_method FROM mapped""")
def _(t):
    out = segmentation.parse_option_sections(t.label_docs, t.label_options)
    return out["mappings"].select("doc_id", "option_pos", "mapping_status", "mapping_method")


# --- structure: tops with two nested headers each -----------------------------------------------------
view("nested_rows", """
SELECT p_partkey, CAST(floor(p_partkey / 4) AS BIGINT) AS doc_id, CAST(p_partkey % 4 AS INT) AS n, p_size,
       'T' || lpad(CAST(p_partkey % 4 AS STRING), 2, '0') || ' ' || p_name AS label,
       '[T' || lpad(CAST(p_partkey % 4 AS STRING), 2, '0') || ' ' || p_name || '] '
       || CASE WHEN p_size % 3 = 0 THEN '[alpha' || CAST(p_partkey AS STRING) || '] a, b [beta'
                    || CAST(p_partkey AS STRING) || '] c, d'
               WHEN p_size % 3 = 1 THEN '[gamma] e, f' ELSE 'g, h' END AS piece
FROM {part}
""")
_docs("nested_docs", "piece", "' '", "{nested_rows}")
view("nested_options", "SELECT doc_id, n AS option_pos, CAST(NULL AS STRING) AS source_option_id, "
     "label AS raw_option_name FROM {nested_rows}")


@query("classify_structure", """
WITH d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (p_size % 3 = 0) AS deep,
                  count(*) FILTER (p_size % 3 = 1) AS shared FROM {nested_rows} GROUP BY 1)
SELECT doc_id, CASE WHEN n >= 2 AND deep >= 2 THEN 'hierarchical_option_internal_sections'
         WHEN n >= 2 AND deep + shared >= 2 AND shared >= 2 THEN 'needs_review'
         ELSE 'option_full_sections' END AS document_format,
       n AS top_level_header_count, CASE WHEN n >= 2 THEN deep * 2 + shared ELSE 0 END AS nested_header_count
FROM d""")
def _(t):
    canonical = segmentation.canonicalize_options(t.nested_options)
    return segmentation.classify_structure(t.nested_docs, canonical).select(
        "doc_id", "document_format", "top_level_header_count", "nested_header_count")


# --- repeated unbracketed labels -------------------------------------------------------------------------
view("repeat_rows", """
SELECT p_partkey, CAST(floor(p_partkey / 5) AS BIGINT) AS doc_id, CAST(p_partkey % 5 AS INT) AS n, p_size,
       lpad(CAST(p_partkey % 5 + 1 AS STRING), 2, '0') || ' 가나' AS label,
       p_name || ', ' || p_brand || ', ' || p_type || ' powder' AS tail
FROM {part}
""")
_docs("repeat_docs", "label || ' 정제수, ' || CASE WHEN p_size = 50 THEN 'x' ELSE tail END", "' '",
      "{repeat_rows}")
view("repeat_options", "SELECT doc_id, n AS option_pos, CAST(NULL AS STRING) AS source_option_id, "
     "CASE WHEN p_size % 10 = 0 THEN 'none ' || CAST(n AS STRING) ELSE label END AS raw_option_name FROM {repeat_rows}")


@query("detect_repeated_labels", """
WITH ok AS (SELECT doc_id FROM {repeat_rows} GROUP BY 1
            HAVING count(*) >= 3 AND count(*) FILTER (p_size % 10 > 0) >= 2 AND count(*) FILTER (p_size = 50) = 0)
SELECT doc_id, label, '정제수, ' || tail AS body FROM {repeat_rows} WHERE doc_id IN (SELECT doc_id FROM ok)""")
def _(t):
    canonical = segmentation.canonicalize_options(t.repeat_options)
    return segmentation.detect_repeated_labels(t.repeat_docs, canonical).select("doc_id", "label", "body")


# --- unmarked option names ---------------------------------------------------------------------------------
view("plain_rows", f"""
SELECT p_partkey, CAST(floor(p_partkey / 6) AS BIGINT) AS doc_id, CAST(p_partkey % 6 AS INT) AS n, p_size, p_brand,
       'N' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || ' ' || p_name AS label, {_LONG} AS body,
       p_name || '|' || p_brand || ' (a, b)|' || p_type || '|1,2-diol' AS ingredients
FROM {{part}}
""")
_docs("plain_docs", "label || chr(10) || body", "chr(10)", "{plain_rows}")
view("plain_options", """
SELECT doc_id, n AS option_pos, CAST(NULL AS STRING) AS source_option_id,
       CASE WHEN p_size % 7 = 1 THEN 'zz' || CAST(n AS STRING) ELSE label END AS raw_option_name FROM {plain_rows}
UNION ALL
SELECT doc_id, n + 6, CAST(NULL AS STRING), '[' || p_brand || '] ' || label FROM {plain_rows} WHERE p_size % 9 = 0
""")


@query("locate_option_headers", """
WITH o AS (SELECT doc_id, n, n AS option_pos, p_size % 7 = 1 AS gone, 'normalized_mapping_key' AS method,
                  CAST(1.0 AS DOUBLE) AS confidence, p_size FROM {plain_rows}
  UNION ALL SELECT doc_id, n, n + 6, false, 'code_and_label', CAST(0.9 AS DOUBLE), p_size FROM {plain_rows} WHERE p_size % 9 = 0),
place AS (SELECT doc_id, n, label, coalesce(sum(length(label) + length(body) + 2) OVER (PARTITION BY doc_id
         ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {plain_rows})
SELECT doc_id, option_pos, CAST(start AS INT) AS start, CAST(start + length(label) AS INT) AS "end", method, confidence,
       CASE WHEN count(*) OVER (PARTITION BY doc_id, n) > 1 THEN 'shared' ELSE 'single' END AS span_status
FROM o JOIN place USING (doc_id, n) WHERE NOT gone""")
def _(t):
    canonical = segmentation.canonicalize_options(t.plain_options)
    return segmentation.locate_option_headers(t.plain_docs, canonical).select(
        "doc_id", "option_pos", "start", "end", "method", "confidence", "span_status")


@query("located_sections", """
WITH o AS (SELECT doc_id, n, n AS option_pos, p_size % 7 = 1 AS gone FROM {plain_rows}
  UNION ALL SELECT doc_id, n, n + 6, false FROM {plain_rows} WHERE p_size % 9 = 0),
shown AS (SELECT DISTINCT doc_id, n FROM o WHERE NOT gone),
-- A section runs on over the options that are not found, to the next one that is.
owner AS (SELECT r.doc_id, r.n, max(s.n) AS head FROM {plain_rows} r JOIN shown s ON s.doc_id = r.doc_id AND s.n <= r.n
          GROUP BY 1, 2)
SELECT o.doc_id, option_pos, CASE WHEN gone THEN 'unmatched' ELSE 'matched' END AS mapping_status,
       CASE WHEN gone THEN 0 ELSE (SELECT count(DISTINCT p_brand) FROM owner w JOIN {plain_rows} x
         ON x.doc_id = w.doc_id AND x.n = w.n WHERE w.doc_id = o.doc_id AND w.head = o.n) END AS n_bodies
FROM o""")
def _(t):
    canonical = segmentation.canonicalize_options(t.plain_options)
    out = segmentation.located_sections(t.plain_docs, canonical)
    return out.select("doc_id", "option_pos", "mapping_status",
                      F.when(F.col("mapping_status") == "matched", F.size(F.filter(
                          "ingredients", lambda x: x.contains("(a, b)")))).otherwise(0).alias("n_bodies"))


# --- second parser ---------------------------------------------------------------------------------------
_SPLIT = comma_chunks("{documents}")


@query("comma_chunks", f"""
WITH {_SPLIT}
SELECT doc_id, chunk_index, chunk, CAST(start AS INT) AS start,
       CAST(start + length(chunk) AS INT) AS "end"
FROM (SELECT *, coalesce(sum(length(chunk) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)""")
def _(t):
    return hierarchy.comma_chunks(t.documents)


@query("classify_chunks", f"""
WITH {_SPLIT}
SELECT doc_id, chunk_index, CASE WHEN regexp_full_match(x, '[0-9]+(\\.[0-9]+)?') THEN 'numeric'
    WHEN length(x) <= 8 AND regexp_full_match(x, '[A-Za-z]*[0-9]+[A-Za-z]*') AND regexp_matches(x, '[A-Za-z]')
    THEN 'alphanumeric' ELSE 'text' END AS kind
FROM (SELECT *, {clean('chunk')} AS x FROM c)""")
def _(t):
    return hierarchy.classify_chunks(hierarchy.comma_chunks(t.documents)).select(
        "doc_id", "chunk_index", "kind")


@query("boundary_candidates", """
SELECT doc_id, '1,2-diol' AS preceding_text, header AS boundary_text, p_name AS following_text, grammar
FROM {label_rows} WHERE n > 0""")
def _(t):
    rows = hierarchy.boundary_candidates(hierarchy.comma_chunks(t.long_docs))
    return rows.filter("kind = 'embedded_header'").select(
        "doc_id", "preceding_text", "boundary_text", "following_text", "grammar")


@query("build_sections", """
SELECT doc_id, CAST(n + 1 AS BIGINT) AS section_no, header AS raw_header, long_body AS body, 4 AS n_ingredients FROM {label_rows}""")
def _(t):
    return hierarchy.build_sections(hierarchy.comma_chunks(t.long_docs)).select(
        "doc_id", "section_no", "raw_header", F.trim("body").alias("body"),
        F.size("ingredients").alias("n_ingredients"))


_HEADER_KEY = ("CASE WHEN p_size % 6 = 0 THEN CAST(p_size AS STRING) || ' ' || p_name "
               "ELSE CAST(p_size AS STRING) || ' ' || p_name END")
view("exact_options", "SELECT doc_id, n AS option_pos, CAST(NULL AS STRING) AS source_option_id, CASE WHEN p_size % 7 = 1 "
     "THEN 'other ' || CAST(n AS STRING) ELSE label END AS raw_option_name FROM {label_rows}")


def _second(t):
    from ..operators.matching import build_dictionary

    return hierarchy.parse_sections_exact(t.long_docs, t.exact_options, build_dictionary(t.ingredients))


# Flat documents map by label; documents whose header numbers start again map nothing.
@query("map_sections_exact", f"""
WITH h AS (SELECT doc_id, n, p_size, {_HEADER_KEY} AS label,
    lag({_HEADER_KEY}) OVER (PARTITION BY doc_id ORDER BY n) AS before,
    max(p_size) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM {{label_rows}}),
deep AS (SELECT doc_id, bool_or(p_size <= top AND label <> before) AS restarts FROM h GROUP BY 1),
opt AS (SELECT doc_id, CASE WHEN p_size % 7 = 1 THEN 'other ' || CAST(n AS STRING) ELSE label END AS label,
               CASE WHEN p_size % 7 = 1 THEN 'other' || CAST(n AS STRING) ELSE label_key END AS key, n
        FROM (SELECT doc_id, n, p_size, label_key, {_HEADER_KEY} AS label FROM {{label_rows}})),
canon AS (SELECT doc_id, key, min(n) AS option_pos, min(label) AS label FROM opt GROUP BY 1, 2),
sec AS (SELECT doc_id, label, count(*) AS n_sections, min(n) + 1 AS section_no FROM h GROUP BY 1, 2),
n_opt AS (SELECT doc_id, label, count(*) AS n_options FROM canon GROUP BY 1, 2)
SELECT doc_id, option_pos, CASE WHEN coalesce(restarts, false) THEN 'unsupported' WHEN n_sections > 1 OR
    (n_sections IS NOT NULL AND n_options > 1) THEN 'ambiguous' WHEN n_sections = 1 THEN 'matched'
    ELSE 'unmatched' END AS mapping_status,
  CASE WHEN NOT coalesce(restarts, false) AND n_sections = 1 AND n_options = 1 THEN section_no END AS section_no
FROM canon LEFT JOIN sec USING (doc_id, label) JOIN n_opt USING (doc_id, label) LEFT JOIN deep USING (doc_id)""")
def _(t):
    return _second(t)["mappings"].select("doc_id", "option_pos", "mapping_status", "section_no")


@query("document_structure", f"""
WITH h AS (SELECT doc_id, n, p_size, {_HEADER_KEY} AS label,
    lag({_HEADER_KEY}) OVER (PARTITION BY doc_id ORDER BY n) AS before,
    max(p_size) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM {{label_rows}})
SELECT doc_id, CASE WHEN coalesce(bool_or(p_size <= top AND label <> before), false)
  THEN 'hierarchical_option_internal_sections' ELSE 'option_full_sections' END AS document_format FROM h GROUP BY 1""")
def _(t):
    return _second(t)["formats"].select("doc_id", "document_format")


@query("section_restart_groups", f"""
WITH h AS (SELECT doc_id, n, p_size, {_HEADER_KEY} AS label,
    lag({_HEADER_KEY}) OVER (PARTITION BY doc_id ORDER BY n) AS before,
    max(p_size) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM {{label_rows}})
SELECT doc_id, n + 1 AS section_no, p_size AS number, sum(CASE WHEN p_size <= top AND label <> before THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS group_no FROM h""")
def _(t):
    return hierarchy.section_restart_groups(hierarchy.build_sections(hierarchy.comma_chunks(t.long_docs)))


# Formulas: 'Tone<n>' in front of a known ingredient opens one.
view("formula_rows", """
SELECT p_partkey, CAST(floor(p_partkey / 4) AS BIGINT) AS doc_id, CAST(p_partkey % 4 AS INT) AS n,
       p_size % 10 > 0 AS toned, p_size % 13 = 0 AS poor, p_name, p_type, p_brand,
       CASE WHEN p_size % 10 > 0 THEN 'Tone' || CAST(p_partkey % 4 AS STRING) || ' ' ELSE '' END || p_name || ', '
       || p_type || ', ' || p_brand || ', ' || CASE WHEN p_size % 13 = 0 THEN 'unknown' ELSE 'water' END AS piece
FROM {part}
""")
_docs("formula_docs", "piece", "', '", "{formula_rows}", before="'[Set] '")
view("formula_dictionary", """
SELECT DISTINCT key FROM (SELECT replace(p_name, ' ', '') AS key FROM {part} UNION ALL
  SELECT lower(p_type) FROM {part} UNION ALL SELECT lower(p_brand) FROM {part} UNION ALL SELECT 'water' FROM {part}) k
""")


def _formula_sections(t):
    return settle(hierarchy.build_sections(hierarchy.comma_chunks(t.formula_docs)))


@query("formula_boundaries", """
SELECT doc_id, n * 4 AS chunk_index, 1 AS n_splits, 'Tone' || CAST(n AS STRING) AS middle
FROM {formula_rows} WHERE toned""")
def _(t):
    out = hierarchy.formula_boundaries(_formula_sections(t), t.formula_dictionary)
    return out.select("doc_id", "chunk_index", "n_splits", F.array_join(F.slice(
        "words", F.col("left_end") + 1, F.col("right_start") - F.col("left_end")), " ").alias("middle"))


@query("evaluate_formulas", """
WITH seg AS (SELECT *, sum(CASE WHEN toned THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n
               ROWS UNBOUNDED PRECEDING) AS s FROM {formula_rows}),
items AS (SELECT doc_id, s, unnest([p_name, p_type, p_brand, CASE WHEN NOT poor THEN 'water' END]) AS x FROM seg),
body AS (SELECT doc_id, s, count(DISTINCT lower(x)) AS known FROM items GROUP BY 1, 2),
d AS (SELECT doc_id, count(*) FILTER (toned) AS marks FROM {formula_rows} GROUP BY 1)
SELECT doc_id, CASE WHEN marks < 2 THEN 'none' WHEN (SELECT min(known) FROM body b WHERE b.doc_id = d.doc_id) < 4
  THEN 'needs_review' ELSE 'hierarchical' END AS outcome,
  CASE WHEN marks > 0 THEN (SELECT count(*) FROM body b WHERE b.doc_id = d.doc_id) END AS n_bodies
FROM d""")
def _(t):
    sections = _formula_sections(t)
    bounds = settle(hierarchy.formula_boundaries(sections, t.formula_dictionary))
    return hierarchy.evaluate_formulas(sections, bounds, t.formula_dictionary).select(
        "doc_id", "outcome", F.when(F.col("subsections").isNotNull(), F.size("subsections")).alias("n_bodies"))


# Numbered formulas 1. to N. under one header; documents with a hole in the numbers are left alone.
view("numbered_rows", """
SELECT p_partkey, CAST(floor(p_partkey / 4) AS BIGINT) AS doc_id, CAST(p_partkey % 4 AS INT) AS n, p_size = 50 AS hole,
       p_name, p_type, CASE WHEN p_size = 50 THEN '9. ' ELSE CAST(p_partkey % 4 + 1 AS STRING) || '. ' END || p_name || ', '
       || p_type || ', ' || p_brand AS piece
FROM {part}
""")
_docs("numbered_docs", "piece", "' '", "{numbered_rows}", before="'[Set] '")


@query("numbered_subsections", """
SELECT doc_id, n + 1 AS n, 3 AS n_ingredients FROM {numbered_rows}
WHERE doc_id IN (SELECT doc_id FROM {numbered_rows} GROUP BY 1 HAVING count(*) >= 3 AND NOT bool_or(hole))""")
def _(t):
    sections = hierarchy.build_sections(hierarchy.comma_chunks(t.numbered_docs))
    return hierarchy.numbered_subsections(sections).select(
        "doc_id", "n", F.size("ingredients").alias("n_ingredients"))


# One document per part: a last ingredient with or without a bracket note, and component groups.
view("note_docs", """
SELECT p_partkey AS doc_id, '[' || CASE WHEN p_size % 3 = 0 THEN '증정' ELSE p_brand END || '] ' || p_name || ', ' || p_type
       || ', ' || p_brand || ', water' || CASE WHEN p_size % 2 = 0 THEN ' [note ' || p_type || ']' ELSE '' END
       || CASE WHEN p_size % 5 = 0 THEN ', oil [end]' ELSE '' END AS text
FROM {part}
""")


def _note_sections(t):
    return hierarchy.build_sections(hierarchy.comma_chunks(t.note_docs))


@query("split_trailing_annotation", """
SELECT p_partkey AS doc_id, CASE WHEN p_size % 5 = 0 THEN 'oil' ELSE 'water' END AS last_ingredient,
  CASE WHEN p_size % 5 = 0 THEN '[end]' WHEN p_size % 2 = 0 THEN '[note ' || p_type || ']' END AS annotation,
  CASE WHEN p_size % 5 = 0 OR p_size % 2 = 0 THEN length(text) - length(CASE WHEN p_size % 5 = 0 THEN '[end]'
       ELSE '[note ' || p_type || ']' END) END AS annotation_start
FROM {part} JOIN {note_docs} ON doc_id = p_partkey""")
def _(t):
    return hierarchy.split_trailing_annotation(_note_sections(t)).select(
        "doc_id", F.element_at("ingredients", -1).alias("last_ingredient"), "annotation", "annotation_start")


@query("classify_section_kind", """
SELECT p_partkey AS doc_id, CASE WHEN p_size % 3 = 0 AND (p_size % 2 = 1 OR p_size % 5 <> 0) THEN 'component_group'
  ELSE 'ingredient_section' END AS section_kind FROM {part}""")
def _(t):
    rows = hierarchy.split_trailing_annotation(_note_sections(t))
    return hierarchy.classify_section_kind(rows, t.formula_dictionary).select("doc_id", "section_kind")
