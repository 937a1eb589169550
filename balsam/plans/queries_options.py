"""Queries of option results, source reconciliation and parser reports."""

from pyspark.sql import functions as F

from ..functions.settle import settle
from ..operators import hierarchy, options, segmentation
from . import views  # noqa: F401
from .queries_segmentation import _CANON, _GOOD
from .registry import query, view

# Option rows of a product: its lines; two parsers that differ in places.
view("parser_rows", """
SELECT l_orderkey AS product_id, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey AS position,
       CAST(l_linenumber AS STRING) || CASE WHEN l_quantity > 48 THEN '' ELSE '-' || CAST(l_partkey AS STRING) END AS option_id,
       CASE WHEN l_quantity > 40 THEN 'unmapped' WHEN l_quantity > 35 THEN 'empty' ELSE 'ready' END AS p_status,
       CASE WHEN l_quantity > 45 THEN 'ready' WHEN l_quantity = 1 THEN 'unmapped' WHEN l_quantity > 40 THEN 'unmapped'
            WHEN l_quantity > 35 THEN 'empty' ELSE 'ready' END AS c_status,
       l_quantity = 2 AS changed, l_quantity = 3 AS lost, p_name AS item
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
""")


def _parsers(t):
    rows = settle(t.parser_rows)
    p = rows.select("product_id", "position", "option_id", F.col("p_status").alias("status"),
                    F.array("item", F.lit("x")).alias("ingredients"))
    c = rows.filter("NOT lost AND product_id % 50 > 0").select(
        "product_id", "position", "option_id", F.col("c_status").alias("status"),
        F.when(F.col("changed"), F.array(F.lit("x"), "item")).otherwise(F.array("item", F.lit("x"))).alias("ingredients"))
    return p, c


_SELECTED = """
p AS (SELECT *, count(*) OVER (PARTITION BY product_id, option_id) > 1 AS twice FROM {parser_rows}),
s AS (SELECT product_id, product_id % 50 = 0 OR bool_and(lost) AS gone, bool_or(twice) AS repeats_p,
        min_by(CASE WHEN lost THEN 'production_option_missing_in_candidate'
             WHEN p_status = 'ready' AND c_status <> 'ready' THEN 'production_ready_option_not_ready_in_candidate'
             ELSE 'production_ready_option_ingredients_changed_in_candidate' END, position)
          FILTER (lost OR (p_status = 'ready' AND (c_status <> 'ready' OR changed))) AS problem,
        count(*) FILTER (p_status = 'ready') AS rp, count(*) FILTER (c_status = 'ready' AND NOT lost) AS rc
      FROM p GROUP BY 1),
chosen AS (SELECT product_id, CASE WHEN gone THEN 'candidate_result_unavailable' WHEN repeats_p THEN 'duplicate_option_id_detected'
  WHEN problem IS NOT NULL THEN problem WHEN rc > rp THEN 'candidate_increases_ready_options_without_regression'
  ELSE 'no_safe_improvement_detected' END AS reason FROM s)"""


@query("select_safe_result", f"""
WITH {_SELECTED}
SELECT product_id, CASE WHEN reason LIKE 'candidate_increases%' THEN 'candidate' ELSE 'production' END AS selected, reason
FROM chosen""")
def _(t):
    return options.select_safe_result(*_parsers(t))


@query("effective_options", f"""
WITH {_SELECTED}
SELECT product_id, option_id AS option_key, status, status = 'ready' AS analysis_available,
       CASE WHEN status = 'ready' THEN item || ',x' ELSE '' END AS ingredients, selected AS provenance
FROM (SELECT r.product_id, option_id, item, CASE WHEN reason LIKE 'candidate_increases%' THEN c_status ELSE p_status END AS status,
             CASE WHEN reason LIKE 'candidate_increases%' THEN 'candidate' ELSE 'production' END AS selected
      FROM {{parser_rows}} r JOIN chosen USING (product_id) WHERE reason <> 'duplicate_option_id_detected')""")
def _(t):
    p, c = _parsers(t)
    selection = settle(options.select_safe_result(p, c).filter("reason <> 'duplicate_option_id_detected'"))
    canonical = p.join(selection, "product_id", "left_semi").select(
        "product_id", F.col("option_id").alias("option_key"), F.lit("n").alias("option_name")).distinct()
    return options.effective_options(canonical, p, c, selection).select(
        "product_id", "option_key", "status", "analysis_available",
        F.array_join("ingredients", ",").alias("ingredients"), "provenance")


@query("option_status", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN CASE WHEN l_tax > 0.04 THEN 'ready' ELSE 'empty' END
  WHEN 1 THEN 'unmapped' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unmapped' WHEN 4 THEN 'error' ELSE 'error' END AS status FROM {lineitem}""")
def _(t):
    names = F.array(*[F.lit(s) for s in ("matched", "unmatched", "ambiguous", "unsupported", "error", "odd")])
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.get(names, F.col("l_quantity").cast("int") % 6).alias("mapping_status"),
        F.when(F.col("l_tax") > 0.04, F.array(F.lit("x"))).alias("ingredients"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", options.option_status().alias("status"))


@query("collection_status", """
SELECT o_orderkey AS product_id, coalesce(n, 0) AS n_options, coalesce(r, 0) AS n_ready,
  CASE WHEN coalesce(r, 0) = 0 THEN 'failed' WHEN r = n THEN 'ready' ELSE 'partial' END AS collection_status
FROM {orders} LEFT JOIN (SELECT product_id, count(*) AS n, count(*) FILTER (p_status = 'ready') AS r FROM {parser_rows} GROUP BY 1) s
  ON product_id = o_orderkey""")
def _(t):
    products = t.orders.select(F.col("o_orderkey").alias("product_id"))
    return options.collection_status(products, t.parser_rows.withColumn("status", F.col("p_status")))


@query("first_analysable_option", """
SELECT product_id, min_by(option_id, position) AS option_id FROM {parser_rows} WHERE p_status = 'ready' GROUP BY 1""")
def _(t):
    return options.first_analysable(t.parser_rows.withColumn("analysis_available", F.col("p_status") == "ready"))


# --- two sources ---------------------------------------------------------------------------------------
# Options of a brand: the shown list and the embedded list, with brands that break each gate.
view("source_rows", """
SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS product_id, CAST(p_partkey % 10 AS INT) AS n,
       CAST(floor(p_partkey / 10) AS BIGINT) % 9 AS kind, 'Opt ' || CAST(p_partkey % 10 AS STRING) AS name, p_size % 2 = 0 AS sold
FROM {part}
""")
_A = "SELECT product_id, n AS sort_order, CASE WHEN kind = 2 AND n = 1 THEN 'opt-0' WHEN kind IN (3, 5) AND n = 0 THEN 'only shown' ELSE name END AS raw_option_name, " \
     "sold AS sold_out, CASE WHEN sold THEN CAST(NULL AS BOOLEAN) ELSE false END AS disabled FROM {source_rows}"
_B = "SELECT product_id, CASE WHEN kind = 8 THEN 9 - n ELSE n END AS seq, CASE WHEN kind = 2 AND n = 1 THEN 'Opt.0' WHEN kind = 5 AND n = 0 THEN 'only there' ELSE upper(name) END AS option_name, " \
     "CASE WHEN kind = 6 AND n < 2 THEN 'same' ELSE 'N' || CAST(n AS STRING) END AS option_number, 'C' AS standard_code, " \
     "CASE WHEN kind = 7 AND n = 0 THEN NOT sold WHEN n = 5 THEN CAST(NULL AS BOOLEAN) ELSE sold END AS sold_out_flag, " \
     "CASE WHEN n = 4 THEN CAST(NULL AS INT) ELSE n + 100 END AS sort_order, n = 0 AS representative, " \
     "CASE WHEN n <> 3 THEN concat('https://img.test/', n) END AS image_url, CASE WHEN n = 2 THEN NULL ELSE array('all', upper(name)) END AS group_path, " \
     "kind = 4 AS combination_option_flag FROM {source_rows} WHERE kind <> 0 AND NOT (kind = 1 AND n = 9)"


@query("reconcile_sources", """
WITH k AS (SELECT product_id, kind, count(*) AS n FROM {source_rows} GROUP BY 1, 2)
SELECT product_id, CASE WHEN kind = 0 THEN 'partial_metadata_enrichment' WHEN kind = 8 THEN 'complete_match_reordered'
    WHEN kind = 4 THEN 'complete_match' ELSE 'mismatch' END AS status,
  CASE kind WHEN 1 THEN 'count_mismatch' WHEN 2 THEN 'duplicate_name_collision' WHEN 3 THEN 'normalized_name_mismatch'
    WHEN 5 THEN 'normalized_name_mismatch' WHEN 6 THEN 'option_number_collision' WHEN 7 THEN 'sold_out_state_mismatch'
    WHEN 8 THEN 'order_only_mismatch' END AS category FROM k""")
def _(t):
    return options.reconcile_sources(t.sql(_A), t.sql(_B))


@query("merge_option_metadata", """
SELECT product_id, name AS raw_option_name, lower(replace(name, ' ', '')) AS normalized_option_name,
  CASE WHEN kind <> 0 THEN 'N' || CAST(n AS STRING) END AS option_number, CASE WHEN kind <> 0 THEN 'C' END AS standard_code,
  CASE WHEN kind = 0 THEN sold WHEN n = 5 THEN NULL ELSE sold END AS sold_out_flag,
  CASE WHEN sold THEN 'temporarily_sold_out' ELSE 'available' END AS availability,
  CASE WHEN kind <> 0 AND n <> 4 THEN n + 100 ELSE n END AS sort_order, CASE WHEN kind <> 0 THEN n = 0 END AS representative,
  CASE WHEN kind <> 0 THEN 'N' || CAST(n AS STRING) END AS source_option_id,
  CASE WHEN kind <> 0 AND n <> 3 THEN 'https://img.test/' || CAST(n AS STRING) END AS image_url,
  CASE WHEN kind <> 0 AND n <> 2 THEN 'all>' || upper(name) ELSE '' END AS group_path,
  CASE WHEN kind <> 0 THEN kind = 4 END AS combination_option_flag, CASE WHEN NOT sold THEN false END AS dom_disabled
FROM {source_rows} WHERE kind IN (0, 4, 8)""")
def _(t):
    a, b = t.sql(_A), t.sql(_B)
    merged = options.merge_option_metadata(a, b, options.reconcile_sources(a, b))
    return merged.withColumn("group_path", F.array_join("group_path", ">"))


# --- parser reports ---------------------------------------------------------------------------------------

def _first(t):
    canonical = segmentation.canonicalize_options(t.label_options)
    return canonical, *segmentation.map_options(segmentation.cut_sections(t.label_docs), canonical)


_COUNTED = f"""{_CANON}, {_GOOD},
counted AS (SELECT doc_id, count(*) AS n, count(*) FILTER (mapping_status = 'matched') AS n_matched,
  count(*) FILTER (mapping_status = 'unmatched') AS n_unmatched, count(*) FILTER (mapping_status = 'ambiguous') AS n_ambiguous,
  count(*) FILTER (mapping_status = 'unsupported') AS n_unsupported FROM mapped GROUP BY 1)"""


@query("option_status_counts", f"""
WITH {_COUNTED} SELECT doc_id, n_matched, n_unmatched, n_ambiguous, n_unsupported FROM counted""")
def _(t):
    return options.option_status_counts(_first(t)[1])


@query("match_rate_report", f"""
WITH {_COUNTED}
SELECT doc_id, n AS n_options, n_matched, n_matched / n AS rate, NULL AS mean_ready_options, NULL AS mean_unready_rate FROM counted
UNION ALL SELECT NULL, sum(n), sum(n_matched), sum(n_matched) / sum(n), avg(n) FILTER (n = n_matched),
  avg(n_matched / n) FILTER (n <> n_matched) FROM counted""")
def _(t):
    return options.match_rate_report(_first(t)[1])


@query("mapping_diagnostics", f"""
WITH {_COUNTED},
h AS (SELECT doc_id, count(*) FILTER (r.grammar = 'malformed_bracket') AS n_malformed_headers,
        count(*) FILTER (r.grammar <> 'malformed_bracket' AND c.key IS NULL) AS n_orphan_headers,
        count(*) FILTER (r.grammar <> 'malformed_bracket' AND c.key IS NOT NULL AND g.n_headers > 1) AS n_ambiguous_headers
      FROM (SELECT doc_id, label_key AS key, grammar FROM {{label_rows}}) r LEFT JOIN canon c USING (doc_id, key)
      LEFT JOIN (SELECT doc_id, key, n_headers FROM good) g USING (doc_id, key) GROUP BY 1),
m AS (SELECT doc_id, sum(n_sources) AS n_raw_options, count(*) AS n_canonical FROM canon GROUP BY 1)
SELECT doc_id, n_raw_options, n_canonical, n_raw_options - n_canonical AS n_merged_duplicates, n_matched, n_unmatched,
  n_ambiguous, n_unsupported, n_orphan_headers, n_malformed_headers, n_ambiguous_headers, 'flat' AS document_format
FROM m JOIN counted USING (doc_id) LEFT JOIN h USING (doc_id)""")
def _(t):
    canonical, mapped, headers = _first(t)
    formats = t.label_docs.select("doc_id", F.lit("flat").alias("document_format"))
    return options.mapping_diagnostics(canonical, mapped, headers, formats)


# The same documents mapped by whole labels, all of them taken as flat.
def _exact(t):
    canonical = segmentation.canonicalize_options(t.exact_options)
    sections = hierarchy.build_sections(hierarchy.comma_chunks(t.long_docs)).withColumn(
        "section_kind", F.when(F.col("section_no") % 4 == 0, "component_group").otherwise("ingredient_section"))
    formats = t.long_docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "needs_review").otherwise(
        "option_full_sections").alias("document_format"))
    return sections, canonical, formats, hierarchy.map_sections_exact(sections, canonical, formats)


_HK = "CAST(p_size AS STRING) || ' ' || p_name"
_EXACT = f"""
opt AS (SELECT doc_id, n, CASE WHEN p_size % 7 = 1 THEN 'other ' || CAST(n AS STRING) ELSE {_HK} END AS label,
          CASE WHEN p_size % 7 = 1 THEN 'other' || CAST(n AS STRING) ELSE label_key END AS key FROM {{label_rows}}),
canon AS (SELECT doc_id, key, min(n) AS option_pos, min(label) AS label FROM opt GROUP BY 1, 2),
sec AS (SELECT doc_id, n + 1 AS section_no, header, {_HK} AS label, n % 4 <> 3 AS plain, p_name, p_brand FROM {{label_rows}}),
heads AS (SELECT doc_id, label, count(*) AS n_sections, min(section_no) AS section_no FROM sec WHERE plain GROUP BY 1, 2),
n_opt AS (SELECT doc_id, label, count(*) AS n_options FROM canon GROUP BY 1, 2),
em AS (SELECT doc_id, option_pos, CASE WHEN doc_id % 5 = 0 THEN 'unsupported' WHEN n_sections > 1 OR (n_sections = 1 AND n_options > 1)
         THEN 'ambiguous' WHEN n_sections = 1 THEN 'matched' ELSE 'unmatched' END AS status, section_no
       FROM canon LEFT JOIN heads USING (doc_id, label) JOIN n_opt USING (doc_id, label))"""


@query("describe_sections", f"""
WITH {_EXACT}
SELECT doc_id, section_no, header AS raw_header, CASE WHEN m.doc_id IS NOT NULL THEN 'matched' WHEN doc_id % 5 = 0 THEN 'unsupported'
    WHEN NOT plain THEN 'excluded' WHEN o.label IS NOT NULL THEN 'ambiguous' ELSE 'orphan' END AS status, 4 AS n_ingredients,
  p_name || '|' || p_brand || ' (a, b)' AS first_ingredients
FROM sec LEFT JOIN (SELECT doc_id, section_no FROM em WHERE status = 'matched') m USING (doc_id, section_no)
LEFT JOIN (SELECT DISTINCT doc_id, label FROM canon) o USING (doc_id, label)""")
def _(t):
    sections, canonical, formats, mapped = _exact(t)
    return options.describe_sections(sections, mapped, canonical, formats, n=2).select(
        "doc_id", "section_no", "raw_header", "status", "n_ingredients",
        F.array_join("first_ingredients", "|").alias("first_ingredients"))


@query("component_groups", """
SELECT doc_id, n + 1 AS section_no, header AS raw_header, 4 AS n_ingredients FROM {label_rows} WHERE n % 4 = 3""")
def _(t):
    return options.component_groups(_exact(t)[0])


@query("orphan_sections", f"""
WITH {_EXACT}
SELECT doc_id, section_no, header AS raw_header FROM sec
WHERE plain AND NOT EXISTS (SELECT 1 FROM canon c WHERE c.doc_id = sec.doc_id AND c.label = sec.label)""")
def _(t):
    sections, canonical, _f, _m = _exact(t)
    return hierarchy.orphan_sections(sections, canonical).select("doc_id", "section_no", "raw_header")


@query("parser_diff", f"""
WITH {_CANON}, {_GOOD}, x AS (SELECT doc_id, count(*) FILTER (mapping_status = 'matched') AS m, count(*) FILTER (mapping_status = 'unmatched') AS u
  FROM mapped GROUP BY 1)
SELECT doc_id, coalesce(x.m, 0) AS n_matched, coalesce(y.m, 0) AS c_matched, CASE WHEN coalesce(x.m, 0) <> coalesce(y.m, 0) THEN coalesce(x.m, 0) - coalesce(y.m, 0) END AS d
FROM x FULL JOIN (SELECT doc_id, count(*) FILTER (option_pos % 2 = 0) AS m FROM canon GROUP BY 1) y USING (doc_id)""")
def _(t):
    _c, mapped, _h = _first(t)
    other = mapped.select("doc_id", F.when(F.col("option_pos") % 2 == 0, "matched").otherwise("unmatched").alias("mapping_status"))
    return options.parser_diff(mapped, other).select(
        "doc_id", "n_matched", "c_matched", F.element_at("status_diff", F.lit("matched")).alias("d"))


# --- diagnostics ---------------------------------------------------------------------------------------------
view("prefix_docs", """
SELECT p_partkey AS doc_id, '[' || p_brand || '] water, ' || p_type || ', Tone ' || p_name || ' water, ' || p_name
       || CASE WHEN p_size % 2 = 0 THEN ', oil, Dark water, end' ELSE '' END AS text FROM {part}
""")


@query("prefix_candidates", """
SELECT p_partkey AS doc_id, 2 AS chunk_index, 'Tone ' || p_name AS prefix_candidate, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END AS n_until_next FROM {part}
UNION ALL SELECT p_partkey, 5, 'Dark', 2 FROM {part} WHERE p_size % 2 = 0""")
def _(t):
    sections = hierarchy.build_sections(hierarchy.comma_chunks(t.prefix_docs))
    return options.prefix_candidates(sections).select("doc_id", "chunk_index", "prefix_candidate", "n_until_next")


@query("trailing_text_candidates", """
SELECT p_partkey AS doc_id, CASE WHEN p_size % 5 = 0 THEN 'oil' ELSE 'water' END AS preceding_ingredient,
  CASE WHEN p_size % 5 = 0 THEN '[end]' ELSE '[note ' || p_type || ']' END AS trailing_text, false AS has_body_after,
  'document_end' AS boundary_type FROM {part} WHERE p_size % 5 = 0 OR p_size % 2 = 0
UNION ALL SELECT p_partkey, '', '[' || CASE WHEN p_size % 3 = 0 THEN '증정' ELSE p_brand END || ']', true, 'document_end' FROM {part}
WHERE p_size % 4 > 0""")
def _(t):
    sections = hierarchy.build_sections(hierarchy.comma_chunks(t.note_docs))
    canonical = t.part.filter("p_size % 4 = 0").select(
        F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 3 == 0, "증정").otherwise(F.col("p_brand")).alias("raw_option_name"))
    return options.trailing_text_candidates(sections, canonical).select(
        "doc_id", "preceding_ingredient", "trailing_text", "has_body_after", "boundary_type")


view("hash_docs", """
SELECT p_partkey AS doc_id, '#Alpha water, oil, ' || p_name || ' # Beta ' || CASE WHEN p_size % 3 = 0 THEN 'x' ELSE p_type || ', b' END AS text FROM {part}
""")


def _hash_options(t):
    return t.part.select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(
        F.lit("red (alpha)"), F.when(F.col("p_size") % 2 == 0, "blue (Beta)").otherwise("blue"))).alias("raw_option_name"))


# A '#' label is letters and words as far as they go, so only headers before a capital or a digit
# end early; the bodies here start with lower-case words that become part of the label.
@query("research_header_grammars_brackets", """
SELECT p_partkey AS doc_id, '[' || p_name || ')' AS raw_header, CASE WHEN p_size % 4 = 0 THEN 2 WHEN p_size % 4 = 1 THEN 0 ELSE 1 END AS n_options,
  CASE WHEN p_size % 4 >= 2 AND p_size % 5 > 0 THEN 'repair_candidate' ELSE 'ambiguous' END AS mapping_status FROM {part}""")
def _(t):
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), F.concat(
        F.lit("["), "p_name", F.lit(") "), F.when(F.col("p_size") % 5 == 0, "water").otherwise("water, oil")).alias("text"))
    named = t.part.select(F.col("p_partkey").alias("doc_id"), F.explode(F.when(
        F.col("p_size") % 4 == 0, F.array(F.concat(F.lit("1 "), "p_name"), F.concat(F.lit("2 "), "p_name"))).when(
        F.col("p_size") % 4 == 1, F.array(F.lit("zz"))).otherwise(F.array(F.concat(F.lit("3 "), F.upper("p_name"))))).alias("raw_option_name"))
    return options.research_header_grammars(docs, named, "single_mismatched_bracket").select(
        "doc_id", "raw_header", "n_options", "mapping_status")


@query("research_header_grammars_hash", """
SELECT p_partkey AS doc_id, 'Alpha' AS label, 1 AS n_options, 'matched' AS mapping_status FROM {part}
UNION ALL SELECT p_partkey, 'Beta', CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END,
  CASE WHEN p_size % 2 = 0 AND p_size % 3 > 0 THEN 'matched' ELSE 'unmatched' END FROM {part}""")
def _(t):
    docs = t.hash_docs.withColumn("text", F.regexp_replace("text", "(#Alpha|# Beta) ", "$1 1. "))
    return options.research_header_grammars(docs, _hash_options(t), "hash_english_alias").select(
        "doc_id", "label", "n_options", "mapping_status")


@query("research_full_labels", """
SELECT doc_id, label, CASE WHEN p_size % 7 = 1 THEN 'orphan' ELSE 'matched' END AS mapping_status FROM {plain_rows}""")
def _(t):
    labels = t.plain_rows.select("doc_id", "n", "label")
    named = t.plain_rows.select("doc_id", F.when(F.col("p_size") % 7 == 1, "none").otherwise(F.upper("label")).alias("raw_option_name"))
    return options.research_full_labels(t.plain_docs, named, labels).select("doc_id", "label", "mapping_status")
