"""Queries of the registry builds and their quality checks."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import quality, registry_build, windows
from . import views  # noqa: F401
from .duck import clean
from .registry import query


def _fill_sql(width: int) -> str:
    view = {3: "prohibited_rows", 5: "restricted_rows"}[width]
    own = "c[1]" if width == 3 else "c[1] || '|' || c[2] || '|' || c[3]"
    lone = "len(c) = 1" if width == 3 else "false"
    limit, notes = (("''", "''") if width == 3 else (
        "split_part(cur, '|', 2)", "split_part(cur, '|', 3)"))
    return f"""
WITH clean AS (
  SELECT source_table, source_row, list_transform(cells, lambda x: {clean('x')}) AS c
  FROM {{{view}}} WHERE source_row > 1),
marked AS (
  SELECT *, CASE WHEN (len(c) >= {width} OR {lone}) AND c[1] <> '' THEN {own} END AS mark FROM clean),
filled AS (
  SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY source_table ORDER BY source_row) AS cur
  FROM marked WHERE len(c) >= {width} OR len(c) = 2 OR {lone})
SELECT source_table, source_row,
       CASE WHEN len(c) = 2 THEN split_part(cur, '|', 1) ELSE c[1] END AS ingredient_kor_name,
       {limit} AS usage_limit, {notes} AS notes,
       CASE WHEN len(c) >= {width} THEN CASE WHEN c[{width - 1}] = '-' THEN '' ELSE c[{width - 1}] END
            WHEN len(c) = 2 THEN CASE WHEN c[1] = '-' THEN '' ELSE c[1] END ELSE '' END AS cas_no,
       nullif(CASE WHEN len(c) >= {width} THEN c[{width}] WHEN len(c) = 2 THEN c[2] ELSE '' END, '')
         AS chemical_name
FROM filled WHERE coalesce(CASE WHEN len(c) = 2 THEN split_part(cur, '|', 1) ELSE c[1] END, '') <> ''"""


@query("fill_merged_cells_prohibited", _fill_sql(3))
def _(t):
    return registry_build.fill_merged_cells(t.prohibited_rows, 3)


@query("fill_merged_cells_restricted", _fill_sql(5))
def _(t):
    return registry_build.fill_merged_cells(t.restricted_rows, 5)


@query("unexpected_table_rows", """
SELECT source_table, source_row, len(cells) AS n_cells, CASE source_table
         WHEN 1 THEN 'preservative' WHEN 2 THEN 'uv_filter' WHEN 3 THEN 'hair_dye'
         WHEN 4 THEN 'restricted_other' END AS category
FROM {restricted_rows} WHERE source_row > 1 AND len(cells) NOT IN (2, 5)""")
def _(t):
    return registry_build.unexpected_rows(t.restricted_rows, 5).select(
        "source_table", "source_row", F.size("cells").alias("n_cells"),
        registry_build.table_category("source_table").alias("category"))


# The pages are built from `part`, so the rows cut out of them must be its rows again.
@query("extract_numbered_rows", f"""
SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS page_id, CAST(p_partkey % 50 + 1 AS INT) AS source_row,
       p_name || CASE WHEN p_size > 25 THEN ' ' || p_type ELSE '' END AS ingredient_kor_name,
       {views.cas('p_partkey')} AS cas_no
FROM {{part}}""")
def _(t):
    out = registry_build.extract_numbered_rows(t.numbered_pages)
    return out.withColumn("cas_no", F.element_at("cas_numbers", 1)).drop("cas_numbers")


@query("pages_without_rows", """
SELECT page_id, 'heading not found' AS reason FROM {pages}
WHERE html NOT LIKE '%연번 성분명 CAS 등록번호%'""")
def _(t):
    pages = t.pages.select("page_id", F.col("html").alias("text"))
    return registry_build.pages_without_rows(pages, registry_build.extract_numbered_rows(pages))


_META = ["source_id", "document_title", "dataset_version"]


@query("attach_source_metadata", """
SELECT p_partkey, p_name, source_id, document_title, dataset_version FROM {part}, {metadata}""")
def _(t):
    return registry_build.attach_source_metadata(
        t.part.select("p_partkey", "p_name"), t.metadata, _META)


@query("missing_metadata", """
SELECT unnest(['notice_date', 'notice_number']) AS field FROM {metadata}""")
def _(t):
    return registry_build.missing_metadata(
        t.metadata, [*_META, "notice_number", "notice_date"])


# Two registries that overlap: all parts as prohibited, then the parts again without their brand.
_A = "SELECT p_partkey AS seq, p_name || ' ' || p_brand AS ingredient_kor_name, '' AS cas_no, " \
     "CASE WHEN p_size % 9 = 0 THEN 'notice' ELSE 'prohibited' END AS regulation_type, " \
     "lower(p_type) AS category FROM {part}"
_B = "SELECT p_partkey AS seq, p_name AS ingredient_kor_name, CAST(p_size AS STRING) AS cas_no, " \
     "'restricted' AS regulation_type, CASE WHEN p_size % 4 = 0 THEN lower(p_type) END AS category, " \
     "p_brand AS max_concentration FROM {part}"
_MERGED = f"""
merged AS (
  SELECT 0 AS part, seq, ingredient_kor_name, cas_no, regulation_type, category,
         NULL AS max_concentration FROM ({_A})
  UNION ALL
  SELECT 1, seq, ingredient_kor_name, cas_no, regulation_type, category, max_concentration
  FROM ({_B}))"""
_UNIQUE = """
uniq AS (SELECT * FROM merged QUALIFY row_number() OVER (
  PARTITION BY ingredient_kor_name, cas_no, regulation_type, coalesce(category, '')
  ORDER BY part, seq) = 1)"""


def _merged(t):
    return registry_build.merge_registries(t.sql(_A), t.sql(_B))


@query("merge_registries", f"WITH {_MERGED} SELECT * FROM merged")
def _(t):
    return _merged(t)


@query("deduplicate_registry", f"WITH {_MERGED}, {_UNIQUE} SELECT * FROM uniq")
def _(t):
    return registry_build.deduplicate_registry(_merged(t))


@query("registry_duplicate_count", f"""
WITH {_MERGED}, {_UNIQUE}
SELECT (SELECT count(*) FROM merged) AS n_rows, (SELECT count(*) FROM uniq) AS n_kept,
       (SELECT count(*) FROM merged) - (SELECT count(*) FROM uniq) AS n_removed""")
def _(t):
    return registry_build.duplicate_count(_merged(t))


@query("sort_registry", f"""
WITH {_MERGED}, {_UNIQUE}
SELECT part, seq, ingredient_kor_name, CASE regulation_type WHEN 'prohibited' THEN 0
         WHEN 'restricted' THEN 1 ELSE 99 END AS type_rank
FROM uniq""")
def _(t):
    out = registry_build.sort_registry(registry_build.deduplicate_registry(_merged(t)))
    return out.select("part", "seq", "ingredient_kor_name",
                      registry_build.type_rank().alias("type_rank"))


@query("registry_summary", f"""
WITH {_MERGED}
SELECT 'regulation_type' AS facet, coalesce(regulation_type, 'unknown') AS value, count(*) AS n
FROM merged GROUP BY 1, 2 UNION ALL
SELECT 'category', coalesce(category, 'unknown'), count(*) FROM merged GROUP BY 1, 2""")
def _(t):
    return registry_build.registry_summary(_merged(t))


_REQUIRED = ["ingredient_kor_name", "category", "max_concentration", "product_scope", "warning_text"]


@query("check_required", """
SELECT seq, concat_ws(',', CASE WHEN coalesce(max_concentration, '') = '' THEN 'max_concentration' END,
         CASE WHEN coalesce(product_scope, '') = '' THEN 'product_scope' END,
         CASE WHEN coalesce(warning_text, '') = '' THEN 'warning_text' END) AS missing
FROM {regulations}
WHERE coalesce(max_concentration, '') = '' OR coalesce(product_scope, '') = ''
   OR coalesce(warning_text, '') = ''""")
def _(t):
    return quality.check_required(t.regulations, _REQUIRED).withColumn(
        "missing", F.array_join("missing", ","))


@query("check_source_id", """
SELECT seq, source_id FROM {regulations} WHERE source_id <> 'SRC-1'""")
def _(t):
    return quality.check_source_id(t.regulations, "SRC-1")


@query("check_regulations", """
SELECT seq, regulation_type, 'decision basis missing' AS reason FROM {regulations}
WHERE regulation_type = 'restricted' AND max_concentration IS NULL AND product_scope IS NULL
  AND use_conditions IS NULL AND warning_text IS NULL""")
def _(t):
    return quality.check_regulations(t.regulations)


@query("check_allergens", """
SELECT seq, 'legal status' AS reason FROM {allergens} WHERE legal_status <> 'labeling_required'
UNION ALL SELECT NULL, unnest(['row count', 'row numbers not contiguous'])""")
def _(t):
    return quality.check_allergens(t.allergens, 25)


@query("check_counts", """
SELECT (SELECT count(*) FROM {part}) + (SELECT count(*) FROM {supplier}) AS n_parts,
       (SELECT count(*) FROM {orders}) AS n_merged, 'more rows than the parts' AS reason
WHERE (SELECT count(*) FROM {orders}) >
      (SELECT count(*) FROM {part}) + (SELECT count(*) FROM {supplier})""")
def _(t):
    return quality.check_counts([t.part, t.supplier], t.orders)


@query("check_source_complete", """
SELECT product_id, name AS query_ingredient, concat_ws(',',
         CASE WHEN source_section IS NULL THEN 'source_section' END) AS missing
FROM {mixed_items} JOIN {allergens} ON name = cas_numbers[1] WHERE source_section IS NULL""")
def _(t):
    from ..operators.matching import match_allergens_by_cas

    out = quality.check_source_complete(
        match_allergens_by_cas(t.mixed_items, t.allergens), quality.ALLERGEN_PROVENANCE,
        ["product_id"])
    return out.withColumn("missing", F.array_join("missing", ","))


@query("duplicates", """
SELECT p_name, p_brand, count(*) AS n FROM {part} GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return windows.duplicates(t.part, ["p_name", "p_brand"])
