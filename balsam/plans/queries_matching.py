"""Queries of the exact-matching operators and the product report."""

from pyspark.sql import functions as F

from ..operators import context, matching
from . import views  # noqa: F401
from .duck import clean, dictionary_key, registry_key
from .registry import query
from .report import product_report

# Index of a registry in SQL: best entry per key and record identity.
_REG_INDEX = f"""
reg_entries AS (
  SELECT {registry_key('ingredient_kor_name')} AS key, 'ingredient_kor_name' AS match_type,
         0 AS priority, ingredient_kor_name AS matched_name, * FROM {{regulations}}
  UNION ALL
  SELECT {registry_key('chemical_name')}, 'chemical_name', 1, coalesce(chemical_name, ''), *
  FROM {{regulations}}),
reg_index AS (
  SELECT * FROM reg_entries WHERE key <> '' QUALIFY row_number() OVER (
    PARTITION BY key, regulation_type, category, cas_no, source_row ORDER BY priority, seq) = 1)"""
_ALG_INDEX = f"""
alg_entries AS (
  SELECT {registry_key('ingredient_kor_name')} AS key, 'ingredient_kor_name' AS match_type,
         0 AS priority, ingredient_kor_name AS matched_name, * FROM {{allergens}}
  UNION ALL
  SELECT {registry_key('ingredient_eng_name')}, 'ingredient_eng_name', 1,
         coalesce(ingredient_eng_name, ''), * FROM {{allergens}}
  UNION ALL
  SELECT {registry_key('inci_name')}, 'inci_name', 2, coalesce(inci_name, ''), * FROM {{allergens}}
  UNION ALL
  SELECT {registry_key('a')}, 'alias', 3, NULL, g.*
  FROM (SELECT *, unnest(aliases) AS a FROM {{allergens}}) t JOIN {{allergens}} g USING (seq)),
alg_index AS (
  SELECT * FROM alg_entries WHERE key <> '' QUALIFY row_number() OVER (
    PARTITION BY key, ingredient_kor_name, source_row ORDER BY priority, seq) = 1)"""
_ITEM_KEYS = f"""
item_keys AS (
  SELECT product_id, position, name AS query_ingredient, {registry_key('name')} AS key FROM SRC
  WHERE {registry_key('name')} <> '' QUALIFY row_number() OVER (
    PARTITION BY product_id, {registry_key('name')} ORDER BY position) = 1)"""
_ITEMS = _ITEM_KEYS.replace("SRC", "{items}")

_OUT = ["product_id", "position", "query_ingredient", "matched_name", "match_type", "source_row"]


@query("match_regulations", f"""
WITH {_REG_INDEX}, {_ITEMS}
SELECT product_id, position, query_ingredient, matched_name, match_type, source_row,
       regulation_type, category
FROM item_keys JOIN reg_index USING (key)""")
def _(t):
    return matching.match_regulations(t.items, t.regulations).select(
        *_OUT, "regulation_type", "category")


@query("match_allergens", f"""
WITH {_ALG_INDEX}, {_ITEMS}
SELECT product_id, position, query_ingredient,
       coalesce(matched_name, query_ingredient) AS matched_name, match_type, source_row
FROM item_keys JOIN alg_index USING (key)""")
def _(t):
    return matching.match_allergens(t.items, t.allergens).select(*_OUT)


_REG_CAS = """
cas_index AS (
  SELECT unnest(regexp_extract_all(cas_no, '\\b[0-9]{2,7}-[0-9]{2}-[0-9]\\b')) AS key, *
  FROM {regulations})"""


@query("match_regulations_by_cas", f"""
WITH {_REG_CAS}
SELECT product_id, position, name AS query_ingredient, key AS matched_name,
       'cas_no' AS match_type, source_row
FROM {{mixed_items}} JOIN cas_index ON replace({clean('name')}, ' ', '') = key""")
def _(t):
    return matching.match_regulations_by_cas(t.mixed_items, t.regulations).select(*_OUT)


@query("match_allergens_by_cas", f"""
WITH cas_index AS (SELECT unnest(cas_numbers) AS key, * FROM {{allergens}})
SELECT product_id, position, name AS query_ingredient, key AS matched_name,
       'cas_no' AS match_type, source_row
FROM {{mixed_items}} JOIN cas_index ON replace({clean('name')}, ' ', '') = key""")
def _(t):
    return matching.match_allergens_by_cas(t.mixed_items, t.allergens).select(*_OUT)


@query("match_by_name_or_cas", f"""
WITH {_REG_INDEX}, {_REG_CAS},
routed AS (SELECT *, regexp_full_match(name, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') AS shaped
           FROM {{mixed_items}})
SELECT product_id, position, name AS query_ingredient, matched_name, match_type, source_row
FROM (SELECT DISTINCT * FROM routed WHERE NOT shaped) r
JOIN reg_index ON {registry_key('name')} = key
UNION ALL
SELECT product_id, position, name, key, 'cas_no', source_row
FROM (SELECT * FROM routed WHERE shaped) r JOIN cas_index ON name = key""")
def _(t):
    return matching.match_by_name_or_cas(t.mixed_items, t.regulations, "regulation").select(*_OUT)


@query("build_dictionary", f"""
SELECT DISTINCT key FROM (
  SELECT {dictionary_key('ingredient_kor_name')} AS key FROM {{ingredients}}
  UNION ALL
  SELECT {dictionary_key('s')} FROM
    (SELECT unnest(string_split(coalesce(synonym, ''), ',')) AS s FROM {{ingredients}}))
WHERE key <> ''""")
def _(t):
    return matching.build_dictionary(t.ingredients)


@query("known_ingredients", f"""
WITH dict AS (
  SELECT DISTINCT key FROM (
    SELECT {dictionary_key('ingredient_kor_name')} AS key FROM {{ingredients}}
    UNION ALL
    SELECT {dictionary_key('s')} FROM
      (SELECT unnest(string_split(coalesce(synonym, ''), ',')) AS s FROM {{ingredients}})))
SELECT product_id, position, name,
       {dictionary_key('name')} IN (SELECT key FROM dict) AS is_known
FROM {{items}}""")
def _(t):
    return matching.known_ingredients(t.items, matching.build_dictionary(t.ingredients))


@query("regulation_response", f"""
WITH {_REG_INDEX}, {_ITEMS}
SELECT product_id, query_ingredient, matched_name, match_type, regulation_type, category, cas_no,
       chemical_name, max_concentration, product_scope, use_conditions, warning_text, source_id,
       source_authority, source_document, notice_number, notice_label, notice_date,
       source_section, source_table, source_row
FROM item_keys JOIN reg_index USING (key)""")
def _(t):
    return context.map_regulation_response(matching.match_regulations(t.items, t.regulations))


@query("allergen_response", f"""
WITH {_ALG_INDEX}, {_ITEMS}
SELECT product_id, query_ingredient, coalesce(matched_name, query_ingredient) AS matched_name,
       match_type, ingredient_kor_name, ingredient_eng_name, inci_name,
       array_to_string(cas_numbers, ',') AS cas_numbers, array_to_string(aliases, ',') AS aliases,
       allergen_type, legal_status, jurisdiction, evidence_scope,
       array_to_string(reaction_types, ',') AS reaction_types, sensitization_note, oxidation_note,
       rinse_off_threshold, leave_on_threshold, source_id, source_authority, source_document,
       source_document_version, source_document_date, source_section, source_page, source_row
FROM item_keys JOIN alg_index USING (key)""")
def _(t):
    out = context.map_allergen_response(matching.match_allergens(t.items, t.allergens))
    return out.withColumns({
        c: F.array_join(c, ",") for c in ("cas_numbers", "aliases", "reaction_types")
    })


_LINES = "'\\n'".replace("\\n", "\n")


def _line(label, c):
    return f"CASE WHEN coalesce({c}, '') <> '' THEN '{label}: ' || {c} END"


def _context_sql(index, source, heading, specs, notes, columns):
    body = ", ".join([f"'성분명: ' || query_ingredient", *[_line(a, b) for a, b in specs]])
    return f"""
WITH {index}, {_ITEMS},
rows AS (
  SELECT product_id, position, priority, seq, concat_ws({_LINES}, {body}) AS body
  FROM (SELECT *, {columns} FROM item_keys JOIN {source} USING (key))),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY position, priority, seq) AS n
  FROM rows)
SELECT product_id, '{chr(10).join(heading)}' || '\n\n' ||
       string_agg(CAST(n AS VARCHAR) || '. ' || body, '\n\n' ORDER BY n) || '\n\n' ||
       '{chr(10).join(notes)}' AS context
FROM numbered GROUP BY product_id"""


@query("regulation_context", _context_sql(
    _REG_INDEX, "reg_index", context.texts.REGULATION_HEADING, context.texts.REGULATION_LINES,
    context.texts.REGULATION_NOTES, "source_document || ' ' || source_section AS source_text"))
def _(t):
    return context.regulation_context(matching.match_regulations(t.items, t.regulations))


@query("allergen_context", _context_sql(
    _ALG_INDEX, "alg_index", context.texts.ALLERGEN_HEADING, context.texts.ALLERGEN_LINES,
    context.texts.ALLERGEN_NOTES, "array_to_string(cas_numbers, ', ') AS cas_text"))
def _(t):
    return context.allergen_context(matching.match_allergens(t.items, t.allergens))


@query("product_report", f"""
WITH {_REG_INDEX}, {_ALG_INDEX},
names AS (SELECT product_id, {clean('name')} AS name, min(position) AS position
          FROM {{items}} WHERE {clean('name')} <> '' GROUP BY ALL),
{_ITEM_KEYS.replace('SRC', 'names')},
n AS (SELECT product_id, count(*) AS ingredient_count FROM names GROUP BY 1),
r AS (SELECT product_id, count(*) AS regulation_count,
             count(*) FILTER (regulation_type = 'prohibited') AS prohibited_count,
             count(*) FILTER (regulation_type = 'restricted') AS restricted_count,
             string_agg(query_ingredient || '|' || match_type || '|' || CAST(source_row AS VARCHAR),
                        ';' ORDER BY position, priority, seq) AS regulations
      FROM item_keys JOIN reg_index USING (key) GROUP BY 1),
a AS (SELECT product_id, count(*) AS allergen_count,
             string_agg(query_ingredient || '|' || match_type || '|' || CAST(source_row AS VARCHAR),
                        ';' ORDER BY position, priority, seq) AS allergens
      FROM item_keys JOIN alg_index USING (key) GROUP BY 1)
SELECT q.product_id, category, coalesce(ingredient_count, 0) AS ingredient_count,
       coalesce(regulation_count, 0) AS regulation_count,
       coalesce(prohibited_count, 0) AS prohibited_count,
       coalesce(restricted_count, 0) AS restricted_count, regulations,
       coalesce(allergen_count, 0) AS allergen_count, allergens
FROM {{requests}} q LEFT JOIN n USING (product_id) LEFT JOIN r USING (product_id)
LEFT JOIN a USING (product_id)""")
def _(t):
    out = product_report(t.requests, t.items, t.regulations, t.allergens)

    def text(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(
            "|", x["query_ingredient"], x["match_type"], x["source_row"].cast("string"))), ";")

    return out.withColumns({"regulations": text("regulations"), "allergens": text("allergens")})
