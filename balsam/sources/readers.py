"""Readers: JSON lines, API pages, manifests, product pages, embedded option data, rule documents."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..functions.settle import spread
from ..functions.text import collapse, let, strip
from ..operators.windows import keep_first

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON-lines files with a fixed schema; blank lines are skipped and a malformed line
    stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_errors(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line) of the lines that are not a JSON object of the schema."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.filter(strip("value") != "").withColumn("p", parsed)
    bad = F.col(f"p.{CORRUPT}").isNotNull() | ~strip("value").startswith("{")
    return rows.filter(bad).select("file", F.col("value").alias("line"))


# --- API pages ---------------------------------------------------------------------------------

# Item fields of the ingredient API and the names they get here.
API_FIELDS = {
    "INGR_KOR_NAME": "ingredient_kor_name", "INGR_ENG_NAME": "ingredient_eng_name", "CAS_NO": "cas_no",
    "ORIGIN_MAJOR_KOR_NAME": "origin_description", "INGR_SYNONYM": "synonym",
}
OK_CODE = "00"
_RAW_ITEM = T.StructType([T.StructField(f, T.StringType()) for f in API_FIELDS])
_ITEMS = T.ArrayType(_RAW_ITEM)


def _items_from_variant(v: Column) -> Column:
    """Items of a JSON payload: an optional response and body around, and a list, an object that
    holds `item`, or one object inside."""
    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(v, path, kind)

    def pick(*paths: str) -> Column:
        lists = [get(p, "array<variant>") for p in paths]
        singles = [F.when(F.schema_of_variant(get(p, "variant")).startswith("OBJECT"), F.array(get(p, "variant")))
                   for p in paths]
        return F.coalesce(*lists, *singles)

    roots = ["$.response.body", "$.response", "$.body", "$"]
    return F.coalesce(*[pick(f"{r}.items.item", f"{r}.items") for r in roots])


def _named(get) -> Column:
    return F.struct(*[F.coalesce(collapse(get(f)), F.lit("")).alias(name) for f, name in API_FIELDS.items()])


def _json_items(pages: DataFrame, payload: str) -> DataFrame:
    items = _items_from_variant(F.col("__v"))
    return pages.withColumn("__v", F.try_parse_json(payload)).select("page_no", F.transform(
        items, lambda x: _named(lambda f: F.try_variant_get(x, f"$.{f}", "string"))).alias("__items"))


def _before_first_empty(items: DataFrame) -> DataFrame:
    """Explode the item arrays of the pages before the first empty one.

    The first empty page is one minimum over the pages, so no page waits for another."""
    empty = F.coalesce(F.size("__items"), F.lit(0)) <= 0
    stop = items.filter(empty).agg(F.min("page_no").alias("n")).scalar()
    kept = items.filter(stop.isNull() | (F.col("page_no") < stop))
    return kept.select("page_no", F.posexplode("__items").alias("item_no", "__i")).select(
        "page_no", "item_no", "__i.*")


def parse_json_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """(page_no, item_no, ingredient fields) of JSON pages up to the first page without items."""
    return _before_first_empty(_json_items(pages, payload))


_XML = T.StructType([
    T.StructField("header", T.StructType([
        T.StructField("resultCode", T.StringType()), T.StructField("resultMsg", T.StringType())])),
    T.StructField("body", T.StructType([
        T.StructField("items", T.StructType([T.StructField("item", _ITEMS)]))])),
])


def _xml_items(pages: DataFrame, payload: str, on_error: str) -> DataFrame:
    code = F.coalesce(F.col("__x.header.resultCode"), F.lit(OK_CODE))
    good = code.isin(OK_CODE, "")
    if on_error == "raise":
        said = F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(" reports "), code, F.lit(": "),
                        F.coalesce(F.col("__x.header.resultMsg"), F.lit("")))
        good = F.when(good, True).otherwise(F.raise_error(said).cast("boolean"))
    return pages.withColumn("__x", F.from_xml(payload, _XML)).filter(good).select(
        "page_no", F.transform("__x.body.items.item", lambda x: _named(lambda f: x[f])).alias("__items"))


def parse_xml_pages(pages: DataFrame, payload: str = "payload", on_error: str = "raise") -> DataFrame:
    """The same from XML pages.  A page that reports an error code stops the job; with on_error="skip"
    it gives no rows, and `xml_errors` lists it."""
    return _before_first_empty(_xml_items(pages, payload, on_error))


def xml_errors(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Pages whose result code reports an error."""
    parsed = pages.select("page_no", F.from_xml(payload, _XML).alias("x"))
    return parsed.filter(~F.coalesce(F.col("x.header.resultCode"), F.lit(OK_CODE)).isin(OK_CODE, "")).select(
        "page_no", F.col("x.header.resultCode").alias("result_code"), F.col("x.header.resultMsg").alias("result_msg"))


def parse_pages(pages: DataFrame, payload: str = "payload", on_error: str = "raise") -> DataFrame:
    """Pages of either kind: text that starts with '<', or is no JSON, is XML; error pages as in `parse_xml_pages`."""
    is_xml = F.coalesce(strip(payload).startswith("<"), F.lit(False)) | F.try_parse_json(payload).isNull()
    return _before_first_empty(_json_items(pages.filter(~is_xml), payload).unionByName(
        _xml_items(pages.filter(is_xml), payload, on_error)))


# --- manifests -----------------------------------------------------------------------------------

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in (
    "source", "external_product_id", "product_url", "label", "product_name", "brand_name", "category",
    "category_path", "image_url")])


def check_manifest(
    entries: DataFrame, sources: Sequence[str], host: str, path_suffix: str, id_parameter: str
) -> DataFrame:
    """Manifest entries with the first reason to reject each, null when it is fine."""
    url = strip("product_url")
    name = F.lower(F.try_parse_url(url, F.lit("HOST")))
    page_id = strip(F.try_parse_url(url, F.lit("QUERY"), F.lit(id_parameter)))
    supported = (
        F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https")
        & ((name == host) | name.endswith("." + host))
        & F.try_parse_url(url, F.lit("PATH")).endswith(path_suffix) & (F.coalesce(page_id, F.lit("")) != ""))
    rows = entries.withColumns({
        "source": strip("source"), "external_product_id": strip("external_product_id"), "__page": page_id,
        "__ok": F.coalesce(supported, F.lit(False))})
    repeats = rows.groupBy("source", "external_product_id").agg((F.count("*") > 1).alias("__repeated"))
    return rows.join(repeats, ["source", "external_product_id"], "left").withColumn(
        "reason",
        F.when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "source not supported")
        .when(~F.col("__ok"), "url not supported")
        .when(F.col("__page") != F.col("external_product_id"), "url id differs")
        .when(F.col("__repeated"), "duplicate entry")).drop("__page", "__ok", "__repeated")


def read_manifest(spark: SparkSession, path: str, **rules) -> tuple[DataFrame, DataFrame]:
    """(valid entries, rejects with reasons) of a JSON-array manifest file."""
    rows = check_manifest(spark.read.schema(MANIFEST).option("multiLine", True).json(path), **rules)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


# --- product pages ---------------------------------------------------------------------------------

def html_text(c: Column | str) -> Column:
    """Text of an HTML fragment: tags out, all entities decoded, white space collapsed.

    The fragment is an expression that is costly to find, so it goes to Python whole: testing it for
    entities first would find it again for each test."""
    return collapse(_unescape(F.regexp_replace(c, "<[^>]*>", "")))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x).replace("\xa0", " ") if "&" in x else x, na_action="ignore")


def attribute(c: str, name: str, tag: str) -> Column:
    """First value of an attribute of a tag (a pattern for the tag's own text)."""
    found = F.regexp_extract(c, rf"(?is)<{tag}[^>]*?\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return let(strip(found), lambda x: F.nullif(x, F.lit("")))


def class_text(c: str, cls: str) -> Column:
    """Text of the first element that has a class."""
    mark = rf"(?is)<([a-z0-9]+)[^>]*?\bclass\s*=\s*[\"'](?:[^\"']*\s)?{cls}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1\s*>"
    return let(html_text(F.regexp_extract(c, mark, 2)), lambda x: F.nullif(x, F.lit("")))


def extract_page_fields(
    pages: DataFrame, rules: Mapping[str, Column], base_url: str, id_parameter: str, html: str = "html"
) -> DataFrame:
    """Product fields of page or card HTML with a reject reason.

    `rules` maps product_url, product_name, brand_name, image_url, category_path, original_price
    and sale_price to Columns over the HTML (see `attribute`, `class_text`).  Relative urls are
    resolved against `base_url`; rank and query columns are carried; the original price falls
    back to the sale price."""
    def absolute(u: Column) -> Column:
        return F.when(u.rlike("^(?i:https?)://"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(
            u.startswith("/"), F.concat(F.lit(base_url), u)).otherwise(F.concat(F.lit(base_url + "/"), u))

    # Small compressed files are read by few tasks; the patterns of a row take far longer than to deal it.
    rows = spread(pages).withColumns({f"__{k}": v for k, v in rules.items()})
    url = absolute(F.col("__product_url"))
    sale = keys.parse_price("__sale_price")
    keep = [c for c in pages.columns if c != html]
    out = rows.select(
        *keep, url.alias("product_url"),
        F.nullif(strip(F.try_parse_url(url, F.lit("QUERY"), F.lit(id_parameter))), F.lit("")).alias("external_id"),
        collapse("__product_name").alias("product_name"), F.col("__brand_name").alias("brand_name"),
        absolute(F.col("__image_url")).alias("image_url"), F.col("__category_path").alias("category_path"),
        F.coalesce(F.nullif(keys.parse_price("__original_price"), F.lit(0)), sale).alias("original_price"),
        sale.alias("sale_price"))
    return out.withColumn(
        "reason", F.when(F.col("product_url").isNull() | F.col("product_name").isNull(), "url or name missing")
        .when(F.col("external_id").isNull(), "product id missing"))


# --- option data inside page scripts ------------------------------------------------------------------

_OPTION = T.StructType([
    T.StructField("owner", T.StringType()), T.StructField("option_number", T.StringType()),
    T.StructField("standard_code", T.StringType()), T.StructField("option_name", T.StringType()),
    T.StructField("sold_out_flag", T.StringType()), T.StructField("image_url", T.StringType()),
    T.StructField("sort_order", T.StringType()), T.StructField("representative", T.StringType()),
    T.StructField("group_path", T.ArrayType(T.StringType())),
    T.StructField("combination_flag", T.StringType()), T.StructField("is_option", T.BooleanType()),
])


# Fixed value: how a page pushes a chunk of its data.
PUSH_MARKER = "self.__next_f.push("
#: A string, to its end or that of the text, or a brace.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}]', re.DOTALL)


def _option_scanner(required: Sequence[str], owners: Sequence[str], flag: str):
    """Arrow function: objects inside a script text that hold the required keys, with the nearest
    owner above them, in order of appearance.  Objects that hold only the combination flag are
    kept as flag rows."""
    def text(v) -> str | None:
        if v is None:
            return None
        return str(v).strip() or None

    def image(o: dict) -> str | None:
        for k in ("imageUrl", "optionImageUrl", "goodsOptionImageUrl", "image"):
            v = o.get(k)
            hits = [v] if isinstance(v, str) else [v.get(n) for n in ("url", "imageUrl", "src")] if isinstance(v, dict) else []
            for h in hits:
                if text(h):
                    return text(h)
        for entry in o.get("goodsOptionImageList") or []:
            for k in ("imageUrl", "url", "src") if isinstance(entry, dict) else ():
                if text(entry.get(k)):
                    return text(entry.get(k))
        return None

    def path(v) -> list[str]:
        return [t for t in map(text, v if isinstance(v, list) else [v] if isinstance(v, str) else []) if t]

    def walk(v, owner, out):
        if isinstance(v, dict):
            owner = next((t for t in (text(v.get(k)) for k in owners) if t), owner)
            if v.get(flag) is not None or all(k in v for k in required):
                out.append((
                    owner, text(v.get("optionNumber")), text(v.get("standardCode")), text(v.get("optionName")) or "",
                    text(v.get("soldOutFlag")), image(v), text(v.get("sortSeq", v.get("sortOrder"))),
                    text(v.get("representFlag", v.get("representative"))), path(v.get("combinationOptionName")),
                    text(v.get(flag)), all(k in v for k in required)))
            for nested in v.values():
                walk(nested, owner, out)
        elif isinstance(v, list):
            for nested in v:
                walk(nested, owner, out)
        elif isinstance(v, str) and required[0] in v:
            objects(v, out)

    def objects(s: str, out):
        """Walk each whole outermost object of a text; one that is not JSON is skipped with all inside it.

        One pass over strings and braces, so braces in strings count for nothing."""
        depth = start = 0
        for token in _TOKEN.finditer(s):
            if token[0] == "{":
                start = start if depth else token.start()
                depth += 1
            elif token[0] == "}" and depth:
                depth -= 1
                if not depth:
                    try:
                        value = json.loads(s[start : token.end()])
                    except (ValueError, RecursionError):
                        continue
                    walk(value, None, out)

    def scan(s: str | None) -> list[tuple]:
        out: list[tuple] = []
        s = (s or "").strip()
        # The script may be JSON as it stands, or a pushed chunk that carries the data in a string.
        inner = [s[len(PUSH_MARKER) : -1]] if s.startswith(PUSH_MARKER) and s.endswith(")") else []
        for text_of in [s, *inner]:
            try:
                walk(json.loads(text_of), None, out)
            except (ValueError, RecursionError):
                pass
        if required[0] in s:
            objects(s, out)
        return out

    @F.pandas_udf(T.ArrayType(_OPTION))
    def options(s: pd.Series) -> pd.Series:
        return s.map(scan)

    return options


# Keys of the embedded option data.
OPTION_KEYS = ("optionNumber", "optionName")
OWNER_KEYS = ("goodsNumber", "goodsNo")
COMBINATION_KEY = "combinationOptionFlag"


def extract_embedded_json(
    pages: DataFrame, script: str = "script", required: Sequence[str] = OPTION_KEYS,
    owners: Sequence[str] = OWNER_KEYS,
) -> DataFrame:
    """Options found in page scripts (product_id, script_no, script).

    Options that name the product as owner win; only if there are none, options without an owner
    count.  Equal (number, name key, order) keeps the last; order: sort order with nulls last."""
    found = pages.select(
        "product_id", "script_no",
        F.posexplode(_option_scanner(required, owners, COMBINATION_KEY)(F.col(script))).alias("n", "o")
    ).select("product_id", "script_no", "n", "o.*")
    mine = (F.col("owner") == F.col("product_id").cast("string"))
    scoped = found.withColumn("__exact", F.coalesce(mine, F.lit(False))).filter("__exact OR owner IS NULL")

    def preferred(df: DataFrame) -> DataFrame:
        any_exact = F.max("__exact").over(Window.partitionBy("product_id"))
        return df.withColumn("__any", any_exact).filter("__exact = __any").drop("__any")

    flags = keep_first(
        preferred(scoped.filter(keys.coerce_flag("combination_flag").isNotNull())), "product_id",
        ["script_no", "n"]).select("product_id", keys.coerce_flag("combination_flag").alias("combination_option_flag"))
    options = preferred(scoped.filter("is_option")).withColumns({
        "name_key": keys.option_label_key("option_name"),
        "sort_order": F.col("sort_order").try_cast("int"),
        "sold_out_flag": keys.coerce_flag("sold_out_flag"), "representative": keys.coerce_flag("representative")})
    unique = keep_first(
        options, ["product_id", "option_number", "name_key", "sort_order"], [F.desc("script_no"), F.desc("n")])
    order = Window.partitionBy("product_id").orderBy(
        F.col("sort_order").asc_nulls_last(), F.coalesce("option_number", F.lit("")), "script_no", "n")
    return unique.withColumn("seq", F.row_number().over(order)).join(flags, "product_id", "left").select(
        "product_id", "seq", "option_number", "standard_code", "option_name", "sold_out_flag", "image_url",
        "sort_order", "representative", "group_path", "combination_option_flag")


# --- rule documents -----------------------------------------------------------------------------------

_STRINGS = T.ArrayType(T.StringType())


def _struct(strings: Sequence[str], lists: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in strings]
                        + [T.StructField(c, _STRINGS) for c in lists])


RULE_DOCUMENT = T.StructType([
    T.StructField("dataset_name", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("sources", T.MapType(T.StringType(), _struct(("title", "url", "type"), ()))),
    T.StructField("skin_profiles", T.ArrayType(_struct(
        ("profile_id", "display_name_ko", "notes"),
        ("core_features", "priority_concerns", "helpful_function_groups", "caution_function_groups", "source_ids")))),
    T.StructField("rules", T.ArrayType(_struct(
        ("rule_id", "canonical_group", "display_name_ko", "condition", "evidence_level", "severity_default",
         "user_message_ko"),
        ("aliases", "functions", "beneficial_for", "caution_for", "possible_concerns", "source_ids")))),
])


def split_rule_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, profiles, rules) tables of nested rule documents."""
    sources = documents.select(F.explode("sources").alias("source_id", "s")).select("source_id", "s.*")
    profiles = documents.select(F.explode("skin_profiles").alias("p")).select("p.*")
    rules = documents.select(F.explode("rules").alias("r")).select("r.*")
    lists = [f.name for f in RULE_DOCUMENT["rules"].dataType.elementType if isinstance(f.dataType, T.ArrayType)]
    return sources, profiles, rules.withColumns(
        {c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def load_rule_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of one JSON rule document, read with its fixed schema."""
    return split_rule_documents(
        spark.read.schema(RULE_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path))
