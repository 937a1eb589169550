"""Option results: statuses, safe selection between parsers, source reconciliation, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import EDGE_CHARS, SPACE, SPACES, raw_chunks, strip

MAPPING_STATUSES = ("matched", "unmatched", "ambiguous", "unsupported")


def option_status(mapping: str = "mapping_status", ingredients: str = "ingredients",
                  has_error: Column | None = None) -> Column:
    """error, then ambiguous, unmapped, empty, ready; an unknown mapping is an error."""
    error = F.col(mapping).eqNullSafe("error") | (F.lit(False) if has_error is None else has_error)
    filled = F.coalesce(F.size(ingredients), F.lit(0)) > 0
    return (
        F.when(error, "error").when(F.col(mapping) == "ambiguous", "ambiguous")
        .when(F.col(mapping).isin("unmatched", "unsupported"), "unmapped")
        .when((F.col(mapping) == "matched") & ~filled, "empty")
        .when(F.col(mapping) == "matched", "ready").otherwise("error")
    )


def collection_status(products: DataFrame, options: DataFrame, by: str = "product_id") -> DataFrame:
    """failed without a ready option, ready when all are, else partial."""
    counts = options.groupBy(by).agg(
        F.count("*").alias("n_options"), F.count_if(F.col("status") == "ready").alias("n_ready"))
    n, ready = (F.coalesce(c, F.lit(0)) for c in ("n_options", "n_ready"))
    return products.select(by).distinct().join(counts, by, "left").select(
        by, n.alias("n_options"), ready.alias("n_ready"),
        F.when(ready == 0, "failed").when(ready == n, "ready").otherwise("partial").alias("collection_status"))


def option_status_counts(mappings: DataFrame, by: str = "doc_id") -> DataFrame:
    """Mapping status counts per product."""
    return mappings.groupBy(by).agg(
        *[F.count_if(F.col("mapping_status") == s).alias(f"n_{s}") for s in MAPPING_STATUSES])


def mapping_diagnostics(
    canonical: DataFrame, mappings: DataFrame, headers: DataFrame, formats: DataFrame
) -> DataFrame:
    """Per document: option counts before and after merging, mapping and header counts, structure."""
    merged = canonical.groupBy("doc_id").agg(
        F.sum("n_sources").alias("n_raw_options"), F.count("*").alias("n_canonical"),
        (F.sum("n_sources") - F.count("*")).alias("n_merged_duplicates"))
    heads = headers.groupBy("doc_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}_headers") for s in ("orphan", "malformed", "ambiguous")])
    out = merged.join(option_status_counts(mappings), "doc_id").join(heads, "doc_id", "left").join(
        formats, "doc_id", "left")
    return out.fillna(0, [c for c in heads.columns if c != "doc_id"])


# --- choosing between two parser results --------------------------------------------------------

def select_safe_result(production: DataFrame, candidate: DataFrame, by: str = "product_id") -> DataFrame:
    """(product, selected, reason): the candidate is taken only if nothing gets worse and more
    options become ready.

    Rows: product_id, position, option_id, status, ingredients.  Gates in order: no candidate;
    repeated option ids; then per production option in its order the option lost, no longer ready,
    or with another ingredient list (order matters).  The first failing option gives the reason."""
    # A repeated id decides the product by itself, so pairing may use one row per id; a list is compared only if it is ready.
    pair = F.struct("status", F.when(F.col("status") == "ready", F.col("ingredients")).alias("ingredients"))
    ours, theirs, ready = F.col("ours"), ~F.col("ours"), F.col("pair.status") == "ready"
    columns = [by, "option_id", "position", pair.alias("pair")]
    # All rows are dealt by product once: options and products are grouped where they are.
    rows = production.select(*columns, F.lit(True).alias("ours")).unionByName(
        candidate.filter(F.col(by).isNotNull()).select(*columns, F.lit(False).alias("ours"))).repartition(by)
    per_option = rows.groupBy(by, "option_id").agg(
        *[F.count_if(side).alias(f"n_{name}") for name, side in (("p", ours), ("c", theirs))],
        *[F.count_if(side & ready).alias(f"{name}_ready") for name, side in (("p", ours), ("c", theirs))],
        F.first(F.when(ours, F.col("pair")), ignorenulls=True).alias("p"), F.min(F.when(ours, F.col("position"))).alias("at"),
        F.min_by(F.when(theirs, F.col("pair")), F.when(theirs, F.col("position"))).alias("c"))
    problem = (
        F.when(F.col("p").isNull(), F.lit(None).cast("string"))
        .when(F.col("option_id").isNull() | F.col("c").isNull(), "production_option_missing_in_candidate")
        .when((F.col("p.status") == "ready") & (F.col("c.status") != "ready"),
              "production_ready_option_not_ready_in_candidate")
        .when((F.col("p.status") == "ready") & ~F.col("p.ingredients").eqNullSafe(F.col("c.ingredients")),
              "production_ready_option_ingredients_changed_in_candidate"))
    found = per_option.withColumn("problem", problem)
    products = found.groupBy(by).agg(
        *[F.sum(c).alias(c) for c in ("n_p", "n_c", "p_ready", "c_ready")],
        (F.greatest(F.max("n_p"), F.max("n_c")) > 1).alias("repeats"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("at"))).alias("problem")).filter("n_p > 0")
    reason = (
        F.when(F.col("n_c") == 0, "candidate_result_unavailable")
        .when(F.col("repeats"), "duplicate_option_id_detected")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("c_ready") > F.col("p_ready"), "candidate_increases_ready_options_without_regression")
        .otherwise("no_safe_improvement_detected"))
    return products.withColumn("reason", reason).select(
        by, F.when(F.col("reason").startswith("candidate_increases"), "candidate").otherwise("production")
        .alias("selected"), "reason")


def effective_options(
    canonical: DataFrame, production: DataFrame, candidate: DataFrame, selection: DataFrame,
    by: str = "product_id",
) -> DataFrame:
    """Canonical options with the selected parser's status, ingredients and provenance.

    Only ready options carry ingredients; options the result does not know are errors."""
    def result(df: DataFrame, name: str) -> DataFrame:
        known = F.struct("status", F.when(F.col("status") == "ready", F.col("ingredients")).alias("ingredients"), F.lit(name).alias("selected"))
        return df.select(by, F.col("option_id").alias("option_key"), known.alias("result"))

    # Options, results and selections are dealt by product once and meet there.
    rows = canonical.select(by, "option_key", F.struct("option_name").alias("option"))
    for df in (result(production, "production"), result(candidate, "candidate"), selection.select(by, F.col("selected").alias("pick"))):
        rows = rows.unionByName(df, allowMissingColumns=True)
    picked = rows.repartition(by).withColumn("picks", F.collect_set("pick").over(Window.partitionBy(by)))
    met = picked.filter(F.col("option").isNotNull() | F.array_contains("picks", F.col("result.selected"))).groupBy(by, "option_key").agg(
        F.collect_list("option").alias("option"), F.collect_list("result").alias("result"))
    # A null key equals none.
    keyed = F.when(F.col(by).isNotNull() & F.col("option_key").isNotNull(), F.col("result"))
    out = met.select(by, "option_key", F.explode("option").alias("option"), keyed.alias("result")).select(
        by, "option_key", "option.option_name", F.explode_outer("result").alias("result"))
    status = F.coalesce("result.status", F.lit("error"))
    return out.select(
        by, "option_key", "option_name", status.alias("status"), (status == "ready").alias("analysis_available"),
        F.when(status == "ready", F.col("result.ingredients")).otherwise(F.array().cast("array<string>"))
        .alias("ingredients"),
        F.col("result.selected").alias("provenance"))


def first_analysable(options: DataFrame, by: str = "product_id", order: str = "position") -> DataFrame:
    """First option of each product that can be analysed; products without one have no row."""
    return options.filter("analysis_available").groupBy(by).agg(
        F.min_by("option_id", order).alias("option_id"))


# --- two sources of one option list ---------------------------------------------------------------

def reconcile_sources(shown: DataFrame, embedded: DataFrame, by: str = "product_id") -> DataFrame:
    """(product, status, category) of matching the shown options to the embedded metadata 1:1.

    shown: product_id, sort_order, raw_option_name, sold_out; embedded: product_id, seq,
    option_name, option_number, sold_out_flag.  Gates in order: nothing embedded, counts differ,
    a name repeats, name sets differ, a number repeats, sold-out flags differ; then the order."""
    a = shown.withColumn("__name", keys.option_label_key("raw_option_name"))
    b = embedded.withColumn("__name", keys.option_label_key("option_name"))

    def named(df, n, value):
        return df.groupBy(by, "__name").agg(F.count("*").alias(n), *value)

    left = named(a, "n_a", [F.min("sort_order").alias("at_a"), F.bool_or("sold_out").alias("sold_a")])
    right = named(b, "n_b", [F.min("seq").alias("at_b"), F.first("sold_out_flag").alias("sold_b")])
    pairs = left.join(right, [by, "__name"], "full_outer")
    rank_a = Window.partitionBy(by).orderBy(F.col("at_a").asc_nulls_last())
    rank_b = Window.partitionBy(by).orderBy(F.col("at_b").asc_nulls_last())
    placed = pairs.withColumns({"r_a": F.row_number().over(rank_a), "r_b": F.row_number().over(rank_b)})
    facts = placed.groupBy(by).agg(
        F.sum(F.coalesce("n_a", F.lit(0))).alias("total_a"), F.sum(F.coalesce("n_b", F.lit(0))).alias("total_b"),
        F.max(F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))).alias("most"),
        F.count_if(F.col("n_b").isNull()).alias("only_a"), F.count_if(F.col("n_a").isNull()).alias("only_b"),
        F.count_if(F.col("sold_b").isNotNull() & (F.col("sold_a") != F.col("sold_b"))).alias("flags"),
        F.count_if(F.col("r_a") != F.col("r_b")).alias("moved"))
    numbers = embedded.filter("option_number IS NOT NULL").groupBy(by, "option_number").agg(
        F.count("*").alias("n")).groupBy(by).agg((F.max("n") > 1).alias("number_repeats"))
    rows = shown.select(by).distinct().join(facts, by, "left").join(numbers, by, "left")
    category = (
        F.when(F.col("total_b") == 0, F.lit(None).cast("string"))
        .when(F.col("total_a") != F.col("total_b"), "count_mismatch")
        .when(F.col("most") > 1, "duplicate_name_collision")
        .when((F.col("only_a") > 0) & (F.col("only_b") == 0), "shown_only_option")
        .when((F.col("only_b") > 0) & (F.col("only_a") == 0), "embedded_only_option")
        .when(F.col("only_a") > 0, "normalized_name_mismatch")
        .when(F.coalesce("number_repeats", F.lit(False)), "option_number_collision")
        .when(F.col("flags") > 0, "sold_out_state_mismatch")
        .when(F.col("moved") > 0, "order_only_mismatch"))
    status = (
        F.when(F.col("total_b") == 0, "partial_metadata_enrichment")
        .when(F.col("category").isNull(), "complete_match")
        .when(F.col("category") == "order_only_mismatch", "complete_match_reordered").otherwise("mismatch"))
    return rows.withColumn("category", category).select(by, status.alias("status"), "category")


def merge_option_metadata(
    shown: DataFrame, embedded: DataFrame, outcome: DataFrame, by: str = "product_id"
) -> DataFrame:
    """Shown options with embedded metadata, for products whose sources agree.

    Without embedded rows (partial) only the shown values remain.  The option's source id is its
    number there; image, group path (none: empty) and the product's combination flag come along."""
    empty = F.array().cast("array<string>")

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in embedded.columns else F.lit(None)).cast(kind).alias(name)

    usable = outcome.filter("status <> 'mismatch'").select(by)
    a = shown.join(usable, by, "left_semi").withColumn("__name", keys.option_label_key("raw_option_name"))
    b = embedded.select(
        by, keys.option_label_key("option_name").alias("__name"), "option_number", "standard_code",
        "sold_out_flag", F.col("sort_order").alias("__order"), "representative",
        optional("image_url", "string"), optional("group_path", "array<string>"))
    # The flag is the product's: options that no embedded row names have it as well.
    flags = embedded.groupBy(by).agg(F.bool_or(optional("combination_option_flag", "boolean")).alias("combination_option_flag"))
    return a.join(b, [by, "__name"], "left").join(flags, by, "left").select(
        by, F.col("option_number").alias("source_option_id"), "raw_option_name", F.col("__name").alias("normalized_option_name"),
        "option_number", "standard_code", "image_url", F.coalesce("group_path", empty).alias("group_path"),
        "combination_option_flag", F.col("disabled").alias("dom_disabled"),
        F.when(F.col("option_number").isNotNull() | F.col("sold_out_flag").isNotNull(), F.col("sold_out_flag"))
        .otherwise(F.col("sold_out")).alias("sold_out_flag"),
        F.when(F.col("sold_out"), "temporarily_sold_out").when(F.col("disabled").eqNullSafe(False), "available")
        .otherwise("unknown").alias("availability"),
        F.coalesce("__order", "sort_order").alias("sort_order"), "representative")


# --- reports ----------------------------------------------------------------------------------------

def parser_diff(production: DataFrame, candidate: DataFrame, by: str = "doc_id") -> DataFrame:
    """Status counts of two parsers and the differences that are not zero."""
    p, c = option_status_counts(production, by), option_status_counts(candidate, by)
    c = c.select(by, *[F.col(f"n_{s}").alias(f"c_{s}") for s in MAPPING_STATUSES])
    both = p.join(c, by, "full_outer").fillna(0)
    entries = F.array(*[F.struct(F.lit(s).alias("k"), (F.col(f"n_{s}") - F.col(f"c_{s}")).alias("v"))
                        for s in MAPPING_STATUSES])
    return both.withColumn("status_diff", F.map_from_entries(F.filter(entries, lambda e: e["v"] != 0)))


def match_rate_report(mappings: DataFrame, by: str = "doc_id") -> DataFrame:
    """Per product and, with a null product, for all: options, matched, rate; and over all the
    mean options of ready products and the mean rate of the others."""
    per = option_status_counts(mappings, by).withColumn(
        "n_options", sum((F.col(f"n_{s}") for s in MAPPING_STATUSES[1:]), F.col(f"n_{MAPPING_STATUSES[0]}"))
    ).withColumn("rate", F.col("n_matched") / F.col("n_options"))
    is_ready = F.col("n_matched") == F.col("n_options")
    total = per.agg(
        F.sum("n_options").alias("n_options"), F.sum("n_matched").alias("n_matched"),
        (F.sum("n_matched") / F.sum("n_options")).alias("rate"),
        F.avg(F.when(is_ready, F.col("n_options"))).alias("mean_ready_options"),
        F.avg(F.when(~is_ready, F.col("rate"))).alias("mean_unready_rate"))
    null = F.lit(None)
    return per.select(
        by, "n_options", "n_matched", "rate", null.cast("double").alias("mean_ready_options"),
        null.cast("double").alias("mean_unready_rate"),
    ).unionByName(total.withColumn(by, null.cast(per.schema[by].dataType)))


def component_groups(sections: DataFrame) -> DataFrame:
    """Component sections with their ingredient counts."""
    return sections.filter("section_kind = 'component_group'").select(
        "doc_id", "section_no", "raw_header", F.size("ingredients").alias("n_ingredients"))


def describe_sections(
    sections: DataFrame, mappings: DataFrame, canonical: DataFrame, formats: DataFrame, n: int = 3
) -> DataFrame:
    """Status, size and edge ingredients of every section."""
    matched = mappings.filter("mapping_status = 'matched'").select(
        "doc_id", "section_no", F.col("option_name").alias("mapped_option_name"))
    labels = canonical.select("doc_id", keys.header_label_key("raw_option_name").alias("label")).distinct().withColumn(
        "named", F.lit(True))
    rows = (
        sections.withColumn("label", keys.header_label_key("raw_header"))
        .join(matched, ["doc_id", "section_no"], "left").join(labels, ["doc_id", "label"], "left")
        .join(formats.select("doc_id", "document_format"), "doc_id", "left"))
    status = (
        F.when(F.col("mapped_option_name").isNotNull(), "matched")
        .when(F.col("document_format") != "option_full_sections", "unsupported")
        .when(F.col("raw_header") == "", "unmatched")
        .when(F.col("section_kind") != "ingredient_section", "excluded")
        .when(F.coalesce("named", F.lit(False)), "ambiguous").otherwise("orphan"))
    size = F.size("ingredients")
    return rows.select(
        "doc_id", "section_no", "raw_header", status.alias("status"), "mapped_option_name",
        size.alias("n_ingredients"), F.slice("ingredients", 1, n).alias("first_ingredients"),
        F.slice("ingredients", F.greatest(size - n + 1, F.lit(1)), F.lit(n)).alias("last_ingredients"))


def prefix_candidates(sections: DataFrame) -> DataFrame:
    """Chunks in which the section's first ingredient comes again after other text, with the
    number of chunks up to the next such place."""
    clean = F.transform(raw_chunks(F.col("body")), lambda c: strip(F.regexp_replace(c, SPACES, " "), EDGE_CHARS))
    rows = sections.filter(F.size("ingredients") > 0).withColumns({
        "first_ingredient": F.get("ingredients", F.lit(0)), "chunks": clean})
    hits = F.filter(
        F.transform("chunks", lambda c, i: F.struct(i.alias("at"), c.alias("chunk"), strip(
            F.substr(c, F.lit(1), F.instr(c, F.col("first_ingredient")) - 1)).alias("prefix"))),
        lambda x: (F.instr(x["chunk"], F.col("first_ingredient")) > 1) & (x["prefix"] != ""))
    rows = rows.withColumn("hits", hits)
    spaced = F.transform("hits", lambda h, i: F.struct(
        h["at"].alias("chunk_index"), h["chunk"].alias("chunk"), h["prefix"].alias("prefix_candidate"),
        (F.coalesce(F.get("hits", i + 1)["at"], F.size("chunks")) - h["at"]).alias("n_until_next")))
    return rows.select("doc_id", "section_no", "raw_header", "first_ingredient", F.explode(spaced).alias("h")).select(
        "doc_id", "section_no", "raw_header", "first_ingredient", "h.*")


def trailing_text_candidates(sections: DataFrame, canonical: DataFrame) -> DataFrame:
    """Bracket text at the end of a section or document: a bracket section no option is named
    after, or a bracket suffix of a last ingredient."""
    order = Window.partitionBy("doc_id").orderBy("section_no")
    header = strip("raw_header")
    last = F.try_element_at("ingredients", F.lit(-1))
    rows = sections.withColumns({
        "label": keys.header_label_key("raw_header"), "last_ingredient": last,
        "is_last": F.lead("section_no").over(order).isNull(),
        "previous_header": F.coalesce(F.lag("raw_header").over(order), F.lit("")),
        "previous_ingredient": F.coalesce(F.lag(last).over(order), F.lit("")),
    })
    where = F.when(F.col("is_last"), "document_end").otherwise("section_end_only")
    labels = canonical.select("doc_id", keys.header_label_key("raw_option_name").alias("label"))
    own = rows.filter(header.startswith("[") & header.endswith("]")).join(
        labels, ["doc_id", "label"], "left_anti").select(
        "doc_id", "section_no", F.col("previous_header").alias("section_header"),
        F.col("previous_ingredient").alias("preceding_ingredient"), header.alias("trailing_text"),
        (F.size("ingredients") > 0).alias("has_body_after"), where.alias("boundary_type"))
    mark = f"^([^\\n]+?){SPACE}+(\\[[^\\[\\]]*\\])$"
    suffix = rows.filter(F.col("last_ingredient").rlike(mark)).select(
        "doc_id", "section_no", F.col("raw_header").alias("section_header"),
        strip(F.regexp_extract("last_ingredient", mark, 1)).alias("preceding_ingredient"),
        F.regexp_extract("last_ingredient", mark, 2).alias("trailing_text"),
        F.lit(False).alias("has_body_after"), where.alias("boundary_type"))
    return own.unionByName(suffix)


# Grammars under research, as (name, pattern).
RESEARCH_GRAMMARS = {
    "hash_english_alias": (
        ("hash_english_alias", r"(?<![0-9A-Za-z가-힣])#\s*(?P<label>[A-Za-z]+(?:[ -][A-Za-z]+)*)(?=\s)"),),
    "single_mismatched_bracket": (
        ("single_mismatched_bracket", r"\[(?P<label>[^\[\]()\],:\r\n]{1,80})\)"),
        ("single_mismatched_bracket", r"\((?P<label>[^\[\]()\],:\r\n]{1,80})\]"),),
}


def _plausible_body(body: Column) -> Column:
    parts = F.filter(F.transform(F.split(body, ","), lambda x: strip(x)), lambda x: x != "")
    return (F.size(parts) >= 2) & F.exists(F.slice(parts, 1, 3), lambda x: x.rlike("[가-힣A-Za-z]"))


def research_header_grammars(docs: DataFrame, options: DataFrame, grammar: str) -> DataFrame:
    """Candidate headers of a grammar with counts and a verdict; nothing is mapped.

    hash_english_alias: '#Name' against names in brackets of an option; single_mismatched_bracket:
    '[name)' against option ends.  Options: doc_id, raw_option_name."""
    from .segmentation import _body, _next_start, span_scanner

    text, spans = F.col("text"), F.col("spans")
    found = docs.withColumn("spans", span_scanner(RESEARCH_GRAMMARS[grammar], prune=False)(text))
    rows = found.select("doc_id", F.explode(F.transform(spans, lambda h, i: F.struct(
        h["start"].alias("start"), h["end"].alias("end"), h["raw_header"].alias("raw_header"),
        h["label"].alias("label"),
        strip(_body(text, h["end"], _next_start(spans, i, text))).alias("body")))).alias("s")).select(
        "doc_id", "s.*").withColumns({"key": keys.dictionary_key("label"), "plausible": _plausible_body(F.col("body"))})
    if grammar == "hash_english_alias":
        aliases = options.select("doc_id", F.explode(F.regexp_extract_all(
            "raw_option_name", F.lit(r"\(([^()]*)\)"), F.lit(1))).alias("alias")).filter(
            strip("alias").rlike(r"^[A-Za-z][A-Za-z -]*$"))
        per_key = aliases.groupBy("doc_id", keys.dictionary_key("alias").alias("key")).agg(
            F.count("*").alias("n_options"))
        seen = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n_headers"))
        rows = rows.join(seen, ["doc_id", "key"]).join(per_key, ["doc_id", "key"], "left").fillna(0, ["n_options"])
        unique = (F.col("n_options") == 1) & (F.col("n_headers") == 1) & F.col("plausible")
        several = (F.col("n_options") > 1) | (F.col("n_headers") > 1)
        verdict = F.when(unique, "matched").when(several, "ambiguous").otherwise("unmatched")
    else:
        # Every ending of an option name is a key, so the suffix test is an equality.
        ends = options.select("doc_id", keys.dictionary_key("raw_option_name").alias("name")).select(
            "doc_id", F.explode(F.when(F.length("name") > 0, F.transform(
                F.sequence(F.lit(1), F.length("name")), lambda i: F.substr("name", i, F.length("name"))))).alias("key"))
        per_key = ends.groupBy("doc_id", "key").agg(F.count("*").alias("n_options"))
        rows = rows.join(per_key, ["doc_id", "key"], "left").fillna(0, ["n_options"]).withColumn(
            "n_headers", F.lit(1).cast("bigint"))
        verdict = F.when((F.col("n_options") == 1) & F.col("plausible"), "repair_candidate").otherwise("ambiguous")
    return rows.select("doc_id", "start", "end", "raw_header", "label", F.length("body").alias("body_length"),
                       "n_options", (F.col("n_headers") - 1).alias("duplicate_count"), verdict.alias("mapping_status"))


def research_full_labels(docs: DataFrame, options: DataFrame, labels: DataFrame) -> DataFrame:
    """Document labels (doc_id, n, label), located one after the other, against whole option names."""
    from .segmentation import _body, _next_start

    listed = labels.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "label"))).alias("labels"))
    text = F.col("text")
    located = F.aggregate(
        "labels",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,label:string>>").alias("out")),
        lambda acc, x: _advance(acc, x["label"], _find(text, x["label"], acc["at"])),
        lambda acc: acc["out"])
    rows = docs.join(listed, "doc_id").withColumn("spans", located)
    spans = F.col("spans")
    cut = rows.select("doc_id", F.explode(F.transform(spans, lambda h, i: F.struct(
        h["start"].alias("start"), h["end"].alias("end"), h["label"].alias("label"),
        strip(_body(text, h["end"], _next_start(spans, i, text))).alias("body")))).alias("s")).select(
        "doc_id", "s.*").withColumns({"key": keys.dictionary_key("label"), "plausible": _plausible_body(F.col("body"))})
    per_key = options.groupBy("doc_id", keys.dictionary_key("raw_option_name").alias("key")).agg(
        F.count("*").alias("n_options"))
    seen = cut.groupBy("doc_id", "key").agg(F.count("*").alias("n_headers"))
    out = cut.join(seen, ["doc_id", "key"]).join(per_key, ["doc_id", "key"], "left").fillna(0, ["n_options"])
    unique = (F.col("n_options") == 1) & (F.col("n_headers") == 1) & F.col("plausible")
    several = (F.col("n_options") > 1) | (F.col("n_headers") > 1)
    return out.select(
        "doc_id", "start", "end", "label", "n_options", (F.col("n_headers") - 1).alias("duplicate_count"),
        F.when(unique, "matched").when(several, "ambiguous").otherwise("orphan").alias("mapping_status"))


def _find(text: Column, label: Column, at: Column) -> Column:
    """1-based place of a label at or after an offset, letter case ignored; 0 when absent."""
    hit = F.instr(F.lower(F.substr(text, at + 1, F.length(text))), F.lower(label))
    return F.when(hit > 0, hit + at).otherwise(0)


def _advance(acc: Column, label: Column, place: Column) -> Column:
    span = F.struct((place - 1).cast("int").alias("start"), (place - 1 + F.length(label)).cast("int").alias("end"),
                    label.alias("label"))
    return F.struct(
        F.when(place > 0, (place - 1 + F.length(label)).cast("int")).otherwise(acc["at"]).alias("at"),
        F.when(place > 0, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

