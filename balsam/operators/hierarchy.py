"""Second parser: comma chunks to sections, formulas inside sections, exact label mapping.

A section's ingredients are found chunk by chunk; all of it is regular expressions, array
functions and per-document windows in the JVM.  The windows run over the chunks of one document,
which is bounded by that document's own text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.settle import settle
from ..functions.text import (
    EDGE_CHARS, SPACE, SPACE_CHARS, SPACES, casefolded, first_occurrences, fold, is_blank, let, raw_chunks, strip,
)
from .segmentation import canonicalize_options

# Header forms inside a chunk; at one place the earlier form wins.
CHUNK_HEADER = (
    r"\[[^\[\]\r\n]{1,120}\]"
    r"|★[\s]*[^,:;\[\]\r\n]{1,80}?[\s]*:"
    r"|(?<![0-9A-Za-z가-힣])#[\s]*(?:[A-Za-z]+\d+|\d+[A-Za-z]+)(?=[\s])"
    r"|\[[^\[\]()\],:\r\n]{1,80}\)"
    r"|\([^\[\]()\],:\r\n]{1,80}\]"
    r"|\{[^{}\[\]()\],:\r\n]{1,80}\]"
)
# The text before the first header, and that header.
_HEADER = f"(?Us)^(.*?)({CHUNK_HEADER})"
# Numbered formulas, and the thresholds of the formula rules.
NUMBER_MARK = r"(?U)(?<![0-9A-Za-z가-힣.])(\d{1,2})\.(?=\s)"
MIN_NUMBERED = 3
MIN_FORMULAS = 2
MIN_KNOWN = 4
MAX_RIGHT_WORDS = 4
# Bracket labels that name a component of a set.
COMPONENT_LABELS = ("증정", "본품", "리필")
HEADER_STRIP = r"\[\](){}★#: "
_CODE_SUFFIX = r"\(ci\d+\)$"


def _clean_item(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACES, " "), EDGE_CHARS)


def chunk_ingredients(text: Column) -> Column:
    """Cleaned comma chunks of a text, case-insensitive repeats dropped."""
    parts = F.filter(F.transform(raw_chunks(text), _clean_item), lambda x: x != "")
    return first_occurrences(parts, casefolded)


def comma_chunks(docs: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """by…, chunk_index, chunk, start, end: the pieces between separating commas of `text`, untrimmed.

    Offsets are running lengths over one text's chunks, which are linear in it."""
    pieces = docs.select(*by, F.posexplode(raw_chunks(F.col("text"))).alias("chunk_index", "chunk"))
    before = Window.partitionBy(*by).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("chunk") + 1).over(before), F.lit(0)).cast("int")
    return pieces.withColumn("start", start).withColumn("end", F.col("start") + F.length("chunk"))


def classify_chunks(chunks: DataFrame) -> DataFrame:
    """Add `kind`: numeric, alphanumeric (eight characters at most) or text."""
    t = strip("chunk")
    code = (F.length(t) <= 8) & t.rlike(r"(?iU)^[a-z]*\d+[a-z]*$") & t.rlike(r"(?U)\p{Alpha}")
    return chunks.withColumn(
        "kind", F.when(t.rlike(r"(?U)^\d+(?:\.\d+)?$"), "numeric").when(code, "alphanumeric").otherwise("text"))


def with_chunk_headers(chunks: DataFrame) -> DataFrame:
    """Add trimmed text with offsets, and the first header in it: before, header, after."""
    left = F.length(F.regexp_extract("chunk", f"^{SPACE}*", 0))
    rows = chunks.withColumn("trimmed", strip("chunk")).withColumn(
        "t_start", F.when(F.col("trimmed") == "", F.col("start")).otherwise(F.col("start") + left))
    return rows.withColumns({
        "t_end": F.col("t_start") + F.length("trimmed"),
        "header": F.regexp_extract("trimmed", _HEADER, 2),
    }).withColumns({
        "has_header": F.col("header") != "",
        # Not split: that compiles its pattern for each row.
        "before": F.when(F.col("header") != "", F.regexp_extract("trimmed", _HEADER, 1)).otherwise(F.col("trimmed")),
    }).withColumns({
        "h_start": F.col("t_start") + F.length("before"),
        "after": F.substr("trimmed", F.length("before") + F.length("header") + 1, F.length("trimmed")),
    }).withColumn("h_end", F.col("h_start") + F.length("header"))


def header_grammar(h: Column) -> Column:
    return (
        F.when(h.startswith("★"), "star_colon").when(h.startswith("#"), "hash_alphanumeric_code")
        .when(h.startswith("{"), "malformed_curly_bracket")
        .when(h.startswith("[") & h.endswith("]"), "bracketed").otherwise("malformed_bracket"))


def boundary_candidates(chunks: DataFrame) -> DataFrame:
    """Non-blank chunks: text + header + text is an embedded header, any other chunk its kind."""
    rows = classify_chunks(with_chunk_headers(chunks)).filter("trimmed <> ''")
    embedded = F.col("has_header") & ~is_blank("before") & ~is_blank("after")
    return rows.select(
        "doc_id", "chunk_index",
        F.when(embedded, F.col("h_start")).otherwise(F.col("t_start")).alias("start"),
        F.when(embedded, F.col("h_end")).otherwise(F.col("t_end")).alias("end"),
        F.when(embedded, strip("before")).otherwise("").alias("preceding_text"),
        F.when(embedded, F.col("header")).otherwise(F.col("trimmed")).alias("boundary_text"),
        F.when(embedded, strip("after")).otherwise("").alias("following_text"),
        F.when(embedded, "embedded_header").otherwise(F.col("kind")).alias("kind"),
        F.when(embedded, header_grammar(F.col("header"))).alias("grammar"),
    )


def build_sections(chunks: DataFrame) -> DataFrame:
    """doc_id, section_no, raw_header, header_start/end, body_start/end, body, ingredients.

    Every chunk becomes one to three events (append text, open a section, append text); a running
    count of openings numbers the sections."""
    rows = with_chunk_headers(chunks)
    first = F.col("chunk_index") == 0
    embedded = F.col("has_header") & ~is_blank("before") & ~is_blank("after") & ~first
    heads = F.col("has_header") & (F.col("before") == "") & (first | is_blank("after"))
    raw_after = F.substr("chunk", F.col("h_end") - F.col("start") + 1, F.length("chunk"))
    raw_before = F.substr(F.col("chunk"), F.lit(1), F.col("h_start") - F.col("start"))

    def event(opens: bool, text, header="", h_start=None, h_end=None, end=None, raw=None) -> Column:
        none = F.lit(None).cast("int")
        return F.struct(
            F.lit(opens).alias("opens"), (F.lit(text) if isinstance(text, str) else text).alias("item"),
            (F.lit(header) if isinstance(header, str) else header).alias("header"),
            (none if h_start is None else h_start).alias("h_start"),
            (none if h_end is None else h_end).alias("h_end"),
            (none if end is None else end).alias("end_at"), raw.alias("raw"))

    nothing = F.lit("")
    t_end, h_start, h_end = F.col("t_end"), F.col("h_start"), F.col("h_end")
    opened = event(True, F.when(is_blank("after"), "").otherwise(F.col("after")), F.col("header"), h_start,
                   h_end, F.when(is_blank("after"), h_end).otherwise(t_end), raw_after)
    events = (
        F.when(F.col("trimmed") == "", F.array(event(False, "", raw=F.col("chunk"))))
        .when(embedded, F.array(event(False, F.col("before"), end=h_start, raw=raw_before), opened))
        .when(heads, F.array(opened))
        .when(first, F.array(event(True, F.col("trimmed"), "", F.col("t_start"), F.col("t_start"), t_end,
                                   F.col("trimmed"))))
        .otherwise(F.array(event(False, F.col("trimmed"), end=t_end, raw=F.col("chunk"))))
    )
    flat = rows.select("doc_id", "chunk_index", F.posexplode(events).alias("part", "e")).select(
        "doc_id", "chunk_index", "part", "e.*")
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "part")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = flat.withColumn("section_no", F.sum(F.col("opens").cast("int")).over(running))
    entry = F.struct("chunk_index", "part", "item", "raw", "end_at")
    grouped = numbered.groupBy("doc_id", "section_no").agg(
        F.max(F.when(F.col("opens"), F.col("header"))).alias("raw_header"),
        F.max(F.when(F.col("opens"), F.col("h_start"))).alias("open_start"),
        F.max(F.when(F.col("opens"), F.col("h_end"))).alias("open_end"),
        F.max("end_at").alias("body_end"), F.min("end_at").alias("first_end"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    ).filter((F.col("section_no") > 0) | F.col("body_end").isNotNull())
    items = F.filter(F.transform("entries", lambda e: _clean_item(e["item"])), lambda x: x != "")
    # Blank chunks after the last item are outside the body.
    body = F.regexp_replace(F.array_join(F.transform("entries", lambda e: e["raw"]), ","),
                            f"(?:{SPACE}*,)+{SPACE}*$", "")
    start = F.coalesce("open_end", "first_end")
    return grouped.select(
        "doc_id", "section_no", F.coalesce("raw_header", nothing).alias("raw_header"),
        F.coalesce("open_start", "first_end").alias("header_start"), start.alias("header_end"),
        start.alias("body_start"), F.coalesce("body_end", start).alias("body_end"), body.alias("body"),
        first_occurrences(items, casefolded).alias("ingredients"))


def leading_number(header: Column | str) -> Column:
    """Number a header starts with, else null."""
    text = strip(header, HEADER_STRIP)
    return F.nullif(F.regexp_extract(text, r"(?U)^\d{1,3}", 0), F.lit("")).try_cast("int")


# --- formulas --------------------------------------------------------------------------------

def _known(spans: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Spans (…, key) whose key, or key without a trailing colour code, is in the dictionary."""
    both = spans.withColumn("__key", F.explode(F.array_distinct(F.array(
        F.col("key"), F.regexp_replace("key", _CODE_SUFFIX, "")))))
    return both.join(dictionary.select(F.col("key").alias("__key")), "__key", "left_semi").drop("__key")


def formula_boundaries(sections: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Places in a section where [known][unknown][known] words mark the start of a formula.

    Rows: doc_id, section_no, chunk_index, n_splits, left_end, right_start (word numbers of the
    first split) and the words.  A split without a left part counts only where the chunk has
    none with one.

    Splits are counted, never listed: those of a left part are the known right parts behind it
    less the ones that a known name leads up to.  No known name is longer than the longest
    dictionary key, so only words within that reach of a chunk's start or of a left part are
    looked up, and work is linear in a chunk's words."""
    longest = dictionary.agg(F.max(F.length("key")).alias("n")).scalar()
    words = F.regexp_extract_all("chunk", F.lit(r"(?U)\S+"), F.lit(0))
    by = ["doc_id", "section_no", "chunk_index"]
    chunks = sections.filter("raw_header <> ''").select(
        "doc_id", "section_no", F.posexplode(raw_chunks(F.col("body"))).alias("chunk_index", "chunk")
    ).withColumns({"words": words, "keys": F.regexp_extract_all(fold("chunk"), F.lit(f"[^{SPACE_CHARS}]+"), F.lit(0))})
    n = F.size("words")
    # A code such as (ci 77019) may follow the name: room for the longest one in the chunk.
    codes = F.regexp_extract_all(F.array_join("keys", ""), F.lit(_CODE_SUFFIX.rstrip("$")), F.lit(0))
    room = F.coalesce(F.array_max(F.transform(codes, F.length)), F.lit(0))
    # Words are read again for the left, right and middle parts and for the result.
    chunks = settle(chunks.filter(n >= 2).withColumns({"n": n, "reach": F.least(n - 1, longest + room)}))

    def key(start: Column, size: Column) -> Column:
        return F.array_join(F.slice("keys", start, size), "").alias("key")

    def listed(spans: Column) -> DataFrame:
        return chunks.select(*by, F.explode(spans).alias("s")).select(*by, "s.*")

    lefts = listed(F.transform(F.sequence(F.lit(1), F.col("reach")), lambda i: F.struct(
        i.alias("left_end"), key(F.lit(1), i))))
    known_left = settle(_known(lefts, dictionary).select(*by, "left_end").distinct())
    rights = listed(F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(MAX_RIGHT_WORDS), F.col("n") - i)), lambda size: F.struct(
            i.alias("right_start"), key(i + 1, size))))))
    known_right = settle(_known(rights, dictionary).select(*by, "right_start").distinct())
    # Names that start at a left part's end, no further than a name can reach.
    led = chunks.filter("chunk_index > 0").select(*by, "keys", "n", "reach").join(known_left, by).filter("left_end < n - 1")
    spans = F.transform(
        F.sequence(F.col("left_end") + 1, F.least(F.col("n") - 1, F.col("left_end") + F.col("reach"))),
        lambda i: F.struct(i.alias("right_start"), key(F.col("left_end") + 1, i - F.col("left_end"))))
    middles = led.select(*by, "left_end", F.explode(spans).alias("s")).select(*by, "left_end", "s.*")
    closed = _known(middles, dictionary).select(*by, "left_end", "right_start").distinct().join(
        known_right, [*by, "right_start"], "left_semi")
    closed = closed.groupBy(*by, "left_end").agg(F.collect_list("right_start").alias("closed"))
    left_parts = known_left.join(closed, [*by, "left_end"], "left").groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct("left_end", F.coalesce("closed", F.array().cast("array<int>")).alias("closed")))).alias("lefts"))
    parts = known_right.groupBy(*by).agg(F.array_sort(F.collect_list("right_start")).alias("rights")).join(
        left_parts, by, "left").join(chunks.select(*by, "words", "chunk"), by)
    lefts = F.coalesce("lefts", F.array().cast(left_parts.schema["lefts"].dataType))

    def behind(left: Column) -> Column:
        return F.filter("rights", lambda r: r > left)

    # A chunk at the start of a section has no left part before it.
    counts = F.when(F.col("chunk_index") > 0, F.transform(lefts, lambda e: F.struct(
        e["left_end"].alias("left_end"), (F.size(behind(e["left_end"])) - F.size(e["closed"])).alias("n"),
        e["closed"].alias("closed")))).otherwise(F.array())
    bare = F.array_except("rights", F.transform(lefts, lambda e: e["left_end"]))
    counted = parts.withColumns({"open": F.filter(counts, lambda e: e["n"] > 0), "bare": bare}).withColumn(
        "first", F.get("open", F.lit(0)))
    led_by = F.size("open") > 0
    return counted.filter(led_by | (F.size("bare") > 0)).select(
        *by,
        F.when(led_by, F.aggregate("open", F.lit(0), lambda acc, e: acc + e["n"])).otherwise(F.size("bare")).alias("n_splits"),
        F.when(led_by, F.col("first.left_end")).otherwise(0).alias("left_end"),
        F.when(led_by, F.array_min(F.array_except(behind(F.col("first.left_end")), "first.closed")))
        .otherwise(F.array_min("bare")).alias("right_start"), "words", "chunk")


def _word_at(chunk: Column, k: Column) -> Column:
    """Offset of word k in a chunk."""
    lead = F.concat(F.lit(r"(?U)^\s*(?:\S+\s+){"), k.cast("string"), F.lit("}"))
    return F.length(F.call_function("regexp_extract", chunk, lead, F.lit(0)))


def evaluate_formulas(sections: DataFrame, boundaries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Outcome per headed section (none, needs_review, hierarchical) with its sub-sections.

    Any ambiguous chunk or any body with fewer than four known ingredients asks for review; fewer
    than two boundaries, or bodies, is no structure."""
    by = ["doc_id", "section_no"]
    headed = sections.filter("raw_header <> ''").select(*by, "body")
    starts = comma_chunks(headed.withColumnRenamed("body", "text"), by).select(
        *by, "chunk_index", F.col("start").alias("at"))
    single = boundaries.filter("n_splits = 1").join(starts, [*by, "chunk_index"]).select(
        *by,
        (F.col("at") + _word_at(F.col("chunk"), F.col("left_end"))).alias("middle_start"),
        (F.col("at") + _word_at(F.col("chunk"), F.col("right_start"))).alias("right_start"))
    marks = single.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("middle_start", "right_start"))).alias("marks"))
    unclear = boundaries.filter("n_splits > 1").select(*by).distinct().withColumn("unclear", F.lit(True))
    staged = headed.join(marks, by).join(unclear, by, "left")
    body, m = F.col("body"), F.col("marks")
    pieces = F.transform(F.sequence(F.lit(0), F.size(m)), lambda i: F.struct(
        i.alias("n"),
        F.when(i == 0, "").otherwise(strip(F.substr(
            body, F.get(m, i - 1)["middle_start"] + 1,
            F.get(m, i - 1)["right_start"] - F.get(m, i - 1)["middle_start"]))).alias("label"),
        F.coalesce(F.get(m, i - 1)["right_start"], F.lit(0)).alias("start"),
        F.coalesce(F.get(m, i)["middle_start"], F.length(body)).alias("end")))
    subs = staged.select(*by, F.explode(F.transform(pieces, lambda p: F.struct(
        p["n"].alias("n"), p["label"].alias("label"), p["start"].alias("start"), p["end"].alias("end"),
        F.when(p["end"] > p["start"], F.substr(body, p["start"] + 1, p["end"] - p["start"])).otherwise("")
        .alias("text")))).alias("p")).select(*by, "p.*").filter(~is_blank("text"))
    listed = settle(subs.withColumn("ingredients", chunk_ingredients(F.col("text"))).drop("text"))
    known = count_known(listed.select(*by, "n", F.explode("ingredients").alias("name")), dictionary, [*by, "n"])
    judged = listed.join(known, [*by, "n"], "left").groupBy(*by).agg(
        F.count("*").alias("n_bodies"),
        F.bool_and(F.coalesce("n_known", F.lit(0)) >= MIN_KNOWN).alias("rich"),
        F.array_sort(F.collect_list(F.struct("n", "label", "start", "end", "ingredients"))).alias("subsections"))
    outcome = (
        F.when(F.col("marks").isNull(), "none")
        .when(F.coalesce("unclear", F.lit(False)), "needs_review")
        .when(F.size("marks") < MIN_FORMULAS, "none")
        .when(~F.coalesce("rich", F.lit(True)), "needs_review")
        .when(F.coalesce("n_bodies", F.lit(0)) < MIN_FORMULAS, "none").otherwise("hierarchical"))
    return headed.select(*by).join(staged.drop("body"), by, "left").join(judged, by, "left").select(
        *by, outcome.alias("outcome"), "subsections")


def count_known(items: DataFrame, dictionary: DataFrame, by: list[str]) -> DataFrame:
    """Known items per group; items are looked up by distinct spelling."""
    from .matching import known_ingredients

    return known_ingredients(items, dictionary).groupBy(*by).agg(F.count_if("is_known").alias("n_known"))


def numbered_subsections(sections: DataFrame) -> DataFrame:
    """Formulas 1. … N. of documents that have exactly one section, and that section a header.

    The numbers must be 1..N without a gap, three or more, from the start of the body."""
    alone = sections.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("section_no").alias("section_no"), F.max("raw_header").alias("raw_header"),
        F.max("body").alias("body")).filter("n = 1 AND raw_header <> ''")
    numbers = F.transform(F.regexp_extract_all("body", F.lit(NUMBER_MARK), F.lit(1)), lambda x: x.cast("int"))
    rows = alone.withColumns({"numbers": numbers, "texts": F.split("body", NUMBER_MARK)}).filter(
        (F.size("numbers") >= MIN_NUMBERED)
        & (F.col("numbers") == F.sequence(F.lit(1), F.greatest(F.size("numbers"), F.lit(1))))
        & is_blank(F.get("texts", F.lit(0))))
    return rows.select("doc_id", "section_no", F.explode(F.transform("numbers", lambda n, i: F.struct(
        n.alias("n"), F.regexp_extract(n.cast("string"), r"\d+", 0).alias("label"),
        chunk_ingredients(F.get("texts", i + 1)).alias("ingredients")))).alias("f")).select(
        "doc_id", "section_no", "f.*")


def section_restart_groups(sections: DataFrame) -> DataFrame:
    """Group number of every headed section; a header number that starts again under another
    label opens the next group.  Documents with one group are flat."""
    from .windows import restart_groups

    headed = sections.filter("raw_header <> ''").withColumns({
        "number": leading_number("raw_header"), "label": keys.header_label_key("raw_header")})
    return restart_groups(headed, "doc_id", "section_no", "number", "label", "group_no").select(
        "doc_id", "section_no", "number", "group_no")


def split_trailing_annotation(sections: DataFrame) -> DataFrame:
    """Move a bracket suffix of the last ingredient into `annotation`, with its offset."""
    last = F.try_element_at("ingredients", F.lit(-1))
    mark = f"^([^\\n]+?){SPACE}+(\\[[^\\[\\]]*\\])$"
    name, note = strip(F.regexp_extract(last, mark, 1)), F.regexp_extract(last, mark, 2)
    found = F.coalesce(last.rlike(mark) & (name != ""), F.lit(False))
    rows = sections.withColumn("__note", F.when(found, note)).withColumn("__name", F.when(found, name))
    # The note is located in the last chunk that reads like the last ingredient.
    chunks = raw_chunks(F.col("body"))
    at = F.aggregate(
        chunks, F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit")),
        lambda acc, c: F.struct(
            (acc["at"] + F.length(c) + 1).alias("at"),
            F.when((_clean_item(c) == last) & (F.locate("[", c) > 0) & (F.instr(c, F.col("__note")) > 0),
                   acc["at"] + F.instr(c, F.col("__note")) - 1).otherwise(acc["hit"]).alias("hit")),
        lambda acc: acc["hit"])
    rows = rows.withColumn("__at", F.when(F.col("__note").isNotNull(), at))
    moved = F.col("__at").isNotNull()
    return rows.withColumns({
        "ingredients": F.when(moved, F.concat(
            F.slice("ingredients", F.lit(1), F.greatest(F.size("ingredients") - 1, F.lit(0))), F.array("__name")))
        .otherwise(F.col("ingredients")),
        "annotation": F.when(moved, F.col("__note")),
        "annotation_start": F.when(moved, F.col("body_start") + F.col("__at")),
    }).drop("__note", "__name", "__at")


def classify_section_kind(sections: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add `section_kind`: component group, annotation candidate at the document end, or ingredients."""
    by = ["doc_id", "section_no"]
    known = count_known(
        sections.select(*by, F.explode("ingredients").alias("name")), dictionary, by)
    header = strip("raw_header")
    bracket = header.startswith("[") & header.endswith("]")
    label = strip(F.substr(header, F.lit(2), F.length(header) - 2))
    n = F.coalesce("n_known", F.lit(0))
    last = F.col("section_no") == F.max("section_no").over(Window.partitionBy("doc_id"))
    return sections.join(known, by, "left").withColumn(
        "section_kind",
        F.when(~bracket, "ingredient_section")
        .when(label.isin(*COMPONENT_LABELS) & (n >= MIN_KNOWN), "component_group")
        .when(n >= MIN_KNOWN, "ingredient_section")
        .when(last & (F.size("ingredients") == 0), "ambiguous_annotation_candidate")
        .otherwise("ingredient_section")).drop("n_known")


def map_sections_exact(sections: DataFrame, canonical: DataFrame, formats: DataFrame) -> DataFrame:
    """Options mapped to sections by whole label equality; documents that are not flat map none."""
    flat = formats.filter("document_format = 'option_full_sections'").select("doc_id")
    heads = (
        sections.filter("section_kind = 'ingredient_section'").join(flat, "doc_id", "left_semi")
        .withColumn("label", keys.header_label_key("raw_header")).filter("label <> ''")
        .select("doc_id", "section_no", "label", "ingredients"))
    labels = canonical.withColumn("label", keys.header_label_key("raw_option_name"))
    # Counted per label on each side: no pair is formed before the label is known to be unique.
    n_sections = heads.groupBy("doc_id", "label").agg(
        F.count("*").alias("n_sections"), F.min("section_no").alias("section_no"),
        F.min_by("ingredients", "section_no").alias("ingredients"))
    n_options = labels.groupBy("doc_id", "label").agg(F.count("*").alias("n_options"))
    out = labels.join(n_sections, ["doc_id", "label"], "left").join(n_options, ["doc_id", "label"]).join(
        formats.select("doc_id", "document_format"), "doc_id", "left")
    hit = F.col("n_sections").isNotNull()
    unclear = hit & ((F.col("n_sections") > 1) | (F.col("n_options") > 1))
    blocked = F.coalesce(F.col("document_format") != "option_full_sections", F.lit(False))
    status = (
        F.when(blocked, "unsupported").when(unclear, "ambiguous").when(hit, "matched").otherwise("unmatched"))
    return out.select(
        "doc_id", "option_pos", "option_key", "option_name", status.alias("mapping_status"),
        F.when(blocked, F.concat(F.lit("second_"), "document_format")).when(unclear, "duplicate_or_colliding_header")
        .when(hit, "exact_normalized_label").otherwise("no_matching_header").alias("mapping_method"),
        F.when(status == "matched", 1.0).otherwise(0.0).alias("mapping_confidence"),
        F.when(status == "matched", F.col("section_no")).alias("section_no"),
        F.when(status == "matched", F.col("ingredients")).otherwise(F.array().cast("array<string>"))
        .alias("ingredients"))


def orphan_sections(sections: DataFrame, canonical: DataFrame) -> DataFrame:
    """Headed ingredient sections that no option is named after."""
    heads = sections.filter("section_kind = 'ingredient_section'").withColumn(
        "label", keys.header_label_key("raw_header")).filter("label <> ''")
    labels = canonical.select("doc_id", keys.header_label_key("raw_option_name").alias("label"))
    return heads.join(labels, ["doc_id", "label"], "left_anti")


def document_structure(sections: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, document_format, structure_reason): formulas first, then numbered formulas, then
    restarting header numbers, else flat."""
    bounds = settle(formula_boundaries(sections, dictionary))
    formulas = evaluate_formulas(sections, bounds, dictionary)
    by_formula = formulas.groupBy("doc_id").agg(
        F.bool_or(F.col("outcome") == "needs_review").alias("review"),
        F.bool_or(F.col("outcome") == "hierarchical").alias("formulas"))
    numbered = numbered_subsections(sections).select("doc_id").distinct().withColumn("numbered", F.lit(True))
    restarts = section_restart_groups(sections).groupBy("doc_id").agg((F.max("group_no") > 0).alias("restarts"))
    no = F.lit(False)
    rows = sections.select("doc_id").distinct()
    for other in (by_formula, numbered, restarts):
        rows = rows.join(other, "doc_id", "left")
    deep = "hierarchical_option_internal_sections"
    review, formula, number, restart = (F.coalesce(c, no) for c in ("review", "formulas", "numbered", "restarts"))
    return rows.select(
        "doc_id",
        F.when(review, "needs_review").when(formula | number | restart, deep).otherwise("option_full_sections")
        .alias("document_format"),
        F.when(review, "string_formula_boundary_ambiguous").when(formula, "string_formula_boundary_sequence")
        .when(number, "numbered_dot_formula_sequence").when(restart, "numbered_header_sequence_restart")
        .alias("structure_reason"))


def parse_sections_exact(docs: DataFrame, options: DataFrame, dictionary: DataFrame) -> dict[str, DataFrame]:
    """The whole second parser: sections, formats and option mappings."""
    sections = settle(build_sections(comma_chunks(docs.filter(~is_blank("text")))))
    known = settle(dictionary.select("key").distinct())
    formats = settle(document_structure(sections, known))
    kinds = settle(classify_section_kind(split_trailing_annotation(sections), known))
    canonical = settle(canonicalize_options(options))
    return {
        "sections": kinds, "formats": formats, "canonical": canonical,
        "mappings": map_sections_exact(kinds, canonical, formats),
    }
