"""First parser: explicit option headers in one raw label text per product.

A document is one row, so everything about a single text is done inside the row with array
functions and without a shuffle; only the joins to options and the per-document decisions move
data, and they move spans and section bodies, never the whole text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..functions.settle import settle
from ..functions.text import SPACE, is_blank, let, section_ingredients, strip

# Header grammars of the first parser, (name, pattern), most explicit first.
HEADER_GRAMMARS = (
    ("bracketed", r"\[(?P<label>[^\[\]\r\n]{1,120})\]"),
    ("star_colon", r"★\s*(?P<label>[^,:;\[\]\r\n]{1,80}?)\s*:"),
    ("hash_alphanumeric_code",
     r"(?<![0-9A-Za-z가-힣])#\s*(?P<label>(?:[A-Za-z]+\d+|\d+[A-Za-z]+))(?=\s)"),
    ("malformed_bracket", r"\[(?P<label>[^\[\]()\],:\r\n]{1,80})\)"),
    ("malformed_bracket", r"\((?P<label>[^\[\]()\],:\r\n]{1,80})\]"),
)
# An unbracketed two-language name before an ingredient.
BILINGUAL_GRAMMAR = (
    ("unbracketed_bilingual",
     r"(?<![A-Za-z가-힣])(?P<label>[가-힣]{1,10}(?:\s+[가-힣]{1,10}){0,1}\s+"
     r"[A-Z][a-z]{1,24}(?:\s+[A-Z][a-z]{1,24}){0,3})(?=\s*[가-힣])"),
)
# A two-digit full option label that repeats without brackets, the product title
# that may stand before it, and the thresholds under which the grammar is trusted.
REPEATED_GRAMMAR = (
    ("repeated_unbracketed_full_option_label",
     r"(?<![0-9A-Za-z가-힣])(?P<label>\d{2}\s*[가-힣]{1,15}(?:\s+[가-힣]{1,15}){0,2})"
     r"(?=\s+[가-힣A-Za-z][^,\[\]\r\n]{0,50},)"),
)
REPEATED_TITLE = r"롬앤\s+더\s+쥬시\s+래스팅\s+틴트(?:\s+3\.5g)?\s*$"
TITLE_LOOKBEHIND = 80
MIN_REPEATED_HEADERS = 3
MIN_REPEATED_BODY = 20
MIN_SECTION_INGREDIENTS = 2

_SPAN = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("raw_header", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("grammar", T.StringType()),
]))


def span_scanner(grammars: Sequence[tuple[str, str]], prune: bool = True):
    """Arrow function: all matches of the grammars in a text, by start; where matches overlap the
    earliest, then longest, is kept."""
    compiled = [(name, re.compile(pattern)) for name, pattern in grammars]

    def scan(text: str) -> list[tuple]:
        found = sorted(
            ((m.start("label") if name.startswith(("unbracketed", "repeated")) else m.start(),
              m.end("label") if name.startswith(("unbracketed", "repeated")) else m.end(),
              name, m) for name, pattern in compiled for m in pattern.finditer(text or "")),
            key=lambda x: (x[0], x[0] - x[1], x[2]),
        )
        kept, last = [], -1
        for start, end, name, m in found:
            if prune and start < last:
                continue
            kept.append((start, end, text[start:end], m["label"].strip(), name))
            last = end
        return kept

    @F.pandas_udf(_SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(scan)

    return spans


def _next_start(spans: Column, i: Column, text: Column) -> Column:
    return F.coalesce(F.get(spans, i + 1)["start"], F.length(text))


def _body(text: Column, start: Column, end: Column) -> Column:
    return F.when(end > start, F.substr(text, start + 1, end - start)).otherwise("")


def with_headers(docs: DataFrame, grammars=HEADER_GRAMMARS, out: str = "headers") -> DataFrame:
    """Add the array of header spans of each document (doc_id, text)."""
    return docs.withColumn(out, span_scanner(grammars)(F.col("text")))


def extract_headers(docs: DataFrame, grammars=HEADER_GRAMMARS) -> DataFrame:
    """One row per header: doc_id, start, end, raw_header, label, grammar, label_key, malformed."""
    rows = with_headers(docs, grammars).select("doc_id", F.explode("headers").alias("h")).select(
        "doc_id", "h.*")
    return rows.withColumns({
        "label_key": keys.option_mapping_key("label"),
        "malformed": F.col("grammar") == "malformed_bracket",
    })


def cut_sections(docs: DataFrame, grammars=HEADER_GRAMMARS) -> DataFrame:
    """Section of every header: from its end to the next header of any grammar, else to the end.

    Bodies are cut inside the document row, so the text itself is never copied per section."""
    text, spans = F.col("text"), F.col("headers")
    cut = F.transform(spans, lambda h, i: F.struct(
        h["start"].alias("start"), h["end"].alias("end"), h["raw_header"].alias("raw_header"),
        h["label"].alias("label"), h["grammar"].alias("grammar"),
        _next_start(spans, i, text).alias("section_end"),
        _body(text, h["end"], _next_start(spans, i, text)).alias("body"),
    ))
    rows = with_headers(docs, grammars).select("doc_id", F.explode(cut).alias("s")).select("doc_id", "s.*")
    return rows.withColumns({
        "label_key": keys.option_mapping_key("label"),
        "malformed": F.col("grammar") == "malformed_bracket",
        "body": strip("body"),
        "ingredients": section_ingredients("body"),
    }).withColumn("valid", F.size("ingredients") >= MIN_SECTION_INGREDIENTS)


# --- options -----------------------------------------------------------------------------------

def canonicalize_options(options: DataFrame) -> DataFrame:
    """Options (doc_id, option_pos, raw_option_name, source_option_id) merged by mapping key.

    The first option of a key leads; options with an empty key stay apart.  Source names and ids
    are first reduced to distinct values with their first place, then listed in that order."""
    keyed = options.withColumn("mapping_key", keys.option_mapping_key("raw_option_name")).withColumn(
        "group_key", F.when(F.col("mapping_key") != "", F.col("mapping_key")).otherwise(
            F.concat(F.lit("__empty__:"), "option_pos")))
    facts = keyed.select("doc_id", "group_key", "mapping_key", "option_pos", "raw_option_name", F.explode(
        F.array(F.struct(F.lit("name").alias("kind"), F.col("raw_option_name").alias("value")),
                F.struct(F.lit("id").alias("kind"), F.col("source_option_id").alias("value")))).alias("f"))
    first = facts.groupBy("doc_id", "group_key", "mapping_key", "f.kind", "f.value").agg(
        F.min("option_pos").alias("pos"), F.min_by("raw_option_name", "option_pos").alias("raw"),
        F.count("*").alias("n"))
    def listed(kind: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(
            (F.col("kind") == kind) & (F.coalesce("value", F.lit("")) != ""),
            F.struct("pos", "value")))), lambda x: x["value"])

    merged = first.groupBy("doc_id", "group_key", "mapping_key").agg(
        F.min("pos").alias("option_pos"), F.min_by("raw", "pos").alias("raw_option_name"),
        listed("name").alias("source_names"), listed("id").alias("source_ids"),
        F.sum(F.when(F.col("kind") == "name", F.col("n"))).alias("n_sources"))
    seed = F.when(F.col("mapping_key") != "", F.col("mapping_key")).otherwise(F.concat(
        F.lit("__unmapped__:"), F.coalesce(F.get("source_ids", F.lit(0)), F.concat(
            F.lit("__empty_index__:"), "option_pos"))))
    return merged.select(
        "doc_id", "option_pos", "mapping_key", "raw_option_name",
        F.when(F.col("mapping_key") != "", keys.option_display_name("raw_option_name"))
        .otherwise(F.col("raw_option_name")).alias("option_name"),
        keys.option_key(seed).alias("option_key"), "source_names", "source_ids", "n_sources")


_CODE = r"(?iU)^\s*((?:[a-z]+\s*)?\d+(?:\.\d+)?(?:\s*[a-z]+)?)(?:\s*호)?(?=\s|$)"


def option_aliases(canonical: DataFrame) -> DataFrame:
    """Alias keys of each option: full key, shade code, colour name, and the unshortened label."""
    coded = F.col("__name").rlike(_CODE)
    # The name and its parts are plain columns before keys are made of them.
    shown = settle(canonical.withColumn("__name", keys.option_display_name("raw_option_name")).withColumns({
        "__code": F.when(coded, F.regexp_extract("__name", _CODE, 1)),
        "__rest": F.when(coded, F.regexp_replace("__name", _CODE, "")).otherwise(F.col("__name")),
    }))
    return shown.withColumns({
        "full_key": keys.option_mapping_key("__name"),
        "shade_code": F.nullif(keys.shade_code_key("__code"), F.lit("")),
        "color_key": F.nullif(keys.option_mapping_key("__rest"), F.lit("")),
        "label_full_key": keys.full_label_key("__name"),
    }).drop("__name", "__code", "__rest")


def header_option_candidates(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, start, option_pos): options of the first alias level that has any hit.

    Levels: full key, shade code, colour name; a repeated label only knows its whole label."""
    repeated = F.col("grammar") == REPEATED_GRAMMAR[0][0]
    wanted = headers.select("doc_id", "start", F.explode(F.when(repeated, F.array(
        F.struct(F.lit(-1).alias("level"), F.col("label_key").alias("key")))).otherwise(F.array(
            F.struct(F.lit(0).alias("level"), F.col("label_key").alias("key")),
            F.struct(F.lit(1).alias("level"), keys.shade_code_of_key("label_key").alias("key")),
            F.struct(F.lit(2).alias("level"), F.col("label_key").alias("key"))))).alias("w")
    ).select("doc_id", "start", "w.*")
    known = aliases.select("doc_id", "option_pos", F.explode(F.array(
        F.struct(F.lit(-1).alias("level"), F.col("label_full_key").alias("key")),
        F.struct(F.lit(0).alias("level"), F.col("full_key").alias("key")),
        F.struct(F.lit(1).alias("level"), F.col("shade_code").alias("key")),
        F.struct(F.lit(2).alias("level"), F.col("color_key").alias("key")),
    )).alias("a")).select("doc_id", "option_pos", "a.*").filter("key IS NOT NULL")
    hits = wanted.join(known, ["doc_id", "level", "key"])
    best = F.min("level").over(Window.partitionBy("doc_id", "start"))
    return hits.withColumn("__best", best).filter("level = __best").select(
        "doc_id", "start", "option_pos").distinct()


def map_options(sections: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(option mappings, header statuses) for flat documents.

    Ambiguity is two-sided: a header that fits several options makes them all ambiguous, an
    option that several headers fit is ambiguous with those headers."""
    sections = settle(sections)
    aliases = settle(option_aliases(canonical))
    good = sections.filter(~F.col("malformed"))
    pairs = settle(header_option_candidates(good, aliases))
    per_header = pairs.groupBy("doc_id", "start").agg(F.count("*").alias("n_options"))
    sided = pairs.join(per_header, ["doc_id", "start"])
    per_option = sided.groupBy("doc_id", "option_pos").agg(
        F.count_if(F.col("n_options") == 1).alias("n_assigned"),
        F.bool_or(F.col("n_options") > 1).alias("collides"),
        F.min(F.when(F.col("n_options") == 1, F.col("start"))).alias("start"),
    ).withColumn("ambiguous", F.col("collides") | (F.col("n_assigned") > 1))
    malformed = sections.filter("malformed")
    # A malformed header hints at an option if exactly one option has any alias equal to it.
    hint_keys = malformed.select("doc_id", "start", F.explode(F.array(
        F.struct(F.lit("name").alias("kind"), F.col("label_key").alias("key")),
        F.struct(F.lit("code").alias("kind"), keys.shade_code_of_key("label_key").alias("key")),
    )).alias("k")).select("doc_id", "start", "k.*")
    alias_rows = aliases.select("doc_id", "option_pos", F.explode(F.array(
        F.struct(F.lit("name").alias("kind"), F.col("full_key").alias("key")),
        F.struct(F.lit("name").alias("kind"), F.col("color_key").alias("key")),
        F.struct(F.lit("code").alias("kind"), F.col("shade_code").alias("key")),
    )).alias("k")).select("doc_id", "option_pos", "k.*").filter("key IS NOT NULL")
    hints = (
        hint_keys.join(alias_rows, ["doc_id", "kind", "key"])
        .select("doc_id", "start", "option_pos").distinct()
        .groupBy("doc_id", "start").agg(F.count("*").alias("n"), F.min("option_pos").alias("option_pos"))
        .filter("n = 1").select("doc_id", "option_pos").distinct()
        .withColumn("hinted", F.lit(True))
    )
    bodies = good.select("doc_id", "start", "raw_header", "grammar", "body", "ingredients", "valid")
    mapped = (
        canonical.select("doc_id", "option_pos", "option_key", "option_name")
        .join(per_option, ["doc_id", "option_pos"], "left")
        .join(hints, ["doc_id", "option_pos"], "left")
        .join(bodies, ["doc_id", "start"], "left")
    )
    ambiguous = F.coalesce("ambiguous", F.lit(False))
    assigned = F.coalesce(F.col("n_assigned") == 1, F.lit(False))
    status = (
        F.when(ambiguous, "ambiguous").when(~assigned, "unmatched")
        .when(F.col("valid"), "matched").otherwise("unsupported")
    )
    method = (
        F.when(ambiguous, "duplicate_explicit_headers")
        .when(~assigned & F.coalesce("hinted", F.lit(False)), "malformed_explicit_header")
        .when(~assigned, "unmatched_sale_option")
        .when(F.col("valid"), F.when(F.col("grammar") == REPEATED_GRAMMAR[0][0],
                                     "explicit_full_option_label_exact").otherwise(
            F.concat(F.lit("explicit_"), "grammar", F.lit("_exact"))))
        .otherwise("invalid_ingredient_section")
    )
    is_matched = status == "matched"
    empty = F.array().cast("array<string>")
    out = mapped.select(
        "doc_id", "option_pos", "option_key", "option_name", status.alias("mapping_status"),
        method.alias("mapping_method"), F.when(is_matched, 1.0).otherwise(0.0).alias("mapping_confidence"),
        F.when(status.isin("matched", "unsupported"), F.col("raw_header")).alias("matched_header"),
        F.when(status.isin("matched", "unsupported"), F.col("start")).alias("header_start"),
        F.when(is_matched, F.col("ingredients")).otherwise(empty).alias("ingredients"),
    )
    # Header side: ambiguous if it fits several options or touches an ambiguous one.
    touched = sided.join(per_option.select("doc_id", "option_pos", "ambiguous"),
                         ["doc_id", "option_pos"]).groupBy("doc_id", "start").agg(
        F.bool_or((F.col("n_options") > 1) | F.col("ambiguous")).alias("ambiguous_header"))
    headers = sections.join(touched, ["doc_id", "start"], "left").select(
        "doc_id", "start", "end", "section_end", "raw_header", "label", "grammar", "ingredients",
        F.when(F.col("malformed"), "malformed")
        .when(F.coalesce("ambiguous_header", F.lit(False)), "ambiguous")
        .when(F.col("ambiguous_header").isNotNull(), "matched").otherwise("orphan").alias("status"))
    return out, headers


# --- repeated unbracketed labels ----------------------------------------------------------------------

def detect_repeated_labels(docs: DataFrame, canonical: DataFrame, title: str = REPEATED_TITLE) -> DataFrame:
    """Sections of documents that repeat two-digit full option labels without brackets.

    A document qualifies only as a whole: no explicit header, three or more labels of one variant
    from its very start, numbers in order, two or more labels that equal one option, and bodies of
    some length that all begin with the same ingredient."""
    text, spans = F.col("text"), F.col("labels")
    plain = with_headers(docs).filter(~F.exists("headers", lambda h: h["grammar"] != "malformed_bracket"))
    found = plain.drop("headers").withColumn("labels", span_scanner(REPEATED_GRAMMAR)(text)).filter(
        F.size("labels") >= MIN_REPEATED_HEADERS)

    def title_length(h: Column) -> Column:
        low = F.greatest(h["start"] - TITLE_LOOKBEHIND, F.lit(0))
        return F.length(F.regexp_extract(
            F.substr(text, low + 1, h["start"] - low), f"(?iU)(?:{title})", 0))

    marked = F.transform(spans, lambda h: F.struct(
        (h["start"] - title_length(h)).alias("start"), h["end"].alias("end"), h["label"].alias("label"),
        (title_length(h) > 0).alias("titled")))
    found = found.withColumn("labels", marked)
    cut = F.transform(spans, lambda h, i: F.struct(
        h["start"].alias("start"), h["end"].alias("end"), h["label"].alias("label"),
        h["titled"].alias("titled"), (i + 1).alias("n"),
        _next_start(spans, i, text).alias("section_end"),
        strip(_body(text, h["end"], _next_start(spans, i, text))).alias("body"),
        F.substr(text, h["start"] + 1, h["end"] - h["start"]).alias("raw_header")))
    lead = is_blank(F.substr(text, F.lit(1), F.get(spans, F.lit(0))["start"]))
    rows = found.filter(lead).select("doc_id", F.explode(cut).alias("s")).select("doc_id", "s.*")
    rows = rows.withColumns({
        "grammar": F.lit(REPEATED_GRAMMAR[0][0]),
        "label_key": keys.full_label_key("label"),
        "ingredients": section_ingredients("body"),
        "malformed": F.lit(False),
    }).withColumn("shade_number", F.substr("label_key", F.lit(1), F.lit(2)).cast("int"))
    rows = settle(rows)
    hits = header_option_candidates(rows, option_aliases(canonical)).groupBy("doc_id", "start").agg(
        F.count("*").alias("n_options"))
    rows = rows.join(hits, ["doc_id", "start"], "left")
    order = Window.partitionBy("doc_id").orderBy("n")
    checked = rows.withColumn("__before", F.lag("shade_number").over(order))
    first_key = keys.full_label_key(F.get("ingredients", F.lit(0)))
    verdict = checked.withColumn("__first", first_key).groupBy("doc_id").agg(
        F.count_distinct("titled").alias("n_variants"),
        F.bool_and(F.coalesce(F.col("shade_number") >= F.col("__before"), F.lit(True))).alias("in_order"),
        F.count_if(F.col("n_options") == 1).alias("n_exact"),
        F.bool_and((F.length("body") >= MIN_REPEATED_BODY) & (F.size("ingredients") >= 3)).alias("bodies"),
        F.count_distinct("__first").alias("n_first"),
    ).filter("n_variants = 1 AND in_order AND n_exact >= 2 AND bodies AND n_first = 1")
    return rows.join(verdict.select("doc_id"), "doc_id", "left_semi").drop("n", "n_options", "shade_number").withColumn(
        "valid", F.size("ingredients") >= MIN_SECTION_INGREDIENTS)


# --- unbracketed option names --------------------------------------------------------------------------

# How an option name may appear in a text, with the confidence of each way.
LOCATE_LEVELS = (
    ("normalized_mapping_key", 1.0), ("normalized_full_name", 0.95), ("code_and_label", 0.9),
    ("exact_alphanumeric_code", 0.8),
)
_OPTION_CODE = r"(?iU)(?:[a-z]+\s*)?\d+(?:\s*[a-z]+)?(?:\s*호)?"


def _mixed(c: Column) -> Column:
    """Holds a digit and a letter."""
    return c.rlike(r"(?U)\d") & c.rlike(r"(?U)\p{Alpha}")


def option_needles(canonical: DataFrame) -> DataFrame:
    """(doc_id, option_pos, level, needle, in_mapping_text): keys to look for, best first.

    A key equal to an earlier one of the option is dropped."""
    bare = strip(F.regexp_replace(
        F.regexp_replace("raw_option_name", r"\[[^\[\]]*\]", " "), f"{SPACE}+", " "))
    staged = canonical.withColumn("__bare", bare).withColumns({
        "__has": F.col("__bare").rlike(_OPTION_CODE),
        "__tail": F.substr("__bare", F.length(F.get(F.split("__bare", _OPTION_CODE, 2), F.lit(0))) + 1,
                           F.length("__bare")),
        "__first": F.regexp_extract("__bare", _OPTION_CODE, 0),
    })
    staged = settle(staged.withColumns({
        "k1": F.col("mapping_key"),
        "k2": keys.option_label_key(F.col("raw_option_name")),
        "__label": keys.option_mapping_key(F.col("__tail")),
        "__code": keys.option_mapping_key(F.col("__first")),
    }))
    k3 = F.when(F.col("__has") & _mixed(F.col("__label")), F.col("__label"))
    k4 = F.when(F.col("__has") & _mixed(F.col("__code")), F.col("__code"))
    options = F.array(
        F.struct(F.lit(0).alias("level"), F.when(_mixed(F.col("k1")), F.col("k1")).alias("needle"),
                 F.lit(True).alias("in_mapping_text")),
        F.struct(F.lit(1).alias("level"), F.nullif("k2", F.lit("")).alias("needle"),
                 F.lit(False).alias("in_mapping_text")),
        F.struct(F.lit(2).alias("level"), k3.alias("needle"), F.lit(True).alias("in_mapping_text")),
        F.struct(F.lit(3).alias("level"), k4.alias("needle"), F.lit(True).alias("in_mapping_text")),
    )
    found = F.filter(options, lambda x: x["needle"].isNotNull())
    unique = let(found, lambda f: let(F.transform(f, lambda x: x["needle"]), lambda names: F.filter(
        f, lambda x, i: F.array_position(names, x["needle"]) == i + 1)))
    return staged.select("doc_id", "option_pos", F.explode(unique).alias("n")).select(
        "doc_id", "option_pos", "n.*")


def occurrences(text: str | None, needles: Sequence[dict]) -> list[tuple]:
    """(option_pos, level, occurrence, start, end, prefix, closing) of each option's best key that occurs.

    One automaton holds all keys of the document, so its text is read once for each of its two forms,
    however many keys there are.  A prefix (the line up to the span) with a comma in it is given as a
    comma and its last character: no more of it is asked for."""
    hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for mapped in (True, False):
        automaton, owners = ahocorasick.Automaton(), {}
        for n in needles:
            if n["in_mapping_text"] == mapped and n["needle"]:
                owners.setdefault(n["needle"], []).append((n["option_pos"], n["level"]))
        if not owners or not text:
            continue
        for needle in owners:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        key, offsets = keys.index_label(text, mapped)
        for last, needle in automaton.iter(key):
            span = offsets[last - len(needle) + 1], offsets[last] + 1
            for owner in owners[needle]:
                hits.setdefault(owner, []).append(span)
    best: dict[int, int] = {}
    for option, level in hits:
        best[option] = min(level, best.get(option, level))
    breaks, commas = ([m.start() for m in re.finditer(c, text or "")] for c in ("\n", ","))
    out = []
    for (option, level), spans in hits.items():
        for n, (start, end) in enumerate(spans if best[option] == level else ()):
            line = bisect_left(breaks, start)
            line = breaks[line - 1] + 1 if line else 0
            comma = bisect_left(commas, start)
            prefix = "," + text[start - 1] if comma and commas[comma - 1] >= line else text[line:start]
            closing = end
            while closing < len(text) and text[closing] in "])}":
                closing += 1
            out.append((option, level, n, start, end, prefix, closing - end))
    return out


_OCCURRENCES = ("array<struct<option_pos:{kind},level:int,occurrence:int,start:int,end:int,prefix:string,closing:int>>")


def locate_option_headers(docs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Where each option name stands in its document, by the best key that occurs at all.

    Rows: doc_id, option_pos, occurrence (0 is the header, others are duplicates), start, end,
    confidence, method, span_status: 'shared' when another option has exactly this span,
    'ambiguous' when it overlaps a different span, else 'single'.

    A document meets the list of its keys and is searched for all of them in one pass; only small
    span rows leave it.  Overlaps are found by one ordered pass over the distinct spans of a document
    (the running maximum end before, the next start after), not by pairing spans."""
    needles = option_needles(canonical).groupBy("doc_id").agg(F.collect_list(F.struct(
        "option_pos", "level", "needle", "in_mapping_text")).alias("needles"))

    @F.pandas_udf(_OCCURRENCES.format(kind=canonical.schema["option_pos"].dataType.simpleString()))
    def found(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([occurrences(t, n) for t, n in zip(texts, wanted, strict=True)])

    rows = docs.join(needles, "doc_id").select("doc_id", F.explode(found("text", "needles")).alias("o")).select("doc_id", "o.*")
    line_start = ~is_blank("prefix") & ~F.col("prefix").contains(",") & (
        F.length(keys.option_label_key("prefix")) <= 100)
    rows = rows.withColumns({
        "start": F.when(line_start, F.col("start") - F.length("prefix"))
        .when(F.col("prefix").rlike(r"[\[({]\z"), F.col("start") - 1).otherwise(F.col("start")),
        "end": F.col("end") + F.col("closing"),
    }).drop("prefix", "closing")
    heads = rows.filter("occurrence = 0").groupBy("doc_id", "start", "end").agg(
        F.count("*").alias("n_options"))
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, -1)
    step = Window.partitionBy("doc_id").orderBy("start", "end")
    spans = heads.withColumn("overlaps", F.coalesce(
        F.max("end").over(before) > F.col("start"), F.lit(False))
        | F.coalesce(F.lead("start").over(step) < F.col("end"), F.lit(False)))
    level_of = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(c).alias("confidence"))
                         for m, c in LOCATE_LEVELS])
    flagged = rows.join(spans, ["doc_id", "start", "end"], "left")
    own = Window.partitionBy("doc_id", "option_pos")
    overlap = F.max(F.when(F.col("occurrence") == 0, F.col("overlaps"))).over(own)
    shared = F.max(F.when(F.col("occurrence") == 0, F.col("n_options"))).over(own)
    return flagged.select(
        "doc_id", "option_pos", "occurrence", "start", "end", F.get(level_of, F.col("level")).alias("l"),
        F.when(overlap, "ambiguous").when(shared > 1, "shared").otherwise("single").alias("span_status"),
    ).select("doc_id", "option_pos", "occurrence", "start", "end", "span_status", "l.method", "l.confidence")


def located_sections(docs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Option mappings of documents whose option names stand unmarked in the text."""
    located = settle(locate_option_headers(docs, canonical))
    usable = located.filter("span_status <> 'ambiguous'")
    spans = usable.select("doc_id", "start", "end").distinct().groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    text, arr = F.col("text"), F.col("spans")
    bodies = docs.join(spans, "doc_id").select("doc_id", F.explode(F.transform(
        arr, lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            strip(_body(text, s["end"], _next_start(arr, i, text))).alias("body")))).alias("b")
    ).select("doc_id", "b.*").withColumn("section", section_ingredients("body")).drop("body")
    heads = located.filter("occurrence = 0")
    dup = located.groupBy("doc_id", "option_pos").agg((F.count("*") - 1).alias("n_duplicates"))
    out = (
        canonical.join(heads, ["doc_id", "option_pos"], "left")
        .join(dup, ["doc_id", "option_pos"], "left").join(bodies, ["doc_id", "start", "end"], "left")
    )
    valid = F.coalesce(F.size("section") >= MIN_SECTION_INGREDIENTS, F.lit(False))
    status = (
        F.when(F.col("mapping_key") == "", "unsupported")
        .when(F.col("span_status").isNull(), "unmatched")
        .when(F.col("span_status") == "ambiguous", "ambiguous")
        .when(valid, "matched").otherwise("unsupported"))
    method = (
        F.when(F.col("mapping_key") == "", "empty_mapping_key").when(F.col("span_status").isNull(), "not_found")
        .when(F.col("span_status") == "ambiguous", "multiple_or_overlapping_headers")
        .when(valid, F.col("method")).otherwise("invalid_ingredient_section"))
    return out.select(
        "doc_id", "option_pos", "option_key", "option_name", status.alias("mapping_status"),
        method.alias("mapping_method"),
        F.when(status == "matched", F.col("confidence")).otherwise(0.0).alias("mapping_confidence"),
        F.coalesce("n_duplicates", F.lit(0)).alias("n_duplicates"),
        F.when(status == "matched", F.col("section")).otherwise(F.array().cast("array<string>"))
        .alias("ingredients"))


# --- structure -----------------------------------------------------------------------------------------

def classify_structure(docs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Format of each document: flat, hierarchical or needs_review, with header counts.

    Top headers fit exactly one option; headers between two tops that fit no option and open a
    list of two or more ingredients are nested.  Two tops with two nested headers each make a
    hierarchy; one nested label under two tops is left for review."""
    aliases = settle(option_aliases(canonical))
    explicit = settle(extract_headers(docs).filter(~F.col("malformed")))
    fits = header_option_candidates(explicit, aliases)
    per_header = fits.groupBy("doc_id", "start").agg(
        F.count("*").alias("n_options"), F.min("option_pos").alias("option_pos"))
    linked = explicit.join(per_header.filter("n_options = 1"), ["doc_id", "start"]).select(
        "doc_id", "option_pos", "start", "end")
    spare = canonical.join(linked.select("doc_id", "option_pos").distinct(),
                           ["doc_id", "option_pos"], "left_anti")
    located = locate_option_headers(docs, spare)
    alone = located.groupBy("doc_id", "option_pos").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("occurrence") == 0, F.col("start"))).alias("start"),
        F.min(F.when(F.col("occurrence") == 0, F.col("end"))).alias("end"),
        F.max("confidence").alias("confidence"),
    ).filter("n = 1 AND confidence >= 0.9").select("doc_id", "option_pos", "start", "end")
    tops = settle(linked.unionByName(alone))
    unique = tops.groupBy("doc_id", "option_pos").agg(
        F.count("*").alias("n"), F.min("start").alias("start"), F.min("end").alias("end")
    ).filter("n = 1").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("tops"))

    bilingual = extract_headers(docs, BILINGUAL_GRAMMAR)
    both = explicit.unionByName(bilingual)
    taken = header_option_candidates(both.filter(F.col("grammar") != ""), aliases).select(
        "doc_id", "start").distinct()
    free = both.join(taken, ["doc_id", "start"], "left_anti").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "label_key"))).alias("free"))

    text = F.col("text")
    rows = docs.join(unique, "doc_id", "left").join(free, "doc_id", "left").withColumns({
        "tops": F.coalesce("tops", F.array().cast("array<struct<start:int,end:int>>")),
        "free": F.coalesce("free", F.array().cast("array<struct<start:int,end:int,label_key:string>>")),
    })

    def nested(top: Column, i: Column) -> Column:
        stop = _next_start(F.col("tops"), i, text)
        inside = F.filter("free", lambda h: (h["start"] >= top["end"]) & (h["start"] < stop) & ~F.exists(
            "tops", lambda t: (t["start"] == h["start"]) & (t["end"] == h["end"])))
        # Greedy: a header that starts inside the last kept one is dropped.
        kept = F.aggregate(
            inside, F.array().cast("array<struct<start:int,end:int,label_key:string>>"),
            lambda acc, h: F.when(
                (F.size(acc) > 0) & (h["start"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))),
                acc).otherwise(F.concat(acc, F.array(h))))
        return let(kept, lambda k: F.transform(F.filter(
            F.transform(k, lambda h, j: F.struct(
                h["label_key"].alias("label"),
                F.size(section_ingredients(_body(
                    text, h["end"], F.coalesce(F.get(k, j + 1)["start"], stop)))).alias("n"))),
            lambda x: x["n"] >= MIN_SECTION_INGREDIENTS), lambda x: x["label"]))

    rows = rows.withColumn("nested", F.when(F.size("tops") >= 2, F.transform("tops", nested)).otherwise(
        F.array().cast("array<array<string>>"))).select("doc_id", "tops", "nested")
    deep = F.size(F.filter("nested", lambda n: F.size(n) >= 2)) >= 2
    some = F.size(F.filter("nested", lambda n: F.size(n) >= 1)) >= 2
    labels = F.flatten(F.transform("nested", lambda n: F.array_distinct(n)))
    repeated = F.size(labels) > F.size(F.array_distinct(labels))
    return rows.select(
        "doc_id",
        F.when(deep, "hierarchical_option_internal_sections").when(some & repeated, "needs_review")
        .otherwise("option_full_sections").alias("document_format"),
        F.when(deep, "multiple_top_level_options_with_repeated_valid_nested_headers")
        .when(some & repeated, "repeated_nested_header_pattern_needs_review").alias("structure_reason"),
        F.size("tops").alias("top_level_header_count"),
        F.size(F.flatten("nested")).alias("nested_header_count"),
    )


def parse_option_sections(docs: DataFrame, options: DataFrame) -> dict[str, DataFrame]:
    """The whole first parser: canonical options, formats, headers and option mappings.

    Documents that are not flat map none of their options; blank documents likewise."""
    canonical = settle(canonicalize_options(options))
    formats = settle(classify_structure(docs, canonical))
    blank = docs.filter(is_blank("text")).select("doc_id").withColumn("__blank", F.lit(True))
    explicit = cut_sections(docs)
    repeated = detect_repeated_labels(docs, canonical)
    sections = explicit.unionByName(repeated.select(*explicit.columns))
    mapped, headers = map_options(sections, canonical)
    flat = formats.select("doc_id", "document_format", "structure_reason")
    judged = mapped.join(flat, "doc_id", "left").join(blank, "doc_id", "left")
    blocked = F.coalesce(F.col("document_format") != "option_full_sections", F.lit(False))
    is_empty = F.coalesce("__blank", F.lit(False))
    keep = ~(blocked | is_empty)
    mappings = judged.withColumns({
        "mapping_method": F.when(is_empty, "raw_text_empty").when(blocked, F.col("structure_reason"))
        .otherwise(F.col("mapping_method")),
        "mapping_status": F.when(keep, F.col("mapping_status")).otherwise("unsupported"),
        "mapping_confidence": F.when(keep, F.col("mapping_confidence")).otherwise(0.0),
        "matched_header": F.when(keep, F.col("matched_header")),
        "header_start": F.when(keep, F.col("header_start")),
        "ingredients": F.when(keep, F.col("ingredients")).otherwise(F.array().cast("array<string>")),
    }).drop("__blank", "structure_reason", "document_format")
    return {"canonical": canonical, "formats": formats, "headers": headers, "mappings": mappings}
