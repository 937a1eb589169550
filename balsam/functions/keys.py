"""Name-normalisation policies.  They differ on purpose: a policy is picked by what the key is for."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import (
    SPACE, SPACE_CHARS, SPACES, col, collapse, fold, fold_each, let, nfkc, squeeze, strip,
)

# Punctuation that carries no meaning in an option label.
LABEL_PUNCTUATION = "[](){}·ㆍ_/,.\\-:;"
_LABEL_CLASS = f"[{SPACE_CHARS}\\[\\](){{}}·ㆍ_/,.\\\\\\-:;]+"

# Words that mark a leading bracket block as a promotion.
PROMOTION_MARKERS = (
    "기획", "단품", "new", "단독", "본품", "리필", "증정", "한정", "재입고", "pick", "ad",
    "컬렉션", "올영", "용기",
)
# Promotion words before, and package words after, an option name.
_LEADING_WORDS = "기획|단품|new|단독|한정|재입고"
_PACKAGE_WORDS = "단품|본품|리필"


def clean_text(c: Column | str) -> Column:
    return F.coalesce(collapse(c), F.lit(""))


def retrieval_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(clean_text(c)), f"[{SPACE_CHARS}\\-/·,()]+", "")


def registry_key(c: Column | str) -> Column:
    """Key for legal decisions: dashes unified, dots, commas and slashes dropped, brackets kept."""
    return F.translate(squeeze(F.lower(clean_text(c))), "‐–—·ㆍ,./", "---")


def cas_key(c: Column | str) -> Column:
    return F.replace(clean_text(c), F.lit(" "), F.lit(""))


CAS_PATTERN = r"(?U)\b\d{2,7}-\d{2}-\d\b"


def split_cas(c: Column | str) -> Column:
    """Every registry number found in the text, in order."""
    return F.regexp_extract_all(clean_text(c), F.lit(CAS_PATTERN), F.lit(0))


def item_key(c: Column | str) -> Column:
    return squeeze(F.lower(strip(c)))


def _or_else(value: Column, other) -> Column:
    return F.when(value == "", other).otherwise(value)


def product_name_key(c: Column | str) -> Column:
    """Folded name without its leading [..] blocks; the whole name when nothing else is left."""
    blocks = rf"^(?:{SPACE}*\[[^\[\]]*\])+{SPACE}*"
    return let(collapse(fold(c)), lambda whole: let(
        collapse(F.regexp_replace(whole, blocks, "")), lambda bare: _or_else(bare, whole)))


_PARENTHESISED = r"\([^)]*\)"


def rule_key(c: Column | str) -> Column:
    bare = F.regexp_replace(strip(F.coalesce(fold(c), F.lit(""))), _PARENTHESISED, "")
    return F.regexp_replace(bare, f"[{SPACE_CHARS}_\\-./]+", "")


def rule_match_keys(c: Column | str) -> Column:
    """All keys under which an ingredient may match a rule, without blanks or repeats."""
    text = F.coalesce(col(c), F.lit(""))
    codes = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?iU)\bCI\s*[\d:]+\b"), F.lit(0)),
        lambda x: squeeze(F.lower(x)),
    )
    # Only full-width brackets make "drop brackets, then fold" differ from "fold, then drop".
    wide = F.when(text.rlike("[（）]"), F.regexp_replace(text, _PARENTHESISED, ""))
    keys = F.array_distinct(F.concat(F.array(rule_key(c)), codes, F.array(rule_key(wide))))
    return F.filter(keys, lambda x: x != "")


def dictionary_key(c: Column | str) -> Column:
    return squeeze(fold(c))


def dictionary_key_without_code(c: Column | str) -> Column:
    """Second-chance key with a trailing `(CI n)` removed; null when there is none."""
    text = strip(c)
    bare = F.regexp_replace(
        text, rf"(?iU){SPACE}*\({SPACE}*ci{SPACE}*\d+{SPACE}*\){SPACE}*$", ""
    )
    return F.when((bare != text) & (strip(bare) != ""), dictionary_key(bare))


def option_label_key(c: Column | str) -> Column:
    return F.regexp_replace(
        fold_each(F.regexp_replace(col(c), _LABEL_CLASS, "")), _LABEL_CLASS, ""
    )


_INDEXED = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("offsets", T.ArrayType(T.IntegerType())),
])


def index_label(value: str | None, drop_shade_unit: bool) -> tuple[str, list[int]]:
    """Label key of a long text plus, per key character, its offset in the text."""
    drop = set(LABEL_PUNCTUATION)
    chars, offsets = [], []
    for i, ch in enumerate(value or ""):
        if ch.isspace() or ch in drop:
            continue
        for f in unicodedata.normalize("NFKC", ch).casefold():
            unit = drop_shade_unit and f == "호" and chars and chars[-1].isdigit()
            if not (unit or f.isspace() or f in drop):
                chars.append(f)
                offsets.append(i)
    return "".join(chars), offsets


def _indexed(drop_shade_unit: bool):
    @F.pandas_udf(_INDEXED)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([index_label(v, drop_shade_unit) for v in s], columns=["text", "offsets"])

    return run


label_with_offsets = _indexed(False)
# The same, without the shade unit after a digit.
mapping_label_with_offsets = _indexed(True)


def _spaced(word: str) -> str:
    """The word's letters with any meaningless punctuation between them."""
    return f"{_LABEL_CLASS[:-1]}*".join(word)


_LEAD = rf"(?iU)^\s*(?:{_LEADING_WORDS})(?=\s|[/_\-·])(?:\s|[/_\-·])*"
# A run of leading bracket blocks, one of which holds a promotion marker.
_PROMOTION_BLOCKS = (
    r"(?iU)^\s*(?:\[[^\[\]]*\]\s*)*\[[^\[\]]*(?:"
    + "|".join(_spaced(w) for w in PROMOTION_MARKERS)
    + r")[^\[\]]*\]\s*(?:\[[^\[\]]*\]\s*)*"
)
_PACKAGE_TAIL = (
    rf"(?iU)(?:\s|[/_\-·])+(?:\((?:{_PACKAGE_WORDS})(?:\s*\+\s*(?:{_PACKAGE_WORDS}))*\)"
    rf"|(?:{_PACKAGE_WORDS}|기획)(?:\s*\+\s*(?:{_PACKAGE_WORDS}))*)\s*$"
)
_SHADE_UNIT = r"(?U)(?<=\d)\s*호"


def _without_marketing(text: Column) -> Column:
    """Drop promotion words and blocks, package words and the shade unit; one pass each."""
    text = strip(F.regexp_replace(text, _LEAD, ""))
    text = F.regexp_replace(text, _PROMOTION_BLOCKS, "")
    text = strip(F.regexp_replace(text, _LEAD, ""))
    return F.regexp_replace(F.regexp_replace(text, _PACKAGE_TAIL, ""), _SHADE_UNIT, "")


def option_mapping_key(c: Column | str) -> Column:
    """Label key of what is left of an option name once its marketing text is removed.

    The patterns ignore case, so folding first gives the same key with a single fold."""
    return F.regexp_replace(_without_marketing(fold(c)), _LABEL_CLASS, "")


def full_label_key(c: Column | str) -> Column:
    """Folded label with only white space removed."""
    return squeeze(fold(strip(c)))


def option_display_name(c: Column | str) -> Column:
    """Readable option name: marketing text removed, separators as blanks."""
    return let(
        collapse(F.regexp_replace(_without_marketing(nfkc(c)), r"[/_·-]+", " ")),
        lambda shown: _or_else(shown, collapse(c)))


_SHADE = r"(?U)^(?i:([a-z]+)(\d+)|(\d+(?:\.\d+)?)([a-z]+)?)$"


def shade_code_of_key(key: Column | str) -> Column:
    """Shade code of an option mapping key: leading zeros dropped; other keys unchanged."""
    def code(k: Column) -> Column:
        number = F.concat(F.regexp_extract(k, _SHADE, 2), F.regexp_extract(k, _SHADE, 3))
        # Zeros go at the front of a whole number and at the end of a decimal one.
        number = F.when(number.contains("."), F.regexp_replace(number, r"\.?0+$", "")).otherwise(
            F.regexp_replace(number, "^0+(?=.)", ""))
        return F.when(k.rlike(_SHADE), F.concat(
            F.lower(F.regexp_extract(k, _SHADE, 1)), number, F.lower(F.regexp_extract(k, _SHADE, 4)))).otherwise(k)

    return let(col(key), code)


def shade_code_key(c: Column | str) -> Column:
    return shade_code_of_key(option_mapping_key(c))


# Punctuation trimmed from both ends of a section header.
HEADER_EDGE_CHARS = "[](){}:;·-–—.,★# "


def header_label_key(c: Column | str) -> Column:
    """Folded header label: outer punctuation, leading zeros and the shade unit removed."""
    edge = "".join("\\" + ch for ch in HEADER_EDGE_CHARS)
    text = collapse(strip(collapse(fold(c)), edge))
    text = F.regexp_replace(text, r"(?U)^0+(?=\d)", "")
    return collapse(F.regexp_replace(text, r"(?U)(?<=\d)\s*호(?=\s|$)", ""))


# Request phrases that may end a product question, removed in this order.
INTENT_SUFFIXES = (
    r"(?U)\s*(?:이|가|은|는)?\s*(?:민감성\s*피부에\s*)?(?:괜찮은지|잘\s*맞는지)\s*"
    r"(?:알려\s*줘|알려주세요|분석해\s*줘|분석해주세요)?[?.!]*$",
    r"(?U)(?:을|를)?\s*(?:성분을?\s*)?(?:분석|확인)(?:해\s*(?:줘|주세요))?[?.!]*$",
)


def search_intent_query(c: Column | str) -> Column:
    """Product text of a question: quotes and trailing request phrases removed."""
    asked = F.regexp_replace(
        F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), "[“”\"']", ""), SPACES, " ")

    def bare(text: Column) -> Column:
        out = text
        for pattern in INTENT_SUFFIXES:
            out = F.regexp_replace(out, pattern, "")
        return let(strip(out), lambda x: _or_else(x, text))

    return let(asked, bare)


def parse_price(c: Column | str) -> Column:
    """Digits of a price text as a number, null when there are none."""
    return F.regexp_replace(col(c), r"[^0-9]", "").try_cast("bigint")


def coerce_flag(c: Column | str) -> Column:
    """y/yes/1/true and n/no/0/false in any case; anything else is null."""
    text = F.lower(strip(col(c).cast("string")))
    return F.when(text.isin("y", "yes", "1", "true"), True).when(
        text.isin("n", "no", "0", "false"), False
    )


def document_id(kor: Column | str, eng: Column | str, cas: Column | str) -> Column:
    joined = F.lower(F.concat_ws("|", clean_text(kor), clean_text(eng), clean_text(cas)))
    return F.concat(F.lit("ingredient-"), F.md5(joined))


def record_hash(c: Column | str) -> Column:
    return F.sha2(strip(c), 256)


def option_key(name_key: Column | str) -> Column:
    """Stable 16-digit option key of a normalised name."""
    return F.substring(F.sha2(col(name_key), 256), 1, 16)


POLICIES: dict[str, Callable[[Column | str], Column]] = {
    "clean_text": clean_text,
    "retrieval_key": retrieval_key,
    "registry_key": registry_key,
    "cas_key": cas_key,
    "item_key": item_key,
    "product_name_key": product_name_key,
    "rule_key": rule_key,
    "dictionary_key": dictionary_key,
    "option_label_key": option_label_key,
    "option_mapping_key": option_mapping_key,
    "full_label_key": full_label_key,
    "shade_code_key": shade_code_key,
    "option_display_name": option_display_name,
    "header_label_key": header_label_key,
    "search_intent_query": search_intent_query,
    "record_hash": record_hash,
}
