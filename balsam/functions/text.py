"""Text primitives that stay in the JVM, plus the one Unicode fold that cannot.

Spark has neither NFKC nor case folding.  ASCII strings need neither (lower-casing is the
same thing), so only non-ASCII values cross into Python; the rest go over as nulls.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space (Unicode space separators plus the
# control characters U+0009-U+000D, U+001C-U+001F and U+0085), ready for a character class.
SPACE_RANGES = (
    "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The small ones one by one: Java looks those up and walks a class's ranges.
SPACE_CHARS = SPACE_RANGES.replace("\t-\r\x1c- ", "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")
SPACE = f"[{SPACE_CHARS}]"
SPACES = f"{SPACE}+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate a value once and use it several times in `body`.

    A repeated expression is otherwise copied into the plan once per use; nested copies grow
    exponentially and end code generation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str, chars: str = SPACE_CHARS) -> Column:
    """Trim a character class from both ends."""
    if chars == SPACE_CHARS:  # no other class holds every line end, where `$` would stop
        return F.regexp_extract(col(c), f"(?s)^{SPACE}*+(.*[^{SPACE_CHARS}])", 1)
    return F.regexp_replace(col(c), f"^[{chars}]+|[{chars}]+$", "")


def collapse(c: Column | str) -> Column:
    """White-space runs become one blank; ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(col(c), SPACES, " "))


def squeeze(c: Column | str) -> Column:
    """Remove all white space."""
    return F.regexp_replace(col(c), SPACES, "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~col(c).rlike(f"[^{SPACE_CHARS}]"), F.lit(True))


def _non_ascii(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7f]"), c)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_casefold_each(s: pd.Series) -> pd.Series:
    """Fold character by character, so that combining sequences are not merged."""
    return s.map(
        lambda v: "".join(unicodedata.normalize("NFKC", ch).casefold() for ch in v),
        na_action="ignore",
    )


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def _folded(c: Column | str, udf, ascii_form) -> Column:
    """A named column skips Python for its ASCII values; an expression goes through the function
    whole, as testing it first would copy it."""
    if isinstance(c, str):
        return F.coalesce(udf(_non_ascii(F.col(c))), ascii_form(F.col(c)))
    return udf(c)


def nfkc(c: Column | str) -> Column:
    return _folded(c, _nfkc, lambda x: x)


def fold(c: Column | str) -> Column:
    """NFKC + case fold of the whole string."""
    return _folded(c, _nfkc_casefold, F.lower)


def fold_each(c: Column | str) -> Column:
    """NFKC + case fold of each character on its own."""
    return _folded(c, _nfkc_casefold_each, F.lower)


def casefold(c: Column | str) -> Column:
    return _folded(c, _casefold, F.lower)


def contains_any(c: Column | str, words) -> Column:
    """True when the text contains any of the literal words (words is a plain sequence)."""
    out = F.lit(False)
    for word in words:
        out = out | col(c).contains(word)
    return F.coalesce(out, F.lit(False))


def lines(*parts: Column, sep: str = "\n") -> Column:
    """Join the non-null parts."""
    return F.concat_ws(sep, *parts)


def labelled(label: str, c: Column | str) -> Column:
    """'label: value' for a non-empty value, else null."""
    c = col(c)
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))


def keep_indexed(arr: Column, predicate) -> Column:
    """`filter(arr, (x, i) -> …)` with a shorter name."""
    return F.filter(arr, predicate)


def first_occurrences(arr: Column, key=None) -> Column:
    """Order-preserving distinct of an array by a key expression (not null)."""
    if key is None:
        return F.array_distinct(arr)

    def firsts(a: Column, k: Column) -> Column:
        keyed = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        # Equal keys stand side by side once sorted; the first of each run goes back to its place.
        return let(keyed, lambda s: F.transform(F.sort_array(F.transform(
            F.filter(s, lambda e, n: (n == 0) | (F.get(s, n - 1)["k"] != e["k"])), lambda e: e["i"])), lambda i: F.get(a, i)))

    return let(arr, lambda a: let(F.transform(a, key), lambda k: F.when(
        F.size(F.array_distinct(k)) == F.size(k), a).otherwise(firsts(a, k))))


# --- splitting ---------------------------------------------------------------------------

def split_simple(c: Column | str) -> Column:
    """Comma (ASCII or full-width) separated names: collapsed, blanks dropped."""
    parts = F.split(F.translate(F.coalesce(col(c), F.lit("")), "，", ","), ",")
    return F.filter(F.transform(parts, collapse), lambda x: x != "")


# A noncharacter, which no text may hold: stands for a separating comma while chunks are glued.
_CUT = "\uffff"


def _depth_after(text: Column, depth: Column) -> Column:
    """Bracket depth at the end of a comma-free piece; depth never goes below zero."""
    walked = F.aggregate(
        F.split(F.regexp_replace(text, r"[^()\[\]]", ""), ""), depth,
        lambda acc, ch: F.greatest(
            acc + F.when(ch.isin("(", "["), 1).when(ch.isin(")", "]"), -1).otherwise(0), F.lit(0)))
    return F.when(text.rlike(r"[()\[\]]"), walked).otherwise(depth)


# Comma pieces that are walked together: a growing result is copied once per block, not once per piece.
_BLOCK = 512


def _bracket_marks(pieces: Column) -> Column:
    """One character per comma piece: 1 if brackets are open before it, else 0."""

    def step(acc, p):
        return F.struct(_depth_after(p, acc["depth"]).alias("depth"),
                        F.concat(acc["marks"], F.when(acc["depth"] > 0, "1").otherwise("0")).alias("marks"))

    def block(acc, b):
        return let(
            F.aggregate(F.slice(pieces, b * _BLOCK + 1, F.lit(_BLOCK)),
                        F.struct(acc["depth"].alias("depth"), F.lit("").alias("marks")), step),
            lambda done: F.struct(done["depth"].alias("depth"),
                                  F.concat(acc["blocks"], F.array(done["marks"])).alias("blocks")))

    last = F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")
    return F.aggregate(
        F.sequence(F.lit(0), last), F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("blocks")),
        block, lambda acc: F.array_join(acc["blocks"], ""))


def raw_chunks(c: Column | str) -> Column:
    """Pieces between the commas that stand outside brackets and not between two digits.

    Text without brackets is split by one regular expression.  Otherwise the comma pieces are
    marked block by block with whether brackets are open before them, and joined again by a comma
    or by the cut mark.  Nothing that grows with the text is copied per piece, so both passes are
    linear up to millions of commas."""

    def glued(pieces: Column) -> Column:
        return let(F.split(_bracket_marks(pieces), ""), lambda open_: F.split(F.array_join(F.transform(
            pieces, lambda p, i: F.concat(
                F.when(i == 0, "").when(
                    (F.get(open_, i) == "1")
                    | (F.get(pieces, i - 1).rlike(r"(?U)\d\z") & p.rlike(r"(?U)^\d")), ",").otherwise(_CUT), p)), ""), _CUT))

    return let(F.coalesce(col(c), F.lit("")), lambda text: F.when(
        text.rlike(r"[(\[]"), let(F.split(text, ","), glued)).otherwise(F.split(text, r"(?U)(?<!\d),|,(?!\d)")))


def split_ingredients(c: Column | str) -> Column:
    """Trimmed, non-empty chunks."""
    return F.filter(F.transform(raw_chunks(c), lambda x: strip(x)), lambda x: x != "")


# Punctuation trimmed from the edges of an ingredient section.
EDGE_CHARS = " \t\r\n:;\\-–—"


def clean_section(c: Column | str) -> Column:
    """Undo line breaks inside a section: joined between letters, a blank elsewhere."""
    text = strip(c, EDGE_CHARS)
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(
        text, f"(?<=[가-힣A-Za-z]){SPACE}*\n{SPACE}*(?=[가-힣A-Za-z])", ""
    )
    return strip(F.regexp_replace(text, f"{SPACE}*\n{SPACE}*", " "))


# Letters whose case fold is more than their small letter.
_FOLDS = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŉ": "ʼn", "ΐ": "ΐ", "ΰ": "ΰ"}


def casefolded(x: Column) -> Column:
    """A key that two texts share if their case folds are equal: small letters, one sigma, one long s,
    sharp s and ligatures spelled out."""
    small = F.lower(x)
    out = F.translate(small, "ςſẞ", "σsß")
    for letter, spelled in _FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    # As many bytes as characters: ASCII, which lower-casing folds.
    return F.when(F.octet_length(x) == F.length(x), small).otherwise(out)


def section_ingredients(c: Column | str) -> Column:
    """Ingredient array of one section; duplicates by case fold keep the first spelling."""
    parts = F.transform(
        split_ingredients(clean_section(c)),
        lambda x: strip(F.regexp_replace(x, SPACES, " "), EDGE_CHARS),
    )
    parts = F.filter(parts, lambda x: x != "")
    return first_occurrences(parts, casefolded)
