"""Questions: ingredient lists, routing and context flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.text import collapse, contains_any, split_simple

# Words that send a question to the safety route.
DANGER_WORDS = (
    "호흡곤란", "숨이 안", "숨쉬기", "숨 쉬기", "얼굴이 부", "부종", "진물", "물집", "심한 통증",
    "통증이 심", "눈 주변", "전신 두드러기", "두드러기", "피부가 벗겨", "피부 벗겨",
)
# Words that send a question to the routine route.
ROUTINE_WORDS = (
    "비타민c", "비타민 c", "bha", "aha", "레티놀", "트레티노인", "아다팔렌", "필링", "스크럽",
    "토너", "세럼", "루틴", "같이 써", "함께 써", "병행",
)


def ingredient_names(structured: Column | str, text: Column | str) -> Column:
    """Structured list if it has entries, else the split text; distinct, in first order."""
    listed = F.filter(
        F.transform(structured, lambda x: F.coalesce(collapse(x), F.lit(""))), lambda x: x != "")
    return F.array_distinct(F.when(F.size(structured) > 0, listed).otherwise(split_simple(text)))


def resolve_ingredients(requests: DataFrame, structured: str, text: str) -> DataFrame:
    return requests.withColumn("ingredient_names", ingredient_names(F.col(structured), text))


def route_questions(
    requests: DataFrame, danger: Sequence[str] = DANGER_WORDS, routine: Sequence[str] = ROUTINE_WORDS,
    warning: str = texts.SAFETY_WARNING,
) -> DataFrame:
    """Add route and warnings: danger words first, then ingredients, then routine words.

    Needs question, ingredient_names and current_routine."""
    said = F.lower(F.concat_ws(
        " ", F.coalesce("question", F.lit("")), F.array_join("ingredient_names", " "),
        F.coalesce("current_routine", F.lit(""))))
    staged = requests.withColumn("__said", said)
    route = (
        F.when(contains_any("__said", danger), "safety_warning")
        .when(F.size("ingredient_names") > 0, "ingredient_rag")
        .when(contains_any("__said", routine), "routine_check")
        .otherwise("general_answer")
    )
    return staged.withColumn("route", route).withColumns({
        "warnings": F.when(F.col("route") == "safety_warning", F.array(F.lit(warning)))
        .otherwise(F.array().cast("array<string>")),
        "ingredient_count": F.size("ingredient_names"),
    }).drop("__said")


def context_flags(contexts: DataFrame) -> DataFrame:
    """Context length and flags.  The text for 'nothing found' has characters too, so an empty
    retrieval still reports a length; emptiness is decided by the document count."""
    empty = F.col("retrieved_doc_count") == 0
    return contexts.withColumns({
        "context_char_count": F.length(F.trim("context")),
        "context_empty": empty,
        "used_rag_context": ~empty,
    })


def merge_warnings(df: DataFrame, current: str, new: str, out: str) -> DataFrame:
    """Current warnings, then new ones: no repeats, no blanks, order kept."""
    from .windows import ordered_union

    return df.withColumn(out, ordered_union(current, new))


