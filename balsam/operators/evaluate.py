"""Labelled evaluation: outputs and gold joined per case, one boolean per metric, rates per suite.

A metric is a Column over one joined row; gold columns are named expected_*, or as the suite
says.  Lists compare as lists, multisets or sets, whichever the suite means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, contains_any
from .windows import multiset_equal, set_equal


def evaluate(outputs: DataFrame, gold: DataFrame, metrics: Mapping[str, Column], case: str = "case_id") -> DataFrame:
    """case_id, one boolean per metric, and case_correct; a case without output fails."""
    joined = gold.join(outputs, case, "left").select(
        case, *[F.coalesce(c, F.lit(False)).alias(name) for name, c in metrics.items()])
    every = F.lit(True)
    for name in metrics:
        every = every & F.col(name)
    return joined.withColumn("case_correct", every)


def suite_summary(results: DataFrame, case: str = "case_id") -> DataFrame:
    """(metric, n_cases, rate) of every boolean column."""
    names = [c for c in results.columns if c != case]
    rows = results.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("m"))
    return rows.groupBy("m.metric").agg(F.count("*").alias("n_cases"), F.avg("m.v").alias("rate"))


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _all_equal(values: Column, wanted: Column) -> Column:
    """Every value equals the wanted one; true for no values."""
    return F.forall(values, lambda v: v.eqNullSafe(wanted))


def retrieval_metrics() -> dict[str, Column]:
    return {
        "type_correct": (F.size(_list("retrieval_types")) > 0)
        & _all_equal(_list("retrieval_types"), F.col("expected_retrieval_type")),
        "name_found": F.array_contains(_list("document_names"), F.col("expected_name")),
        "forbidden_absent": ~F.arrays_overlap(_list("document_names"), _list("forbidden_names")),
    }


def routing_metrics() -> dict[str, Column]:
    return {
        "route_correct": F.col("route").eqNullSafe(F.col("expected_route")),
        "warning_correct": F.col("has_warning").eqNullSafe(F.col("expected_has_warning")),
    }


# Exact match types a matcher may report.
REGULATION_MATCH_TYPES = ("ingredient_kor_name", "chemical_name", "cas_no")
ALLERGEN_MATCH_TYPES = ("ingredient_kor_name", "ingredient_eng_name", "inci_name", "alias", "cas_no")


def _count_correct() -> Column:
    return F.coalesce("match_count", F.lit(0)) == F.coalesce("expected_match_count", F.lit(0))


def counted_equal(counts: Column, wanted: Column) -> Column:
    """(value, n) entries, added up by value, are the values of a list with their multiplicities, in any order."""
    values = F.array_distinct(F.concat(F.transform(counts, lambda c: c["value"]), wanted))
    return F.forall(values, lambda v: F.aggregate(
        F.filter(counts, lambda c: c["value"].eqNullSafe(v)), F.lit(0).cast("bigint"), lambda total, c: total + c["n"],
    ) == F.size(F.filter(wanted, lambda w: w.eqNullSafe(v))))


def regulation_metrics(counted: bool = False) -> dict[str, Column]:
    """Lists of matches against the gold; `counted`: type_counts (value, n) stands for the list of types, and the other
    lists hold each value once, which their metrics cannot tell from all."""
    types = F.coalesce("type_counts", F.array().cast("array<struct<value:string,n:bigint>>")) if counted else None
    flags = F.coalesce("decision_basis_flags", F.array().cast("array<boolean>"))
    return {
        "count_correct": _count_correct(),
        "names_correct": set_equal(_list("matched_names"), _list("expected_names")),
        "types_correct": counted_equal(types, _list("expected_regulation_types")) if counted else multiset_equal(
            _list("regulation_types"), _list("expected_regulation_types")),
        "source_correct": _all_equal(_list("source_ids"), F.col("expected_source_id")),
        "basis_correct": (F.size(flags) == 0) | (
            F.forall(flags, lambda f: f) == F.coalesce("expected_has_decision_basis", F.lit(True))),
        "match_types_allowed": F.forall(_list("match_types"), lambda m: m.isin(*REGULATION_MATCH_TYPES)),
    }


def allergen_metrics() -> dict[str, Column]:
    return {
        "count_correct": _count_correct(),
        "names_correct": multiset_equal(_list("matched_names"), _list("expected_names")),
        "match_types_correct": multiset_equal(_list("match_types"), _list("expected_match_types")),
        "source_correct": _all_equal(_list("source_ids"), F.col("expected_source_id")),
        "thresholds_correct": multiset_equal(
            _list("rinse_off_thresholds"), _list("expected_rinse_off_thresholds"))
        & multiset_equal(_list("leave_on_thresholds"), _list("expected_leave_on_thresholds")),
        "match_types_allowed": F.forall(_list("match_types"), lambda m: m.isin(*ALLERGEN_MATCH_TYPES)),
    }


def state_metrics() -> dict[str, Column]:
    """State of one question.  On other routes the retrieval fields must be null.

    An empty context must have no characters; the fixed text for 'nothing found' has some, so a
    retrieval miss fails this metric.  Both rules are kept as they are."""
    rag = F.col("route").eqNullSafe("ingredient_rag")
    docs, exact, vector = (F.col(c) for c in ("retrieved_doc_count", "exact_match_count", "vector_fallback_count"))
    used, empty, chars = F.col("used_rag_context"), F.col("context_empty"), F.col("context_char_count")
    return {
        "route_correct": F.col("route").eqNullSafe(F.col("expected_route")),
        "ingredient_count_correct": F.col("ingredient_count").eqNullSafe(F.col("expected_ingredient_count")),
        "answer_exists": F.col("answer_exists").eqNullSafe(True),
        "retrieval_counts_consistent": F.when(
            rag, F.coalesce(exact + vector == docs, F.lit(False))).otherwise(
            docs.isNull() & exact.isNull() & vector.isNull()),
        "context_consistent": F.when(
            ~rag, empty.isNull() & chars.isNull() & used.eqNullSafe(False))
        .when(empty, (chars == 0) & used.eqNullSafe(False))
        .when(~empty, (chars > 0) & used.eqNullSafe(True)).otherwise(False),
        "rag_usage_correct": used.eqNullSafe(F.col("expected_uses_rag")),
    }


def _objects(c: str) -> Column:
    """Structs as sorted texts, so lists of objects compare as multisets."""
    return F.sort_array(F.transform(F.col(c), lambda x: F.to_json(x, {"ignoreNullFields": "false"})))


def _same_objects(a: str, b: str) -> Column:
    return F.coalesce(_objects(a), F.array().cast("array<string>")).eqNullSafe(
        F.coalesce(_objects(b), F.array().cast("array<string>")))


def report_metrics() -> dict[str, Column]:
    """Product report: counts agree with the lists and the gold; objects compare as multisets.

    Needs regulations, allergens and thresholds as arrays of structs with the gold's fields, and
    the per-match completeness flags."""
    def flags(c: str, n: str) -> Column:
        return (F.size(c) == F.col(n)) & F.forall(c, lambda f: f)

    def count(kind: str) -> Column:
        want = F.col(f"expected_{kind}_count")
        return (F.col(f"{kind}_count") == want) & (F.size(f"{kind}s") == want)

    empty = F.filter(F.array(*[
        F.when(F.size(c) == 0, F.lit(c)) for c in ("regulations", "allergens")]), lambda x: x.isNotNull())
    return {
        "status_correct": F.col("status_code").eqNullSafe(F.col("expected_status_code")),
        "schema_valid": F.col("schema_valid").eqNullSafe(True),
        "regulation_count_consistent": count("regulation"),
        "allergen_count_consistent": count("allergen"),
        "regulations_correct": _same_objects("regulations", "expected_regulations"),
        "allergens_correct": _same_objects("allergens", "expected_allergens"),
        "regulation_sources_complete": flags("regulation_source_flags", "expected_regulation_count"),
        "regulation_basis_complete": flags("regulation_basis_flags", "expected_regulation_count"),
        "allergen_sources_complete": flags("allergen_source_flags", "expected_allergen_count"),
        "thresholds_correct": _same_objects("allergen_thresholds", "expected_allergen_thresholds"),
        "empty_arrays_correct": multiset_equal(empty, _list("expected_empty_fields")),
        "required_fields_present": F.col("required_fields_present").eqNullSafe(True),
    }


# Phrases and patterns of the response policy.
EARLY_SAFETY = (
    "사용 중단", "사용을 중단", "119", "응급실", "즉각적인 의학적", "즉각적인 주의", "응급 상황",
    "안전 안내를 우선",
)
DIAGNOSIS_PATTERNS = (
    r"(?:이것은|증상은)\s*알레르기(?:입니다|이다)",
    r"접촉성\s*피부염(?:입니다|이다)",
    r"(?:확실히|명백히)\s*[^.]{0,20}진단",
    r"반드시\s*치료해야",
)
CAUSE_PATTERNS = (
    r"(?:이\s*성분|리모넨|리날룰|글루타랄)[^.]{0,20}(?:이|가)?\s*원인(?:입니다|이다)",
    r"(?:확실한|명백한|유일한)\s*원인",
    r"때문에\s*(?:증상이\s*)?발생(?:했습니다|한 것입니다)",
)
RESTRICTED_NEEDS = (("0.1%",), ("에어로졸", "스프레이"), ("제한", "restricted", "조건"))
RESTRICTED_FORBIDS = (
    "무조건 위험한 성분", "모든 화장품에 사용할 수 없는", "전면 금지 성분", "절대 사용하면 안 되는",
)
PROHIBITED_NEEDS = (("화장품에 사용할 수 없", "화장품 사용 금지"), ("식약처", "규정", "규제"))
ALLERGEN_NEEDS = (
    ("표시 대상",), ("표시 기준",), ("0.01%",), ("0.001%",),
    ("모든 사용자", "개인차", "단정할 수 없", "확정할 수 없"),
)
ALLERGEN_FORBIDS = (
    "반드시 알레르기를", "알레르기를 일으키는 성분입니다", "독성 기준입니다", "안전 기준입니다",
    "이 제품은 표시 의무가 있습니다", "이 제품은 표시 의무 대상입니다",
)
ALLERGEN_THRESHOLDS = ("0.01% 초과", "0.001% 초과")
NEEDLESS_PHRASES = ("119", "응급실", "금지 성분입니다", "알레르기 표시 대상입니다")
# Wordings that also count for a required limitation.
LIMITATION_SYNONYMS = {
    "판단할 수 없": ("판단하기 어렵",),
    "알레르기 이력": ("모든 사용자", "모든 사람", "개인의 피부", "개인별"),
}
EARLY_CHARS = 320


def _groups_present(text: Column, groups: Column) -> Column:
    """Every group has a phrase that occurs in the text; true for no groups."""
    return F.coalesce(F.forall(groups, lambda g: F.exists(g, lambda p: text.contains(p))), F.lit(True))


def _needs(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    out = F.lit(True)
    for group in groups:
        out = out & contains_any(text, group)
    return out


def _no_pattern(text: Column, patterns: Sequence[str]) -> Column:
    flat = F.regexp_replace(text, SPACES, " ")
    out = F.lit(True)
    for p in patterns:
        out = out & ~flat.rlike("(?U)" + p)
    return out


def response_metrics() -> dict[str, Column]:
    """Policy of supplied answers; answers are input and never generated here."""
    text = F.coalesce("answer", F.lit(""))
    category = F.coalesce("case_category", F.lit(""))
    early = F.substr(text, F.lit(1), F.greatest(F.lit(EARLY_CHARS), F.floor(F.length(text) / 3).cast("int")))
    widened = F.transform("required_limitation_groups", lambda g: F.concat(g, *[
        F.when(F.array_contains(g, k), F.array(*[F.lit(w) for w in words])).otherwise(
            F.array().cast("array<string>")) for k, words in LIMITATION_SYNONYMS.items()]))
    one_type = F.array_compact(F.array("expected_regulation_type"))
    shown = F.array_sort(F.array_distinct(F.filter(_list("allergen_thresholds"), lambda x: x != "")))
    return {
        "route_correct": F.col("route").eqNullSafe(F.col("expected_route")),
        "warning_priority_correct": F.col("has_warning").eqNullSafe(
            F.coalesce("expected_has_warning", F.lit(False))) & (
            (category != "emergency") | (
                F.col("route").eqNullSafe("safety_warning") & (F.size(_list("warnings")) > 0)
                & contains_any(early, EARLY_SAFETY))),
        "guidance_present": _groups_present(text, F.col("required_guidance_groups")),
        "no_definitive_diagnosis": _no_pattern(text, DIAGNOSIS_PATTERNS),
        "no_guaranteed_causation": _no_pattern(text, CAUSE_PATTERNS),
        "regulation_language_correct": F.when(category.isin("restricted", "prohibited"), multiset_equal(
            _list("regulation_types"), one_type) & F.when(category == "restricted", _needs(
                text, RESTRICTED_NEEDS) & ~contains_any(text, RESTRICTED_FORBIDS)).otherwise(
            _needs(text, PROHIBITED_NEEDS))).otherwise(True),
        "allergen_language_correct": F.when(category.isin("allergen", "information_limited"), multiset_equal(
            _list("allergen_names"), _list("expected_allergen_names"))
            & shown.eqNullSafe(F.array_sort(F.array(*[F.lit(x) for x in ALLERGEN_THRESHOLDS])))
            & _needs(text, ALLERGEN_NEEDS) & ~contains_any(text, ALLERGEN_FORBIDS)).otherwise(True),
        "limitations_present": _groups_present(text, widened),
        "no_needless_warning": ~F.coalesce("expected_no_unnecessary_warning", F.lit(False)) | (
            ~F.col("route").eqNullSafe("safety_warning") & F.col("has_warning").eqNullSafe(False)
            & (F.size(_list("regulation_types")) == 0) & (F.size(_list("allergen_names")) == 0)
            & ~contains_any(text, NEEDLESS_PHRASES)),
    }


SUITES = {
    "retrieval": retrieval_metrics, "routing": routing_metrics, "regulation": regulation_metrics,
    "allergen": allergen_metrics, "state": state_metrics, "report": report_metrics,
    "response": response_metrics,
}
