"""Product categories, analysis eligibility and the actions that follow from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, contains_any, strip

# Words in a shop's category path, checked first, in this order.
PATH_WORDS = {
    "color_makeup": ("메이크업", "베이스메이크업", "베이스 메이크업", "아이메이크업", "아이 메이크업",
                     "립메이크업", "립 메이크업", "색조"),
    "skincare": ("스킨케어", "선케어", "선 케어", "클렌징", "마스크팩", "마스크 팩"),
    "other": ("헤어케어", "헤어 케어", "바디케어", "바디 케어", "향수", "건강식품", "구강용품"),
}
# A colour word together with a lip word is colour make-up.
COLOR_WORDS = ("컬러", "틴티드", "틴티드 컬러")
LIP_WORDS = ("립", "입술")
# Words in a product name, checked in this order.
NAME_WORDS = {
    "color_makeup": (
        "쿠션", "파운데이션", "비비크림", "비비 크림", "씨씨크림", "씨씨 크림", "컨실러", "프라이머",
        "메이크업 베이스", "톤업 베이스", "블러셔", "치크", "하이라이터", "브론저", "쉐딩", "아이섀도",
        "아이 섀도", "섀도우", "마스카라", "아이라이너", "아이 라이너", "아이브로우", "아이 브로우",
        "브로우", "립스틱", "립틴트", "립 틴트", "틴트", "립글로스", "립 글로스", "립라이너", "립 라이너",
        "립펜슬", "립 펜슬", "컬러 립밤",
    ),
    "skincare": (
        "스킨", "토너", "에센스", "세럼", "앰플", "로션", "에멀전", "크림", "수분크림", "아이크림",
        "아이 크림", "미스트", "오일", "마스크팩", "마스크 팩", "시트마스크", "시트 마스크", "패드",
        "토너패드", "토너 패드", "선크림", "선 크림", "선로션", "선 로션", "선스틱", "선 스틱", "선세럼",
        "선 세럼", "자외선차단제", "자외선 차단제", "클렌저", "클렌징폼", "클렌징 폼", "클렌징오일",
        "클렌징 오일", "클렌징밤", "클렌징 밤", "클렌징워터", "클렌징 워터", "필링", "스크럽",
    ),
    "other": (
        "샴푸", "린스", "트리트먼트", "헤어팩", "헤어 팩", "헤어스프레이", "헤어 스프레이", "바디워시",
        "바디 워시", "바디로션", "바디 로션", "핸드크림", "핸드 크림", "향수", "퍼퓸", "칫솔", "치약",
        "영양제", "유산균", "비타민",
    ),
}


def product_category(
    name: str, path: str, path_words: Mapping[str, Sequence[str]] = PATH_WORDS,
    name_words: Mapping[str, Sequence[str]] = NAME_WORDS, color_words: Sequence[str] = COLOR_WORDS,
    lip_words: Sequence[str] = LIP_WORDS,
) -> Column:
    """Category by path words, then colour and lip words, then name words, else 'unknown'."""
    shown = F.lower(F.coalesce(collapse(name), F.lit("")))
    where = F.lower(F.coalesce(collapse(path), F.lit("")))
    cases = [(contains_any(where, [w.lower() for w in words]), c) for c, words in path_words.items()]
    cases.append((contains_any(shown, color_words) & contains_any(shown, lip_words), "color_makeup"))
    cases += [(contains_any(shown, [w.lower() for w in words]), c) for c, words in name_words.items()]
    out = F.when(cases[0][0], cases[0][1])
    for condition, category in cases[1:]:
        out = out.when(condition, category)
    return out.otherwise("unknown")


def classify_products(products: DataFrame, **words) -> DataFrame:
    return products.withColumn("category", product_category("product_name", "category_path", **words))


def fill_category(products: DataFrame, **words) -> DataFrame:
    """Classify only the products whose category is 'unknown'."""
    return products.withColumn("category", F.when(
        F.col("category") == "unknown", product_category("product_name", "category_path", **words)
    ).otherwise(F.col("category")))


# What to do with a product of each category.
NEXT_ACTIONS = {"skincare": "extract_ingredients", "color_makeup": "select_product_option"}
OTHER_ACTION = "manual_review"


def next_action(category: str = "category", other: str = OTHER_ACTION) -> Column:
    out = F.lit(other)
    for name, action in NEXT_ACTIONS.items():
        out = F.when(F.col(category) == name, action).otherwise(out)
    return out


def analysis_eligible(products: DataFrame, source: str, host: str) -> DataFrame:
    """Add `can_analyze` and the first reason against it: source, url present, http(s) on the
    shop's host or one below it."""
    url = strip(F.coalesce("product_url", F.lit("")))
    name = F.lower(F.try_parse_url(url, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    reason = (
        F.when(~F.col("source").eqNullSafe(source), "source not supported")
        .when(url == "", "no product url")
        .when(name.isNull() | scheme.isNull(), "malformed url")
        .when(~(scheme.isin("http", "https") & ((name == host) | name.endswith("." + host))), "host not allowed")
    )
    return products.withColumn("reason", reason).withColumn("can_analyze", F.col("reason").isNull())


def public_option_status(preparations: DataFrame) -> DataFrame:
    """Public status and next action of a preparation (can_analyze, status, collection_status, category)."""
    can = F.coalesce("can_analyze", F.lit(False))
    return preparations.withColumns({
        "public_status": F.when(~can, "unavailable").when(
            F.col("collection_status") == "partial", "partial").otherwise(F.col("status")),
        "next_action": F.when(~can, "product_data_unavailable").otherwise(next_action()),
    })
