"""Normalisation traps that DuckDB cannot state: Unicode space, NFKC, case folding."""

import pytest
from pyspark.sql import functions as F

from balsam.functions import keys, text
from balsam.operators.normalise import add_keys, key_collisions


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first()["y"]


@pytest.mark.parametrize("policy, value, want", [
    ("clean_text", " a 　b\n\tc ", "a b c"),
    ("clean_text", None, ""),
    ("retrieval_key", "Poly-Ethylene / (Glycol), A·B", "polyethyleneglycolab"),
    ("registry_key", "Ｐoly–Eth. A/B (x)", "ｐoly-ethab(x)"),
    ("item_key", " 부틸렌　글라이콜 ", "부틸렌글라이콜"),
    ("product_name_key", "[기획] [1+1] Ｃream  STRASSE ß", "cream strasse ss"),
    ("product_name_key", " [only] ", "[only]"),
    ("product_name_key", "Cream [not leading]", "cream [not leading]"),
    ("rule_key", "황색５호 (CI 15985)", "황색5호"),
    ("dictionary_key", "ＡＢ c", "abc"),
    ("option_label_key", "[０１] Ａ-b·c", "01abc"),
    ("option_mapping_key", "[기 획] 012호 로즈 본품+리필", "012로즈"),
    ("option_mapping_key", "[로즈] 012호", "로즈012"),
    ("option_mapping_key", "단품 / new 17N", "17n"),
    ("shade_code_key", "007N", "7n"),
    ("shade_code_key", "n007", "n7"),
    ("header_label_key", "★ [００3호 로즈] :", "3 로즈"),
    ("full_label_key", " 01 로즈·ß ", "01로즈·ss"),
    ("option_display_name", "[기획] 01_로즈", "01 로즈"),
    ("search_intent_query", "“수분크림” 성분을 분석해줘?", "수분크림"),
])
def test_policy(spark, policy, value, want):
    assert one(spark, value, keys.POLICIES[policy]) == want


def test_rule_match_keys(spark):
    got = one(spark, "마이카（a(b)c） CI 77019", keys.rule_match_keys)
    assert "ci77019" in got and len(got) == len(set(got))


def test_split_cas_needs_word_boundaries(spark):
    assert one(spark, "16807-48-0 / 520-45-6, 가100-51-6", keys.split_cas) == ["16807-48-0", "520-45-6"]
    assert one(spark, "-", keys.split_cas) == []


@pytest.mark.parametrize("raw, want", [
    ("정제수, 글리세린", ["정제수", "글리세린"]),
    ("1,2-헥산다이올, 물", ["1,2-헥산다이올", "물"]),
    ("a(b, c[d, e]), f", ["a(b, c[d, e])", "f"]),
    ("a), b, c(d, e", ["a)", "b", "c(d, e"]),
    ("코코/카프릴, , ", ["코코/카프릴"]),
    ("(1,2), 3,4", ["(1,2)", "3,4"]),
    ("", []),
])
def test_split_ingredients(spark, raw, want):
    assert one(spark, raw, text.split_ingredients) == want


def test_section_ingredients_keep_first_spelling(spark):
    assert one(spark, ": Water,\n water , Gly\ncerin -", text.section_ingredients) == ["Water", "Glycerin"]


def test_flags_and_prices(spark):
    row = spark.createDataFrame([(" Y", "1,200원", "n/a")], "a string, b string, c string").select(
        keys.coerce_flag("a"), keys.parse_price("b"), keys.parse_price("c")).first()
    assert tuple(row) == (True, 1200, None)


def test_key_collisions_are_long_and_counted(spark):
    df = spark.createDataFrame([("A b",), ("ab",), ("ab",), ("c",)], "n string")
    got = {tuple(r) for r in key_collisions(df, "n", "item_key").collect()}
    assert got == {("ab", "A b", 1, 2), ("ab", "ab", 2, 2)}
    assert add_keys(df, {"k": ("n", "item_key")}).filter(F.col("k") == "ab").count() == 3
