"""Trimming, first occurrences and chunk headers on odd texts."""

from pyspark.sql import functions as F

from balsam.functions import text
from balsam.operators import hierarchy

ODD = ["", " ", "a", " a b ", "\n a b\x85", "\x1c　x\U0001f600  \r\n", "​ a", "\t ", None]


def test_strip_and_blank_on_odd_white_space(spark):
    got = spark.createDataFrame([(i, v) for i, v in enumerate(ODD)], "i int, v string").select(
        "i", text.strip("v").alias("s"), text.is_blank("v").alias("b")).orderBy("i").collect()
    assert [r.s for r in got] == [None if v is None else v.strip() for v in ODD]
    assert [r.b for r in got] == [v is None or not v.strip() for v in ODD]


def test_first_occurrences_keep_the_first_spelling_in_order(spark):
    rows = [(["b", "A", "a", "B", "c"],), (["Straße", "STRASSE", "x"],), ([],), (["ΟΔΟΣ", "οδος", "οδοσ"],), (["a", "b"],), (None,)]
    got = spark.createDataFrame(rows, "a array<string>").select(text.first_occurrences(F.col("a"), text.casefolded).alias("a")).collect()
    assert [r.a for r in got] == [["b", "A", "c"], ["Straße", "x"], [], ["ΟΔΟΣ"], ["a", "b"], None]


def test_chunk_headers_compile_no_pattern_per_row(spark):
    texts = ["plain", "[one] two [three]", "a\nb★ c : d", "x#A1 y #B2 z", "😀 {bad] tail", ""]
    rows = hierarchy.with_chunk_headers(hierarchy.comma_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")))
    assert "split(trimmed" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.before, r.header, r.after, r.h_start) for r in rows.collect()}
    assert got == {0: ("plain", "", "", 5), 1: ("", "[one]", " two [three]", 0), 2: ("a\nb", "★ c :", " d", 3),
                   3: ("x#A1 y ", "#B2", " z", 7), 4: ("😀 ", "{bad]", " tail", 2), 5: ("", "", "", 0)}


def test_places_of_related_products_stay_one_row(spark):
    import re

    import __spark_entry__ as contract

    df = contract.queries()["related_products"](spark, "/root/testdata/sf0.001")
    # Spellings meet a place as arrays: no rows of a place are dealt again by its columns.
    assert not re.search(r"hashpartitioning\(request_id#\d+L?, rank#", df._jdf.queryExecution().executedPlan().toString())
