"""Rules that hold since the second round: linear chunking, case folds, k above eight, error pages, repeated records."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from balsam.functions import settle as settling
from balsam.functions import text
from balsam.operators import hierarchy, retrieval
from balsam.sources import readers, writers


def test_chunking_grows_with_the_text(spark):
    def seconds(n):
        long = ",".join(f"item {i} (a, b)" if i % 3 else f"item {i}" for i in range(n))
        docs = spark.createDataFrame([(1, long)], "doc_id bigint, text string")
        start = time.perf_counter()
        rows = hierarchy.comma_chunks(docs).agg(F.count("*"), F.max("end")).first()
        assert tuple(rows) == (n, len(long))
        return time.perf_counter() - start

    seconds(100)
    short = seconds(10_000)
    assert seconds(40_000) < 8 * short + 4


def test_duplicates_by_full_case_fold(spark):
    row = spark.createDataFrame([("ΟΔΟΣ, οδος, οδοσ, ﬁx, fix, STRASSE, Straße, ı, i",)], "t string")
    assert row.select(text.section_ingredients("t")).first()[0] == ["ΟΔΟΣ", "ﬁx", "STRASSE", "ı", "i"]


def test_first_occurrences_keep_order(spark):
    row = spark.createDataFrame([(["b", "A", "a", "c", "B", "b"],)], "a array<string>")
    assert row.select(text.first_occurrences(F.col("a"), F.lower)).first()[0] == ["b", "A", "c"]


def test_search_k_above_eight(spark):
    fields = {c: F.lit("") for c in ("ingredient_kor_name", "ingredient_eng_name", "cas_no", "synonym", "origin_description", "content")}
    vector = F.array(F.lit(1.0), F.col("row") / 1000)
    docs = spark.range(40).withColumnRenamed("id", "row").withColumns({
        **fields, "ingredient_kor_name": F.concat(F.lit("name "), "row"), "vector": vector})
    asked = spark.createDataFrame([(1, 0, "something else", [1.0, 0.0], 10), (2, 0, "something else", [1.0, 0.0], 3)],
                                  "request_id bigint, position int, query string, vector array<double>, search_k int")
    found = retrieval.retrieve_for_ingredients(asked, docs, 0.1, limit=50)
    assert {r["request_id"]: r["count"] for r in found.groupBy("request_id").count().collect()} == {1: 10, 2: 3}


_OK = "<response><header><resultCode>00</resultCode></header><body><items><item><INGR_KOR_NAME>a</INGR_KOR_NAME></item></items></body></response>"


def test_error_pages_stop_the_job(spark):
    pages = spark.createDataFrame([(1, _OK), (2, _OK.replace("00", "99"))], "page_no int, payload string")
    with pytest.raises(Exception, match="page 2 reports 99"):
        readers.parse_xml_pages(pages).collect()
    assert readers.parse_xml_pages(pages, on_error="skip").count() == 1
    assert readers.xml_errors(pages).count() == 1


def test_all_html_entities(spark):
    row = spark.createDataFrame([("<b>A&amp;B &eacute;&#44033;&#xe9;&nbsp; x</b>",), ("plain",), (None,)], "h string")
    assert [r[0] for r in row.select(readers.html_text("h")).collect()] == ["A&B é각é x", "plain", None]


def test_the_last_of_repeated_records_stays(spark):
    accepted = spark.createDataFrame([(1, "", 1, ["a", "b"]), (1, "", 2, ["c"])], "product_id bigint, option_id string, seq int, ingredients array<string>")
    items = writers.exploded_items(accepted.limit(0))
    got = writers.replace_items(items, accepted, order="seq").collect()
    assert [r.ingredient_name for r in got] == ["c"]


def test_settle_wants_a_shared_folder_on_clusters(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        settling.checkpoint_dir(Session())
