"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from balsam.functions.settle import settle
from balsam.sources import readers, writers


def test_jsonl_round_trip_keeps_nulls_and_text(spark, tmp_path):
    df = spark.createDataFrame([("가", None), ("b", "x")], "a string, b string").coalesce(1)
    writers.write_jsonl(df, str(tmp_path / "out"))
    lines = [line for p in (tmp_path / "out").glob("*.json") for line in p.read_text(encoding="utf-8").splitlines()]
    assert '{"a":"가","b":null}' in lines
    back = readers.read_jsonl(spark, str(tmp_path / "out"), df.schema)
    assert {tuple(r) for r in back.collect()} == {("가", None), ("b", "x")}


def test_malformed_lines_stop_the_read_and_are_reported(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"a":"1"}\n\n[1]\n{"a":\n', encoding="utf-8")
    schema = spark.createDataFrame([], "a string").schema
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), schema).collect()
    assert {r.line for r in readers.jsonl_errors(spark, str(path), schema).collect()} == {"[1]", '{"a":'}


def test_manifest_splits_valid_and_rejected(spark, tmp_path):
    path = tmp_path / "m.json"
    entry = {"source": "shop", "external_product_id": "A1", "product_url": "https://www.shop.test/d.do?goodsNo=A1"}
    path.write_text(json.dumps([entry, {**entry, "external_product_id": "B", "label": "x"}]), encoding="utf-8")
    good, bad = readers.read_manifest(
        spark, str(path), sources=["shop"], host="shop.test", path_suffix="/d.do", id_parameter="goodsNo")
    assert [r.external_product_id for r in good.collect()] == ["A1"]
    assert [r.reason for r in bad.collect()] == ["url id differs"]


def test_rule_document(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({
        "dataset_name": "d", "version": "1", "sources": {"S": {"title": "t", "url": "u", "type": "x"}},
        "skin_profiles": [{"profile_id": "oily", "display_name_ko": "o", "helpful_function_groups": ["g"]}],
        "rules": [{"rule_id": "r", "canonical_group": "g", "display_name_ko": "n", "aliases": ["a", "b"]}],
    }), encoding="utf-8")
    sources, profiles, rules = readers.load_rule_dataset(spark, str(path))
    assert sources.count() == 1 and profiles.first().helpful_function_groups == ["g"]
    row = rules.first()
    assert row.aliases == ["a", "b"] and row.caution_for == []


def test_text_corpus_is_numbered_in_file_order(spark, tmp_path):
    docs = spark.range(20).select((F.col("id") * 3).alias("row"), F.concat(F.lit("text "), F.col("id")).alias("content"))
    writers.write_text_corpus(docs, str(tmp_path / "corpus"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "corpus").glob("part-*")))
    assert [int(x.split("]")[0]) for x in text.split("[성분 데이터 ")[1:]] == list(range(1, 21))


def test_publish_replaces_the_collection(spark, tmp_path):
    path = str(tmp_path / "docs")
    writers.publish_documents(spark.range(3), path)
    writers.publish_documents(spark.range(5, 7), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [5, 6]


def test_settle_uses_the_named_folder(spark):
    df = settle(spark.range(4))
    assert df.count() == 4 and "Range" not in df._jdf.queryExecution().toString()


def test_embedded_json_prefers_the_owner(spark):
    script = '{"goodsNo":"9","optionList":[{"optionNumber":"1","optionName":"A","sortSeq":2},{"optionNumber":"2","optionName":"B"}]}'
    loose = '{"optionNumber":"3","optionName":"C"}'
    rows = spark.createDataFrame([(9, 0, script), (9, 1, loose), (8, 0, loose)], "product_id long, script_no int, script string")
    got = {(r.product_id, r.seq, r.option_number) for r in readers.extract_embedded_json(rows).collect()}
    assert got == {(9, 1, "1"), (9, 2, "2"), (8, 1, "3")}
