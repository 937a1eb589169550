"""Both option parsers on small documents."""

from balsam.operators import hierarchy, options, segmentation

OPTIONS = "doc_id long, option_pos int, raw_option_name string, source_option_id string"


def parse(spark, text, names):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    opts = spark.createDataFrame([(1, i, n, None) for i, n in enumerate(names)], OPTIONS)
    return docs, opts


def statuses(df):
    return [r.mapping_status for r in df.orderBy("option_pos").collect()]


def test_first_parser_statuses(spark):
    docs, opts = parse(
        spark, "[01 로즈] 물, 오일 [02 피치] 물, 향료 [02 피치] 물, 왁스 [99 없음] 물, 염료 [03 베리) 물, 산 [04 민트] 물",
        ["01호 로즈", "02 피치", "03 베리", "04 민트", "05 라임"])
    out = segmentation.parse_option_sections(docs, opts)
    assert statuses(out["mappings"]) == ["matched", "ambiguous", "unmatched", "unsupported", "unmatched"]
    methods = [r.mapping_method for r in out["mappings"].orderBy("option_pos").collect()]
    assert methods[2] == "malformed_explicit_header" and methods[4] == "unmatched_sale_option"
    assert [r.status for r in out["headers"].orderBy("start").collect()] == [
        "matched", "ambiguous", "ambiguous", "orphan", "malformed", "matched"]


def test_blank_text_is_unsupported(spark):
    docs, opts = parse(spark, "  ", ["01 로즈"])
    row = segmentation.parse_option_sections(docs, opts)["mappings"].first()
    assert (row.mapping_status, row.mapping_method) == ("unsupported", "raw_text_empty")


def test_canonical_options_merge_and_keep_order(spark):
    _docs, opts = parse(spark, "x", ["[기획] 01 로즈", "01 로즈", "[단독] 01호 로즈 기획", "02 피치", "[기획]", "[단품]"])
    rows = segmentation.canonicalize_options(opts).orderBy("option_pos").collect()
    assert [r.option_pos for r in rows] == [0, 3, 4, 5]
    assert rows[0].source_names == ["[기획] 01 로즈", "01 로즈", "[단독] 01호 로즈 기획"]
    assert len({r.option_key for r in rows}) == 4


def test_overlapping_unmarked_names_are_ambiguous(spark):
    docs, opts = parse(spark, "A12 red\n물, 오일\nB7 blue sky\n물, 왁스", ["A12 red", "B7 blue sky", "B7 blue", "C9 x"])
    canonical = segmentation.canonicalize_options(opts)
    assert statuses(segmentation.located_sections(docs, canonical)) == [
        "matched", "ambiguous", "ambiguous", "unmatched"]


def test_second_parser_sections_and_mapping(spark):
    docs, opts = parse(
        spark, "[01 로즈] 물, 오일 [02 피치] 물, 물, 향료 {03 베리] 산, 왁스 [note x]", ["1호 로즈", "02 피치", "3 베리", "04 민트"])
    none = spark.createDataFrame([("없는성분",)], "key string")
    out = hierarchy.parse_sections_exact(docs, opts, none)
    sections = out["sections"].orderBy("section_no").collect()
    assert [s.raw_header for s in sections] == ["[01 로즈]", "[02 피치]", "{03 베리]"]
    assert sections[1].ingredients == ["물", "향료"]
    assert (sections[2].ingredients, sections[2].annotation) == (["산", "왁스"], "[note x]")
    assert statuses(out["mappings"]) == ["matched", "matched", "matched", "unmatched"]


def test_formula_without_unique_split_asks_for_review(spark):
    docs, opts = parse(spark, "[A] w1, w2, w3, w4 Tone w1 x w2, w3 Shade w1, w2", ["A"])
    known = spark.createDataFrame([(f"w{i}",) for i in range(1, 5)], "key string")
    row = hierarchy.parse_sections_exact(docs, opts, known)["formats"].first()
    assert (row.document_format, row.structure_reason) == ("needs_review", "string_formula_boundary_ambiguous")


def test_selection_reports_the_first_failing_option(spark):
    schema = "product_id long, position int, option_id string, status string, ingredients array<string>"
    p = spark.createDataFrame([(1, 0, "a", "ready", ["x", "y"]), (1, 1, "b", "ready", ["z"]), (2, 0, "a", "empty", [])], schema)
    c = spark.createDataFrame([(1, 0, "a", "ready", ["y", "x"]), (2, 0, "a", "ready", ["x"])], schema)
    got = {r.product_id: (r.selected, r.reason) for r in options.select_safe_result(p, c).collect()}
    assert got[1] == ("production", "production_ready_option_ingredients_changed_in_candidate")
    assert got[2][0] == "candidate"
