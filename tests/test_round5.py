"""Costly work per row: each text is found once, and rows of one file are dealt to many tasks."""

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"


def test_card_fields_are_found_once_and_by_many_tasks(spark):
    df = contract.queries()["extract_card_fields"](spark, SF_DIR)
    text = df._jdf.queryExecution().executedPlan().toString()
    # The plan names the pattern of a field as often as a row is searched for it.
    for mark in ("tx_name", "tx_brand", "tx_org", "tx_cur"):
        assert text.count(f"{mark}(?:") == 1
    assert "RoundRobinPartitioning" in text


def test_sections_of_formulas_are_built_once(spark):
    df = contract.queries()["evaluate_formulas"](spark, SF_DIR)
    # Sections and boundaries are read again where they are used, not built again from the parts.
    assert "p_partkey" not in df._jdf.queryExecution().executedPlan().toString()


def test_effective_options_choose_a_parser_once(spark):
    df = contract.queries()["effective_options"](spark, SF_DIR)
    assert "l_orderkey" not in df._jdf.queryExecution().executedPlan().toString()


def test_python_workers_hold_few_rows_and_the_cluster_keeps_its_setting(spark):
    from balsam.plans import session

    before = session.prepare(spark).conf.get(session.BATCH)
    session.prepare_tables(spark)
    assert int(spark.conf.get(session.BATCH)) <= 1000
    session.prepare_tables(spark)
    session.prepare(spark)
    assert spark.conf.get(session.BATCH) == before
