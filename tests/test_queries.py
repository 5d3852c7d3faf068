"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from spanwright.plans import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A window without a key may only see one row per chunk.
    for keys in re.findall(r"Window \[.*?\], \[(.*?)\]", plan):
        assert keys or "__chunk" in plan
    assert name in SQL, "a query needs its SQL"
    assert compare(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", ["l3_scope_texts", "l8_directory_logs", "l9_log_entries", "a21_move_plan", "o1_records",
                                  "o1_strict_records", "l1_owners", "p9_mail_matches"])
def test_tables_are_not_read_again_and_again(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 if name[0] in "lp" else plan.count("FileScan") <= 2


def test_entry(spark):
    assert entry.entry(spark).count() > 0


ORDERED = ["l6_likewise", "l7_entry_lines", "l8_directory_logs", "l9_log_entries", "o1_records", "o1_strict_records",
           "p3_sections", "p4_diff_lines", "p6_drop_repeats", "p8_owner_headers", "a21_move_plan", "scope_report"]


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_queries_do_not_depend_on_the_chunks(spark, con, monkeypatch, name):
    from spanwright.operators import ordered
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 5)
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


JOINED = ["m4_dictionary_counts", "m4_dictionary_places", "m5_guards", "c6_fixed_scopes", "l1_owners", "p10_approvals",
          "a4_exempt", "a4_listed", "a6_classify", "a12_chained_lookup", "a14_ancestors", "a15_descendants",
          "a16_castable", "a20_repeated", "a21_unclassified", "s8_rule_usage"]


@pytest.mark.parametrize("name", JOINED)
def test_lookups_too_big_to_broadcast_give_the_same(spark, con, monkeypatch, name):
    from spanwright.operators import sizing
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(sizing, "SAMPLE_FRACTION", 1.0)
    monkeypatch.setattr(sizing, "SALTS", 7)
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None
