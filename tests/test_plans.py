"""Plans stay as they were meant: no products of tables, pruned scans, few exchanges."""

import re

import pytest

from tessera.queries import queries

SF = "/root/testdata/sf0.001"
# Joins with a single row or a short list of keys, which Spark runs as nested loops over a broadcast row.
ONE_ROW = {"activity_by_quarter_yoy", "window_filtered_counts", "events_daily_calendar", "top_entities_then_points", "unresolved_names_ranked", "source_status"}
EXCHANGES = {"activity_by_quarter_yoy": 3, "monthly_flagged_zero_filled": 3, "near_date_chain_islands": 1, "reported_vs_documented": 4, "composition_report": 5, "label_agreement": 3, "first_wins_dedupe": 1, "explore_organisation": 2}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_products_of_tables(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert name in ONE_ROW or "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(EXCHANGES))
def test_exchanges(spark, name):
    text = plan(queries()[name](spark, SF))
    assert len(re.findall(r"(?<!Broadcast)Exchange ", text)) <= EXCHANGES[name]


def test_scans_read_what_they_need(spark):
    text = plan(queries()["activity_by_quarter_yoy"](spark, SF))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) <= {"o_custkey:bigint,o_orderdate:timestamp_ntz", "o_orderdate:timestamp_ntz", "o_custkey:bigint,o_orderdate:timestamp"}
    text = plan(queries()["catalog_semi_collect"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text and "LessThanOrEqual(p_size,5)" in text
