"""What the plans must look like to hold on large tables."""

import re

import pytest

from txnwatch.plans.queries import all_queries

QUERIES = all_queries()
BATCH = sorted(q for q in QUERIES if not q.startswith("stream_"))
# the only Python in a task is the text model
WITH_PYTHON = {
    "generate_text", "recent_recommendations", "null_audit",
    "feature_ideation", "recent_ideas", "graph_inference",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cartesian_product_and_no_row_wise_python(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan
    if name != "grounded_prompt":  # joins two one-row aggregates
        assert "BroadcastNestedLoopJoin" not in plan
    if name not in WITH_PYTHON:
        assert not re.search("Python|Pandas|ArrowEval", plan)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("baseline_14d", "struct<ts:timestamp_ntz,user_id:bigint,value:double>"),
        ("intraday_totals", "struct<ts:timestamp_ntz,user_id:bigint,value:double>"),
        ("smurfing_sinks", "struct<event_id:bigint,user_id:bigint,value:double,props:string>"),
    ],
)
def test_scans_read_only_the_columns_they_need(spark, small, name, columns):
    assert f"ReadSchema: {columns}" in plan_of(QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["baseline_14d", "user_features_1h", "category_summary", "latest_per_table"])
def test_time_filters_reach_the_scan(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", plan)


@pytest.mark.parametrize(
    ("name", "scans"),
    [
        ("sliding_features_60m", 1),
        ("score_transactions", 2),
        ("rolling_1h_all", 3),
        ("layering_paths", 4),
        ("layering_top", 5),
        ("graph_verdict", 17),
        ("circular_transfers", 9),
        ("column_profile", 1),
    ],
)
def test_number_of_scans(spark, small, name, scans):
    df = QUERIES[name](spark, small)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= scans


@pytest.mark.parametrize("name", ["sliding_features_60m", "rolling_1h_all"])
def test_marks_are_made_by_generated_code(spark, small, name):
    assert "lambdafunction" not in plan_of(QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["graph_verdict", "graph_inference"])
def test_findings_parse_the_events_once(spark, small, name):
    assert "get_json_object" not in plan_of(QUERIES[name](spark, small))
