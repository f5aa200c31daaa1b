"""Every registered query against its SQL twin on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
# the training-data queries have tests of their own
QUERIES = {n: f for n, f in entry.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}
SQL = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    # what SQL cannot state: iterative solves, fitted models, the greedy search, the whole feature table
    assert set(QUERIES) - set(SQL) == {
        "ease_score", "ease_variants", "fm_scores", "oof_scores", "gbt_scores", "feature_importance", "early_stop",
        "saved_model_scores", "lambdarank_scores", "xendcg_scores", "greedy_blend", "feature_table", "fm_oof_scores", "feature_variants",
    }


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def single_partition_windows(plan):
    """Window nodes of a printed plan that are fed by an exchange into one partition."""
    lines = [re.sub(r"^[\s:+|-]*(\*\(\d+\) )?", "", x) for x in plan.splitlines()]
    lines = [x for x in lines if x and not re.match(r"(Sort|Project|Filter|InputAdapter|WholeStageCodegen|ShuffleQueryStage|AQEShuffleRead)\b", x)]
    return [a for a, b in zip(lines, lines[1:]) if re.match(r"Window\b", a) and "SinglePartition" in b]


# queries whose windows run over aggregated rows: a series, the values of one split or its items, which ``by_weight``
# cuts beyond ``rows_per_task``
SMALL_WINDOWS = {"running_best", "convergence", "stale_counter", "quantile_bucket", "user_cross", "ease_residual", "ease_score", "ease_variants"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SMALL_WINDOWS - {"lambdarank_scores", "xendcg_scores", "gbt_scores", "oof_scores", "fm_scores", "fm_oof_scores", "feature_variants", "early_stop", "feature_importance", "saved_model_scores", "greedy_blend"}))
def test_no_unpartitioned_window(spark, name):
    assert not single_partition_windows(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())


def test_the_window_check_finds_one(spark):
    df = spark.range(5).selectExpr("id", "row_number() OVER (ORDER BY id) AS n")
    assert single_partition_windows(df._jdf.queryExecution().executedPlan().toString())


def test_split_filter_reaches_the_scan(spark):
    plan = QUERIES["split_selection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan
    assert "value" not in scan.split("ReadSchema")[1]


def test_split_filter_reaches_the_order_scan(spark):
    plan = QUERIES["protocol_orders"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "o_orderdate" in line]
    assert scans and all("GreaterThanOrEqual(o_orderdate" in line and "LessThan(o_orderdate" in line for line in scans)
