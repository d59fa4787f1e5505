"""What the plans of registered queries read, and report parameters."""

import re

import pytest

from funnelkit.plans.registry import all_queries, run

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,most", [("lead_journey", 12), ("application_lookups", 8), ("asof_previous_click", 4), ("previous_click_value", 4),
                                       ("lookback_48h_first", 4), ("nested_lookup", 6), ("subset_complement", 1),
                                       ("prior_state", 1), ("cohort_suppressed", 6), ("cohort_conversion_matrix", 4),
                                       ("call_mis_combined", 4)])
def test_planned_scans(spark, name, most):
    plan = _plan(all_queries()[name].build(spark, SF))
    assert len(re.findall("FileScan|Scan parquet", plan)) <= most
    if name == "cohort_suppressed":
        assert plan.count("SinglePartition") <= 2


def test_rollup_copies_cells_not_rows(spark):
    """What the product interest funnel expands is its cells, counted before."""
    plan = all_queries()["product_interest_funnel"].build(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    below = [lines[i + 1] for i, x in enumerate(lines) if "Expand [" in x]
    assert below and all("Aggregate [" in x for x in below), below


def test_referrals_take_an_owner_list_and_an_end(spark):
    def moved(**kw):
        return run("rollup_null_label", spark, SF, **kw).agg({"moved": "max"}).first()[0]
    every = moved()
    assert 0 < moved(owners=["BUILDING"]) < every and 0 < moved(end="1999-01-01") < every
    assert run("rollup_null_label", spark, SF, owners=[]).count() == 0


def test_a_registered_query_takes_the_split_path(spark):
    from funnelkit.operators.lookup import hot_keys_for
    ev = spark.read.parquet(f"{SF}/events.parquet")
    assert len(hot_keys_for(ev, "user_id", "ts", share=2000).rows) > 10
    assert "__cuts" in all_queries()["previous_click_cut_finely"].build(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name,params", [
    ("fresh_profiles_effort", {"first_day": "2024-01-03", "last_day": "2024-01-03"}),
    ("sms_promise_not_subscribed", {"start": "1997-01-01", "end": "1997-02-01"}),
    ("interest_not_subscribed", {"start": "1996-01-01", "end": "1996-06-01", "run_date": "1997-01-01"}),
    ("stage_070_leads", {"start": "1998-01-01", "end": "1998-02-01"}),
    ("approved_attribution", {"start": "1998-01-01", "end": "1998-02-01"}),
    ("regenerated_leads", {"start": "1998-01-01", "end": "1998-02-01"}),
    ("applications_extract", {"start": "1997-01-01", "end": "1997-02-01"}),
    ("application_lookups", {"start": "1997-01-01", "end": "1997-02-01"}),
    ("product_interest_funnel", {"start": "1998-01-01", "end": "1998-02-01"}),
    ("missed_promise", {"start": "1998-01-01", "end": "1998-02-01"}),
    ("rollup_null_label", {"start": "2001-01-01"}),
    ("payment_holdings", {"start": "2024-01-01", "end": "2024-01-05"}),
    ("lead_answers", {"first_day": "1998-01-01", "last_day": "1998-01-31"})])
def test_reports_take_their_dates(spark, name, params):
    default, other = run(name, spark, SF), run(name, spark, SF, **params)
    assert other.columns == default.columns
    assert sorted(map(repr, other.collect())) != sorted(map(repr, default.collect()))


def test_owner_lists_are_optional(spark):
    every = run("stage_070_leads", spark, SF, owners=None).count()
    some = run("stage_070_leads", spark, SF, owners=["System"]).count()
    assert 0 < some < every and run("stage_070_leads", spark, SF, owners=[]).count() == 0
    assert run("payments_owner_list", spark, SF).count() < run("payments_owner_list", spark, SF, owners=None).count()
    assert run("attribution_cascade", spark, SF, services=["S0"]).count() == run("payments_single_service", spark, SF).count()
    assert run("points_score", spark, SF, owners=["supp-1"]).count() < run("points_score", spark, SF).count()
