"""Every registered query: runs on sf0.001, has no nested-loop / cartesian join
in its plan, and matches its DuckDB oracle (row count, names, values)."""

import contextlib
import io
import os

import duckdb
import pytest

import __spark_entry__ as E
from funnelkit.plans.registry import all_queries
from funnelkit.sources.tables import TABLES
from scripts.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
NAMES = sorted(all_queries())
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "profiles" in df.columns


def test_registry_contract():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 70


@pytest.mark.parametrize("name", NAMES)
def test_plan_and_oracle(spark, duck, name):
    q = all_queries()[name]
    df = q.build(spark, SF)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    plan = buf.getvalue()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, plan
    srows = [tuple(r) for r in df.collect()]
    if not q.sql:
        return
    cur = duck.execute(q.sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert rows_of(df.columns, srows) == rows_of(ocols, orows)


def test_reports_take_run_parameters(spark):
    from funnelkit.plans.registry import run
    assert run("working_days", spark, SF, threshold=10 ** 9).first().date_past == 0
    wide = run("funnel_rollup", spark, SF).where("segment = 'Total' AND product = 'Total'").first()
    narrow = run("funnel_rollup", spark, SF, first_day="1995-07-01", last_day="1995-12-31") \
        .where("segment = 'Total' AND product = 'Total'").first()
    assert narrow.profiles <= wide.profiles and narrow.pass_f <= wide.pass_f
    got = run("first_event_per_user", spark, SF, start="2024-01-01", end="2024-02-01", exclude="^$")
    assert got.count() == duckdb.sql(f"SELECT count(DISTINCT user_id) FROM '{SF}/events.parquet'").fetchall()[0][0]


# Report, run arguments, and what they replace in its oracle.
OTHER_RUNS = [
    ("mtd_active_enriched", {"since": "1997-01-01"}, {"1998-06-01": "1997-01-01"}),
    ("rejected_enriched", {"since": "1996-01-01"}, {"1998-01-01": "1996-01-01"}),
    ("rejected_enriched", {"recent": "1997-01-01", "run_date": "2020-07-15", "min_error": 20},
     {"2000-01-01": "1997-01-01", "2024-01-30": "2020-07-15", "value > 98": "value > 20"}),
    ("rest_of_base", {"status_since": "1995-01-01", "since": "1997-01-01"}, {"2001-01-01": "1995-01-01", "2000-01-01": "1997-01-01"}),
    ("rest_of_base", {"min_score": 3000, "pincodes": ("1", "4"), "min_error": 50},
     {"c_acctbal >= 500": "c_acctbal >= 3000", "BETWEEN '500' AND '550'": "BETWEEN '1' AND '4'", "value > 98": "value > 50"}),
    ("ever_product_cohort", {"d0": "1998-01-01", "d1": "1997-01-01", "d2": "1996-01-01", "pincodes": ("1", "2"), "min_price": 90000},
     {"2001-01-01": "1998-01-01", "2000-01-01": "1997-01-01", "1999-01-01": "1996-01-01",
      "BETWEEN '500' AND '550'": "BETWEEN '1' AND '2'", "o_totalprice < 5000": "o_totalprice < 90000"}),
    ("cohort_suppressed", {"d0": "1998-01-01", "d1": "1997-01-01", "d2": "1996-01-01", "pincodes": ("1", "2"), "min_price": 90000,
                           "high_value": 300000},
     {"2001-01-01": "1998-01-01", "2000-01-01": "1997-01-01", "1999-01-01": "1996-01-01",
      "BETWEEN '500' AND '550'": "BETWEEN '1' AND '2'", "o_totalprice < 5000": "o_totalprice < 90000", "> 450000": "> 300000"}),
]


@pytest.mark.parametrize("name,args,changes", OTHER_RUNS)
def test_reports_of_other_runs_equal_their_oracle(spark, duck, name, args, changes):
    q = all_queries()[name]
    sql = q.sql
    for old, new in changes.items():
        assert old in sql
        sql = sql.replace(old, new)
    results = []
    for text in (sql, q.sql):
        cur = duck.execute(text)
        results.append(rows_of([d[0] for d in cur.description], cur.fetchall()))
    df = q.build(spark, SF, **args)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == results[0]
    assert len(results[0]) and results[0] != results[1]


def test_reports_survive_empty_periods(spark):
    from funnelkit.plans.registry import run
    # no chatbot rows and no applications in the period: NULL rates, no errors
    rows_ = run("call_disposition", spark, SF, run_date="2030-01-01").collect()
    chat = [r for r in rows_ if r.campaign_name == "Chatbot"][0]
    assert chat.total_calls == 0 and chat.answered_pct is None
    assert run("pacing", spark, SF, day="2030-06-14", month_start="2030-06-01").count() == 0
