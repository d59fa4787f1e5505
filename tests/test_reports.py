"""Report composites on hand-built edge tables (FIXTURES section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from funnelkit.functions.expr import imatch, upper_strings
from funnelkit.plans.reports import attribution_owner, conversion_matrix, pacing, stage_funnel
from tests.conftest import rows


def ts(day, minute=0):
    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minute)


def test_stage_funnel_edge_log(spark):
    profiles = spark.createDataFrame([(1, "Green"), (2, "Green"), (3, "Red"), (4, "Red")], "u long, seg string")
    log = [(1, ts(1), "PL-021", None), (1, ts(2), "PL-03", "System"), (1, ts(3), "PL-88", "a"),
           (2, ts(1), "PL-88", "b"), (2, ts(2), "PL-05", "c"), (2, ts(3), "CC-03", None),
           (3, ts(1), None, "d"), (3, ts(2), "CC-021\n", "e"), (3, ts(3), "CC-03", "System")]
    logs = spark.createDataFrame(log, "u long, t timestamp_ntz, code string, owner string")
    st = F.col("code")
    out = stage_funnel(profiles, logs, user="u", segment=F.col("seg"), product=F.split_part(st, F.lit("-"), F.lit(1)),
                       stages={"p021": imatch(st, "021$"), "p03": imatch(st, "03$"), "p88": imatch(st, "88$"),
                               "p05": imatch(st, "05$")},
                       derived={"p88_only": F.when((F.col("p88") == 1) & (F.col("p05") == 0), 1).otherwise(0)},
                       owners={"oic03": (F.col("owner"), ["t"], imatch(st, "03$"))},
                       gated={"p03_sys": (F.col("p03") == 1) & (F.col("oic03") == "System")},
                       percents={"pct03": "p03"})
    got = {(r.segment, r.product): r for r in out.collect()}
    # NULL code forms no product row; trailing newline defeats '021$' (PostgreSQL '$')
    assert ("Red", "CC") in got and ("Red", None) not in got
    assert got[("Red", "CC")].p021 == 0 and got[("Red", "CC")].p03_sys == 1
    # user 1 passes 88 without 05; user 2 passes both in PL
    assert got[("Green", "PL")].p88_only == 1 and got[("Green", "PL")].p88 == 2
    # CC-03 of user 2 has a NULL owner: flag counts, STP does not
    assert got[("Green", "CC")].p03 == 1 and got[("Green", "CC")].p03_sys == 0
    # users counted once per level even when they span products
    assert got[("Green", "Total")].p03 == 2 and got[("Total", "Total")].p03 == 3
    assert got[("Total", "Total")].profiles == 4 and got[("Total", "Total")].pct03 == "75.0 %"


def test_attribution_owner_cascade(spark):
    data = [("sms", None), ("email-monitoring", None), ("email-monitoring", "agent7"), ("CRM-AB12", "x"),
            ("crm-ab12", "x"), ("CRM-ABCD", "agent7"), ("bysemail-Z9", None), ("AB12_androidapp", None),
            ("ab12_androidapp", None), (None, "agent3"), (None, None)]
    df = spark.createDataFrame(data, "src string, lc string")
    got = [r[0] for r in df.select(attribution_owner(F.col("src"), F.col("lc"))).collect()]
    assert got == ["PORTFOLIO", "System", "agent7", "AB12", None, "agent7", "Z9", "AB12", "System",
                   "agent3", "System"]


def test_conversion_matrix_brute_force(spark):
    base = [(1, 10, ts(1), ts(20)), (1, 11, ts(1), ts(25)), (2, 12, ts(12), ts(14)), (3, 13, ts(22), ts(23)),
            (4, 14, None, ts(26))]
    conv = [(1, 90, ts(2)), (1, 91, ts(27)), (2, 92, ts(11)), (2, 93, ts(13)), (3, 94, ts(29)), (3, 95, ts(31))]
    profile = {u: p for u, _, p, _ in base}
    leads = [(u, lead, p, a, None) for u, lead, p, a in base] + [(u, lead, profile[u], None, at) for u, lead, at in conv]
    leads += leads[:3]                                      # repeated rows count once
    df = spark.createDataFrame(leads, "user_id long, lead_id long, profiled timestamp_ntz, applied timestamp_ntz, booked timestamp_ntz")
    out = conversion_matrix(df, user="user_id", lead="lead_id", profiled="profiled", applied="applied",
                            booked="booked", m0="2024-01-21", m1="2024-01-11", m2="2024-01-05", end="2024-01-30")
    got = {r.vintage: r.asDict() for r in out.collect()}
    assert set(got) == {"M0", "M1", "M2+", None}
    assert got[None]["2024-01-21 applied"] == 1 and got[None]["M2+ profiled"] == 0
    assert got["M2+"]["M2+ profiled"] == 1 and got["M2+"]["2024-01-11 applied"] == 1
    assert got["M2+"]["2024-01-21 applied"] == 1
    # user 1: conversions booked on/after the profile date and on/before the end
    assert got["M2+"]["M2+ conversion"] == 1 and got["M2+"]["2024-01-21 conversion"] == 1
    assert got["M1"]["2024-01-11 conversion"] == 1          # lead 93, not 92 (before profile)
    assert got["M0"]["2024-01-21 conversion"] == 1          # lead 94, not 95 (after end)


def test_pacing_zero_plan_and_case(spark):
    plan = spark.createDataFrame([("Green", "pl", "a", "PA", 30, 1), ("GREEN", "PL", "B", "PA", 0, 0),
                                  ("GREEN", "PL", "A", "System", 60, 2)],
                                 "customer_type string, product string, sku string, attribution string, "
                                 "monthly_plan long, dtd_plan long")
    plan = upper_strings(plan, ["customer_type", "product", "sku"])
    apps = spark.createDataFrame([(1, ts(9), "green", "pl", "a", "PA"), (2, ts(10), "green", "pl", "a", "PA"),
                                  (3, ts(10), "green", "pl", "b", "PA"), (4, ts(10), "green", "pl", "a", "System")],
                                 "lead long, t timestamp_ntz, customer_type string, product string, sku string, "
                                 "attribution string")
    apps = upper_strings(apps, ["customer_type", "product", "sku"])
    out = pacing(apps, plan, team="attribution", keys=["customer_type", "product", "sku"], lead="lead", t="t",
                 day="2024-01-10", days_month=F.lit(30), days_past=F.lit(10))
    got = {(r.attribution, r.sku): r for r in out.collect()}
    assert set(got) == {("PA", "A"), ("System", "A")}            # zero-plan SKU B is dropped
    r = got[("PA", "A")]
    assert (r.dtd_actual, r.mtd_actual, r.mtd_plan, r.mtd_estimate, r.backlog, r.drr) == (1, 2, 10, 6, 8, 3)
    assert r.mtd_pct == "20.00%" and r.dtd_pct == "100.00%"
    left = pacing(apps, plan, team="attribution", keys=["customer_type", "product", "sku"], lead="lead",
                  t="t", day="2024-01-10", days_month=F.lit(30), days_past=F.lit(10), drr_per="left")
    assert {(x.attribution, x.drr) for x in left.collect()} == {("PA", 1), ("System", 3)}


def test_latest_utm_strictly_before(spark):
    from funnelkit.plans.reports import latest_utm
    pays = spark.createDataFrame([(1, ts(2)), (1, ts(1)), (2, ts(3))], "user_id long, payment_date timestamp_ntz")
    log = spark.createDataFrame([(1, ts(1), "sms"), (1, ts(1, 30), "CRM-A1"), (3, ts(1), "x")],
                                "user_id long, created_at timestamp_ntz, utm_source_text string")
    got = latest_utm(pays, log, user="user_id", t="payment_date")
    assert rows(got) == [(1, ts(1), None), (1, ts(2), "CRM-A1"), (2, ts(3), None)]


def test_recency_flags_boundaries(spark):
    from funnelkit.plans.reports import recency_flags
    apps = spark.createDataFrame(
        [(1, dt.datetime(2024, 3, 1), "STBL"), (2, dt.datetime(2024, 2, 29, 23, 59), "STBL"),
         (3, dt.datetime(2024, 2, 1), "STBL"), (4, dt.datetime(2023, 12, 31), "STBL"), (5, dt.datetime(2024, 3, 5), "PL")],
        "user_id long, applied_date timestamp_ntz, product string")
    got = recency_flags(apps, user="user_id", t="applied_date", d0="2024-03-01", d1="2024-02-01", d2="2024-01-01",
                        groups={"stbl": F.col("product") == "STBL"})
    r = {x.user_id: (x.stbl_d0, x.stbl_d1, x.stbl_d2, x.stbl_old) for x in got.collect()}
    assert r == {1: (1, 0, 0, 0), 2: (0, 1, 0, 0), 3: (0, 1, 0, 0), 4: (0, 0, 0, 1), 5: (0, 0, 0, 0)}
