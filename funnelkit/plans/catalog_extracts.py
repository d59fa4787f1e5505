"""Wide per-lead / per-user extracts (R2, R9, R10, R17, R18, R19, R21): many
lookups on one base, each lookup computed once per key (single-pass log
aggregation) and attached with an equi join."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelkit.functions.expr import (case_cascade, day_window, decode_label, half_open, imatch,
                                      m_bucket, month_diff, nimatch, similar_prefix)
from funnelkit.operators.agg import first_by, join_distinct, last_by, milestone, milestone_and_not
from funnelkit.operators.lookup import (agg_per_key, asof_join, first_per, hot_keys_for, lookback_join,
                                        lookup_latest, range_agg)
from funnelkit.operators.member import anti, semi
from funnelkit.plans.registry import Tables, query
from funnelkit.sources.tables import maybe_in

# Profile type labels and the progress ladder (first match wins).
SEGMENT_LABELS = {"BUILDING": "Green", "MACHINERY": "Red", "AUTOMOBILE": "Amber"}
PROGRESS_LADDER = [("07$", "07"), ("(110|210)$", "110"), ("(051?|06)$", "05"), ("88$", "88"),
                   ("02[23]$", "022"), ("021?$", "02")]
# Stages that mean a product was offered, was of interest, or was rejected.
OFFERED_STAGE, INTEREST_STAGE, REJECTED_STAGE = "05$", "0(1|21?)$", "88$"
CORE_INTEREST_STAGE = "^(CL|vi)-0(1|21?)$"
# Sources of alliances and networks.
ALLIANCE_SOURCE, ALLIANCE_EXCLUDED = "(crm|email)", "email-7"
NETWORK_SOURCE = "(androidapp|monitoring)"


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


def _segment_label(t):
    return t.customer.select(F.col("c_custkey").alias("user_id"),
                             decode_label("c_mktsegment", SEGMENT_LABELS, "NH").alias("customer_type"))


def _stage_events(t):
    """Events as a stage log: ``PRODUCT-STAGE`` text from the event type and its
    ``props.k`` code (e.g. ``CL-069``)."""
    k = F.get_json_object("props", "$.k")
    return t.events.withColumn(
        "product_status", F.concat(F.upper(F.substring("event_type", 1, 2)), F.lit("-"),
                                   F.lpad(k, 3, "0")))


_STAGE_SQL = "upper(substr(event_type, 1, 2)) || '-' || lpad(json_extract_string(props, '$.k'), 3, '0')"


@query("fresh_profiles_effort", ids="R21 C13 A10 A14 J7 J11 J15 F2", sql=f"""
WITH ev AS (SELECT *, {_STAGE_SQL} AS product_status FROM events),
cp AS (SELECT user_id, min(ts) AS created_on FROM events GROUP BY user_id)
SELECT cp.user_id,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Green' WHEN c.c_mktsegment = 'MACHINERY' THEN 'Red'
            WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Amber' ELSE 'NH' END AS customer_type,
       CAST(cp.created_on AS DATE) AS profile_date,
       call_metrics.*, log_metrics.*,
       (app.first_applied_date IS NOT NULL)::INTEGER AS is_applied, app.first_applied_date,
       first_call.event_type AS first_call_type, first_call.event_id AS first_call_id,
       first_call.ts AS first_log_date,
       CASE WHEN dialer.dialer_crm IS NULL THEN 'Other M0' ELSE dialer.dialer_crm END AS dialer_crm
FROM cp
LEFT JOIN customer c ON c.c_custkey = cp.user_id
LEFT JOIN LATERAL (SELECT min(ts) AS first_applied_date FROM ev
                   WHERE ev.user_id = cp.user_id AND ev.event_type = 'purchase') app ON TRUE
LEFT JOIN LATERAL (
  SELECT (count(*) > 0)::INTEGER AS is_called, bool_or(event_type != 'error')::INTEGER AS is_contacted,
         count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS eff_attempts
  FROM ev WHERE ev.user_id = cp.user_id AND ev.event_type IN ('click', 'view', 'error')
    AND ev.ts < coalesce(app.first_applied_date + INTERVAL 2 MINUTE, 'infinity'::TIMESTAMP)
) call_metrics ON TRUE
LEFT JOIN LATERAL (
  SELECT bool_or(event_type = 'view')::INTEGER AS is_prod_int,
         CASE WHEN bool_or(regexp_matches(product_status, '07$', 'i')) THEN '07'
              WHEN bool_or(regexp_matches(product_status, '(110|210)$', 'i')) THEN '110'
              WHEN bool_or(regexp_matches(product_status, '(051?|06)$', 'i')) THEN '05'
              WHEN bool_or(regexp_matches(product_status, '88$', 'i')) THEN '88'
              WHEN bool_or(regexp_matches(product_status, '02[23]$', 'i')) THEN '022'
              WHEN bool_or(regexp_matches(product_status, '021?$', 'i')) THEN '02'
              ELSE '00' END AS progress,
         nullif(string_agg(DISTINCT split_part(product_status, '-', 1), ' | ' ORDER BY split_part(product_status, '-', 1))
                FILTER (WHERE regexp_matches(product_status, '05$', 'i')), '') AS offered_products,
         nullif(string_agg(DISTINCT split_part(product_status, '-', 1), ' | ' ORDER BY split_part(product_status, '-', 1))
                FILTER (WHERE regexp_matches(product_status, '0(1|21?)$', 'i')), '') AS interest_shown_products,
         string_agg(DISTINCT split_part(product_status, '-', 1), ' | ' ORDER BY split_part(product_status, '-', 1))
                FILTER (WHERE regexp_matches(product_status, '^(CL|vi)-0(1|21?)$', 'i')) AS core_interest_shown_products,
         string_agg(DISTINCT split_part(product_status, '-', 1), ' | ' ORDER BY split_part(product_status, '-', 1))
                FILTER (WHERE regexp_matches(product_status, '88$', 'i')) AS rejected_products
  FROM ev WHERE ev.user_id = cp.user_id AND ev.event_type IN ('view', 'click', 'signup')
) log_metrics ON TRUE
LEFT JOIN LATERAL (
  SELECT event_type, event_id, ts FROM ev
  WHERE ev.user_id = cp.user_id AND ev.event_type IN ('click', 'view', 'error')
    AND ev.ts < coalesce(app.first_applied_date + INTERVAL 2 MINUTE, 'infinity'::TIMESTAMP)
  ORDER BY ts, event_id LIMIT 1
) first_call ON TRUE
LEFT JOIN LATERAL (
  SELECT product_status AS dialer_crm FROM ev WHERE ev.user_id = cp.user_id
    AND regexp_matches(product_status, '^er', 'i') ORDER BY ts DESC, event_id DESC LIMIT 1
) dialer ON TRUE
WHERE CAST(cp.created_on AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-02'
""")
def fresh_profiles_effort(spark, d, *, first_day="2024-01-01", last_day="2024-01-02"):
    t = Tables(spark, d)
    ev = _stage_events(t)
    prof = ev.groupBy("user_id").agg(F.min("ts").alias("created_on")) \
        .where(day_window("created_on", first_day, last_day))
    app = ev.where(F.col("event_type") == "purchase").groupBy("user_id") \
        .agg(F.min("ts").alias("first_applied_date"))
    base = prof.join(app, "user_id", "left")
    calls = ev.where(F.col("event_type").isin("click", "view", "error"))
    until = F.col("first_applied_date") + F.expr("INTERVAL 2 MINUTES")
    # effort before the first application (all of it without one) and the first such
    # call, one pass
    base = range_agg(base.withColumn("__until", until), calls, "user_id", "__until", "ts", {
        "attempts": ("count", F.lit(1)),
        "is_contacted": ("max", (F.col("event_type") != "error").cast("int")),
        "eff_attempts": ("sum", (F.col("event_type") == "error").cast("long")),
        "__fc": ("min", F.struct("ts", "event_id", "event_type")),
    }, hot=hot_keys_for(t.events, "user_id", "ts", holds_right=True)).drop("__until").fillna(0, subset=["eff_attempts"])
    st = F.col("product_status")
    logs = ev.where(F.col("event_type").isin("view", "click", "signup")).groupBy("user_id").agg(
        milestone(F.col("event_type") == "view").alias("is_prod_int"),
        case_cascade([(F.bool_or(imatch(st, p)), lbl) for p, lbl in PROGRESS_LADDER], "00").alias("progress"),
        join_distinct(F.split_part(st, F.lit("-"), F.lit(1)), " | ", where=imatch(st, OFFERED_STAGE))
        .alias("offered_products"),
        join_distinct(F.split_part(st, F.lit("-"), F.lit(1)), " | ", where=imatch(st, INTEREST_STAGE))
        .alias("interest_shown_products"),
        join_distinct(F.split_part(st, F.lit("-"), F.lit(1)), " | ", where=imatch(st, CORE_INTEREST_STAGE))
        .alias("core_interest_shown_products"),
        join_distinct(F.split_part(st, F.lit("-"), F.lit(1)), " | ", where=imatch(st, REJECTED_STAGE))
        .alias("rejected_products"))
    dialer = lookup_latest(base.select("user_id"), ev, "user_id", ["ts", "event_id"], ["product_status"],
                           where=imatch(st, "^er"), how="inner")
    out = (base.join(logs, "user_id", "left").join(dialer, "user_id", "left")
           .join(_segment_label(t), "user_id", "left"))
    return out.select(
        "user_id", "customer_type", F.to_date("created_on").alias("profile_date"),
        (F.col("attempts") > 0).cast("int").alias("is_called"), "is_contacted", "attempts", "eff_attempts",
        "is_prod_int", "progress", "offered_products", "interest_shown_products", "core_interest_shown_products",
        "rejected_products",
        F.col("first_applied_date").isNotNull().cast("int").alias("is_applied"), "first_applied_date",
        F.col("__fc.event_type").alias("first_call_type"), F.col("__fc.event_id").alias("first_call_id"),
        F.col("__fc.ts").alias("first_log_date"),
        F.coalesce(F.col("product_status"), F.lit("Other M0")).alias("dialer_crm"))


def _subscribers(t):
    return t.orders.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000))


_SUBSCRIBED_SQL = "SELECT 1 FROM orders s WHERE s.o_custkey = {u} AND s.o_orderstatus = 'P' AND s.o_totalprice > 400000"


@query("sms_promise_not_subscribed", ids="R19 A23 J21 J2 P2 P3 O3", sql=f"""
SELECT DISTINCT ON (user_id) l.l_orderkey AS lead_id, o.o_custkey AS user_id,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Green' WHEN c.c_mktsegment = 'MACHINERY' THEN 'Red'
            WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Amber' ELSE 'NH' END AS customer_type,
       CASE WHEN regexp_matches(l.l_returnflag, 'r', 'i') THEN 'BYS'
            WHEN regexp_matches(l.l_returnflag, 'a', 'i') THEN 'CHR' END AS service_type,
       l.l_shipdate AS updated_at
FROM lineitem l
LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
WHERE l.l_shipdate >= TIMESTAMP '1996-01-01' AND l.l_shipdate < TIMESTAMP '1996-07-01'
  AND regexp_matches(l.l_returnflag, '(r|a)', 'i') AND l.l_linestatus = 'F'
  AND NOT EXISTS ({_SUBSCRIBED_SQL.format(u='o.o_custkey')})
ORDER BY user_id, l.l_shipdate, l.l_orderkey, l.l_returnflag
""")
def sms_promise_not_subscribed(spark, d, *, start="1996-01-01", end="1996-07-01"):
    t = Tables(spark, d)
    contacts = t.lineitem.where(half_open("l_shipdate", start, end) &
                                imatch("l_returnflag", "(r|a)") & (F.col("l_linestatus") == "F"))
    j = contacts.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"),
                                      F.col("o_custkey").alias("user_id")), "l_orderkey", "left")
    j = anti(j, _subscribers(t), [("user_id", "o_custkey")])
    j = j.withColumn("service_type", F.when(imatch("l_returnflag", "r"), "BYS")
                     .when(imatch("l_returnflag", "a"), "CHR"))
    first = first_per(j, "user_id", ["l_shipdate", "l_orderkey", "l_returnflag"],
                      ["l_orderkey", "service_type", "l_shipdate"])
    return first.join(_segment_label(t), "user_id", "left").select(
        F.col("l_orderkey").alias("lead_id"), "user_id", "customer_type", "service_type",
        F.col("l_shipdate").alias("updated_at"))


@query("interest_not_subscribed", ids="R18 A23 J16 J21 C11 DT7 P5", sql=f"""
WITH vas_interest AS (
  SELECT DISTINCT ON (o_custkey) o_custkey AS user_id, o_orderkey AS lead_id, o_orderdate AS log_updated_at,
         o_orderpriority AS product_status
  FROM orders
  WHERE regexp_matches(o_orderpriority, '(urg|hig).*t$', 'i')
    AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
  ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC
)
SELECT vi.*,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Green' WHEN c.c_mktsegment = 'MACHINERY' THEN 'Red'
            WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Amber' ELSE 'NH' END AS customer_type,
       c.c_acctbal AS credit_score, calls.*, acct.*
FROM vas_interest vi
LEFT JOIN customer c ON c.c_custkey = vi.user_id
LEFT JOIN LATERAL (
  SELECT count(*) AS calls, count(*) FILTER (WHERE l.l_returnflag NOT IN ('N', 'X')) AS contacted
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  WHERE o.o_custkey = vi.user_id AND l.l_shipdate >= CAST(DATE '1998-06-01' - INTERVAL 3 MONTH AS TIMESTAMP)
) calls ON TRUE
LEFT JOIN LATERAL (
  SELECT bool_or(p.p_type = 'ECONOMY')::INTEGER AS has_economy,
         bool_or(p.p_type = 'SMALL')::INTEGER AS has_small,
         bool_or(p.p_type = 'LARGE')::INTEGER AS has_large
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
  WHERE l.l_orderkey = vi.lead_id AND l.l_linestatus = 'O'
) acct ON TRUE
WHERE NOT EXISTS ({_SUBSCRIBED_SQL.format(u='vi.user_id')})
""")
def interest_not_subscribed(spark, d, *, start="1997-01-01", end="1998-01-01", run_date="1998-06-01"):
    t = Tables(spark, d)
    logs = t.orders.where(imatch("o_orderpriority", "(urg|hig).*t$") &
                          half_open("o_orderdate", start, end))
    vi = first_per(logs, "o_custkey", ["o_orderdate", "o_orderkey"],
                   ["o_orderkey", "o_orderdate", "o_orderpriority"], last=True).select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("lead_id"),
        F.col("o_orderdate").alias("log_updated_at"), F.col("o_orderpriority").alias("product_status"))
    vi = anti(vi, _subscribers(t), [("user_id", "o_custkey")])
    since = F.add_months(F.lit(run_date).cast("date"), -3).cast("timestamp_ntz")
    user_calls = (t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"))
                  .join(t.lineitem.where(F.col("l_shipdate") >= since)
                        .select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag"), "o_orderkey"))
    vi = agg_per_key(vi, user_calls, "user_id", [
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(~F.col("l_returnflag").isin("N", "X"), 1)).alias("contacted")],
        zero=["calls", "contacted"])
    held = (t.lineitem.where(F.col("l_linestatus") == "O").select(F.col("l_orderkey").alias("lead_id"), "l_partkey")
            .join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey"))
    vi = agg_per_key(vi, held, "lead_id", [
        milestone(F.col("p_type") == "ECONOMY").alias("has_economy"),
        milestone(F.col("p_type") == "SMALL").alias("has_small"),
        milestone(F.col("p_type") == "LARGE").alias("has_large")])
    cust = t.customer.select(F.col("c_custkey").alias("user_id"),
                             decode_label("c_mktsegment", SEGMENT_LABELS, "NH").alias("customer_type"),
                             F.col("c_acctbal").alias("credit_score"))
    return vi.join(cust, "user_id", "left").select(
        "user_id", "lead_id", "log_updated_at", "product_status", "customer_type", "credit_score",
        "calls", "contacted", "has_economy", "has_small", "has_large")


@query("stage_070_leads", ids="R17 U1 J10 J29 J9 P2", sql="""
WITH calls AS (
  SELECT o.o_custkey AS user_id, l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_linestatus
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
)
SELECT vs.o_custkey AS user_id,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Green' WHEN c.c_mktsegment = 'MACHINERY' THEN 'Red'
            WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Amber' ELSE 'NH' END AS customer_type,
       vs.o_orderkey AS lead_id, vs.o_orderstatus AS product_status, vs.o_orderpriority AS type,
       (SELECT x.l_returnflag || '-' || x.l_linestatus FROM calls x
        WHERE x.user_id = vs.o_custkey AND x.l_shipdate < vs.o_orderdate
        ORDER BY x.l_shipdate DESC, x.l_orderkey DESC, x.l_linenumber DESC, x.l_returnflag DESC, x.l_linestatus DESC
        LIMIT 1) AS utm_source_text,
       vs.o_orderdate AS modified_ts,
       (SELECT max(x.l_shipdate) FROM calls x WHERE x.user_id = vs.o_custkey AND x.l_returnflag = 'R'
          AND regexp_matches(x.l_linestatus, 'f', 'i')) AS sms_sent_on
FROM orders vs LEFT JOIN customer c ON c.c_custkey = vs.o_custkey
WHERE vs.o_orderdate >= TIMESTAMP '1999-01-01' AND vs.o_orderdate < TIMESTAMP '1999-04-01'
  AND regexp_matches(vs.o_orderpriority, '(1.+NT|2.+GH)', 'i')
""")
def stage_070_leads(spark, d, *, start="1999-01-01", end="1999-04-01", owners=None):
    t = Tables(spark, d)
    vs = t.orders.where(half_open("o_orderdate", start, end) & imatch("o_orderpriority", "(1.+NT|2.+GH)"))
    # the owner list is optional: without it every owner's leads are reported
    vs = maybe_in(vs.withColumn("owner", _applied_oic()), "owner", owners).drop("owner")
    # only the reported leads' users' logs take part
    calls = semi(t.orders, vs, "o_custkey").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")).join(t.lineitem, "l_orderkey")
    src = calls.select("user_id", "l_shipdate", "l_orderkey", "l_linenumber",
                       F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("utm_source_text"))
    x = asof_join(vs.withColumnRenamed("o_custkey", "user_id"), src, "user_id", "o_orderdate", "l_shipdate",
                  ["utm_source_text"], tiebreak=["l_orderkey", "l_linenumber"],
                  hot=hot_keys_for(t.orders, "o_custkey", "o_orderdate"))
    x = agg_per_key(x, calls.where((F.col("l_returnflag") == "R") & imatch("l_linestatus", "f")), "user_id",
                    [F.max("l_shipdate").alias("sms_sent_on")])
    return x.join(_segment_label(t), "user_id", "left").select(
        "user_id", "customer_type", F.col("o_orderkey").alias("lead_id"),
        F.col("o_orderstatus").alias("product_status"), F.col("o_orderpriority").alias("type"),
        "utm_source_text", F.col("o_orderdate").alias("modified_ts"), "sms_sent_on")


def _user_event_lookups(t):
    """All per-user lookups on the event log in one aggregation pass."""
    ev = t.events
    order = ["ts", "event_id"]
    et = F.col("event_type")
    return ev.groupBy("user_id").agg(
        last_by("event_id", order, where=et == "signup").alias("tkn"),
        last_by("value", order, where=et == "purchase").alias("__last_purchase_value"),
        last_by("value", order, where=et == "view").alias("__last_view_value"),
        F.max("ts").alias("latest_login_date"))


@query("mtd_active_enriched", ids="R2 J20 J7 J8 J9 P5 P1", sql="""
WITH base AS (
  SELECT la.o_orderkey AS lead_id, la.o_custkey AS user_id, la.o_orderstatus AS product_status,
         la.o_orderpriority AS product, la.o_orderdate AS applied_date
  FROM orders la
  WHERE EXISTS (SELECT 1 FROM lineitem steps WHERE steps.l_orderkey = la.o_orderkey
                AND steps.l_shipdate >= TIMESTAMP '1998-06-01')
)
SELECT b.*,
  (SELECT o2.o_orderdate FROM orders o2 WHERE o2.o_custkey = b.user_id ORDER BY o2.o_orderdate LIMIT 1) AS first_profile_date,
  c.c_mktsegment AS customer_type, c.c_acctbal AS credit_score, c.c_name AS first_name,
  (SELECT e.event_id FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'signup'
   ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) AS tkn,
  coalesce((SELECT e.value FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'purchase'
            ORDER BY e.ts DESC, e.event_id DESC LIMIT 1),
           (SELECT e.value FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'view'
            ORDER BY e.ts DESC, e.event_id DESC LIMIT 1),
           c.c_acctbal) AS monthly_income,
  (SELECT e.ts FROM events e WHERE e.user_id = b.user_id ORDER BY e.ts DESC LIMIT 1) AS latest_login_date
FROM base b JOIN customer c ON c.c_custkey = b.user_id
""")
def mtd_active_enriched(spark, d, *, since="1998-06-01"):
    """Leads with a logged step since ``since``, enriched."""
    t = Tables(spark, d)
    base = semi(t.orders, t.lineitem.where(F.col("l_shipdate") >= _ts(since)),
                [("o_orderkey", "l_orderkey")]).select(
        F.col("o_orderkey").alias("lead_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("product_status"), F.col("o_orderpriority").alias("product"),
        F.col("o_orderdate").alias("applied_date"))
    first = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.min("o_orderdate").alias("first_profile_date"))
    cust = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("customer_type"),
                             F.col("c_acctbal").alias("credit_score"), F.col("c_name").alias("first_name"))
    out = (base.join(first, "user_id", "left").join(cust, "user_id", "inner")
           .join(_user_event_lookups(t), "user_id", "left"))
    return out.select(
        "lead_id", "user_id", "product_status", "product", "applied_date", "first_profile_date",
        "customer_type", "credit_score", "first_name", "tkn",
        F.coalesce("__last_purchase_value", "__last_view_value", "credit_score").alias("monthly_income"),
        "latest_login_date")


@query("approved_attribution", ids="R9 J4 J18 J10 J16 A13 P4", sql="""
WITH ev AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
src AS (SELECT user_id, ts AS created_at, event_id,
        CASE event_type
          WHEN 'click' THEN 'CRM-A' || k
          WHEN 'view' THEN CASE WHEN k % 5 = 0 THEN 'email-monitoring-' || k ELSE 'email-' || k END
          WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'B' || k || '_androidapp' ELSE 'crm-b' || k END
          ELSE 'error-' || k END AS utm_source_text
        FROM ev WHERE event_type <> 'purchase'),
prof1 AS (SELECT user_id, min(ts) AS profiled_date FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT a.o_orderkey AS lead_id, a.o_custkey AS user_id, c.c_name AS first_name, a.o_orderpriority AS sku,
       a.o_orderdate AS aip_approval_date, agency.agency_name, pu.profiled_utm_source,
       CASE WHEN regexp_matches(pu.profiled_utm_source, '(crm|email)', 'i')
             AND pu.profiled_utm_source NOT IN ('email-7') THEN '1' END AS alliance_flag,
       CASE WHEN regexp_matches(pu.profiled_utm_source, '(androidapp|monitoring)', 'i') THEN '1' END AS nw_flag,
       c.c_acctbal AS credit_score, coalesce(rc.regen_lead_count, 0) AS regen_lead_count
FROM orders a
LEFT JOIN customer c ON c.c_custkey = a.o_custkey
LEFT JOIN LATERAL (SELECT r.r_name AS agency_name FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
                   WHERE n.n_nationkey = c.c_nationkey AND regexp_matches(n.n_name, '_1', 'i')) agency ON TRUE
LEFT JOIN LATERAL (
  SELECT (SELECT s.utm_source_text FROM src s WHERE s.user_id = prof1.user_id AND s.created_at < prof1.profiled_date
          ORDER BY s.created_at DESC, s.event_id DESC LIMIT 1) AS profiled_utm_source
  FROM prof1 WHERE prof1.user_id = a.o_custkey
) pu ON TRUE
LEFT JOIN LATERAL (
  SELECT count(*) AS regen_lead_count
  FROM orders cl WHERE regexp_matches(cl.o_orderpriority, 'high', 'i') AND cl.o_custkey = a.o_custkey
) rc ON TRUE
WHERE a.o_orderdate >= TIMESTAMP '1997-01-01' AND a.o_orderdate < TIMESTAMP '1997-04-01'
""")
def approved_attribution(spark, d, *, start="1997-01-01", end="1997-04-01"):
    from funnelkit.plans.catalog_reports import _utm_source
    t = Tables(spark, d)
    a = t.orders.where(half_open("o_orderdate", start, end))
    ev = semi(t.events, a, [("user_id", "o_custkey")])    # the approved users' logs only
    ev = ev.withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    src = ev.where(F.col("event_type") != "purchase").select(
        "user_id", F.col("ts").alias("src_ts"), F.col("event_id").alias("src_id"),
        _utm_source(F.col("k"), F.col("event_type")).alias("profiled_utm_source"))
    prof1 = ev.where(F.col("event_type") == "purchase").groupBy("user_id").agg(F.min("ts").alias("profiled_date"))
    pu = asof_join(prof1, src, "user_id", "profiled_date", "src_ts", ["profiled_utm_source"], tiebreak=["src_id"],
                   hot=hot_keys_for(ev, "user_id", "ts", holds_right=True))
    agency = (t.nation.where(imatch("n_name", "_1"))
           .join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey", "left")
           .select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("agency_name")))
    cust = t.customer.join(agency, "c_nationkey", "left").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("first_name"), "agency_name",
        F.col("c_acctbal").alias("credit_score"))
    # the regenerated leads themselves are the rows of ``regenerated_leads``: a list of
    # them on each of their user's leads would grow with the square of that user's leads
    regen = semi(t.orders.where(imatch("o_orderpriority", "high")), a, "o_custkey") \
        .groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("regen_lead_count"))
    out = (a.select(F.col("o_orderkey").alias("lead_id"), F.col("o_custkey").alias("user_id"),
                    F.col("o_orderpriority").alias("sku"), F.col("o_orderdate").alias("aip_approval_date"))
           .join(cust, "user_id", "left").join(pu.select("user_id", "profiled_utm_source"), "user_id", "left")
           .join(regen, "user_id", "left"))
    src_col = F.col("profiled_utm_source")
    return out.select(
        "lead_id", "user_id", "first_name", "sku", "aip_approval_date", "agency_name", "profiled_utm_source",
        F.when(imatch(src_col, ALLIANCE_SOURCE) & ~src_col.isin(ALLIANCE_EXCLUDED), "1").alias("alliance_flag"),
        F.when(imatch(src_col, NETWORK_SOURCE), "1").alias("nw_flag"), "credit_score",
        F.coalesce("regen_lead_count", F.lit(0)).alias("regen_lead_count"))


@query("regenerated_leads", ids="R9 J19", sql="""
SELECT cl.o_custkey AS user_id, cl.o_orderkey AS regen_lead_id, cl.o_orderstatus AS regen_lender,
       cl.o_orderpriority AS regen_sku
FROM orders cl
WHERE regexp_matches(cl.o_orderpriority, 'high', 'i')
  AND EXISTS (SELECT 1 FROM orders a WHERE a.o_custkey = cl.o_custkey
              AND a.o_orderdate >= TIMESTAMP '1997-01-01' AND a.o_orderdate < TIMESTAMP '1997-04-01')
""")
def regenerated_leads(spark, d, *, start="1997-01-01", end="1997-04-01"):
    """Every regenerated lead, with lender and SKU, of the users that
    ``approved_attribution`` reports: its three lists in long form, by user."""
    t = Tables(spark, d)
    a = t.orders.where(half_open("o_orderdate", start, end))
    return semi(t.orders.where(imatch("o_orderpriority", "high")), a, "o_custkey").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("regen_lead_id"),
        F.col("o_orderstatus").alias("regen_lender"), F.col("o_orderpriority").alias("regen_sku"))


def _applied_oic():
    return (F.when(F.col("o_totalprice") > 200000, "System").when(F.col("o_orderstatus") == "P", "PORTFOLIO")
            .otherwise(F.concat(F.lit("agent-"), (F.col("o_custkey") % 10).cast("string"))))


@query("applications_extract", ids="R10 C3 C10 J12 J16 A6 A7 A11 A14 AR1 F10 F12 STR4 STR5 U2 DT9 P2", sql="""
WITH a AS (
  SELECT o.*, CASE WHEN o_totalprice > 200000 THEN 'System' WHEN o_orderstatus = 'P' THEN 'PORTFOLIO'
                   ELSE 'agent-' || CAST(o_custkey % 10 AS VARCHAR) END AS applied_oic,
         regexp_full_match(CAST(o_custkey AS VARCHAR), '(1|2|3).*') AS zone
  FROM orders o
  WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01'
),
calls AS (SELECT o.o_custkey AS user_id, l.* FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
SELECT a.o_orderkey AS lead_id, a.o_custkey AS user_id, a.o_orderpriority AS sku, a.applied_oic,
  CASE WHEN regexp_matches(a.o_orderpriority, 'urgent', 'i') AND NOT a.zone
         AND regexp_matches(a.applied_oic, '(system|port)', 'i') THEN coalesce(lb.oic, a.applied_oic)
       WHEN regexp_matches(a.o_orderpriority, 'low', 'i')
         AND regexp_matches(a.applied_oic, '(system|port)', 'i') THEN coalesce(lb.oic, a.applied_oic)
       WHEN regexp_matches(a.o_orderpriority, 'medium', 'i')
         AND regexp_matches(a.applied_oic, '(system|port)', 'i') THEN coalesce(late.oic, a.applied_oic)
       ELSE a.applied_oic END AS attribution,
  steps.latest_crm, stage_flags.*, effort.*,
  CASE WHEN (year(a.o_orderdate) - year(fp.first_profile_date)) * 12 + month(a.o_orderdate) - month(fp.first_profile_date) < 2
       THEN 'M' || CAST((year(a.o_orderdate) - year(fp.first_profile_date)) * 12 + month(a.o_orderdate) - month(fp.first_profile_date) AS VARCHAR)
       ELSE 'M1+' END AS profile_vintage,
  CASE WHEN regexp_matches(a.o_orderpriority, 'urgent', 'i') AND a.zone THEN a.o_orderpriority || ' AP & TG'
       WHEN regexp_matches(a.o_orderpriority, 'urgent', 'i') AND NOT a.zone THEN a.o_orderpriority || ' ROI'
       WHEN regexp_matches(a.o_orderpriority, 'high', 'i') THEN 'HIGH PL'
       ELSE a.o_orderpriority END AS sku_name,
  CASE WHEN a.o_orderpriority = '1-URGENT' THEN 1 WHEN a.o_orderpriority = '5-LOW' THEN 0 END AS consent,
  CASE WHEN a.o_orderstatus = 'F' THEN 'YES' WHEN a.o_orderstatus = 'O' THEN 'NO'
       ELSE 'No regen consent record present' END AS regeneration_consent,
  lenders_present.lenders_presented
FROM a
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_profile_date FROM orders GROUP BY 1) fp ON fp.o_custkey = a.o_custkey
LEFT JOIN LATERAL (
  SELECT 'supp-' || CAST(x.l_suppkey AS VARCHAR) AS oic FROM calls x
  WHERE x.user_id = a.o_custkey AND x.l_shipdate >= a.o_orderdate - INTERVAL 40 DAY AND x.l_shipdate <= a.o_orderdate
  ORDER BY x.l_shipdate DESC, x.l_orderkey DESC, x.l_linenumber DESC, x.l_suppkey DESC LIMIT 1
) lb ON TRUE
LEFT JOIN LATERAL (
  SELECT 'supp-' || CAST(l.l_suppkey AS VARCHAR) AS oic FROM lineitem l
  WHERE l.l_orderkey = a.o_orderkey AND l.l_shipdate >= a.o_orderdate + INTERVAL 30 DAY - INTERVAL 48 HOUR
    AND l.l_shipdate < a.o_orderdate + INTERVAL 30 DAY AND NOT regexp_matches('supp-' || CAST(l.l_suppkey AS VARCHAR), '0$')
  ORDER BY l.l_shipdate DESC, l.l_linenumber DESC, l.l_suppkey DESC LIMIT 1
) late ON TRUE
LEFT JOIN LATERAL (
  SELECT l.l_returnflag AS latest_crm FROM lineitem l
  WHERE l.l_orderkey = a.o_orderkey AND l.l_linestatus = 'F' AND NOT regexp_matches(l.l_returnflag, '^n', 'i')
  ORDER BY l.l_shipdate DESC, l.l_linenumber DESC, l.l_returnflag DESC LIMIT 1
) steps ON TRUE
LEFT JOIN LATERAL (
  SELECT bool_or(l_returnflag = 'R')::INTEGER AS pass_r,
         bool_or(CAST(l_linenumber AS VARCHAR) >= '3')::INTEGER AS pass_ge3,
         (bool_or(CAST(l_linenumber AS VARCHAR) >= '3') AND NOT bool_or(CAST(l_linenumber AS VARCHAR) = '5'))::INTEGER AS pass_ge3_not5,
         bool_or(CAST(l_linenumber AS VARCHAR) IN ('5', '6', '7'))::INTEGER AS pass_reject_stage,
         bool_or(CAST(l_linenumber AS VARCHAR) > '2' AND CAST(l_linenumber AS VARCHAR) NOT IN ('4', '6'))::INTEGER AS has_received_feedback
  FROM lineitem WHERE l_orderkey = a.o_orderkey
) stage_flags ON TRUE
LEFT JOIN LATERAL (
  SELECT count(*) AS attempts,
         count(*) FILTER (WHERE NOT regexp_matches(l_returnflag, '(a)', 'i')) AS effective_attempts,
         (array_agg(regexp_replace(l_returnflag || chr(10) || l_linestatus, '[\\n\\r]+', ' ', 'g')
                    ORDER BY l_shipdate DESC, l_returnflag DESC) FILTER (WHERE l_linenumber = 2))[1] AS crm_210
  FROM lineitem
  WHERE l_orderkey = a.o_orderkey AND l_linestatus = 'F' AND NOT regexp_matches(l_returnflag, '^n', 'i')
    AND l_shipdate > a.o_orderdate
) effort ON TRUE
LEFT JOIN LATERAL (
  SELECT string_agg(lenders, '|' ORDER BY lenders) AS lenders_presented
  FROM (SELECT DISTINCT trim(unnest(string_split('{' || l_returnflag || ',' || l_linestatus || '}', ',')), '{}') AS lenders
        FROM lineitem fs2 WHERE fs2.l_orderkey = a.o_orderkey) le
) lenders_present ON TRUE
""")
def applications_extract(spark, d, *, start="1996-01-01", end="1996-04-01"):
    t = Tables(spark, d)
    a = t.orders.where(half_open("o_orderdate", start, end)).withColumns({
        "applied_oic": _applied_oic(),
        "zone": similar_prefix(F.col("o_custkey").cast("string"), ["1", "2", "3"])})
    owner = F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string"))
    leads = a.select("o_orderkey", "o_orderdate")
    # only the applicants' calls take part in the look-back
    calls = semi(t.orders, a, "o_custkey").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")) \
        .join(t.lineitem, "l_orderkey").select(
        "user_id", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", owner.alias("lb_oic"))
    a = lookback_join(a.withColumn("user_id", F.col("o_custkey")), calls, "user_id", "o_orderdate",
                      "l_shipdate", ["lb_oic"], 40 * 86400, pick="last", upper_inclusive=True,
                      tiebreak=["l_orderkey", "l_linenumber", "l_suppkey"],
                      hot=hot_keys_for(t.orders, "o_custkey", "o_orderdate"))
    # every per-lead metric over the lead's lines in one aggregation
    lines = t.lineitem.join(leads.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    applied = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    lately = (F.col("l_shipdate") >= applied - F.expr("INTERVAL 48 HOURS")) & (F.col("l_shipdate") < applied)
    ln = F.col("l_linenumber").cast("string")
    crm_rows = (F.col("l_linestatus") == "F") & nimatch("l_returnflag", "^n")
    after = crm_rows & (F.col("l_shipdate") > F.col("o_orderdate"))
    met = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        last_by("l_returnflag", ["l_shipdate", "l_linenumber", "l_returnflag"], where=crm_rows).alias("latest_crm"),
        last_by(owner, ["l_shipdate", "l_linenumber", "l_suppkey"], where=lately & ~owner.rlike("0$")).alias("late_oic"),
        milestone(F.col("l_returnflag") == "R").alias("pass_r"),
        milestone(ln >= "3").alias("pass_ge3"),
        milestone_and_not(ln >= "3", ln == "5").alias("pass_ge3_not5"),
        milestone(ln.isin("5", "6", "7")).alias("pass_reject_stage"),
        milestone((ln > "2") & ~ln.isin("4", "6")).alias("has_received_feedback"),
        F.count(F.when(after, 1)).alias("attempts"),
        F.count(F.when(after & nimatch("l_returnflag", "(a)"), 1)).alias("effective_attempts"),
        last_by(F.regexp_replace(F.concat("l_returnflag", F.lit("\n"), "l_linestatus"), "[\\n\\r]+", " "),
                ["l_shipdate", "l_returnflag"], where=after & (F.col("l_linenumber") == 2)).alias("crm_210"))
    # lenders presented: the array cast to PostgreSQL text ('{a,b}'), split on
    # commas, braces trimmed, distinct, '|'-joined (bounded by the lender list)
    as_text = F.concat(F.lit("{"), F.array_join(F.array("l_returnflag", "l_linestatus"), ","), F.lit("}"))
    lenders = (lines.select(F.col("l_orderkey").alias("o_orderkey"),
                            F.explode(F.split(as_text, ",")).alias("__l"))
               .select("o_orderkey", F.expr("trim(BOTH '{}' FROM __l)").alias("__l"))
               .groupBy("o_orderkey").agg(join_distinct("__l", "|").alias("lenders_presented")))
    fp = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_profile_date"))
    out = (a.join(met, "o_orderkey", "left").join(fp, "o_custkey", "left")
           .join(lenders, "o_orderkey", "left"))
    sys_owner = imatch("applied_oic", "(system|port)")
    urgent, zone = imatch("o_orderpriority", "urgent"), F.col("zone")
    return out.select(
        F.col("o_orderkey").alias("lead_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("sku"), "applied_oic",
        case_cascade([(urgent & ~zone & sys_owner, F.coalesce("lb_oic", "applied_oic")),
                      (imatch("o_orderpriority", "low") & sys_owner, F.coalesce("lb_oic", "applied_oic")),
                      (imatch("o_orderpriority", "medium") & sys_owner, F.coalesce("late_oic", "applied_oic"))],
                     F.col("applied_oic")).alias("attribution"),
        "latest_crm", "pass_r", "pass_ge3", "pass_ge3_not5", "pass_reject_stage", "has_received_feedback",
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.coalesce("effective_attempts", F.lit(0)).alias("effective_attempts"), "crm_210",
        m_bucket(month_diff("first_profile_date", "o_orderdate")).alias("profile_vintage"),
        case_cascade([(urgent & zone, F.concat("o_orderpriority", F.lit(" AP & TG"))),
                      (urgent & ~zone, F.concat("o_orderpriority", F.lit(" ROI"))),
                      (imatch("o_orderpriority", "high"), F.lit("HIGH PL"))],
                     F.col("o_orderpriority")).alias("sku_name"),
        decode_label("o_orderpriority", {"1-URGENT": 1, "5-LOW": 0}).alias("consent"),
        decode_label("o_orderstatus", {"F": "YES", "O": "NO"}, "No regen consent record present")
        .alias("regeneration_consent"), "lenders_presented")


@query("rejected_enriched", ids="R1 J5 J7 J8 J9 J22 P2 P4 P5 U3", sql="""
WITH base AS (
  SELECT la.o_orderkey AS lead_id, la.o_custkey AS user_id, la.o_orderstatus AS product_status,
         la.o_orderdate AS applied_date,
         count(*) AS fanout_rows,
         max(CASE WHEN regexp_matches(lender_rows.o_orderstatus, 'f', 'i') AND lender_rows.o_orderdate >= TIMESTAMP '2000-01-01' THEN 1 END) AS lender_applied_2years_flag,
         max(CASE WHEN regexp_matches(lender_rows.o_orderstatus, 'f', 'i') THEN 1 END) AS lender_applied_ever_flag
  FROM orders la
  LEFT JOIN LATERAL (SELECT * FROM orders app WHERE app.o_custkey = la.o_custkey) lender_rows ON TRUE
  WHERE regexp_matches(la.o_orderpriority, '(3-|4-)', 'i') AND la.o_orderdate >= TIMESTAMP '1998-01-01'
  GROUP BY 1, 2, 3, 4
)
SELECT b.*,
  (SELECT o2.o_orderdate FROM orders o2 WHERE o2.o_custkey = b.user_id ORDER BY o2.o_orderdate LIMIT 1) AS first_profile_date,
  CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Green' WHEN c.c_mktsegment = 'MACHINERY' THEN 'Red'
       WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Amber' END AS customer_type,
  (SELECT e.event_id FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'signup'
   ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) AS tkn,
  coalesce((SELECT e.value FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'purchase'
            ORDER BY e.ts DESC, e.event_id DESC LIMIT 1),
           (SELECT e.value FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'view'
            ORDER BY e.ts DESC, e.event_id DESC LIMIT 1)) AS monthly_income,
  CAST(date_part('year', age(DATE '2024-01-30', CAST(DATE '1960-01-01' + CAST((b.user_id * 37) % 18000 AS INTEGER) AS DATE))) AS INTEGER) AS age,
  (SELECT e.ts FROM events e WHERE e.user_id = b.user_id ORDER BY e.ts DESC LIMIT 1) AS latest_login_date
FROM base b JOIN customer c ON c.c_custkey = b.user_id
WHERE b.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 98)
""")
def rejected_enriched(spark, d, *, since="1998-01-01", recent="2000-01-01", run_date="2024-01-30", min_error=98):
    """Rejected leads applied since ``since``, with whether their user applied at the
    lender since ``recent`` or ever, and the age on ``run_date``; users with an error
    above ``min_error`` are suppressed."""
    from funnelkit.functions.expr import age_years
    from funnelkit.operators.member import suppress
    t = Tables(spark, d)
    la = t.orders.where(imatch("o_orderpriority", "(3-|4-)") & (F.col("o_orderdate") >= _ts(since)))
    # the fan-out lateral (every lead x all of its user's leads) is kept as its
    # multiplicity and the per-pair flags as aggregates per user
    f = imatch("o_orderstatus", "f")
    per_user = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count(F.lit(1)).alias("fanout_rows"),
        F.max(F.when(f & (F.col("o_orderdate") >= _ts(recent)), 1)).alias("lender_applied_2years_flag"),
        F.max(F.when(f, 1)).alias("lender_applied_ever_flag"),
        F.min("o_orderdate").alias("first_profile_date"))
    base = la.select(F.col("o_orderkey").alias("lead_id"), F.col("o_custkey").alias("user_id"),
                     F.col("o_orderstatus").alias("product_status"), F.col("o_orderdate").alias("applied_date"))
    cust = t.customer.select(F.col("c_custkey").alias("user_id"),
                             decode_label("c_mktsegment", SEGMENT_LABELS).alias("customer_type"))
    out = (base.join(per_user, "user_id", "left").join(cust, "user_id", "inner")
           .join(_user_event_lookups(t), "user_id", "left"))
    out = suppress(out, t.events.where((F.col("event_type") == "error") & (F.col("value") > min_error)),
                   "user_id", "user_id")
    dob = F.date_add(F.lit("1960-01-01").cast("date"), ((F.col("user_id") * 37) % 18000).cast("int"))
    return out.select(
        "lead_id", "user_id", "product_status", "applied_date", "fanout_rows", "lender_applied_2years_flag",
        "lender_applied_ever_flag", "first_profile_date", "customer_type", "tkn",
        F.coalesce("__last_purchase_value", "__last_view_value").alias("monthly_income"),
        age_years(dob, run_date).alias("age"), "latest_login_date")


@query("rest_of_base", ids="R7 C4 J6 J22 J23 F5 F11 P4 A22", sql="""
WITH base AS (
  SELECT c.c_custkey AS user_id, c.c_acctbal AS credit_score, c.c_mktsegment AS employment_type,
         CAST(c.c_custkey AS VARCHAR) AS pincode
  FROM customer c
  LEFT JOIN LATERAL (SELECT o.o_orderstatus AS last1mnth_status FROM orders o
                     WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '2001-01-01'
                       AND o.o_orderstatus = 'P') acct ON TRUE
  WHERE c.c_acctbal >= 500
    AND (regexp_matches(c.c_mktsegment, '(build|auto)', 'i') OR c.c_mktsegment IS NULL)
    AND CAST(c.c_custkey AS VARCHAR) NOT BETWEEN '500' AND '550'
    AND acct.last1mnth_status IS NULL
),
b2 AS (
  SELECT b.*, high_value.high_value_flag, es_1.recent_urgent_flag, es_2.recent_high_flag
  FROM base b
  LEFT JOIN LATERAL (SELECT DISTINCT '1' AS high_value_flag FROM orders x
                     WHERE x.o_custkey = b.user_id AND x.o_totalprice > 450000) high_value ON TRUE
  LEFT JOIN LATERAL (SELECT DISTINCT '1' AS recent_urgent_flag FROM orders x
                     WHERE x.o_custkey = b.user_id AND x.o_orderpriority = '1-URGENT'
                       AND x.o_orderdate >= TIMESTAMP '2000-01-01') es_1 ON TRUE
  LEFT JOIN LATERAL (SELECT DISTINCT '1' AS recent_high_flag FROM orders x
                     WHERE x.o_custkey = b.user_id AND x.o_orderpriority = '2-HIGH'
                       AND x.o_orderdate >= TIMESTAMP '2000-01-01') es_2 ON TRUE
)
SELECT b.*,
       CASE WHEN b.credit_score >= 1500 AND b.user_id % 100 >= 22 AND b.user_id % 100 <= 45 THEN '1' END AS income_age_flag,
       (SELECT e.event_id FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'signup'
        ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) AS tkn,
       (SELECT e.ts FROM events e WHERE e.user_id = b.user_id ORDER BY e.ts DESC LIMIT 1) AS latest_login_date
FROM b2 b
WHERE b.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 98)
""")
def rest_of_base(spark, d, *, status_since="2001-01-01", since="2000-01-01", min_score=500, pincodes=("500", "550"),
                 min_error=98):
    """Profiles of a score of ``min_score`` at least, outside the range of ``pincodes`` and
    without an account since ``status_since``; flags look back to ``since``, and users
    with an error above ``min_error`` are suppressed."""
    from funnelkit.functions.expr import flag_when, text_between
    from funnelkit.operators.member import attach_flag, suppress
    t = Tables(spark, d)
    base = t.customer.where((F.col("c_acctbal") >= min_score) &
                            (imatch("c_mktsegment", "(build|auto)") | F.col("c_mktsegment").isNull()) &
                            text_between(F.col("c_custkey").cast("string"), *pincodes, negate=True))
    recent_p = t.orders.where((F.col("o_orderdate") >= _ts(status_since)) & (F.col("o_orderstatus") == "P"))
    base = anti(base, recent_p, [("c_custkey", "o_custkey")]).select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("credit_score"),
        F.col("c_mktsegment").alias("employment_type"), F.col("c_custkey").cast("string").alias("pincode"))
    recent = F.col("o_orderdate") >= _ts(since)
    for name, members in [("high_value_flag", t.orders.where(F.col("o_totalprice") > 450000)),
                          ("recent_urgent_flag", t.orders.where((F.col("o_orderpriority") == "1-URGENT") & recent)),
                          ("recent_high_flag", t.orders.where((F.col("o_orderpriority") == "2-HIGH") & recent))]:
        base = attach_flag(base, members, "user_id", name, "o_custkey")
    age = F.col("user_id") % 100
    out = base.withColumn("income_age_flag", flag_when((F.col("credit_score") >= 1500) & (age >= 22) & (age <= 45), "1"))
    out = out.join(_user_event_lookups(t).select("user_id", "tkn", "latest_login_date"), "user_id", "left")
    return suppress(out, t.events.where((F.col("event_type") == "error") & (F.col("value") > min_error)),
                    "user_id", "user_id")


@query("lead_journey", ids="R25 C12 U1 J7 J11 J24 W1 A9 A6 A15 A23 F2 P2", sql="""
WITH lines AS (
  SELECT l_orderkey AS lead_id, l_shipdate AS log_date, l_linenumber, l_returnflag || '-' || l_linestatus AS status,
         l_returnflag, l_partkey, l_quantity FROM lineitem
),
calls AS (
  SELECT o.o_custkey AS user_id, l.l_shipdate, l.l_orderkey, l.l_linenumber,
         l.l_returnflag || '-' || l.l_linestatus AS utm
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
),
cl AS (
  SELECT o_orderkey AS lead_id, o_custkey AS user_id, o_orderdate AS updated_at, o_orderpriority AS product,
         o_orderstatus AS product_status
  FROM orders
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' AND o_orderstatus IN ('F', 'O')
),
base AS (
  SELECT cl.*, (SELECT max(x.log_date) FROM lines x WHERE x.lead_id = cl.lead_id AND x.l_returnflag = 'R') AS applied_date
  FROM cl
)
SELECT b.user_id,
  CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Green' WHEN c.c_mktsegment = 'MACHINERY' THEN 'Red'
       WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Amber' ELSE 'NH' END AS customer_type,
  (SELECT k.utm FROM calls k WHERE k.user_id = b.user_id AND k.l_shipdate < b.updated_at
   ORDER BY k.l_shipdate DESC, k.l_orderkey DESC, k.l_linenumber DESC, k.utm DESC LIMIT 1) AS latest_utm_source,
  cp.o_totalprice AS credit_score,
  b.lead_id, b.updated_at, b.product, b.product_status,
  (SELECT x.status FROM lines x WHERE x.lead_id = b.lead_id ORDER BY x.log_date, x.l_linenumber, x.status LIMIT 1) AS first_call_stage,
  (SELECT x.status FROM lines x WHERE x.lead_id = b.lead_id AND x.l_returnflag <> 'N'
   ORDER BY x.log_date, x.l_linenumber, x.status LIMIT 1) AS first_contact_stage,
  (SELECT DISTINCT s.status FROM (SELECT x.status, dense_rank() OVER (ORDER BY x.log_date DESC, x.status DESC) AS rk
                                  FROM lines x WHERE x.lead_id = b.lead_id) s WHERE s.rk = 2) AS prior_stage,
  (SELECT CASE WHEN bool_and(x.l_returnflag = 'N') THEN 'NC' WHEN bool_or(x.l_returnflag = 'N') THEN 'Contact'
               ELSE 'No Call' END FROM lines x WHERE x.lead_id = b.lead_id) AS call_state,
  f.pass_rf, f.pass_bulk, b.applied_date, ap.active_profile_id,
  (SELECT string_agg('q' || CAST(q.l_partkey AS VARCHAR) || '=' || CAST(q.l_quantity AS VARCHAR), ';' ORDER BY q.l_partkey)
   FROM (SELECT DISTINCT ON (x.l_partkey) x.l_partkey, x.l_quantity FROM lines x WHERE x.lead_id = b.lead_id
         ORDER BY x.l_partkey, x.log_date DESC, x.l_quantity DESC, x.l_linenumber DESC) q) AS answers,
  CASE WHEN EXISTS (SELECT 1 FROM orders o2 WHERE o2.o_custkey = b.user_id AND o2.o_orderpriority = b.product
                    AND o2.o_orderdate < b.updated_at AND regexp_matches(o2.o_orderstatus, 'f$', 'i'))
       THEN 1 ELSE 0 END AS duplicate_lead
FROM base b
LEFT JOIN customer c ON c.c_custkey = b.user_id
LEFT JOIN LATERAL (SELECT max(o2.o_orderkey) AS active_profile_id FROM orders o2
                   WHERE o2.o_custkey = b.user_id
                     AND o2.o_orderdate <= coalesce(b.applied_date, 'infinity'::TIMESTAMP)) ap ON TRUE
LEFT JOIN orders cp ON cp.o_orderkey = ap.active_profile_id
LEFT JOIN LATERAL (SELECT bool_or(regexp_matches(x.status, 'r-f$', 'i'))::INTEGER AS pass_rf,
                          bool_or(x.l_quantity >= 40)::INTEGER AS pass_bulk
                   FROM lines x WHERE x.lead_id = b.lead_id) f ON TRUE
""")
def lead_journey(spark, d, *, first_day="1997-01-01", last_day="1997-03-31"):
    from funnelkit.operators.agg import join_strings
    from funnelkit.operators.lookup import nth_state
    from funnelkit.operators.member import flag_earlier_exists
    from funnelkit.sources.sinks import cut_lineage
    t = Tables(spark, d)
    leads = t.orders.where(day_window("o_orderdate", first_day, last_day) & F.col("o_orderstatus").isin("F", "O")) \
        .select(F.col("o_orderkey").alias("lead_id"), F.col("o_custkey").alias("user_id"),
                F.col("o_orderdate").alias("updated_at"), F.col("o_orderpriority").alias("product"),
                F.col("o_orderstatus").alias("product_status"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("lead_id"), F.col("l_shipdate").alias("log_date"),
                              "l_linenumber", F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("status"),
                              "l_returnflag", "l_partkey", "l_quantity")
    # report leads are a narrow window: restrict every log to those leads (or
    # their users) with a semi join before aggregating, since an aggregate
    # below a join cannot be filtered by it
    # The leads, their lines and their users' orders serve several lookups each: they are
    # read once and kept in the checkpoint folder
    leads, all_lines = cut_lineage(leads), lines
    lines = cut_lineage(lines.join(leads.select("lead_id"), "lead_id", "left_semi"))
    lead_users = leads.select("user_id").distinct()
    order = ["log_date", "l_linenumber", "status"]
    nc = F.col("l_returnflag") == "N"
    # every per-lead lookup on the lead's log in one aggregation pass
    per_lead = lines.groupBy("lead_id").agg(
        first_by("status", order).alias("first_call_stage"),
        first_by("status", order, where=~nc).alias("first_contact_stage"),
        F.bool_and(nc).alias("__all_nc"), F.bool_or(nc).alias("__any_nc"),
        milestone(imatch("status", "r-f$")).alias("pass_rf"),
        milestone(F.col("l_quantity") >= 40).alias("pass_bulk"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("log_date"))).alias("applied_date"))
    prior = nth_state(lines, "lead_id", "log_date", "status", out="prior_stage").drop("prior_stage_at")
    latest_answer = first_per(lines, ["lead_id", "l_partkey"], ["log_date", "l_quantity", "l_linenumber"],
                              ["l_quantity"], last=True)
    answers = latest_answer.groupBy("lead_id").agg(join_strings(
        F.concat(F.lit("q"), F.col("l_partkey").cast("string"), F.lit("="), F.col("l_quantity").cast("string")),
        ";", order="l_partkey").alias("answers"))
    user_orders = cut_lineage(t.orders.join(lead_users.withColumnRenamed("user_id", "o_custkey"), "o_custkey", "left_semi")
                              .select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus"))
    dup = flag_earlier_exists(user_orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate",
                                                 "o_orderstatus"),
                              ["o_custkey", "o_orderpriority"], "o_orderdate", imatch("o_orderstatus", "f$"),
                              "duplicate_lead").select(F.col("o_orderkey").alias("lead_id"), "duplicate_lead")
    base = leads.join(per_lead, "lead_id", "left")
    # latest source of the user before the lead (as-of), active profile = the
    # user's largest order key on/before the applied date (prefix max)
    src = all_lines.join(user_orders.select(F.col("o_orderkey").alias("lead_id"),
                                            F.col("o_custkey").alias("user_id")),
                         "lead_id").select("user_id", F.col("log_date").alias("src_t"),
                                       F.col("lead_id").alias("src_lead"), "l_linenumber",
                                       F.col("status").alias("latest_utm_source"))
    hot = hot_keys_for(user_orders, "o_custkey", "o_orderdate", holds_right=True)
    source = asof_join(leads.select("lead_id", "user_id", "updated_at"), src, "user_id", "updated_at", "src_t",
                       ["latest_utm_source"], tiebreak=["src_lead", "l_linenumber"], hot=hot.open_ended()) \
        .select("lead_id", "latest_utm_source")
    profiles = user_orders.select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    # without an applied date the bound is open: the user's largest order key
    active = range_agg(base.select("lead_id", "user_id", "applied_date"), profiles, "user_id", "applied_date",
                       "o_orderdate", {"active_profile_id": ("max", F.col("o_orderkey"))}, inclusive=True,
                       hot=hot).select("lead_id", "active_profile_id")
    # both lookups start from the leads and meet on the lead
    base = base.join(source, "lead_id", "left").join(active, "lead_id", "left")
    credit = t.orders.select(F.col("o_orderkey").alias("active_profile_id"), F.col("o_totalprice").alias("credit_score"))
    out = (base.join(credit, "active_profile_id", "left").join(prior, "lead_id", "left")
           .join(answers, "lead_id", "left").join(dup, "lead_id", "left").join(_segment_label(t), "user_id", "left"))
    return out.select(
        "user_id", "customer_type", "latest_utm_source", "credit_score", "lead_id", "updated_at", "product",
        "product_status", "first_call_stage", "first_contact_stage", "prior_stage",
        F.when(F.col("__all_nc"), "NC").when(F.col("__any_nc"), "Contact").otherwise("No Call").alias("call_state"),
        "pass_rf", "pass_bulk", "applied_date", "active_profile_id", "answers", "duplicate_lead")
