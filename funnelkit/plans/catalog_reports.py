"""Report-level queries (C2-C5, C8, C10-C14; R1-R26) bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelkit.functions.calendar import days_in_month
from funnelkit.functions.expr import (decode_label, imatch, month_diff, month_offset_label,
                                      text_between, upper_strings, vintage_bucket)
from funnelkit.operators.agg import join_distinct, last_by, milestone
from funnelkit.operators.lookup import (agg_per_key, asof_join, first_per, hot_keys_for, lookback_join,
                                        lookup_latest, nth_state)
from funnelkit.operators.member import attach_flag, flag_earlier_exists, semi, suppress
from funnelkit.plans.registry import Tables, query
from funnelkit.sources.tables import maybe_in
from funnelkit.plans.reports import attribution_owner, conversion_matrix, pacing, recency_flags

# Fixed run parameters of the registered reports.
M0, M1, M2, CONV_END = "2001-06-01", "2001-05-01", "2001-04-01", "2001-06-30"
PAY_START, PAY_END = "2024-01-10", "2024-01-31"
PREV_MON_START, PREV_5_MONTH_START = "2024-01-15", "2024-01-05"
SEGMENT_LABELS = {"BUILDING": "Green", "MACHINERY": "Red", "AUTOMOBILE": "Amber"}
PACE_DAY, PACE_MONTH_START, PLAN_MONTH = "2001-06-14", "2001-06-01", ("2000-06-01", "2000-07-01")
TEAMS = ["System", "PA", "Allset", "Regeneration", "Assisted"]
WORKING_DAY_TEAMS = {"Assisted": (25, 10), "Allset": (25, 10)}   # team -> (days in month, days past)


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


@query("cohort_conversion_matrix", ids="C2 R4 DT9 SRC8 A3", sql="""
WITH prof AS (SELECT o_custkey, min(o_orderdate) AS first_profile_date FROM orders GROUP BY 1),
base AS (
  SELECT o.o_custkey AS user_id, o.o_orderkey AS lead_id, p.first_profile_date AS profiled_date,
         o.o_orderdate AS applied_date
  FROM orders o JOIN prof p ON p.o_custkey = o.o_custkey JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE o.o_orderdate >= TIMESTAMP '2001-04-01' AND o.o_orderdate <= TIMESTAMP '2001-06-30'
    AND regexp_matches(c.c_mktsegment, '(building|machinery)', 'i')
)
SELECT
  CASE WHEN cp.profiled_date >= TIMESTAMP '2001-06-01' THEN 'M0'
       WHEN cp.profiled_date >= TIMESTAMP '2001-05-01' AND cp.profiled_date < TIMESTAMP '2001-06-01' THEN 'M1'
       WHEN cp.profiled_date >= TIMESTAMP '2001-04-01' AND cp.profiled_date < TIMESTAMP '2001-05-01' THEN 'M2'
       WHEN cp.profiled_date < TIMESTAMP '2001-04-01' THEN 'M2+' END AS vintage,
  count(DISTINCT cp.user_id) FILTER (WHERE cp.profiled_date >= TIMESTAMP '2001-06-01') AS "2001-06-01 profiled",
  count(DISTINCT cp.user_id) FILTER (WHERE cp.profiled_date >= TIMESTAMP '2001-05-01' AND cp.profiled_date < TIMESTAMP '2001-06-01') AS "2001-05-01 profiled",
  count(DISTINCT cp.user_id) FILTER (WHERE cp.profiled_date >= TIMESTAMP '2001-04-01' AND cp.profiled_date < TIMESTAMP '2001-05-01') AS "2001-04-01 profiled",
  count(DISTINCT cp.user_id) FILTER (WHERE cp.profiled_date < TIMESTAMP '2001-04-01') AS "M2+ profiled",
  count(DISTINCT cp.lead_id) FILTER (WHERE cp.applied_date >= TIMESTAMP '2001-06-01') AS "2001-06-01 applied",
  count(DISTINCT cp.lead_id) FILTER (WHERE cp.applied_date >= TIMESTAMP '2001-05-01' AND cp.applied_date < TIMESTAMP '2001-06-01') AS "2001-05-01 applied",
  count(DISTINCT cp.lead_id) FILTER (WHERE cp.applied_date >= TIMESTAMP '2001-04-01' AND cp.applied_date < TIMESTAMP '2001-05-01') AS "2001-04-01 applied",
  count(DISTINCT cp.lead_id) FILTER (WHERE cp.applied_date < TIMESTAMP '2001-04-01') AS "M2+ applied",
  count(DISTINCT converted.lead_id) FILTER (WHERE converted.booking_date >= TIMESTAMP '2001-06-01') AS "2001-06-01 conversion",
  count(DISTINCT converted.lead_id) FILTER (WHERE converted.booking_date >= TIMESTAMP '2001-05-01' AND converted.booking_date < TIMESTAMP '2001-06-01') AS "2001-05-01 conversion",
  count(DISTINCT converted.lead_id) FILTER (WHERE converted.booking_date >= TIMESTAMP '2001-04-01' AND converted.booking_date < TIMESTAMP '2001-05-01') AS "2001-04-01 conversion",
  count(DISTINCT converted.lead_id) FILTER (WHERE converted.booking_date < TIMESTAMP '2001-04-01') AS "M2+ conversion"
FROM base cp
LEFT JOIN LATERAL (
  SELECT DISTINCT steps.o_orderkey AS lead_id, steps.o_custkey AS user_id, steps.o_orderdate AS booking_date
  FROM orders steps
  WHERE steps.o_custkey = cp.user_id AND steps.o_orderdate >= cp.profiled_date
    AND steps.o_orderdate <= TIMESTAMP '2001-06-30' AND regexp_matches(steps.o_orderstatus, 'F', 'i')
) converted ON TRUE
GROUP BY 1
""")
def cohort_conversion_matrix(spark, d, *, m0=M0, m1=M1, m2=M2, end=CONV_END):
    t = Tables(spark, d)
    at = F.col("o_orderdate")
    window = (at >= _ts(m2)) & (at <= _ts(end))
    # one aggregate of the users' orders: their profile date, and whether they applied in the window
    prof = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("profiled_date"), F.bool_or(window).alias("__in")) \
        .where("__in").drop("__in")
    seg = t.customer.where(imatch("c_mktsegment", "(building|machinery)")).select(
        F.col("c_custkey").alias("o_custkey"))
    leads = t.orders.where(at <= _ts(end)).join(prof.join(seg, "o_custkey", "left_semi"), "o_custkey").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("lead_id"), "profiled_date",
        F.when(window, at).alias("applied_date"), F.when(imatch("o_orderstatus", "F"), at).alias("booking_date"))
    return conversion_matrix(leads, user="user_id", lead="lead_id", profiled="profiled_date",
                             applied="applied_date", booked="booking_date",
                             m0=m0, m1=m1, m2=m2, end=end)


def _utm_source(k, et):
    return (F.when(et == "click", F.concat(F.lit("CRM-A"), k))
            .when(et == "view", F.when(k % 5 == 0, F.concat(F.lit("email-monitoring-"), k))
                  .otherwise(F.concat(F.lit("email-"), k)))
            .when(et == "signup", F.when(k % 2 == 0, F.concat(F.lit("B"), k, F.lit("_androidapp")))
                  .otherwise(F.concat(F.lit("crm-b"), k)))
            .otherwise(F.concat(F.lit("error-"), k)))


_UTM_SQL = """CASE event_type
      WHEN 'click' THEN 'CRM-A' || k
      WHEN 'view' THEN CASE WHEN k % 5 = 0 THEN 'email-monitoring-' || k ELSE 'email-' || k END
      WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'B' || k || '_androidapp' ELSE 'crm-b' || k END
      ELSE 'error-' || k END"""


def _attribution_sql(where: str = "") -> str:
    return f"""
WITH ev AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
src AS (SELECT user_id, ts AS created_at, event_id, {_UTM_SQL} AS utm_source_text
        FROM ev WHERE event_type <> 'purchase'),
contacts AS (SELECT user_id, ts AS updated_at, event_id, 'oic-' || CAST(event_id % 17 AS VARCHAR) AS oic,
                    value FROM ev WHERE event_type = 'view'),
pay AS (SELECT DISTINCT ON (user_id) user_id, event_id, ts AS payment_date FROM ev
        WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-31' {where}
        ORDER BY user_id, ts, event_id),
j AS (
  SELECT vs.user_id,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Green' WHEN c.c_mktsegment = 'MACHINERY' THEN 'Red'
              WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Amber' ELSE 'NH' END AS customer_type,
         vs.event_id, vs.payment_date,
         CASE WHEN prof2.first_profile_date >= TIMESTAMP '2024-01-15' AND prof2.first_profile_date < TIMESTAMP '2024-01-31' THEN 'V0'
              WHEN prof2.first_profile_date >= TIMESTAMP '2024-01-05' AND prof2.first_profile_date < TIMESTAMP '2024-01-15' THEN 'V1'
              WHEN prof2.first_profile_date < TIMESTAMP '2024-01-05' THEN 'V2'
              ELSE strftime(prof2.first_profile_date, '%Y-%m') END AS profile_vintage,
         CASE WHEN (year(DATE '2024-01-10') - year(prof2.first_profile_date)) * 12 + month(DATE '2024-01-10') - month(prof2.first_profile_date) <= 6
              THEN 'M-' || CAST((year(DATE '2024-01-10') - year(prof2.first_profile_date)) * 12 + month(DATE '2024-01-10') - month(prof2.first_profile_date) AS VARCHAR)
              ELSE 'M-6 >' END AS profile_vintage_m,
         login_src.utm_source_text,
         (SELECT max(x.updated_at) FROM contacts x WHERE x.user_id = vs.user_id AND x.value > 90) AS sms_sent_on,
         lc.oic AS lc_oic
  FROM pay vs
  LEFT JOIN customer c ON c.c_custkey = vs.user_id
  LEFT JOIN LATERAL (SELECT utm_source_text FROM src WHERE src.user_id = vs.user_id
                     AND src.created_at < vs.payment_date ORDER BY created_at DESC, event_id DESC LIMIT 1) login_src ON TRUE
  LEFT JOIN LATERAL (SELECT oic FROM contacts x WHERE x.user_id = vs.user_id AND x.value > 20
                     AND x.updated_at >= vs.payment_date - INTERVAL 48 HOUR AND x.updated_at < vs.payment_date
                     ORDER BY x.updated_at, x.event_id LIMIT 1) lc ON TRUE
  LEFT JOIN LATERAL (SELECT min(ts) AS first_profile_date FROM ev WHERE ev.user_id = vs.user_id
                     AND ev.event_type = 'signup') prof2 ON TRUE
)
SELECT user_id, customer_type, event_id, payment_date, profile_vintage, profile_vintage_m,
       utm_source_text, sms_sent_on,
       CASE WHEN regexp_matches(utm_source_text, '(^cis-pa|^email|^sms|sms$)', 'i')
                 AND NOT regexp_matches(utm_source_text, 'monitoring', 'i') THEN 'PORTFOLIO'
            WHEN regexp_matches(utm_source_text, '^(CRM|byssms|chrsms|bhrsms)-[A-Z0-9]+$', 'i')
                 AND regexp_matches(regexp_extract(utm_source_text, '^[^-]*-(.*)$', 1), '[0-9]')
                 AND regexp_matches(regexp_extract(utm_source_text, '^[^-]*-(.*)$', 1), '[A-Z]', 'i')
              THEN nullif(regexp_extract(utm_source_text, '-([A-Z0-9]+)$', 1), '')
            WHEN regexp_matches(utm_source_text, '^(CRM|bysemail|chremail|bhremail)-[A-Z0-9]+$', 'i')
                 AND regexp_matches(regexp_extract(utm_source_text, '^[^-]*-(.*)$', 1), '[0-9]')
                 AND regexp_matches(regexp_extract(utm_source_text, '^[^-]*-(.*)$', 1), '[A-Z]', 'i')
              THEN nullif(regexp_extract(utm_source_text, '-([A-Z0-9]+)$', 1), '')
            WHEN regexp_matches(utm_source_text, '^[A-Z0-9]+_androidapp')
                 AND regexp_matches(regexp_extract(utm_source_text, '^([A-Z0-9]+)_', 1), '[0-9]')
                 AND regexp_matches(regexp_extract(utm_source_text, '^([A-Z0-9]+)_', 1), '[A-Z]')
              THEN nullif(regexp_extract(utm_source_text, '^([A-Z0-9]+)_', 1), '')
            WHEN lc_oic IS NOT NULL THEN lc_oic
            ELSE 'System' END AS oic
FROM j
"""


# Role bindings: a payment's service and sub-owner on the driver tables.
_SERVICE_SQL = "CASE WHEN value < 35 THEN 'S0' WHEN value < 70 THEN 'S1' ELSE 'S2' END"
_SUB_OWNER_SQL = "'sub-' || CAST(k // 20 AS VARCHAR)"


@query("attribution_cascade", ids="C3 U1 J10 J13 J29 A23 P2 DT3 DT9 U2 F7 F8 F9 STR3", sql=_attribution_sql())
def attribution_cascade(spark, d, *, start=PAY_START, end=PAY_END, prev_mon_start=PREV_MON_START,
                        prev5_month_start=PREV_5_MONTH_START, services=None, owners=None):
    """Payments of a window with the owner each is attributed to. ``services`` and
    ``owners`` are optional lists: absent, all services and owners are reported."""
    t = Tables(spark, d)
    ev = t.events.withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    src = ev.where(F.col("event_type") != "purchase").select(
        "user_id", F.col("ts").alias("src_ts"), F.col("event_id").alias("src_id"),
        _utm_source(F.col("k"), F.col("event_type")).alias("utm_source_text"))
    contacts = ev.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("contact_ts"), F.col("event_id").alias("contact_id"), "value",
        F.concat(F.lit("oic-"), (F.col("event_id") % 17).cast("string")).alias("lc_oic"))
    pays = ev.where((F.col("event_type") == "purchase") & (F.col("ts") >= _ts(start)) &
                    (F.col("ts") < _ts(end)))
    pays = pays.withColumns({
        "service": F.when(F.col("value") < 35, "S0").when(F.col("value") < 70, "S1").otherwise("S2"),
        "sub_owner": F.concat(F.lit("sub-"), F.floor(F.col("k") / 20).cast("string"))})
    pays = maybe_in(maybe_in(pays, "service", services), "sub_owner", owners)
    pay = first_per(pays, "user_id", ["ts", "event_id"], ["event_id", "ts"]) \
        .withColumnRenamed("ts", "payment_date")
    # one count of the log's keys serves both lookups
    hot = hot_keys_for(ev, "user_id", "ts", holds_right=True)
    # the two lookups are independent: each runs on the payment rows and the
    # results meet on the payment key (1:1), instead of one lookup re-reading
    # the other's output
    utm = asof_join(pay, src, "user_id", "payment_date", "src_ts", ["utm_source_text"], tiebreak=["src_id"], hot=hot)
    lc = lookback_join(pay, contacts.where(F.col("value") > 20), "user_id", "payment_date", "contact_ts",
                       ["lc_oic"], 48 * 3600, pick="first", tiebreak=["contact_id"], hot=hot)
    x = utm.join(lc.select("user_id", "event_id", "lc_oic"), ["user_id", "event_id"], "left")
    kind = F.col("event_type")
    x = agg_per_key(x, ev, "user_id", [
        F.max(F.when((kind == "view") & (F.col("value") > 90), F.col("ts"))).alias("sms_sent_on"),
        F.min(F.when(kind == "signup", F.col("ts"))).alias("first_profile_date")])
    cust = t.customer.select(F.col("c_custkey").alias("user_id"),
                             decode_label("c_mktsegment", SEGMENT_LABELS, "NH").alias("customer_type"))
    x = x.join(cust, "user_id", "left")
    fp = F.col("first_profile_date")
    return x.select(
        "user_id", "customer_type", "event_id", "payment_date",
        vintage_bucket(fp, prev_mon_start, end, prev5_month_start).alias("profile_vintage"),
        month_offset_label(month_diff(fp, F.lit(start).cast("date"))).alias("profile_vintage_m"),
        "utm_source_text", "sms_sent_on",
        attribution_owner(F.col("utm_source_text"), F.col("lc_oic")).alias("oic"))


@query("payments_single_service", ids="R13 SRC7", sql=_attribution_sql(f"AND {_SERVICE_SQL} IN ('S0')"))
def payments_single_service(spark, d, *, owners=None, **dates):
    """Payments of one service."""
    return attribution_cascade(spark, d, services=["S0"], owners=owners, **dates)


@query("payments_service_family", ids="R14 SRC7", sql=_attribution_sql(f"AND {_SERVICE_SQL} IN ('S1', 'S2')"))
def payments_service_family(spark, d, *, owners=None, **dates):
    """Payments of a family of services (``payment_holdings`` has the payers' accounts)."""
    return attribution_cascade(spark, d, services=["S1", "S2"], owners=owners, **dates)


@query("payments_owner_list", ids="R15 SRC7", sql=_attribution_sql(
    f"AND {_SERVICE_SQL} IN ('S2') AND {_SUB_OWNER_SQL} IN ('sub-1', 'sub-4')"))
def payments_owner_list(spark, d, *, owners=("sub-1", "sub-4"), **dates):
    """Payments of a service, restricted to a list of owners."""
    return attribution_cascade(spark, d, services=["S2"], owners=owners, **dates)


@query("cohort_suppressed", ids="C4 C5 J6 J7 J20 J22 F5 P5 A8", sql="""
WITH base AS (
  SELECT c.c_custkey, c.c_mktsegment,
         coalesce((SELECT o.o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O'
                   ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 1), c.c_acctbal) AS monthly_income
  FROM customer c
  WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
    AND CAST(c.c_custkey AS VARCHAR) NOT BETWEEN '500' AND '550'
    AND c.c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 5000)
)
SELECT b.c_custkey, b.c_mktsegment, b.monthly_income, f.*,
       CASE WHEN b.c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) THEN '1' END AS hv_flag
FROM base b
LEFT JOIN LATERAL (
  SELECT coalesce(bool_or(o_orderdate >= TIMESTAMP '2001-01-01')::INTEGER, 0) AS urgent_d0,
         coalesce(bool_or(o_orderdate < TIMESTAMP '2001-01-01' AND o_orderdate >= TIMESTAMP '2000-01-01')::INTEGER, 0) AS urgent_d1,
         coalesce(bool_or(o_orderdate < TIMESTAMP '2000-01-01' AND o_orderdate >= TIMESTAMP '1999-01-01')::INTEGER, 0) AS urgent_d2,
         coalesce(bool_or(o_orderdate < TIMESTAMP '1999-01-01')::INTEGER, 0) AS urgent_old,
         coalesce(bool_or(regexp_matches(o_orderstatus, 'f', 'i'))::INTEGER, 0) AS urgent_f,
         coalesce(bool_or(true)::INTEGER, 0) AS urgent_any,
         coalesce(bool_or(o_orderstatus IN ('O'))::INTEGER, 0) AS urgent_o
  FROM orders o WHERE o.o_custkey = b.c_custkey AND o.o_orderpriority IN ('1-URGENT')
) f ON TRUE
""")
def cohort_suppressed(spark, d, *, d0="2001-01-01", d1="2000-01-01", d2="1999-01-01", pincodes=("500", "550"),
                      min_price=5000, high_value=450000):
    """Urgent leads' profiles outside the range of ``pincodes`` and without a pending lead
    below ``min_price``, with recency since ``d0``, from ``d1`` and from ``d2``."""
    t = Tables(spark, d)
    urgent, status = F.col("o_orderpriority").isin("1-URGENT"), F.col("o_orderstatus")
    # every fact about a user's orders in one pass over them
    per = recency_flags(t.orders, user="o_custkey", t="o_orderdate", d0=d0, d1=d1, d2=d2,
                        groups={"urgent": urgent}, more=[
                            milestone(urgent & imatch("o_orderstatus", "f"), 0).alias("urgent_f"),
                            milestone(urgent, 0).alias("urgent_any"),
                            milestone(urgent & status.isin("O"), 0).alias("urgent_o"),
                            last_by("o_totalprice", ["o_orderdate", "o_orderkey"], where=status == "O").alias("__latest"),
                            F.when(F.bool_or(F.col("o_totalprice") > high_value), "1").alias("hv_flag")])
    base = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal") \
        .where(text_between(F.col("c_custkey").cast("string"), *pincodes, negate=True))
    base = suppress(base, t.orders.where((status == "P") & (F.col("o_totalprice") < min_price)), "c_custkey", "o_custkey")
    out = base.join(per.where("urgent_any = 1").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
    return out.select("c_custkey", "c_mktsegment", F.coalesce("__latest", "c_acctbal").alias("monthly_income"),
                      "urgent_d0", "urgent_d1", "urgent_d2", "urgent_old", "urgent_f", "urgent_any", "urgent_o", "hv_flag")


def _team():
    return (F.when(F.col("o_totalprice") > 250000, "PA")
            .when(imatch("o_orderpriority", "urgent"), "Allset")
            .when(F.col("o_orderstatus") == "F", "Assisted")
            .when(F.col("o_custkey") % 10 == 0, "Regeneration").otherwise("System"))


_TEAM_SQL = """CASE WHEN o.o_totalprice > 250000 THEN 'PA'
            WHEN regexp_matches(o.o_orderpriority, 'urgent', 'i') THEN 'Allset'
            WHEN o.o_orderstatus = 'F' THEN 'Assisted'
            WHEN o.o_custkey % 10 = 0 THEN 'Regeneration' ELSE 'System' END"""

_KEYS_SQL = """upper(c.c_mktsegment) AS customer_type, upper(o.o_orderstatus) AS product,
       upper(split_part(o.o_orderpriority, '-', 2)) AS sku"""


def _orders_keyed(t):
    return t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"),
                         "o_custkey").select(
        "o_orderkey", "o_orderdate", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus",
        F.col("c_mktsegment").alias("customer_type"), F.col("o_orderstatus").alias("product"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("sku"))


def targets_wide(t, plan_month=PLAN_MONTH):
    """Monthly plan per (customer type, product, SKU) and team, one column per
    team (the wide target sheet), derived from the same month a year earlier."""
    o = _orders_keyed(t).where((F.col("o_orderdate") >= _ts(plan_month[0])) &
                               (F.col("o_orderdate") < _ts(plan_month[1])))
    team = _team()
    w = o.groupBy("customer_type", "product", "sku").agg(
        *[(F.count(F.when(team == n, 1)) * 2).alias(n) for n in TEAMS])
    return upper_strings(w, ["customer_type", "product", "sku"]).select(
        "customer_type", "product", "sku", *TEAMS)


def targets_long(t, plan_month=PLAN_MONTH, day=PACE_DAY):
    w = targets_wide(t, plan_month)
    long = w.unpivot(["customer_type", "product", "sku"], TEAMS, "attribution", "monthly_plan")
    return long.withColumn("dtd_plan", F.bround(F.col("monthly_plan") / days_in_month(day), 0)
                           .cast("long"))


_WIDE_SQL = f"""
wide AS (
  SELECT {_KEYS_SQL},
         count(*) FILTER (WHERE ({_TEAM_SQL}) = 'System') * 2 AS System,
         count(*) FILTER (WHERE ({_TEAM_SQL}) = 'PA') * 2 AS PA,
         count(*) FILTER (WHERE ({_TEAM_SQL}) = 'Allset') * 2 AS Allset,
         count(*) FILTER (WHERE ({_TEAM_SQL}) = 'Regeneration') * 2 AS Regeneration,
         count(*) FILTER (WHERE ({_TEAM_SQL}) = 'Assisted') * 2 AS Assisted
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE o.o_orderdate >= TIMESTAMP '2000-06-01' AND o.o_orderdate < TIMESTAMP '2000-07-01'
  GROUP BY 1, 2, 3
),
plan AS (
  SELECT customer_type, product, sku, 'System' AS attribution, System AS monthly_plan FROM wide
  UNION ALL SELECT customer_type, product, sku, 'PA', PA FROM wide
  UNION ALL SELECT customer_type, product, sku, 'Allset', Allset FROM wide
  UNION ALL SELECT customer_type, product, sku, 'Regeneration', Regeneration FROM wide
  UNION ALL SELECT customer_type, product, sku, 'Assisted', Assisted FROM wide
)"""


@query("unpivot_targets", ids="RS1 STR7 MA1 U6", sql=f"""
WITH {_WIDE_SQL}
SELECT customer_type, product, sku, attribution, monthly_plan,
       CAST(round_even(monthly_plan / 30, 0) AS BIGINT) AS dtd_plan
FROM plan
""")
def unpivot_targets(spark, d, *, plan_month=PLAN_MONTH, day=PACE_DAY):
    return targets_long(Tables(spark, d), plan_month, day)


@query("pacing", ids="C8 R6 A25 J28 STR8 MA1 DT8", sql=f"""
WITH {_WIDE_SQL},
apps AS (
  SELECT o.o_orderkey AS lead_id, o.o_orderdate AS applied_date, {_KEYS_SQL}, {_TEAM_SQL} AS attribution
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE o.o_orderdate >= TIMESTAMP '2001-06-01' AND o.o_orderdate < TIMESTAMP '2001-06-15'
),
act AS (
  SELECT attribution, customer_type, product, sku,
         count(DISTINCT lead_id) FILTER (WHERE CAST(applied_date AS DATE) = DATE '2001-06-14') AS dtd_actual,
         count(*) AS mtd_actual
  FROM apps GROUP BY 1, 2, 3, 4
),
j AS (
  SELECT a.*, p.monthly_plan, CAST(round_even(p.monthly_plan / 30, 0) AS BIGINT) AS dtd_plan,
         CASE WHEN a.attribution IN ('Assisted', 'Allset') THEN 25 ELSE 30 END AS dm,
         CASE WHEN a.attribution IN ('Assisted', 'Allset') THEN 10 ELSE 14 END AS dp
  FROM act a LEFT JOIN (SELECT * FROM plan WHERE monthly_plan <> 0) p
    ON p.attribution = a.attribution AND p.customer_type = a.customer_type
   AND p.product = a.product AND p.sku = a.sku
),
k AS (
  SELECT *, CAST(round_even(mtd_actual / dp * dm, 0) AS BIGINT) AS mtd_estimate,
         CAST(round_even(monthly_plan / dm * dp, 0) AS BIGINT) AS mtd_plan
  FROM j
)
SELECT attribution, customer_type, product, sku, dtd_actual, dtd_plan,
       printf('%.2f%%', dtd_actual / nullif(dtd_plan, 0) * 100) AS dtd_pct,
       mtd_actual, mtd_plan,
       printf('%.2f%%', mtd_actual / nullif(mtd_plan, 0) * 100) AS mtd_pct,
       mtd_estimate, monthly_plan, mtd_plan - mtd_actual AS backlog,
       CAST(round_even((monthly_plan - mtd_actual) / dp, 0) AS BIGINT) AS drr
FROM k
WHERE (attribution, concat_ws(' ', customer_type, product, sku)) IN (
  SELECT attribution, concat_ws(' ', customer_type, product, sku) FROM plan WHERE monthly_plan <> 0)
""")
def pacing_q(spark, d, *, day=PACE_DAY, month_start=PACE_MONTH_START, plan_month=PLAN_MONTH,
             working_day_teams=None):
    t = Tables(spark, d)
    apps = _orders_keyed(t).where(
        (F.col("o_orderdate") >= _ts(month_start)) &
        (F.col("o_orderdate") < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")))
    apps = upper_strings(apps.withColumn("attribution", _team()), ["customer_type", "product", "sku"])
    dm = dp = F.lit(None).cast("int")
    for team, (m, p) in (working_day_teams or WORKING_DAY_TEAMS).items():
        dm = F.when(F.col("attribution") == team, m).otherwise(dm)
        dp = F.when(F.col("attribution") == team, p).otherwise(dp)
    dm = F.coalesce(dm, days_in_month(day))
    dp = F.coalesce(dp, F.dayofmonth(F.lit(day).cast("date")))
    return pacing(apps, targets_long(t, plan_month, day), team="attribution",
                  keys=["customer_type", "product", "sku"], lead="o_orderkey", t="o_orderdate", day=day,
                  days_month=dm, days_past=dp)


@query("points_score", ids="C10 J3 F12 P3", sql="""
WITH apps AS (
  SELECT 'supp-' || CAST(l.l_suppkey AS VARCHAR) AS applied_oic, l.l_shipdate AS applied_date,
         p.p_name AS sku, p.p_type AS customer_type,
         CAST(CAST(trunc(l.l_quantity) AS INTEGER) AS VARCHAR) AS status_code, l.l_orderkey AS lead_id
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
),
sp AS (SELECT p_name AS sku, p_type AS customer_type, min(p_size) % 2 AS api_flag,
              min(p_size) % 5 + 1 AS points FROM part GROUP BY 1, 2)
SELECT a.applied_oic, strftime(a.applied_date, '%Y-%m') AS applied_month,
       sum(CASE WHEN a.applied_date IS NOT NULL AND regexp_matches(a.sku, 'ring', 'i') THEN 1
                WHEN regexp_matches(a.sku, 'widget', 'i') AND a.applied_date IS NOT NULL THEN 2
                WHEN a.sku = sp.sku AND a.customer_type = sp.customer_type AND sp.api_flag = 1 AND a.status_code >= '39' THEN sp.points
                WHEN a.sku = sp.sku AND a.customer_type = sp.customer_type AND sp.api_flag = 0 AND a.status_code >= '25' THEN sp.points
                ELSE 0 END) AS points_sku,
       count(a.lead_id) AS referrals_generated
FROM apps a LEFT JOIN sp ON sp.sku = a.sku AND sp.customer_type = a.customer_type
GROUP BY 1, 2
""")
def points_score(spark, d, *, owners=None):
    t = Tables(spark, d)
    apps = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"),
                           "l_partkey").select(
        F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("applied_oic"),
        F.col("l_shipdate").alias("applied_date"), F.col("p_name").alias("sku"),
        F.col("p_type").alias("customer_type"),
        F.col("l_quantity").cast("int").cast("string").alias("status_code"),
        F.col("l_orderkey").alias("lead_id"))
    apps = maybe_in(apps, "applied_oic", owners)
    sp = t.part.groupBy(F.col("p_name").alias("sku"), F.col("p_type").alias("customer_type")).agg(
        (F.min("p_size") % 2).alias("api_flag"), (F.min("p_size") % 5 + 1).alias("points"))
    j = apps.join(sp.select("sku", "customer_type", F.col("api_flag").alias("sp_api"),
                            F.col("points").alias("sp_points"), F.lit(True).alias("sp_hit")),
                  ["sku", "customer_type"], "left")
    applied = F.col("applied_date").isNotNull()
    pts = (F.when(applied & imatch("sku", "ring"), 1)
           .when(imatch("sku", "widget") & applied, 2)
           .when(F.col("sp_hit") & (F.col("sp_api") == 1) & (F.col("status_code") >= "39"), F.col("sp_points"))
           .when(F.col("sp_hit") & (F.col("sp_api") == 0) & (F.col("status_code") >= "25"), F.col("sp_points"))
           .otherwise(0))
    return j.groupBy("applied_oic", F.date_format("applied_date", "yyyy-MM").alias("applied_month")).agg(
        F.sum(pts).cast("long").alias("points_sku"), F.count("lead_id").alias("referrals_generated"))


@query("holding_flags", ids="C11 J4 A6 A14", sql="""
SELECT c.c_custkey, coalesce(h.holds_economy, 0) AS holds_economy,
       coalesce(h.holds_small_returned, 0) AS holds_small_returned,
       coalesce(h.n_parts, 0) AS n_parts, h.brands
FROM customer c
LEFT JOIN LATERAL (
  SELECT bool_or(regexp_matches(p.p_type, 'economy', 'i'))::INTEGER AS holds_economy,
         bool_or(regexp_matches(p.p_type, 'small', 'i') AND l.l_returnflag = 'R')::INTEGER AS holds_small_returned,
         count(DISTINCT l.l_partkey) AS n_parts,
         nullif(string_agg(DISTINCT p.p_brand, ',' ORDER BY p.p_brand), '') AS brands
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
  WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'
) h ON TRUE
""")
def holding_flags(spark, d):
    t = Tables(spark, d)
    held = (t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")
            .join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag"),
                  "o_orderkey")
            .join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"), "l_partkey"))
    return agg_per_key(t.customer.select("c_custkey"), held, [("c_custkey", "o_custkey")], [
        milestone(imatch("p_type", "economy")).alias("holds_economy"),
        milestone(imatch("p_type", "small") & (F.col("l_returnflag") == "R")).alias("holds_small_returned"),
        F.count_distinct("l_partkey").alias("n_parts"),
        join_distinct("p_brand", ",").alias("brands"),
    ], zero=["holds_economy", "holds_small_returned", "n_parts"])


@query("journey", ids="C12 J7 W1 J24 A9", sql="""
SELECT c.c_custkey,
       (SELECT e.event_type FROM events e WHERE e.user_id = c.c_custkey ORDER BY e.ts, e.event_id LIMIT 1) AS first_event_type,
       (SELECT min(e.ts) FROM events e WHERE e.user_id = c.c_custkey AND e.event_type = 'purchase') AS first_purchase_ts,
       ps.prior_state,
       (SELECT count(*) FROM events e WHERE e.user_id = c.c_custkey AND e.event_type = 'purchase'
          AND EXISTS (SELECT 1 FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'purchase'
                      AND e2.value > 50 AND e2.ts < e.ts)) AS n_repeat_purchases,
       (SELECT CASE WHEN bool_and(e.event_type = 'error') THEN 'NC'
                    WHEN bool_or(e.event_type = 'error') THEN 'Contact' ELSE 'No Call' END
        FROM events e WHERE e.user_id = c.c_custkey) AS call_state
FROM customer c
LEFT JOIN (SELECT DISTINCT user_id, prior_state FROM (
             SELECT user_id, event_type AS prior_state,
                    dense_rank() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS rk
             FROM events) x WHERE rk = 2) ps ON ps.user_id = c.c_custkey
""")
def journey(spark, d):
    t = Tables(spark, d)
    ev = t.events
    cust = t.customer.select(F.col("c_custkey").alias("user_id"))
    first = first_per(ev, "user_id", ["ts", "event_id"], ["event_type"]) \
        .withColumnRenamed("event_type", "first_event_type")
    buys = ev.where(F.col("event_type") == "purchase")
    rep = flag_earlier_exists(buys, ["user_id"], "ts", F.col("value") > 50, "dup")
    per = ev.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("first_purchase_ts"),
        F.bool_and(F.col("event_type") == "error").alias("__all"),
        F.bool_or(F.col("event_type") == "error").alias("__any"))
    out = (cust.join(first, "user_id", "left").join(per, "user_id", "left")
           .join(nth_state(ev, "user_id", "ts", "event_type").drop("prior_state_at"), "user_id", "left")
           .join(rep.groupBy("user_id").agg(F.sum("dup").cast("long").alias("n_repeat_purchases")),
                 "user_id", "left"))
    return out.select(F.col("user_id").alias("c_custkey"), "first_event_type", "first_purchase_ts",
                      "prior_state", F.coalesce("n_repeat_purchases", F.lit(0)).alias("n_repeat_purchases"),
                      F.when(F.col("__all"), "NC").when(F.col("__any"), "Contact").otherwise("No Call")
                      .alias("call_state"))


@query("missed_promise", ids="C14 R16 J2 P3 DT1", sql="""
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, ll.followup_date,
       CASE WHEN CAST(ll.followup_date AS DATE) < DATE '1998-01-01' AND regexp_matches(o.o_orderpriority, 'urgent', 'i') THEN 1 ELSE 0 END AS missed_urgent,
       CASE WHEN CAST(ll.followup_date AS DATE) < DATE '1998-01-01' AND regexp_matches(o.o_orderpriority, 'high', 'i') THEN 1 ELSE 0 END AS missed_high
FROM orders o
LEFT JOIN (SELECT l_orderkey AS id, max(l_shipdate) AS followup_date FROM lineitem GROUP BY 1) ll ON o.o_orderkey = ll.id
WHERE o.o_orderdate >= TIMESTAMP '1997-01-01' AND o.o_orderdate < TIMESTAMP '1998-01-01'
""")
def missed_promise(spark, d, *, start="1997-01-01", end="1998-01-01"):
    t = Tables(spark, d)
    leads = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("followup_date"))
    o = t.orders.where((F.col("o_orderdate") >= _ts(start)) & (F.col("o_orderdate") < _ts(end)))
    j = o.join(leads, "o_orderkey", "left")
    due = F.to_date("followup_date") < F.lit(end).cast("date")
    return j.select("o_orderkey", "o_custkey", "o_orderdate", "followup_date",
                    F.when(due & imatch("o_orderpriority", "urgent"), 1).otherwise(0).alias("missed_urgent"),
                    F.when(due & imatch("o_orderpriority", "high"), 1).otherwise(0).alias("missed_high"))


@query("agent_tracking", ids="R22 C6 C10 J3 J25 A3 A5 F12 F8", sql="""
WITH ev AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                   'agent-' || CAST(user_id AS VARCHAR) AS oic FROM events
            WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'),
data AS (
  SELECT CAST(ts AS DATE) AS call_date, oic,
         CASE WHEN extract(dow FROM CAST(ts AS DATE)) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
         count(*) AS total_calls, count(*) FILTER (WHERE event_type != 'error') AS effective_calls,
         strftime(min(ts), '%H:%M:%S') AS first_call_time, strftime(max(ts), '%H:%M:%S') AS last_call_time,
         CAST(CASE WHEN count(*) = 0 THEN 0 WHEN count(*) < 40 THEN 0.5 ELSE 1 END AS DOUBLE) AS attendance_count,
         CAST(round((epoch_us(max(ts)) - epoch_us(min(ts)))::DECIMAL(20,0) / 3600000000, 2) AS DOUBLE) AS hours_logged
  FROM ev GROUP BY 1, 2, 3
),
apps AS (
  SELECT e.oic AS applied_oic, CAST(e.ts AS DATE) AS applied_date, e.event_id AS lead_id,
         p.p_name AS sku, p.p_type AS customer_type,
         CAST(CAST(trunc(e.value) AS INTEGER) AS VARCHAR) AS appops_status_code
  FROM ev e LEFT JOIN part p ON p.p_partkey = e.k
  WHERE e.event_type = 'purchase'
),
sp AS (SELECT p_name AS sku, p_type AS customer_type, min(p_size) % 2 AS api_flag,
              min(p_size) % 5 + 1 AS points FROM part GROUP BY 1, 2),
data2 AS (
  SELECT a.applied_oic, a.applied_date,
         sum(CASE WHEN a.applied_date IS NOT NULL AND regexp_matches(a.sku, 'ring', 'i') THEN 1
                  WHEN regexp_matches(a.sku, 'widget', 'i') AND a.applied_date IS NOT NULL THEN 2
                  WHEN a.sku = sp.sku AND a.customer_type = sp.customer_type AND sp.api_flag = 1 AND a.appops_status_code >= '39' THEN sp.points
                  WHEN a.sku = sp.sku AND a.customer_type = sp.customer_type AND sp.api_flag = 0 AND a.appops_status_code >= '25' THEN sp.points
                  ELSE 0 END) AS points_sku,
         count(a.lead_id) AS referrals_generated
  FROM apps a LEFT JOIN sp ON a.sku = sp.sku AND a.customer_type = sp.customer_type
  GROUP BY 1, 2
),
data3 AS (
  SELECT oic AS sub_oic, CAST(ts AS DATE) AS payment_date,
         count(*) FILTER (WHERE regexp_matches(CASE WHEN k < 50 THEN 'CHR' ELSE 'BYS' END, 'CHR', 'i')) AS chr_subscriptions,
         count(*) FILTER (WHERE regexp_matches(CASE WHEN k < 50 THEN 'CHR' ELSE 'BYS' END, 'BYS', 'i')) AS bys_subscriptions
  FROM ev WHERE event_type = 'signup' AND NOT regexp_matches(oic, 'sys|port', 'i')
  GROUP BY 1, 2
)
SELECT a.*, CAST(b.points_sku AS BIGINT) AS points_sku, b.referrals_generated,
       c.chr_subscriptions, c.bys_subscriptions
FROM data a
LEFT JOIN data2 b ON a.oic = b.applied_oic AND a.call_date = b.applied_date
LEFT JOIN data3 c ON c.sub_oic = a.oic AND a.call_date = c.payment_date
""")
def agent_tracking(spark, d, *, start="2024-01-01", end="2024-02-01"):
    from funnelkit.plans.reports import agent_day
    t = Tables(spark, d)
    ev = t.events.where((F.col("ts") >= _ts(start)) & (F.col("ts") < _ts(end))).withColumns({
        "k": F.get_json_object("props", "$.k").try_cast("int"),
        "oic": F.concat(F.lit("agent-"), F.col("user_id").cast("string"))})
    data = agent_day(ev, owner="oic", t="ts", effective=F.col("event_type") != "error")
    # points and referrals per (agent, day): purchases joined to their SKU on
    # the derived key, then to the (SKU, type) points master
    apps = (ev.where(F.col("event_type") == "purchase")
            .join(t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("sku"),
                                F.col("p_type").alias("customer_type")), "k", "left")
            .select(F.col("oic").alias("applied_oic"), F.to_date("ts").alias("applied_date"),
                    F.col("event_id").alias("lead_id"), "sku", "customer_type",
                    F.col("value").cast("int").cast("string").alias("appops_status_code")))
    sp = t.part.groupBy(F.col("p_name").alias("sku"), F.col("p_type").alias("customer_type")).agg(
        (F.min("p_size") % 2).alias("sp_api"), (F.min("p_size") % 5 + 1).alias("sp_points"),
        F.lit(True).alias("sp_hit"))
    j = apps.join(sp, ["sku", "customer_type"], "left")
    applied = F.col("applied_date").isNotNull()
    code = F.col("appops_status_code")
    pts = (F.when(applied & imatch("sku", "ring"), 1).when(imatch("sku", "widget") & applied, 2)
           .when(F.col("sp_hit") & (F.col("sp_api") == 1) & (code >= "39"), F.col("sp_points"))
           .when(F.col("sp_hit") & (F.col("sp_api") == 0) & (code >= "25"), F.col("sp_points"))
           .otherwise(0))
    data2 = j.groupBy(F.col("applied_oic").alias("oic"), F.col("applied_date").alias("call_date")).agg(
        F.sum(pts).cast("long").alias("points_sku"), F.count("lead_id").alias("referrals_generated"))
    service = F.when(F.col("k") < 50, "CHR").otherwise("BYS")
    data3 = (ev.where((F.col("event_type") == "signup") & ~imatch("oic", "sys|port"))
             .groupBy("oic", F.to_date("ts").alias("call_date")).agg(
                 F.count(F.when(imatch(service, "CHR"), 1)).alias("chr_subscriptions"),
                 F.count(F.when(imatch(service, "BYS"), 1)).alias("bys_subscriptions")))
    return data.join(data2, ["oic", "call_date"], "left").join(data3, ["oic", "call_date"], "left")
