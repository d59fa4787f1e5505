"""Lead reports: the product interest funnel (R24), the second half of the application
extract (R10), payments by service with holdings (R13-R15, C11), the ever-product
cohort in two saved steps (R8), and lead answers as columns (R25)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from funnelkit.functions.expr import (case_cascade, collapse_newlines, decode_label, half_open, imatch, m_bucket,
                                      month_diff, text_between, to_numeric)
from funnelkit.operators.agg import collect_struct, first_by, last_by, milestone, milestone_and_not
from funnelkit.operators.lookup import asof_join, first_per, hot_keys_for
from funnelkit.operators.member import semi, suppress
from funnelkit.plans.catalog_extracts import SEGMENT_LABELS
from funnelkit.plans.registry import Tables, query
from funnelkit.plans.reports import latest_utm, recency_flags, rollup_distinct_flags
from funnelkit.sources.sinks import cut_lineage

# Sources whose leads count as marketing (any of them in the source text).
MARKETING_SOURCES = (
    "(netcoreCC|netcorepl|intellectadscc|adcanopuscc|adcanopuspl|aqugenCC|FB_CC_LAL2_AM|FB_CC_Custom_Am|"
    "FB_CC_LAL1_AM|FB_PL1|FB_PL2|FB_CCPL_LAL1|FB_CCPL_LAL2|FB_GCC_L1|FB_GCC_L2|fb_pm|FB_CC_L1DEC|FB_CC_L2|"
    "FB_L1|FB_L1_DEC1|FB_L1_RED|FB_L2|FB_L2_DEC2|FB_L2_RED|GL)")
# Owners that stand for no person.
NO_PERSON = ["System", "PORTFOLIO", "androidApp"]

_SEGMENT_SQL = """CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Green' WHEN 'MACHINERY' THEN 'Red'
            WHEN 'AUTOMOBILE' THEN 'Amber' ELSE 'NH' END"""
_OWNER_SQL = """CASE WHEN l_suppkey % 3 = 0 THEN 'System' WHEN l_suppkey % 7 = 0 THEN 'PORTFOLIO'
            ELSE 'agent-' || CAST(l_suppkey % 20 AS VARCHAR) END"""
_STATUS_SQL = "l_returnflag || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0')"
_LEAD_SOURCE_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'email-x' WHEN 1 THEN 'SMS-y' ELSE 'direct' END"
_LOGIN_SOURCE_SQL = """CASE o_orderkey % 5 WHEN 0 THEN 'x_fb_pl1_y' WHEN 1 THEN 'NETCORECC' WHEN 2 THEN 'email'
            ELSE 'organic' END"""


def _lead_log(t):
    """A lead's child log: status text, owner and time of each line."""
    owner = F.when(F.col("l_suppkey") % 3 == 0, "System").when(F.col("l_suppkey") % 7 == 0, "PORTFOLIO") \
        .otherwise(F.concat(F.lit("agent-"), (F.col("l_suppkey") % 20).cast("string")))
    return t.lineitem.select(
        F.col("l_orderkey").alias("lead_id"), F.col("l_shipdate").alias("at"), "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_returnflag", "l_linestatus",
        F.concat("l_returnflag", F.lit("-"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("status"),
        owner.alias("owner"))


_LOG_ORDER = ["at", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_LOG_ORDER_SQL = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity"
_LOG_DESC_SQL = "l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC"
_FLAGS = ["pass_021", "pass_022", "pass_023", "pass_024", "pass_03", "pass_03_sys", "pass_05", "pass_88", "pass_110",
          "pass_07", "pass_07_sys", "pass_270"]


@query("product_interest_funnel", ids="R24 J5 J7 J9 J16 J19 U1 U2 A3 A6 A7 A11 A18 DT9", sql=f"""
WITH log AS (SELECT *, {_STATUS_SQL} AS status, {_OWNER_SQL} AS owner FROM lineitem),
src AS (SELECT o_custkey AS user_id, o_orderdate AS created_at, o_orderkey AS id, {_LOGIN_SOURCE_SQL} AS utm FROM orders),
profiles AS (SELECT o_custkey AS user_id, o_orderkey AS profile_id, o_orderdate AS created_on FROM orders
             WHERE o_totalprice >= 100000),
leads AS (
  SELECT cl.o_orderkey AS id, cl.o_orderstatus AS product, {_SEGMENT_SQL} AS customer_type,
    CASE WHEN app.owner = 'System' AND regexp_matches({_LEAD_SOURCE_SQL.replace('o_orderkey', 'cl.o_orderkey')}, '(email|sms)', 'i') THEN 'PA'
         WHEN app.owner NOT IN ('System', 'PORTFOLIO', 'androidApp') THEN 'Assisted'
         WHEN regexp_matches((SELECT s.utm FROM src s WHERE s.user_id = cl.o_custkey AND s.created_at < app.l_shipdate
                              ORDER BY s.created_at DESC, s.id DESC LIMIT 1), '{MARKETING_SOURCES}', 'i') THEN 'Marketing'
         ELSE 'System' END AS channel,
    CASE WHEN (year(cl.o_orderdate) - year(cp.created_on)) * 12 + month(cl.o_orderdate) - month(cp.created_on) = 0 THEN 'M0'
         WHEN (year(cl.o_orderdate) - year(cp.created_on)) * 12 + month(cl.o_orderdate) - month(cp.created_on) = 1 THEN 'M1'
         WHEN (year(cl.o_orderdate) - year(cp.created_on)) * 12 + month(cl.o_orderdate) - month(cp.created_on) > 1 THEN 'M1+'
         END AS month_orig,
    f.*
  FROM orders cl
  LEFT JOIN profiles cp ON cp.user_id = cl.o_custkey
    AND cp.profile_id = (SELECT min(profile_id) FROM profiles p WHERE p.user_id = cl.o_custkey)
  LEFT JOIN customer c ON c.c_custkey = cp.user_id
  LEFT JOIN LATERAL (
    SELECT bool_or(status LIKE '%01') AS p021, bool_or(status LIKE '%02') AS p022, bool_or(status LIKE '%04') AS p023,
      bool_or(status LIKE 'R-05') AS p024, bool_or(status LIKE '%03') AS p03,
      (array_agg(owner ORDER BY {_LOG_ORDER_SQL}) FILTER (WHERE status LIKE '%03'))[1] AS oic_at_03,
      bool_or(status LIKE '%06') AND NOT bool_or(status LIKE '%05') AS p88, bool_or(status LIKE '%05') AS p05,
      bool_or(status LIKE '%07') AS p07,
      (array_agg(owner ORDER BY {_LOG_ORDER_SQL}) FILTER (WHERE status LIKE '%07'))[1] AS oic_at_07,
      bool_or(status LIKE 'A-01') AS p110, bool_or(status LIKE '%07' OR l_quantity >= 45) AS p270
    FROM log WHERE log.l_orderkey = cl.o_orderkey) f ON TRUE
  LEFT JOIN LATERAL (SELECT owner, l_shipdate FROM log WHERE log.l_orderkey = cl.o_orderkey AND status LIKE '%01'
                     ORDER BY {_LOG_DESC_SQL} LIMIT 1) app ON TRUE
  WHERE cl.o_orderdate >= TIMESTAMP '1997-01-01' AND cl.o_orderdate < TIMESTAMP '1997-07-01'
    AND cl.o_orderpriority <> '5-LOW' AND EXISTS (SELECT 1 FROM profiles p WHERE p.user_id = cl.o_custkey)
)
SELECT product, customer_type, channel, month_orig, count(DISTINCT id) AS total,
  count(DISTINCT id) FILTER (WHERE p021) AS pass_021, count(DISTINCT id) FILTER (WHERE p022) AS pass_022,
  count(DISTINCT id) FILTER (WHERE p023) AS pass_023, count(DISTINCT id) FILTER (WHERE p024) AS pass_024,
  count(DISTINCT id) FILTER (WHERE p03) AS pass_03,
  count(DISTINCT id) FILTER (WHERE p03 AND oic_at_03 = 'System') AS pass_03_sys,
  count(DISTINCT id) FILTER (WHERE p05) AS pass_05, count(DISTINCT id) FILTER (WHERE p88) AS pass_88,
  count(DISTINCT id) FILTER (WHERE p110) AS pass_110, count(DISTINCT id) FILTER (WHERE p07) AS pass_07,
  count(DISTINCT id) FILTER (WHERE p07 AND oic_at_07 = 'System') AS pass_07_sys,
  count(DISTINCT id) FILTER (WHERE p270) AS pass_270
FROM leads GROUP BY ROLLUP (product, customer_type, channel, month_orig)
""")
def product_interest_funnel(spark, d, *, start="1997-01-01", end="1997-07-01"):
    """Distinct leads by product, customer type, channel and month of origin, with all
    rollup levels, for twelve stage flags."""
    t = Tables(spark, d)
    profiles = t.orders.where(F.col("o_totalprice") >= 100000)
    leads = semi(t.orders.where(half_open("o_orderdate", start, end) & (F.col("o_orderpriority") != "5-LOW")),
                 profiles, "o_custkey").select(
        F.col("o_orderkey").alias("lead_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("product"),
        F.element_at(F.array(F.lit("email-x"), F.lit("SMS-y"), F.lit("direct"), F.lit("direct")),
                     (F.col("o_orderkey") % 4 + 1).cast("int")).alias("utm_source"))
    leads = cut_lineage(leads)                  # the window's leads are few, and restrict every log below
    users = leads.select("user_id").distinct()
    # profile of the smallest id
    first = semi(profiles, users, [("o_custkey", "user_id")]).groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.min_by("o_orderdate", "o_orderkey").alias("profiled_on"))
    st = F.col("status")
    log = semi(_lead_log(t), leads, "lead_id")
    per = log.groupBy("lead_id").agg(
        milestone(st.endswith("01")).alias("pass_021"), milestone(st.endswith("02")).alias("pass_022"),
        milestone(st.endswith("04")).alias("pass_023"), milestone(st == "R-05").alias("pass_024"),
        milestone(st.endswith("03")).alias("pass_03"), milestone(st.endswith("05")).alias("pass_05"),
        milestone_and_not(st.endswith("06"), st.endswith("05")).alias("pass_88"),
        milestone(st == "A-01").alias("pass_110"), milestone(st.endswith("07")).alias("pass_07"),
        milestone(st.endswith("07") | (F.col("l_quantity") >= 45)).alias("pass_270"),
        first_by("owner", _LOG_ORDER, where=st.endswith("03")).alias("oic_at_03"),
        first_by("owner", _LOG_ORDER, where=st.endswith("07")).alias("oic_at_07"),
        last_by(F.struct("owner", "at"), _LOG_ORDER, where=st.endswith("01")).alias("app"))
    login = semi(t.orders, users, [("o_custkey", "user_id")]).select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("log_id"),
        F.element_at(F.array(*map(F.lit, ("x_fb_pl1_y", "NETCORECC", "email", "organic", "organic"))),
                     (F.col("o_orderkey") % 5 + 1).cast("int")).alias("utm_source_text"))
    base = leads.join(per, "lead_id", "left").join(first, "user_id", "left")
    base = base.withColumns({"app_owner": F.col("app.owner"), "app_at": F.col("app.at")}).drop("app")
    base = latest_utm(base, login, user="user_id", t="app_at", tiebreak=["log_id"], out="login_source",
                      hot=hot_keys_for(t.orders, "o_custkey", "o_orderdate"))
    customer = t.customer.select(F.col("c_custkey").alias("user_id"),
                                 decode_label("c_mktsegment", SEGMENT_LABELS, "NH").alias("customer_type"))
    base = base.join(customer, "user_id", "left").fillna("NH", subset=["customer_type"])
    n = month_diff("profiled_on", "created_at")
    base = base.withColumns({
        "channel": case_cascade([((F.col("app_owner") == "System") & imatch("utm_source", "(email|sms)"), "PA"),
                                 (~F.col("app_owner").isin(NO_PERSON), "Assisted"),
                                 (imatch("login_source", MARKETING_SOURCES), "Marketing")], "System"),
        "month_orig": F.when(n >= 0, m_bucket(n, null_stays=True)),
        "pass_03_sys": F.when((F.col("pass_03") == 1) & (F.col("oic_at_03") == "System"), 1),
        "pass_07_sys": F.when((F.col("pass_07") == 1) & (F.col("oic_at_07") == "System"), 1)})
    out = rollup_distinct_flags(base, ["product", "customer_type", "channel", "month_orig"], "lead_id", _FLAGS,
                                label=None, total_name="total", one_row=True)
    return out.fillna(0, subset=_FLAGS)


@query("application_lookups", ids="R10 J4 J7 J8 J9 J10 J16 J18 C10 F12 JS1 STR4 U4", sql=f"""
WITH a AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01'),
ev AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log AS (SELECT *, {_OWNER_SQL} AS owner FROM lineitem),
sp AS (SELECT o.o_orderpriority AS sku, c.c_mktsegment AS customer_type, count(*) % 2 AS api_flag, count(*) % 5 + 1 AS points
       FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1, 2)
SELECT a.o_orderkey AS lead_id, a.o_custkey AS user_id,
  CASE WHEN regexp_matches(a.o_orderpriority, 'urgent', 'i') AND a.o_orderdate IS NOT NULL THEN 1
       WHEN regexp_matches(a.o_orderpriority, 'not spec', 'i') AND a.o_orderdate IS NOT NULL THEN 2
       WHEN sp.api_flag = 1 AND CAST(CAST(floor(a.o_totalprice / 1000) AS BIGINT) AS VARCHAR) >= '390' THEN sp.points
       WHEN sp.api_flag = 0 AND CAST(CAST(floor(a.o_totalprice / 1000) AS BIGINT) AS VARCHAR) >= '250' THEN sp.points
       ELSE 0 END AS points_sku,
  CASE WHEN rl.status IN (1, 2) THEN 1 ELSE 0 END AS is_card_api_approved,
  CASE WHEN (SELECT l.l_suppkey % 3 FROM lineitem l WHERE l.l_orderkey = a.o_orderkey AND l.l_returnflag = 'R'
             ORDER BY {_LOG_DESC_SQL} LIMIT 1) IN (1) THEN 1 ELSE 0 END AS is_bank_api_approved,
  (SELECT regexp_replace(l.l_returnflag || chr(10) || chr(13) || CAST(l.l_partkey AS VARCHAR), '[\\n\\r]+', ' ', 'g')
   FROM lineitem l WHERE l.l_orderkey = a.o_orderkey AND l.l_linestatus = 'F'
   ORDER BY {_LOG_DESC_SQL} LIMIT 1) AS description,
  CAST(TRY_CAST(json_extract_string(form.props, '$.k') AS DECIMAL(18,2)) AS DOUBLE) AS net_take_home,
  (SELECT (array_agg(owner ORDER BY {_LOG_ORDER_SQL}) FILTER (WHERE l_linenumber = 3))[1] FROM log
   WHERE log.l_orderkey = a.o_orderkey GROUP BY l_orderkey) AS first_oic,
  fb.lender_notes, fb.lender_reject_reason, agency.agency_name,
  pu.profiled_date, pu.profiled_utm_source,
  (SELECT o.o_totalprice FROM orders o WHERE o.o_custkey = a.o_custkey
   ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 1) AS credit_score,
  (SELECT e.event_id FROM events e WHERE e.user_id = a.o_custkey AND e.event_type = 'signup'
   ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) AS tkn,
  (SELECT count(*) FROM orders cl WHERE cl.o_custkey = a.o_custkey AND regexp_matches(cl.o_orderpriority, 'high', 'i')) AS regen_lead_count
FROM a
LEFT JOIN customer c ON c.c_custkey = a.o_custkey
LEFT JOIN sp ON sp.sku = a.o_orderpriority AND sp.customer_type = c.c_mktsegment
LEFT JOIN LATERAL (
  SELECT CAST(l.l_quantity AS BIGINT) % 4 AS status FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey
  WHERE l.l_orderkey = a.o_orderkey AND coalesce(CASE WHEN l.l_returnflag = 'A' THEN 'initial' END,
        CASE WHEN p.p_size < 20 THEN 'initial' ELSE 'final' END) = 'initial'
  ORDER BY {_LOG_DESC_SQL} LIMIT 1) rl ON TRUE
LEFT JOIN LATERAL (SELECT props FROM events e WHERE e.user_id = a.o_custkey ORDER BY e.event_id LIMIT 1) form ON TRUE
LEFT JOIN LATERAL (
  SELECT l.l_linestatus || CAST(l.l_linenumber AS VARCHAR) AS lender_notes, l.l_partkey AS lender_reject_reason
  FROM lineitem l WHERE l.l_orderkey = a.o_orderkey AND l.l_returnflag = 'N'
  ORDER BY {_LOG_DESC_SQL} LIMIT 1) fb ON TRUE
LEFT JOIN LATERAL (SELECT r.r_name AS agency_name FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
                   WHERE n.n_nationkey = c.c_nationkey AND regexp_matches(n.n_name, '_1', 'i')) agency ON TRUE
LEFT JOIN LATERAL (
  SELECT p.profiled_date, (SELECT 'src-' || s.k FROM ev s WHERE s.user_id = a.o_custkey AND s.event_type <> 'purchase'
      AND s.ts < p.profiled_date ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) AS profiled_utm_source
  FROM (SELECT min(ts) AS profiled_date FROM ev WHERE ev.user_id = a.o_custkey AND ev.event_type = 'purchase') p) pu ON TRUE
""")
def application_lookups(spark, d, *, start="1996-01-01", end="1996-04-01"):
    """The application extract's other lookups: one aggregation of each log, restricted
    to the window's leads or users first, and one as-of lookup."""
    t = Tables(spark, d)
    a = t.orders.where(half_open("o_orderdate", start, end)).select(
        F.col("o_orderkey").alias("lead_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("sku"),
        F.col("o_orderdate").alias("applied_date"), F.floor(F.col("o_totalprice") / 1000).cast("string").alias("code"))
    a = cut_lineage(a)                          # the window's leads are few, and restrict every log below
    users = a.select("user_id").distinct()
    log = semi(_lead_log(t), a, "lead_id").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey", "left")
    level = F.coalesce(F.when(F.col("l_returnflag") == "A", "initial"),
                       F.when(F.col("p_size") < 20, "initial").otherwise("final"))
    note = collapse_newlines(F.concat("l_returnflag", F.lit("\n\r"), F.col("l_partkey").cast("string")))
    flag = F.col("l_returnflag")
    per_lead = log.groupBy("lead_id").agg(
        last_by(F.col("l_quantity").cast("long") % 4, _LOG_ORDER, where=level == "initial").alias("__card"),
        last_by(F.col("l_suppkey") % 3, _LOG_ORDER, where=flag == "R").alias("__bank"),
        last_by(note, _LOG_ORDER, where=F.col("l_linestatus") == "F").alias("description"),
        first_by("owner", _LOG_ORDER, where=F.col("l_linenumber") == 3).alias("first_oic"),
        last_by(F.struct(F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("notes"), "l_partkey"),
                _LOG_ORDER, where=flag == "N").alias("__fb"))
    ev = cut_lineage(semi(t.events, users, "user_id"))      # read once for the aggregates and the as-of lookup
    order = ["ts", "event_id"]
    per_user = ev.groupBy("user_id").agg(
        F.min_by("props", "event_id").alias("__form"),
        last_by("event_id", order, where=F.col("event_type") == "signup").alias("tkn"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("profiled_date"))
    source = ev.where(F.col("event_type") != "purchase").select(
        "user_id", F.col("ts").alias("src_ts"), F.col("event_id").alias("src_id"),
        F.concat(F.lit("src-"), F.get_json_object("props", "$.k").try_cast("int").cast("string")).alias("profiled_utm_source"))
    per_user = asof_join(per_user, source, "user_id", "profiled_date", "src_ts", ["profiled_utm_source"], tiebreak=["src_id"],
                         hot=hot_keys_for(ev, "user_id", "ts", holds_right=True))
    theirs = semi(t.orders, users, [("o_custkey", "user_id")]).groupBy(F.col("o_custkey").alias("user_id")).agg(
        last_by("o_totalprice", ["o_orderdate", "o_orderkey"]).alias("credit_score"),
        F.count(F.when(imatch("o_orderpriority", "high"), 1)).alias("regen_lead_count"))
    agency = (t.nation.where(imatch("n_name", "_1"))
           .join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey", "left")
           .select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("agency_name")))
    customer = t.customer.join(agency, "c_nationkey", "left").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("customer_type"), "agency_name")
    points = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("customer_type")),
                           "o_custkey").groupBy(F.col("o_orderpriority").alias("sku"), "customer_type").agg(
        (F.count(F.lit(1)) % 2).alias("api_flag"), (F.count(F.lit(1)) % 5 + 1).alias("points"))
    out = (a.join(customer, "user_id", "left").join(points, ["sku", "customer_type"], "left")
           .join(per_lead, "lead_id", "left").join(per_user, "user_id", "left").join(theirs, "user_id", "left"))
    applied = F.col("applied_date").isNotNull()
    score = (F.when(imatch("sku", "urgent") & applied, 1).when(imatch("sku", "not spec") & applied, 2)
             .when((F.col("api_flag") == 1) & (F.col("code") >= "390"), F.col("points"))
             .when((F.col("api_flag") == 0) & (F.col("code") >= "250"), F.col("points")).otherwise(0))
    one_if = lambda c: F.when(c, 1).otherwise(0)
    return out.select(
        "lead_id", "user_id", score.alias("points_sku"),
        one_if(F.col("__card").isin(1, 2)).alias("is_card_api_approved"), one_if(F.col("__bank") == 1).alias("is_bank_api_approved"),
        "description", to_numeric(F.get_json_object("__form", "$.k")).cast("double").alias("net_take_home"), "first_oic",
        F.col("__fb.notes").alias("lender_notes"), F.col("__fb.l_partkey").alias("lender_reject_reason"), "agency_name",
        "profiled_date", "profiled_utm_source", "credit_score", "tkn",
        F.coalesce("regen_lead_count", F.lit(0)).alias("regen_lead_count"))


@query("payment_holdings", ids="R14 C11 J4 J7 J10 J25 A12 JS1", sql=f"""
WITH ev AS (SELECT *, json_extract_string(props, '$.k') AS term FROM events),
pay AS (SELECT DISTINCT ON (user_id) user_id, event_id, ts AS payment_date FROM ev WHERE event_type = 'purchase'
        AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-31' ORDER BY user_id, ts, event_id),
login AS (SELECT user_id, ts AS login_date, event_id FROM ev WHERE event_type IN ('click', 'signup')),
held AS (
  SELECT l.l_orderkey AS profile_id, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, n.n_name AS short_name,
         p.p_brand AS product, CASE l.l_linestatus WHEN 'F' THEN 'Closed' ELSE 'Open' END AS status
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
  LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
  WHERE l.l_returnflag NOT IN ('N')
)
SELECT vs.user_id, vs.event_id, vs.payment_date, login_src.login_date, ue.term AS utm_term, prof3.latest_profile_id,
  coalesce(h.nsaleable, 0) AS nsaleable, h.lenders, h.account_no, h.products, h.account_status
FROM pay vs
LEFT JOIN LATERAL (SELECT login_date FROM login x WHERE x.user_id = vs.user_id AND x.login_date < vs.payment_date
                   ORDER BY x.login_date DESC, x.event_id DESC LIMIT 1) login_src ON TRUE
LEFT JOIN LATERAL (SELECT term FROM ev x WHERE x.user_id = vs.user_id AND x.ts = login_src.login_date
                   ORDER BY x.event_id LIMIT 1) ue ON TRUE
LEFT JOIN LATERAL (SELECT max(o_orderkey) AS latest_profile_id FROM orders o WHERE o.o_custkey = vs.user_id) prof3 ON TRUE
LEFT JOIN LATERAL (
  SELECT count(*) AS nsaleable, string_agg(short_name, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lenders,
    string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS account_no,
    string_agg(product, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS products,
    string_agg(status, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS account_status
  FROM held WHERE held.profile_id = prof3.latest_profile_id) h ON TRUE
""")
def payment_holdings(spark, d, *, start="2024-01-10", end="2024-01-31"):
    """The term of the event at the login before each payment, the payer's latest
    profile and its saleable accounts as parallel lists (a list is as long as one
    profile has accounts)."""
    t = Tables(spark, d)
    term = F.get_json_object("props", "$.k")
    pays = t.events.where((F.col("event_type") == "purchase") & half_open("ts", start, end))
    pay = first_per(pays, "user_id", ["ts", "event_id"], ["event_id", "ts"]).withColumnRenamed("ts", "payment_date")
    ev = semi(t.events, pay, "user_id")
    login = ev.where(F.col("event_type").isin("click", "signup")).select(
        "user_id", F.col("ts").alias("login_date"), F.col("event_id").alias("login_id"))
    x = asof_join(pay, login, "user_id", "payment_date", "login_date", ["login_date"], tiebreak=["login_id"],
                  hot=hot_keys_for(ev, "user_id", "ts", holds_right=True))
    at_login = ev.groupBy("user_id", F.col("ts").alias("login_date")).agg(F.min_by(term, "event_id").alias("utm_term"))
    x = x.join(at_login, ["user_id", "login_date"], "left")
    latest = semi(t.orders, pay, [("o_custkey", "user_id")]).groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max("o_orderkey").alias("latest_profile_id"))
    x = x.join(latest, "user_id", "left")
    lender = t.supplier.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "left") \
        .select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    held = semi(t.lineitem.where(F.col("l_returnflag") != "N"), latest, [("l_orderkey", "latest_profile_id")]) \
        .join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(lender, "l_suppkey", "left")
    fields = {"lenders": "n_name", "account_no": F.col("l_partkey").cast("string"), "products": "p_brand",
              "account_status": F.when(F.col("l_linestatus") == "F", "Closed").otherwise("Open")}
    lists = held.groupBy(F.col("l_orderkey").alias("latest_profile_id")).agg(
        F.count(F.lit(1)).alias("nsaleable"),
        collect_struct(fields, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).alias("__a"))
    x = x.join(lists, "latest_profile_id", "left")
    return x.select("user_id", "event_id", "payment_date", "login_date", "utm_term", "latest_profile_id",
                    F.coalesce("nsaleable", F.lit(0)).alias("nsaleable"),
                    *[F.array_join(F.col(f"__a.{f}"), ",").alias(f) for f in fields])


def _saved(df, step: str):
    """Saves a cohort step as a table of its own in the shared folder and reads it back."""
    from funnelkit.session import checkpoint_dir
    from funnelkit.sources.sinks import load_cohort, save_cohort
    spark = df.sparkSession
    name = f"cohort_{step}_{uuid.uuid4().hex}"
    save_cohort(df, name, path=f"{checkpoint_dir(spark)}/{name}")
    return load_cohort(spark, name)


@query("ever_product_cohort", ids="R8 C4 C5 J2 J6 J7 J22 F5 P5 A8 SNK1 SNK2", sql="""
WITH base AS (
  SELECT c.c_custkey AS user_id, c.c_mktsegment, c.c_nationkey,
    coalesce((SELECT o.o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O'
              ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 1), c.c_acctbal) AS monthly_income
  FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
),
base_3 AS (
  SELECT b.*, (SELECT e.event_id FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'signup'
               ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) AS tkn FROM base b
),
base_4 AS (
  SELECT b.*, n.n_name AS message_consent FROM base_3 b LEFT JOIN nation n ON n.n_nationkey = b.c_nationkey
  WHERE CAST(b.user_id AS VARCHAR) NOT BETWEEN '500' AND '550'
    AND b.user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 5000)
)
SELECT b.user_id, b.c_mktsegment, b.monthly_income, b.tkn, b.message_consent, f.* FROM base_4 b
LEFT JOIN LATERAL (
  SELECT coalesce(bool_or(o_orderdate >= TIMESTAMP '2001-01-01')::INTEGER, 0) AS applied_d0,
    coalesce(bool_or(o_orderdate < TIMESTAMP '2001-01-01' AND o_orderdate >= TIMESTAMP '2000-01-01')::INTEGER, 0) AS applied_d1,
    coalesce(bool_or(o_orderdate < TIMESTAMP '2000-01-01' AND o_orderdate >= TIMESTAMP '1999-01-01')::INTEGER, 0) AS applied_d2,
    coalesce(bool_or(o_orderdate < TIMESTAMP '1999-01-01')::INTEGER, 0) AS applied_old,
    coalesce(bool_or(o_orderkey % 5 = 0)::INTEGER, 0) AS applied_lender_a,
    coalesce(bool_or(o_orderkey % 5 = 1)::INTEGER, 0) AS applied_lender_b,
    coalesce(bool_or(o_orderkey % 5 = 2)::INTEGER, 0) AS applied_lender_c,
    coalesce(bool_or(o_orderkey % 5 = 3)::INTEGER, 0) AS applied_lender_d,
    coalesce(bool_or(o_orderkey % 5 = 4)::INTEGER, 0) AS applied_lender_e,
    coalesce(bool_or(true)::INTEGER, 0) AS applied_any,
    coalesce(bool_or(o_orderstatus IN ('P'))::INTEGER, 0) AS applied_disbursed
  FROM orders o WHERE o.o_custkey = b.user_id AND o.o_orderpriority IN ('1-URGENT')
) f ON TRUE
""")
def ever_product_cohort(spark, d, *, d0="2001-01-01", d1="2000-01-01", d2="1999-01-01", pincodes=("500", "550"),
                        min_price=5000):
    """The cohort in its two saved steps: the base with incomes, then tokens, consent,
    suppression and the recency, lender and status flags. Recency is since ``d0``, from
    ``d1`` and from ``d2``; profiles in the range of ``pincodes``, and users with a pending
    lead below ``min_price``, are left out."""
    t = Tables(spark, d)
    urgent = t.orders.where(F.col("o_orderpriority").isin("1-URGENT"))
    base = semi(t.customer, urgent, [("c_custkey", "o_custkey")]).select(
        F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_nationkey", "c_acctbal")
    income = t.orders.where(F.col("o_orderstatus") == "O").groupBy(F.col("o_custkey").alias("user_id")).agg(
        last_by("o_totalprice", ["o_orderdate", "o_orderkey"]).alias("__income"))
    base = base.join(income, "user_id", "left").withColumn("monthly_income", F.coalesce("__income", "c_acctbal")) \
        .drop("__income", "c_acctbal")
    base = _saved(base, "base")
    tokens = t.events.groupBy("user_id").agg(
        last_by("event_id", ["ts", "event_id"], where=F.col("event_type") == "signup").alias("tkn"))
    consent = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("message_consent"))
    step = base.join(tokens, "user_id", "left").join(consent, "c_nationkey", "left")
    step = step.where(text_between(F.col("user_id").cast("string"), *pincodes, negate=True))
    step = suppress(step, t.orders.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < min_price)),
                    "user_id", "o_custkey")
    flags = recency_flags(urgent, user="o_custkey", t="o_orderdate", d0=d0, d1=d1, d2=d2,
                          groups={"applied": F.lit(True)})
    lender = F.col("o_orderkey") % 5
    more = urgent.groupBy("o_custkey").agg(
        *[milestone(lender == i, 0).alias(f"applied_lender_{c}") for i, c in enumerate("abcde")],
        milestone(F.lit(True), 0).alias("applied_any"),
        milestone(F.col("o_orderstatus").isin("P"), 0).alias("applied_disbursed"))
    per = flags.join(more, "o_custkey").withColumnRenamed("o_custkey", "user_id")
    cols = [c for c in per.columns if c != "user_id"]
    out = step.join(per, "user_id", "left").fillna(0, subset=cols)
    return _saved(out.select("user_id", "c_mktsegment", "monthly_income", "tkn", "message_consent", *cols), "flags")


# The answers a lead report shows, by question.
QUESTIONS = ["residence_city", "nth", "pat", "property_city", "salary_account", "residential_pincode"]


@query("lead_answers", ids="R25 A15 A23 J25 JS1 U3", sql="""
WITH leads AS (SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'),
answers AS (
  SELECT DISTINCT ON (l_orderkey, l_partkey % 6) l_orderkey AS lead_id, l_partkey % 6 AS q,
    CASE WHEN l_partkey % 6 = 5 THEN CAST(CAST(l_quantity AS BIGINT) % 25 AS VARCHAR)
         ELSE 'a' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS answer
  FROM lineitem ORDER BY l_orderkey, l_partkey % 6, l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC
),
wide AS (
  SELECT lead_id, max(answer) FILTER (WHERE q = 0) AS residence_city, max(answer) FILTER (WHERE q = 1) AS nth,
    max(answer) FILTER (WHERE q = 2) AS pat, max(answer) FILTER (WHERE q = 3) AS property_city,
    max(answer) FILTER (WHERE q = 4) AS salary_account, max(answer) FILTER (WHERE q = 5) AS residential_pincode
  FROM answers GROUP BY lead_id
)
SELECT l.o_orderkey AS lead_id, l.o_custkey AS user_id,
  CAST(date_part('year', age(DATE '2024-01-30', CAST(DATE '1960-01-01' + CAST((l.o_custkey * 37) % 18000 AS INTEGER) AS DATE))) AS INTEGER) AS age,
  w.residence_city, p.n_name AS city_from_pincode, w.nth, w.pat, w.property_city, w.salary_account
FROM leads l LEFT JOIN wide w ON w.lead_id = l.o_orderkey
LEFT JOIN nation p ON CAST(p.n_nationkey AS VARCHAR) = w.residential_pincode
""")
def lead_answers(spark, d, *, first_day="1997-01-01", last_day="1997-03-31", run_date="2024-01-30"):
    """Each lead's latest answer to every question, by name, with the city of the
    pincode master and the applicant's age."""
    from funnelkit.functions.expr import age_years, day_window
    from funnelkit.operators.agg import answers_map
    t = Tables(spark, d)
    leads = t.orders.where(day_window("o_orderdate", first_day, last_day)).select(
        F.col("o_orderkey").alias("lead_id"), F.col("o_custkey").alias("user_id"))
    q = (F.col("l_partkey") % 6).cast("int")
    number = F.col("l_quantity").cast("long")
    log = semi(_lead_log(t), leads, "lead_id").select("*", F.element_at(F.array(*map(F.lit, QUESTIONS)), q + 1).alias("slug"),
                                                      F.when(q == 5, (number % 25).cast("string"))
                                                      .otherwise(F.concat(F.lit("a"), number.cast("string"))).alias("answer"))
    latest = first_per(log, ["lead_id", "slug"], _LOG_ORDER, ["answer"], last=True)
    wide = latest.groupBy("lead_id").agg(answers_map("slug", "answer").alias("answers"))   # one entry a question
    out = leads.join(wide, "lead_id", "left").withColumn("pincode", F.col("answers")["residential_pincode"])
    cities = t.nation.select(F.col("n_nationkey").cast("string").alias("pincode"), F.col("n_name").alias("city_from_pincode"))
    born = F.date_add(F.lit("1960-01-01").cast("date"), ((F.col("user_id") * 37) % 18000).cast("int"))
    return out.join(cities, "pincode", "left").select(
        "lead_id", "user_id", age_years(born, run_date).alias("age"), F.col("answers")["residence_city"].alias("residence_city"),
        "city_from_pincode", *[F.col("answers")[n].alias(n) for n in ("nth", "pat", "property_city", "salary_account")])
