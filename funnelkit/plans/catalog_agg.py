"""Aggregation-family queries: funnels, rollups, milestone flags, string / map
aggregates, disposition summaries (A1-A26, C1, C6, C7, C9, W1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelkit.functions.expr import (day_window, decode_label, imatch, pct_text, pct_text_ratio,
                                      similar_prefix, case_cascade, nimatch)
from funnelkit.operators.agg import (answers_map, bind_cols, collect_struct, disposition_summary,
                                     full_join_all, join_distinct, join_strings, progress, rollup_totals,
                                     with_total_row, fill_zero)
from funnelkit.operators.lookup import agg_per_key, first_per, nth_state
from funnelkit.plans.registry import Tables, query
from funnelkit.plans.reports import agent_day, stage_funnel, working_days
from funnelkit.sources.tables import date_series, maybe_in

# Call outcome lists of the disposition buckets.
DIALLED = ["Answered Linkcall", "Answered Linkcall Abandoned", "Busy", "Invalid", "No Answer",
           "Failed No Lines", "Canceled", "Answered Hangup"]
ANSWERED = ["Answered Linkcall", "Answered Linkcall Abandoned", "Answered Hangup"]
KEYPRESS = ["Answered Linkcall", "Answered Linkcall Abandoned"]
CONNECTED = ["Answered Linkcall"]
ABANDONED = ["Answered Linkcall Abandoned"]
HANGUP = ["Answered Hangup"]


def _listed(values):
    return ", ".join(f"'{v}'" for v in values)


FUNNEL_FIRST_DAY, FUNNEL_LAST_DAY = "1995-07-01", "1996-12-31"
CAL_START, CAL_END = "2024-01-01", "2024-01-31"
RUN_DATE = "2024-01-30"
# Profile types (segments) and their labels.
PROFILE_TYPES = {"BUILDING": "Green", "MACHINERY": "Red", "AUTOMOBILE": "Amber"}


def funnel_plan(t, first_day=FUNNEL_FIRST_DAY, last_day=FUNNEL_LAST_DAY):
    """C1 on the driver tables. Profiles: customers of the three profile types
    whose first profile (first order) was created in [first_day, last_day];
    the stage log is all of their orders, product = priority name."""
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_on"))
    profiles = (t.customer.where(F.col("c_mktsegment").isin(list(PROFILE_TYPES)))
                .select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
                .join(first, "o_custkey").where(day_window("created_on", first_day, last_day)))
    logs = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice",
                           "o_orderpriority")
    big = F.col("o_totalprice") >= 300000
    return stage_funnel(
        profiles, logs,
        user="o_custkey", segment=decode_label("c_mktsegment", PROFILE_TYPES),
        product=F.split_part("o_orderpriority", F.lit("-"), F.lit(2)),
        stages={"pass_f": imatch("o_orderstatus", "f$"), "pass_o": imatch("o_orderstatus", "o$"),
                "pass_p": imatch("o_orderstatus", "p$"), "pass_big": big},
        derived={"pass_big_not_p": F.when((F.col("pass_big") == 1) & (F.col("pass_p") == 0), 1)
                 .otherwise(0)},
        owners={"first_big_status": (F.col("o_orderstatus"), ["o_orderdate", "o_orderkey"], big)},
        gated={"pass_big_first_f": (F.col("pass_big") == 1) & (F.col("first_big_status") == "F")},
        percents={"pct_f": "pass_f", "pct_big": "pass_big"},
    ).select("segment", "profiles", "product", "pass_f", "pct_f", "pass_o", "pass_p", "pass_big",
             "pct_big", "pass_big_not_p", "pass_big_first_f")


@query("funnel_rollup", ids="C1 R20 A3 A6 A7 A11 A18 A19 F2 MA2 STR11", sql="""
WITH prof1 AS (
  SELECT c.c_custkey AS user_id, c.c_mktsegment AS p_customer_type,
         (SELECT min(o.o_orderdate) FROM orders o WHERE o.o_custkey = c.c_custkey) AS created_on
  FROM customer c
),
cp AS (
  SELECT user_id,
         CASE WHEN p_customer_type = 'BUILDING' THEN 'Green' WHEN p_customer_type = 'MACHINERY' THEN 'Red'
              WHEN p_customer_type = 'AUTOMOBILE' THEN 'Amber' END AS customer_type
  FROM prof1
  WHERE CAST(created_on AS DATE) BETWEEN DATE '1995-07-01' AND DATE '1996-12-31'
    AND p_customer_type IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
),
profiles AS (
  SELECT CASE WHEN grouping(customer_type) = 0 THEN customer_type ELSE 'Total' END AS segment,
         count(DISTINCT user_id) AS profiles
  FROM cp GROUP BY ROLLUP(customer_type)
),
funnel AS (
  SELECT CASE WHEN grouping(cp.customer_type) = 0 THEN cp.customer_type ELSE 'Total' END AS segment,
         CASE WHEN grouping(steps.prod) = 0 THEN steps.prod ELSE 'Total' END AS product,
         count(DISTINCT cp.user_id) FILTER (WHERE steps.pass_f = 1) AS pass_f,
         count(DISTINCT cp.user_id) FILTER (WHERE steps.pass_o = 1) AS pass_o,
         count(DISTINCT cp.user_id) FILTER (WHERE steps.pass_p = 1) AS pass_p,
         count(DISTINCT cp.user_id) FILTER (WHERE steps.pass_big = 1) AS pass_big,
         count(DISTINCT cp.user_id) FILTER (WHERE steps.pass_big_not_p = 1) AS pass_big_not_p,
         count(DISTINCT cp.user_id) FILTER (WHERE steps.pass_big = 1 AND steps.first_big_status = 'F') AS pass_big_first_f
  FROM cp
  LEFT JOIN LATERAL (
    SELECT split_part(o_orderpriority, '-', 2) AS prod,
           bool_or(regexp_matches(o_orderstatus, 'f$', 'i'))::INTEGER AS pass_f,
           bool_or(regexp_matches(o_orderstatus, 'o$', 'i'))::INTEGER AS pass_o,
           bool_or(regexp_matches(o_orderstatus, 'p$', 'i'))::INTEGER AS pass_p,
           bool_or(o_totalprice >= 300000)::INTEGER AS pass_big,
           (bool_or(o_totalprice >= 300000) AND NOT bool_or(regexp_matches(o_orderstatus, 'p$', 'i')))::INTEGER AS pass_big_not_p,
           (array_agg(o_orderstatus ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_totalprice >= 300000))[1] AS first_big_status
    FROM orders
    WHERE o_custkey = cp.user_id
    GROUP BY prod
  ) steps ON TRUE
  WHERE steps.prod IS NOT NULL
  GROUP BY ROLLUP(cp.customer_type, steps.prod)
)
SELECT p.segment, p.profiles, f.product, f.pass_f,
       round(f.pass_f / nullif(p.profiles, 0)::NUMERIC * 100, 1) || ' %' AS pct_f,
       f.pass_o, f.pass_p, f.pass_big,
       round(f.pass_big / nullif(p.profiles, 0)::NUMERIC * 100, 1) || ' %' AS pct_big,
       f.pass_big_not_p, f.pass_big_first_f
FROM profiles p JOIN funnel f ON f.segment = p.segment
""")
def funnel_rollup(spark, d, *, first_day=FUNNEL_FIRST_DAY, last_day=FUNNEL_LAST_DAY):
    return funnel_plan(Tables(spark, d), first_day, last_day)


@query("rollup_grouping", ids="A18 A19 A17", sql="""
SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN o_orderstatus ELSE 'Total' END AS status,
       CASE WHEN grouping(split_part(o_orderpriority, '-', 2)) = 0 THEN split_part(o_orderpriority, '-', 2) ELSE 'Total' END AS prod,
       CASE WHEN grouping(c_mktsegment) = 0 THEN c_mktsegment ELSE 'Total' END AS segment,
       count(*) AS n_orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON c_custkey = o_custkey
GROUP BY ROLLUP(o_orderstatus, split_part(o_orderpriority, '-', 2), c_mktsegment)
""")
def rollup_grouping(spark, d):
    t = Tables(spark, d)
    j = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"),
                      "o_custkey")
    out = rollup_totals(j, {"status": "o_orderstatus",
                            "prod": F.split_part("o_orderpriority", F.lit("-"), F.lit(2)),
                            "segment": "c_mktsegment"},
                        [F.count(F.lit(1)).alias("n_orders"),
                         F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
                         .alias("revenue")])
    return out


@query("rollup_null_label", ids="A20 R11 F10 P3 STR2", sql="""
WITH data AS (
  SELECT split_part(o.o_orderpriority, '-', 2) AS prod,
         CASE WHEN regexp_matches(o.o_orderpriority, 'urgent', 'i') AND regexp_full_match(CAST(o.o_custkey AS VARCHAR), '(1|2|3).*') THEN o.o_orderstatus || ' AP & TG'
              WHEN regexp_matches(o.o_orderpriority, 'urgent', 'i') AND NOT regexp_full_match(CAST(o.o_custkey AS VARCHAR), '(1|2|3).*') THEN o.o_orderstatus || ' ROI'
              WHEN regexp_matches(o.o_orderstatus, 'p', 'i') THEN 'PEND ' || o.o_orderstatus
              ELSE o.o_orderstatus END AS sku,
         c.c_mktsegment AS ct,
         CASE WHEN NOT regexp_matches(c.c_mktsegment, '(building|machinery)', 'i') THEN 'Assisted'
              WHEN regexp_matches(c.c_mktsegment, 'building', 'i') AND o.o_totalprice > 200000 THEN 'PA'
              WHEN regexp_matches(c.c_mktsegment, 'building', 'i') AND o.o_totalprice < 50000 THEN 'Marketing'
              ELSE 'System' END AS applied_through,
         count(o.o_orderkey) AS moved
  FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE o.o_orderdate >= TIMESTAMP '1998-01-01'
  GROUP BY ROLLUP (1, 2, 3, 4)
)
SELECT CASE WHEN prod IS NULL THEN 'Total' ELSE prod END AS product,
       CASE WHEN sku IS NULL THEN 'Total' ELSE sku END AS sku,
       CASE WHEN ct IS NULL THEN 'Total' ELSE ct END AS customer_type,
       CASE WHEN applied_through IS NULL THEN 'Total' ELSE applied_through END AS oic,
       moved
FROM data
""")
def rollup_null_label(spark, d, *, start="1998-01-01", end=None, owners=None):
    """Referrals since ``start`` (before ``end``, if given) by product, SKU, customer type
    and channel; ``owners`` keeps those of the listed owners only (``c_mktsegment`` has
    the owner's role)."""
    t = Tables(spark, d)
    o = t.orders.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        o = o.where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    j = o.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    j = maybe_in(j, "c_mktsegment", owners)
    urgent = imatch("o_orderpriority", "urgent")
    zone = similar_prefix(F.col("o_custkey").cast("string"), ["1", "2", "3"])
    seg = F.col("c_mktsegment")
    sku = case_cascade([
        (urgent & zone, F.concat("o_orderstatus", F.lit(" AP & TG"))),
        (urgent & ~zone, F.concat("o_orderstatus", F.lit(" ROI"))),
        (imatch("o_orderstatus", "p"), F.concat(F.lit("PEND "), "o_orderstatus")),
    ], F.col("o_orderstatus"))
    through = case_cascade([
        (nimatch(seg, "(building|machinery)"), "Assisted"),
        (imatch(seg, "building") & (F.col("o_totalprice") > 200000), "PA"),
        (imatch(seg, "building") & (F.col("o_totalprice") < 50000), "Marketing"),
    ], "System")
    return rollup_totals(j, {"product": F.split_part("o_orderpriority", F.lit("-"), F.lit(2)),
                             "sku": sku, "customer_type": seg, "oic": through},
                         [F.count("o_orderkey").alias("moved")], mark="null")


@query("working_days", ids="C7 R12 SRC9 A21 J25 F3 F8", sql="""
WITH dates AS (SELECT CAST(generate_series AS DATE) AS dates
               FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)),
base AS (
  SELECT CAST(ts AS DATE) AS applied_date, count(1) AS total_leads
  FROM events
  WHERE NOT regexp_matches(event_type, '(error|sign)', 'i')
    AND ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31'
  GROUP BY 1 HAVING count(1) > 100
)
SELECT count(1) FILTER (WHERE applied_date IS NOT NULL) AS date_past
FROM dates d LEFT JOIN base b ON d.dates = b.applied_date
""")
def working_days_q(spark, d, *, start=CAL_START, end=CAL_END, threshold=100):
    t = Tables(spark, d)
    ev = t.events.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) &
                        (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
    return working_days(date_series(spark, start, end), ev, t="ts",
                        keep=nimatch("event_type", "(error|sign)"), threshold=threshold)


@query("agent_day", ids="C6 R22 DT2 DT4 DT5 A1 A3 A4 MA1", sql="""
SELECT CAST(ts AS DATE) AS call_date, 'agent-' || CAST(user_id AS VARCHAR) AS oic,
       CASE WHEN extract(dow FROM CAST(ts AS DATE)) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
       count(*) AS total_calls,
       count(*) FILTER (WHERE event_type != 'error') AS effective_calls,
       strftime(min(ts), '%H:%M:%S') AS first_call_time,
       strftime(max(ts), '%H:%M:%S') AS last_call_time,
       CAST(CASE WHEN count(*) = 0 THEN 0 WHEN count(*) < 40 THEN 0.5 ELSE 1 END AS DOUBLE) AS attendance_count,
       CAST(round((epoch_us(max(ts)) - epoch_us(min(ts)))::DECIMAL(20,0) / 3600000000, 2) AS DOUBLE) AS hours_logged
FROM events
WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'
  AND NOT regexp_matches('agent-' || CAST(user_id AS VARCHAR), '^agent-1[0-9]$', 'i')
GROUP BY 1, 2, 3
""")
def agent_day_q(spark, d, *, start="2024-01-01", end="2024-02-01"):
    t = Tables(spark, d)
    calls = t.events.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) &
                           (F.col("ts") < F.lit(end).cast("timestamp_ntz"))) \
        .withColumn("oic", F.concat(F.lit("agent-"), F.col("user_id").cast("string")))
    return agent_day(calls, owner="oic", t="ts", effective=F.col("event_type") != "error",
                     exclude_owner=imatch("oic", "^agent-1[0-9]$"))


@query("prior_state", ids="W1", sql="""
SELECT DISTINCT user_id, prior_state, prior_state_at FROM (
  SELECT user_id, event_type AS prior_state, ts AS prior_state_at,
         dense_rank() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_type DESC) AS rk
  FROM events) x
WHERE rk = 2
""")
def prior_state(spark, d):
    return nth_state(Tables(spark, d).events, "user_id", "ts", "event_type")


@query("progress_ladder", ids="A10", sql="""
SELECT user_id,
       CASE WHEN bool_or(regexp_matches(event_type, 'purchase$', 'i')) THEN '07'
            WHEN bool_or(regexp_matches(event_type, '(click|view)$', 'i')) THEN '05'
            WHEN bool_or(regexp_matches(event_type, '^sign', 'i')) THEN '02'
            ELSE '00' END AS stage
FROM events GROUP BY user_id
""")
def progress_ladder(spark, d):
    ev = Tables(spark, d).events
    et = F.col("event_type")
    return ev.groupBy("user_id").agg(progress([
        (imatch(et, "purchase$"), "07"), (imatch(et, "(click|view)$"), "05"),
        (imatch(et, "^sign"), "02")], "00").alias("stage"))


@query("call_state", ids="A9 Q8", sql="""
SELECT c.c_custkey,
       (SELECT CASE WHEN bool_and(regexp_matches(e.event_type, '(error|view)', 'i')) THEN 'NC'
                    WHEN bool_or(regexp_matches(e.event_type, '(error|view)', 'i')) THEN 'Contact'
                    ELSE 'No Call' END
        FROM events e WHERE e.user_id = c.c_custkey) AS call_state
FROM customer c
""")
def call_state(spark, d):
    t = Tables(spark, d)
    nc = imatch("event_type", "(error|view)")
    out = agg_per_key(t.customer.select("c_custkey"), t.events,
                      [("c_custkey", "user_id")],
                      [F.bool_and(nc).alias("__all"), F.bool_or(nc).alias("__any")])
    return out.select("c_custkey", F.when(F.col("__all"), "NC").when(F.col("__any"), "Contact")
                      .otherwise("No Call").alias("call_state"))


@query("string_agg_types", ids="A13 STR6", sql="""
SELECT l_orderkey,
       string_agg(l_returnflag || ':' || CAST(l_linenumber AS VARCHAR), ' , '
                  ORDER BY l_linenumber, l_returnflag) FILTER (WHERE l_quantity > 25) AS hi_lines,
       count(*) FILTER (WHERE l_quantity > 25) AS n_hi
FROM lineitem GROUP BY l_orderkey
""")
def string_agg_types(spark, d):
    # string_agg per order over its lines: one string holds one order's lines, so its
    # length is that of the largest order (13 lines in the test tables).
    li = Tables(spark, d).lineitem
    hi = F.col("l_quantity") > 25
    return li.groupBy("l_orderkey").agg(
        join_strings(F.concat("l_returnflag", F.lit(":"), F.col("l_linenumber").cast("string")), " , ",
                     order="l_linenumber", where=hi).alias("hi_lines"),
        F.count(F.when(hi, 1)).alias("n_hi"))


@query("joined_distinct", ids="A14 STR1", sql="""
SELECT user_id,
       string_agg(DISTINCT split_part(event_type, 'i', 1), ',' ORDER BY split_part(event_type, 'i', 1))
                FILTER (WHERE value > 95) AS types_hi
FROM events GROUP BY user_id
""")
def joined_distinct(spark, d):
    ev = Tables(spark, d).events
    return ev.groupBy("user_id").agg(
        join_distinct(F.split_part("event_type", F.lit("i"), F.lit(1)), ",", where=F.col("value") > 95)
        .alias("types_hi"))


@query("parallel_arrays", ids="A12", sql="""
SELECT l_orderkey,
       array_to_string(array_agg(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), ',') AS line_numbers,
       array_to_string(array_agg(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), ',') AS quantities,
       array_to_string(array_agg(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), ',') AS flags
FROM lineitem GROUP BY l_orderkey
""")
def parallel_arrays(spark, d):
    li = Tables(spark, d).lineitem
    arr = collect_struct({"ln": "l_linenumber", "q": "l_quantity", "f": "l_returnflag"},
                         ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    g = li.groupBy("l_orderkey").agg(arr.alias("a"))

    def text(field):
        return F.array_join(F.transform("a", lambda e: e[field].cast("string")), ",")
    return g.select("l_orderkey", text("ln").alias("line_numbers"), text("q").alias("quantities"),
                    text("f").alias("flags"))


@query("answers_map", ids="A15 JS2 A23", sql="""
SELECT user_id,
       string_agg(event_type || '=' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR), ';' ORDER BY event_type) AS answers,
       count(*) AS n_keys
FROM (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, value
      FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC) x
GROUP BY user_id
""")
def answers_map_q(spark, d):
    ev = Tables(spark, d).events
    latest = first_per(ev, ["user_id", "event_type"], ["ts", "event_id"], ["value"], last=True)
    m = latest.groupBy("user_id").agg(
        answers_map("event_type", F.col("value").cast("decimal(10,2)")).alias("m"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return m.select("user_id", text.alias("answers"), F.size("m").cast("long").alias("n_keys"))


@query("csv_list_explode", ids="AR1 STR2", sql="""
SELECT DISTINCT user_id, t AS token
FROM events,
     unnest(string_split(concat_ws(',', event_type, 'k' || json_extract_string(props, '$.k'),
                                   CASE WHEN value > 50 THEN 'hi' END), ',')) AS u(t)
""")
def csv_list_explode(spark, d):
    # unnest(string_to_array(list, ',')) on a per-row comma list, then distinct.
    ev = Tables(spark, d).events
    lst = F.concat_ws(",", "event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k")),
                      F.when(F.col("value") > 50, F.lit("hi")))
    return ev.select("user_id", F.explode(F.split(lst, ",")).alias("token")).distinct()


@query("basic_aggs", ids="A1 A2 A4 A5 A17 O1", sql="""
SELECT o_orderstatus, count(*) AS n_rows, count(o_orderkey) AS n_keys,
       count(DISTINCT o_custkey) AS n_customers,
       min(o_totalprice) AS min_price, max(o_totalprice) AS max_price,
       sum(CASE WHEN regexp_matches(o_orderpriority, 'urgent', 'i') THEN 2
                WHEN regexp_matches(o_orderpriority, 'high', 'i') THEN 1 ELSE 0 END) AS score
FROM orders GROUP BY 1 ORDER BY 1
""")
def basic_aggs(spark, d):
    o = Tables(spark, d).orders
    score = F.when(imatch("o_orderpriority", "urgent"), 2).when(imatch("o_orderpriority", "high"), 1) \
        .otherwise(0)
    return o.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("o_orderkey").alias("n_keys"),
        F.count_distinct("o_custkey").alias("n_customers"),
        F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"),
        F.sum(score).cast("long").alias("score")).orderBy("o_orderstatus")


@query("distinct_keys", ids="A22", sql="""
SELECT DISTINCT o_custkey, o_orderstatus FROM orders
""")
def distinct_keys(spark, d):
    return Tables(spark, d).orders.select("o_custkey", "o_orderstatus").distinct()


@query("value_frequency", ids="A26", sql="""
SELECT event_type, count(*) AS n FROM events GROUP BY event_type
""")
def value_frequency(spark, d):
    return Tables(spark, d).events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("arbitrary_row_fixed", ids="O2 O3 AR2", sql="""
SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate
FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate
""")
def arbitrary_row_fixed(spark, d):
    li = Tables(spark, d).lineitem
    return first_per(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"],
                     ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"])


def _dash_total_rates(df, cols):
    """Text rate columns of the appended total row read '-' (rates do not add)."""
    is_total = F.col("campaign_name") == "Total"
    return df.withColumns({c: F.when(is_total, F.lit("-")).otherwise(F.col(c)) for c in cols})


def _outcome():
    return (F.when(F.col("event_type") == "click", "Answered Linkcall")
            .when(F.col("event_type") == "view", "Answered Linkcall Abandoned")
            .when(F.col("event_type") == "purchase", "Answered Hangup")
            .when(F.col("event_type") == "error", "Busy").otherwise("No Answer"))


_OUTCOME_SQL = """CASE event_type WHEN 'click' THEN 'Answered Linkcall'
                   WHEN 'view' THEN 'Answered Linkcall Abandoned'
                   WHEN 'purchase' THEN 'Answered Hangup' WHEN 'error' THEN 'Busy'
                   ELSE 'No Answer' END"""


@query("call_disposition", ids="C9 R3 R5 A16 A24 SET1 STR10 U5 P8 F13", sql=f"""
WITH calls AS (
  SELECT c.c_mktsegment AS campaign_name, e.user_id, {_OUTCOME_SQL} AS last_result
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
),
mivr AS (
  SELECT campaign_name, count(DISTINCT user_id) AS total_calls,
    count(DISTINCT user_id) FILTER (WHERE last_result IN ({_listed(DIALLED)})) AS dialled,
    count(DISTINCT user_id) FILTER (WHERE last_result IN ({_listed(ANSWERED)})) AS answered,
    count(DISTINCT user_id) FILTER (WHERE last_result IN ({_listed(KEYPRESS)})) AS keypress,
    count(DISTINCT user_id) FILTER (WHERE last_result IN ({_listed(CONNECTED)})) AS connected,
    count(DISTINCT user_id) FILTER (WHERE last_result IN ({_listed(ABANDONED)})) AS abandoned,
    count(DISTINCT user_id) FILTER (WHERE last_result IN ({_listed(HANGUP)})) AS hangup
  FROM calls GROUP BY campaign_name
),
chatbot AS (
  SELECT 'Chatbot' AS campaign_name, count(DISTINCT user_id) AS total_calls, 0 AS dialled,
         count(DISTINCT user_id) AS answered, count(DISTINCT user_id) AS keypress,
         count(DISTINCT user_id) AS connected, 0 AS abandoned, NULL::BIGINT AS hangup
  FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY
),
allrows AS (
  SELECT campaign_name, total_calls, dialled, answered, keypress, connected, abandoned,
         coalesce(hangup, 0) AS hangup,
         printf('%.2f%%', answered / nullif(total_calls, 0) * 100) AS answered_pct,
         printf('%.2f%%', keypress / nullif(total_calls, 0) * 100) AS keypress_pct,
         printf('%.2f%%', connected / nullif(total_calls, 0) * 100) AS connected_pct
  FROM (SELECT * FROM mivr UNION ALL SELECT * FROM chatbot) u
)
SELECT * FROM allrows
UNION ALL
SELECT 'Total', sum(total_calls), sum(dialled), sum(answered), sum(keypress), sum(connected),
       sum(abandoned), sum(hangup), '-', '-', '-'
FROM allrows
""")
def call_disposition(spark, d, *, run_date=RUN_DATE):
    t = Tables(spark, d)
    calls = t.events.join(t.customer.select(F.col("c_custkey").alias("user_id"),
                                            F.col("c_mktsegment").alias("campaign_name")), "user_id") \
        .withColumn("last_result", _outcome())
    mivr = disposition_summary(calls, ["campaign_name"], "user_id", "last_result",
                               {"dialled": DIALLED, "answered": ANSWERED, "keypress": KEYPRESS,
                                "connected": CONNECTED, "abandoned": ABANDONED, "hangup": HANGUP},
                               total="total_calls")
    since = F.date_sub(F.lit(run_date).cast("date"), 1).cast("timestamp_ntz")
    chat = t.events.where((F.col("event_type") == "signup") & (F.col("ts") >= since)) \
        .agg(F.count_distinct("user_id").alias("total_calls"))
    chat = chat.select(F.lit("Chatbot").alias("campaign_name"), "total_calls",
                       F.lit(0).cast("long").alias("dialled"), F.col("total_calls").alias("answered"),
                       F.col("total_calls").alias("keypress"), F.col("total_calls").alias("connected"),
                       F.lit(0).cast("long").alias("abandoned"))
    rows = fill_zero(mivr.unionByName(chat, allowMissingColumns=True))
    rate = {f"{c}_pct": pct_text_ratio(F.try_divide(F.col(c), F.col("total_calls")))
            for c in ("answered", "keypress", "connected")}
    rows = rows.withColumns(rate)
    total = with_total_row(rows, "campaign_name")
    return _dash_total_rates(total, list(rate))


@query("bind_one_row", ids="J27 P8", sql="""
SELECT * FROM
  (SELECT count(*) AS n_events FROM events) a,
  (SELECT count(*) AS n_purchases FROM events WHERE event_type = 'purchase') b,
  (SELECT count(DISTINCT user_id) AS n_users FROM events) c,
  (SELECT coalesce(sum(value), 0) AS refund_value FROM events WHERE event_type = 'refund') r
""")
def bind_one_row(spark, d):
    ev = Tables(spark, d).events
    kind = F.col("event_type")
    return fill_zero(bind_cols(ev.agg(F.count(F.lit(1)).alias("n_events")),
                               ev.where(kind == "purchase").agg(F.count(F.lit(1)).alias("n_purchases")),
                               ev.agg(F.count_distinct("user_id").alias("n_users")),
                               ev.where(kind == "refund").agg(F.sum("value").alias("refund_value"))))


@query("disposition_full_join", ids="J26", sql=f"""
WITH calls AS (SELECT user_id, {_OUTCOME_SQL} AS r, ts FROM events),
a AS (SELECT user_id, count(*) AS answered FROM calls WHERE r = 'Answered Linkcall' GROUP BY user_id),
b AS (SELECT user_id, count(*) AS busy FROM calls WHERE r = 'Busy' GROUP BY user_id),
c AS (SELECT user_id, count(*) AS hangup, max(ts) AS last_hangup FROM calls WHERE r = 'Answered Hangup' GROUP BY user_id)
SELECT user_id, coalesce(answered, 0) AS answered, coalesce(busy, 0) AS busy, coalesce(hangup, 0) AS hangup, last_hangup
FROM a FULL JOIN b USING (user_id) FULL JOIN c USING (user_id)
""")
def disposition_full_join(spark, d):
    """Frames counted apart and joined by their key, where no single pass makes them."""
    calls = Tables(spark, d).events.withColumn("r", _outcome())

    def counted(outcome, name, *more):
        return calls.where(F.col("r") == outcome).groupBy("user_id").agg(F.count(F.lit(1)).alias(name), *more)
    return fill_zero(full_join_all([counted("Answered Linkcall", "answered"), counted("Busy", "busy"),
                                    counted("Answered Hangup", "hangup", F.max("ts").alias("last_hangup"))], "user_id"))


@query("safe_ratio", ids="MA2 MA3 STR2 STR11", sql="""
SELECT segment, n_orders, n_f, segment || ' / ' || CAST(n_orders AS VARCHAR) AS label,
       round(n_f / nullif(n_orders, 0)::NUMERIC * 100, 1) || ' %' AS pct_f,
       round(n_f / nullif(n_x, 0)::NUMERIC * 100, 1) || ' %' AS pct_f_of_x,
       n_orders % 7 AS bucket
FROM (SELECT c.c_mktsegment AS segment, count(*) AS n_orders,
             count(*) FILTER (WHERE o.o_orderstatus = 'F') AS n_f,
             count(*) FILTER (WHERE o.o_orderstatus = 'X') AS n_x
      FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1) s
""")
def safe_ratio_q(spark, d):
    t = Tables(spark, d)
    j = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"),
                                        F.col("c_mktsegment").alias("segment")), "o_custkey")
    s = j.groupBy("segment").agg(F.count(F.lit(1)).alias("n_orders"),
                                 F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_f"),
                                 F.count(F.when(F.col("o_orderstatus") == "X", 1)).alias("n_x"))
    return s.select("segment", "n_orders", "n_f",
                    F.concat("segment", F.lit(" / "), F.col("n_orders").cast("string")).alias("label"),
                    pct_text(F.col("n_f"), F.col("n_orders")).alias("pct_f"),
                    pct_text(F.col("n_f"), F.col("n_x")).alias("pct_f_of_x"),
                    (F.col("n_orders") % 7).alias("bucket"))


_OB_SQL = """CASE WHEN l_returnflag = 'R' THEN 'Answered Linkcall'
                   WHEN l_returnflag = 'A' THEN 'Answered Linkcall Abandoned'
                   WHEN l_linestatus = 'O' THEN 'Answered Hangup' ELSE 'Busy' END"""


@query("call_mis_combined", ids="R3 C9 A16 A24 SET1 SRC5 F13 P8 STR10", sql=f"""
WITH ivr AS (
  SELECT c.c_mktsegment AS campaign_name, e.user_id AS id, {_OUTCOME_SQL} AS r
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
),
mivr AS (
  SELECT campaign_name, count(DISTINCT id) AS total_calls,
    count(DISTINCT id) FILTER (WHERE r IN ({_listed(DIALLED)})) AS dialled,
    count(DISTINCT id) FILTER (WHERE r IN ({_listed(ANSWERED)})) AS answered,
    count(DISTINCT id) FILTER (WHERE r IN ({_listed(KEYPRESS)})) AS keypress,
    count(DISTINCT id) FILTER (WHERE r IN ({_listed(CONNECTED)})) AS connected,
    count(DISTINCT id) FILTER (WHERE r IN ({_listed(ABANDONED)})) AS abandoned,
    count(DISTINCT id) FILTER (WHERE r IN ({_listed(HANGUP)})) AS hangup
  FROM ivr GROUP BY campaign_name
),
ob_calls AS (SELECT l_suppkey AS phone, {_OB_SQL} AS r FROM lineitem),
ob AS (
  SELECT 'OB' AS campaign_name, count(DISTINCT phone) AS total_calls,
    count(DISTINCT phone) FILTER (WHERE r IN ({_listed(DIALLED)})) AS dialled,
    count(DISTINCT phone) FILTER (WHERE r IN ({_listed(ANSWERED)})) AS answered,
    count(DISTINCT phone) FILTER (WHERE r IN ({_listed(KEYPRESS)})) AS keypress,
    count(DISTINCT phone) FILTER (WHERE r IN ({_listed(CONNECTED)})) AS connected,
    count(DISTINCT phone) FILTER (WHERE r IN ({_listed(ABANDONED)})) AS abandoned,
    count(DISTINCT phone) FILTER (WHERE r IN ({_listed(HANGUP)})) AS hangup
  FROM ob_calls
),
chat_dump AS (
  SELECT user_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS chatbot_agent_id,
         date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) AS created_at_serial
  FROM events WHERE event_type = 'signup'
),
chatbot AS (
  SELECT 'Chatbot' AS campaign_name, count(DISTINCT user_id) AS total_calls, 0 AS dialled,
         count(DISTINCT user_id) AS answered, count(DISTINCT user_id) AS keypress,
         count(DISTINCT user_id) AS connected, 0 AS abandoned, 0 AS hangup
  FROM chat_dump
  WHERE chatbot_agent_id IN (1, 2, 3, 4)
    AND DATE '1899-12-30' + CAST(created_at_serial AS INTEGER) >= DATE '2024-01-30' - INTERVAL 1 DAY
),
drop_dump AS (SELECT {_OUTCOME_SQL} AS r FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) < 20),
ib_drop AS (
  SELECT 'IB Drop' AS campaign_name, count(*) AS total_calls, 0 AS dialled,
    count(*) FILTER (WHERE r IN ({_listed(KEYPRESS)})) AS answered,
    count(*) FILTER (WHERE r IN ({_listed(KEYPRESS)})) AS keypress,
    count(*) FILTER (WHERE r IN ({_listed(CONNECTED)})) AS connected,
    count(*) FILTER (WHERE r IN ({_listed(ABANDONED)})) AS abandoned,
    count(*) FILTER (WHERE r IN ({_listed(HANGUP)})) AS hangup
  FROM drop_dump
),
allrows AS (
  SELECT *, printf('%.2f%%', answered / nullif(total_calls, 0) * 100) AS answered_pct,
         printf('%.2f%%', keypress / nullif(total_calls, 0) * 100) AS keypress_pct,
         printf('%.2f%%', connected / nullif(total_calls, 0) * 100) AS connected_pct
  FROM (SELECT * FROM mivr UNION ALL SELECT * FROM ob UNION ALL SELECT * FROM chatbot
        UNION ALL SELECT * FROM ib_drop) u
)
SELECT * FROM allrows
UNION ALL
SELECT 'Total', sum(total_calls), sum(dialled), sum(answered), sum(keypress), sum(connected),
       sum(abandoned), sum(hangup), '-', '-', '-'
FROM allrows
""")
def call_mis_combined(spark, d, *, run_date=RUN_DATE):
    from funnelkit.sources.tables import serial_to_date
    t = Tables(spark, d)
    buckets = {"dialled": DIALLED, "answered": ANSWERED, "keypress": KEYPRESS, "connected": CONNECTED,
               "abandoned": ABANDONED, "hangup": HANGUP}
    ivr = t.events.join(t.customer.select(F.col("c_custkey").alias("user_id"),
                                          F.col("c_mktsegment").alias("campaign_name")), "user_id") \
        .withColumn("r", _outcome())
    mivr = disposition_summary(ivr, ["campaign_name"], "user_id", "r", buckets, total="total_calls")
    ob_calls = t.lineitem.select(F.col("l_suppkey").alias("phone"), F.when(F.col("l_returnflag") == "R", "Answered Linkcall")
                                 .when(F.col("l_returnflag") == "A", "Answered Linkcall Abandoned")
                                 .when(F.col("l_linestatus") == "O", "Answered Hangup").otherwise("Busy").alias("r"))
    ob = disposition_summary(ob_calls, [], "phone", "r", buckets, total="total_calls") \
        .withColumn("campaign_name", F.lit("OB"))
    # The chatbot dump (spreadsheet day serials converted back to dates) and the dropped
    # calls are both cut from the event log: one pass, a row a user, then one row of sums.
    code = F.get_json_object("props", "$.k").try_cast("int")
    serial = F.datediff(F.to_date("ts"), F.lit("1899-12-30").cast("date"))
    since = F.date_sub(F.lit(run_date).cast("date"), 1)
    dump = t.events.select("user_id", ((F.col("event_type") == "signup") & code.isin(1, 2, 3, 4)
                                       & (serial_to_date(serial) >= since)).alias("chat"),
                           (code < 20).alias("dropped"), _outcome().alias("r")).where("chat OR dropped")
    counted = {"total_calls": F.lit(True), "answered": F.col("r").isin(KEYPRESS), "keypress": F.col("r").isin(KEYPRESS),
               "connected": F.col("r").isin(CONNECTED), "abandoned": F.col("r").isin(ABANDONED), "hangup": F.col("r").isin(HANGUP)}
    sums = dump.groupBy("user_id").agg(
        F.max(F.when(F.col("user_id").isNotNull(), F.col("chat").cast("long"))).alias("chat"),
        *[F.count(F.when(F.col("dropped") & c, 1)).alias(n) for n, c in counted.items()]) \
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chat", *counted)])
    zero, chat = F.lit(0).cast("long"), F.col("chat")
    more = sums.select(F.inline(F.array(
        F.struct(F.lit("Chatbot").alias("campaign_name"), chat.alias("total_calls"), zero.alias("dialled"), chat.alias("answered"),
                 chat.alias("keypress"), chat.alias("connected"), zero.alias("abandoned"), zero.alias("hangup")),
        F.struct(F.lit("IB Drop").alias("campaign_name"), "total_calls", zero.alias("dialled"), "answered", "keypress",
                 "connected", "abandoned", "hangup"))))
    rows = fill_zero(mivr.unionByName(ob).unionByName(more))
    rate = {f"{c}_pct": pct_text_ratio(F.try_divide(F.col(c), F.col("total_calls")))
            for c in ("answered", "keypress", "connected")}
    rows = rows.withColumns(rate).select("campaign_name", "total_calls", "dialled", "answered", "keypress",
                                         "connected", "abandoned", "hangup", *rate)
    return _dash_total_rates(with_total_row(rows, "campaign_name"), list(rate))
