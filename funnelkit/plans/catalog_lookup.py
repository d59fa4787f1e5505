"""Lookup-family queries over the driver tables.

Role bindings: ``customer`` = user, ``orders`` = application / lead (o_custkey
user, o_orderdate applied date), ``lineitem`` = a lead's child log, ``events``
= login / call / stage log, ``part`` = SKU, ``nation``/``region`` = masters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelkit.functions.expr import half_open, imatch, nimatch
from funnelkit.operators.agg import milestone, milestone_and_not, first_by
from funnelkit.operators.lookup import (asof_join, first_per, hot_keys_for, lookback_join,
                                        lookup_latest, prefix_agg, range_agg, range_join,
                                        agg_per_key, time_micros, window_count)
from funnelkit.operators.member import anti, attach_flag, flag_earlier_exists, semi, suppress
from funnelkit.plans.registry import Tables, query

# Fixed run parameters of the registered queries (report dates and thresholds).
EVENT_START, EVENT_END = "2024-01-05", "2024-01-25"
ACTIVE_SINCE = "2024-01-20"
H48 = 48 * 3600
WEEK = 7 * 86400


@query("first_event_per_user", ids="A23 R23 F1 F8", sql="""
SELECT DISTINCT ON (user_id) user_id, event_id, ts, event_type, value
FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'
  AND NOT regexp_matches(event_type, '(error|signup)', 'i')
ORDER BY user_id, ts, event_id
""")
def first_event_per_user(spark, d, *, start=EVENT_START, end=EVENT_END, exclude="(error|signup)"):
    ev = Tables(spark, d).events
    f = ev.where(half_open("ts", start, end) & nimatch("event_type", exclude))
    return first_per(f, "user_id", ["ts", "event_id"], ["event_id", "ts", "event_type", "value"])


@query("latest_event_lookup", ids="J7 J8", sql="""
SELECT c.c_custkey, c.c_name, le.event_id AS last_event_id,
       le.event_type AS last_event_type, le.ts AS last_event_ts
FROM customer c
LEFT JOIN LATERAL (SELECT event_id, event_type, ts FROM events e
                   WHERE e.user_id = c.c_custkey
                   ORDER BY ts DESC, event_id DESC LIMIT 1) le ON TRUE
""")
def latest_event_lookup(spark, d):
    t = Tables(spark, d)
    ev = t.events.select("user_id", F.col("event_id").alias("last_event_id"),
                         F.col("event_type").alias("last_event_type"), F.col("ts").alias("last_event_ts"))
    return lookup_latest(t.customer.select("c_custkey", "c_name"), ev, [("c_custkey", "user_id")],
                         ["last_event_ts", "last_event_id"],
                         ["last_event_id", "last_event_type", "last_event_ts"])


@query("last_matching_event_ts", ids="J29", sql="""
SELECT c.c_custkey,
       (SELECT max(l.l_shipdate) FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        WHERE o.o_custkey = c.c_custkey AND l.l_returnflag = 'R'
          AND regexp_matches(o.o_orderpriority, '(urgent|high)', 'i')) AS last_return_ship
FROM customer c
""")
def last_matching_event_ts(spark, d):
    t = Tables(spark, d)
    o = t.orders.where(imatch("o_orderpriority", "(urgent|high)")).select("o_orderkey", "o_custkey")
    li = t.lineitem.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_shipdate")
    pair = o.join(li, o.o_orderkey == li.l_orderkey)
    return agg_per_key(t.customer.select("c_custkey"), pair, [("c_custkey", "o_custkey")],
                       [F.max("l_shipdate").alias("last_return_ship")])


@query("latest_order_by_id", ids="J9 J1", sql="""
SELECT c.c_custkey, c.c_mktsegment, o.o_orderkey, o.o_orderstatus, o.o_totalprice
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
 AND o.o_orderkey = (SELECT max(o2.o_orderkey) FROM orders o2 WHERE o2.o_custkey = c.c_custkey)
""")
def latest_order_by_id(spark, d):
    t = Tables(spark, d)
    return lookup_latest(t.customer.select("c_custkey", "c_mktsegment"), t.orders,
                         [("c_custkey", "o_custkey")], ["o_orderkey"],
                         ["o_orderkey", "o_orderstatus", "o_totalprice"], how="inner")


def _purchases(t):
    return t.events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")


@query("asof_previous_click", ids="J10 U1", sql="""
SELECT p.event_id, p.user_id, p.ts, c.event_id AS click_id, c.ts AS click_ts, c.value AS click_value
FROM events p
LEFT JOIN LATERAL (SELECT event_id, ts, value FROM events c
                   WHERE c.user_id = p.user_id AND c.event_type = 'click' AND c.ts < p.ts
                   ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) c ON TRUE
WHERE p.event_type = 'purchase'
""")
def asof_previous_click(spark, d):
    t = Tables(spark, d)
    clicks = t.events.where(F.col("event_type") == "click").select(
        "user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"),
        F.col("value").alias("click_value"))
    return asof_join(_purchases(t), clicks, "user_id", "ts", "click_ts",
                     ["click_id", "click_ts", "click_value"], strict=True, tiebreak=["click_id"],
                     hot=hot_keys_for(t.events, "user_id", "ts", holds_right=True))


@query("previous_click_value", ids="J10 (every event)", sql="""
SELECT e.event_id, e.user_id, e.event_type,
       (SELECT c.value FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click'
          AND c.ts < e.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) AS prev_click_value
FROM events e
""")
def previous_click_value(spark, d):
    t = Tables(spark, d)
    clicks = t.events.where(F.col("event_type") == "click").select(
        "user_id", F.col("ts").alias("cts"), F.col("event_id").alias("cid"),
        F.col("value").alias("prev_click_value"))
    base = t.events.select("event_id", "user_id", "event_type", "ts")
    # both sides are the event log: its keys are counted once
    out = asof_join(base, clicks, "user_id", "ts", "cts", ["prev_click_value"], tiebreak=["cid"],
                    hot=hot_keys_for(t.events, "user_id", "ts", holds_right=True))
    return out.drop("ts")


@query("asof_open_bound", ids="J11", sql="""
SELECT c.c_custkey, b.first_purchase_ts,
       (SELECT max(e.event_id) FROM events e WHERE e.user_id = c.c_custkey
          AND e.ts <= coalesce(b.first_purchase_ts, 'infinity'::TIMESTAMP)) AS max_event_id
FROM customer c
LEFT JOIN (SELECT user_id, min(ts) AS first_purchase_ts FROM events
           WHERE event_type = 'purchase' GROUP BY user_id) b ON b.user_id = c.c_custkey
""")
def asof_open_bound(spark, d):
    t = Tables(spark, d)
    bounds = t.events.where(F.col("event_type") == "purchase").groupBy(
        F.col("user_id").alias("c_custkey")).agg(F.min("ts").alias("first_purchase_ts"))
    cust = t.customer.select("c_custkey").join(bounds, "c_custkey", "left")
    ev = t.events.select(F.col("user_id").alias("c_custkey"), "ts", "event_id")
    return range_agg(cust, ev, "c_custkey", "first_purchase_ts", "ts",
                     {"max_event_id": ("max", F.col("event_id"))}, inclusive=True,
                     hot=hot_keys_for(t.events, "user_id", "ts", holds_right=True))


@query("lookback_48h_last", ids="J12", sql="""
SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.ts AS view_ts
FROM events p
LEFT JOIN LATERAL (SELECT event_id, ts FROM events v
                   WHERE v.user_id = p.user_id AND v.event_type = 'view'
                     AND v.ts >= p.ts - INTERVAL 48 HOUR AND v.ts < p.ts
                   ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON TRUE
WHERE p.event_type = 'purchase'
""")
def lookback_48h_last(spark, d):
    t = Tables(spark, d)
    views = t.events.where(F.col("event_type") == "view").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    return lookback_join(_purchases(t), views, "user_id", "ts", "view_ts", ["view_id", "view_ts"],
                         H48, pick="last", tiebreak=["view_id"], hot=hot_keys_for(t.events, "user_id", "ts", holds_right=True))


@query("lookback_48h_first", ids="J13", sql="""
SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.ts AS view_ts
FROM events p
LEFT JOIN LATERAL (SELECT event_id, ts FROM events v
                   WHERE v.user_id = p.user_id AND v.event_type = 'view'
                     AND v.ts >= p.ts - INTERVAL 48 HOUR AND v.ts < p.ts
                   ORDER BY v.ts, v.event_id LIMIT 1) v ON TRUE
WHERE p.event_type = 'purchase'
""")
def lookback_48h_first(spark, d):
    t = Tables(spark, d)
    views = t.events.where(F.col("event_type") == "view").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    return lookback_join(_purchases(t), views, "user_id", "ts", "view_ts", ["view_id", "view_ts"],
                         H48, pick="first", tiebreak=["view_id"], hot=hot_keys_for(t.events, "user_id", "ts", holds_right=True))


@query("range_join_conversions", ids="J10 J15", sql="""
SELECT s.event_id, s.user_id, s.ts,
       (SELECT count(*) FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'purchase'
          AND p.ts >= s.ts AND p.ts < s.ts + INTERVAL 7 DAY) AS purchases_7d,
       (SELECT p.event_id FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'purchase'
          AND p.ts >= s.ts AND p.ts < s.ts + INTERVAL 7 DAY ORDER BY p.ts, p.event_id LIMIT 1)
         AS first_purchase_id
FROM events s WHERE s.event_type = 'signup'
""")
def range_join_conversions(spark, d):
    # Purchases in [ts, ts + 7 days) per signup without materialising pairs: both
    # bounds are marker rows of one counting pass; the first purchase at or after ts
    # is a forward as-of. The keys are counted once for both.
    t = Tables(spark, d)
    signups = t.events.where(F.col("event_type") == "signup").select("event_id", "user_id", "ts")
    buys = t.events.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("pts"), F.col("event_id").alias("pid"))
    hot = hot_keys_for(t.events.where(F.col("event_type").isin("signup", "purchase")), "user_id", "ts",
                       holds_right=True)
    counts = window_count(signups, buys, "user_id", "ts", "pts", 0, WEEK, "purchases_7d", row_id="event_id", hot=hot)
    first = lookback_first(signups, buys, hot)
    return counts.join(first, "event_id").select("event_id", "user_id", "ts", "purchases_7d", "first_purchase_id")


def lookback_first(signups, buys, hot):
    """The first purchase in the week from each signup on."""
    got = asof_join(signups, buys, "user_id", "ts", "pts", ["pid", "pts"], strict=False, forward=True,
                    tiebreak=["pid"], hot=hot)
    inside = F.col("pts") < F.col("ts") + F.expr("INTERVAL 7 DAYS")
    return got.select("event_id", F.when(inside, F.col("pid")).alias("first_purchase_id"))


@query("range_join_daily", ids="J14", sql="""
SELECT c.user_id, c.ts::DATE AS click_day, count(*) AS n_pairs, count(DISTINCT c.event_id) AS n_clicks,
       sum(v.value) AS view_value, min(v.ts) AS first_view_ts
FROM events c JOIN events v ON v.user_id = c.user_id AND v.event_type = 'view'
 AND v.ts >= c.ts - INTERVAL 1 DAY AND v.ts < c.ts + INTERVAL 1 DAY
WHERE c.event_type = 'click'
GROUP BY c.user_id, c.ts::DATE
""")
def range_join_daily(spark, d):
    """Views within a day of each click, summed by user and day: the match set of the
    range join is aggregated where it is made."""
    t = Tables(spark, d)
    clicks = t.events.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    views = t.events.where(F.col("event_type") == "view").select("user_id", F.col("ts").alias("vts"), "value")
    pairs = range_join(clicks, views, "user_id", "ts", "vts", -86400, 86400)
    per_click = pairs.groupBy("user_id", "event_id", F.to_date("ts").alias("click_day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.min("vts").alias("first"))
    return per_click.groupBy("user_id", "click_day").agg(
        F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_clicks"), F.sum("v").alias("view_value"),
        F.min("first").alias("first_view_ts"))


@query("range_join_pairs", ids="J14", sql="""
SELECT c.event_id, c.user_id, c.ts, v.event_id AS view_id, v.ts AS view_ts, v.value AS view_value
FROM events c JOIN events v ON v.user_id = c.user_id AND v.event_type = 'view'
 AND v.ts >= c.ts - INTERVAL 3 HOUR AND v.ts < c.ts + INTERVAL 3 HOUR
WHERE c.event_type = 'click'
""")
def range_join_pairs(spark, d):
    """Every view within three hours of a click of the same user, a row a pair. The
    window is narrow against the log's months, so a click has a handful of them."""
    t = Tables(spark, d)
    clicks = t.events.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    views = t.events.where(F.col("event_type") == "view").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    return range_join(clicks, views, "user_id", "ts", "view_ts", -3 * 3600, 3 * 3600)


@query("previous_click_cut_finely", ids="J10", sql="""
SELECT e.event_id, e.user_id,
       (SELECT c.event_id FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click'
          AND c.ts < e.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) AS prev_click_id,
       (SELECT count(*) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click'
          AND c.ts < e.ts) AS n_before
FROM events e
""")
def previous_click_cut_finely(spark, d, *, share=2000):
    """The as-of lookup with so fine a share that most users are hot keys and cut into
    cells: the same result by the split path."""
    t = Tables(spark, d)
    clicks = t.events.where(F.col("event_type") == "click").select(
        "user_id", F.col("ts").alias("cts"), F.col("event_id").alias("cid"))
    pick = F.struct(time_micros("cts", clicks).alias("o"), "cid")
    out = prefix_agg(t.events.select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "cts",
                     {"__c": ("max", pick), "n_before": ("count", F.lit(1))}, share=share)
    return out.select("event_id", "user_id", F.col("__c.cid").alias("prev_click_id"), "n_before")


@query("range_agg_before_first_purchase", ids="J15 C13 J11", sql="""
SELECT c.c_custkey, fp.first_purchase_ts,
       (coalesce(x.attempts, 0) > 0)::INTEGER AS called,
       coalesce(x.contacted, 0) AS contacted,
       coalesce(x.attempts, 0) AS attempts
FROM customer c
LEFT JOIN (SELECT user_id, min(ts) AS first_purchase_ts FROM events
           WHERE event_type = 'purchase' GROUP BY user_id) fp ON fp.user_id = c.c_custkey
LEFT JOIN LATERAL (
  SELECT count(*) AS attempts, bool_or(e.event_type <> 'error')::INTEGER AS contacted
  FROM events e
  WHERE e.user_id = c.c_custkey AND e.event_type IN ('click', 'view', 'error')
    AND e.ts < coalesce(fp.first_purchase_ts + INTERVAL 2 MINUTE, 'infinity'::TIMESTAMP)
) x ON TRUE
""")
def range_agg_before_first_purchase(spark, d):
    t = Tables(spark, d)
    fp = t.events.where(F.col("event_type") == "purchase").groupBy(
        F.col("user_id").alias("c_custkey")).agg(F.min("ts").alias("first_purchase_ts"))
    cust = t.customer.select("c_custkey").join(fp, "c_custkey", "left")
    calls = t.events.where(F.col("event_type").isin("click", "view", "error")).select(
        F.col("user_id").alias("c_custkey"), "ts", "event_type")
    bound = F.col("first_purchase_ts") + F.expr("INTERVAL 2 MINUTES")
    out = range_agg(cust.withColumn("__until", bound), calls, "c_custkey", "__until", "ts",
                    {"attempts": ("count", F.lit(1)),
                     "contacted": ("max", (F.col("event_type") != "error").cast("int"))},
                    hot=hot_keys_for(t.events, "user_id", "ts", holds_right=True))
    return out.select("c_custkey", "first_purchase_ts", (F.col("attempts") > 0).cast("int").alias("called"),
                      F.coalesce("contacted", F.lit(0)).alias("contacted"), "attempts")


@query("agg_per_key_zero", ids="J16 A1 A4 A6 A7 A8", sql="""
SELECT c.c_custkey, coalesce(x.n_events, 0) AS n_events, x.has_purchase,
       x.click_no_error, coalesce(x.has_signup, 0) AS has_signup, x.max_value
FROM customer c
LEFT JOIN LATERAL (
  SELECT count(*) AS n_events,
         bool_or(event_type = 'purchase')::INTEGER AS has_purchase,
         (bool_or(event_type = 'click') AND NOT bool_or(event_type = 'error'))::INTEGER AS click_no_error,
         bool_or(event_type = 'signup')::INTEGER AS has_signup,
         max(value) AS max_value
  FROM events e WHERE e.user_id = c.c_custkey
) x ON TRUE
""")
def agg_per_key_zero(spark, d):
    t = Tables(spark, d)
    et = F.col("event_type")
    return agg_per_key(t.customer.select("c_custkey"), t.events, [("c_custkey", "user_id")], [
        F.count(F.lit(1)).alias("n_events"),
        milestone(et == "purchase").alias("has_purchase"),
        milestone_and_not(et == "click", et == "error").alias("click_no_error"),
        milestone(et == "signup", default=0).alias("has_signup"),
        F.max("value").alias("max_value"),
    ], zero=["n_events", "has_signup"])


@query("funnel_by_type", ids="J17 A11 A3", sql="""
SELECT c.c_custkey, c.c_mktsegment, x.prod, x.n, x.pass_hi, x.first_hi_props
FROM customer c
JOIN LATERAL (
  SELECT event_type AS prod, count(*) AS n,
         bool_or(value >= 50)::INTEGER AS pass_hi,
         (array_agg(props ORDER BY ts, event_id) FILTER (WHERE value >= 50))[1] AS first_hi_props
  FROM events e WHERE e.user_id = c.c_custkey GROUP BY event_type
) x ON TRUE
WHERE x.prod IS NOT NULL
""")
def funnel_by_type(spark, d):
    t = Tables(spark, d)
    per = t.events.groupBy(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("prod")).agg(
        F.count(F.lit(1)).alias("n"),
        milestone(F.col("value") >= 50).alias("pass_hi"),
        first_by("props", ["ts", "event_id"], where=F.col("value") >= 50).alias("first_hi_props"))
    return t.customer.select("c_custkey", "c_mktsegment").join(per, "c_custkey", "inner")


@query("nested_lookup", ids="J18", sql="""
SELECT p.event_id, p.user_id, c.click_id, v.view_id
FROM events p
LEFT JOIN LATERAL (SELECT event_id AS click_id, ts AS click_ts FROM events c
                   WHERE c.user_id = p.user_id AND c.event_type = 'click' AND c.ts < p.ts
                   ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) c ON TRUE
LEFT JOIN LATERAL (SELECT event_id AS view_id FROM events v
                   WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts < c.click_ts
                   ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON TRUE
WHERE p.event_type = 'purchase'
""")
def nested_lookup(spark, d):
    t = Tables(spark, d)
    clicks = t.events.where(F.col("event_type") == "click").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    views = t.events.where(F.col("event_type") == "view").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    # both steps key the same event log by user: count its keys once and share
    # the (bounded) hot-key list along the chain
    hot = hot_keys_for(t.events, "user_id", "ts", holds_right=True)
    step1 = asof_join(_purchases(t), clicks, "user_id", "ts", "click_ts", ["click_id", "click_ts"],
                      tiebreak=["click_id"], hot=hot)
    step2 = asof_join(step1, views, "user_id", "click_ts", "view_ts", ["view_id"], tiebreak=["view_id"],
                      hot=hot)
    return step2.select("event_id", "user_id", "click_id", "view_id")


@query("semi_active_since", ids="J19 J20", sql="""
SELECT c.c_custkey, c.c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND e.ts >= TIMESTAMP '2024-01-20')
""")
def semi_active_since(spark, d):
    t = Tables(spark, d)
    return semi(t.customer.select("c_custkey", "c_name"), t.events, [("c_custkey", "user_id")],
                where=F.col("ts") >= F.lit(ACTIVE_SINCE).cast("timestamp_ntz"))


@query("anti_never_purchased", ids="J21 J23", sql="""
SELECT c.c_custkey, c.c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND e.event_type = 'purchase')
""")
def anti_never_purchased(spark, d):
    t = Tables(spark, d)
    return anti(t.customer.select("c_custkey", "c_name"), t.events, [("c_custkey", "user_id")],
                where=F.col("event_type") == "purchase")


@query("suppress_not_in", ids="J22", sql="""
SELECT c.c_custkey, c.c_mktsegment FROM customer c
WHERE c.c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95)
""")
def suppress_not_in(spark, d):
    t = Tables(spark, d)
    lst = t.events.where((F.col("event_type") == "error") & (F.col("value") > 95))
    return suppress(t.customer.select("c_custkey", "c_mktsegment"), lst, "c_custkey", "user_id")


@query("duplicate_flag", ids="J24", sql="""
SELECT o.o_orderkey, o.o_custkey,
       CASE WHEN EXISTS (SELECT 1 FROM orders o2
                         WHERE o2.o_custkey = o.o_custkey
                           AND split_part(o2.o_orderpriority, '-', 2) = split_part(o.o_orderpriority, '-', 2)
                           AND o2.o_orderstatus = 'F' AND o2.o_orderdate < o.o_orderdate)
            THEN 1 ELSE 0 END AS dup_flag
FROM orders o
""")
def duplicate_flag(spark, d):
    t = Tables(spark, d)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
                        F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("prod"))
    out = flag_earlier_exists(o, ["o_custkey", "prod"], "o_orderdate", F.col("o_orderstatus") == "F")
    return out.select("o_orderkey", "o_custkey", "dup_flag")


@query("fanout_self", ids="J5 P4", sql="""
SELECT la.o_orderkey, la.o_custkey, count(*) AS fanout_rows,
       max(CASE WHEN regexp_matches(app.o_orderpriority, 'urgent', 'i')
                 AND app.o_orderdate >= TIMESTAMP '2000-01-01' THEN 1 END) AS urgent_recent_flag,
       max(CASE WHEN regexp_matches(app.o_orderpriority, 'urgent', 'i') THEN 1 END) AS urgent_ever_flag
FROM orders la
LEFT JOIN LATERAL (SELECT * FROM orders app WHERE app.o_custkey = la.o_custkey) app ON TRUE
GROUP BY la.o_orderkey, la.o_custkey
""")
def fanout_self(spark, d):
    # The reference multiplies every lead by all of its user's leads; here the
    # fan-out is kept as its multiplicity and the per-pair flags as aggregates,
    # so no pair of rows is ever emitted.
    t = Tables(spark, d)
    urgent = imatch("o_orderpriority", "urgent")
    return agg_per_key(t.orders.select("o_orderkey", "o_custkey"), t.orders, "o_custkey", [
        F.count(F.lit(1)).alias("fanout_rows"),
        F.max(F.when(urgent & (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")),
                     1)).alias("urgent_recent_flag"),
        F.max(F.when(urgent, 1)).alias("urgent_ever_flag"),
    ], zero=["fanout_rows"])


@query("member_flags", ids="J6", sql="""
SELECT c.c_custkey,
       CASE WHEN c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN '1' END AS hv_flag,
       CASE WHEN c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN '1' END AS urgent_flag
FROM customer c
""")
def member_flags(spark, d):
    t = Tables(spark, d)
    hv = t.orders.where(F.col("o_totalprice") > 400000)
    urg = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    out = attach_flag(t.customer.select("c_custkey"), hv, "c_custkey", "hv_flag", "o_custkey")
    return attach_flag(out, urg, "c_custkey", "urgent_flag", "o_custkey")


@query("lookup_chain", ids="J4 J2", sql="""
SELECT c.c_custkey, n.n_name, r.r_name
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
""")
def lookup_chain(spark, d):
    t = Tables(spark, d)
    # nation and region are bounded masters (fixed code lists); Catalyst's
    # size statistics broadcast them, the customer side is never shuffled.
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return (t.customer.select("c_custkey", "c_nationkey").join(n, "c_nationkey", "left")
            .join(r, "n_regionkey", "left").select("c_custkey", "n_name", "r_name"))


@query("derived_key_join", ids="J25 JS1", sql="""
SELECT e.event_id, TRY_CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k, p.p_name
FROM events e JOIN part p ON p.p_partkey = TRY_CAST(json_extract_string(e.props, '$.k') AS INTEGER)
""")
def derived_key_join(spark, d):
    t = Tables(spark, d)
    ev = t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return ev.join(t.part.select(F.col("p_partkey").alias("k"), "p_name"), "k", "inner") \
        .select("event_id", "k", "p_name")


@query("multi_key_join", ids="J3", sql="""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, ps.n_lines
FROM lineitem l
JOIN (SELECT l_partkey, l_suppkey, count(*) AS n_lines, avg(l_quantity) AS avg_qty
      FROM lineitem GROUP BY 1, 2) ps
  ON ps.l_partkey = l.l_partkey AND ps.l_suppkey = l.l_suppkey AND l.l_quantity > ps.avg_qty
 AND ps.n_lines >= 2
""")
def multi_key_join(spark, d):
    t = Tables(spark, d)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    ps = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"),
                                                  F.avg("l_quantity").alias("avg_qty"))
    ps = ps.where(F.col("n_lines") >= 2)
    j = li.join(ps, ["l_partkey", "l_suppkey"], "inner").where(F.col("l_quantity") > F.col("avg_qty"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "n_lines")


@query("inner_equi", ids="J1 SRC1 P1", sql="""
SELECT o.o_orderkey, o.o_orderstatus, c.c_name, c.c_mktsegment
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
""")
def inner_equi(spark, d):
    t = Tables(spark, d)
    return t.orders.select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c_custkey")).join(
        t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").drop("c_custkey")


@query("left_equi", ids="J2", sql="""
SELECT c.c_custkey, o.o_orderkey, o.o_totalprice
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'
""")
def left_equi(spark, d):
    t = Tables(spark, d)
    o = t.orders.where(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return t.customer.select("c_custkey").join(o, "c_custkey", "left")
