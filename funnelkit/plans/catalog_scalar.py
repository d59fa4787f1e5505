"""Scalar-function and filter queries (P2-P8, F1-F15, STR1-STR11, DT1-DT9, U2-U6,
SRC7) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelkit.functions.calendar import (days_in_month, days_left, days_past, month_start,
                                          prev_month_end, prev_month_start)
from funnelkit.functions.expr import (age_years, case_cascade, cmatch, collapse_newlines,
                                      day_window, decode_label, dow_sunday0, extract_group,
                                      flag_when, half_open, imatch, m_bucket, month_diff,
                                      month_offset_label, nimatch, similar_prefix, text_between,
                                      to_numeric)
from funnelkit.operators.lookup import lookup_latest, row_positions
from funnelkit.plans.registry import Tables, query
from funnelkit.sources.sinks import write_by_team, write_csv
from funnelkit.sources.tables import maybe_in, read_csv

# Order-status labels of the decode variants.
STATUS_LABELS = {"F": "Fulfilled", "O": "Open", "P": "Partial"}
RUN_DATE = "2024-01-30"
ORDERS_RUN_DATE = "2001-06-01"


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


@query("split_codes", ids="STR1 F12 F7", sql="""
SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS prio_num,
       split_part(o_orderpriority, '-', 2) AS prio_name,
       (split_part(o_orderpriority, '-', 1) >= '3')::INTEGER AS low_half,
       regexp_matches(o_orderpriority, 'urgent$', 'i')::INTEGER AS urgent_suffix
FROM orders
""")
def split_codes(spark, d):
    o = Tables(spark, d).orders
    num = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    return o.select("o_orderkey", num.alias("prio_num"),
                    F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("prio_name"),
                    (num >= F.lit("3")).cast("int").alias("low_half"),
                    imatch("o_orderpriority", "urgent$").cast("int").alias("urgent_suffix"))


@query("regex_flags", ids="F7 F8 F9 STR3 F11", sql="""
SELECT c_custkey,
       regexp_matches(c_name, '#0+1', 'i')::INTEGER AS has_01,
       (NOT regexp_matches(c_name, '5$', 'i'))::INTEGER AS not_ends_5,
       (regexp_matches(c_name, '^Customer#[0-9]+$') AND regexp_matches(c_name, '[0-9]')
        AND regexp_matches(c_name, 'C'))::INTEGER AS code_ok,
       nullif(regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1), '') AS num_code,
       (nullif(regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1), '') IS NULL)::INTEGER AS no_code
FROM customer
""")
def regex_flags(spark, d):
    c = Tables(spark, d).customer
    code = extract_group("c_name", "#0*([1-9][0-9]*)$")
    return c.select("c_custkey", imatch("c_name", "#0+1").cast("int").alias("has_01"),
                    nimatch("c_name", "5$").cast("int").alias("not_ends_5"),
                    cmatch("c_name", "^(?=.*[0-9])(?=.*C)Customer#[0-9]+$").cast("int").alias("code_ok"),
                    code.alias("num_code"), code.isNull().cast("int").alias("no_code"))


@query("similar_zone", ids="F10 P3 STR2 Q5", sql="""
SELECT p_partkey,
       CASE WHEN regexp_matches(p_name, 'ring', 'i') AND regexp_full_match(p_name, '(red|blue|small).*') THEN p_name || ' AP & TG'
            WHEN regexp_matches(p_name, 'ring', 'i') AND NOT regexp_full_match(p_name, '(red|blue|small).*') THEN p_name || ' ROI'
            WHEN regexp_matches(p_brand, '#1[0-9]') THEN p_brand || ' ' || p_type
            ELSE p_name END AS sku
FROM part
""")
def similar_zone(spark, d):
    p = Tables(spark, d).part
    zone = similar_prefix("p_name", ["red", "blue", "small"])
    ring = imatch("p_name", "ring")
    return p.select("p_partkey", case_cascade([
        (ring & zone, F.concat("p_name", F.lit(" AP & TG"))),
        (ring & ~zone, F.concat("p_name", F.lit(" ROI"))),
        (cmatch("p_brand", "#1[0-9]"), F.concat("p_brand", F.lit(" "), "p_type")),
    ], F.col("p_name")).alias("sku"))


@query("text_between", ids="F5 F12 F6", sql="""
SELECT o_orderstatus,
       count(*) FILTER (WHERE CAST(o_custkey AS VARCHAR) BETWEEN '500' AND '550') AS n_between,
       count(*) FILTER (WHERE CAST(o_custkey AS VARCHAR) NOT BETWEEN '500' AND '550') AS n_not_between,
       count(*) FILTER (WHERE CAST(o_custkey AS VARCHAR) >= '390') AS n_ge_390,
       count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS n_not_top
FROM orders GROUP BY o_orderstatus
""")
def text_between_q(spark, d):
    o = Tables(spark, d).orders
    code = F.col("o_custkey").cast("string")
    return o.groupBy("o_orderstatus").agg(
        F.count(F.when(text_between(code, "500", "550"), 1)).alias("n_between"),
        F.count(F.when(text_between(code, "500", "550", negate=True), 1)).alias("n_not_between"),
        F.count(F.when(code >= F.lit("390"), 1)).alias("n_ge_390"),
        F.count(F.when(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1)).alias("n_not_top"))


@query("day_window", ids="F1 F2 F3 F4", sql="""
SELECT event_type,
       count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10') AS n_half_open,
       count(*) FILTER (WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10') AS n_day_window,
       count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10') AS n_closed,
       count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') AS n_open_ended
FROM events GROUP BY event_type
""")
def day_window_q(spark, d):
    ev = Tables(spark, d).events
    closed = (F.col("ts") >= _ts("2024-01-05")) & (F.col("ts") <= _ts("2024-01-10"))
    return ev.groupBy("event_type").agg(
        F.count(F.when(half_open("ts", "2024-01-05", "2024-01-10"), 1)).alias("n_half_open"),
        F.count(F.when(day_window("ts", "2024-01-05", "2024-01-10"), 1)).alias("n_day_window"),
        F.count(F.when(closed, 1)).alias("n_closed"),
        F.count(F.when(F.col("ts") >= _ts("2024-01-25"), 1)).alias("n_open_ended"))


@query("decode_label", ids="P2 P6 P7", sql="""
SELECT o_orderkey AS lead_id,
       CASE WHEN o_orderstatus = 'F' THEN 'Fulfilled' WHEN o_orderstatus = 'O' THEN 'Open' END AS label_null,
       CASE WHEN o_orderstatus = 'F' THEN 'Fulfilled' WHEN o_orderstatus = 'O' THEN 'Open'
            WHEN o_orderstatus = 'P' THEN 'Partial' ELSE 'NH' END AS label_nh,
       CASE WHEN o_orderpriority = '1-URGENT' THEN '1' WHEN o_orderpriority = '5-LOW' THEN '0' END AS consent,
       'orders' AS source
FROM orders
""")
def decode_label_q(spark, d):
    o = Tables(spark, d).orders
    two = {k: v for k, v in STATUS_LABELS.items() if k != "P"}
    return o.select(F.col("o_orderkey").alias("lead_id"),
                    decode_label("o_orderstatus", two).alias("label_null"),
                    decode_label("o_orderstatus", STATUS_LABELS, "NH").alias("label_nh"),
                    decode_label("o_orderpriority", {"1-URGENT": "1", "5-LOW": "0"}).alias("consent"),
                    F.lit("orders").alias("source"))


@query("case_cascade", ids="P3", sql="""
SELECT event_id,
       CASE WHEN value >= 90 AND event_type = 'purchase' THEN 'hot'
            WHEN event_type IN ('click', 'view') THEN 'engaged'
            WHEN value < 5 THEN 'cold' ELSE 'other' END AS temperature
FROM events
""")
def case_cascade_q(spark, d):
    ev = Tables(spark, d).events
    return ev.select("event_id", case_cascade([
        ((F.col("value") >= 90) & (F.col("event_type") == "purchase"), "hot"),
        (F.col("event_type").isin("click", "view"), "engaged"),
        (F.col("value") < 5, "cold")], "other").alias("temperature"))


@query("sparse_flag", ids="P4", sql="""
SELECT o_orderkey,
       CASE WHEN regexp_matches(o_orderpriority, 'urgent', 'i') AND o_orderstatus = 'F' THEN 1 END AS urgent_done_flag,
       CASE WHEN o_totalprice > 300000 THEN 1 END AS big_flag
FROM orders
""")
def sparse_flag(spark, d):
    o = Tables(spark, d).orders
    return o.select("o_orderkey",
                    flag_when(imatch("o_orderpriority", "urgent") & (F.col("o_orderstatus") == "F"))
                    .alias("urgent_done_flag"),
                    flag_when(F.col("o_totalprice") > 300000).alias("big_flag"))


@query("coalesce_chain", ids="P5 J8 F11", sql="""
SELECT c.c_custkey,
       coalesce((SELECT e.value FROM events e WHERE e.user_id = c.c_custkey AND e.event_type = 'purchase'
                 ORDER BY e.ts DESC, e.event_id DESC LIMIT 1),
                (SELECT o.o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey
                 ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 1),
                c.c_acctbal) AS best_value
FROM customer c
""")
def coalesce_chain(spark, d):
    t = Tables(spark, d)
    c = t.customer.select("c_custkey", "c_acctbal")
    c = lookup_latest(c, t.events.where(F.col("event_type") == "purchase"), [("c_custkey", "user_id")],
                      ["ts", "event_id"], ["value"], prefix="ev_")
    c = lookup_latest(c, t.orders, [("c_custkey", "o_custkey")], ["o_orderdate", "o_orderkey"],
                      ["o_totalprice"], prefix="last_")
    return c.select("c_custkey", F.coalesce("ev_value", "last_o_totalprice", "c_acctbal").alias("best_value"))


@query("optional_list_given", ids="SRC6 SRC7", sql="""
SELECT event_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND event_type IN ('click', 'view')
""")
def optional_list_given(spark, d):
    ev = Tables(spark, d).events.where(half_open("ts", "2024-01-05", "2024-01-25"))
    return maybe_in(ev, "event_type", ["click", "view"]).select("event_id", "event_type")


@query("optional_list_absent", ids="SRC6 SRC7", sql="""
SELECT event_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'
""")
def optional_list_absent(spark, d):
    ev = Tables(spark, d).events.where(half_open("ts", "2024-01-05", "2024-01-25"))
    return maybe_in(ev, "event_type", None).select("event_id", "event_type")


@query("rows_after_position", ids="F15 W2 F14", sql="""
SELECT o_orderkey, o_custkey FROM (
  SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders) x
WHERE pos > 100
""")
def rows_after_position(spark, d):
    # Rows n+1..end of a total order: the n-th key comes from a distributed
    # top-n (each task keeps n rows), then a plain filter; no global window. Right
    # because o_orderkey is unique; for other orders take ``row_positions``.
    o = Tables(spark, d).orders
    nth = o.select("o_orderkey").orderBy("o_orderkey").limit(100).agg(F.max("o_orderkey")).scalar()
    return o.where(F.col("o_orderkey") > nth).select("o_orderkey", "o_custkey")


@query("row_positions", ids="W2 F15", sql="""
SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders
""")
def row_positions_q(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey")
    return row_positions(o, ["o_orderkey"])


@query("recent_relative", ids="F13 DT7", sql="""
SELECT event_type, count(*) AS n_recent FROM events
WHERE ts >= CAST(DATE '2024-01-30' - INTERVAL 1 DAY AS TIMESTAMP)
GROUP BY event_type
""")
def recent_relative(spark, d):
    ev = Tables(spark, d).events
    since = F.date_sub(F.lit(RUN_DATE).cast("date"), 1).cast("timestamp_ntz")
    return ev.where(F.col("ts") >= since).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_recent"))


@query("recent_orders", ids="DT7 F4", sql="""
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= CAST(DATE '2001-06-01' - INTERVAL 3 MONTH AS TIMESTAMP)
""")
def recent_orders(spark, d):
    o = Tables(spark, d).orders
    since = F.add_months(F.lit(ORDERS_RUN_DATE).cast("date"), -3).cast("timestamp_ntz")
    return o.where(F.col("o_orderdate") >= since).select("o_orderkey", "o_orderdate")


@query("text_clean", ids="STR4 STR5 STR6 STR7 STR8 STR9", sql="""
SELECT CAST(doc_id AS VARCHAR) AS doc_key, upper(lang) AS lang_uc,
       length(regexp_replace(text, '[\\n\\r]+', ' ', 'g')) AS clean_len,
       md5(regexp_replace(text, '[\\n\\r]+', ' ', 'g')) AS clean_md5,
       trim(source, '{}') AS source_trim, substr(source, 1, 3) AS source_code,
       concat_ws(' ', lang, source) AS lang_source
FROM documents
""")
def text_clean(spark, d):
    doc = Tables(spark, d).documents
    clean = collapse_newlines("text")
    return doc.select(F.col("doc_id").cast("string").alias("doc_key"), F.upper("lang").alias("lang_uc"),
                      F.length(clean).cast("bigint").alias("clean_len"), F.md5(clean).alias("clean_md5"),
                      F.expr("trim(BOTH '{}' FROM source)").alias("source_trim"),
                      F.substring("source", 1, 3).alias("source_code"),
                      F.concat_ws(" ", "lang", "source").alias("lang_source"))


@query("date_parts", ids="DT1 DT3 DT4", sql="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day, strftime(o_orderdate, '%Y-%m') AS order_month,
       CAST(extract(dow FROM o_orderdate) AS INTEGER) AS dow,
       CASE WHEN extract(dow FROM o_orderdate) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
FROM orders
""")
def date_parts(spark, d):
    o = Tables(spark, d).orders
    dow = dow_sunday0("o_orderdate")
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("order_day"),
                    F.date_format("o_orderdate", "yyyy-MM").alias("order_month"), dow.alias("dow"),
                    F.when(dow.isin(0, 6), 1).otherwise(0).alias("is_weekend"))


@query("month_diff", ids="U2 DT9", sql="""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
       (year(l.l_shipdate) - year(o.o_orderdate)) * 12 + month(l.l_shipdate) - month(o.o_orderdate) AS months,
       CASE WHEN (year(l.l_shipdate) - year(o.o_orderdate)) * 12 + month(l.l_shipdate) - month(o.o_orderdate) < 2
            THEN 'M' || CAST((year(l.l_shipdate) - year(o.o_orderdate)) * 12 + month(l.l_shipdate) - month(o.o_orderdate) AS VARCHAR)
            ELSE 'M1+' END AS m_bucket,
       CASE WHEN (year(l.l_shipdate) - year(o.o_orderdate)) * 12 + month(l.l_shipdate) - month(o.o_orderdate) <= 6
            THEN 'M-' || CAST((year(l.l_shipdate) - year(o.o_orderdate)) * 12 + month(l.l_shipdate) - month(o.o_orderdate) AS VARCHAR)
            ELSE 'M-6 >' END AS offset_label
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
""")
def month_diff_q(spark, d):
    t = Tables(spark, d)
    j = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    n = month_diff("o_orderdate", "l_shipdate")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", n.alias("months"),
                    m_bucket(n).alias("m_bucket"), month_offset_label(n).alias("offset_label"))


@query("ts_interval", ids="DT6 DT7", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate - INTERVAL 48 HOUR AS ship_minus_48h,
       l_shipdate + INTERVAL 2 MINUTE AS ship_plus_2m,
       CAST(l_shipdate AS DATE) + INTERVAL 3 MONTH AS ship_plus_3m
FROM lineitem
""")
def ts_interval(spark, d):
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     (F.col("l_shipdate") - F.expr("INTERVAL 48 HOURS")).alias("ship_minus_48h"),
                     (F.col("l_shipdate") + F.expr("INTERVAL 2 MINUTES")).alias("ship_plus_2m"),
                     F.add_months(F.to_date("l_shipdate"), 3).cast("timestamp_ntz").alias("ship_plus_3m"))


@query("calendar_vars", ids="DT8 U6 R26", sql="""
SELECT DISTINCT CAST(o_orderdate AS DATE) AS d,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS prev_month_start,
       CAST(date_trunc('month', o_orderdate) - INTERVAL 1 DAY AS DATE) AS prev_month_end,
       CAST(day(last_day(o_orderdate)) AS INTEGER) AS days_in_month,
       CAST(day(o_orderdate) - 1 AS INTEGER) AS days_past,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), last_day(o_orderdate)) + 1 AS INTEGER) AS days_left
FROM orders
""")
def calendar_vars(spark, d):
    o = Tables(spark, d).orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    c = F.col("d")
    return o.select("d", month_start(c).alias("month_start"), prev_month_start(c).alias("prev_month_start"),
                    prev_month_end(c).alias("prev_month_end"), days_in_month(c).alias("days_in_month"),
                    days_past(c).alias("days_past"), days_left(c).alias("days_left"))


@query("age_numeric", ids="U3 U4 MA3", sql="""
SELECT c_custkey,
       CAST(date_part('year', age(DATE '2024-01-30', CAST(DATE '1960-01-01' + CAST((c_custkey * 37) % 18000 AS INTEGER) AS DATE))) AS INTEGER) AS age,
       CAST(TRY_CAST(split_part(c_name, '#', 2) AS DECIMAL(18,2)) AS DOUBLE) AS name_number,
       CAST(TRY_CAST(c_mktsegment AS DECIMAL(18,2)) AS DOUBLE) AS bad_number,
       c_custkey % 7 AS bucket
FROM customer
""")
def age_numeric(spark, d):
    c = Tables(spark, d).customer
    dob = F.date_add(F.lit("1960-01-01").cast("date"), ((F.col("c_custkey") * 37) % 18000).cast("int"))
    return c.select("c_custkey", age_years(dob, RUN_DATE).alias("age"),
                    to_numeric(F.split_part("c_name", F.lit("#"), F.lit(2))).cast("double").alias("name_number"),
                    to_numeric("c_mktsegment").cast("double").alias("bad_number"), (F.col("c_custkey") % 7).alias("bucket"))


def _folder(spark, name):
    """A folder of its own beside the session's checkpoints, which the cluster shares."""
    import uuid
    from funnelkit.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("summary_as_csv", ids="SNK3 SRC2", sql="""
SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type
""")
def summary_as_csv(spark, d):
    """A summary written as CSV and read back with its schema, two of its columns first."""
    ev = Tables(spark, d).events
    out = _folder(spark, "summary")
    write_csv(ev.groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n_events"),
                                           F.count_distinct("user_id").alias("n_users")), out)
    return read_csv(spark, out, "event_type string, first_ts timestamp_ntz, n_events bigint, n_users bigint",
                    ["event_type", "n_events", "n_users"])


@query("blocks_by_team", ids="SNK4", sql="""
SELECT c_mktsegment AS team, count(*) AS n_customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS acctbal
FROM customer GROUP BY c_mktsegment
""")
def blocks_by_team(spark, d):
    """One output folder a team, read back by team."""
    c = Tables(spark, d).customer.select(F.col("c_mktsegment").alias("team"), "c_custkey", "c_acctbal")
    out = _folder(spark, "teams")
    write_by_team(c, out, "team", fmt="parquet")
    back = spark.read.schema("c_custkey bigint, c_acctbal double, team string").parquet(out)
    return back.groupBy("team").agg(F.count("c_custkey").alias("n_customers"),
                                    F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("acctbal"))


@query("subset_complement", ids="F14 P6", sql="""
SELECT label, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS acctbal
FROM (
  SELECT 'building' AS label, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL
  SELECT 'machinery', c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION ALL
  SELECT 'other', c_acctbal FROM customer
  WHERE NOT coalesce(c_mktsegment = 'BUILDING', false) AND NOT coalesce(c_mktsegment = 'MACHINERY', false)
) s
GROUP BY label
""")
def subset_complement(spark, d):
    # subsets by value and the complement of their union; a NULL value belongs
    # to the complement (R's which() drops NA from both subsets)
    c = Tables(spark, d).customer
    a = F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False))
    b = F.coalesce(F.col("c_mktsegment") == "MACHINERY", F.lit(False))
    label = F.when(a, "building").when(b, "machinery").otherwise("other")
    return c.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("acctbal"))


@query("renamed_dataset_counts", ids="SRC3 SRC4 P7 A1 A2", sql="""
SELECT event_type AS last_result, count(*) AS n_rows, count(DISTINCT user_id) AS n_users
FROM events GROUP BY event_type
""")
def renamed_dataset_counts(spark, d):
    # a dataset read by name (one per former sheet) and patched by ordinal
    # renames, as the call-centre scripts do before summarising
    from funnelkit.sources.tables import read_dataset, rename_at
    ds = read_dataset(spark, d, "events.parquet")
    pos = {c: i + 1 for i, c in enumerate(ds.columns)}
    ds = rename_at(ds, {pos["event_type"]: "last_result", pos["user_id"]: "User_ID"})
    return ds.groupBy("last_result").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.count_distinct("User_ID").alias("n_users"))
