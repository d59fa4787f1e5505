"""Lookup operators against brute force, including the FIXTURES edge cases:
equal timestamps (strict vs inclusive), no earlier row, NULL key, NULL time,
ties broken by id, exactly-48-hour boundaries, and buckets small enough that
matches must be carried across buckets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from funnelkit.operators.lookup import (HotKeys, asof_join, first_per, lookback_join, lookup_latest,
                                        nth_state, prefix_agg, range_agg, range_join, window_count)
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def ts(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def asof_data(spark):
    rnd = random.Random(7)
    left = [(i, rnd.choice([1, 2, 3, None]), ts(rnd.choice([None] + list(range(0, 6000, 7)))))
            for i in range(300)]
    right = [(rnd.choice([1, 2, 3, 4]), ts(rnd.randrange(0, 6000, 5)), j, float(j)) for j in range(400)]
    # exact-equality and tie cases
    left += [(1000, 1, ts(100)), (1001, 2, ts(0))]
    right += [(1, ts(100), 5000, 1.0), (1, ts(100), 5001, 2.0)]
    L = spark.createDataFrame(left, "id long, key long, t timestamp_ntz")
    R = spark.createDataFrame(right, "key long, rt timestamp_ntz, rid long, v double")
    return left, right, L, R


def brute_asof(left, right, strict, forward, lo=None, hi_incl=None):
    out = []
    for i, k, t in left:
        best = None
        for rk, rt, rid, v in right:
            if k is None or t is None or rk != k:
                continue
            ok = (rt < t if strict else rt <= t) if not forward else (rt > t if strict else rt >= t)
            if not ok:
                continue
            cand = (rt, rid) if not forward else (-rt.timestamp(), -rid)
            if best is None or cand > best[0]:
                best = (cand, rid)
        out.append((i, best[1] if best else None))
    return sorted(out, key=repr)


# how finely hot keys are cut: a fair share of all rows of a quarter partition (the
# default), of a hundredth (every key is hot, cells of a row or two), or none hot
SHARES = [4, 100, 0]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("share", SHARES)
def test_asof_matches_brute_force(spark, asof_data, strict, forward, share):
    left, right, L, R = asof_data
    kw = {"share": share} if share else {"hot": HotKeys()}
    got = asof_join(L, R, "key", "t", "rt", ["rid"], strict=strict, forward=forward, tiebreak=["rid"], **kw)
    assert rows(got, "id", "rid") == brute_asof(left, right, strict, forward)
    assert got.count() == len(left)


@pytest.mark.parametrize("share", SHARES)
def test_prefix_count_and_sum(spark, asof_data, share):
    left, right, L, R = asof_data
    kw = {"share": share} if share else {"hot": HotKeys()}
    got = prefix_agg(L, R, "key", "t", "rt", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")),
                                               "lo": ("min", F.col("rid"))}, **kw)
    exp = []
    for i, k, t in left:
        m = [(rid, v) for rk, rt, rid, v in right if k is not None and t is not None and rk == k and rt < t]
        exp.append((i, len(m), sum(v for _, v in m) if m else None, min((r for r, _ in m), default=None)))
    assert rows(got, "id", "n", "s", "lo") == sorted(exp, key=repr)


@pytest.mark.parametrize("pick", ["last", "first"])
@pytest.mark.parametrize("upper_inclusive", [False, True])
def test_lookback_window_bounds(spark, asof_data, pick, upper_inclusive):
    left, right, L, R = asof_data
    w = 48 * 60 * 60
    got = lookback_join(L, R, "key", "t", "rt", ["rid"], w, pick=pick, upper_inclusive=upper_inclusive,
                        tiebreak=["rid"], share=100)
    exp = []
    for i, k, t in left:
        m = [(rt, rid) for rk, rt, rid, _ in right if k is not None and t is not None and rk == k
             and rt >= t - dt.timedelta(seconds=w) and (rt <= t if upper_inclusive else rt < t)]
        if not m:
            exp.append((i, None))
        else:
            exp.append((i, (max(m) if pick == "last" else min(m))[1]))
    assert rows(got, "id", "rid") == sorted(exp, key=repr)


def test_lookback_exact_boundary(spark):
    L = spark.createDataFrame([(1, 1, ts(48 * 60)), (2, 1, ts(48 * 60 + 1))], "id long, key long, t timestamp_ntz")
    R = spark.createDataFrame([(1, ts(0), 10, 0.0)], "key long, rt timestamp_ntz, rid long, v double")
    got = lookback_join(L, R, "key", "t", "rt", ["rid"], 48 * 3600, pick="first")
    assert rows(got, "id", "rid") == [(1, 10), (2, None)]   # exactly 48 h old is inside


def test_window_count_and_range_join(spark, asof_data):
    left, right, L, R = asof_data
    got = window_count(L, R, "key", "t", "rt", 0, 3600, name="n", row_id="id", share=100)
    pairs = range_join(L, R, "key", "t", "rt", 0, 3600)
    exp_n, exp_pairs = [], []
    for i, k, t in left:
        m = [rid for rk, rt, rid, _ in right if k is not None and t is not None and rk == k
             and t <= rt < t + dt.timedelta(hours=1)]
        exp_n.append((i, len(m)))
        exp_pairs += [(i, r) for r in m]
    assert rows(got, "id", "n") == sorted(exp_n, key=repr)
    assert rows(pairs, "id", "rid") == sorted(exp_pairs, key=repr)


def test_left_range_join_keeps_unmatched_rows_once(spark, asof_data):
    left, right, L, R = asof_data
    got = range_join(L, R, "key", "t", "rt", 0, 3600, how="left", row_id="id")
    assert got.columns == ["id", "key", "t", "rt", "rid", "v"]
    exp = []
    for i, k, t in left:
        m = [rid for rk, rt, rid, _ in right if k is not None and t is not None and rk == k
             and t <= rt < t + dt.timedelta(hours=1)]
        exp += [(i, r) for r in m] or [(i, None)]
    assert rows(got, "id", "rid") == sorted(exp, key=repr)
    with pytest.raises(ValueError):
        range_join(L, R, "key", "t", "rt", 0, 3600, how="left")
    with pytest.raises(ValueError):
        range_join(L, R, "key", "t", "rt", 0, 3600, how="full")


def test_first_per_and_lookup_latest_null_order(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (1, 3, "c"), (2, 7, "d")],
                               "k long, t long, v string")
    assert rows(first_per(df, "k", ["t"], ["v"]), "k", "v") == [(1, "c"), (2, "d")]
    # descending: PostgreSQL puts NULL first, so the NULL-time row is "latest"
    assert rows(first_per(df, "k", ["t"], ["v"], last=True), "k", "v") == [(1, "a"), (2, "d")]
    left = spark.createDataFrame([(1,), (3,)], "k long")
    got = lookup_latest(left, df.where(F.col("t").isNotNull()), "k", ["t"], ["v"])
    assert rows(got) == [(1, "b"), (3, None)]


def test_nth_state_ties_and_single_row(spark):
    data = [(1, ts(1), "A"), (1, ts(2), "B"), (1, ts(2), "B"), (1, ts(2), "A"),
            (2, ts(5), "X"),
            (3, ts(1), "Q"), (3, ts(1), "Q"), (3, ts(0), "R")]
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, s string")
    got = nth_state(df, "k", "t", "s")
    # key 1: rank 1 = (2,B), rank 2 = (2,A); key 2 has no rank 2; key 3: rank 2 = (0,R)
    assert rows(got, "k", "prior_state") == [(1, "A"), (3, "R")]
    # NULL state is the largest of its time, and a NULL key is a key
    nulls = spark.createDataFrame([(1, ts(2), None), (1, ts(2), "Z"), (None, ts(1), "A"), (None, ts(2), "B")],
                                  "k long, t timestamp_ntz, s string")
    assert rows(nth_state(nulls, "k", "t", "s"), "k", "prior_state") == [(1, "Z"), (None, "A")]


def test_nth_state_limits_before_the_shuffle(spark):
    """One read, no join; the rank's limit stands on both sides of the shuffle by key."""
    df = spark.range(6000).selectExpr("0 AS k", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS t",
                                      "CAST(id AS STRING) AS s")
    got = nth_state(df, "k", "t", "s", n=3)
    assert rows(got, "k", "prior_state") == [(0, "5997")]
    plan = nth_state(df, "k", "t", "s", n=3)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan and "Join" not in plan and plan.count("Range (") == 1


def _tied(spark, n=6000):
    """A third of all rows are of one key and one time; others stand around it."""
    return spark.range(n).selectExpr(
        "id", "CASE WHEN id % 3 = 0 OR id % 9 = 1 THEN 0 ELSE id % 50 + 1 END AS k",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CASE WHEN id % 3 = 0 THEN 5000 ELSE id % 10000 END) AS t")


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("forward", [False, True])
def test_a_time_that_a_third_of_all_rows_share(spark, strict, forward):
    from funnelkit.operators import lookup
    df = _tied(spark)
    left = df.where("id % 2 = 0").select("id", "k", "t")
    right = df.where("id % 2 = 1").select("k", F.col("t").alias("rt"), F.col("id").alias("rid"))
    seen, window = [], lookup.Window.partitionBy

    class Spy:
        unboundedPreceding, currentRow = lookup.Window.unboundedPreceding, lookup.Window.currentRow

        @staticmethod
        def partitionBy(*cols):
            seen.append(cols)
            return window(*cols)
    orig, lookup.Window = lookup.Window, Spy
    try:
        got = prefix_agg(left, right, "k", "t", "rt", {"n": ("count", F.lit(1)), "s": ("sum", F.col("rid")), "top": ("max", F.col("rid"))},
                         inclusive=not strict, forward=forward, share=8)
    finally:
        lookup.Window = orig
    assert "__j" in seen[-1]                    # the last window is the cells'
    sign = ">" if forward else "<"
    brute = left.join(right, "k").where(f"rt {sign}{'' if strict else '='} t").groupBy("id").agg(
        F.count("*").alias("n"), F.sum("rid").alias("s"), F.max("rid").alias("top"))
    want = left.join(brute, "id", "left").fillna(0, ["n"])
    assert rows(got, "id", "n", "s", "top") == rows(want, "id", "n", "s", "top")


def test_cells_of_a_shared_time_are_fair(spark):
    from funnelkit.operators.lookup import _cell, _shared, hot_keys_for, time_micros
    df = _tied(spark, 40_000)
    hot = hot_keys_for(df, "k", "t")
    assert [r[0] for r in hot.rows] == [0]
    t, cuts = time_micros("t", df), F.col("__cuts")
    below = _cell(t, cuts, len(hot.rows[0][-4]))
    many = _shared(t, cuts, F.col("__shares"), below)
    cells = df.join(hot.frame(spark, ["k"], 1), "k").select(below.alias("c"), many.alias("m"), F.when(many > 0, F.pmod(F.xxhash64("id"), many)).alias("j"))
    largest = cells.groupBy("c", "m", "j").count().agg(F.max("count")).first()[0]
    target = df.count() / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert largest <= 2 * target and cells.where("m > 1").count() > 13_000


@pytest.mark.parametrize("share", [1, 8, 200])
def test_range_join_rows_on_hot_buckets(spark, share):
    """Row pairs within ten seconds, with a third of all rows in one bucket and many at one time."""
    df = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 90 + 1 END AS k",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CASE WHEN id % 3 = 0 THEN 700 + (id % 100) / 10.0 "
        "WHEN id % 30 = 1 THEN 100 ELSE id / 10.0 END) AS t")
    left = df.where("id % 4 = 0").select("id", "k", "t")
    right = df.where("id % 4 = 1").select("k", F.col("t").alias("rt"), F.col("id").alias("rid"))
    for lo, hi in ((0, 10), (-7, 3)):
        got = range_join(left, right, "k", "t", "rt", lo, hi, share=share)
        span = lambda s: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(s))
        brute = left.join(right, "k").where((F.col("rt") >= F.col("t") + span(lo)) & (F.col("rt") < F.col("t") + span(hi)))
        assert rows(got, "id", "rid") == rows(brute, "id", "rid")


def test_range_join_spreads_a_hot_bucket(spark):
    """No cell of the equi join holds more than twice a fair share of the right rows."""
    from funnelkit.operators import lookup
    right = spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS rid",
                                           "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id % 1000) / 1000.0) AS rt")
    left = right.where("rid % 500 = 0").select(F.col("rid").alias("id"), "k", F.col("rt").alias("t"))
    seen = []
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    orig = Classic.join

    def spy(self, other, on=None, how=None):
        if "__c" in self.columns and "__c" in other.columns:
            seen.append(other)
        return orig(self, other, on, how)
    Classic.join = spy
    try:
        lookup.range_join(left, right, "k", "t", "rt", 0, 10)
    finally:
        Classic.join = orig
    sizes = seen[0].groupBy("__k0", "__bk", "__c").count().agg(F.max("count").alias("m")).first().m
    assert sizes <= 2 * 40_000 / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_lookback_unbounded_equals_asof(spark, asof_data):
    left, right, L, R = asof_data
    huge = 10 * 365 * 86400
    a = asof_join(L, R, "key", "t", "rt", ["rid"], tiebreak=["rid"])
    b = lookback_join(L, R, "key", "t", "rt", ["rid"], huge, pick="last", tiebreak=["rid"])
    assert rows(a, "id", "rid") == rows(b, "id", "rid")


def test_asof_order_is_zone_free_for_wall_clock_times(spark):
    # 02:30 on 2024-03-10 does not exist in New York; through the session zone
    # it would map after 03:00. Wall-clock columns must keep their own order.
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = spark.createDataFrame([(1, "2024-03-10 02:30:00", 1), (1, "2024-03-10 02:50:00", 2)],
                                  "k long, s string, rid long").selectExpr("k", "CAST(s AS TIMESTAMP_NTZ) AS rt", "rid")
        l = spark.createDataFrame([(1, "2024-03-10 03:00:00")], "k long, s string") \
            .selectExpr("k", "CAST(s AS TIMESTAMP_NTZ) AS t")
        got = asof_join(l, r, "k", "t", "rt", ["rid"])
        assert [x.rid for x in got.collect()] == [2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_nth_state_rank_three_matches_dense_rank(spark):
    from pyspark.sql import Window
    rnd = random.Random(3)
    data = [(rnd.randrange(20), ts(rnd.randrange(30)), rnd.choice("ABC")) for _ in range(600)]
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, s string")
    w = Window.partitionBy("k").orderBy(F.col("t").desc_nulls_first(), F.col("s").desc())
    exp = df.withColumn("r", F.dense_rank().over(w)).where("r = 3").select("k", "s").distinct()
    assert rows(nth_state(df, "k", "t", "s", n=3), "k", "prior_state") == rows(exp)


@pytest.mark.parametrize("forward", [False, True])
def test_asof_adaptive_hot_key_buckets(spark, asof_data, forward):
    left, right, L, R = asof_data
    got = prefix_agg(L, R, "key", "t", "rt",
                     {"pick": ("max", F.struct(((-1 if forward else 1) * F.col("rid")).alias("o"), "rid")),
                      "n": ("count", F.lit(1))},
                     forward=forward, inclusive=True, share=20)
    exp = []
    for i, k, t in left:
        m = [rid for rk, rt, rid, _ in right if k is not None and t is not None and rk == k
             and ((rt >= t) if forward else (rt <= t))]
        best = (min(m) if forward else max(m)) if m else None
        exp.append((i, best, len(m)))
    assert rows(got.select("id", F.col("pick.rid"), "n")) == sorted(exp, key=repr)


def _cells(spark, df, share, kcols=("k",)):
    """Rows of the largest cell of the hot keys of ``df`` (k, t), and the target size."""
    from funnelkit.operators.lookup import _cell, hot_keys_for, time_micros
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys_for(df, "k", "t", share=share)
    table = hot.frame(spark, ["k"], 1)
    cell = _cell(time_micros("t", df), F.col("__cuts"), max(len(r[-3]) for r in hot.rows))
    sizes = df.join(table, "k").groupBy("k", cell.alias("c")).count()
    return hot, sizes.agg(F.max("count")).first()[0], df.count() / (share * parts)


def test_hot_keys_are_cut_into_fair_cells(spark):
    df = spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k",
                                        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7) AS t")
    hot, largest, target = _cells(spark, df, 4)
    assert [r[0] for r in hot.rows] == [0] and largest <= 2 * target


def test_an_outlier_date_does_not_widen_the_cells(spark):
    df = spark.range(40_000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS k",
        "CASE WHEN id = 0 THEN TIMESTAMP_NTZ'9999-12-31 00:00:00' WHEN id = 2 THEN TIMESTAMP_NTZ'0001-01-01 00:00:00'"
        " ELSE TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id / 1000.0) END AS t")
    _, largest, target = _cells(spark, df, 4)
    assert largest <= 2 * target


def test_rows_that_meet_nothing_and_open_bounds_are_spread(spark):
    """NULL keys, NULL times and open bounds of a hot key are dealt over many cells."""
    import re
    from funnelkit.operators import lookup
    rows_ = spark.range(8000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN NULL WHEN id % 4 = 1 THEN 1 ELSE id END AS k",
                                         "CASE WHEN id % 8 < 6 THEN NULL ELSE TIMESTAMP_NTZ'2024-01-01 00:00:00' END AS t")
    right = spark.range(4000).selectExpr("1 AS k", "id AS rid", "TIMESTAMP_NTZ'2023-01-01 00:00:00' + "
                                         "make_dt_interval(0, 0, 0, id) AS rt")
    seen = []
    partition_by = lookup.Window.partitionBy

    class Spy:
        unboundedPreceding, currentRow = lookup.Window.unboundedPreceding, lookup.Window.currentRow

        @staticmethod
        def partitionBy(*cols):
            seen.append(cols)
            return partition_by(*cols)
    orig, lookup.Window = lookup.Window, Spy
    try:
        got = lookup.range_agg(rows_, right, "k", "t", "rt", {"n": ("count", F.lit(1)), "top": ("max", F.col("rid"))}, share=8)
    finally:
        lookup.Window = orig
    assert any("__b" in c for c in seen[-1])
    exp = [(r.id, 4000 if r.k == 1 else 0, 3999 if r.k == 1 else None) for r in rows_.collect()]
    assert sorted(map(tuple, got.select("id", "n", "top").collect())) == sorted(exp)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert re.search("__b", plan)


def test_open_bound_takes_every_right_row(spark, asof_data):
    left, right, L, R = asof_data
    for kw in ({"share": 100}, {"hot": HotKeys()}):
        got = range_agg(L, R, "key", "t", "rt", {"n": ("count", F.lit(1))}, **kw)
        exp = [(i, sum(1 for rk, rt, _, _ in right if k is not None and rk == k and (t is None or rt < t)))
               for i, k, t in left]
        assert rows(got, "id", "n") == sorted(exp, key=repr)


def test_planned_scans_of_one_lookup(spark, tmp_path):
    """Without hot keys a lookup reads each side once; with them the right side twice."""
    import re
    spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS k", "id AS rid", "TIMESTAMP_NTZ'2023-01-01 00:00:00' + "
                                 "make_dt_interval(0, 0, 0, id) AS rt").write.parquet(str(tmp_path / "r"))
    r = spark.read.parquet(str(tmp_path / "r"))
    left = r.select("k", F.col("rid").alias("id"), F.col("rt").alias("t"))
    for kw, n in (({"hot": HotKeys()}, 2), ({}, 3)):
        plan = asof_join(left, r, "k", "t", "rt", ["rid"], **kw)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("FileScan", plan)) <= n


def test_asof_on_instant_timestamps(spark, asof_data):
    # instant (time-zone aware) timestamps take the epoch-micros path
    left, right, L, R = asof_data
    Li = L.withColumn("t", F.col("t").cast("timestamp"))
    Ri = R.withColumn("rt", F.col("rt").cast("timestamp"))
    got = asof_join(Li, Ri, "key", "t", "rt", ["rid"], tiebreak=["rid"], share=20)
    assert rows(got, "id", "rid") == brute_asof(left, right, True, False)


@pytest.mark.parametrize("forward", [False, True])
def test_asof_with_shared_hot_list(spark, asof_data, forward):
    from funnelkit.operators.lookup import hot_keys_for
    left, right, L, R = asof_data
    hot = hot_keys_for(R, "key", "rt", share=20)
    assert len(hot.rows) >= 1
    got = asof_join(L, R, "key", "t", "rt", ["rid"], tiebreak=["rid"], forward=forward, hot=hot)
    assert rows(got, "id", "rid") == brute_asof(left, right, True, forward)
    # a list of the right rows themselves, and one whose times end long before them
    own = hot_keys_for(R, "key", "rt", share=20, holds_right=True)
    early = hot_keys_for(R.where(F.col("rt") < ts(700)), "key", "rt", share=20)
    for shared in (own, early):
        got = asof_join(L, R, "key", "t", "rt", ["rid"], tiebreak=["rid"], forward=forward, hot=shared)
        assert rows(got, "id", "rid") == brute_asof(left, right, True, forward)
