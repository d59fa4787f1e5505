import datetime as dt

import pytest
from pyspark.sql import functions as F

from funnelkit.operators.agg import (collect_struct, disposition_summary, first_by, join_distinct,
                                     join_strings, milestone, milestone_and_not, progress,
                                     rollup_totals, with_total_row, answers_map, bind_cols, fill_zero)
from funnelkit.operators.member import anti, attach_flag, flag_earlier_exists, semi, suppress
from funnelkit.plans.reports import rollup_distinct_flags
from tests.conftest import rows


def test_suppress_is_null_aware(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "u long")
    lst = spark.createDataFrame([(2,), (2,)], "u long")
    assert rows(suppress(df, lst, "u")) == [(1,)]
    with_null = spark.createDataFrame([(2,), (None,)], "u long")
    assert suppress(df, with_null, "u").count() == 0
    assert rows(suppress(df, with_null, "u", null_aware=False)) == [(1,), (None,)]
    # nothing is in an empty list, not even an unknown key
    assert rows(suppress(df, lst.limit(0), "u")) == [(1,), (2,), (None,)]
    assert suppress(df, spark.createDataFrame([(None,)], "u long"), "u").count() == 0


def test_joined_strings_keep_a_lone_empty_string(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a"), (3, "")], "k long, v string")
    got = df.groupBy("k").agg(join_strings("v", ",").alias("a"), join_distinct("v", ",").alias("b"),
                              join_strings("v", ",", order="v").alias("c"))
    assert rows(got) == [(1, "", "", ""), (2, None, None, None), (3, ",a", ",a", ",a")]


def test_attach_flag_keeps_row_count(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "u long")
    members = spark.createDataFrame([(1,), (1,), (3,), (None,)], "u long")
    got = attach_flag(df, members, "u", "f")
    assert rows(got) == [(1, "1"), (2, None), (3, "1")]


def test_semi_anti(spark):
    df = spark.createDataFrame([(1,), (2,)], "u long")
    other = spark.createDataFrame([(1, "x"), (1, "y")], "user long, t string")
    assert rows(semi(df, other, [("u", "user")])) == [(1,)]
    assert rows(anti(df, other, [("u", "user")])) == [(2,)]


def test_flag_earlier_exists_is_strict(spark):
    data = [(1, "PL", ts(1), "10"), (1, "PL", ts(1), "20"), (1, "PL", ts(2), "30"), (2, "PL", ts(1), "10")]
    df = spark.createDataFrame(data, "u long, p string, t timestamp_ntz, code string")
    got = flag_earlier_exists(df, ["u", "p"], "t", F.col("code").endswith("10"))
    assert rows(got, "u", "code", "dup_flag") == [(1, "10", 0), (1, "20", 0), (1, "30", 1), (2, "10", 0)]


def ts(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def test_milestones_first_by_and_progress(spark):
    log = [(1, ts(1), "PL-021", None), (1, ts(2), "PL-03", "System"), (1, ts(3), "PL-88", "a"),
           (2, ts(1), "CC-03", "b"), (2, ts(2), "CC-05", "c"), (2, ts(3), None, "d")]
    df = spark.createDataFrame(log, "u long, t timestamp_ntz, code string, owner string")
    c = F.col("code")
    got = df.groupBy("u").agg(
        milestone(c.endswith("021")).alias("p021"),
        milestone_and_not(c.endswith("88"), c.endswith("05")).alias("p88"),
        first_by("owner", ["t"], where=c.endswith("03")).alias("oic03"),
        first_by("owner", ["t"]).alias("first_owner"),
        progress([(c.endswith("05"), "05"), (c.endswith("88"), "88"), (c.endswith("03"), "03")], "00").alias("stage"))
    assert rows(got) == [(1, 1, 1, "System", None, "88"), (2, 0, 0, "b", "b", "05")]


def test_string_aggs_and_map(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "a", 3), (2, None, 1)], "u long, x string, o long")
    got = df.groupBy("u").agg(join_strings("x", " , ", order="o").alias("s"),
                              join_distinct("x", ",").alias("d"),
                              answers_map(F.col("o"), F.col("x")).alias("m"))
    r = {x.u: x for x in got.collect()}
    assert r[1].s == "a , b , a" and r[1].d == "a,b"
    assert r[1].m == {"1": "a", "2": "b", "3": "a"} and r[2].m == {"1": None}
    assert r[2].s is None and r[2].d is None


def test_collect_struct_keeps_alignment(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 1, "x"), (1, 3, "z")], "g long, o long, v string")
    got = df.groupBy("g").agg(collect_struct({"o": "o", "v": "v"}, ["o"]).alias("a")).first().a
    assert [(e.o, e.v) for e in got] == [(1, "x"), (2, None), (3, "z")]


def test_rollup_labels_grouping_vs_null(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", 3)], "k1 string, k2 string, v long")
    g = rollup_totals(df, {"k1": "k1", "k2": "k2"}, [F.sum("v").alias("v")])
    n = rollup_totals(df, {"k1": "k1", "k2": "k2"}, [F.sum("v").alias("v")], mark="null")
    assert ("a", None, 2) in rows(g) and ("Total", "Total", 6) in rows(g)
    assert ("a", "Total", 2) in rows(n)            # the real NULL key is conflated with subtotal
    assert len(rows(g)) == 6


def test_rollup_distinct_flags_equals_count_distinct(spark):
    data = [("s1", "p1", 1, 1, 0), ("s1", "p2", 1, 0, 1), ("s1", "p1", 2, 0, 0), ("s2", "p1", 3, 1, 1),
            ("s2", "p2", 3, 1, 0), ("s2", None, 4, 1, 1)]
    df = spark.createDataFrame(data, "seg string, prod string, u long, f1 int, f2 int")
    got = rollup_distinct_flags(df, ["seg", "prod"], "u", ["f1", "f2"], total_name="n")
    exp = df.rollup("seg", "prod").agg(
        F.count_distinct(F.when(F.col("f1") == 1, F.col("u"))).alias("f1"),
        F.count_distinct(F.when(F.col("f2") == 1, F.col("u"))).alias("f2"),
        F.count_distinct("u").alias("n"), F.grouping("seg").alias("gs"), F.grouping("prod").alias("gp"))
    exp = exp.select(F.when(F.col("gs") == 1, "Total").otherwise(F.col("seg")).alias("seg"),
                     F.when(F.col("gp") == 1, "Total").otherwise(F.col("prod")).alias("prod"), "f1", "f2", "n")
    assert rows(got, "seg", "prod", "f1", "f2", "n") == rows(exp)
    # entities of one row each: the same, from sums of cells alone
    alone = df.dropDuplicates(["u"])
    one = rollup_distinct_flags(alone, ["seg", "prod"], "u", ["f1", "f2"], total_name="n", one_row=True)
    assert rows(one) == rows(rollup_distinct_flags(alone, ["seg", "prod"], "u", ["f1", "f2"], total_name="n"))


def test_rollup_distinct_flags_on_many_rows(spark):
    df = spark.range(4000).selectExpr("CAST(id % 3 AS STRING) AS a", "CAST(id % 7 AS STRING) AS b",
                                      "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 2 = 0 THEN id % 400 ELSE id END AS u",
                                      "CAST(id % 5 = 0 AS INT) AS f")
    got = rollup_distinct_flags(df, ["a", "b"], "u", ["f"], total_name="n", label=None)
    exp = df.rollup("a", "b").agg(F.count_distinct(F.when(F.col("f") == 1, F.col("u"))).alias("f"), F.count_distinct("u").alias("n"))
    assert rows(got, "a", "b", "f", "n") == rows(exp)


def test_disposition_and_total_row(spark):
    calls = spark.createDataFrame([("c1", 1, "A"), ("c1", 1, "B"), ("c1", 2, "B"), ("c2", None, "A"),
                                   ("c2", 3, "Z"), ("c3", None, "A"), ("c3", None, "B")], "camp string, u long, r string")
    s = disposition_summary(calls, ["camp"], "u", "r", {"ab": ["A", "B"], "b": ["B"], "never": ["Q"]},
                            total="total")
    assert rows(s) == [("c1", 2, 2, 2, 0), ("c2", 1, 0, 0, 0), ("c3", 0, 0, 0, 0)]   # c3 has no known id
    t = with_total_row(s, "camp")
    assert ("Total", 3, 2, 2, 0) in rows(t)


def test_bind_cols_and_fill_zero(spark):
    a = spark.range(3).agg(F.count(F.lit(1)).alias("n"))
    b = spark.range(3).where("id > 5").agg(F.sum("id").alias("s"))
    assert rows(fill_zero(bind_cols(a, b))) == [(3, 0)]
    assert rows(bind_cols(a, b.where("s > 0"))) == [(3, None)]
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        bind_cols(a, spark.range(2)).collect()


def test_full_join_all(spark):
    from funnelkit.operators.agg import full_join_all
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a long")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "k string, b long")
    c = spark.createDataFrame([("x", 5)], "k string, c long")
    assert rows(full_join_all([a, b, c], "k")) == [("x", 1, None, 5), ("y", 2, 3, None), ("z", None, 4, None)]


def test_row_positions_match_row_number(spark):
    from pyspark.sql import Window
    from funnelkit.operators.lookup import row_positions
    df = spark.range(0, 5000).selectExpr("(id * 7919) % 5000 AS k", "id").repartition(7)
    got = row_positions(df, ["k", "id"])
    exp = df.withColumn("pos", F.row_number().over(Window.orderBy("k", "id")))
    assert rows(got, "k", "id", "pos") == rows(exp, "k", "id", "pos")


def test_rollup_leaf_rows_equal_group_by(spark):
    df = spark.range(500).selectExpr("CAST(id % 3 AS STRING) AS a", "CAST(id % 5 AS STRING) AS b", "id AS v")
    r = rollup_totals(df, {"a": "a", "b": "b"}, [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")])
    leaf = r.where((F.col("a") != "Total") & (F.col("b") != "Total"))
    assert rows(leaf) == rows(df.groupBy("a", "b").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")))


def test_milestones_and_call_state(spark):
    from funnelkit.operators.agg import call_state, milestones
    log = spark.createDataFrame([(1, "NC"), (1, "NC"), (2, "NC"), (2, "ok"), (3, "ok")], "lead long, dispo string")
    m = milestones(log, "lead", {"nc": F.col("dispo") == "NC", "ok": F.col("dispo") == "ok"})
    assert rows(m) == [(1, 1, 0), (2, 1, 1), (3, 0, 1)]
    st = log.groupBy("lead").agg(call_state(F.col("dispo") == "NC").alias("s"))
    assert rows(st) == [(1, "NC"), (2, "Contact"), (3, "No Call")]


def test_total_row_does_not_overflow_int_columns(spark):
    df = spark.createDataFrame([("a", 2_000_000_000), ("b", 2_000_000_000)], "k string, v int")
    got = {r.k: r.v for r in with_total_row(df, "k").collect()}
    assert got["Total"] == 4_000_000_000


def test_total_row_reads_its_input_once(spark, tmp_path):
    spark.range(100).selectExpr("CAST(id % 5 AS STRING) AS k", "id AS v", "'x' AS note").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = with_total_row(df.groupBy("k").agg(F.sum("v").alias("v"), F.max("note").alias("note")), "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert rows(got) == [("0", 950, "x"), ("1", 970, "x"), ("2", 990, "x"), ("3", 1010, "x"), ("4", 1030, "x"), ("Total", 4950, None)]
    assert rows(with_total_row(df.where("v < 0"), "k")) == [("Total", None, None)]
    # equal rows stay apart
    same = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    assert rows(with_total_row(same, "k")) == [("Total", 2), ("a", 1), ("a", 1)]


def test_row_positions_many_partitions_with_coalescing(spark):
    from pyspark.sql import Window
    from funnelkit.operators.lookup import row_positions
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(0, 20000).selectExpr("(id * 104729) % 20000 AS k", "id % 7 AS g").repartition(13)
        got = row_positions(df, ["k"])
        exp = df.withColumn("pos", F.row_number().over(Window.orderBy("k")))
        assert rows(got, "k", "pos") == rows(exp, "k", "pos")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
