"""A key holding a third of all rows: the as-of engine's exchange on (key, cell)
spreads it, a key-only exchange puts it in one task. Spark's hash
partitioning is pmod(murmur3(keys, seed 42), n), i.e. F.pmod(F.hash(...), n),
so the per-task load of each exchange can be computed exactly."""

from pyspark.sql import functions as F

from funnelkit.operators.lookup import _cell, asof_join, hot_keys_for, time_micros

N = 64


def _skewed(spark, n=90_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("k"),
        (F.lit("2024-01-01").cast("timestamp_ntz") +
         F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 29) % (30 * 86400))).alias("t"),
        F.col("id").alias("rid"))


def _max_over_mean(df, *cols):
    loads = df.groupBy(F.pmod(F.hash(*cols), F.lit(N)).alias("p")).count()
    r = loads.agg(F.max("count").alias("mx"), F.sum("count").alias("tot")).first()
    return r.mx / (r.tot / N)


def test_hot_key_is_spread_over_cells(spark):
    df = _skewed(spark)
    hot = hot_keys_for(df, "k", "t", share=16)
    assert [r[0] for r in hot.rows] == [0]
    cut = df.join(hot.frame(spark, ["k"], 1), "k", "left").withColumn(
        "b", F.coalesce(_cell(time_micros("t", df), F.col("__cuts"), len(hot.rows[0][-3])), F.lit(0)))
    key_only = _max_over_mean(df, "k")
    key_cell = _max_over_mean(cut, "k", "b")
    assert key_only > 15          # one task would hold the whole hot key (a third of all rows)
    assert key_cell < 5           # per (key, cell) the hot key is a third of 64 cells


def test_asof_on_hot_key_is_exact(spark):
    df = _skewed(spark, 6000)
    left = df.where(F.col("rid") % 2 == 0).select("k", "t", "rid")
    right = df.where(F.col("rid") % 2 == 1).select("k", F.col("t").alias("rt"), F.col("rid").alias("r"))
    got = asof_join(left, right, "k", "t", "rt", ["r"], tiebreak=["r"])
    brute = (left.join(right, "k").where(F.col("rt") < F.col("t"))
             .groupBy("rid").agg(F.max_by("r", F.struct("rt", "r")).alias("r")))
    exp = left.join(brute, "rid", "left")
    assert sorted(map(tuple, got.select("rid", "r").collect())) == \
        sorted(map(tuple, exp.select("rid", "r").collect()))


def test_hot_keys_are_those_above_a_fair_share(spark):
    df = _skewed(spark, 30_000)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [r[0] for r in hot_keys_for(df, "k", "t").rows] == [0]
    many = hot_keys_for(df, "k", "t", share=10_000)           # every key is above so small a share
    assert 900 < len(many.rows) <= 10_000 * parts
    assert not hot_keys_for(df.where("k <> 0"), "k", "t")
    # cuts add up to about as many as there are cells
    assert sum(len(r[-3]) for r in hot_keys_for(df, "k", "t").rows) <= 4 * parts


def test_hot_keys_do_not_pass_through_the_driver(spark, monkeypatch):
    """However many keys are hot, the driver reads no row a key, and a key keeps only the
    quantiles that it is cut at."""
    from pyspark.sql.classic.dataframe import DataFrame
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(3000).select((F.col("id") % 500).alias("k"), F.expr(
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, id)").alias("t"))
    read, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: read.append(collect(self)) or read[-1])
    hot = hot_keys_for(df, "k", "t", share=10_000)
    got = asof_join(df, df.select("k", F.col("t").alias("rt")), "k", "t", "rt", ["rt"], hot=hot)
    assert sum(map(len, read)) <= 5
    monkeypatch.undo()
    assert len(hot.rows) == 500 and sum(sum(r[-3]) for r in hot.rows) <= 10_000 * parts
    assert got.where("rt = t - INTERVAL 500 MINUTES").count() == 2500 and got.where("rt IS NULL").count() == 500
