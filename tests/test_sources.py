import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from funnelkit.sources import (date_series, load_cohort, maybe_in, read_csv, rename_at, save_cohort,
                               serial_to_date, split_bad, write_by_team, write_csv)
from tests.conftest import rows


def test_read_csv_schema_and_projection(spark):
    d = tempfile.mkdtemp(prefix="fk-csv-")
    p = os.path.join(d, "dump.csv")
    with open(p, "w") as f:
        f.write("lead_id,customer_type,sku,extra\n1,green,A,x\n2,red,B,y\n")
    df = read_csv(spark, p, "lead_id long, customer_type string, sku string, extra string",
                  ["lead_id", "sku"])
    assert df.columns == ["lead_id", "sku"] and rows(df) == [(1, "A"), (2, "B")]


def _csv(*lines, name="dump.csv", folder=None):
    d = folder or tempfile.mkdtemp(prefix="fk-csv-")
    with open(os.path.join(d, name), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_read_csv_binds_by_name(spark):
    d = _csv("sku,extra,lead_id,day", "A,x,1,2024-01-02", "B,y,2,2024-02-03")
    df = read_csv(spark, d, "lead_id long, sku string, day date")
    assert df.columns == ["lead_id", "sku", "day"]
    assert rows(df) == [(1, "A", dt.date(2024, 1, 2)), (2, "B", dt.date(2024, 2, 3))]
    assert rows(read_csv(spark, d, "lead_id long, sku string, day date", ["sku"])) == [("A",), ("B",)]
    with pytest.raises(ValueError, match="no column team"):
        read_csv(spark, d, "lead_id long, team string")
    # a second file in another order is refused, not read by position
    _csv("lead_id,sku,extra,day", "3,C,z,2024-01-01", name="other.csv", folder=d)
    with pytest.raises(Exception, match="CSV header"):
        read_csv(spark, d, "lead_id long, sku string").collect()


def test_read_csv_keeps_bad_records_apart(spark):
    d = _csv("lead_id,amount,sku", "1,10.5,A", "two,3,B", "3,,C", "4,1e9999x,D", "5,1,E,more", "6,2,F")
    df = read_csv(spark, d, "lead_id long, amount double, sku string", bad="bad")
    good, bad = split_bad(df, "bad")
    assert good.columns == ["lead_id", "amount", "sku"]
    assert rows(good) == [(1, 10.5, "A"), (3, None, "C"), (6, 2.0, "F")]
    assert rows(bad) == [("4,1e9999x,D",), ("5,1,E,more",), ("two,3,B",)] and bad.count() == 3
    # also when the column that is wrong is not asked for
    assert read_csv(spark, d, "lead_id long, amount double, sku string", ["sku"], bad="bad").where("bad IS NOT NULL").count() == 3


def test_team_blocks_are_balanced(spark):
    """A team of nine tenths of the rows has several files of like size, each small one a file."""
    d = tempfile.mkdtemp(prefix="fk-teams-")
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(0, 100_000, 1, 16).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS note",
                                                       "CASE WHEN id % 10 > 0 THEN 'big' ELSE CONCAT('t', id % 60) END AS team")
        write_by_team(df, d, "team", fmt="parquet")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    files = {t: [os.path.getsize(os.path.join(d, t, f)) for f in os.listdir(os.path.join(d, t)) if f.endswith(".parquet")]
             for t in os.listdir(d) if t.startswith("team=")}
    assert len(files["team=big"]) >= 4 and max(files["team=big"]) < 3 * sorted(files["team=big"])[len(files["team=big"]) // 2]
    assert all(len(sizes) == 1 for t, sizes in files.items() if t != "team=big") and len(files) == 7
    assert spark.read.parquet(d).count() == 100_000


def test_rename_at_and_serial_dates(spark):
    df = spark.createDataFrame([(1, "x", 45000)], "a long, b string, c long")
    r = rename_at(df, {2: "last_result"})
    assert r.columns == ["a", "last_result", "c"]
    assert r.select(serial_to_date("c")).first()[0] == dt.date(2023, 3, 15)


def test_maybe_in_and_date_series(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert maybe_in(df, "x", None).count() == 2 and maybe_in(df, "x", ["a"]).count() == 1
    days = date_series(spark, "2024-02-27", "2024-03-01")
    assert [r.d for r in days.collect()][-1] == dt.date(2024, 3, 1) and days.count() == 4


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="fk-sink-")
    df = spark.createDataFrame([(1, "PA"), (2, "System"), (3, "PA")], "lead_id long, attribution string")
    save_cohort(df, "fk_test_cohort", path=os.path.join(d, "cohort"))
    assert rows(load_cohort(spark, "fk_test_cohort")) == rows(df)
    spark.sql("DROP TABLE fk_test_cohort")
    write_csv(df, os.path.join(d, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(d, "csv"))
    assert back.count() == 3
    write_by_team(df, os.path.join(d, "teams"))
    assert sorted(x for x in os.listdir(os.path.join(d, "teams")) if x.startswith("attribution=")) == \
        ["attribution=PA", "attribution=System"]


def test_cut_lineage_uses_session_checkpoint_dir(spark):
    from funnelkit.sources import cut_lineage
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    out = cut_lineage(df)
    assert out.count() == 10 and spark.conf.get("spark.checkpoint.dir")


def test_read_dataset_csv_and_parquet(spark):
    from funnelkit.sources import read_dataset
    d = tempfile.mkdtemp(prefix="fk-ds-")
    df = spark.createDataFrame([(1, "Busy"), (2, "Answered Linkcall")], "user_id long, result string")
    df.write.parquet(os.path.join(d, "ivr"))
    df.write.option("header", True).csv(os.path.join(d, "drop"))
    assert rows(read_dataset(spark, d, "ivr")) == rows(df)
    got = read_dataset(spark, d, "drop", fmt="csv", schema="user_id long, result string")
    assert rows(got) == rows(df)
