import datetime as dt

from pyspark.sql import functions as F

from funnelkit.functions.expr import (age_years, decode_label, extract_group, imatch, m_bucket,
                                      month_diff, month_offset_label, nimatch, pct_text,
                                      pct_text_ratio, pg_regex, similar_prefix, text_between,
                                      to_numeric, vintage_bucket, dow_sunday0, collapse_newlines)
from funnelkit.functions.calendar import days_in_month, days_left, days_past, prev_month_end


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_pg_regex_dollar_and_class():
    assert pg_regex("sms$", True) == "(?si)sms\\z"
    assert pg_regex("[$]x") == "(?s)[$]x"
    assert pg_regex("a\\$") == "(?s)a\\$"


def test_imatch_end_anchor_and_newline(spark):
    got = one(spark, imatch("s", "021$"), [("PL-021",), ("PL-021\n",), ("pl-0211",), (None,)], "s string")
    # PostgreSQL: '$' only at the very end, so a trailing newline does not match
    assert got == [True, False, False, None]
    got = one(spark, imatch("s", "a.b"), [("a\nb",)], "s string")
    assert got == [True]


def test_negated_regex_null_drops_row(spark):
    df = spark.createDataFrame([("System",), ("agent",), (None,)], "o string")
    assert [r.o for r in df.where(nimatch("o", "system")).collect()] == ["agent"]


def test_extract_group_case_sensitive(spark):
    data = [("CRM-AB12",), ("crm-ab12",), ("CRM-ABCD",), (None,)]
    got = one(spark, extract_group("s", "-([A-Z0-9]+)$"), data, "s string")
    assert got == ["AB12", None, "ABCD", None]


def test_attribution_rule_lookahead(spark):
    from funnelkit.plans.reports import SMS_CODE
    data = [("CRM-AB12",), ("crm-ab12",), ("CRM-ABCD",), ("CRM-1234",), ("sms",)]
    got = one(spark, imatch("s", SMS_CODE), data, "s string")
    assert got == [True, True, False, False, False]


def test_similar_prefix_null_takes_no_branch(spark):
    data = [("500001",), ("560001",), (None,)]
    z = similar_prefix("p", ["50", "51", "52", "53", "54", "55"])
    got = one(spark, F.when(z, "AP").when(~z, "ROI").otherwise("sku"), data, "p string")
    assert got == ["AP", "ROI", "sku"]


def test_text_codes_compare_lexicographically(spark):
    data = [("70",), ("390",), ("1000",), (None,)]
    assert one(spark, F.col("c") >= "390", data, "c string") == [True, True, False, None]
    got = one(spark, text_between("c", "500000", "550000", negate=True),
              [("500000",), ("550000",), ("560001",), (None,)], "c string")
    assert got == [False, False, True, None]


def test_decode_label_defaults(spark):
    m = {1: "Green", 2: "Red", 3: "Amber"}
    data = [(1,), (3,), (9,), (None,)]
    assert one(spark, decode_label("t", m), data, "t int") == ["Green", "Amber", None, None]
    assert one(spark, decode_label("t", m, "NH"), data, "t int") == ["Green", "Amber", "NH", "NH"]


def test_month_diff_and_labels(spark):
    data = [(dt.date(2023, 12, 31), dt.date(2024, 1, 1)), (dt.date(2023, 1, 1), dt.date(2024, 1, 31)),
            (None, dt.date(2024, 1, 1))]
    df = spark.createDataFrame(data, "a date, b date")
    n = month_diff("a", "b")
    got = df.select(n, m_bucket(n), m_bucket(n, 3, null_stays=True), month_offset_label(n)).collect()
    assert [tuple(r) for r in got] == [(1, "M1", "M1", "M-1"), (12, "M1+", "M2+", "M-6 >"), (None, "M1+", None, "M-6 >")]


def test_vintage_bucket(spark):
    data = [(dt.datetime(2024, 1, 20),), (dt.datetime(2023, 10, 1),), (dt.datetime(2023, 1, 1),),
            (dt.datetime(2024, 3, 1),), (None,)]
    got = one(spark, vintage_bucket("d", "2024-01-01", "2024-02-01", "2023-08-01"), data, "d timestamp")
    assert got == ["V0", "V1", "V2", "2024-03", None]


def test_age_years_leap_day(spark):
    data = [(dt.date(2000, 2, 29), dt.date(2001, 2, 28)), (dt.date(2000, 2, 29), dt.date(2001, 3, 1)),
            (dt.date(1990, 6, 15), dt.date(2024, 6, 14))]
    df = spark.createDataFrame(data, "dob date, d date")
    assert [r[0] for r in df.select(age_years("dob", F.col("d"))).collect()] == [0, 1, 33]


def test_to_numeric_bad_text_is_null(spark):
    got = one(spark, to_numeric("s"), [("12.5",), ("abc",), ("",), (None,)], "s string")
    assert [None if g is None else float(g) for g in got] == [12.5, None, None, None]


def test_percent_texts(spark):
    df = spark.createDataFrame([(1, 16), (2, 3), (5, 0)], "a long, b long")
    assert [r[0] for r in df.select(pct_text(F.col("a"), F.col("b"))).collect()] == ["6.3 %", "66.7 %", None]
    got = [r[0] for r in df.select(pct_text_ratio(F.try_divide(F.col("a"), F.col("b")))).collect()]
    assert got == ["6.25%", "66.67%", None]


def test_calendar_and_dow(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 10),)], "d date")
    r = df.select(days_in_month(F.col("d")), days_past(F.col("d")), days_left(F.col("d")),
                  prev_month_end(F.col("d")), dow_sunday0(F.lit("2024-01-07").cast("date"))).first()
    assert tuple(r) == (29, 9, 20, dt.date(2024, 1, 31), 0)


def test_collapse_newlines(spark):
    assert one(spark, collapse_newlines("s"), [("a\r\n\nb\nc",)], "s string") == ["a b c"]
