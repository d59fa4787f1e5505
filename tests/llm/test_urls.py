"""Operator 8 against plain matching."""

import re

import pytest

from funnelkit.llm import url_filter
from funnelkit.llm.queries import BLOCKED_HOSTS, URL_RULES
from funnelkit.llm.url_filter import build_cascade, judge_urls

ODD = [None, "", "nourl", "http://NET/", "http://net", "https://a.NET/x?y", "x://y://z.net/", "ftp://example.net/en/1",
       "ftp://example.net/e", "http://sub.example.com/de/", "http://org/fr/a#b", "http://x.org/fr", "://spam-farm.example.org",
       "http://www.spam-farm.example.org/q", "http://a..net/", "http://.net/", "http://net./", "http://" + "a." * 500 + "net/x",
       "HTTP://É.example.com/de/é\n", "http://a\nb.net/"]


def judged(url, rules, hosts):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    under = lambda h: host == h or host.endswith("." + h)
    fits = [r for r in rules if under(r[:r.index("/")]) and path.startswith(r[r.index("/"):])]
    rule = max(fits, key=len) if fits else None
    return host, path, rule, rules[rule] if rule else ("block" if any(map(under, hosts)) else "allow")


@pytest.mark.parametrize("hosts", [BLOCKED_HOSTS, []])
def test_verdicts(spark, hosts):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    rows = [(1000 + i, u) for i, u in enumerate(ODD)] + [(None, "http://q.net/")] * 2
    pages = pages.unionAll(spark.createDataFrame(rows, pages.schema)).selectExpr("*", "1 as rule", "2 as keys", "3 as host")
    got = sorted((tuple(r) for r in judge_urls(pages, URL_RULES, hosts).collect()), key=repr)
    assert got == sorted(((r.page_id, *judged(r.url, URL_RULES, hosts)) for r in pages.collect()), key=repr)
    assert judge_urls(pages.limit(0), URL_RULES, hosts).count() == 0


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert tuple(judge_urls(pages, {}, ["net"]).first()) == (1, "a.net", "/", None, "block")


@pytest.mark.parametrize("every", [1, 2, 37, 5000])
def test_cascade_is_exact(spark, every):
    universe = spark.range(5000).selectExpr("cast(id as string) as key")
    ours, others = universe.where(f"key % {every} = 0"), universe.where(f"key % {every} <> 0")
    cascade = build_cascade(ours, others, ours.count(), others.count())
    found = {int(r.key) for r in universe.where(cascade.contains(universe["key"])).collect()}
    assert found == set(range(0, 5000, every))
    assert len(cascade.levels) <= 8


def _long(spark, n, listed):
    pages = spark.range(n).selectExpr("id as page_id", "concat('http://www.site', id % 4000, '.example.', if(id % 2 = 0, 'com', 'net'), "
                                      "if(id % 3 = 0, '/en/x', '/de/y')) as url")
    hosts = spark.range(listed).selectExpr("concat('site', id * 3, if(id % 5 = 0, '.example.com', '.example.net')) as host", "id")
    return pages, hosts.unionAll(spark.createDataFrame([(None, 0)], "host string, id bigint"))


@pytest.mark.parametrize("part_bytes,every", [(url_filter.PART_BYTES, 1), (400, 1)])
def test_a_long_list_from_a_table(spark, part_bytes, every):
    """Exact against a join; also where the list is taken in parts."""
    pages, hosts = _long(spark, 6000, 3000)
    got = judge_urls(pages, URL_RULES, hosts, part_bytes=part_bytes)
    known = {r.host for r in hosts.collect()}
    want = [(r.page_id, *judged(r.url, URL_RULES, [])) for r in pages.collect()]
    want = [x if x[3] else (*x[:4], "block" if x[1].removeprefix("www.") in known else "allow") for x in want]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {x[4] for x in want if not x[3]} == {"allow", "block"}
    assert ("ExistingRDD" in got._jdf.queryExecution().optimizedPlan().toString() or "LogicalRDD" in
            got._jdf.queryExecution().optimizedPlan().toString()) == (part_bytes == 400)


def test_one_universe_for_all_lists(spark):
    """The pages are read once for the universe, and once for the verdicts."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    seen, orig = [], url_filter.cut_lineage
    url_filter.cut_lineage = lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), orig(df))[1]
    try:
        judge_urls(pages, URL_RULES, BLOCKED_HOSTS)
    finally:
        url_filter.cut_lineage = orig
    assert sum(plan.count("FileScan") for plan in seen) == 1


def test_native_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = judge_urls(pages, URL_RULES, BLOCKED_HOSTS)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)
