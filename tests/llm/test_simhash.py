"""Operator 2 against all pairs."""

import random

import pytest

from funnelkit.llm.components import components
from funnelkit.llm.simhash import keep_one, links, midpoint_links, segments, simhash_near_dedup
from tests.llm.helpers import documents, groups, odd_docs, simhash


@pytest.mark.parametrize("bucket", [512, 1])
def test_equals_all_pairs(spark, bucket):
    rows = documents(spark).select("doc_id", "text").collect()
    prints = {r.doc_id: simhash(r.text) for r in rows}
    want = groups(prints)
    got = simhash_near_dedup(documents(spark), bucket=bucket).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == \
        {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def _planted(spark, n=60, seed=5):
    """Fingerprints in chains of small steps, so that components are wider than a ball."""
    rnd = random.Random(seed)
    out = set()
    for _ in range(n):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 8)):
            out.add(x)
            for b in rnd.sample(range(64), rnd.randrange(1, 7)):
                x ^= 1 << b
    signed = [x - (1 << 64) if x >> 63 else x for x in out]
    return signed, spark.createDataFrame([(x,) for x in signed], "fp bigint")


@pytest.mark.parametrize("bits,bucket", [(0, 512), (2, 512), (4, 512), (5, 512), (2, 0), (3, 0)])
def test_links_of_other_distances(spark, bits, bucket):
    signed, df = _planted(spark, 25 if bucket == 0 else 60)
    assert sum(r + 1 for _, r in segments(bits)) == bits + 1
    edges = links(df, bits, bucket).collect()
    for e in edges:
        assert ((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= bits
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for e in edges:
        parent[find(e.a)] = find(e.b)
    want = groups({x: x & (1 << 64) - 1 for x in signed}, bits)
    for x in signed:
        for y in signed:
            assert (find(x) == find(y)) == (want[x] == want[y])


@pytest.mark.parametrize("parts", [1, 2, 3, 5])
def test_every_cut_finds_the_same_components(spark, parts):
    """Two and three segments (and five, and for three bits one) give all pairs' components."""
    bits = 4 if parts > 1 else 1
    cut = [(64 // parts + (i >= parts - 64 % parts), (bits + 1) // parts - 1 + (i < (bits + 1) % parts)) for i in range(parts)]
    assert sum(w for w, _ in cut) == 64 and sum(r + 1 for _, r in cut) == bits + 1
    signed, df = _planted(spark, 40)
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for e in links(df, bits, cut=cut).collect():
        assert ((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= bits
        parent[find(e.a)] = find(e.b)
    want = groups({x: x & (1 << 64) - 1 for x in signed}, bits)
    assert all((find(x) == find(y)) == (want[x] == want[y]) for x in signed for y in signed)


def test_segments_follow_the_count():
    for bits in range(8):
        for n in (0, 10 ** 3, 10 ** 6, 10 ** 9, 10 ** 12):
            cut = segments(bits, n)
            assert sum(w for w, _ in cut) == 64 and sum(r + 1 for _, r in cut) == bits + 1
    assert [len(segments(4, n)) for n in (200_000, 5 * 10 ** 6, 10 ** 8, 10 ** 10)] == [3, 3, 2, 2]
    # rows that a fingerprint meets by chance stay far below one midpoint ball
    assert all(10 ** 9 / 2 ** w < 1 for w, _ in segments(4, 10 ** 9))


def test_a_component_of_half_the_rows_has_no_hot_task(spark):
    """The join that names components deals a large one's members over salts."""
    import pyspark.sql.classic.dataframe as classic
    from funnelkit.llm import simhash as S
    line = [(1 << b) - 1 for b in range(63)] + [((1 << b) - 1) ^ (1 << 62) for b in range(50)]
    rnd = random.Random(3)
    fps = [(i, x) for i, x in enumerate(line)] + [(1000 + i, rnd.getrandbits(63)) for i in range(100)]
    df = spark.createDataFrame(fps, "doc_id bigint, fp bigint")
    seen, orig = [], classic.DataFrame.join

    def spy(self, other, on=None, how=None):
        if isinstance(on, list) and on == ["root", "salt"]:
            seen.append(self)
        return orig(self, other, on, how)
    classic.DataFrame.join = spy
    try:
        got = {r.fp: r.component_id for r in S.near_duplicates(df).collect()}
    finally:
        classic.DataFrame.join = orig
    want = groups({i: x for i, x in fps})
    assert got == {x: want[i] for i, x in fps} and len(set(want.values())) < len(fps) // 2 + 5
    most = seen[0].groupBy("root", "salt").count().agg({"count": "max"}).first()[0]
    assert most <= 12


def test_midpoint_links_are_bounded_by_the_ball(spark):
    """A dense cluster is linked with at most a ball's edges a member, not by pairs."""
    cluster = [x for x in range(1 << 10)]
    df = spark.createDataFrame([(x,) for x in cluster], "fp bigint")
    edges = midpoint_links(df, 2).count()
    assert edges < 20 * len(cluster) < len(cluster) * (len(cluster) - 1) / 2


def test_odd_rows(spark):
    df = odd_docs(spark)
    rows = df.select("doc_id", "text").collect()
    got = simhash_near_dedup(df).collect()
    assert len(got) == len(rows)
    prints = {r.doc_id: simhash(r.text) for r in rows if r.doc_id is not None}
    want = groups(prints)
    for g in got:
        if g.doc_id is not None:
            assert (g.fingerprint, g.component_id) == (f"{prints[g.doc_id]:016x}", want[g.doc_id])
        else:
            assert g.component_id is None
    assert simhash_near_dedup(df.limit(0)).count() == 0


def test_keep_one(spark):
    df = odd_docs(spark)
    kept = keep_one(df)
    assert kept.columns == df.columns
    prints = {r.doc_id: simhash(r.text) for r in df.collect() if r.doc_id is not None}
    want = sorted(set(groups(prints).values()))
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 1
    assert keep_one(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
