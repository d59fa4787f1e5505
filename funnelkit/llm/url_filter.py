"""Operator 8: URL filters by a Bloom filter cascade.

A list of keys is encoded over the corpus's complete key universe. Level one is a
Bloom filter of the listed keys; level two encodes the universe's other keys that
level one lets pass, level three the listed keys that level two lets pass, and so on
until no level is wrong about any key. A key's membership is then exact, and is an
expression over its own hashes: no join, and nothing of the corpus is broadcast.

A URL's keys are the suffixes of its host, each followed by the beginnings of its
path that some rule's path has the length of; there are at most (labels of the
longest rule host) x (different rule path lengths) of them. Rules of either action
and the listed hosts have a cascade each.

DataFrame functions only. The universe is one distinct (combined map-side, dealt by the
key itself) for all lists, each a bit of a key's mark; it is written once and every
level reads only the keys that the level before got wrong. A filter's bits stand in the
plan as one binary value. Filters hold about ``1.44 * (log2(universe / listed) + 4)``
bits a listed key, which follows the list and not the corpus. A list whose first filter
would be larger than ``part_bytes`` is taken in parts by hash of the key: URLs are
marked part by part, each in a pass of its own that is written before the next, so that
no plan holds more than one part's filters whatever the list.

A null URL, or one without ``://``, has an empty host and path, no rule, and is
allowed. An empty list lists nothing, a null host in it nothing either. Repeated rows
are judged each; columns whose names clash with the results are dropped. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.sources.sinks import cut_lineage

PART_BYTES = 8 << 20       # of a list's first filter, in one plan
MAX_LEVELS = 64
RATE = 1 / 16              # wrong keys of every level after the first
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as big-endian 64-bit words, and its hashes' number and
    seed."""
    words: bytes
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        words = F.lit(self.words)

        def word(p: Column) -> Column:
            at = F.substring(words, (F.shiftright(p, 6) * 8 + 1).cast("int"), F.lit(8))
            return F.conv(F.hex(at), 16, -10).cast("bigint")
        return F.forall(_places(key, len(self.words) * 8, self.hashes, self.seed), lambda p: F.getbit(
            word(p), p.bitwiseAND(F.lit(63)).cast("int")) == 1)


@dataclass(frozen=True)
class Cascade:
    """Exact membership of the keys of the universe that the cascade was made over."""
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        if not self.levels:
            return F.lit(False)
        out = self.levels[-1].passes(key)
        for level in reversed(self.levels[:-1]):
            out = level.passes(key) & ~out
        return out


def _places(key: Column, bits: int, hashes: int, seed: int) -> Column:
    """Bit positions of a key by double hashing."""
    one, two = F.xxhash64(F.lit(2 * seed), key), F.xxhash64(F.lit(2 * seed + 1), key)
    small = lambda h: F.shiftrightunsigned(h, 24)  # noqa: E731  40 bits, so that sums stay in range
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (small(one) + i * small(two)) % bits)


def _hashes(rate: float) -> int:
    return max(1, round(math.log2(1 / rate)))


def _size(n: int, rate: float) -> int:
    """64-bit words of a filter of ``n`` keys."""
    return max(1, math.ceil(1.44 * n * _hashes(rate) / 64))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    hashes, size = _hashes(rate), _size(n, rate)
    places = keys.select(F.explode(_places(F.col("key"), size * 64, hashes, seed)).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).collect()  # at most ``size`` rows
    out = bytearray(8 * size)
    for w, bits in words:
        out[8 * w:8 * w + 8] = bits.to_bytes(8, "big", signed=True)
    return Level(bytes(out), hashes, seed)


def first_rate(listed: int, rest: int) -> float:
    """Wrong keys of the first level: as many as are listed, if there are more others."""
    return RATE if rest < listed / RATE else listed / rest


def build_cascade(ours: DataFrame, others: DataFrame, n: int, rest: int) -> Cascade:
    """The cascade of ``ours`` over ``ours`` and ``others`` (column ``key``, distinct and
    apart; ``n`` and ``rest`` of them). Each level reads only the keys that the level
    before it got wrong."""
    levels: list[Level] = []
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: keys with equal hashes")
        level = _level(ours, n, RATE if levels else first_rate(n, rest), len(levels))
        levels.append(level)
        wrong = cut_lineage(others.where(level.passes(F.col("key"))))
        ours, others = wrong, ours
        n, rest = wrong.count(), n
    return Cascade(tuple(levels))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, labels: int) -> Column:
    """The host's last one, two, ... up to ``labels`` labels."""
    parts = F.split(host, r"\.")
    depth = F.least(F.size(parts), F.lit(labels))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, -i, i), ".")))


def url_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Keys that a rule could have that fits the URL."""
    heads = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    return F.flatten(F.transform(host_suffixes(host, labels), lambda h: F.transform(
        F.filter(heads, lambda p: p.isNotNull()), lambda p: F.concat(h, p))))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def _held(cascade: Cascade, mark: str, part: int, parts: int):
    def held(key: Column) -> Column:
        mine = cascade.contains(F.concat(F.lit(mark), key))
        return mine if parts == 1 else (_part(F.concat(F.lit(mark), key), parts) == part) & mine
    return held


def _members(own: DataFrame, lists: dict[str, tuple[str, DataFrame]], part_bytes: int) -> DataFrame:
    """``own`` with a column for each list, ``name -> (column of keys, listed keys)``: those
    of the row's keys that the list holds."""
    names = list(lists)
    bit = {name: 1 << i for i, name in enumerate(names)}
    # a key of one column is not a key of another: the column's place goes before it
    sources = sorted({column for column, _ in lists.values()})
    mark = {column: f"{i}:" for i, column in enumerate(sources)}

    def marked(c: str) -> Column:
        return F.transform(F.col(c), lambda k: F.concat(F.lit(mark[c]), k))
    universe = own.select(F.explode(F.array_distinct(F.concat(*map(marked, sources)))).alias("key")) \
        .select("key", F.lit(0).alias("lists"))
    for name, (column, listed) in lists.items():
        universe = universe.unionAll(listed.select(F.concat(F.lit(mark[column]), F.col("key")), F.lit(bit[name])))
    tagged = cut_lineage(universe.where(F.col("key").isNotNull()).groupBy("key").agg(F.bit_or("lists").alias("lists")))
    on = lambda name: F.col("lists").bitwiseAND(F.lit(bit[name])) != 0
    sizes = tagged.groupBy(F.substring_index("key", ":", 1).alias("m")).agg(
        F.count("*").alias("n"), *[F.count(F.when(on(name), 1)).alias(name) for name in names]).collect()  # a row a column
    for name, (column, _) in lists.items():
        n = sum(r[name] for r in sizes)
        rest = sum(r.n for r in sizes if r.m == mark[column][:-1]) - n
        parts = max(1, math.ceil(8 * _size(n, first_rate(n, rest)) / part_bytes)) if n else 1
        there = tagged.where(F.col("key").startswith(mark[column]))
        found = None
        for part in range(parts):
            here = there if parts == 1 else there.where(_part(F.col("key"), parts) == part)
            ours, others = here.where(on(name)), here.where(~on(name))
            if parts > 1:
                k, r = ours.count(), others.count()
            else:
                k, r = n, rest
            cascade = build_cascade(ours, others, k, r)
            now = F.filter(F.col(column), _held(cascade, mark[column], part, parts))
            own = own.withColumn(name, now if found is None else F.concat(F.col(name), now))
            found = True
            if parts > 1:
                own = cut_lineage(own)
    return own


def judge_urls(df: DataFrame, rules: dict[str, str], blocked_hosts: list[str] | DataFrame, url: str = "url",
               key: str = "page_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """Key, ``host``, ``path``, ``rule`` and ``verdict`` of every URL.

    ``rules`` maps ``host/path`` to ``allow`` or ``block``; a rule fits its host and
    all subdomains where the path begins with the rule's, and the longest wins. URLs
    without a rule are blocked if their host, or a domain above it, is listed.
    ``blocked_hosts`` is a list, or a DataFrame whose first column holds the hosts."""
    spark = df.sparkSession
    split = {r: (r[:r.index("/")], r[r.index("/"):]) for r in rules}
    labels = max((h.count(".") + 1 for h, _ in split.values()), default=1)
    lengths = sorted({len(p) for _, p in split.values()})
    of = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string")
    hosts = of(blocked_hosts) if isinstance(blocked_hosts, list) else \
        blocked_hosts.select(F.col(blocked_hosts.columns[0]).cast("string").alias("key")).where(F.col("key").isNotNull())
    deep = hosts.agg(F.max(F.size(F.split("key", r"\."))).alias("n")).first().n or 1
    own = df.select(F.col(key).alias("k"), F.col(url).alias("url"))
    own = own.select("k", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    empty = F.array().cast("array<string>")
    own = own.withColumns({"keys": url_keys(F.col("host"), F.col("path"), labels, lengths) if lengths else empty,
                           "above": host_suffixes(F.col("host"), deep)})
    own = _members(own, {"block": ("keys", of([r for r, a in rules.items() if a == "block"])),
                         "allow": ("keys", of([r for r, a in rules.items() if a != "block"])),
                         "listed": ("above", hosts)}, part_bytes)
    fits = F.transform(F.concat("block", "allow"), lambda k: F.struct(F.length(k).alias("n"), k.alias("rule")))
    out = own.withColumn("rule", F.array_max(fits)["rule"])
    by_rule = F.when(F.array_contains("block", F.col("rule")), "block").otherwise("allow")
    by_host = F.when(F.size("listed") > 0, "block").otherwise("allow")
    return out.select(F.col("k").alias(key), "host", "path", "rule",
                      F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_host).alias("verdict"))
