"""Operator 6: quality rules with host verdicts.

Each text is judged by its own figures (``base_failed``), then each host by its
texts: failures are summed by domain, the hosts' rates are shrunk towards the
corpus by a beta prior fitted to all of them (method of moments), and a host whose
shrunk rate exceeds ``max_rate`` is rejected. Host verdicts are joined back to the
documents.

DataFrame functions only. A text's repeated windows are found inside its row, so
nothing but small figures is shuffled; hosts are summed map-side first.

Nulls and texts without words have no words (``n_words`` 0) and fail. A null host
is a host like any other. Repeated rows count as often as they come, and columns
whose names clash with the results are dropped. With fewer than two hosts, or hosts
that do not differ, the prior is one document's worth of the corpus rate. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.tables import written
from funnelkit.sources.sinks import cut_lineage

SPACE = " \t\n\x0b\f\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_RATE = 0.5


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever the optimizer does."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")) \
        .otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_words(found: Column, size: int = WINDOW) -> Column:
    """How many words stand in ``size``-word windows that the array holds twice or
    more. Windows are compared by 64-bit hash; the positions of equal ones are found
    by sorting, in n log n steps, and only in arrays that have any."""
    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(by_hash, lambda s: let(
            F.sort_array(F.transform(
                F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"]))
                         | (F.get(s, i + 1)["h"].eqNullSafe(x["h"]))),
                lambda x: x["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - p, F.lit(size)))),
                F.lit(0).cast("bigint"), lambda a, x: a + x)))

    hashes = F.transform(F.sequence(F.lit(1), F.size(found) - (size - 1)),
                         lambda i: F.xxhash64(F.slice(found, i, size)))
    return F.when(F.size(found) <= size, F.lit(0).cast("bigint")).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint"))
            .otherwise(covered(h))))


def figures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words`` of each text."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    found = df.withColumn("__words", words(F.col(text))).withColumn("__lines", lines)
    long = lambda c: c.cast("bigint")
    return found.withColumns({
        "n_words": long(F.size("__words")),
        "word_chars": long(F.length(F.translate(value, SPACE, ""))),
        "n_symbols": long(F.length(value) - F.length(F.translate(value, "#*$%&|<>", ""))),
        "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
        "n_repeat_words": repeated_words(F.col("__words")),
    }).drop("__words", "__lines")


def base_failed() -> Column:
    """The rule on a text's own figures."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def failing(text: Column) -> Column:
    """``base_failed`` from the text alone."""
    return let(words(text), lambda w: (F.size(w) < MIN_WORDS)
               | (100 * repeated_words(w) > MAX_REPEAT_PERCENT * F.size(w)))


def host_verdicts(judged: DataFrame, host: str, failed: str = "base_failed", max_rate: float = MAX_RATE) -> DataFrame:
    """One row a host: documents, failures, its shrunk failure rate and ``host_kept``.

    The prior is Beta(m * k, (1 - m) * k): m is the corpus's rate, and the strength k
    comes from how much host rates vary beyond what their sizes explain."""
    hosts = cut_lineage(judged.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("docs"), F.sum(F.col(failed).cast("int")).alias("failures")))
    rate = F.col("failures") / F.col("docs")
    m = F.sum("failures") / F.sum("docs")
    total = hosts.agg(m.alias("m"), F.sum("docs").alias("n"), F.count("*").alias("hosts"),
                      F.sum(F.col("docs") * rate * rate).alias("square"))
    # spread of the rates between hosts, weighted by documents, less the binomial share
    between = F.col("square") / F.col("n") - F.col("m") * F.col("m")
    noise = F.col("m") * (1 - F.col("m"))
    share = F.col("hosts") / F.col("n")
    spread = (between - noise * share) / (1 - share)
    k = F.when((F.col("hosts") > 1) & (F.col("n") > F.col("hosts")) & (spread > 0),
               F.greatest(noise / spread - 1, F.lit(1.0))).otherwise(F.lit(1.0))
    prior = total.select(F.struct("m", k.alias("k")))
    shrunk = (F.col("failures") + F.col("p.m") * F.col("p.k")) / (F.col("docs") + F.col("p.k"))
    return hosts.withColumn("p", prior.scalar()).withColumn("rate", shrunk) \
        .select("host", "docs", "failures", "rate", (F.col("rate") <= max_rate).alias("host_kept"))


def quality_rules(df: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source",
                  max_rate: float = MAX_RATE) -> DataFrame:
    """Key, the five figures, ``base_failed`` and ``kept`` of every document. The
    figures, without texts, are checkpointed and read for both passes."""
    own = df.select(F.col(key).alias("__key"), F.col(host).alias("__host"), F.col(text).alias("__text"))
    judged = figures(own, "__text").drop("__text").withColumn("base_failed", base_failed())
    judged = cut_lineage(judged)
    hosts = written(host_verdicts(judged, "__host", max_rate=max_rate).select("host", "host_kept"), "hosts")
    out = judged.join(hosts, judged["__host"].eqNullSafe(hosts["host"]), "left")
    return out.select(F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def keep_good(df: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``df`` that pass both verdicts. Texts are judged once: rows are written
    with their own verdict, hosts are summed from two columns of that, and rejected hosts
    are removed by an anti join with their written table."""
    judged = written(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), failing(F.col(text)).alias("failed")),
                     "judged")
    verdicts = host_verdicts(judged.select(F.col("row").getField(host).alias("host"), "failed"), "host", "failed", max_rate)
    bad = written(verdicts.where(~F.col("host_kept")).select("host"), "rejected-hosts")
    good = judged.where(~F.col("failed"))
    good = good.join(bad, F.col("row").getField(host).eqNullSafe(bad["host"]), "left_anti")
    return good.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
