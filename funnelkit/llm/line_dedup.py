"""Operator 10: line dedup by site-relative frequency.

Documents are grouped by host. A line's frequency is the number of its host's pages
that contain it over the number of the host's pages; lines above ``ratio`` are
boilerplate and are dropped from every page of that host. A page is a row, however many
rows share its text. A line has to stand on ``min_pages`` pages, two unless told
otherwise: on the single page of a small host it repeats nothing. A page of nothing but
boilerplate keeps its lines without a word only.

DataFrame functions only. Each page emits its distinct lines as hashes, which are
counted by (host, line) map-side first, never by host alone; page totals are a count by
host. Boilerplate lines of a host number at most its mean lines a page over ``ratio``;
they are joined back to the documents as one row a host, and each text is filtered
inside its row. That table is written first, so Spark knows its size: below the
session's threshold it is broadcast and texts are not shuffled, above it texts are
joined by host with skewed hosts split.

Lines are compared as they stand, between ``\n``, and told by 64-bit hash: a clash
would need two lines of one host, one of them boilerplate, to share a hash. Lines
without a word are never dropped. A null text stays null, an empty one empty (both are
pages of their host); a null host is a host like any other; repeated rows are returned
as often as they come. Columns are returned as they came, with ``text`` filtered. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.quality import SPACE
from funnelkit.llm.tables import written

RATIO = 0.1
MIN_PAGES = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _worded(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) != ""


def boilerplate(df: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, line_hash, pages, host_pages)`` of the lines to drop."""
    own = df.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = own.groupBy("host").agg(F.count("*").alias("host_pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _worded), lambda x: F.xxhash64(x)))
    counts = own.select("host", F.explode(hashes).alias("line_hash")) \
        .groupBy("host", "line_hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, counts["host"].eqNullSafe(totals["host"])).drop(totals["host"]) \
        .where(F.col("pages") > ratio * F.col("host_pages"))


def line_dedup(df: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO,
               min_pages: int = MIN_PAGES, count: str | None = None) -> DataFrame:
    """``df`` with boilerplate lines dropped from ``text``; ``count`` names a column for
    the number of lines dropped, if wanted."""
    found = boilerplate(df, text, host, ratio, min_pages)
    hosts = written(found.groupBy("host").agg(F.collect_list("line_hash").alias("lines")), "boilerplate")
    # working columns stand in structs, so a name of the caller's cannot clash with them
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row")).alias("d")
    own = lambda c: F.col("d.row").getField(c)
    lines, drop = _lines(own(text)), F.col("b.lines")
    kept = F.filter(lines, lambda x: ~(F.array_contains(drop, F.xxhash64(x)) & _worded(x)))
    joined = rows.join(hosts.alias("b"), own(host).eqNullSafe(F.col("b.host")), "left") \
        .select("d.row", F.when(drop.isNotNull(), kept).alias("kept")).alias("d")
    kept = F.col("d.kept")
    cleaned = F.coalesce(F.array_join(kept, "\n"), own(text))
    extra = []
    if count:
        extra = [F.coalesce(F.size(_lines(own(text))) - F.when(kept.isNotNull(), F.size(kept)), F.lit(0))
                 .cast("bigint").alias(count)]
    return joined.select(*[(cleaned if c == text else own(c)).alias(c) for c in df.columns if c != count], *extra)
