"""Operator 9: secret scan with corpus-wide ownership frequency.

Base spans are found by three patterns (``assign``, ``access``, ``hex``). Their
secrets, and further candidates (``token``: runs of 24 or more letters, digits and
``+ / _ -`` with at least three letters, of whatever case, and three digits, that no
base span touches), are counted over the whole corpus by the distinct repositories and
owners that hold them. A repository is a text, however often it is copied, and its
owner the smallest that has it: copies of one text do not make its secrets common. A
secret in repositories of ``COPIED`` owners or more is a widely copied example; one of
fewer owners, in however many repositories, is owner-specific and looks live.
Candidates that look live are added as spans of kind ``token``; base spans stay
whatever their verdict, which is reported beside them with both counts.

DataFrame functions only. Matches are taken apart from the text between them inside
the row, and offsets are running sums of both lengths, in code points. Only secrets'
hashes are shuffled, by (secret, repository) and (secret, owner) before they are counted
by secret, so a secret that very many documents hold is counted map-side. Texts are read twice and
never shuffled; each document's verdicts come back by id and text hash.

A null text is empty. Repeated rows give the same spans each. A null id or owner is
one like any other. Columns whose names clash with the results are
dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.quality import let
from funnelkit.llm.tables import written
from funnelkit.sources.sinks import cut_lineage

# Kinds in rank order. Keyword letters match in either case, ASCII only.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{24,}={0,2}"
MIXED = r"(?=(?:.*[0-9]){3})(?=(?:.*[A-Za-z]){3})"
KINDS = ("assign", "access", "hex", "token")
MIN_VALUE = 6
COPIED = 3
SPAN = "struct<start:int,rank:int,end:int,hash:bigint>"


def _offsets(text: Column, pattern: str, rank: int, value: str | None = None, held_like: str = "") -> Column:
    """Spans of a pattern's matches whose secret (what follows ``pattern`` where
    ``value`` is given, else all) is long enough and matches ``held_like``. What stands between two matches and the match
    behind it are one step; starts are the running sum of the steps before.

    Sums are taken in blocks of 64 steps, so that a text of very many matches needs
    little more than linear time."""
    whole = pattern + (value or "")

    def spans(parts: Column) -> Column:
        def block(lo: Column) -> Column:
            return F.slice(parts, lo, 64)

        def total(steps: Column) -> Column:
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["hit"]))

        count = F.size(parts)
        lows = F.sequence(F.lit(1), count, F.lit(64))
        bases = F.aggregate(lows, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")),
                            lambda a, lo: F.struct((a["sum"] + total(block(lo))).alias("sum"),
                                                   F.concat(a["all"], F.array(a["sum"])).alias("all")),
                            lambda a: a["all"])
        def inside(lo: Column, base: Column) -> Column:
            zero = F.struct(base.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

            def step(a: Column, x: Column) -> Column:
                start = a["at"] + x["gap"]
                end = start + F.length(x["hit"])
                held = F.regexp_replace(x["hit"], "^" + pattern, "") if value else x["hit"]
                one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
                               F.xxhash64(held).alias("hash"))
                good = (F.length(held) >= MIN_VALUE) & F.regexp_like(held, F.lit(held_like))
                return F.struct(end.alias("at"), F.concat(a["out"], F.when(good, F.array(one))
                                                          .otherwise(F.array().cast(f"array<{SPAN}>"))).alias("out"))
            return F.aggregate(block(lo), zero, step, lambda a: a["out"])
        return F.flatten(F.zip_with(lows, bases, inside))

    gaps = F.transform(F.split(text, whole, -1), lambda g: F.length(g))
    hits = F.regexp_extract_all(text, F.lit("(" + whole + ")"), F.lit(1))
    parts = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits,
                       lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.regexp_like(text, F.lit(whole)), let(parts, spans)) \
        .otherwise(F.array().cast(f"array<{SPAN}>"))


def find_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``base`` (the base spans, in order) and ``more`` (candidates)."""
    value = F.coalesce(F.col(text), F.lit(""))
    base = F.sort_array(F.concat(_offsets(value, ASSIGN, 0, VALUE), _offsets(value, ACCESS, 1), _offsets(value, HEX, 2)))
    found = df.withColumn("base", base).withColumn("token", _offsets(value, TOKEN, 3, held_like=MIXED))
    return found.withColumn("more", F.filter("token", lambda t: ~F.exists(
        F.col("base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))).drop("token")


def owners(spans: DataFrame, copied: int = COPIED) -> DataFrame:
    """For every secret of ``spans`` (hash, repo, owner): the distinct repositories that
    hold it and their distinct owners, and ``live``, whether those are fewer than
    ``copied``. A repository that several owners have is the smallest one's."""
    return spans.groupBy("hash", "repo").agg(F.min(F.struct("owner")).alias("owner")) \
        .groupBy("hash", "owner").agg(F.count("*").alias("repos")) \
        .groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners")) \
        .withColumn("live", F.col("owners") < copied)


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
         copied: int = COPIED, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row a document: the ``keep`` columns, ``base``, ``more``, and ``held``, a map of
    its spans' secrets to their verdicts (``live``, ``repos``, ``owners``). Spans are
    checkpointed, without texts, so that rows can be told by a number."""
    kept = {f"k_{n}": c for n, c in (keep or {key: F.col(key)}).items()}
    found = find_spans(df.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("repo"), F.col(owner).alias("owner"),
                                 F.col(text).alias("text"), *[c.alias(n) for n, c in kept.items()]))
    found = cut_lineage(found.drop("text").withColumn("row", F.monotonically_increasing_id()))
    spans = found.select("row", "repo", "owner", F.explode(F.transform(F.concat("base", "more"), lambda s: s["hash"]))
                         .alias("hash"))
    verdicts = owners(spans, copied)
    mine = spans.select("row", "hash").distinct().join(verdicts, "hash") \
        .groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("hash", F.struct("live", "repos", "owners")))).alias("held"))
    out = found.join(mine, "row", "left")
    return out.select(*[F.col(n).alias(n[2:]) for n in kept], "base", "more", "held")


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _verdict(span: Column) -> Column:
    return F.element_at("held", span["hash"])


def _live(spans: Column) -> Column:
    return F.filter(spans, lambda s: _verdict(s)["live"])


def secret_spans(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
                 copied: int = COPIED) -> DataFrame:
    """Key, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` (base and
    added ones), ``n_live``, how many of them look live, and ``held``, for each of them
    ``repositories:owners``."""
    found = scan(df, text, key, owner, copied)
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")
    every = F.sort_array(F.concat("base", _live(F.col("more"))))
    return found.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"),
                        F.size(_live(every)).cast("bigint").alias("n_live"),
                        F.array_join(F.transform(every, lambda s: F.concat_ws(":", _verdict(s)["repos"].cast("string"),
                                                                              _verdict(s)["owners"].cast("string"))), ",").alias("held"))


def redact(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
           copied: int = COPIED, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every live-looking span replaced by ``mark`` (overlapping spans by
    one); widely copied examples stay. Texts without such spans come back as they are.
    Spans return to their rows by key and text hash, as equal rows have equal spans;
    their table is written first, so the join is planned by its size."""
    spans = F.sort_array(_live(F.concat("base", "more")))
    found = scan(df, text, key, owner, copied, {"key": F.col(key), "hash": F.xxhash64(text)}) \
        .select("key", "hash", spans.alias("spans")).where(F.size("spans") > 0).dropDuplicates(["key", "hash"])
    found = written(found, "masks").alias("m")
    # working columns stand beside the row in a struct, so no name of the caller's clashes
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[key].alias("key"), F.xxhash64(text).alias("hash")).alias("d")
    joined = rows.join(found, F.col("d.key").eqNullSafe(F.col("m.key")) & (F.col("d.hash") == F.col("m.hash")), "left") \
        .select("d.row", "m.spans")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    value = F.col("row").getField(text)
    clean = F.aggregate("spans", zero, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when((s["start"] < a["at"]) & (a["at"] > 0), a["out"])
        .otherwise(F.concat(a["out"], value.substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out")),
        lambda a: F.concat(a["out"], value.substr(a["at"] + 1, F.length(value))))
    masked = F.when(F.col("spans").isNull(), value).otherwise(clean)
    return joined.select(*[(masked if c == text else F.col("row").getField(c)).alias(c) for c in df.columns])
