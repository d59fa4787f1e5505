"""Membership: flags, semi / anti joins, null-aware suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.operators.lookup import _pairs

__all__ = ["attach_flag", "semi", "anti", "suppress", "flag_earlier_exists"]


def attach_flag(df: DataFrame, members: DataFrame, key: str, name: str,
                member_key: str | None = None, value: str = "1") -> DataFrame:
    """``value`` when the key is in ``members``, NULL otherwise. Members are
    de-duplicated first (an aggregation), so the row count of ``df`` never changes."""
    mk = member_key or key
    m = members.where(F.col(mk).isNotNull()).select(F.col(mk).alias(key)).distinct() \
        .withColumn(name, F.lit(value))
    return df.join(m, key, "left")


def semi(df: DataFrame, other: DataFrame, on, where: Column | None = None) -> DataFrame:
    """Rows of ``df`` with at least one match (EXISTS). Never multiplies rows."""
    pairs = _pairs(on)
    o = other if where is None else other.where(where)
    o = o.select(*[F.col(rk).alias(lk) for lk, rk in pairs])
    return df.join(o, [lk for lk, _ in pairs], "left_semi")


def anti(df: DataFrame, other: DataFrame, on, where: Column | None = None) -> DataFrame:
    """Rows of ``df`` without a match (NOT EXISTS / left join + IS NULL)."""
    pairs = _pairs(on)
    o = other if where is None else other.where(where)
    o = o.select(*[F.col(rk).alias(lk) for lk, rk in pairs])
    return df.join(o, [lk for lk, _ in pairs], "left_anti")


def suppress(df: DataFrame, lst: DataFrame, key: str, list_key: str | None = None,
             null_aware: bool = True) -> DataFrame:
    """J22 ``key NOT IN (SELECT list_key FROM lst)``.

    SQL semantics: nothing is in an empty list, so every row stays, NULL keys
    included; against any other list a NULL ``key`` never survives, and a single NULL
    in the list empties the result. Exclusion is an ordinary anti join; what else the
    list says (is it empty, does it hold a NULL) is a relation of one row, made once and
    joined. A scalar sub-query would be copied to wherever Spark moves the filter.
    """
    lk = list_key or key
    kept = df.join(lst.where(F.col(lk).isNotNull()).select(F.col(lk).alias(key)), key, "left_anti")
    if not null_aware:
        return kept
    # NULL: the list is empty; else whether it holds a NULL. The key is 0 on both sides, but
    # made of a column, so that this stays an equi join
    facts = lst.agg(F.max(F.col(lk).isNull()).alias("__null")).withColumn("__f", F.pmod(F.hash("__null"), F.lit(1)))
    known = kept.withColumn("__f", F.pmod(F.hash(F.col(key)), F.lit(1))).join(F.broadcast(facts), "__f")     # one row
    null = F.col("__null")
    return known.where(null.isNull() | (~null & F.col(key).isNotNull())).select(*df.columns)


def flag_earlier_exists(df: DataFrame, keys: Sequence[str], t: str, qualifies: Column,
                        name: str = "dup_flag") -> DataFrame:
    """1 when an earlier row (strictly smaller ``t``) of the same keys
    qualifies, else 0. The earliest qualifying time per key is an aggregate,
    joined back by key: no self join over pairs, no window over a whole key."""
    first = df.where(qualifies).groupBy(*keys).agg(F.min(t).alias("__fq"))
    out = df.join(first, list(keys), "left")
    return out.withColumn(name, F.when(F.col("__fq") < F.col(t), 1).otherwise(0)).drop("__fq")
