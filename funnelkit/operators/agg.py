"""Aggregation building blocks: milestone flags, filtered first/last values,
progress ladders, string / map aggregates, rollups with totals, disposition
summaries (A1-A26)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.expr import col_
from funnelkit.operators.lookup import order_key

__all__ = ["milestones", "call_state", "milestone", "milestone_and_not", "first_by", "last_by", "progress",
           "join_strings", "join_distinct", "collect_struct", "answers_map",
           "rollup_totals", "with_total_row", "disposition_summary", "bind_cols",
           "full_join_all", "count_distinct_if", "fill_zero"]


def milestone(pred: Column, default: int | None = None) -> Column:
    """``bool_or(pred)::integer`` (``coalesce(..., default)`` if given)."""
    m = F.bool_or(pred).cast("int")
    return F.coalesce(m, F.lit(default)) if default is not None else m


def milestones(logs: DataFrame, key: Sequence[str] | str, preds: Mapping[str, Column],
               default: int | None = None) -> DataFrame:
    """A6 at table level: one row per key with ``bool_or(pred)::int`` per name
    (one aggregation pass over the log, map-side combined)."""
    keys = [key] if isinstance(key, str) else list(key)
    return logs.groupBy(*keys).agg(*[milestone(p, default).alias(n) for n, p in preds.items()])


def call_state(pred: Column, labels: Sequence[str] = ("NC", "Contact", "No Call")) -> Column:
    """A9 tri-state label over a group: all rows match, some match, none (or no
    rows). The second label is the reference's for "some rows match"."""
    all_, some, none = labels
    return F.when(F.bool_and(pred), F.lit(all_)).when(F.bool_or(pred), F.lit(some)).otherwise(F.lit(none))


def milestone_and_not(a: Column, b: Column) -> Column:
    """``(bool_or(a) and not bool_or(b))::integer``."""
    return (F.bool_or(a) & ~F.bool_or(b)).cast("int")


def first_by(x: Column | str, order: Sequence[Column | str], where: Column | None = None) -> Column:
    """``(array_agg(x ORDER BY order) FILTER (WHERE where))[1]`` without
    building the array; a NULL ``x`` is kept, as ``array_agg`` keeps it."""
    o = order_key(order)
    return F.min_by(col_(x), o if where is None else F.when(where, o))


def last_by(x: Column | str, order: Sequence[Column | str], where: Column | None = None) -> Column:
    o = order_key(order)
    return F.max_by(col_(x), o if where is None else F.when(where, o))


def progress(ladder: Sequence[tuple[Column, str]], default: str) -> Column:
    """A10: highest stage reached; the first rung whose predicate held on any row."""
    expr = None
    for pred, label in ladder:
        cond = F.bool_or(pred)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def join_strings(x: Column | str, sep: str, order: Column | str | None = None,
                 where: Column | None = None) -> Column:
    """``string_agg(x, sep)``; deterministic order (by ``order`` or by x).
    NULL for an empty group. The string is as long as the group: for groups without a
    bound in the data model keep the rows instead."""
    v = col_(x).cast("string")
    if where is not None:
        v = F.when(where, v)
    if order is None:
        return _joined(F.array_sort(F.collect_list(v)), sep)
    s = F.struct(col_(order).alias("o"), v.alias("v"))
    arr = F.array_sort(F.collect_list(F.when(v.isNotNull(), s)))
    return _joined(F.transform(arr, lambda e: e["v"]), sep)


def _joined(arr: Column, sep: str) -> Column:
    """The elements as one string; NULL for none (a lone empty string stays)."""
    return F.when(F.size(arr) > 0, F.array_join(arr, sep))


def join_distinct(x: Column | str, sep: str, where: Column | None = None) -> Column:
    """``string_agg(DISTINCT x, sep) FILTER (WHERE ...)``, sorted; NULL when empty."""
    v = col_(x) if where is None else F.when(where, col_(x))
    return _joined(F.array_sort(F.collect_set(v)), sep)


def collect_struct(fields: Mapping[str, Column | str], order: Sequence[Column | str]) -> Column:
    """Parallel ``array_agg`` columns as one sorted array of structs, so a
    NULL in one field cannot shift the other arrays. The array holds the whole group:
    for groups without a bound in the data model keep the rows instead."""
    s = F.struct(order_key(order).alias("__o"), *[col_(c).alias(n) for n, c in fields.items()])
    return F.transform(F.sort_array(F.collect_list(s)), lambda e: e.dropFields("__o"))


def answers_map(k: Column | str, v: Column | str) -> Column:
    """key/value rows to a map. Keys must be unique per group (take the
    latest answer per key first, e.g. with ``first_per``)."""
    return F.map_from_entries(F.collect_list(F.struct(col_(k).cast("string"), col_(v).cast("string"))))


def count_distinct_if(x: Column | str, cond: Column) -> Column:
    """A3: ``count(DISTINCT x) FILTER (WHERE cond)``."""
    return F.count_distinct(F.when(cond, col_(x)))


def rollup_totals(df: DataFrame, keys: Mapping[str, Column | str], aggs: Sequence[Column],
                  label: str = "Total", mark: str = "grouping") -> DataFrame:
    """``GROUP BY ROLLUP(keys)`` with subtotal labels.

    ``mark='grouping'`` labels rows where ``grouping(k) = 1`` (a real NULL key
    stays NULL); ``mark='null'`` labels every NULL, as the reference's
    ``CASE WHEN k IS NULL`` variant does. Keys are cast to text for the label.
    """
    named = {n: col_(c) for n, c in keys.items()}
    base = df.select(*[c.alias(n) for n, c in named.items()], *[F.col(c) for c in df.columns
                                                                 if c not in named])
    gcols = [F.grouping(n).alias(f"__g_{n}") for n in named] if mark == "grouping" else []
    out = base.rollup(*named).agg(*aggs, *gcols)
    labels = {}
    for n in named:
        txt = F.col(n).cast("string")
        if mark == "grouping":
            labels[n] = F.when(F.col(f"__g_{n}") == 1, F.lit(label)).otherwise(txt)
        else:
            labels[n] = F.coalesce(txt, F.lit(label))
    out = out.withColumns(labels)
    return out.drop(*[f"__g_{n}" for n in named]) if gcols else out


def with_total_row(df: DataFrame, label_col: str, label: str = "Total",
                   sum_cols: Sequence[str] | None = None) -> DataFrame:
    """Append one row with the column sums, labelled in ``label_col``; other columns
    are NULL there.

    ``df`` is evaluated once: its rows are numbered and grouped by the sets (row) and (),
    which copies the summary's few rows, not what they were made from. Sums have their
    wider type (long for integers) in all rows."""
    num = sum_cols or [f.name for f in df.schema.fields
                       if f.name != label_col and f.dataType.typeName() in
                       ("long", "integer", "double", "decimal", "short", "float")]
    own = df.withColumns({"__row": F.monotonically_increasing_id(), "__own": F.lit(True)})
    # a row of nothing, so that the total of no rows is a row as well
    none = df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("__row"), F.lit(False).alias("__own"))
    rows = own.unionByName(none, allowMissingColumns=True)
    other = [c for c in df.columns if c not in num]
    out = rows.groupingSets([["__row"], []], "__row").agg(
        F.grouping("__row").alias("__all"), *[F.sum(c).alias(c) for c in num], *[F.first(c).alias(c) for c in other],
        F.bool_or("__own").alias("__own")).where((F.col("__all") == 1) | F.col("__own"))
    whole = F.col("__all") == 1
    return out.select(*[F.col(c) if c in num else F.when(whole, F.lit(label) if c == label_col else None)
                        .otherwise(F.col(c)).alias(c) for c in df.columns])


def disposition_summary(df: DataFrame, group: Sequence[str], ident: Column | str, result: Column | str,
                        buckets: Mapping[str, Sequence[str] | None], total: str = "Total_Calls",
                        distinct: bool = True) -> DataFrame:
    """One pass of filtered counts, one column per disposition bucket.

    ``buckets`` maps a column name to the outcome list it counts (``None`` = all
    rows). ``distinct`` counts distinct ``ident`` (R's ``n_distinct(na.rm=TRUE)``),
    otherwise rows. This replaces per-bucket frames stitched by an outer join.

    Distinct counts are computed without Spark's per-aggregate row expansion:
    first one row per (group, ident) with a 0/1 flag per bucket (map-side
    combined), then plain sums per group.
    """
    r, i = col_(result), col_(ident)
    conds = {name: (r.isin(list(values)) if values is not None else F.lit(True))
             for name, values in buckets.items()}
    if not distinct:
        return df.groupBy(*group).agg(F.count(F.lit(1)).alias(total),
                                      *[F.count(F.when(c, F.lit(1))).alias(n) for n, c in conds.items()])
    # NULL ids count nothing but keep their group (it may have no others)
    per = (df.groupBy(*group, i.alias("__id"))
           .agg(*[F.max(F.when(c & i.isNotNull(), 1).otherwise(0)).alias(n) for n, c in conds.items()]))
    return per.groupBy(*group).agg(F.count("__id").alias(total),
                                   *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in conds])


def bind_cols(*one_row: DataFrame) -> DataFrame:
    """Side-by-side binding of one-row frames (each a global aggregate).

    Every frame is a scalar sub-query, so Spark itself refuses one of more than one
    row; nothing is joined or broadcast. A frame without a row binds as NULLs."""
    spark = one_row[0].sparkSession
    bound = spark.range(1).select(*[df.select(F.struct(*df.columns)).scalar().alias(f"__f{i}")
                                    for i, df in enumerate(one_row)])
    return bound.select(*[F.col(f"__f{i}.`{c}`").alias(c) for i, df in enumerate(one_row) for c in df.columns])


def full_join_all(dfs: Sequence[DataFrame], key: Sequence[str] | str) -> DataFrame:
    """N-way full outer join on one key (prefer one ``disposition_summary`` pass)."""
    keys = [key] if isinstance(key, str) else list(key)
    return reduce(lambda a, b: a.join(b, keys, "full"), dfs)


def fill_zero(df: DataFrame, text_cols: Sequence[str] = ()) -> DataFrame:
    """NULL to 0 in numeric columns (and to '0' in the listed text columns)."""
    out = df.fillna(0)
    return out.fillna("0", subset=list(text_cols)) if text_cols else out
