"""Per-row lookups: top-1 per key, as-of, bounded look-back, range aggregates,
previous distinct state (A23, J7-J18, W1).

Design rules (see README "Scale"):

* Equality-only top-1 is an aggregation (``min_by``/``max_by`` over a struct),
  which Spark combines map-side, so a key holding a third of all rows is reduced
  inside every input task before the shuffle.
* Anything ordered in time (as-of, look-back, "count of rows before") runs on the
  prefix engine ``prefix_agg``: left and right rows meet in one running window,
  hash-partitioned on (key, cell). A key is hot when it holds more than a fair
  share of all rows (total / (SHARE * shuffle partitions)), so at most
  ``SHARE * partitions`` keys can be; each hot key is cut into cells of about
  that many rows at quantiles of its own times, and a seed row carries the
  result of the cells before into each cell. Every other key is one cell. No
  task holds a whole hot key, no pair of rows is emitted, the work is linear.
* Finding the hot keys is a count per key, run when the lookup is built. The hot
  keys and their cut times are checkpointed in the shared folder: of them the driver
  reads two counts and one length, and passes on their broadcast, which is
  bounded by ``SHARE * partitions`` keys and twice as many cuts.
  ``hot_keys_for`` counts a log once for several lookups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from funnelkit.functions.expr import col_
from funnelkit.sources.sinks import cut_lineage

__all__ = ["HotKeys", "hot_keys_for", "wall_micros", "row_positions", "first_per", "lookup_latest", "prefix_agg",
           "asof_join", "lookback_join", "window_count", "range_join", "range_agg", "agg_per_key", "nth_state",
           "order_key", "time_micros"]

SHARE = 4            # cells a shuffle partition's fair share of the rows is cut into
MAX_CUTS = 4096      # quantiles taken of one hot key's times
_T, _B, _J, _S = "__t", "__b", "__j", "__side"
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def _pairs(on) -> list[tuple[str, str]]:
    """Normalise a join key spec: 'k', ['k1','k2'] or [('left_k','right_k'), ...]."""
    if isinstance(on, str):
        return [(on, on)]
    out = []
    for k in on:
        out.append((k, k) if isinstance(k, str) else (k[0], k[1]))
    return out


def wall_micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock value
    (``timestamp_ntz`` or ``date``), computed from its calendar fields so no
    time zone takes part (Spark's casts and ``timestampdiff`` go through the
    session zone, where a daylight-saving gap maps 02:30 after 03:00)."""
    if isinstance(c, str):
        # same arithmetic as below, built as one SQL expression (one call
        # instead of a dozen while the plan is assembled)
        w = f"CAST(`{c.replace('`', '``')}` AS TIMESTAMP_NTZ)"
        return F.expr(f"((CAST(datediff(CAST({w} AS DATE), DATE'1970-01-01') AS BIGINT) * 24 + hour({w})) * 60"
                      f" + minute({w})) * 60000000 + CAST(extract(SECOND FROM {w}) * 1000000 AS BIGINT)")
    w = col_(c).cast("timestamp_ntz")
    days = F.datediff(w.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    secs = F.extract(F.lit("SECOND"), w)
    return ((days * 24 + F.hour(w)) * 60 + F.minute(w)) * 60_000_000 + (secs * 1_000_000).cast("long")


def time_micros(c: Column | str, df: DataFrame | None = None) -> Column:
    """Monotone numeric image of a time column: wall-clock micros for
    ``timestamp_ntz`` / ``date`` (zone-free), epoch micros for instants
    (``timestamp``). Pass ``df`` so the type can be resolved; without it the
    value is treated as wall-clock time."""
    col = col_(c)
    if df is not None:
        if isinstance(c, str) and "." not in c and c in df.columns:
            kind = df.schema[c].dataType.typeName()            # cached schema, no new analysis
        else:
            kind = df.select(col).schema.fields[0].dataType.typeName()
        if kind == "timestamp":
            return F.unix_micros(col)
    return wall_micros(col)


def order_key(order: Sequence[Column | str]) -> Column:
    """Struct sort key with PostgreSQL NULL placement: NULL sorts as the largest
    value, so it comes last ascending and first descending."""
    if all(isinstance(o, str) and "." not in o for o in order):
        # one SQL expression for plain column names (fewer calls while building)
        parts = []
        for i, o in enumerate(order):
            q = "`" + o.replace("`", "``") + "`"
            parts += [f"'n{i}', {q} IS NULL", f"'v{i}', {q}"]
        return F.expr("named_struct(" + ", ".join(parts) + ")")
    fields = []
    for i, o in enumerate(order):
        c = col_(o)
        fields += [c.isNull().alias(f"n{i}"), c.alias(f"v{i}")]
    return F.struct(*fields)


def first_per(df: DataFrame, key, order: Sequence[Column | str], cols: Sequence[str] | None = None,
              last: bool = False) -> DataFrame:
    """A23 ``DISTINCT ON (key) ... ORDER BY order``: the first (or last) row per key.

    One aggregation with map-side combine; ties must be broken by ``order``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*cols), order_key(order))
    return df.groupBy(*keys).agg(pick.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in cols])


def lookup_latest(left: DataFrame, right: DataFrame, on, order: Sequence[Column | str],
                  cols: Sequence[str], how: str = "left", pick: str = "last",
                  where: Column | None = None, prefix: str = "") -> DataFrame:
    """Attach the latest (``pick='last'``) or earliest row of ``right``
    per equality key, e.g. a correlated ``ORDER BY t DESC LIMIT 1`` sub-query."""
    pairs = _pairs(on)
    r = right if where is None else right.where(where)
    agg = (F.max_by if pick == "last" else F.min_by)(F.struct(*[col_(c) for c in cols]), order_key(order))
    top = (r.groupBy(*[F.col(rk).alias(lk) for lk, rk in pairs]).agg(agg.alias("__r"))
           .select(*[lk for lk, _ in pairs], *[F.col(f"__r.{c}").alias(prefix + c) for c in cols]))
    return left.join(top, [lk for lk, _ in pairs], how)


_MERGE = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}


@dataclass(frozen=True)
class HotKeys:
    """Keys that hold more than a fair share of the rows, with the times (micros)
    that cut each into cells and its first and last right-side time. A time that is a
    quantile more than once holds that many cells' rows: its share is kept beside it."""
    table: DataFrame | None = None        # k0, k1, ..., cuts, shares, first, last
    longest: int = 0                      # most cuts of a key

    def __bool__(self) -> bool:
        return self.table is not None

    @property
    def rows(self) -> tuple[tuple, ...]:
        """The table, read into the driver: for looking at, not for lookups."""
        return tuple(map(tuple, self.table.collect())) if self else ()

    def open_ended(self) -> HotKeys:
        """Without the first and last times, for a right side that may lie outside them."""
        if not self:
            return self
        none = F.lit(None).cast("bigint")
        return HotKeys(self.table.withColumns({"first": none, "last": none}), self.longest)

    def frame(self, spark, kcols: Sequence[str], sign: int) -> DataFrame:
        """Bounded table of the hot keys: at most SHARE * partitions rows, whose cuts
        add up to about as many. Times are negated and reversed to look forward."""
        keys = [F.col(f"k{i}").alias(k) for i, k in enumerate(kcols)]
        if sign > 0:
            return self.table.select(*keys, F.col("cuts").alias("__cuts"), F.col("shares").alias("__shares"),
                                     F.col("last").alias("__end"))
        return self.table.select(*keys, F.transform(F.reverse("cuts"), lambda c: -c).alias("__cuts"),
                                 F.reverse("shares").alias("__shares"), (-F.col("first")).alias("__end"))


def _find_hot(keyed: DataFrame, kcols: Sequence[str], share: int) -> HotKeys:
    """Hot keys of ``keyed`` (key columns, ``__ht`` time in micros, ``__hr`` whether a
    right row). One map-side combined count per key, of which the total and the largest
    come back; only if that is hot, one pass over the hot keys' times for the quantiles,
    of which each key keeps those that it is cut at."""
    spark = keyed.sparkSession
    cells = share * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.lit(True)
    for k in kcols:
        known = known & F.col(k).isNotNull()
    keyed = keyed.where(known & F.col("__ht").isNotNull())
    counts = keyed.groupBy(*kcols).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    if not total or most * cells <= total or most == 1:      # the usual case: one count, one row back
        return HotKeys()
    m = max(2, min(cells, MAX_CUTS))
    listed = counts.where((F.col("__n") * cells > total) & (F.col("__n") > 1)).select(
        *kcols, F.least(F.lit(m), F.ceil(F.col("__n") * cells / F.lit(total))).cast("int").alias("__k"))    # cells of this key
    quantiles = F.percentile_approx("__ht", [i / m for i in range(1, m)], 10 * MAX_CUTS)
    found = keyed.join(F.broadcast(listed), list(kcols)).groupBy(*kcols, "__k").agg(      # at most ``cells`` keys
        quantiles.alias("__q"), F.min(F.when(F.col("__hr"), F.col("__ht"))).alias("first"),
        F.max(F.when(F.col("__hr"), F.col("__ht"))).alias("last"))
    picked = F.transform(F.sequence(F.lit(1), F.col("__k") - 1), lambda i: F.get(
        "__q", F.greatest(F.lit(0), F.least(F.lit(m - 2), F.bround(i * m / F.col("__k")).cast("int") - 1))))
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(kcols)]
    found = found.select(*keys, picked.alias("__p"), "first", "last")
    # equal quantiles stand together: where each run of them starts, and how long it is
    starts = F.filter(F.sequence(F.lit(0), F.size("__p") - 1), lambda i: (i == 0) | (F.get("__p", i) != F.get("__p", i - 1)))
    found = found.withColumn("__s", starts).select(
        *[f"k{i}" for i in range(len(kcols))], F.transform("__s", lambda i: F.get("__p", i)).alias("cuts"),
        F.transform("__s", lambda i, j: F.coalesce(F.get("__s", j + 1), F.size("__p")) - i).alias("shares"), "first", "last")
    table = cut_lineage(found)
    longest = table.agg(F.max(F.size("cuts"))).first()[0]
    return HotKeys(table, longest) if longest else HotKeys()


def hot_keys_for(df: DataFrame, key, time: str, share: int = SHARE, holds_right: bool = False) -> HotKeys:
    """The hot keys of one base table, for sharing across several lookups on data
    derived from it (``hot=``): a chain of lookups then counts keys once.

    ``holds_right`` states that every right row's key and time is in ``df`` (it is
    filtered from it). Left rows beyond a key's last right row are then spread over
    cells; otherwise they share the key's last cell."""
    keys = [key] if isinstance(key, str) else list(key)
    kcols = [f"__k{i}" for i in range(len(keys))]
    hot = _find_hot(df.select(*[F.col(k).alias(kc) for k, kc in zip(keys, kcols)],
                              time_micros(time, df).alias("__ht"), F.lit(True).alias("__hr")), kcols, share)
    return hot if holds_right else hot.open_ended()


def _cell(t: Column, cuts: Column, longest: int) -> Column:
    """Number of cuts below ``t``, found by halving steps."""
    steps = [1 << b for b in range(longest.bit_length() - 1, -1, -1)]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(
        F.coalesce(F.get(cuts, lo + s - 1) < t, F.lit(False)), lo + s).otherwise(lo))


def _shared(t: Column, cuts: Column, shares: Column, below: Column) -> Column:
    """How many cells the rows of exactly this time make: 0 unless it is a cut that
    was more than one quantile."""
    share = F.when(F.get(cuts, below) == t, F.get(shares, below))
    return F.when(share > 1, share).otherwise(0)


def prefix_agg(left: DataFrame, right: DataFrame, on, left_time: Column | str,
               right_time: Column | str, aggs: Mapping[str, tuple[str, Column]], *,
               inclusive: bool = False, forward: bool = False, open_bound: bool = False,
               hot: HotKeys | None = None, share: int = SHARE) -> DataFrame:
    """For each left row, aggregate the right rows of the same key that lie before
    it in time (``t_r < t_l``; ``<=`` when ``inclusive``), or after it when
    ``forward`` (``t_r > t_l`` / ``>=``).

    ``aggs`` maps an output name to ``(kind, right_expr)`` with kind ``max``,
    ``min``, ``sum`` or ``count`` (``count`` ignores ``right_expr`` and is 0 when
    nothing precedes). Every left row is returned once with all its columns. A left
    row with a NULL key meets nothing; one with a NULL time meets nothing either, or,
    with ``open_bound``, every right row of its key.

    Hot keys (see the module notes) are cut into cells; ``share`` sets how finely,
    and ``hot`` passes a list made by ``hot_keys_for`` (keyed like ``left``). Left
    rows that meet nothing, or lie beyond a hot key's last right row, are spread over
    cells of their own. So are left rows of a time that more than a cell's rows share:
    all they meet is in their seed row, and right rows of that time count in seeds only.
    """
    pairs = _pairs(on)
    kcols = [f"__k{i}" for i in range(len(pairs))]
    sign = -1 if forward else 1
    l_side, r_side = (1, 0) if inclusive else (0, 1)
    spark = left.sparkSession
    names = list(aggs)
    acols = [f"__a{i}" for i in range(len(names))]

    lt = time_micros(left_time, left)
    lx = left.withColumns({k: F.col(lk) for k, (lk, _) in zip(kcols, pairs)} | {"__raw": lt})
    rx = right.select(*[F.col(rk).alias(k) for k, (_, rk) in zip(kcols, pairs)],
                      time_micros(right_time, right).alias("__raw"),
                      *[(F.lit(1) if aggs[n][0] == "count" else aggs[n][1]).alias(a) for a, n in zip(acols, names)])
    known = F.lit(True)
    for k in kcols:
        known = known & F.col(k).isNotNull()
    rx = rx.where(known & F.col("__raw").isNotNull())
    if hot is None:
        hot = _find_hot(lx.select(*kcols, F.col("__raw").alias("__ht"), F.lit(False).alias("__hr")).unionAll(
            rx.select(*kcols, F.col("__raw").alias("__ht"), F.lit(True).alias("__hr"))), kcols, share)

    t = F.col("__raw") * sign
    if open_bound:
        t = F.coalesce(t, F.lit(_LAST))
    # rows without a key or time meet nothing: deal them out by what they hold
    plain = [f.name for f in left.schema.fields if isinstance(f.dataType, AtomicType)]
    dealt = F.pmod(F.xxhash64(*plain) if plain else F.lit(0), F.lit(1 << 20)).cast("int")
    lx = lx.withColumns({_T: t, _S: F.lit(l_side)}).withColumn(
        _B, F.when(known & F.col(_T).isNotNull(), 0).otherwise(-1 - dealt)).drop("__raw")
    rx = rx.withColumns({_T: F.col("__raw") * sign, _S: F.lit(r_side), _B: F.lit(0)}).drop("__raw")

    lx, rx = lx.withColumn(_J, F.lit(0)), rx.withColumn(_J, F.lit(0))
    if hot:
        # Cells of a hot key by place: 2n holds the times between its cuts n and n + 1,
        # 2n + 1 the rows of cut n + 1 itself where that time is more than a cell.
        table = F.broadcast(hot.frame(spark, kcols, sign))       # bounded, see HotKeys.frame
        longest = hot.longest
        cuts, beyond = F.col("__cuts"), 2 * F.size("__cuts") + 2
        extra = ["__cuts", "__shares", "__end", "__n", "__many"]

        def placed(df):
            df = df.join(table, kcols, "left").withColumn("__n", F.when(cuts.isNotNull(), _cell(F.col(_T), cuts, longest)))
            return df.withColumn("__many", F.when(cuts.isNotNull(), _shared(F.col(_T), cuts, F.col("__shares"), F.col("__n"))))
        place = 2 * F.col("__n") + F.when(F.col("__many") > 0, 1).otherwise(0)
        lx = placed(lx)
        last = F.coalesce(F.col(_T) > F.col("__end"), F.lit(False))
        lx = lx.withColumns({
            _B: F.when(cuts.isNull() | (F.col(_B) < 0), F.col(_B)).when(last, beyond + F.pmod(dealt, F.size("__cuts") + 1))
            .otherwise(place),
            _J: F.when((F.col("__many") > 0) & ~last & (F.col(_B) >= 0), F.pmod(dealt, F.col("__many"))).otherwise(0)}).drop(*extra)
        rx = placed(rx).withColumn(_B, F.when(cuts.isNull(), 0).otherwise(place))
        sums = rx.where(cuts.isNotNull()).groupBy(*kcols, _B).agg(
            *[_MERGE[aggs[n][0]](F.col(a)).alias(a) for a, n in zip(acols, names)])
        rx = rx.where(cuts.isNull() | (F.col("__many") == 0)).drop(*extra)
        # every cell's place, and how many cells stand there
        every = hot.frame(spark, kcols, sign).select(*kcols, "__cuts", "__shares", F.explode(
            F.sequence(F.lit(0), beyond + F.size("__cuts"))).alias(_B))
        tied = (F.col(_B) % 2 == 1) & (F.col(_B) < beyond)
        share = F.get("__shares", F.floor(F.col(_B) / 2).cast("int"))
        every = every.select(*kcols, _B, F.when(tied & (share > 1), share).otherwise(1).alias("__many"))
        # seeds hold the places before; where a whole time is one place and counts, its own too
        over = Window.partitionBy(*kcols).orderBy(_B)                                    # cells, not rows
        before, upto = (over.rowsBetween(Window.unboundedPreceding, x) for x in (-1, 0))

        def seed(a, n):
            own = F.when((F.col("__many") > 1) & F.lit(inclusive), _MERGE[aggs[n][0]](F.col(a)).over(upto))
            return own.otherwise(_MERGE[aggs[n][0]](F.col(a)).over(before)).alias(a)
        seeds = every.join(sums, [*kcols, _B], "left").select(
            *kcols, *[seed(a, n) for a, n in zip(acols, names)], F.lit(_FIRST).alias(_T), F.lit(r_side).alias(_S), _B, "__many")
        seeds = seeds.withColumn(_J, F.explode(F.sequence(F.lit(0), F.col("__many") - 1))).drop("__many")
        rx = rx.unionByName(seeds)

    both = lx.unionByName(rx, allowMissingColumns=True)
    w = Window.partitionBy(*kcols, _B, _J).orderBy(_T, _S).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = {n: _MERGE[aggs[n][0]](F.col(a)).over(w) for a, n in zip(acols, names)}
    out = both.withColumns({f"__o{i}": run[n] for i, n in enumerate(names)}).where(F.col(_S) == l_side)
    return out.select(*left.columns, *[
        (F.coalesce(F.col(f"__o{i}"), F.lit(0)) if aggs[n][0] == "count" else F.col(f"__o{i}")).alias(n)
        for i, n in enumerate(names)])


def asof_join(left: DataFrame, right: DataFrame, on, left_time: Column | str,
              right_time: Column | str, cols: Sequence[str], *, strict: bool = True,
              forward: bool = False, tiebreak: Sequence[str] = (), prefix: str = "",
              keep_time: str | None = None, open_bound: bool = False,
              hot: HotKeys | None = None, share: int = SHARE) -> DataFrame:
    """Attach to every left row the latest right row of the same key
    with ``t_r < t_l`` (``<=`` unless ``strict``); with ``forward`` the earliest
    row with ``t_r > t_l`` (``>=`` unless ``strict``). Ties on time go to the
    largest ``tiebreak`` (smallest when ``forward``; numeric tie-break columns).

    ``keep_time`` names an output column holding the matched right time.
    """
    sign = -1 if forward else 1
    fields = [(time_micros(right_time, right) * sign).alias("__o")]
    fields += [(col_(t) * sign).alias(f"__tb{i}") for i, t in enumerate(tiebreak)]
    payload = [col_(c).alias(c) for c in cols]
    if keep_time:
        payload.append(col_(right_time).alias("__rt"))
    pick = F.struct(*fields, *payload)
    res = prefix_agg(left, right, on, left_time, right_time, {"__pick": ("max", pick)}, inclusive=not strict,
                     forward=forward, open_bound=open_bound, hot=hot, share=share)
    outs = [F.col(f"__pick.{c}").alias(prefix + c) for c in cols]
    if keep_time:
        outs.append(F.col("__pick.__rt").alias(keep_time))
    return res.select(*left.columns, *outs)


def _seconds(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(n)))


def lookback_join(left: DataFrame, right: DataFrame, on, left_time: str, right_time: str,
                  cols: Sequence[str], window_seconds: int, *, pick: str = "last",
                  upper_inclusive: bool = False, tiebreak: Sequence[str] = (),
                  prefix: str = "", hot: HotKeys | None = None, share: int = SHARE) -> DataFrame:
    """J12 (``pick='last'``) / J13 (``pick='first'``): the latest or earliest right
    row of the key with ``t_l - window <= t_r < t_l`` (``<= t_l`` when
    ``upper_inclusive``). No range join: the latest row is an as-of lookup cut at
    the lower bound, the earliest is a forward as-of from ``t_l - window`` cut at
    the upper bound."""
    lo = col_(left_time) - _seconds(window_seconds)
    if pick == "last":
        res = asof_join(left, right, on, left_time, right_time, cols, strict=not upper_inclusive,
                        tiebreak=tiebreak, prefix="__m_", keep_time="__mt", hot=hot, share=share)
        ok = F.col("__mt") >= lo
    else:
        res = asof_join(left.withColumn("__lo", lo), right, on, "__lo", right_time, cols,
                        strict=False, forward=True, tiebreak=tiebreak, prefix="__m_",
                        keep_time="__mt", hot=hot, share=share).drop("__lo")
        ok = (F.col("__mt") <= col_(left_time)) if upper_inclusive else (F.col("__mt") < col_(left_time))
    return res.select(*left.columns, *[F.when(ok, F.col(f"__m_{c}")).alias(prefix + c) for c in cols])


def window_count(left: DataFrame, right: DataFrame, on, left_time: str, right_time: str,
                 lo_seconds: int, hi_seconds: int, name: str = "n", *, row_id: str,
                 hot: HotKeys | None = None, share: int = SHARE) -> DataFrame:
    """Count right rows of the key with ``t_l + lo <= t_r < t_l + hi`` as the
    difference of two prefix counts (no pair is materialised). Both bounds of a left
    row are marker rows of one pass; ``row_id`` is a column unique in ``left`` by
    which they meet again."""
    lks = [lk for lk, _ in _pairs(on)]
    bound = F.explode(F.array(
        F.struct((col_(left_time) + _seconds(lo_seconds)).alias("__at"), F.lit(-1).alias("__sign")),
        F.struct((col_(left_time) + _seconds(hi_seconds)).alias("__at"), F.lit(1).alias("__sign"))))
    marks = left.select(row_id, *[c for c in lks if c != row_id], bound.alias("__m")).select(
        row_id, *[c for c in lks if c != row_id], "__m.__at", "__m.__sign")
    counted = prefix_agg(marks, right, on, "__at", right_time, {"__n": ("count", F.lit(1))}, hot=hot, share=share)
    per = counted.groupBy(row_id).agg(F.sum(F.col("__n") * F.col("__sign")).alias(name))
    return left.join(per, row_id)


def range_join(left: DataFrame, right: DataFrame, on, left_time: str, right_time: str,
               lo_seconds: int, hi_seconds: int, how: str = "inner", row_id: str | None = None,
               share: int = SHARE) -> DataFrame:
    """Every (left, right) pair of a key with ``t_l + lo <= t_r < t_l + hi``,
    with the left table's key columns and the right table's other columns.
    ``how="left"`` also keeps left rows without a match, once each, and needs
    ``row_id``, a column unique in ``left``.

    The result is the match set itself, found by an equi join on cells. A cell is a
    key's time bucket of width ``hi - lo``; where that holds more than a fair share of
    the right rows it is cut at quantiles of its own times (and a time that alone is
    more than a cell, by row). A right row stands in one cell, a left row in each cell
    its window reaches: the neighbours, and the cuts between. So no task holds a hot key
    or a hot bucket, and candidates stay within a window's width of each other. Prefer ``window_count`` /
    ``lookback_join`` when an aggregate is what is used.
    """
    if how not in ("inner", "left"):
        raise ValueError("range_join is an inner or left join")
    if how == "left" and row_id is None:
        raise ValueError("a left range_join needs row_id, a column unique in the left table")
    pairs = _pairs(on)
    spark = left.sparkSession
    width = max(int(hi_seconds - lo_seconds), 1) * 1_000_000
    lo_us, hi_us = int(lo_seconds) * 1_000_000, int(hi_seconds) * 1_000_000
    kcols = [f"__k{i}" for i in range(len(pairs))]
    others = [c for c in right.columns if c not in [rk for _, rk in pairs]]
    lx = left.select("*", *[F.col(lk).alias(k) for k, (lk, _) in zip(kcols, pairs)],
                     (time_micros(left_time, left) + lo_us).alias("__lo"))
    lx = lx.withColumn("__hi", F.col("__lo") + (hi_us - lo_us))      # the first time beyond the window
    first = F.floor(F.col("__lo") / width)
    lx = lx.withColumn("__bk", F.explode(F.array_distinct(F.array(first, F.floor((F.col("__hi") - 1) / width)))))
    rx = _bucketed(right, pairs, right_time, width).select(*kcols, "__bk", "__tr", *others)
    hot = _find_hot(rx.select(*kcols, "__bk", F.col("__tr").alias("__ht"), F.lit(True).alias("__hr")),
                    [*kcols, "__bk"], share)
    cell = ["__bk"]
    if hot:
        table = F.broadcast(hot.frame(spark, [*kcols, "__bk"], 1).drop("__end"))         # bounded, see HotKeys.frame
        longest = hot.longest
        cuts, shares = F.col("__cuts"), F.col("__shares")
        upto = F.aggregate(shares, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        table = table.withColumn("__upto", upto)                     # cells that the cuts before make
        # a cut's cells begin with the times below it; a time of several cells deals its rows over them
        number = _cell(F.col("__tr"), cuts, longest)
        many = _shared(F.col("__tr"), cuts, shares, number)
        plain = [f.name for f in right.schema.fields if isinstance(f.dataType, AtomicType)]
        rx = rx.join(table, [*kcols, "__bk"], "left").withColumn("__c", F.when(cuts.isNull(), 0).otherwise(
            F.get("__upto", number) + F.when(many > 0, F.pmod(F.xxhash64(*[c for c in plain if c in rx.columns], "__tr"), many))
            .otherwise(0))).drop("__cuts", "__shares", "__upto")
        lx = lx.join(table, [*kcols, "__bk"], "left")
        low, high = _cell(F.col("__lo"), cuts, longest), _cell(F.col("__hi"), cuts, longest)
        reach = F.sequence(F.get("__upto", low).cast("int"), F.get("__upto", high).cast("int"))
        lx = lx.withColumn("__c", F.explode(F.when(cuts.isNull(), F.array(F.lit(0))).otherwise(reach))) \
            .drop("__cuts", "__shares", "__upto")
        rx = rx.withColumn("__c", F.col("__c").cast("int"))
        cell = ["__bk", "__c"]
    hit = (F.col("__tr") >= F.col("__lo")) & (F.col("__tr") < F.col("__hi"))
    out = lx.join(rx, [*kcols, *cell]).where(hit).drop(*kcols, *cell, "__lo", "__hi", "__tr")
    if how == "inner":
        return out
    matched = out.select(row_id, F.struct(*others).alias("__r"))
    return left.join(matched, row_id, "left").select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in others])


def _bucketed(right: DataFrame, pairs: list[tuple[str, str]], right_time: str, width: int) -> DataFrame:
    rx = right.select("*", *[F.col(rk).alias(f"__k{i}") for i, (_, rk) in enumerate(pairs)],
                      time_micros(right_time, right).alias("__tr"))
    return rx.withColumn("__bk", F.floor(F.col("__tr") / width))


def range_agg(left: DataFrame, right: DataFrame, on, bound: Column | str, right_time: Column | str,
              aggs: Mapping[str, tuple[str, Column]], *, inclusive: bool = False,
              hot: HotKeys | None = None, share: int = SHARE) -> DataFrame:
    """Aggregate the right rows of the key up to a bound of the left row; a NULL
    bound is open (every right row of the key). One pass of the prefix engine, so a
    hot key is cut like in any lookup. ``aggs`` is as for ``prefix_agg``."""
    return prefix_agg(left, right, on, bound, right_time, aggs, inclusive=inclusive, open_bound=True,
                      hot=hot, share=share)


def agg_per_key(left: DataFrame, right: DataFrame, on, aggs: Sequence[Column],
                zero: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Pre-aggregate ``right`` by key (map-side combine), then join.
    Count-like columns listed in ``zero`` become 0 where the key has no rows,
    as a lateral aggregate without GROUP BY returns; other aggregates stay NULL."""
    pairs = _pairs(on)
    agg = right.groupBy(*[F.col(rk).alias(lk) for lk, rk in pairs]).agg(*aggs)
    out = left.join(agg, [lk for lk, _ in pairs], how)
    return out.fillna(0, subset=list(zero)) if zero else out


def nth_state(df: DataFrame, key, order: str, state: str, out: str = "prior_state", n: int = 2) -> DataFrame:
    """The state at ``dense_rank() = n`` over ``(order DESC, state DESC)`` per
    key, i.e. the n-th largest distinct (order, state) pair (NULL first in either,
    as PostgreSQL sorts descending). Keys with fewer than n distinct pairs are absent.

    Pairs are made distinct first (map-side combined, dealt by the pair). The rank's
    limit then works in every task before the rows are shuffled by key (Spark's partial
    group limit), so a hot key arrives as n pairs a task, not as its rows."""
    keys = [key] if isinstance(key, str) else list(key)
    pairs = df.select(*keys, F.col(order).alias("__t"), F.col(state).alias("__s")).distinct()
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("__t").desc_nulls_first(), F.col("__s").desc_nulls_first()))
    return pairs.withColumn("__n", rank).where((F.col("__n") <= n) & (F.col("__n") == n)) \
        .select(*keys, F.col("__s").alias(out), F.col("__t").alias(f"{out}_at"))


def row_positions(df: DataFrame, order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """1-based position of every row in a total order, without a global
    window. Rows are range-partitioned and sorted within partitions on the
    order; each row is tagged with its partition id and index, and the tagged
    rows are checkpointed (reliably, into ``spark.checkpoint.dir``) so the
    per-partition counts and the rows read the same tags: two evaluations of
    the sort could otherwise be partitioned differently (adaptive coalescing,
    sampling). A partition's offset is the sum of the counts before it (one
    row per partition); a row's position is its offset plus its index.
    The checkpoint runs when this function is called."""
    from funnelkit.sources.sinks import cut_lineage
    cols = [col_(o) for o in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal order values are dealt by what the rows hold, so they do not share one task
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    spread = [F.xxhash64(*plain)] if plain else []
    tagged = cut_lineage(df.repartitionByRange(parts, *cols, *spread).sortWithinPartitions(*cols, *spread).withColumns({
        "__pid": F.spark_partition_id(), "__mid": F.monotonically_increasing_id()}))
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    inner = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    out = tagged.join(F.broadcast(offsets), "__pid")     # one row per partition
    return out.withColumn(name, F.col("__off") + inner + 1).drop("__pid", "__mid", "__off")
