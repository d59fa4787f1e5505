"""Composite analytics as functions of DataFrames and explicit
parameters. Each returns a lazy plan; the registered queries bind them to the
driver tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.functions.expr import elapsed_hours, pct_text, time_of_day
from funnelkit.operators.agg import first_by, milestone, rollup_totals

__all__ = ["rollup_distinct_flags", "stage_funnel", "agent_day", "working_days", "latest_utm",
           "conversion_matrix", "attribution_owner", "pacing",
           "recency_flags"]


def rollup_distinct_flags(df: DataFrame, keys: Sequence[str], entity: str,
                          flags: Sequence[str], label: str | None = "Total",
                          total_name: str | None = None, one_row: bool = False) -> DataFrame:
    """``ROLLUP(keys)`` of ``count(DISTINCT entity) FILTER (WHERE flag = 1)`` for
    many 0/1 flags at once, from the finest cells up.

    Rows are first reduced to one per (cell, entity) (``max`` of each flag, combined
    map-side). Entities of a single cell are counted there once, and the levels above are
    sums of cells: what is rolled up is the few cells, not the rows. Only entities that
    stand in several cells are reduced again at each level (grouping sets over their
    rows alone), as a sum of cells would count them twice. The counts are exact.
    ``one_row`` says that every entity is one row of ``df``: then its flags are summed as
    they are. NULL entities count nothing but keep their cell. Without a ``label``
    subtotal keys are NULL.
    """
    keys, number = list(keys), "__total"
    known = F.col(entity).isNotNull()
    gcols = [f"__g_{k}" for k in keys]
    groupings = [F.grouping(k).alias(g) for k, g in zip(keys, gcols)]

    def counted(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.count(entity).alias(number), *[
            F.sum(F.when(known, F.col(f))).cast("long").alias(f) for f in flags])

    def rolled(cells: DataFrame) -> DataFrame:
        return cells.rollup(*keys).agg(*[F.sum(c).alias(c) for c in (number, *flags)], *groupings)

    if one_row:
        out = rolled(counted(df, keys))
    else:
        per = df.groupBy(*keys, entity).agg(*[F.max(F.col(f)).alias(f) for f in flags])
        per = per.withColumn("__cells", F.count(F.lit(1)).over(Window.partitionBy(entity)))   # at most the cells there are
        many = per.where(known & (F.col("__cells") > 1))
        sets = [keys[:i] + [entity] for i in range(len(keys), -1, -1)]
        levels = many.groupingSets(sets, *keys, entity).agg(*[F.max(F.col(f)).alias(f) for f in flags], *groupings)
        both = rolled(counted(per.where(~known | (F.col("__cells") == 1)), keys)) \
            .unionByName(counted(levels, [*keys, *gcols]))
        out = both.groupBy(*keys, *gcols).agg(*[F.sum(c).alias(c) for c in (number, *flags)])
    out = out.withColumns({k: F.when(F.col(g) == 1, F.lit(label).cast("string")).otherwise(F.col(k).cast("string"))
                           for k, g in zip(keys, gcols)})
    return out.select(*keys, *flags, *([F.col(number).alias(total_name)] if total_name else []))


def stage_funnel(profiles: DataFrame, logs: DataFrame, *, user: str, segment: Column,
                 product: Column, stages: Mapping[str, Column],
                 derived: Mapping[str, Column] | None = None,
                 owners: Mapping[str, tuple[Column, Sequence[Column | str], Column]] | None = None,
                 gated: Mapping[str, Column] | None = None,
                 percents: Mapping[str, str] | None = None, label: str = "Total") -> DataFrame:
    """C1 stage funnel with rollup totals and conversion percentages.

    * ``profiles``: one row per profiled entity (``user``), segmented by ``segment``.
    * ``logs``: stage log rows of the entity; ``product`` groups them.
    * ``stages``: flag name -> row predicate, ``bool_or(pred)::int`` per
      (entity, product); ``derived``: flag name -> expression over the
      aggregated flags (e.g. ``A and not B``); ``owners``: name -> (value,
      order, filter) for the first value of a filtered, ordered log.
    * ``gated``: flag name -> predicate over flags/owners (``pass_03 = 1 and
      oic_at_03 = 'System'``).
    * ``percents``: output name -> flag, ``round(flag / profiles * 100, 1) || ' %'``.

    Result: one row per (segment, product) rollup level that has log rows,
    joined to the profile count of its segment level (``'Total'`` labels).
    """
    seg = profiles.select(F.col(user).alias("__u"), segment.alias("segment"))
    prof = rollup_totals(seg, {"segment": "segment"}, [F.count_distinct("__u").alias("profiles")],
                         label=label)
    aggs = [milestone(p).alias(n) for n, p in stages.items()]
    for n, (val, order, where) in (owners or {}).items():
        aggs.append(first_by(val, order, where).alias(n))
    per = logs.groupBy(F.col(user).alias("__u"), product.alias("product")).agg(*aggs) \
        .where(F.col("product").isNotNull())
    if derived:
        per = per.withColumns(derived)
    flags = list(stages) + list(derived or {})
    if gated:
        per = per.withColumns({n: F.when(c, 1).otherwise(0) for n, c in gated.items()})
        flags += list(gated)
    joined = seg.join(per, "__u", "inner")
    funnel = rollup_distinct_flags(joined, ["segment", "product"], "__u", flags, label=label)
    out = prof.join(funnel, "segment", "inner")
    pcts = {name: pct_text(F.col(flag), F.col("profiles")) for name, flag in (percents or {}).items()}
    return out.withColumns(pcts) if pcts else out


def agent_day(calls: DataFrame, *, owner: str, t: str, effective: Column,
              exclude_owner: Column | None = None, full_day_calls: int = 40) -> DataFrame:
    """C6 agent-day attendance: calls, effective calls, first/last call time,
    weekend flag, attendance (0.5 below ``full_day_calls``, else 1) and hours
    between first and last call, per (day, owner)."""
    c = calls if exclude_owner is None else calls.where(~exclude_owner)
    day = F.to_date(F.col(t))
    return c.groupBy(day.alias("call_date"), F.col(owner).alias("oic")).agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.count(F.when(effective, 1)).alias("effective_calls"),
        F.min(time_of_day(t)).alias("first_call_time"),
        F.max(time_of_day(t)).alias("last_call_time"),
        F.max(F.col(t)).alias("__last"), F.min(F.col(t)).alias("__first"),
    ).select(
        "call_date", "oic",
        F.when(F.dayofweek("call_date").isin(1, 7), 1).otherwise(0).alias("is_weekend"),
        "total_calls", "effective_calls", "first_call_time", "last_call_time",
        F.when(F.col("total_calls") < full_day_calls, F.lit(0.5)).otherwise(F.lit(1.0))
        .cast("double").alias("attendance_count"),
        elapsed_hours("__first", "__last", instants=calls.schema[t].dataType.typeName() == "timestamp")
        .cast("double").alias("hours_logged"))


def working_days(days: DataFrame, facts: DataFrame, *, t: str, keep: Column, threshold: int,
                 day_col: str = "d") -> DataFrame:
    """Number of calendar days in ``days`` whose count of ``keep`` rows in
    ``facts`` exceeds ``threshold`` (GROUP BY day HAVING count > threshold)."""
    base = facts.where(keep).groupBy(F.to_date(F.col(t)).alias(day_col)) \
        .agg(F.count(F.lit(1)).alias("total_leads")).where(F.col("total_leads") > threshold)
    j = days.join(base, day_col, "left")
    return j.agg(F.count(F.col("total_leads")).alias("date_past"))


def recency_flags(df: DataFrame, *, user: str, t: str, d0: str, d1: str, d2: str,
                  groups: Mapping[str, Column], more: Sequence[Column] = ()) -> DataFrame:
    """C5 recency buckets per user and row group: any row at/after ``d0``, in
    [d1, d0), in [d2, d1), before ``d2``; ``coalesce(bool_or(...)::int, 0)``. ``more``
    are other aggregates of the user's rows, made in the same pass."""
    tc = F.col(t)
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    windows = {"d0": tc >= lit(d0), "d1": (tc >= lit(d1)) & (tc < lit(d0)),
               "d2": (tc >= lit(d2)) & (tc < lit(d1)), "old": tc < lit(d2)}
    aggs = []
    for g, gp in groups.items():
        for w, wp in windows.items():
            aggs.append(F.coalesce(F.bool_or(gp & wp).cast("int"), F.lit(0)).alias(f"{g}_{w}"))
    return df.groupBy(user).agg(*aggs, *more)


# ---------------------------------------------------------------------------
# C2 cohort conversion matrix

def conversion_matrix(leads: DataFrame, *, user: str, lead: str, profiled: str, applied: str,
                      booked: str, m0: str, m1: str, m2: str, end: str) -> DataFrame:
    """Vintage rows (M0 / M1 / M2 / M2+ by profile date) x month columns x
    {profiled users, applied leads, converted leads}.

    ``leads``: the leads of users who applied in the window, each with its user's
    profile date; ``applied`` is set on applications of the window, ``booked`` on
    converted leads, both where a lead is both. A conversion counts when booked on or
    after the user's profile date and on or before ``end``; that depends on the user
    only, so nothing is joined here. One pass: every lead gives a long row for each
    measure it takes part in (vintage, measure, month, id), those are made distinct
    (map-side combined) and counted into the columns. Output column names carry the
    month parameters (``'<m0> profiled'``).
    """
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    labels = [m0, m1, m2, "M2+"]

    def month_label(c, names):
        c = F.col(c)
        return (F.when(c >= lit(m0), names[0]).when((c >= lit(m1)) & (c < lit(m0)), names[1])
                .when((c >= lit(m2)) & (c < lit(m1)), names[2]).when(c < lit(m2), names[3]))

    def long(measure, month, ident, when):
        return F.when(when, F.struct(F.lit(measure).alias("measure"), month.alias("month"), ident.cast("string").alias("id")))

    is_base, b = F.col(applied).isNotNull(), F.col(booked)
    none = F.lit(None).cast("string")
    cells = F.array(
        long("vintage", none, none, is_base),       # a vintage has a row even if it counts nothing
        long("profiled", month_label(profiled, labels), F.col(user), is_base),
        long("applied", month_label(applied, labels), F.col(lead), is_base),
        long("conversion", month_label(booked, labels), F.col(lead), (b >= F.col(profiled)) & (b <= lit(end))))
    rows = leads.select(month_label(profiled, ["M0", "M1", "M2", "M2+"]).alias("vintage"),
                        F.inline(F.filter(cells, lambda x: x.isNotNull()))).distinct()
    names = [(lb, sfx) for sfx in ("profiled", "applied", "conversion") for lb in labels]
    out = rows.groupBy("vintage").agg(F.count(F.when(F.col("measure") == "vintage", 1)).alias("__base"), *[
        F.count(F.when((F.col("measure") == sfx) & (F.col("month") == lb), F.col("id"))).alias(f"{lb} {sfx}")
        for lb, sfx in names])
    return out.where("__base > 0").drop("__base")


# ---------------------------------------------------------------------------
# C3 source attribution cascade

# The attribution rules, in order (first match wins).
PORTFOLIO_SOURCE = "(^cis-pa|^email|^sms|sms$)"
PORTFOLIO_EXCLUDE = "monitoring"
SMS_CODE = "^(CRM|byssms|chrsms|bhrsms)-(?=.*[0-9].*)(?=.*[A-Z].*)[A-Z0-9]+$"
EMAIL_CODE = "^(CRM|bysemail|chremail|bhremail)-(?=.*[0-9].*)(?=.*[A-Z].*)[A-Z0-9]+$"
CODE_SUFFIX = "-([A-Z0-9]+)$"
APP_CODE = "^(?=.*[0-9].*_)(?=.*[A-Z].*_)[A-Z0-9]+_androidapp"
APP_CODE_PREFIX = "^([A-Z0-9]+)_"


def attribution_owner(source: Column, fallback_owner: Column, default: str = "System") -> Column:
    """Owner from the as-of login source text, else the look-back contact
    owner, else ``default``. Case-insensitive tests, case-sensitive code
    extraction: a lower-case code matches a rule but extracts NULL (kept)."""
    from funnelkit.functions.expr import cmatch, extract_group, imatch, nimatch
    return (F.when(imatch(source, PORTFOLIO_SOURCE) & nimatch(source, PORTFOLIO_EXCLUDE), F.lit("PORTFOLIO"))
            .when(imatch(source, SMS_CODE), extract_group(source, CODE_SUFFIX))
            .when(imatch(source, EMAIL_CODE), extract_group(source, CODE_SUFFIX))
            .when(cmatch(source, APP_CODE), extract_group(source, APP_CODE_PREFIX))
            .when(fallback_owner.isNotNull(), fallback_owner)
            .otherwise(F.lit(default)))


# ---------------------------------------------------------------------------
# C8 plan-versus-actual pacing

def pacing(actuals: DataFrame, plan_long: DataFrame, *, team: str, keys: Sequence[str],
           lead: str, t: str, day: str, days_month: Column, days_past: Column,
           drr_per: str = "elapsed") -> DataFrame:
    """C8 per (team, keys): DTD actual (distinct leads on ``day``), MTD actual
    (rows), MTD estimate, plan, percentages, backlog and daily run rate.

    ``plan_long``: (team, keys..., monthly_plan, dtd_plan). ``days_month`` /
    ``days_past``: per-team columns (a team may run on working days). Only keys
    with a non-zero plan of the team are kept. R's ``round`` is half-to-even.
    The daily run rate divides the remaining plan by the elapsed days, as the
    reference does (``drr_per='elapsed'``), or by the days left (``'left'``).
    """
    from funnelkit.functions.expr import pct_text_ratio
    a = actuals.groupBy(team, *keys).agg(
        F.count_distinct(F.when(F.to_date(F.col(t)) == F.lit(day).cast("date"), F.col(lead)))
        .alias("dtd_actual"),
        F.count(F.lit(1)).alias("mtd_actual"))
    j = a.join(plan_long.where(F.col("monthly_plan") != 0), [team, *keys])
    j = j.withColumns({"__dm": days_month, "__dp": days_past})
    j = j.withColumns({
        "mtd_estimate": F.bround(F.try_divide(F.col("mtd_actual"), F.col("__dp")) * F.col("__dm"), 0)
        .cast("long"),
        "mtd_plan": F.bround(F.try_divide(F.col("monthly_plan"), F.col("__dm")) * F.col("__dp"), 0)
        .cast("long")})
    j = j.withColumns({
        "dtd_pct": pct_text_ratio(F.try_divide(F.col("dtd_actual"), F.col("dtd_plan"))),
        "mtd_pct": pct_text_ratio(F.try_divide(F.col("mtd_actual"), F.col("mtd_plan"))),
        "backlog": F.col("mtd_plan") - F.col("mtd_actual"),
        "drr": F.bround(F.try_divide(F.col("monthly_plan") - F.col("mtd_actual"),
                                     F.col("__dp") if drr_per == "elapsed" else F.col("__dm") - F.col("__dp")), 0)
        .cast("long")})
    return j.select(team, *keys, "dtd_actual", "dtd_plan", "dtd_pct", "mtd_actual", "mtd_plan",
                    "mtd_pct", "mtd_estimate", "monthly_plan", "backlog", "drr")


def latest_utm(df: DataFrame, utm_log: DataFrame, *, user: str, t: str, log_user: str = "user_id",
               log_t: str = "created_at", text: str = "utm_source_text", tiebreak: Sequence[str] = (),
               out: str = "utm_source_text", hot=None) -> DataFrame:
    """U1 ``get_latest_utm(user_id, ts)``: the latest login-source text of the
    user strictly before ``t`` (as-of join on the prefix engine; ``hot`` shares a count
    of the users' rows)."""
    from funnelkit.operators.lookup import asof_join
    log = utm_log.select(F.col(log_user).alias(user), F.col(log_t).alias("__lt"), F.col(text).alias(out),
                         *[F.col(c) for c in tiebreak])
    return asof_join(df, log, user, t, "__lt", [out], strict=True, tiebreak=tiebreak, hot=hot)
