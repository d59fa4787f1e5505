"""Write COVERAGE.md: every SURVEY section-2 ID -> implementing function(s),
registered queries (from the registry's ids) and unit tests."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from funnelkit.plans.registry import all_queries  # noqa: E402

IMPL = {
    "SRC1": "sources.tables.load", "SRC2": "sources.tables.read_csv",
    "SRC3": "sources.tables.read_dataset (re-aimed: one dataset per sheet)",
    "SRC4": "sources.tables.rename_at", "SRC5": "sources.tables.serial_to_date",
    "SRC6": "keyword parameters of every report", "SRC7": "sources.tables.maybe_in",
    "SRC8": "plans.reports.conversion_matrix (column names from month parameters)",
    "SRC9": "sources.tables.date_series",
    "SNK1": "sources.sinks.save_cohort", "SNK2": "sources.sinks.load_cohort",
    "SNK3": "sources.sinks.write_csv", "SNK4": "sources.sinks.write_by_team (re-aimed: partitioned output)",
    "P1": "select / withColumns", "P2": "functions.expr.decode_label", "P3": "functions.expr.case_cascade",
    "P4": "functions.expr.flag_when", "P5": "F.coalesce", "P6": "F.lit / withColumn",
    "P7": "withColumnsRenamed / select / drop", "P8": "operators.agg.fill_zero",
    "F1": "functions.expr.half_open", "F2": "functions.expr.day_window", "F3": "literal range",
    "F4": "open-ended comparison", "F5": "functions.expr.text_between", "F6": "isin / ~isin",
    "F7": "functions.expr.imatch + pg_regex", "F8": "functions.expr.nimatch", "F9": "functions.expr.cmatch",
    "F10": "functions.expr.similar_prefix", "F11": "isNull / isNotNull", "F12": "string comparison",
    "F13": "date_sub(run_date, 1) filter", "F14": "where / where(~cond)",
    "F15": "distributed top-n threshold (rows_after_position)",
    "J1": "join inner", "J2": "join left", "J3": "join on several keys + residual",
    "J4": "chained joins to bounded masters", "J5": "multiplicity + aggregated flags (no pairs)",
    "J6": "operators.member.attach_flag", "J7": "operators.lookup.lookup_latest",
    "J8": "operators.lookup.lookup_latest", "J9": "operators.lookup.lookup_latest (order by id)",
    "J10": "operators.lookup.asof_join (prefix_agg engine)", "J11": "operators.lookup.range_agg (open bound) / asof_join",
    "J12": "operators.lookup.lookback_join(pick='last')", "J13": "operators.lookup.lookback_join(pick='first')",
    "J14": "operators.lookup.range_join", "J15": "operators.lookup.range_agg",
    "J16": "operators.lookup.agg_per_key", "J17": "agg_per_key with a group key",
    "J18": "chained asof_join", "J19": "operators.member.semi", "J20": "operators.member.semi",
    "J21": "operators.member.anti", "J22": "operators.member.suppress (null-aware)",
    "J23": "operators.member.anti", "J24": "operators.member.flag_earlier_exists",
    "J25": "derived key column + equi join", "J26": "operators.agg.full_join_all",
    "J27": "operators.agg.bind_cols", "J28": "one inner join on the composite key (plans.reports.pacing)",
    "J29": "join + agg_per_key",
    "A1": "F.count", "A2": "F.count_distinct", "A3": "operators.agg.count_distinct_if / rollup_distinct_flags",
    "A4": "F.min / F.max", "A5": "F.sum(F.when(...))", "A6": "operators.agg.milestone",
    "A7": "operators.agg.milestone_and_not", "A8": "milestone(default=0)", "A9": "F.bool_and / F.bool_or",
    "A10": "operators.agg.progress", "A11": "operators.agg.first_by / last_by",
    "A12": "operators.agg.collect_struct", "A13": "operators.agg.join_strings",
    "A14": "operators.agg.join_distinct", "A15": "operators.agg.answers_map",
    "A16": "operators.agg.disposition_summary", "A17": "groupBy(expr)",
    "A18": "operators.agg.rollup_totals", "A19": "rollup_totals(mark='grouping')",
    "A20": "rollup_totals(mark='null')", "A21": "agg(...).where(...)", "A22": "distinct()",
    "A23": "operators.lookup.first_per", "A24": "operators.agg.with_total_row",
    "A25": "plans.reports.pacing", "A26": "groupBy().count()",
    "W1": "operators.lookup.nth_state", "W2": "operators.lookup.row_positions",
    "O1": "orderBy at the outermost step", "O2": "min_by / max_by top-1", "O3": "deterministic first_per",
    "SET1": "unionByName(allowMissingColumns=True)",
    "STR1": "F.split_part", "STR2": "F.concat", "STR3": "functions.expr.extract_group",
    "STR4": "functions.expr.collapse_newlines", "STR5": "trim(BOTH '{}' FROM x)", "STR6": "cast('string')",
    "STR7": "functions.expr.upper_strings", "STR8": "F.concat_ws", "STR9": "F.substring",
    "STR10": "functions.expr.pct_text_ratio", "STR11": "functions.expr.pct_text",
    "DT1": "F.to_date", "DT2": "functions.expr.time_of_day", "DT3": "date_format 'yyyy-MM'",
    "DT4": "functions.expr.dow_sunday0", "DT5": "functions.expr.elapsed_hours",
    "DT6": "timestamp +/- interval", "DT7": "add_months(run_date, -n)", "DT8": "functions.calendar.*",
    "DT9": "functions.expr.vintage_bucket / month_offset_label / m_bucket",
    "MA1": "F.round (SQL) / F.bround (R)", "MA2": "functions.expr.safe_ratio", "MA3": "native arithmetic",
    "AR1": "explode(split(...))", "AR2": "folded into first_by", "JS1": "F.get_json_object",
    "JS2": "answers_map", "RS1": "DataFrame.unpivot",
    "U1": "plans.reports.latest_utm (asof_join)", "U2": "functions.expr.month_diff",
    "U3": "functions.expr.age_years", "U4": "functions.expr.to_numeric",
    "U5": "functions.expr.pct_text_ratio", "U6": "functions.calendar.days_in_month",
    "C1": "plans.reports.stage_funnel", "C2": "plans.reports.conversion_matrix",
    "C3": "plans.reports.attribution_owner + asof_join + lookback_join", "C4": "semi / suppress / attach_flag",
    "C5": "plans.reports.recency_flags", "C6": "plans.reports.agent_day", "C7": "plans.reports.working_days",
    "C8": "plans.reports.pacing", "C9": "operators.agg.disposition_summary + with_total_row",
    "C10": "points rule (points_score query)", "C11": "holding flags, saleable accounts (holding_flags, payment_holdings)",
    "C12": "journey query", "C13": "range_agg (effort before first application)",
    "C14": "missed-promise flags",
}
TESTS = {
    "SRC2": "test_sources", "SRC3": "test_sources", "SRC4": "test_sources", "SRC5": "test_sources",
    "SRC7": "test_sources", "SRC9": "test_sources", "SNK1": "test_sources", "SNK2": "test_sources",
    "SNK3": "test_sources", "SNK4": "test_sources", "U5": "test_expr", "U3": "test_expr", "U4": "test_expr",
    "J10": "test_lookup, test_skew", "J12": "test_lookup", "J13": "test_lookup", "J14": "test_lookup",
    "J22": "test_member_agg", "J6": "test_member_agg", "J24": "test_member_agg", "W1": "test_lookup",
    "W2": "test_member_agg", "A18": "test_member_agg", "A3": "test_member_agg", "C1": "test_reports",
    "C2": "test_reports", "C3": "test_reports, test_expr", "C8": "test_reports", "F7": "test_expr",
    "F10": "test_expr", "F12": "test_expr", "STR3": "test_expr", "A12": "test_member_agg",
}
GROUPS = [("SRC", 9), ("SNK", 4), ("P", 8), ("F", 15), ("J", 29), ("A", 26), ("W", 2), ("O", 3),
          ("SET", 1), ("STR", 11), ("DT", 9), ("MA", 3), ("AR", 2), ("JS", 2), ("RS", 1), ("U", 6),
          ("C", 14), ("R", 26)]


def main():
    by_id: dict[str, list[str]] = {}
    for name, q in all_queries().items():
        for i in q.ids.split():
            by_id.setdefault(i, []).append(name)
    lines = ["# COVERAGE", "",
             "SURVEY section 2 inventory: implementation, registered queries (each with a DuckDB",
             "oracle; see `__spark_entry__.oracle_sql()`), and dedicated unit tests. Every registered",
             "query is also run by `tests/test_queries.py` (plan shape + oracle at sf0.001).",
             "Generated by `scripts/coverage.py`.", "",
             "| ID | Implementation | Registered queries | Unit tests |", "| --- | --- | --- | --- |"]
    for p, n in GROUPS:
        for k in range(1, n + 1):
            i = f"{p}{k}"
            qs = ", ".join(f"`{x}`" for x in by_id.get(i, [])) or "(unit tests only)"
            impl = IMPL.get(i, "report query" if p == "R" else "")
            lines.append(f"| {i} | {impl} | {qs} | {TESTS.get(i, '')} |")
    with open(os.path.join(ROOT, "COVERAGE.md"), "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
