"""Column-expression helpers. All are built-in Spark expressions (codegen'd,
JVM-side); none is a Python UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_", "pg_regex", "imatch", "nimatch", "cmatch", "extract_group", "similar_prefix",
    "decode_label", "case_cascade", "flag_when", "month_diff", "vintage_bucket",
    "month_offset_label", "m_bucket", "pct_text", "pct_text_ratio", "safe_ratio",
    "age_years", "to_numeric", "time_of_day", "dow_sunday0", "elapsed_hours",
    "half_open", "day_window", "text_between", "upper_strings", "collapse_newlines",
]


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pg_regex(pattern: str, ignore_case: bool = False) -> str:
    """Translate a PostgreSQL ARE pattern to Java regex semantics.

    PostgreSQL lets ``.`` match a newline and ``$`` match only at the very end
    of the text; Java needs DOTALL for the first and ``\\z`` for the second.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        if ch == "$" and not in_class:
            out.append("\\z")
        else:
            out.append(ch)
        i += 1
    flags = "(?s" + ("i" if ignore_case else "") + ")"
    return flags + "".join(out)


def imatch(c: Column | str, pattern: str) -> Column:
    """``c ~* pattern``: unanchored, case-insensitive. NULL in, NULL out."""
    return col_(c).rlike(pg_regex(pattern, ignore_case=True))


def nimatch(c: Column | str, pattern: str) -> Column:
    """``c !~* pattern``. A NULL input stays NULL, so a filter drops the row."""
    return ~imatch(c, pattern)


def cmatch(c: Column | str, pattern: str) -> Column:
    """``c ~ pattern``: case-sensitive (look-ahead allowed)."""
    return col_(c).rlike(pg_regex(pattern))


def extract_group(c: Column | str, pattern: str, group: int = 1) -> Column:
    """``substring(c from pattern)``: the first group, NULL when nothing matches."""
    return F.nullif(F.regexp_extract(col_(c), pg_regex(pattern), group), F.lit(""))


def similar_prefix(c: Column | str, prefixes: Sequence[str]) -> Column:
    """``c SIMILAR TO '(p1|p2|...)%'``: whole-string match of a prefix list."""
    alts = "|".join(prefixes)
    return col_(c).rlike(f"(?s)^(?:{alts}).*\\z")


def decode_label(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Code-to-label CASE; unknown codes give ``default`` (NULL or e.g. 'NH')."""
    expr = None
    for code, label in mapping.items():
        cond = col_(c) == F.lit(code)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def case_cascade(branches: Sequence[tuple[Column, Column | object]], default=None) -> Column:
    """Searched CASE: first true condition wins."""
    expr = None
    for cond, val in branches:
        v = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    if default is None:
        return expr
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def flag_when(cond: Column, value=1) -> Column:
    """Sparse flag: ``value`` when true, NULL otherwise."""
    return F.when(cond, F.lit(value))


def month_diff(a: Column | str, b: Column | str) -> Column:
    """Calendar-month difference b - a (0 = same month)."""
    a, b = col_(a), col_(b)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def vintage_bucket(d: Column | str, prev_month_start: str, end: str,
                   prev5_month_start: str) -> Column:
    """V0 / V1 / V2 by date range, else ``yyyy-MM`` of the date (NULL stays NULL)."""
    d = col_(d)
    return case_cascade([
        ((d >= F.lit(prev_month_start)) & (d < F.lit(end)), "V0"),
        ((d >= F.lit(prev5_month_start)) & (d < F.lit(prev_month_start)), "V1"),
        (d < F.lit(prev5_month_start), "V2"),
    ], F.date_format(d, "yyyy-MM"))


def month_offset_label(n: Column, cap: int = 6) -> Column:
    """``'M-' || n`` up to ``cap``; ``'M-6 >'`` above it or when n is NULL."""
    return F.when(n <= cap, F.concat(F.lit("M-"), n.cast("string"))) \
        .otherwise(F.lit(f"M-{cap} >"))


def m_bucket(n: Column, top: int = 2, null_stays: bool = False) -> Column:
    """``'M' || n`` for n below ``top``, else ``'M{top-1}+'``, for a NULL n too
    (``null_stays`` leaves that NULL)."""
    low, high = F.concat(F.lit("M"), n.cast("string")), F.lit(f"M{top - 1}+")
    return F.when(n < top, low).when(n >= top, high) if null_stays else F.when(n < top, low).otherwise(high)


def safe_ratio(num: Column, den: Column, scale: int = 100) -> Column:
    """``num / nullif(den, 0) * scale`` in exact decimal arithmetic."""
    return num.cast("decimal(20,0)") / F.nullif(den, F.lit(0)).cast("decimal(20,0)") * scale


def pct_text(num: Column, den: Column, digits: int = 1, sep: str = " %") -> Column:
    """``round(num / nullif(den,0)::numeric * 100, 1) || ' %'`` (NULL when den is 0)."""
    return F.concat(F.round(safe_ratio(num, den), digits).cast("string"), F.lit(sep))


def pct_text_ratio(x: Column, digits: int = 2) -> Column:
    """Percent text of a ratio with two decimals: 0.1234 -> ``'12.34%'``."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f%%", (x * 100).cast("double")))


def age_years(dob: Column | str, as_of: Column | str) -> Column:
    """Completed years between dob and the run date (a 29 February birthday
    completes a year on 1 March in non-leap years)."""
    a = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of.cast("date")
    b = col_(dob).cast("date")
    before = (F.month(a) < F.month(b)) | ((F.month(a) == F.month(b)) & (F.dayofmonth(a) < F.dayofmonth(b)))
    return (F.year(a) - F.year(b) - F.when(before, 1).otherwise(0)).cast("int")


def to_numeric(c: Column | str, precision: int = 18, scale: int = 2) -> Column:
    """Number or NULL on bad text."""
    return col_(c).try_cast(f"decimal({precision},{scale})")


def time_of_day(ts: Column | str) -> Column:
    """``ts::time`` as sortable ``HH:mm:ss`` text."""
    return F.date_format(col_(ts), "HH:mm:ss")


def dow_sunday0(d: Column | str) -> Column:
    """``extract(dow)``: Sunday = 0 ... Saturday = 6."""
    return F.dayofweek(col_(d)) - 1


def elapsed_hours(start: Column | str, end: Column | str, digits: int = 2, instants: bool = False) -> Column:
    """(end - start) in hours between wall-clock values, rounded (as PostgreSQL
    ``age`` of timestamps without time zone), or between ``instants``."""
    from funnelkit.operators.lookup import wall_micros
    micros = (lambda c: F.unix_micros(col_(c))) if instants else wall_micros
    us = micros(end) - micros(start)
    return F.round(us.cast("decimal(20,0)") / F.lit(3600 * 1000000), digits)


def half_open(c: Column | str, start: str, end: str) -> Column:
    """``c >= start and c < end`` (pushes into the parquet scan)."""
    return (col_(c) >= F.lit(start).cast("timestamp_ntz")) & (col_(c) < F.lit(end).cast("timestamp_ntz"))


def day_window(c: Column | str, first_day: str, last_day: str) -> Column:
    """``date(c) between first_day and last_day`` as a sargable half-open range."""
    return (col_(c) >= F.lit(first_day).cast("timestamp_ntz")) & \
        (col_(c) < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz"))


def text_between(c: Column | str, lo: str, hi: str, negate: bool = False) -> Column:
    """lexicographic BETWEEN on text codes (NULL stays NULL)."""
    cond = col_(c).between(F.lit(lo), F.lit(hi))
    return ~cond if negate else cond


def upper_strings(df, cols: Sequence[str] | None = None):
    """STR7: upper-case every string column (or the listed ones)."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({n: F.upper(F.col(n)) for n in names})


def collapse_newlines(c: Column | str) -> Column:
    """STR4: ``regexp_replace(c, '[\\n\\r]+', ' ', 'g')``."""
    return F.regexp_replace(col_(c), "[\\n\\r]+", " ")
