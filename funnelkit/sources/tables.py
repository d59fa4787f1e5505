"""Scans and scan-side helpers (SRC1-SRC9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """SRC1: one table of a parquet directory (or a catalog table when ``base`` is
    ``None``). Column pruning and filters are pushed into the scan by Catalyst."""
    if base is None:
        return spark.table(name)
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             columns: Sequence[str] | None = None, bad: str | None = None) -> DataFrame:
    """SRC2: CSV with a header and an explicit schema, bound by column name; optional
    projection.

    Columns may stand in any order in the file, and others beside them are not read;
    a column of the schema that the header lacks is an error, and so is a file of the
    path whose header differs from the first one's. Nothing is inferred from the data.
    Values that are not of their column's type are NULL; ``bad`` names a column that
    holds the record as text where there is such a value, or where the record has
    another number of fields than the header (NULL in good records). ``split_bad``
    takes the two apart."""
    header = spark.read.option("header", True).csv(path).columns
    wanted = _schema(schema)
    lost = [f.name for f in wanted.fields if f.name not in header]
    if lost:
        raise ValueError(f"{path} has no column {', '.join(lost)}; its header is {', '.join(header)}")
    record = "__record"
    text = StructType([StructField(c, StringType()) for c in [*header, *([record] if bad else [])]])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False) \
        .option("columnNameOfCorruptRecord", record).csv(path)
    fields = [f for f in wanted.fields if columns is None or f.name in columns]
    value = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in fields}
    out = [value[f.name].alias(f.name) for f in fields]
    if bad:
        wrong = F.lit(False)
        for f in wanted.fields:     # whichever columns are asked for
            c = F.col(f"`{f.name}`")
            wrong = wrong | (c.isNotNull() & c.try_cast(f.dataType).isNull())
        line = F.coalesce(F.col(record), F.concat_ws(",", *[F.coalesce(f"`{c}`", F.lit("")) for c in header]))
        out.append(F.when(F.col(record).isNotNull() | wrong, line).alias(bad))
    df = raw.select(*out)
    return df.select(*columns, *([bad] if bad else [])) if columns else df


def split_bad(df: DataFrame, bad: str) -> tuple[DataFrame, DataFrame]:
    """Good records without the column ``bad`` of ``read_csv``, and the bad ones' text."""
    return df.where(F.col(bad).isNull()).drop(bad), df.where(F.col(bad).isNotNull()).select(bad)


def _schema(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def read_dataset(spark: SparkSession, base: str, name: str, fmt: str = "parquet",
                 schema: StructType | str | None = None) -> DataFrame:
    """SRC3 (re-aimed): one dataset per former workbook sheet."""
    reader = spark.read
    if fmt == "csv":
        if schema is not None:
            return read_csv(spark, f"{base.rstrip('/')}/{name}", schema)
        reader = reader.option("header", True)
    return reader.format(fmt).load(f"{base.rstrip('/')}/{name}")


def rename_at(df: DataFrame, positions: dict[int, str]) -> DataFrame:
    """SRC4: rename columns by 1-based ordinal."""
    cols = df.columns
    return df.withColumnsRenamed({cols[i - 1]: n for i, n in positions.items()})


def serial_to_date(col: Column | str) -> Column:
    """SRC5: spreadsheet day serial (days since 1899-12-30) to date."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_add(F.lit("1899-12-30").cast("date"), c.try_cast("int"))


def maybe_in(df: DataFrame, col: str, values: Sequence | None = None) -> DataFrame:
    """SRC7: apply ``col IN values`` only when a list is given."""
    if values is None:
        return df
    return df.where(F.col(col).isin(list(values)))


def date_series(spark: SparkSession, start: str, end: str, name: str = "d") -> DataFrame:
    """SRC9: one row per calendar day in [start, end] (a calendar: days, not data)."""
    return spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)),
                             F.expr("INTERVAL 1 DAY"))).alias(name))
