"""Sinks (SNK1-SNK4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_cohort(df: DataFrame, name: str, mode: str = "errorifexists",
                path: str | None = None) -> None:
    """SNK1: create-table-as-select. Writing the table also cuts lineage."""
    w = df.write.mode(mode).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def load_cohort(spark: SparkSession, name: str) -> DataFrame:
    """SNK2: read back a saved cohort."""
    return spark.table(name)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK3: summary as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_by_team(df: DataFrame, path: str, team_col: str = "attribution",
                  fmt: str = "csv", mode: str = "overwrite") -> None:
    """SNK4 (re-aimed from one sheet block per team): one output folder per team.

    Rows are rebalanced by team first: adaptive execution gives a small team one task,
    and so one file, and splits a large one into tasks of about the advisory partition
    size. Without it every task would write a file for every team it meets."""
    w = df.hint("rebalance", team_col).write.mode(mode).partitionBy(team_col)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder named by ``spark.checkpoint.dir``
    (read from the session; see ``funnelkit.session.checkpoint_dir``). Survives
    executor loss, unlike a local checkpoint."""
    from funnelkit.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
