"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every report relies on. AQE re-plans at runtime: it coalesces small
# shuffle partitions, splits skewed join partitions, and turns a sort-merge join
# into a broadcast join only when the *measured* shuffle output of one side is
# below spark.sql.adaptive.autoBroadcastJoinThreshold (a checked size, with the
# sort-merge plan as the fallback beyond it).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, cpus: int | None = None,
                  shuffle_partitions: int | None = None, app: str = "funnelkit",
                  extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the data (about 128-256 MB of shuffle per task).
    """
    builder = SparkSession.builder.appName(app)
    if master is None and cpus is not None:
        master = f"local[{cpus}]"
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (``df.checkpoint()`` / written tables).

    The cluster names it in ``spark.checkpoint.dir``; it is read from the session. A
    session that runs in one process (``local`` masters: tests, the bench) and names
    none takes a folder of its warehouse; on a cluster that is an error, as nothing
    guessed there is sure to be shared.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current
