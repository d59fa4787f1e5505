"""The corpus pipeline: documents in, training sequences out.

Five stages, each one operator of ``funnelkit.llm``: quality rules reject documents and
hosts, line dedup drops boilerplate lines, SimHash near-dedup keeps one document of each
group, the secret scan masks secrets that look live, and packing cuts the rest into
sequences. Every stage reads all that the one before it kept, from Parquet in the shared
folder of ``spark.checkpoint.dir``, so a lost executor costs the tasks of one stage.

Nulls are read as the operators' docstrings say (a null text is empty, a null source a
host and an owner like any other, a null id comes last). Empty and very long texts,
repeated rows and empty tables pass every stage. All stages but the last return the
columns of their input, extra ones included whatever their names: working columns stand
beside a row, never among its columns. A document whose text becomes empty on the way still gives a sequence, its
end id.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.line_dedup import line_dedup
from funnelkit.llm.packing import by_length, pack_power_of_two
from funnelkit.llm.quality import keep_good
from funnelkit.llm.secret_scan import redact
from funnelkit.llm.simhash import keep_one
from funnelkit.session import checkpoint_dir
from funnelkit.sources.tables import load

TABLE = "documents"


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text that a stage has changed (null for a null text)."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that fail the rules go, and so do those of failing hosts."""
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: boilerplate lines of a host leave its documents' texts."""
    return _recounted(line_dedup(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of near-duplicates the document with the smallest id stays."""
    return keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: secrets that look live are masked."""
    return _recounted(redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: sequences of token ids, none of which crosses documents, those of one
    length together."""
    return by_length(pack_power_of_two(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("SimHash near-dedup", near_dedup_stage),
          ("secret scans", secret_stage), ("packing", packing_stage)]

# SimHash needs a 64-bit hash that DuckDB does not have; tests hold the rows against a
# brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last one's rows, as written."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, TABLE)
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
