"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.workspace import settled

__all__ = ["plain", "read_table", "settled", "taken", "training_remainder"]


def training_remainder(column: str, divisor: int):
    """crc32 of the id written as text, modulo the divisor; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


#: Bytes of an Arrow batch between Spark and Python: Spark's own default, and what a session with that default is set to.
BATCH_BYTES, DEFAULT_BATCH_BYTES, SMALL_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def plain(docs: DataFrame) -> DataFrame:
    """The columns as c0, c1, ... by place, so that no name of theirs clashes with another or with an operator's own.

    A session that has Spark's default size of Arrow batches gets a smaller one: several copies of a batch are held at once.
    """
    conf = docs.sparkSession.conf
    if str(conf.get(BATCH_BYTES)).rstrip("b") == str(DEFAULT_BATCH_BYTES):
        conf.set(BATCH_BYTES, str(SMALL_BATCH_BYTES))
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def taken(docs: DataFrame, **names: str) -> DataFrame:
    """Some columns of docs, each under another name."""
    return plain(docs).select(*[F.col(f"c{docs.columns.index(own)}").alias(name) for name, own in names.items()])


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
