"""The folder that the driver and all executors see, and tables kept there."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session under spark.checkpoint.dir; a local temporary one only where that is unset in a local session."""
    held = getattr(spark.sparkContext, "_cleargrain_folder", None)
    if held is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
            root = "file://" + tempfile.mkdtemp(prefix="cleargrain-")
        held = f"{root.rstrip('/')}/cleargrain-{uuid.uuid4().hex}"
        spark.sparkContext._cleargrain_folder = held
        atexit.register(_remove, spark, held)
    return held


def clear(spark: SparkSession) -> None:
    """Removes all tables kept so far, for sessions that go on; frames made from them can't be read any more."""
    if held := getattr(spark.sparkContext, "_cleargrain_folder", None):
        _remove(spark, held)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 the session may be gone, and its folder with it
        pass


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's as part of the plan; no job and no Python worker is needed to read it."""
    kind = to_arrow_schema(_parse_datatype_string(schema))
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind))


def settled(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there, and its size is known to the planner."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
