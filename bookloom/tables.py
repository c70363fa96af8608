"""Tables in the folder that driver and executors share: they cut long plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir. Where none is set: under a temporary folder in local mode, as in tests, and an error on a cluster."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/bookloom-shared"
    return f"{base.rstrip('/')}/bookloom-engine/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to a new folder and reads it back."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where rows are many.
TASK_ROWS = 65_536


def tasks(df: DataFrame) -> int:
    """How many tasks to deal df to, for any size of it: the session's number, or more. df is counted, so it should be a table, or little more."""
    return dealt_to(df.sparkSession, df.count())


def dealt_to(spark: SparkSession, rows: int) -> int:
    """How many tasks so many rows are dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
