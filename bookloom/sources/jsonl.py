"""JSON-lines replay and recording of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.sources import wire


def read(spark: SparkSession, path: str, strict: bool = False, limit: int = 0) -> DataFrame:
    """Raw snapshots of all lines, blank ones skipped, with `arrival`: their place in the files. Lines that can't be parsed keep parse_error, or fail the job if strict. limit: the first so many rows by arrival."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("arrival")).where(F.trim("value") != "")
    rows = wire.from_record(lines, "value")
    if strict:
        rows = rows.withColumn("parse_error", F.when(F.col("parse_error").isNotNull(), F.raise_error(F.col("parse_error"))))
    return rows.orderBy("arrival").limit(limit) if limit else rows


def write(df: DataFrame, path: str) -> None:
    df.select(wire.to_record().alias("value")).write.mode("append").text(path)
