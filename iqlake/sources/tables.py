"""Signals read from stored tables, and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def interleaved_blocks(vectors: DataFrame, ports: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vectors of interleaved I and Q as blocks: consecutive ids are the ports of a capture."""
    e = F.col(vec_col)
    half = F.sequence(F.lit(0), (F.size(e) / 2).cast("int") - 1)
    part = lambda k: F.transform(half, lambda i: e[2 * i + k].cast("double"))
    return vectors.where(e.isNotNull() & (F.size(e) >= 2)).select(F.floor(F.col(id_col) / ports).cast("long").alias("capture_id"), F.pmod(F.col(id_col), F.lit(ports)).cast("int").alias("port"), F.lit(0).cast("long").alias("n0"), part(0).alias("re"), part(1).alias("im"))


def chained_blocks(vectors: DataFrame, per_capture: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vectors of interleaved I and Q, ``per_capture`` consecutive ids of which are the blocks of one capture of one port; they have equal lengths."""
    one = interleaved_blocks(vectors, 1, id_col, vec_col)
    at = F.pmod("capture_id", F.lit(per_capture)) * F.size("re")
    return one.select(F.floor(F.col("capture_id") / per_capture).cast("long").alias("capture_id"), "port", at.cast("long").alias("n0"), "re", "im")


def write_results(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "append", batch_rows: int | None = None, chunk_bytes: int | None = None) -> None:
    """Results as zstd Parquet, files of at most ``batch_rows`` rows, in row groups of about ``chunk_bytes``."""
    writer = df.write.mode(mode).option("compression", "zstd")
    for name, value in (("maxRecordsPerFile", batch_rows), ("parquet.block.size", chunk_bytes)):
        writer = writer if value is None else writer.option(name, value)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def with_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Units in the columns' metadata, which Parquet keeps."""
    return df.withMetadataAll(units) if hasattr(df, "withMetadataAll") else df.select(*(F.col(c).alias(c, metadata={"units": units[c]}) if c in units else F.col(c) for c in df.columns))
