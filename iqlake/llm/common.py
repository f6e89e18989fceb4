"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one a local master takes a local folder; a cluster raises, as its executors couldn't read it."""
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="iqlake-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends at replicated files, so a lost executor costs no recomputation of what stands before, and a join of
    two such tables exchanges both sides, which lets adaptive execution split skewed keys.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote, once no later read needs them."""
    spark = df.sparkSession
    root = shared_dir(spark) + "/tables/"
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        if "/tables/" in folder and folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def id_crc(col: Column | str) -> Column:
    """crc32 of an id written as decimal text; the split of held-out rows uses it."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
