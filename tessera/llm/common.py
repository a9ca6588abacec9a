"""What the operators share: shared folders, clean-up of spent shuffles."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

__all__ = ["release", "remove", "shared_dir", "ship", "staged", "texts"]

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, on a local master (tests), one of our own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-shared")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tessera/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key long, text string) with null texts as empty; other columns are dropped, so their names can't clash."""
    return df.select(df[key].cast("long").alias(key), F.coalesce(df[text].cast("string"), F.lit("")).alias(text))
