"""Session settings and the helpers every operator shares."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", cpus: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of a table: it's written once, as Parquet, in spark.checkpoint.dir (where unset, on a local master as in tests, in a folder of its own) and read
    back. Spark then knows its size, so a small one is broadcast, and reads only the columns that are asked for."""
    spark = df.sparkSession
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-cp"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables from cut() that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/tessera/" in folder:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def read_mb(df: DataFrame) -> float:
    """MB of the files that a plan reads, a file once for each scan of it; what has no files or no known size counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (float(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s for s in sizes if s < 2**60) / 1e6


def dealt(df: DataFrame, *keys: str, mb: float = 4) -> DataFrame:
    """Rows by the keys' hash over so many tasks that each has about `mb` MB of the files read (a few hundred thousand narrow rows), so that a task's memory doesn't grow
    with the input: joined on a scan of few splits, or coalesced to the number of cores, tasks would."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(read_mb(df) / mb)), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores before costly expressions, where the scan has fewer splits than that (a file of one row group is one task), by the keys' hash if given. A large
    table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the Python workers, once for each application, so that a cluster without the repository
    installed can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import tempfile
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
