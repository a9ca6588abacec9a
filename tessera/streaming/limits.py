"""Streams: accepted requests per key, daily counts, tables kept up to date by content hash."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sequence import latest
from tessera.session import ship


def accepted_stream(requests: DataFrame, limit: int, window: int) -> DataFrame:
    """requests (key string, s long, id long) -> the same with ok. The state of a key is the times of its last accepted requests, `limit` at most; it goes
    when a key is silent for two windows. Requests of one batch are taken in order of (s, id)."""
    ship(requests.sparkSession)

    def step(key, batches, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["s", "id"])
        ok = []
        for s in rows["s"]:
            held = [t for t in held if s - t <= window]
            ok.append(len(held) < limit)
            if ok[-1]:
                held.append(int(s))
        state.update((held,))
        state.setTimeoutDuration(2 * window * 1000)
        yield rows.assign(ok=ok)[["key", "s", "id", "ok"]]

    return requests.groupBy("key").applyInPandasWithState(step, "key string, s long, id long, ok boolean", "times array<long>", "append", "ProcessingTimeTimeout")


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """events (ts timestamp, provider) -> (day, provider, n) in windows of a UTC day, late rows up to `delay`."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "provider").agg(F.count("*").alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "provider", "n")


def upsert(folder: str, key: str, content: str, order: str | None = None):
    """For foreachBatch: a table at `folder`/<batch> that holds the newest row of each key, by `order` (without it, of the greatest content); rows whose content hash is known are left out of the work.

    Each batch writes a folder of its own, so a batch that is run again writes the same folder and readers of earlier ones aren't disturbed. It goes on from the
    last batch before it that is complete, whatever its number.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch.withColumn("hash", F.sha2(F.col(content).cast("string"), 256)), [key], [order or content])
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath() for f in files.listStatus(root)] if files.exists(root) else []
        done = [int(p.getName()) for p in names if p.getName().isdigit() and int(p.getName()) < number and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        out = new
        if done:
            old = spark.read.parquet(f"{folder}/{max(done)}")
            changed = new.join(old.select(key, "hash"), [key, "hash"], "left_anti")
            out = old.join(changed.select(key), key, "left_anti").unionByName(changed)
        out.write.mode("overwrite").parquet(f"{folder}/{number}")

    return run
