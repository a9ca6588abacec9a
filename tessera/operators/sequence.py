"""Sequential operators: numbering, batches, runs, folds, rate limits, carry-over between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship


def occurrence_ids(rows: DataFrame, scope: list[str], name: str, order: str) -> DataFrame:
    """Adds qual: the name, with #2, #3 ... from its second occurrence in the scope."""
    n = F.row_number().over(Window.partitionBy(*scope, name).orderBy(order))
    return rows.withColumn("qual", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), n)))


def numbered(rows: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """Adds place, from 0, by a total order: ranges are numbered within, and offset by the sizes of the ranges before (one row a range)."""
    ranged = rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = local.groupBy("_p").agg(F.count("*").alias("c"))
    before = sizes.select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("_o"))  # `parts` rows
    return local.join(F.broadcast(before), "_p").withColumn("place", (F.col("_o") + F.col("_n") - 1).cast("long")).drop("_p", "_n", "_o")


def fixed_batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    return numbered(rows, order).withColumn("batch", F.floor(F.col("place") / size))


def greedy_batches(rows: DataFrame, key: str, order: str, weight: str, most: int, count: int) -> DataFrame:
    """(key, order, batch): within a key and in order, a new batch begins when one more row would take it over `most` in weight or `count` rows. A fold over
    the key's rows, as no frame can say where a batch began; they pass once, in order, and nothing but the open batch is held, so a key with very many rows takes
    time in proportion to them and no memory. A weight that is null takes no part in the comparison until the next batch begins."""
    ship(rows.sparkSession)
    narrow = rows.select(key, F.col(order).cast("long").alias(order), F.col(weight).cast("long").alias("_w"))
    schema = narrow.select(key, order, F.lit(0).cast("long").alias("batch")).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, begun, at, batch, w, n = to_arrow_schema(schema), False, None, 0, 0, 0
        for rows in batches:
            out = []
            for k, x in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if not begun or k != at:
                    begun, at, batch, w, n = True, k, 0, x, 1
                elif n >= count or (w is not None and x is not None and w + x > most):
                    batch, w, n = batch + 1, x, 1
                else:
                    w, n = None if w is None or x is None else w + x, n + 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(arrow.field(0).type), rows.column(1), pa.array(out, pa.int64())], schema=arrow)

    return narrow.repartition(key).sortWithinPartitions(key, order, "_w").mapInArrow(run, schema)


def islands(rows: DataFrame, key: list[str], order: list[str], kind: str) -> DataFrame:
    """Adds island: the number, from 0, of the run of equal kinds in the key."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = (F.lag(kind).over(w) != F.col(kind)) & F.lag(kind).over(w).isNotNull()
    return rows.withColumn("_new", new.cast("long")).withColumn("island", F.coalesce(F.sum("_new").over(w), F.lit(0)).cast("long")).drop("_new")


def accepted(rows: DataFrame, key: str, order: list[str], seconds: str, limit: int, window: int) -> DataFrame:
    """Adds ok: whether a request is accepted when at most `limit` accepted ones of its key are `window` seconds old or less. Rejected ones don't
    count, so it's a fold in order of a key's requests, with the last `limit` accepted times as state."""
    item = F.struct(*(F.col(o) for o in order), F.col(seconds).cast("long").alias("_s"))
    start = F.struct(F.array().cast("array<long>").alias("q"), F.array().cast(f"array<struct<{', '.join(f'{o}:{rows.schema[o].dataType.simpleString()}' for o in order)},ok:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        live = F.filter(acc["q"], lambda t: x["_s"] - t <= window)
        ok = F.size(live) < limit
        return F.struct(F.when(ok, F.concat(live, F.array(x["_s"]))).otherwise(live).alias("q"), F.concat(acc["out"], F.array(F.struct(*(x[o].alias(o) for o in order), ok.alias("ok")))).alias("out"))

    folded = rows.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("xs"))
    return folded.select(key, F.inline(F.aggregate("xs", start, step, lambda a: a["out"])))


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, state): added, changed, same or removed, by a hash of the content."""
    a, b = (t.select(key, F.sha2(F.col(content).cast("string"), 256).alias(n)) for t, n in ((old, "was"), (new, "now")))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def carry_over(new: DataFrame, old: DataFrame, key: str, content: str, note: str) -> DataFrame:
    """(key, note, stale): the old note of each row that is still there; stale where its content moved."""
    was = old.select(key, F.sha2(F.col(content).cast("string"), 256).alias("was"), F.col(note))
    now = new.select(key, F.sha2(F.col(content).cast("string"), 256).alias("now"))
    return now.join(was, key, "left").select(key, note, (F.col(note).isNotNull() & (F.col("was") != F.col("now"))).alias("stale"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: what an append-only table says now."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(o) for o in order)))).where("_n = 1").drop("_n")
