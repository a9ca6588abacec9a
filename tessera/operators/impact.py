"""What a change touches: definitions and files changed, what still calls what is gone, who imports and uses files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import file_of


def touched(lines: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """lines (path, line), spans (path, id, first, last) -> (path, id, first, last): spans that hold a line, without those that hold another such span.

    Lines meet spans by buckets of `width` lines; of two spans of a file that are both hit, the outer one goes. What holds another is found over the hit spans' own
    first lines, by buckets again, so no pair of all spans of a file is made.
    """
    bucketed = spans.select("path", "id", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("bucket"))
    at = lines.select("path", "line", F.floor(F.col("line") / width).alias("bucket")).distinct()
    hit = bucketed.join(at, ["path", "bucket"]).where("line BETWEEN first AND last").select("path", "id", "first", "last").distinct()
    outer = hit.select("path", F.col("id").alias("outer_id"), F.col("first").alias("low"), F.col("last").alias("high"), F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("bucket"))
    inner = hit.withColumn("bucket", F.floor(F.col("first") / width))
    holds = (F.col("first") >= F.col("low")) & (F.col("last") <= F.col("high")) & (F.col("id") != F.col("outer_id")) & ((F.col("first") > F.col("low")) | (F.col("last") < F.col("high")))
    around = inner.join(outer, ["path", "bucket"]).where(holds).select("path", F.col("outer_id").alias("id")).distinct()
    return hit.join(around, ["path", "id"], "left_anti")


def changed_definitions(lines: DataFrame, spans: DataFrame, old: DataFrame) -> DataFrame:
    """lines (path, line, added boolean; else a place where lines were taken out), spans, old (path, qual) -> (id, status, signature_changed). A definition that was
    there before is modified, and its signature changed if its first line was added."""
    hit = touched(lines.select("path", "line"), spans)
    first = lines.where("added").select("path", F.col("line").alias("first"), F.lit(True).alias("on_first")).distinct()
    was = old.select("path", "qual", F.lit(True).alias("was")).distinct()
    known = hit.withColumn("qual", F.element_at(F.split("id", "::"), 2)).join(first, ["path", "first"], "left").join(was, ["path", "qual"], "left")
    status = F.when(F.col("was").isNull(), "added").otherwise("modified")
    return known.select("id", status.alias("status"), (F.col("was").isNotNull() & F.col("on_first").isNotNull()).alias("signature_changed"))


def file_level(lines: DataFrame, spans: DataFrame, silent: DataFrame, width: int = 64) -> DataFrame:
    """(path): files with a line added, or taken out, that no definition holds and that is no comment or blank (silent: path, line)."""
    bucketed = spans.select("path", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("bucket"))
    at = lines.select("path", "line").distinct().join(silent.select("path", "line"), ["path", "line"], "left_anti").withColumn("bucket", F.floor(F.col("line") / width))
    inside = at.join(bucketed, ["path", "bucket"]).where("line BETWEEN first AND last").select("path", "line").distinct()
    return at.join(inside, ["path", "line"], "left_anti").select("path").distinct()


def importers(edges: DataFrame, files: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, imports, line): files, no tests (path), that import one of the files (path)."""
    e = edges.where("type = 'imports'").select(F.col("source").alias("path"), F.col("target").alias("imports"), "line")
    return e.join(files.select(F.col("path").alias("imports")).distinct(), "imports", "left_semi").join(tests.select("path"), "path", "left_anti").select("path", "imports", "line")


def still_called(removed: DataFrame, calls: DataFrame, most: int = 20) -> DataFrame:
    """removed (name, qual), calls (path, line, caller, name) -> (qual, path, line, caller): the first calls by the bare name of what is gone."""
    return calls.join(removed.select("name", "qual"), "name").select("qual", "path", "line", "caller").orderBy("path", "line", "caller", "qual").limit(most)


def uses(links: DataFrame) -> DataFrame:
    """links (source, target) -> (path, uses, used_by): sorted files."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("path"), F.col("target").alias("u"), F.lit(None).cast("string").alias("b")), F.struct(F.col("target").alias("path"), F.lit(None).cast("string").alias("u"), F.col("source").alias("b"))))
    return links.select(ends.alias("e")).groupBy(F.col("e.path").alias("path")).agg(F.sort_array(F.collect_set("e.u")).alias("uses"), F.sort_array(F.collect_set("e.b")).alias("used_by"))


def names_list(paths, most: int = 12):
    """A column of paths as base names in order: `most` of them, then how many more; none if there are none."""
    names = F.sort_array(F.transform(paths, lambda p: F.substring_index(p, "/", -1)))
    shown = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) == 0, F.lit("none")).when(F.size(names) > most, F.concat(shown, F.lit(" (+"), F.size(names) - most, F.lit(" more)"))).otherwise(shown)


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are among the ids (id)."""
    own = ids.select("id").distinct()
    return edges.join(own.withColumnRenamed("id", "source"), "source", "left_semi").join(own.withColumnRenamed("id", "target"), "target", "left_semi")


def totals(changes: DataFrame) -> DataFrame:
    """changes (path, added, removed) -> one row: files, added, removed."""
    return changes.agg(F.countDistinct("path").alias("files"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))


def files_of(edges: DataFrame) -> DataFrame:
    """(path): distinct files of the edges' ends."""
    return edges.select(F.explode(F.array(file_of(F.col("source")), file_of(F.col("target")))).alias("path")).distinct()
