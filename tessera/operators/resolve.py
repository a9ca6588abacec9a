"""Import and call resolution: ranked candidates, unique suffixes, anti joins and cascades with vetoes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (id, rank, path), known (path) -> (id, path): the candidate of least rank that is known."""
    return asked.join(known.select("path").distinct(), "path", "left_semi").groupBy("id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def suffixes(files: DataFrame) -> DataFrame:
    """files (path) -> (path, suffix): all its tails at slashes."""
    parts = F.split("path", "/")
    return files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))


def unique_suffix(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked (id, suffix) -> (id, path) where one file alone ends so. An equi join on unfolded suffixes, not a comparison of all pairs."""
    only = suffixes(files.select("path").distinct()).groupBy("suffix").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    return asked.join(only.select("suffix", "path"), "suffix").select("id", "path")


def members_of(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked (id, folder) -> (id, path): every file right in a folder that ends so (wildcard imports)."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    held = files.select("path", folder.alias("at")).where("at <> path")
    tails = suffixes(held.select(F.col("at").alias("path")).distinct()).select(F.col("path").alias("at"), F.col("suffix").alias("folder"))
    return asked.join(tails, "folder").join(held, "at").select("id", "path").distinct()


def external(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """imports (path, source) that nothing resolves: distinct (path, source)."""
    return imports.join(resolved, ["path", "source"], "left_anti").select("path", "source").distinct()


def cascade(rules: list[DataFrame]) -> DataFrame:
    """Tables (id, rank, target, confidence), target null where a rule vetoes: for each id the rule of least rank decides; vetoed ids go."""
    every = rules[0]
    for r in rules[1:]:
        every = every.unionByName(r)
    best = every.groupBy("id").agg(F.min_by(F.struct("target", "confidence"), F.struct("rank", "target")).alias("best"), F.min("rank").alias("rank"))
    return best.where("best.target IS NOT NULL").select("id", "best.target", "best.confidence", "rank")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row of each key: the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
