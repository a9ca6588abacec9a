"""Every registered query over the driver's tables, with its SQL oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import changing, graphs, reports, searching, shaping

FAMILIES = (searching, graphs, shaping, reports, changing)
QUERIES: dict = {k: v for family in FAMILIES for k, v in family.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for family in FAMILIES for k, v in family.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for a question, by raw TF-IDF."""
    return searching.tfidf_search_v0(spark, sf_dir)
