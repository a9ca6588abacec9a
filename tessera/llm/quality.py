"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditional expressions.

Features come from native expressions over whole texts. Learning: labelled rows (at most `max_rows`, those whose hashed id is least) are
that the base rule doesn't reject are binned at quantiles of either label and counted by cell and label; the covering loop works on those counts alone. It grows a conjunction of
thresholds for low quality by information gain, prunes it on counts held back, keeps it while it's precise enough, and goes on with what no rule covers.

Defined results: null and empty texts have no words, so they fail the base rule; without labels (or of one kind only) no rule is
learned and the base rule decides; equal rows get equal results; columns other than doc_id and text (doc_id and quality in labels) are ignored.
Windows of three words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import staged, texts

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: the features that rules test, by expression over features()
RATIOS = {
    "n_words": "cast(n_words AS double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digits_share": "n_digits / greatest(word_chars, 1)",
}


def _count(chars: str, text: str = "text") -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(documents: DataFrame) -> DataFrame:
    """For each document: doc_id and counts (long) over its whole text."""
    docs = texts(documents)
    docs = docs.withColumn("words", F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), ""))
    docs = docs.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES + " ", "") != ""))
    docs = docs.withColumn("grams", F.when(F.size("words") >= 3, F.slice(F.transform("words", lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2))), F.lit(1), F.size("words") - 2)).otherwise(F.array().cast("array<long>")))
    docs = docs.withColumn("n_distinct_grams", F.size(F.array_distinct("grams")))
    # positions of windows found twice: neighbours in order of (hash, position) that have equal hashes
    placed = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    docs = docs.withColumn("placed", F.when(F.col("n_distinct_grams") < F.size("grams"), placed))
    again = F.filter("placed", lambda x, i: (x["g"] == F.get("placed", i + 1)["g"]) | ((i > 0) & (x["g"] == F.get("placed", F.greatest(i - 1, F.lit(0)))["g"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate("text", SPACES + " ", "")),
        "n_symbols": _count(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.col("placed").isNotNull(), covered).otherwise(0),
        "n_lines": F.size("lines"),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_upper": _count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": _count("!?"),
        "n_digits": _count("0123456789"),
    }
    return docs.select("doc_id", *(c.cast("long").alias(k) for k, c in counts.items()))


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({RATIOS[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _totals(cells: list, rule: list, split: int) -> tuple[int, int]:
    bad = good = 0
    for bins, label, part, count in cells:
        if part == split and all((bins[f] > b) if above else (bins[f] <= b) for f, above, b in rule):
            bad, good = (bad + count, good) if label == 0 else (bad, good + count)
    return bad, good


def cover(cells: list, names: list[str], edges: dict[str, list[float]], precision: float, support: int, most_rules: int) -> list[list[Condition]]:
    """Sequential covering over counted cells (bins by feature, label, part, count); part 1 is held back for pruning."""
    out = []
    while len(out) < most_rules:
        rule: list = []
        while len(rule) < 4:
            p0, n0 = _totals(cells, rule, 0)
            if p0 < support or n0 == 0:
                break
            inside = [c for c in cells if c[2] == 0 and all((c[0][f] > b) if above else (c[0][f] <= b) for f, above, b in rule)]
            best = (1e-9, None)
            for f, name in enumerate(names):
                at: dict[int, list[int]] = {}
                for bins, label, _, count in inside:
                    at.setdefault(bins[f], [0, 0])[label] += count
                low_p = low_n = 0
                for b in range(len(edges[name])):
                    x = at.get(b, [0, 0])
                    low_p, low_n = low_p + x[0], low_n + x[1]
                    for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                        if p >= support:
                            best = max(best, (_gain(p, n, p0, n0), (f, above, b)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break

        def worth(r):
            p, n = _totals(cells, r, 1)
            return (p + 1) / (p + n + 2)

        pruned = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        bad, good = (sum(x) for x in zip(_totals(cells, pruned, 0), _totals(cells, pruned, 1), strict=True))
        if bad < support or bad < precision * (bad + good) or worth(pruned) < precision - 0.05:
            break
        out.append([Condition(names[f], above, edges[names[f]][b]) for f, above, b in pruned])
        cells = [c for c in cells if not all((c[0][f] > b) if above else (c[0][f] <= b) for f, above, b in pruned)]
    return out


def learn(counted: DataFrame, labels: DataFrame, max_rows: int = 20_000, bins: int = 24, precision: float = 0.95, support: int = 8, most_rules: int = 24) -> list[list[Condition]]:
    """The decision list for low quality: conjunctions in order. counted: what features() returns."""
    names = list(RATIOS)
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label")).where("label IN (0, 1)").dropDuplicates(["doc_id"])
    rated = counted.select("doc_id", *(F.expr(e).alias(n) for n, e in RATIOS.items())).join(marked, "doc_id")
    rated = staged(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "rated")
    # quantiles of either kind, as the rare kind has few of all
    cuts = rated.groupBy("label").agg(*(F.percentile_approx(n, [i / bins for i in range(bins + 1)], 10_000).alias(n) for n in names)).collect()  # two rows
    edges = {n: sorted({float(x) for r in cuts for x in r[n] or ()}) for n in names}
    if not any(edges.values()):
        return []
    binned = [F.expr(f"size(filter(array({', '.join(f'{e!r}D' for e in edges[n])}), e -> {n} > e))" if edges[n] else "0").alias(n) for n in names]
    part = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("part")
    cells = rated.select(*binned, "label", part).groupBy(*names, "label", "part").count().orderBy(*names, "label", "part").collect()  # max_rows at most
    return cover([(tuple(r[n] for n in names), r["label"], r["part"], r["count"]) for r in cells], names, edges, precision, support, most_rules)


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(F.expr(" AND ".join(c.sql() for c in rule)), F.lit(k)).otherwise(out)
    return out


def assess(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """features() with base_failed, rule (the learned rule that rejects, or null) and kept."""
    counted = staged(features(documents), "features")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rules = learn(counted.where(~failed), labels, **settings)  # what the base rejects needs no rule
    return counted.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document."""
    found = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
