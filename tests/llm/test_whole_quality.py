"""Quality: the learned list, applied by plain Python, gives the query's verdicts, and finds low quality in rows it hasn't seen."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.common import staged

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
RATIOS = {
    "n_words": lambda r: float(r.n_words), "mean_word": lambda r: r.word_chars / max(r.n_words, 1), "symbols_per_word": lambda r: r.n_symbols / max(r.n_words, 1), "dup_lines_share": lambda r: r.n_dup_lines / max(r.n_lines, 1),
    "repeat_share": lambda r: r.n_repeat_words / max(r.n_words, 1), "distinct_share": lambda r: r.n_distinct / max(r.n_words, 1), "upper_share": lambda r: r.n_upper / max(r.word_chars, 1), "marks_per_word": lambda r: r.n_marks / max(r.n_words, 1),
    "digits_share": lambda r: r.n_digits / max(r.word_chars, 1),
}


@pytest.fixture(scope="module")
def assessed(spark):
    """What is assessed with a third of the labels held back, the rules, and the labels held back."""
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    back = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    counted = staged(quality.features(documents), "counted").where("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words")
    rules = quality.learn(counted, labels.where(~back))
    rows = quality.assess(documents, labels.where(~back)).collect()
    return rows, rules, {r.doc_id: r.quality for r in labels.where(back).collect()}


def test_the_list_in_plain_python(assessed):
    rows, rules, _ = assessed
    assert rules
    for r in rows:
        holds = [all((RATIOS[c.feature](r) > c.threshold) == c.above for c in rule) for rule in rules]
        assert r.rule == (holds.index(True) + 1 if any(holds) else None)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule is None)


def test_labels_held_back(assessed):
    rows, _, held = assessed
    judged = [(r.kept, held[r.doc_id]) for r in rows if r.doc_id in held and not r.base_failed]
    dropped = [q for kept, q in judged if not kept]
    low = [kept for kept, q in judged if q == 0]
    precision, recall = dropped.count(0) / len(dropped), low.count(False) / len(low)
    print(f"of {len(judged)} rows held back: precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.85 and recall > 0.85
