"""Mining drops a labelled text only for a near copy of the same label."""

from pyspark.sql import functions as F

from tessera.llm import toxicity


def test_copies_of_both_labels_count(spark, monkeypatch):
    held = []
    monkeypatch.setattr(toxicity, "staged", lambda df, name: held.append({bytes(r.entry): (r.clean, r.toxic) for r in df.collect()}) or df)
    text = "some words that all of these texts have in common here"
    rows = [(i, text, i % 2) for i in range(6)] + [(10 + i, f"{text} and then other{i} words{i} follow{i} in{i} this{i} text{i}", i % 2) for i in range(8)]
    toxicity.mine(spark.createDataFrame(rows, "doc_id long, text string, label int").select("*", F.lit(1).alias("x")))
    assert held[0][b"common"][0] >= 2 and held[0][b"common"][1] >= 2
