"""Decontamination: results don't depend on the number of blocks, and nothing of the benchmark goes on in the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KEY = lambda r: (r[0] is None, r[0] or 0, *map(repr, r[1:]))


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, items, window=13):
    patterns = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            patterns[tuple(w[j : j + m])] |= {item} - {None}
    out = []
    for doc_id, text in rows:
        w, hit, found = words_of(text), set(), set()
        for m in {len(p) for p in patterns}:
            for j in range(len(w) - m + 1):
                if (p := tuple(w[j : j + m])) in patterns:
                    hit |= set(range(j, j + m))
                    found |= patterns[p]
        out.append((doc_id, len(w), len(hit), tuple(sorted(map(str, found)))))
    return sorted(out, key=KEY)


def made(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 2)))
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 5, 12, 13, 14, 40])))) for i in range(60)]
    items += [(70, items[5][1]), (None, "a null item of some fifteen words that no document but one holds in its whole length"), (71, None), (72, " .. "), (None, "zz yy")]
    rows = []
    for i in range(80):
        text = " ".join(word() for _ in range(r.choice([0, 2, 12, 13, 60])))
        for _ in range(r.randint(0, 2)):
            text += r.choice([" ", ". ", "\n"]) + (r.choice(items)[1] or "")
        rows.append((r.choice([i, 7, None]), text.upper() if i % 9 == 0 else text))
    rows += [(3, None), (7, ""), rows[0], rows[0], (200, f"x {items[-5][1]} zz yy {items[1][1]} y")]
    return rows, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 900, 40])
def test_any_number_of_blocks(spark, block_bytes):
    rows, items = made()
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = decontamination.decontaminate(docs, bench, block_bytes=block_bytes).collect()
    want = brute(rows, items)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=KEY) == want
    assert all(r.spans == sorted(r.spans) and all(a < b for a, b in zip(r.spans, r.spans[1:], strict=False)) for r in got)
    kept = decontamination.without_contaminated(docs, bench, block_bytes=block_bytes).collect()
    bad = {(r.doc_id, r.n_words, tuple(r.spans)) for r in got if decontamination.goes(r.n_words, r.spans, 0.05, 8)}
    left = [(r.doc_id, r.text) for r in kept]
    again = decontamination.decontaminate(spark.createDataFrame(left, "doc_id long, text string"), bench).collect()
    assert len(left) == sum((r.doc_id, r.n_words, tuple(r.spans)) not in bad for r in got)
    assert not any(decontamination.goes(r.n_words, r.spans, 0.05, 8) for r in again)


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_rows_are_judged_on_their_own(spark, block_bytes):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    a, b, clean = items[0][1], items[1][1], "nothing of it is here at all"
    rows = [(None, a), (None, clean), (1, a), (1, b), (1, clean), (2, f"{a} {b}"), (2, f"{a} {b}"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.decontaminate(docs, bench, block_bytes=block_bytes).collect()
    one, none = (20, 20, (0, 20)), (7, 0, (), ())
    want = [(None, *one, ("0",)), (None, *none), (1, *one, ("0",)), (1, *one, ("1",)), (1, *none), *[(2, 40, 40, (0, 40), ("0", "1"))] * 2, (3, 0, 0, (), ())]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.spans), tuple(r["items"])) for r in got), key=KEY) == sorted(want, key=KEY)
    kept = decontamination.without_contaminated(docs, bench, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.text or "") for r in kept), key=KEY) == sorted([(None, clean), (1, clean), (3, "")], key=KEY)


def test_a_long_text_of_hits():
    item = " ".join(f"w{i}" for i in range(40))
    s = decontamination.Searcher([("a", item.encode())], 13)
    text = (item + " ") * 20_000
    (n, edges, names), short = s.search([text.encode(), b"w1 w2"])
    assert (n, edges, names) == (800_000, [0, 800_000], ["a"]) and short == (2, [], [])


def test_tables_are_small():
    """A block of 16 MB: measured bytes of what a worker holds."""
    r = np.random.default_rng(1)
    w = [b"word%d" % i for i in range(50_000)]
    items = [(str(k), b" ".join(w[i] for i in r.integers(0, 50_000, 5000))) for k in range(64)]
    size = sum(len(t) for _, t in items)
    s = decontamination.Searcher(items, 13)
    held = len(s.text) + s.starts.nbytes + s.ends.nbytes + sum(x.nbytes for t in s.tables for x in t[1:]) + sum(t[0].table.nbytes for t in s.tables)
    assert held * (16 << 20) / size < 200 << 20


def test_the_pipelines_stage_leaves_no_window(spark, tmp_path):
    """A passage of 16 words in a text of 3,000 goes, as a short item in a long text doesn't."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("bcdfgh") + r.choice("aeiou") for _ in range(3))
    item, short = " ".join(word() for _ in range(40)), "three common words"
    long = [word() for _ in range(3000)]
    rows = [(1, " ".join([*long[:900], *item.split()[7:23], *long[900:]]), 0), (2, " ".join(long), 0), (3, f"{' '.join(long)} {short}", 0), (4, f"{short} and few more words here", 0), (5, None, 0)]
    spark.createDataFrame([(1, item), (2, short)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)["benchmark_decontamination"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), str(tmp_path)).collect()
    assert sorted(x.doc_id for x in got) == [2, 3, 5]
