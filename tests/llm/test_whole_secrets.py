"""Secrets: long texts full of matches, rows without an id, hexadecimal runs."""

import re
import time

from tessera.llm import secrets


def test_long_texts_full_of_matches(spark):
    """5 MB each: the time grows with the matches."""
    texts = ["password=hunter22 " * 280_000, "é0123456789abcdef0123456789abcdef " * 150_000, "ab cd1 ef " * 500_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    secrets.scan(docs.limit(0)).collect()
    began = time.time()
    got = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert time.time() - began < 60
    assert (len(got[0]), got[0][0].start, tuple(got[0][-1])) == (280_000, 0, (18 * 279_999, 0, 18 * 279_999 + 17, "assign"))
    assert (len(got[1]), got[1][0].start, tuple(got[1][-1])) == (150_000, 1, (34 * 149_999 + 1, 2, 34 * 149_999 + 33, "hex"))
    assert got[2] == []


def test_rows_without_an_id(spark):
    rows = [(None, "token: abcdef123"), (None, "clean"), (None, None), (5, "token: abcdef123"), (5, "AKIA" + "B" * 16), (5, "")]
    got = [(r.doc_id, tuple(tuple(s) for s in r.spans)) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    one, two = ((0, 0, 16, "assign"),), ((0, 1, 20, "access"),)
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, one), (None, ()), (None, ()), (5, one), (5, two), (5, ())]))


def test_hexadecimal_runs_are_the_long_ones():
    """The rule's expression and the contract's give the same spans."""
    import random

    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["0123456789abcdef" * r.randint(0, 3), "g", " ", "F", "abc", "a" * 23, "b" * 24]) for _ in range(12))
        want = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        assert [m.span() for m in re.finditer(secrets.RULES[2].tail, text)] == want
