"""The label model recovers what made the votes; voters see whole texts."""

import math
import random
from collections import Counter

from tessera.llm import toxicity


def test_shouting_is_of_the_whole_text():
    entries = toxicity.Entries.of([])
    shouting = toxicity.VOTERS.index("shouting")
    late, early = b"quiet " * 400 + b"YOU IDIOT " * 600, b"YOU IDIOT " * 200 + b"quiet " * 4000
    for text, vote in ((late, 1), (early, 0)):
        x = toxicity.look(text, entries, voters=True)
        assert x.shouts == sum(65 <= b <= 90 for b in text) / (len(text) - text.count(b" "))
        assert toxicity.votes(x, entries, None)[shouting] == vote


def test_the_label_model_recovers_accuracies_and_a_correlated_pair():
    r = random.Random(11)
    says = [(0.8, 0.05), (0.6, 0.1), (0.7, 0.02), (0.5, 0.15)]  # how often each voter says toxic of toxic and of clean texts
    counted = Counter()
    for _ in range(20_000):
        toxic = r.random() < 0.2
        own = [int(r.random() < p[not toxic]) for p in says]
        pair = int(r.random() < (0.4 if toxic else 0.1))
        other = pair if r.random() < 0.9 else 1 - pair
        given = 0 if r.random() < 0.7 else (1 if toxic != (r.random() < 0.05) else -1)
        counted[(*own, pair, other, given)] += 1
    model = toxicity.LabelModel(counted)
    assert (4, 5) in model.groups and all(len(g) == 1 for g in model.groups if 4 not in g)
    assert abs(model.prior[1] - 0.2) < 0.03
    for i, (hit, wrong) in enumerate(says):
        table, _ = model.tables[model.groups.index((i,))]
        assert abs(math.exp(table[(1,)][1]) - hit) < 0.05 and abs(math.exp(table[(1,)][0]) - wrong) < 0.03
    table, _ = model.tables[model.groups.index((4, 5))]
    assert abs(math.exp(table[(1, 1)][1]) - 0.36) < 0.05 and abs(math.exp(table[(1, 1)][0]) - 0.09) < 0.03
    assert model.posterior((1, 1, 1, 1, 0, 0, 0)) > 0.95 and model.posterior((0, 0, 0, 0, 0, 0, 0)) < 0.1


def test_voters_vote():
    entries = toxicity.Entries.of([b"zorg", b"blat"], [b"weak"])
    vote = lambda t, y=None: dict(zip(toxicity.VOTERS, toxicity.votes(toxicity.look(t, entries, voters=True), entries, y), strict=True))
    v = vote(b"You are a moron, idiota! Shut up! zorg! go to hell", 1)
    assert [k for k, x in v.items() if x == 1] == ["en", "es", *(f"mined {k}" for k in range(6) if v[f"mined {k}"]), "two entries", "two kinds", "dense", "very dense", "address", "command", "threat", "marks", "given"]
    assert {k: x for k, x in vote(b"weak tea", 0).items() if x} == {"none": -1, "given": -1} and vote(b"")["none"] == -1
