"""Toxicity by weak supervision.

1. Voters. A general lexicon of insults in four languages, words and word beginnings mined from labelled texts (those whose counts differ
   between labels by more than chance among so many candidates, with near copies counted once), and patterns (shouting, address, density) vote toxic, clean or not at all.
2. A generative label model. Expectation-maximisation over counted vote patterns estimates how often each voter says what for either class; pairs
   of voters whose votes agree more than the classes explain are found from the fitted model, and each such pair becomes one voter with a joint table. Given labels take part
   as one more voter, whose accuracy is estimated too.
3. A linear classifier (logistic, ridge) on presence of lexicon entries and pattern counts learns the posterior labels; it alone scores, and it sees the text only.

Learning uses labelled rows whose crc32(doc_id as text) mod 4 is not 2, at most `max_rows` of them (least hashed ids). What is gathered
on the driver: those rows' entries and votes, and the entries mined from them, so all of it is bounded by `max_rows`.

Defined results: null and empty texts are scored like any (they hold no entry); without labels, or with one kind only, nothing is mined, the
general lexicon votes and the model is fitted without given labels on as many documents; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ship, staged, texts
from tessera.llm.words import LOWER, PLAIN, grams, hashed, rows, trim

#: Insults in general use.
LEXICON = {
    "en": "idiot idiots idiotic moron morons moronic stupid dumb loser losers pathetic worthless trash scum disgusting clown clowns jerk creep filthy vermin imbecile cretin bastard bitch shit fuck fucking asshole crap retard".split(),
    "de": "idioten dumm dummkopf trottel arschloch scheisse abschaum widerlich versager wertlos erbärmlich schwachkopf".split(),
    "fr": "connard connasse merde salope salaud crétin débile imbécile ordure dégoûtant minable abruti".split(),
    "es": "idiota estúpido estúpida mierda imbécil basura escoria asqueroso patético inútil cabrón pendejo".split(),
}
PREFIXES = (4, 5, 6, 7)
#: candidates that a task counts at once
MOST_COUNTED = 100_000
HELD_OUT = 2
CAPITALS = bytes(range(65, 91))


class Entries(NamedTuple):
    """What is looked for: whole words and word beginnings (with an ellipsis as their last byte), and their numbers."""

    number: dict[bytes, int]
    languages: tuple[int, ...]  # where the general lexicon's entries of each language end
    general: int  # entries below this are the general lexicon
    strong: int  # entries from this on don't vote; only the classifier weighs them
    starts: frozenset[bytes]  # the first bytes of word beginnings, to try no others

    @staticmethod
    def of(mined: list[bytes], weak: list[bytes] = ()) -> Entries:
        general = list(dict.fromkeys(w.encode() for words in LEXICON.values() for w in words))
        ends = tuple(len(dict.fromkeys(w for words in list(LEXICON.values())[: k + 1] for w in words)) for k in range(len(LEXICON)))
        voting = list(dict.fromkeys([*general, *mined]))
        every = list(dict.fromkeys([*voting, *weak]))
        return Entries({w: i for i, w in enumerate(every)}, ends, len(general), len(voting), frozenset(w[: min(PREFIXES)] for w in every if w.endswith(b"*")))

    def found(self, words: set[bytes]) -> set[int]:
        number, starts, out = self.number, self.starts, set()
        for w in words:
            if w in number:
                out.add(number[w])
            if w[:4] in starts:
                out.update(number[p] for k in PREFIXES if len(w) > k and (p := w[:k] + b"*") in number)
        return out


def candidates(words: set[bytes]) -> set[bytes]:
    """The words and their beginnings."""
    return words | {w[:k] + b"*" for w in words for k in PREFIXES if len(w) > k}


class Look(NamedTuple):
    """What of a text the voters and the classifier see; found: all entries, voting: those that vote, hits: words that hold one of these."""

    found: set[int]
    voting: set[int]
    n_words: int
    hits: int
    shouts: float
    marks: int
    addressed: bool
    commanding: bool = False  # these two are looked at for voters only
    threatening: bool = False


#: Phrases of address, dismissal and threat.
ADDRESS = (b"you are a", b"you re a", b"you are an", b"you stupid", b"you all are", b"du bist", b"tu es un", b"eres un")


COMMANDS = (b"shut up", b"get lost", b"go away", b"get out of here", b"nobody asked", b"nobody likes you", b"halt den mund", b"halt die klappe", b"hau ab", b"ferme la", b"ta gueule", b"c\xc3\xa1llate", b"l\xc3\xa1rgate", b"vete a la")
THREATS = (b"kill yourself", b"go to hell", b"drop dead", b"hope you die", b"you should die", b"i will hurt", b"rot in", b"fahr zur h\xc3\xb6lle", b"va te faire", b"mu\xc3\xa9rete")


def look(text: bytes, entries: Entries, voters: bool = False) -> Look:
    plain = text.translate(PLAIN)
    listed = plain.split()
    words = set(listed)
    found = entries.found(words)
    voting = {i for i in found if i < entries.strong}
    hits = 0
    if voting:
        held = {w for w in words if any(i < entries.strong for i in entries.found({w}))}
        hits = sum(w in held for w in listed)
    letters, capitals = len(text) - text.count(b" "), len(text) - len(text.translate(None, CAPITALS))
    holds = lambda phrases: any(a in plain for a in phrases)
    return Look(found, voting, len(listed), hits, capitals / max(1, letters) if voting else 0.0, text.count(b"!"), holds(ADDRESS) if voting else False, voters and holds(COMMANDS), voters and holds(THREATS))


MINED = 6
VOTERS = (*LEXICON, *(f"mined {k}" for k in range(MINED)), "two entries", "two kinds", "dense", "very dense", "shouting", "address", "command", "threat", "marks", "none", "given")


def votes(x: Look, entries: Entries, label: int | None) -> tuple[int, ...]:
    """By voter: 1 toxic, -1 clean, 0 none."""
    mined = [i for i in x.voting if i >= entries.general]
    return (
        *(int(any(a <= i < b for i in x.voting)) for a, b in zip((0, *entries.languages[:-1]), entries.languages, strict=True)),
        *(int(any(i % MINED == k for i in mined)) for k in range(MINED)),
        int(x.hits >= 2),
        int(bool(mined) and len(mined) < len(x.voting)),
        int(x.hits > 0.01 * x.n_words),
        int(x.hits > 0.04 * x.n_words),
        int(x.shouts > 0.3 and bool(x.voting)),
        int(x.addressed and bool(x.voting)),
        int(x.commanding),
        int(x.threatening),
        int(x.marks >= 3 and bool(x.voting)),
        -1 if not x.voting else 0,
        0 if label is None else 1 if label else -1,
    )


class LabelModel:
    """Class-conditional vote tables, fitted to counted patterns of votes; the last voter is the given label."""

    def __init__(self, counted: dict[tuple[int, ...], int], rounds: int = 50, least: float = 0.15):
        self.voters = len(next(iter(counted)))
        self.groups = [(i,) for i in range(self.voters)]
        self._fit(counted, rounds)
        for i, j in self._correlated(counted, least):
            self.groups = [g for g in self.groups if g not in ((i,), (j,))] + [(i, j)]
        self._fit(counted, rounds)

    def _fit(self, counted, rounds):
        patterns, n = list(counted), np.array(list(counted.values()), float)
        given = np.array([p[-1] for p in patterns])
        lean = np.array([sum(p[:-1]) for p in patterns])
        q = np.where(given > 0, 0.95, np.where(given < 0, 0.02, np.where(lean > 0, 0.7, 0.05)))
        for _ in range(rounds):
            mass = np.array([(n * (1 - q)).sum(), (n * q).sum()])
            self.prior = np.clip((mass + 1) / (mass.sum() + 2), 1e-4, 1)
            self.tables = []
            for g in self.groups:
                table: dict = defaultdict(lambda: np.zeros(2))
                for p, m, x in zip(patterns, n, q, strict=True):
                    table[tuple(p[i] for i in g)] += (m * (1 - x), m * x)
                size = 3 ** len(g)
                self.tables.append(({k: np.log((v + 0.5) / (mass + 0.5 * size)) for k, v in table.items()}, np.log(0.5 / (mass + 0.5 * size))))
            q = np.array([self.posterior(p) for p in patterns])
        self.q = dict(zip(patterns, q, strict=True))

    def posterior(self, pattern) -> float:
        s = np.log(self.prior).copy()
        for g, (table, rare) in zip(self.groups, self.tables, strict=True):
            s += table.get(tuple(pattern[i] for i in g), rare)
        return float(1 / (1 + np.exp(np.clip(s[0] - s[1], -50, 50))))

    def _correlated(self, counted, least):
        """Pairs of voters, strongest first and each voter once, whose votes are correlated within the classes."""
        p = np.array(list(counted), float)
        n, q = np.array(list(counted.values()), float), np.array([self.q[x] for x in counted])
        strength = np.zeros((p.shape[1],) * 2)
        for weight in (n * q, n * (1 - q)):
            if weight.sum() < 20:
                continue
            centred = p - (p * weight[:, None]).sum(0) / weight.sum()
            cov = (centred * weight[:, None]).T @ centred / weight.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            strength = np.maximum(strength, np.abs(cov / np.outer(sd, sd)) * (np.outer(sd, sd) > 1e-4))
        out, used = [], {self.voters - 1}  # the given labels stay on their own
        for s, i, j in sorted(((strength[i, j], i, j) for i in range(len(strength)) for j in range(i)), reverse=True):
            if s > least and not {i, j} & used:
                out.append((j, i))
                used |= {i, j}
        return out


class Model(NamedTuple):
    entries: Entries
    weights: np.ndarray  # of entries, then of counts
    bias: float

    def score(self, text: bytes) -> float:
        x = look(text, self.entries)
        s = self.bias + float(self.weights[list(x.found)].sum() if x.found else 0) + float(_counts(x) @ self.weights[len(self.entries.number) :])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, s))))


def _counts(x: Look) -> np.ndarray:
    return np.array([math.log1p(len(x.voting)), math.log1p(x.hits), 100 * x.hits / max(x.n_words, 20), float(x.addressed)])


def _count_candidates(batches):
    """Rows (entry, clean, toxic): in how many texts, in parts that are summed later."""
    import pyarrow as pa

    clean, toxic = Counter(), Counter()

    def flush():
        every = list(clean.keys() | toxic.keys())
        for i in range(0, len(every), 1 << 14):
            part = every[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([clean[w] for w in part], pa.int64()), pa.array([toxic[w] for w in part], pa.int64())], ["entry", "clean", "toxic"])
        clean.clear()
        toxic.clear()

    for text, label in rows(batches, "text", "label"):
        (toxic if label else clean).update(candidates(set(text.translate(PLAIN).split())))
        if len(clean) + len(toxic) > MOST_COUNTED:
            yield from flush()
    yield from flush()
    trim()


def _shape(batches):
    """Rows with two minimum hashes of five-word sequences, by which near copies are known."""
    import pyarrow as pa

    for batch in batches:
        low = []
        for (text,) in rows([batch], "text"):
            w, _ = hashed([text.translate(LOWER)])
            g = grams(w, min(5, len(w))) if len(w) else w
            low.append((int(g.min()) if len(g) else 0, int((g * np.uint64(0x9E3779B97F4A7C15)).min()) if len(g) else 0))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.array([x[i] for x in low], np.uint64).view(np.int64)) for i in range(2))], [*batch.schema.names, "low_a", "low_b"])


def mine(labelled: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Entries whose counts in toxic texts are beyond chance: those with odds of 20 or more, and the weaker ones with all words that begin with any. The
    labelled rows are bounded, so their entries are."""
    shaped = labelled.select("doc_id", "text", "label").mapInArrow(_shape, "doc_id long, text string, label int, low_a long, low_b long")
    # near copies: both hashes and the label agree; the least doc_id stays
    once = shaped.groupBy("low_a", "low_b", "label").agg(F.min(F.struct("doc_id", "text")).alias("least")).select("least.text", "label")
    counted = once.select("text", "label").mapInArrow(_count_candidates, "entry binary, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kinds = once.groupBy("label").count().collect()  # two rows
    n = {r["label"]: r["count"] for r in kinds}
    if not n.get(0) or not n.get(1):
        return [], []
    counted = staged(counted.where("clean + toxic >= 3"), "candidates")
    # log-likelihood ratio of the counts against one rate for all texts; a text has about 200 candidates
    every, hits = float(n[0] + n[1]), F.col("clean") + F.col("toxic")
    ratio = 2 * sum(F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * every / (hits * float(n[k])))).otherwise(0.0) for k, c in ((0, "clean"), (1, "toxic")))
    beyond = 2 * max(5.0, math.log(200 * every / 0.1) - 6)
    found = counted.where((ratio >= beyond) & (F.col("toxic") * n[0] >= 6 * F.col("clean") * n[1]))
    # of a beginning and the longer ones inside it, all may stay: the classifier weighs them
    held = [(bytes(r["entry"]), r["toxic"] * n[0] >= 20 * r["clean"] * n[1]) for r in found.orderBy(F.desc(ratio), "entry").collect()]
    starts = [w[:-1] for w, _ in held if w.endswith(b"*")]
    weak = [w for w, strong in held if not strong]
    if starts:  # words with such a beginning may be clean ones; the classifier can tell only if they are entries
        more = counted.where(" OR ".join(f"substring(entry, 1, {k}) IN ({', '.join(x)})" for k in PREFIXES if (x := [f"X'{w.hex()}'" for w in starts if len(w) == k])))
        weak += [bytes(r["entry"]) for r in more.orderBy(F.desc(hits), "entry").collect()]
    return [w for w, strong in held if strong], weak


def _looks(entries: Entries):
    """What training needs of each text: votes, entries found, counts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(look(text, entries, voters=True), label) for text, label in rows([batch], "text", "label")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(votes(x, entries, y)) for x, y in out], pa.list_(pa.int32())), pa.array([sorted(x.found) for x, _ in out], pa.list_(pa.int32())), pa.array([_counts(x).tolist() for x, _ in out], pa.list_(pa.float64()))],
                ["votes", "found", "counts"],
            )

    return run


def _logistic(found: list[list[int]], counts: np.ndarray, target: np.ndarray, entries: int, ridge: float = 2e-4, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.array([i for f in found for i in f], np.int64)
    size = entries + counts.shape[1]
    w, bias = np.zeros(size), -2.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        s = bias + counts @ w[entries:] + np.bincount(row, w[col], len(found))
        e = (1 / (1 + np.exp(-np.clip(s, -50, 50))) - target) / len(found)
        g = np.concatenate([np.bincount(col, e[row], entries), counts.T @ e, [e.sum()]])
        g[:size] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:size], bias - step[size]
    return w, float(bias)


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """The classifier, from documents and labels (doc_id, toxic)."""
    spark = documents.sparkSession
    ship(spark)
    docs = texts(documents)
    open_rows = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != HELD_OUT
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("label")).where(F.col("label").isin(0, 1) & open_rows).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # so a broadcast of it is bounded
    labelled = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").persist()
    try:
        entries = Entries.of(*mine(labelled))
        source = labelled
        if labelled.isEmpty():
            source = docs.where(open_rows).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("text", F.lit(None).cast("int").alias("label"))
        seen = source.mapInArrow(_looks(entries), "votes array<int>, found array<int>, counts array<double>").collect()  # max_rows at most
    finally:
        labelled.unpersist()
    if not seen:
        return Model(entries, np.concatenate([np.full(entries.general, 1.0), np.zeros(len(entries.number) - entries.general + 4)]), -2.0)
    seen.sort()
    patterns = [tuple(r["votes"]) for r in seen]
    model = LabelModel(Counter(patterns))
    target = np.array([model.q[p] for p in patterns])
    weights, bias = _logistic([r["found"] for r in seen], np.array([r["counts"] for r in seen]), target, len(entries.number))
    return Model(entries, weights, bias)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [(d, model.score(t)) for d, t in rows([batch], "doc_id", "text")]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "score"])

    ship(documents.sparkSession)
    return texts(documents).mapInArrow(run, "doc_id long, score double")


def without_toxic(documents: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, that score below the threshold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([model.score(t or b"") < threshold for (t,) in rows([batch], text)], pa.bool_()))

    ship(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == HELD_OUT


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document."""
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(documents, learn(documents, labels))
    return found.select(
        "doc_id",
        (F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)), F.lit(0)) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )
