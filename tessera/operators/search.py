"""Retrieval: inverted indexes, similarity, expansion along links. Chunks are tables (id, text)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import CAMEL, STOP_WORDS, SUFFIXES, WORD, tokens_raw
from tessera.session import cut, read_mb, ship, spread


def words_of(question: str) -> list[str]:
    """A question's distinct terms, sorted: what tokens() does, for one string."""
    return sorted({t for word in re.findall(WORD, question) for t in _terms_of(word)})


def raw_words_of(question: str) -> list[str]:
    """A question's terms as tokens_raw() gives them, with repetition."""
    out = []
    for w in re.findall("[a-z_][a-z0-9_]*", question.lower()):
        out += [w, *(p for p in w.split("_") if p)]
    return out


#: Words whose terms a task keeps, terms whose documents it counts before it passes them on, and documents that become rows at once.
KEPT_WORDS, KEPT_TERMS, SLICE = 200_000, 200_000, 256


_CAMEL = re.compile(CAMEL)


def _terms_of(word: str) -> list[str]:
    """What tokens() makes of one word (of WORD), with repetition."""
    out = []
    for part in (word,) if word.isalpha() and word.islower() else _CAMEL.findall(word):
        t = part.lower()
        if len(t) >= 2 and t not in STOP_WORDS:
            if t[-1] in "sdg":  # what suffixes end in
                fit = next(((s, r) for s, r in SUFFIXES if t.endswith(s) and len(t) - len(s) >= 3), None)
                t = t[: -len(fit[0])] + fit[1] if fit else t
            out.append(t)
    return out


def _raw_terms_of(word: str) -> list[str]:
    return [word, *(p for p in word.split("_") if p)] if "_" in word else [word, word]


def counted(chunks: DataFrame, raw: bool = False, wanted: Callable[[str], bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks read once: (term, df) over all of them, and (id, terms, tfs) of those that hold a term that `wanted` takes. Terms are those of tokens(), or of tokens_raw().

    A chunk's terms are counted where it's read and its word's terms looked up, so only what the question meets, and counts of documents, ever leave a task.
    """
    one = chunks.select("id", "text")
    if not one.groupBy("id").count().where("count > 1").isEmpty():  # chunks that share an id are one; no term goes over a line end
        one = one.groupBy("id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    ship(chunks.sparkSession)
    schema = one.select("id", F.array(F.lit("")).alias("terms"), F.array(F.lit(0).cast("long")).alias("tfs"), F.lit(True).alias("own")).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        words = re.compile("[a-z_][a-z0-9_]*" if raw else WORD)
        split = _raw_terms_of if raw else _terms_of
        known: dict[str, list[str]] = {}
        good: set[str] = set()
        found: Counter[str] = Counter()

        def rows(ids, terms, tfs, own):
            ids = pa.nulls(len(terms), arrow.field("id").type) if ids is None else ids.cast(arrow.field("id").type)
            return pa.RecordBatch.from_arrays([ids, pa.array(terms, arrow.field("terms").type), pa.array(tfs, arrow.field("tfs").type), pa.array([own] * len(terms), pa.bool_())], schema=arrow)

        def passed_on():
            every = list(found)
            parts = [every[k : k + 10_000] for k in range(0, len(every), 10_000)]
            out = rows(None, parts, [[found[t] for t in p] for p in parts], False)
            found.clear()
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                at, terms, tfs = [], [], []
                for n, text in enumerate(part.column(1).to_pylist()):
                    tf: dict[str, int] = {}
                    for w, c in Counter(words.findall(text.lower() if raw else text) if text else ()).items():
                        own = known.get(w)
                        if own is None:
                            own = split(w)
                            if len(known) < KEPT_WORDS:  # words that come first are the common ones
                                known[w] = own
                            if wanted is not None:
                                good.update(filter(wanted, own))
                        for t in own:
                            tf[t] = tf.get(t, 0) + c
                    found.update(tf.keys())
                    if not good.isdisjoint(tf):
                        at.append(n)
                        terms.append(list(tf))
                        tfs.append(list(tf.values()))
                if at:
                    yield rows(part.column(0).take(pa.array(at)), terms, tfs, True)
                if len(found) >= KEPT_TERMS:
                    yield passed_on()
        if found:
            yield passed_on()

    every = cut(spread(one).mapInArrow(run, schema))
    df = every.where("NOT own").select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("df")))).groupBy("term").agg(F.sum("df").alias("df"))
    return df, every.where("own").select("id", "terms", "tfs")


def frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df)."""
    return counted(chunks)[0]


#: MB of a vocabulary's file up to which it's broadcast; a larger one is joined by shuffles.
BROADCAST_MB = 16


def _weighted(chunks: DataFrame, df: DataFrame, docs: DataFrame, share: Column, bits: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(id, tf, idf, q, bits0 ...) of the documents' terms, and one row: the norm of the question's weights q over the vocabulary. A term that one document alone holds and
    that isn't asked for has a known weight, so it isn't looked up."""
    n = F.broadcast(chunks.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")))
    idf = df.crossJoin(n).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    known = cut(idf.withColumn("q", share * F.col("idf")).withColumns({f"bits{i}": b for i, b in enumerate(bits)}).where("df > 1 OR q > 0").drop("df"))
    qnorm = known.where("q > 0").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    held = docs.select("id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    found = held.join(F.broadcast(known) if read_mb(known) <= BROADCAST_MB else known, "term", "left").crossJoin(n)
    alone = F.log((F.col("n") + 1) / F.lit(2)) + 1
    return found.select("id", "tf", F.coalesce("idf", alone).alias("idf"), F.coalesce("q", F.lit(0.0)).alias("q"), *(F.coalesce(f"bits{i}", F.lit(0)).alias(f"bits{i}") for i in range(len(bits)))), qnorm


def _reaches(w: str, t: str) -> bool:
    return t == w or (len(w) >= 3 and t.startswith(w) and len(t) <= len(w) + 4)


def similarities(chunks: DataFrame, question: str) -> DataFrame:
    """(id, score > 0): cosine with prefix expansion, times 0.4 + 0.6 * coverage of the question's words."""
    words = words_of(question)
    t = F.col("term")

    def reached(w: str) -> Column:
        near = t.startswith(w) & (t != w) & (F.length(t) <= len(w) + 4) if len(w) >= 3 else F.lit(False)
        return (t == w) | near

    share = sum((F.when(t == w, 1.0).when(reached(w), 0.5).otherwise(0.0) for w in words), F.lit(0.0))
    bits = [sum((F.when(reached(w), F.lit(1 << i)).otherwise(0).cast("long") for i, w in enumerate(words[k : k + 60])), F.lit(0).cast("long")) for k in range(0, len(words), 60)]
    df, docs = counted(chunks, wanted=lambda term: any(_reaches(w, term) for w in words))
    weighted, qnorm = _weighted(chunks, df, docs, share, bits)
    w = (1 + F.log("tf")) * F.col("idf")
    per = weighted.groupBy("id").agg(
        F.sum(w * F.col("q")).alias("dot"),
        F.sqrt(F.sum(w * w)).alias("norm"),
        *(F.bit_or(f"bits{i}").alias(f"bits{i}") for i in range(len(bits))),
    )
    coverage = sum((F.bit_count(f"bits{i}") for i in range(len(bits))), F.lit(0)) / max(1, len(words))
    found = per.where("dot > 0").crossJoin(F.broadcast(qnorm))
    return found.select("id", F.round(F.col("dot") / (F.col("qnorm") * F.col("norm")) * (0.4 + 0.6 * coverage), 6).alias("score"))


def search(chunks: DataFrame, question: str, k: int = 6) -> DataFrame:
    """The k best (id, score), ties by id."""
    return similarities(chunks, question).orderBy(F.desc("score"), "id").limit(k)


def search_raw(chunks: DataFrame, question: str, k: int = 4) -> DataFrame:
    """Cosine of raw counts times idf; the k best over 0."""
    counts = {w: raw_words_of(question).count(w) for w in dict.fromkeys(raw_words_of(question))}
    share = F.lit(0.0)
    for w, c in counts.items():
        share = F.when(F.col("term") == w, float(c)).otherwise(share)
    df, docs = counted(chunks, raw=True, wanted=lambda term: term in counts)
    weighted, qnorm = _weighted(chunks, df, docs, share, [])
    w = F.col("tf") * F.col("idf")
    per = weighted.groupBy("id").agg(F.sum(w * F.col("q")).alias("dot"), F.sqrt(F.sum(w * w)).alias("norm"))
    scored = per.where("dot > 0").crossJoin(F.broadcast(qnorm)).select("id", F.round(F.col("dot") / (F.col("qnorm") * F.col("norm")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def keyword_search(chunks: DataFrame, question: str, k: int = 4) -> DataFrame:
    """How many of a text's tokens are the question's; the k best over 0."""
    asked = F.array(*map(F.lit, sorted(set(raw_words_of(question)))))
    hits = F.size(F.filter(tokens_raw(F.col("text")), lambda t: F.array_contains(asked, t))).cast("long")
    return spread(chunks).select("id", hits.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def retrieve(chunks: DataFrame, links: DataFrame, question: str, k: int = 6, most: int = 12) -> DataFrame:
    """Hits near the best one, and their neighbours along links (source, target, confidence): (id, score, reason, via_guess).

    A neighbour's place at a hit is by (similarity, sureness, id); the two best hits take four places, others two and only of
    neighbours that match the question. A neighbour belongs to the first hit that reaches it.
    """
    sims = cut(similarities(chunks, question))  # used twice
    top = sims.orderBy(F.desc("score"), "id").limit(k)
    hits = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumn("best", F.max("score").over(Window.partitionBy()))
    hits = hits.where("score >= best * 0.35").drop("best")  # k rows at most
    both = links.select(F.col("source").alias("hit"), F.col("target").alias("other"), "confidence", F.lit("calls").alias("how")).unionByName(
        links.select(F.col("target").alias("hit"), F.col("source").alias("other"), "confidence", F.lit("called by").alias("how"))
    )
    near = both.join(F.broadcast(hits.select(F.col("id").alias("hit"), F.col("score").alias("hit_score"), "rank")), "hit")
    near = near.join(sims.withColumnRenamed("id", "other").withColumnRenamed("score", "own"), "other", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    sure = (F.col("confidence") != "high").cast("int")
    place = F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("own"), sure, "other", "how"))
    near = near.withColumn("place", place).where(F.col("place") <= F.when(F.col("rank") <= 2, 4).otherwise(2)).where("rank <= 2 OR own > 0")
    near = near.join(F.broadcast(hits.select(F.col("id").alias("other"))), "other", "left_anti").join(chunks.select(F.col("id").alias("other")), "other", "left_semi")
    near = near.withColumn("first", F.row_number().over(Window.partitionBy("other").orderBy("rank", "place"))).where("first = 1")
    extra = near.select(F.col("other").alias("id"), F.round(F.col("hit_score") * 0.5, 6).alias("score"), F.concat("how", F.lit(" #"), "rank").alias("reason"), (F.col("confidence") != "high").alias("via_guess"), F.lit(1).alias("kind"), "rank", "place")
    found = hits.select("id", "score", F.lit("search").alias("reason"), F.lit(False).alias("via_guess"), F.lit(0).alias("kind"), "rank", F.lit(0).alias("place")).unionByName(extra)
    return found.orderBy("kind", F.desc("score"), "rank", "place").limit(most).select("id", "score", "reason", "via_guess")


# Everyday words and what code calls them.
SYNONYMS = {
    "loop": "for while repeat", "loops": "for while repeat", "repeat": "for while",
    "menu": "switch case choice menu", "choice": "switch case", "options": "switch case",
    "print": "printf print println puts log", "show": "printf print println display",
    "display": "printf print println", "input": "scanf input readline nextInt read",
    "type": "scanf input", "types": "scanf input", "read": "scanf input read load",
    "save": "save write store dump", "store": "save write store", "load": "load read open",
    "divide": "divide division", "add": "add sum plus", "sum": "sum add total",
    "average": "average mean", "biggest": "max largest", "largest": "max largest",
    "password": "password hash", "log": "login", "logs": "login", "login": "login auth",
    "check": "check verify if", "error": "error except catch raise",
}


def synonyms_of(word: str) -> list[str]:
    """The entry of a word or of its plain form (without s, d, ed, ing), and that form."""
    for w in (word, *(word[: -len(s)] for s in ("s", "d", "ed", "ing") if word.endswith(s))):
        if w in SYNONYMS:
            return [*SYNONYMS[w].split(), w]
    return []


def synonym_search(chunks: DataFrame, question: str, k: int = 6, share: float = 0.3, most: int = 5) -> DataFrame:
    """search() with the question's synonyms added; results of at least `share` of the best."""
    asked = " ".join([question, *(s for w in re.findall("[a-z]+", question.lower()) for s in synonyms_of(w))])
    top = search(chunks, asked, k)
    return top.withColumn("best", F.max("score").over(Window.partitionBy())).where(F.col("score") >= F.col("best") * share).drop("best").orderBy(F.desc("score"), "id").limit(most)


def path_confidence(steps: DataFrame, links: DataFrame) -> DataFrame:
    """steps (path, pos, id) -> (path, pos, hop): the best link ('high', 'medium', none) between a step and any before it."""
    later, earlier = steps.select("path", "pos", F.col("id").alias("b")), steps.select("path", F.col("pos").alias("p"), F.col("id").alias("a"))
    pairs = later.join(earlier, "path").where("p < pos")
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence").isNotNull(), 1).otherwise(0)
    both = links.select(F.col("source").alias("a"), F.col("target").alias("b"), "confidence").unionByName(links.select(F.col("target").alias("a"), F.col("source").alias("b"), "confidence"))
    best = pairs.join(both, ["a", "b"], "left").groupBy("path", "pos").agg(F.max(rank).alias("r"))
    return best.select("path", "pos", F.when(F.col("r") == 2, "high").when(F.col("r") == 1, "medium").otherwise("none").alias("hop"))


def top_per_group(scored: DataFrame, group: str, k: int) -> DataFrame:
    """The k best (group, id, score) of each group, ties by id."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def idf(n: int, df: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1
