"""N-gram Jaccard join with a token-group matrix.

Sets are distinct 5-word shingles, as 64-bit hashes. Documents with equal sets are one class, whose least doc_id stands for it. The
classes are partitioned into groups of similar sets: each is compared with the least class that shares two of its minimum
hashes, and verified links join classes into groups. The matrix stores, for each group, the union of its members' tokens, as
rows (token, group). Any two sets that link share a token among their prefixes, the first n - ceil(0.75 n) + 1 tokens in one global
order, so the matrix holds prefixes only; and they share at least 3 y / 7 - 9 x / 28 of them (x, y: the sizes). A pair of groups whose unions share
fewer can't hold a link. Only those that reach the bound are opened: there each member is held against the other group's whole union, and
against its members if that bound is reached too. Two groups need one link to become one, so the search in a pair ends with the first.

The order of tokens puts those that are frequent in a bounded sample of documents last. It has a bearing on speed alone; any order
gives the same links. All rows of a token are counted map-side, and the hot ones are dropped as soon as all their holders are in one group.

Defined results: null and empty texts have an empty set, link with nothing and are their own component; texts of one to four words have one
shingle, the whole sequence; rows with a null doc_id link with nothing and have a null component; rows with the same doc_id are one node, whose links are those of the least of its texts in compressed form (each row
has its own n_shingles); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import release, remove, ship, staged, texts
from tessera.llm.components import components
from tessera.llm.words import LOWER, chunks, compressed, grams, hashed, mix, rows

SEEDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: tokens of more groups than that are joined in bands of size only; pairs of groups with as many pairs of members or fewer are verified by pair
NARROW, SMALL = 16, 16
BASE = -(1 << 63)
#: tokens of a group that one task puts in order
MOST_NUMBERED = 1 << 20
SAMPLE_DOCS, SAMPLE_HITS, MOST_FREQUENT = 24_576, 3, 200_000


def shingles(docs: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = hashed([d.translate(LOWER) for d in docs])
    all_grams = grams(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(all_grams[a : b - k + 1]) if b - a >= k else grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _profile(k: int):
    """doc_id, n, two hashes of the set, minimum hashes."""

    def run(batches):
        import pyarrow as pa

        for chunk in chunks(rows(batches, "doc_id", "text")):
            ids, n, one, two, low = [], [], [], [], []
            for (doc_id, _), s in zip(chunk, shingles([r[1] for r in chunk], k), strict=True):
                ids.append(doc_id)
                n.append(len(s))
                mixed = [mix(s ^ x) for x in SEEDS]
                one.append(int(mixed[0].sum()) if len(s) else 0)
                two.append(int(mixed[1].sum()) if len(s) else 0)
                low.append([m.min() for m in mixed] if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), pa.array([np.array(x, np.uint64).view(np.int64) for x in low], pa.list_(pa.int64()))],
                ["doc_id", "n", "one", "two", "low"],
            )

    return run


def _tokens(k: int, frequent: np.ndarray | None):
    """Rows (token, doc_id): all of a text's tokens, or with `frequent` those of its prefix."""

    def run(batches):
        import pyarrow as pa

        for chunk in chunks(rows(batches, "doc_id", "text")):
            parts, ids, sizes = [], [], []
            for (doc_id, _), s in zip(chunk, shingles([r[1] for r in chunk], k), strict=True):
                if frequent is not None and len(s):
                    keep = len(s) - -(-3 * len(s) // 4) + 1
                    if len(frequent):
                        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                        s = np.concatenate([s[~late], s[late]]) if late.any() else s
                    s = s[:keep]
                parts.append(s)
                ids.append(doc_id)
                sizes.append(len(s))
            token, own = np.concatenate(parts).view(np.int64), np.repeat(np.array(ids, np.int64), sizes)
            for i in range(0, len(token), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(token[i : i + (1 << 16)]), pa.array(own[i : i + (1 << 16)])], ["token", "doc_id"])

    return run


def _verify(k: int):
    """Rows (a, b) of pairs with texts za, zb whose sets link."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, np.ndarray] = {}

        def of(doc_id, z):
            if doc_id not in held:
                if len(held) > 256:
                    held.clear()
                held[doc_id] = shingles([unpack(z)], k)[0]
            return held[doc_id]

        for batch in batches:
            out = [(a, b) for a, b, za, zb in rows([batch], "a", "b", "za", "zb") if _links(of(a, za), of(b, zb))]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return run


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)) or not len(x):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= 75 * (len(x) + len(y) - shared)


def _open(k: int):
    """Links between a part of one group and members of others: one for each of these groups, member by member behind the bound of the union."""

    def run(table):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        every = sorted(zip(*(table.column(c).to_pylist() for c in ("asks", "doc_id", "z")), strict=True), key=lambda r: r[:2])
        base = [(d, shingles([unpack(z)], k)[0]) for asks, d, z in every if asks == BASE]
        union = np.unique(np.concatenate([x for _, x in base])) if base else None
        out, done = [], set()
        for asks, d, z in every:
            if asks == BASE or asks in done or not base:
                continue
            x = shingles([unpack(z)], k)[0]
            # a set that links with a member shares three quarters of its tokens with the union
            if 4 * len(np.intersect1d(x, union, assume_unique=True)) >= 3 * len(x):
                hit = next((b for b, y in base if _links(x, y)), None)
                if hit is not None:
                    out.append((d, hit))
                    done.add(asks)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def frequent_tokens(docs: DataFrame, k: int = 5) -> np.ndarray:
    """Sorted tokens, at most MOST_FREQUENT, that SAMPLE_HITS or more of about SAMPLE_DOCS documents hold."""
    total = max(1, docs.count())
    share = min(1_000_000, SAMPLE_DOCS * 1_000_000 // total + 1)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    seen = sample.mapInArrow(_tokens(k, None), "token long, doc_id long").groupBy("token").count().where(F.col("count") >= SAMPLE_HITS)
    return np.sort(np.array([r.token for r in seen.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect()], np.int64).view(np.uint64))


def _with_texts(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(doc_id, z) of the documents asked for, one row each."""
    found = compressed(docs).join(ids.distinct().hint("shuffle_hash"), "doc_id")
    return staged(found.groupBy("doc_id").agg(F.min("z").alias("z")), name)


def join(documents: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(profile: doc_id, n and set hashes of every row; links (a, b) between classes' least documents and of members to them, enough to connect all that link)."""
    spark = documents.sparkSession
    ship(spark)
    docs = texts(documents)
    known = docs.where("doc_id IS NOT NULL")
    profile = staged(docs.mapInArrow(_profile(k), "doc_id long, n long, one long, two long, low array<long>"), "profile")
    full = profile.where("n > 0 AND doc_id IS NOT NULL")
    # classes of two rows or more are written first, so that a large one's rows meet them in a join that AQE can split
    several = full.groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    tagged = staged(full.join(staged(several, "classes"), ["n", "one", "two"], "left").select("doc_id", "n", "low", F.coalesce("rep", "doc_id").alias("rep")), "tagged")
    member = tagged.select("doc_id", "rep").distinct()
    reps = staged(tagged.where("doc_id = rep").groupBy("doc_id").agg(F.min("n").alias("low_n"), F.max("n").alias("high_n"), F.min("low").alias("low")), "reps")
    # groups: a class and the least that shares two minimum hashes with it, if they link
    twos = F.array(*(F.xxhash64(F.get("low", F.lit(i)), F.get("low", F.lit(j))) for i in range(len(SEEDS)) for j in range(i)))
    low = reps.select("doc_id", "low_n", "high_n", F.posexplode(twos).alias("seed", "hash"))
    least = low.groupBy("seed", "hash").agg(F.min(F.struct("doc_id", "low_n", "high_n")).alias("first"), F.count("*").alias("c")).where("c > 1")
    pairs = low.join(staged(least, "least"), ["seed", "hash"]).where("doc_id <> first.doc_id AND 4 * least(high_n, first.high_n) >= 3 * greatest(low_n, first.low_n)")
    pairs = staged(pairs.select(F.col("doc_id").alias("b"), F.col("first.doc_id").alias("a")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    links = staged(_verified(known, pairs, k, "held"), "links")
    groups = staged(components(links), "groups")
    grouped = reps.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "low_n", "high_n", F.coalesce("component", "doc_id").alias("group"))
    grouped = staged(grouped, "grouped")
    # the matrix: tokens of prefixes that two documents or more hold
    frequent = frequent_tokens(known, k)
    prefix = known.mapInArrow(_tokens(k, frequent), "token long, doc_id long")
    shared = prefix.groupBy("token").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("token")
    matrix = staged(prefix.join(shared.hint("shuffle_hash"), "token").join(member, "doc_id").select("token", F.col("rep").alias("doc_id")).distinct(), "matrix")
    release(spark)
    sizes = staged(grouped.groupBy("group").agg(F.min("low_n").alias("low"), F.max("high_n").alias("high"), F.count("*").alias("members")), "sizes")
    cells = matrix.join(grouped.select("doc_id", "group"), "doc_id").select("token", "group").distinct()
    holders = cells.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    cells = staged(cells.join(holders, "token").join(sizes, "group"), "cells")
    near = staged(_near(cells), "near")
    remove(matrix)
    remove(cells)
    release(spark)
    members = member.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    if near.isEmpty():
        return profile, links.unionByName(members)
    small = near.where(F.col("members_a") * F.col("members_b") <= SMALL)
    of = grouped.select("doc_id", "group")
    opened = small.join(of.withColumnRenamed("doc_id", "a"), F.col("group_a") == F.col("group")).drop("group").join(of.withColumnRenamed("doc_id", "b"), F.col("group_b") == F.col("group"))
    links = staged(links.unionByName(_verified(known, staged(opened.select("a", "b"), "small-pairs"), k, "small")), "more-links")
    large = near.where(F.col("members_a") * F.col("members_b") > SMALL)
    if not large.isEmpty():
        links = staged(links.unionByName(_opened(known, large, of, k)), "all-links")
    return profile, links.unionByName(members)


def _verified(docs: DataFrame, pairs: DataFrame, k: int, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets link."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    held = _with_texts(docs, ids, name)
    both = pairs.join(held.select(F.col("doc_id").alias("b"), F.col("z").alias("zb")), "b").join(held.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a")
    return both.select("a", "b", "za", "zb").mapInArrow(_verify(k), "a long, b long")


def _near(cells: DataFrame) -> DataFrame:
    """Pairs of groups that may hold a link: (group_a, group_b, members_a, members_b).

    cells: (token, group, holders, low, high, members). A group's tokens are put in one global order, rare ones first. Two groups that share at least `bound` tokens
    have bound - 1 or more left in both after the first they share; only such meetings make a row, so a pair that falls short makes none.

    Tokens of NARROW holders or fewer are joined with themselves. A group has `wide` other tokens; a pair whose bound is over that must share narrow
    ones too. Where the bound is lower, the smaller size is within 7 wide / 3 of three quarters of the larger; only pairs in that band are joined
    on wide tokens, by token and class of size.
    """
    # a very large group is numbered in parts; its tokens left are then an upper bound, which lets more meetings through and loses none
    large = staged(cells.groupBy("group").agg(F.count("*").alias("own_tokens")).where(F.col("own_tokens") > MOST_NUMBERED), "large-groups")
    cells = cells.join(large, "group", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("token"), F.ceil(F.col("own_tokens") / MOST_NUMBERED)), F.lit(0).cast("long")))
    part = Window.partitionBy("group", "part")
    cells = cells.withColumn("left", F.coalesce("own_tokens", F.count("*").over(part)) - F.row_number().over(part.orderBy("holders", "token"))).drop("own_tokens", "part")
    wide = cells.where(F.col("holders") > NARROW)
    wides = wide.groupBy("group").agg(F.count("*").alias("wide"))

    def side(t: DataFrame, s: str, *more: str) -> DataFrame:
        return t.select(F.col("token").alias(f"token_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("group", "low", "high", "members", "left", *more)))

    bound = F.least(3 * F.col("low_b") / 7 - 9 * F.col("high_a") / 28, 3 * F.col("low_a") / 7 - 9 * F.col("high_b") / 28)
    enough = 1 + F.least("left_a", "left_b") >= bound
    narrow = cells.where(F.col("holders") <= NARROW)
    compatible = (4 * F.col("high_a") >= 3 * F.col("low_b")) & (4 * F.col("high_b") >= 3 * F.col("low_a"))
    met = side(narrow, "a").join(side(narrow, "b"), (F.col("token_a") == F.col("token_b")) & (F.col("group_a") < F.col("group_b")) & compatible & enough)
    wide = wide.join(wides, "group")
    kind = lambda c: F.floor(F.log(F.greatest(c, F.lit(1.0))) / F.log(F.lit(1.1)))
    top = F.least(F.col("high").cast("double"), 0.75 * F.col("high") + 7 * F.col("wide") / 3 + 1)
    larger = side(wide.withColumn("kind", F.explode(F.sequence(kind(0.75 * F.col("low")), kind(F.greatest(top, 0.75 * F.col("low")))))), "a", "wide", "kind")
    smaller = side(wide.withColumn("kind", F.explode(F.sequence(kind(F.col("low").cast("double")), kind(F.col("high").cast("double"))))), "b", "kind")
    band = (F.col("high_b") >= 0.75 * F.col("low_a")) & (F.col("low_b") <= 0.75 * F.col("high_a") + 7 * F.col("wide_a") / 3 + 1) & (F.col("low_b") <= F.col("high_a"))
    banded = larger.join(smaller, (F.col("token_a") == F.col("token_b")) & (F.col("kind_a") == F.col("kind_b")) & (F.col("group_a") != F.col("group_b")) & band & enough)
    first = F.col("group_a") < F.col("group_b")
    ordered = banded.select(*(F.when(first, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{o}")).alias(f"{c}_{s}") for c in ("group", "members") for s, o in ("ab", "ba")))
    return met.select("group_a", "members_a", "group_b", "members_b").unionByName(ordered).distinct()


def _opened(docs: DataFrame, near: DataFrame, of: DataFrame, k: int) -> DataFrame:
    """Links between groups of a pair. The larger group is the base, in parts of about 64 members; all groups that ask for a base meet each part in
    batches of about 256 members, so a part is sent once a batch."""
    first = F.col("members_a") >= F.col("members_b")
    asked = near.select(*(F.when(first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"base_{c}") for c in ("group", "members")), *(F.when(first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"ask_{c}") for c in ("group", "members")))
    bases = asked.groupBy("base_group").agg(F.ceil(F.max("base_members") / 64).alias("parts"), F.ceil(F.sum("ask_members") / 256).alias("batches"))
    count = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    base = of.join(bases, F.col("group") == F.col("base_group")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).withColumn("batch", count("batches")).withColumn("asks", F.lit(BASE))
    asks = asked.join(bases, "base_group").join(of, F.col("group") == F.col("ask_group")).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.col("batches"))).withColumn("part", count("parts")).withColumn("asks", F.col("ask_group"))
    rowed = staged(base.select("base_group", "part", "batch", "asks", "doc_id").unionByName(asks.select("base_group", "part", "batch", "asks", "doc_id")), "asked")
    held = _with_texts(docs, rowed.select("doc_id"), "opened")
    return rowed.join(held, "doc_id").groupBy("base_group", "part", "batch").applyInArrow(_open(k), "a long, b long")


def near_duplicates(documents: DataFrame, k: int = 5) -> DataFrame:
    """For each document: doc_id, n_shingles, component_id (the least doc_id it reaches by links)."""
    profile, links = join(documents, k)
    found = components(links).withColumnRenamed("node", "doc_id")
    return profile.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, k: int = 5) -> DataFrame:
    """The rows of `documents`, all columns, whose doc_id is the least of its component (or null)."""
    found = near_duplicates(documents, k)
    gone = staged(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return documents.join(gone.hint("shuffle_hash"), documents["doc_id"] == gone["gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
