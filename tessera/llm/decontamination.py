"""Benchmark decontamination: Wu-Manber search for many word sequences in every text.

Patterns are the windows of the benchmark items: 13 consecutive words, or the whole item if it has fewer. They're searched by
length. A shift table over hashed blocks of two words says how far the search may skip (blocks of one slot share the least shift); where the shift is none, a bucket by
the hashes of the suffix and prefix blocks selects the patterns to compare, and a direct comparison of the words' bytes confirms an occurrence.
Many cursors go through a text at once, each through 64 words, so tables are looked up in bulk.

The tables are arrays: about 50 bytes for each word of the benchmark, built once a Python worker. A benchmark of more than `block_bytes` is cut into blocks by hash of the
item. Then one scan of the documents with shift tables and a Bloom filter of all windows (`SIEVE_BYTES` at most) sets the texts aside that may hold one, and the
blocks are searched in these alone. What blocks find in a row is merged by doc_id (nulls are equal) and SHA-256 of the text, so results are those of one block.

Defined results: null and empty texts have no words and no hits; items without words match nothing; equal items all count; words of an item
with a null item_id are hit, but it isn't among the items; repeated rows of documents each get a result, rows of one doc_id with other texts their own; a null doc_id is
kept as null; very long texts are searched in one piece; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship, staged, texts
from tessera.llm.words import PLAIN, chunks, grams, hashed, keep, mix, rows, spans

BLOCK_BYTES, SIEVE_BYTES = 16 << 20, 64 << 20
#: words of a text that a cursor goes through
STRIDE = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Shifts:
    """The shift table of patterns of m words, and what is left when a text's cursors have skipped by it."""

    def __init__(self, m: int, patterns: int):
        self.m, self.block = m, min(2, m)
        self.far = min(255, m - self.block + 1)
        slots = 1 << min(26, max(10, int(4 * patterns).bit_length()))
        self.mask = np.uint64(slots - 1)
        self.table = np.full(slots, self.far, np.uint8)

    def add(self, blocks: np.ndarray, starts: np.ndarray) -> None:
        """blocks: hashes from each word on; starts: of patterns."""
        last = self.m - self.block
        for at in range(last + 1):  # small shifts last and never raised, so that the least stays
            slot = blocks[starts + at] & self.mask
            self.table[slot] = np.minimum(self.table[slot], min(self.far, last - at))

    def candidates(self, blocks: np.ndarray) -> np.ndarray:
        """Starts of windows whose last block ends a pattern (or shares its slot)."""
        last = self.m - self.block
        at = np.arange(last, len(blocks), STRIDE)
        stop = np.minimum(at + STRIDE, len(blocks))
        out = [at[:0]]
        while len(at):
            shift = self.table[blocks[at] & self.mask]
            out.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            open_ = at < stop
            at, stop = at[open_], stop[open_]
        return np.sort(np.concatenate(out)) - last


def _blocks_of(h: np.ndarray, block: int) -> np.ndarray:
    return grams(h, 2) if block == 2 else h


def _ends(blocks: np.ndarray, starts: np.ndarray, m: int, block: int) -> np.ndarray:
    """What buckets are found by: the suffix and the prefix block of each window."""
    return blocks[starts + (m - block)] * _ODD + blocks[starts]


def _windows(first: np.ndarray, window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: starts of patterns and the item of each, where the words of item i begin at first[i]."""
    n = np.diff(first)
    m = np.minimum(n, window)
    out = {}
    for size in np.unique(m[m > 0]).tolist():
        own = np.flatnonzero(m == size)
        count = n[own] - size + 1
        item = np.repeat(own, count)
        out[size] = (np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(count.sum()), item)
    return out


def _hashed(plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """hashed(), a bounded number of bytes at a time."""
    parts = [hashed([t for _, t in chunk]) for chunk in chunks((None, t) for t in plain)]
    sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(f) for _, f in parts)])
    return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)]), np.cumsum(sizes)


class Searcher:
    """Shift tables, buckets and the patterns' text."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        plain = [b" ".join((t or b"").translate(PLAIN).split()) for _, t in items]
        self.names = [i for i, _ in items]
        h, first = _hashed(plain)
        self.text = b"\n".join([b"", *plain, b""])
        starts, ends = spans(np.frombuffer(self.text, np.uint8)) if len(h) else (np.zeros(0, np.int64),) * 2
        self.starts, self.ends = starts.astype(np.uint32), ends.astype(np.uint32)
        del plain, starts, ends
        two = grams(h, 2)
        self.tables = []
        for m, (at, item) in _windows(first, window).items():
            shifts = Shifts(m, len(at))
            blocks = two if shifts.block == 2 else h
            shifts.add(blocks, at)
            order = np.argsort(grams(h, m)[at], kind="stable")  # equal windows are one pattern
            at, item = at[order], item[order]
            fresh = np.ones(len(at), bool)
            same = np.flatnonzero(np.diff(grams(h, m)[at]) == 0) + 1
            fresh[same] = [self.pattern(a, m) != self.pattern(b, m) for a, b in zip(at[same].tolist(), at[same - 1].tolist(), strict=True)]
            bounds = np.append(np.flatnonzero(fresh), len(at))
            at = at[fresh]
            key = _ends(blocks, at, m, shifts.block)
            order = np.argsort(key, kind="stable")
            self.tables.append((shifts, key[order], at[order].astype(np.uint32), bounds[:-1][order].astype(np.uint32), bounds[1:][order].astype(np.uint32), item.astype(np.uint32)))

    def pattern(self, start: int, m: int) -> bytes:
        return self.text[self.starts[start] : self.ends[start + m - 1]]

    def search(self, texts: list[bytes]) -> list[tuple[int, list[int], list[str]]]:
        """For each text: its words, what is hit (start, end, start, end ... merged), and the sorted names of the items that occur."""
        plain = [t.translate(PLAIN) for t in texts]
        h, first = hashed(plain)
        two = grams(h, 2)
        hits: dict[int, list] = defaultdict(list)
        found: dict[int, set] = defaultdict(set)
        held: dict[int, list[bytes]] = {}
        for number, (shifts, keys, at, low, high, _) in enumerate(self.tables):
            m = shifts.m
            blocks = two if shifts.block == 2 else h
            start = shifts.candidates(blocks)
            own = np.searchsorted(first, start, side="right") - 1
            inside = start + m <= first[own + 1]
            start, own = start[inside], own[inside]
            key = _ends(blocks, start, m, shifts.block)
            a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            for k in np.flatnonzero(a < b).tolist():
                doc = int(own[k])
                if doc not in held:
                    held[doc] = plain[doc].split()
                s = int(start[k] - first[doc])
                words = b" ".join(held[doc][s : s + m])
                for p in range(a[k], b[k]):
                    if self.pattern(at[p], m) == words:
                        hits[doc].append((s, m))
                        found[doc].add((number, int(low[p]), int(high[p])))
        out = []
        for doc, n in enumerate(np.diff(first).tolist()):
            edges, names = [], []
            if doc in hits:
                edge = np.zeros(n + 1, np.int64)
                s, m = np.array(hits[doc]).T
                np.add.at(edge, s, 1)
                np.add.at(edge, s + m, -1)
                hit = np.cumsum(edge) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8))).tolist()
                items = np.unique(np.concatenate([self.tables[t][-1][a:b] for t, a, b in found[doc]]))
                names = sorted({x for i in items.tolist() if (x := self.names[i]) is not None})
            out.append((n, edges, names))
        return out


class Sieve:
    """Shift tables and a Bloom filter of windows of any number of items: which texts may hold one."""

    def __init__(self, window: int, words: int):
        self.window, self.words = window, words
        self.bits = 1 << min(8 * SIEVE_BYTES, max(1 << 16, 20 * words)).bit_length() - 1
        self.filter = np.zeros(self.bits // 8, np.uint8)
        self.shifts: dict[int, Shifts] = {}

    def _places(self, windows: np.ndarray, m: int):
        for k in range(8):
            x = mix(windows ^ np.uint64(m * 64 + k + 1)) & np.uint64(self.bits - 1)
            yield (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8)

    def add(self, items: list[bytes]) -> None:
        h, first = _hashed([(t or b"").translate(PLAIN) for t in items])
        for m, (at, _) in _windows(first, self.window).items():
            shifts = self.shifts.setdefault(m, Shifts(m, self.words if m == self.window else 1 << 12))
            shifts.add(_blocks_of(h, shifts.block), at)
            for byte, bit in self._places(grams(h, m)[at], m):
                np.bitwise_or.at(self.filter, byte, bit)

    def passes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text: its words, and whether a window may occur."""
        h, first = hashed([t.translate(PLAIN) for t in texts])
        out = np.zeros(len(texts), bool)
        for m, shifts in self.shifts.items():
            start = shifts.candidates(_blocks_of(h, shifts.block))
            own = np.searchsorted(first, start, side="right") - 1
            inside = start + m <= first[own + 1]
            start, own = start[inside], own[inside]
            alive = np.ones(len(start), bool)
            for byte, bit in self._places(grams(h, m)[start], m) if len(start) else ():
                alive &= self.filter[byte] & bit > 0
            out[own[alive]] = True
        return np.diff(first), out


def _search(items: list[tuple[str | None, bytes]], window: int):
    """Rows of texts -> what is found in each."""
    token = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        searcher = keep(token, lambda: Searcher(items, window))
        for chunk in chunks(rows(batches, "doc_id", "text")):
            found = searcher.search([t for _, t in chunk])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in chunk], pa.int64()),
                    pa.array([hashlib.sha256(t).digest() if s else None for (_, t), (_, s, _) in zip(chunk, found, strict=True)], pa.binary()),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([s for _, s, _ in found], pa.list_(pa.int64())),
                    pa.array([i for _, _, i in found], pa.list_(pa.string())),
                ],
                ["doc_id", "digest", "n_words", "spans", "items"],
            )

    return run


def _sieved(sieve: Sieve):
    """Rows of texts -> their words, and digest and text of those that may hold a window."""

    def run(batches):
        import pyarrow as pa

        for chunk in chunks(rows(batches, "doc_id", "text")):
            n, may = sieve.passes([t for _, t in chunk])
            kept = [t if m else None for (_, t), m in zip(chunk, may.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in chunk], pa.int64()), pa.array([None if t is None else hashlib.sha256(t).digest() for t in kept], pa.binary()), pa.array(n, pa.int64()), pa.array([None if t is None else t.decode() for t in kept], pa.string())],
                ["doc_id", "digest", "n_words", "text"],
            )

    return run


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[list[DataFrame], int]:
    """The items (item, text) in blocks of about block_bytes of text, and how many bytes they are."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [items], total


def _collected(block: DataFrame) -> list[tuple[str | None, bytes]]:
    return [(r.item, bytes(r.text)) for r in block.collect()]  # about block_bytes


def search(documents: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: doc_id, n_words, spans (start, end, start, end ... of the words hit, merged, in order), items
    (ids, sorted, of the items with an occurring window)."""
    return _found(documents, benchmark, window, block_bytes).drop("digest")


def _found(documents: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """search() with the digest of each text that is hit."""
    ship(documents.sparkSession)
    docs = texts(documents)
    blocks, total = benchmark_blocks(benchmark, block_bytes)
    schema = "doc_id long, digest binary, n_words long, spans array<long>, items array<string>"
    if len(blocks) == 1:
        return docs.mapInArrow(_search(_collected(blocks[0]), window), schema)
    sieve = Sieve(window, total // 4)
    for block in blocks:
        sieve.add([t for _, t in _collected(block)])
    sieved = staged(docs.mapInArrow(_sieved(sieve), "doc_id long, digest binary, n_words long, text string"), "sieved")
    suspects = sieved.where("text IS NOT NULL").groupBy("doc_id", "digest").agg(F.min("text").alias("text"))
    suspects = staged(suspects.select("doc_id", "text"), "suspects")
    hits = None
    for number, block in enumerate(blocks):  # each block sees the few texts that were set aside
        part = staged(suspects.mapInArrow(_search(_collected(block), window), schema).where(F.size("spans") > 0), f"hits-{number}")
        hits = part if hits is None else hits.unionByName(part)
    pairs = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", 2 * i).alias("s"), F.get("spans", 2 * i + 1).alias("e")))
    flat = hits.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), F.explode(pairs).alias("p"))
    # spans of all blocks as runs: a span begins one where no span before it reaches it
    own = Window.partitionBy("hit_id", "hit_digest").orderBy("p.s", "p.e")
    flat = flat.withColumn("new", (F.coalesce(F.max("p.e").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) < F.col("p.s")).cast("int"))
    runs = flat.withColumn("run", F.sum("new").over(own)).groupBy("hit_id", "hit_digest", "run").agg(F.min("p.s").alias("s"), F.max("p.e").alias("e"))
    merged = runs.groupBy("hit_id", "hit_digest").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "e"))), lambda x: F.array(x["s"], x["e"]))).alias("spans"))  # of one text
    named = hits.select("doc_id", "digest", F.explode_outer("items").alias("i")).groupBy(F.col("doc_id").alias("named_id"), F.col("digest").alias("named_digest")).agg(F.array_sort(F.collect_set("i")).alias("items"))
    both = merged.join(named, F.col("hit_id").eqNullSafe(F.col("named_id")) & (F.col("hit_digest") == F.col("named_digest")))
    every = sieved.select("doc_id", "digest", "n_words")
    return every.join(both, every["doc_id"].eqNullSafe(both["hit_id"]) & (every["digest"] == both["hit_digest"]), "left").select(
        "doc_id", F.col("hit_digest").alias("digest"), "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, share: float = 0.05, **settings) -> DataFrame:
    """search() with n_hit and contaminated: a word is hit, and the words hit are at least `share` of all."""
    return _judged(search(documents, benchmark, **settings), share)


def _judged(found: DataFrame, share: float) -> DataFrame:
    ends = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])
    return found.withColumn("n_hit", ends).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words")))


def goes(n_words: int, edges: list[int], share: float, run: int) -> bool:
    """Whether a text leaves a corpus: `run` consecutive words or more are hit, or `share` of its words."""
    sizes = [b - a for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return bool(sizes) and (max(sizes) >= run or sum(sizes) >= share * n_words)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, share: float = 0.05, run: int = 8, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `documents`, all columns, but those that hold benchmark text: `run` consecutive words or more are hit (any window of 13 words is that
    long, however long the text), or `share` of all words. What stays can only hold whole items of fewer than `run` words, which are common phrases."""
    ship(documents.sparkSession)
    blocks, _ = benchmark_blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        sizes = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.get("spans", 2 * i + 1) - F.get("spans", 2 * i))
        bad = F.col("contaminated") | (F.array_max(sizes) >= run)
        gone = _judged(_found(documents, benchmark, window, block_bytes).where(F.size("spans") > 0), share).where(bad).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
        digest = F.unhex(F.sha2(F.coalesce(documents["text"].cast("string"), F.lit("")).cast("binary"), 256))
        return documents.join(gone.hint("shuffle_hash"), documents["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (digest == gone["gone_digest"]), "left_anti")
    items, token = _collected(blocks[0]), uuid.uuid4().hex

    def kept(batches):
        import pyarrow as pa

        searcher = keep(token, lambda: Searcher(items, window))
        for batch in batches:
            bad = [goes(n, edges, share, run) for chunk in chunks((None, t or b"") for (t,) in rows([batch], "text")) for n, edges, _ in searcher.search([t for _, t in chunk])]
            yield batch.filter(pa.array([not b for b in bad], pa.bool_()))

    return documents.mapInArrow(kept, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document against the whole benchmark."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
pats AS (SELECT item, least(13, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS pat FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT m FROM pats),
wins AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS pat FROM d, lens WHERE len(w) >= m),
occ AS (SELECT doc_id, s, wins.m, item FROM wins JOIN pats ON wins.m = pats.m AND wins.pat = pats.pat),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
