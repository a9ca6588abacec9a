"""Substring dedup by level-wise doubling.

A word is removed if a window of `window` words covers it whose words also start in a document with a smaller doc_id. Levels have lengths
`start`, twice that, and so on up to `window`. At each level only windows are alive whose part at the level before was repeated. The part that stands for
a window at length k is its k-word sequence with the least hash (its minimizer), which depends on the window alone; neighbours mostly share it,
so the first level has about a quarter as many keys as there are words. What isn't repeated at one length is never tried at the next; when no key survives, nothing is
removed and the levels end.

Keys are 64-bit hashes of word sequences. They're counted with map-side minima and maxima of doc_id, so a passage that a third of all documents
hold is one row of each task; survivors go back to their documents by a join that can be split by AQE. Texts travel compressed.

Defined results: null and empty texts have no words; rows with a null doc_id keep all words and take none from others; rows with the same doc_id don't take words
from each other, and each gets a result; texts of fewer words than the window are whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import release, remove, ship, staged, texts
from tessera.llm.words import chunks, compressed, grams, hashed, rows, sliding_min


def lengths(window: int, start: int) -> list[int]:
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _keys(docs: list[bytes], window: int, k: int):
    """(key of each window's part of k words, document of the window or -1 where it would cross texts, hashes, firsts)."""
    words, first = hashed(docs)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words, first
    of = np.repeat(np.arange(len(docs)), np.diff(first))
    key = sliding_min(grams(words, k), window - k + 1).view(np.int64)
    of = np.where(of[: len(key)] == of[window - 1 :], of[: len(key)], -1)
    return key, of, words, first


def _emit(window: int, k: int, before: int | None):
    """Rows (key, doc_id): what stands for live windows at length k, once for each text. before: the length whose survivors come with the texts."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        if before is None:
            source = ((d, t, ()) for d, t in rows(batches, "doc_id", "text"))
        else:
            source = ((d, unpack(z), kept) for d, z, kept in rows(batches, "doc_id", "z", "keys"))
        for chunk in chunks(source):
            docs = [r[1] for r in chunk]
            key, of, words, _ = _keys(docs, window, k)
            live = of >= 0
            if before is not None and len(key):
                # whether a key is repeated doesn't depend on the document, so those of the whole chunk are looked up at once
                held = np.unique(np.concatenate([np.asarray(r[2], np.int64) for r in chunk]))
                live &= np.isin(sliding_min(grams(words, before), window - before + 1).view(np.int64), held)
            at = np.flatnonzero(live)
            if not len(at):
                continue
            key, of = key[at], of[at]
            order = np.lexsort((key, of))
            key, of = key[order], of[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            ids = np.array([r[0] for r in chunk], np.int64)
            key, own = key[fresh], ids[of[fresh]]
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)]), pa.array(own[i : i + (1 << 16)])], ["key", "doc_id"])

    return run


def _remove(window: int):
    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = defaultdict(list)
            for doc_id, z, keys in rows([batch], "doc_id", "z", "keys"):
                words = (text := unpack(z)).split()
                spans = []
                if keys:
                    key, _, _, _ = _keys([text], window, window)
                    at = np.flatnonzero(np.isin(key, np.asarray(keys, np.int64)))
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                    spans = edge.tolist()
                    out["n_removed"].append(int(gone.sum()))
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                else:
                    out["n_removed"].append(0)
                    kept = b" ".join(words)
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(words))
                out["kept"].append(kept.decode())
                out["spans"].append(spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["spans"], pa.list_(pa.int64()))],
                ["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return run


def repeated(documents: DataFrame, window: int = 13, start: int = 7) -> DataFrame | None:
    """(doc_id, keys): for each document, the windows whose words also start in one with a smaller doc_id; None if there are none."""
    spark = documents.sparkSession
    ship(spark)
    docs = texts(documents).where("doc_id IS NOT NULL")
    live, before = docs, None
    for k in lengths(window, start):
        keys = live.mapInArrow(_emit(window, k, before), "key long, doc_id long")
        seen = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key", "least")
        seen = staged(seen, f"seen-{k}")  # so that the counts' shuffle is gone before keys are shuffled to be joined
        release(spark)
        met = keys.join(seen.hint("shuffle_hash"), "key")
        if k == window:
            met = met.where("doc_id > least")
        met = staged(met.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), f"repeated-{k}")
        remove(seen)
        if before is not None:
            remove(live)
        release(spark)
        if met.isEmpty():
            return None
        if k == window:
            return met
        live, before = staged(compressed(docs).join(met.hint("shuffle_hash"), "doc_id"), f"live-{k}"), k
        remove(met)
        release(spark)


def dedup(documents: DataFrame, window: int = 13, start: int = 7) -> DataFrame:
    """For each document: doc_id, n_words, n_removed, kept (words that stay, joined by a space) and spans (start, end, start, end ... in words
    of what is removed)."""
    found = repeated(documents, window, start)
    docs = compressed(texts(documents))
    if found is None:
        every = docs.withColumn("keys", F.lit(None).cast("array<long>"))
    else:
        every = docs.join(found.hint("shuffle_hash"), "doc_id", "left")
    return every.select("doc_id", "z", "keys").mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept string, spans array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document."""
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS s, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM d WHERE len(w) >= 13),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM g JOIN f USING (g) WHERE doc_id > least),
w AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT w.doc_id, count(r.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (r.p IS NULL) AS kept FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.p = r.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
