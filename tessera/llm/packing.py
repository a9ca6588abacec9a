"""Lexical retrieval packing: sequences of at most 4,096 tokens, filled with a seed document and its BM25 neighbours.

1. Texts are encoded. White space never takes part in a token of this tokenizer, so words are encoded on their own and kept in a
   bounded table on each worker. What a long document has in whole windows becomes sequences of its own; its rest, shorter than a window, goes on.
2. Document frequencies of all tokens over all documents are summed (as many rows as the vocabulary has), and the rests are dealt to shards of about
   `shard_tokens` tokens by content, so that neighbours meet: their BM25 weights are projected to `DIMENSIONS` numbers, and a tree of two-means cuts, grown on
   a sample of at most `SAMPLE` rests, leads each to its shard. Rests that the tree can't tell apart (many equal copies, or fewer than `LEAST` sampled) share their shards by a hash of doc_id and place.
3. Each shard has its own inverted index with BM25 weights. Longest first, a document not yet used seeds a window; the index scores all documents that share a token with it;
   unused ones are taken in order of score while they fit. Documents of other shards aren't seen; README has the share of neighbours that is lost so. When none of the best fits, the best of them is cut to fill the window, and its
   rest stays in the index. Only the last window of a shard has padding.

Defined results: null and empty texts are the end token alone; a null doc_id and repeated rows are documents like others; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import release, ship, staged, texts
from tessera.llm.words import CHUNK, LOWER, chunks, hash_spans, keep, pieces, rows, spans, stay, trim

WINDOW, END = 4096, 2
SHARD_TOKENS = 1_000_000
SLOTS = 1 << 21
SHARDS_A_TASK = 4
K1, B = 1.2, 0.75
BEST = 48
#: for dealing rests to shards: numbers a rest is projected to, rests the tree grows on, fewest of them that are cut
DIMENSIONS, SAMPLE, LEAST = 64, 1 << 16, 4
#: Fixed value: the expression by which the given tokenizer cuts words, as its file has it; below, what it means for letters and signs before U+0180, in lower case.
CUT_PATTERN = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LATIN = {k: "".join(c for c in map(chr, range(0xA1, 0x180)) if unicodedata.category(c)[0] == k) for k in "LN"}
LATIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u017f]+")
LATIN_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN['L']}]+|[0-9{_LATIN['N']}]|[^a-z0-9{_LATIN['L']}{_LATIN['N']}]+")
#: parts of words kept between chunks
MOST_PARTS = 1 << 17


class Encoder:
    """Ids of whole texts by a tokenizer that lower-cases, splits at white space and between letters and other signs, and ends words with a mark.

    Under those rules (checked when it's made) a text's ids are its words' ids in order, whatever stands around them, and a comma or full stop between an
    ASCII letter and white space is a word of its own. Words are found and hashed in bulk and looked up in an open-addressing table by their 64-bit hashes; the
    table is bounded and begins anew when seven tenths are full; it grows only where one chunk of text holds more different words. New words are encoded together;
    where the word marks don't tell where each ends, one by one. Special tokens are matched in the text as it stands, and what lies between them is encoded as any text.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # words that only look like special tokens in lower case
        self.bare = Tokenizer(self.tokenizer.model)
        # the sign classes that this tokenizer cuts words by; others are left to the tokenizer itself
        self.parts: dict[str, np.ndarray] = {}
        self.cuts_latin = CUT_PATTERN in json.dumps(json.loads(self.tokenizer.to_str())["pre_tokenizer"])
        added = {a.content.encode(): i for i, a in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_ids = {w: np.array([i], np.int64) for w, i in added.items()}
        self.special = re.compile(b"(" + b"|".join(re.escape(w) for w in sorted(added, key=len, reverse=True)) + b")") if added else None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.small = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
        self.ends = np.zeros(len(vocabulary), bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.slots = slots
        self._clear()
        probe = "The  Quick,\tbrown fox.\nÉté, don't a,b x.. 12 naïve. x, y."
        if self.texts([probe.encode()])[0].tolist() != self._ids(probe):
            raise ValueError(f"{path}: words can't be encoded one by one")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int64)
        self.size = np.zeros(self.slots, np.int64)  # a word may have any number of ids
        self.flat, self.used, self.count = np.zeros(1 << 16, self.small), 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        mask = np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, slot, -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            got = self.keys[slot[open_]]
            hit = got == h[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (got != 0)]
        return out

    def _put(self, h: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct new hashes with their ids, one after the other."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.count += len(h)
        slot, left = (h & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            where, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[where], self.at[where], self.size[where] = h[won], at[won], sizes[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (self.slots - 1)

    def _joined(self, tokenizer, texts: list[str]) -> tuple[np.ndarray, list[int]] | None:
        """Ids and sizes of words that are one word each to the tokenizer, encoded together; None where the marks don't tell where each ends."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, self.small)
        at = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(at, prepend=0).tolist()) if len(at) == len(texts) and at[-1] == len(ids) else None

    def _encode(self, words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(numbers of the words in another order, their ids, how many each has)."""
        texts = b"\n".join(words).decode().split("\n") if words else []
        # letters alone are one word to the tokenizer; of these, what no normaliser changes goes to the model by a shorter way
        simple, letters, mixed, rest = [], [], [], []
        for i, w in enumerate(words):
            if w.isalpha():  # a-z
                simple.append(i)
            elif LATIN.fullmatch(t := texts[i]) and t.lower() == t:
                (simple if t.isalpha() else mixed if self.cuts_latin else rest).append(i)
            else:
                (letters if t.isalpha() and t.lower().isalpha() else rest).append(i)
        order, flats, sizes = [], [np.zeros(0, self.small)], []

        def held(part, ids, n):
            order.extend(part)
            flats.append(ids)
            sizes.extend(n)

        for tokenizer, chosen in ((self.bare, simple), (self.plain, letters)):
            for k in range(0, len(chosen), 2000):
                part = chosen[k : k + 2000]
                got = self._joined(tokenizer, [texts[i] for i in part])
                if got is None:
                    rest += part
                else:
                    held(part, *got)
        if mixed:  # these are cut as the tokenizer cuts them, and the few different parts are encoded
            cut = [LATIN_PARTS.findall(texts[i]) for i in mixed]
            if len(self.parts) > MOST_PARTS:
                self.parts.clear()
            new = [x for x in dict.fromkeys(x for c in cut for x in c) if x not in self.parts]
            for k in range(0, len(new), 2000):
                part = new[k : k + 2000]
                got = self._joined(self.bare, part)
                if got is not None:
                    self.parts.update(zip(part, np.split(got[0], np.cumsum(got[1])[:-1]), strict=True))
            for i, c in zip(mixed, cut, strict=True):
                own = [self.parts.get(x) for x in c]
                if any(x is None for x in own):
                    rest.append(i)
                else:
                    order.append(i)
                    flats += own
                    sizes.append(sum(map(len, own)))
        for i in rest:
            own = np.array(self.plain.encode(texts[i], add_special_tokens=False).ids, self.small)
            held([i], own, [len(own)])
        return order, np.concatenate(flats), np.array(sizes, np.int64)

    def texts(self, docs: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, for texts of about a chunk together."""
        if self.special and any(b"<" in d for d in docs):
            split = [self.special.split(d) for d in docs]  # every second part is a special token
            if any(len(p) > 1 for p in split):
                own = iter(self.texts([x for p in split for x in p[::2]]))
                return [np.concatenate([self.special_ids[x] if i % 2 else next(own) for i, x in enumerate(p)]).astype(self.small) for p in split]
        raw = b"\n".join([b"", *docs, b""])
        low = raw.translate(LOWER)
        data = np.frombuffer(low, np.uint8)
        starts, ends = spans(data)
        # a comma or full stop after a letter a-z is cut off
        last, before = data[ends - 1], data[ends - 2]
        stop = ((last == 44) | (last == 46)) & (before >= 97) & (before <= 122)
        place = np.cumsum(stop) - stop + np.arange(len(starts))
        s, e = np.empty(len(starts) + stop.sum(), np.int64), np.empty(len(starts) + stop.sum(), np.int64)
        s[place], e[place] = starts, ends - stop
        s[place[stop] + 1], e[place[stop] + 1] = ends[stop] - 1, ends[stop]
        h = np.maximum(hash_spans(data, s, e), np.uint64(1))
        slot = self._find(h)
        if (slot < 0).any():
            where = np.flatnonzero(slot < 0)
            new, first = np.unique(h[where], return_index=True)
            where = where[first]
            if self.count + len(new) > self.slots * 7 // 10:
                new, where = np.unique(h, return_index=True)
                while len(new) > self.slots // 2:
                    self.slots *= 2
                self._clear()
            order, flat, sizes = self._encode([low[a:b] for a, b in zip(s[where].tolist(), e[where].tolist(), strict=True)])
            self._put(new[order], flat, sizes)
            slot = self._find(h)
        at, size = self.at[slot], self.size[slot]
        total = np.cumsum(size)
        ids = self.flat[np.repeat(at - total + size, size) + np.arange(total[-1] if len(total) else 0)]
        edge = np.concatenate([[0], total])[np.searchsorted(s, np.cumsum([1, *(len(d) + 1 for d in docs)]))]
        out = [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return out

    def whole(self, doc: bytes) -> np.ndarray:
        """The ids of a text of any length."""
        if len(doc) <= 2 * CHUNK:
            return self.texts([doc])[0]
        split = self.special.split(doc) if self.special else [doc]
        return np.concatenate([y for i, x in enumerate(split) for y in ([self.special_ids[x]] if i % 2 else (self.texts([p])[0] for p in pieces(x)))]).astype(self.small)


def _encoder(path: str) -> Encoder:
    """The worker's own encoder, with the words of its earlier tasks. A function of the module, as what a shipped function holds itself comes anew with each task."""
    return keep(path, lambda: Encoder(path))


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and how often each occurs. Ids of 16 bits are sorted by radix."""
    s = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.concatenate([first, [len(s)]]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode(path: str, window: int, vocabulary: int):
    """Rows of documents: doc_id, n, crcs of whole windows, rest (zstd), place (the row's in its task, so that equal rows differ). One row more a task: n = -1, rest: its
    document frequencies."""

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        encoder, pack = _encoder(path), zstandard.ZstdCompressor(level=1).compress
        df = np.zeros(vocabulary, np.int64)
        seen, place = False, TaskContext.get().partitionId() << 40
        for chunk in chunks(rows(batches, "doc_id", "text")):
            out = defaultdict(list)
            every = encoder.texts([t for _, t in chunk]) if len(chunk) > 1 else [encoder.whole(chunk[0][1])]
            for (doc_id, _), own in zip(chunk, every, strict=True):
                ids = np.append(own, encoder.small(END))
                n, seen = len(ids), True
                df[_terms(ids)[0]] += 1
                whole = n // window
                out["doc_id"].append(doc_id)
                out["n"].append(n)
                out["crcs"].append([zlib.crc32(ids[window * i : window * (i + 1)].astype("<u4").tobytes()) for i in range(whole)])
                out["rest"].append(pack(ids[whole * window :].tobytes()))
                out["place"].append(place := place + 1)
            yield batch(pa, out)
        if seen:
            yield batch(pa, {"doc_id": [None], "n": [-1], "crcs": [[]], "rest": [pack(df.tobytes())], "place": [0]})

    def batch(pa, out):
        types = {"doc_id": pa.int64(), "n": pa.int64(), "crcs": pa.list_(pa.int64()), "rest": pa.binary(), "place": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], list(types))

    return run


def _frequencies(batches):
    import pyarrow as pa
    import zstandard

    stay()
    for (data,) in rows(batches, "rest"):
        df = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["token", "df"])


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, tfs = zip(*(_terms(d) for d in docs), strict=True)
        lengths = np.array([len(t) for t in terms])
        own = np.repeat(np.arange(len(docs)), lengths)
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(tfs).astype(np.float64)
        size = np.array([len(d) for d in docs], np.float64)[own]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = own[order].astype(np.int32), weight[order].astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])
        self.terms, self.count = terms, len(docs)

    def scores(self, doc: int) -> np.ndarray:
        """Of all documents, for the terms of one."""
        t = self.terms[doc]
        start, size = self.first[t], self.first[t.astype(np.int64) + 1] - self.first[t]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.docs[at], self.weights[at], self.count)


def fill(sizes: list[int], neighbours, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length). neighbours(seed) gives scores of all documents."""
    left = np.array(sizes, np.int64)
    start = np.zeros(len(sizes), np.int64)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out = []

    def take(seq, i, n):
        seq.append((i, int(start[i]), int(n)))
        start[i] += n
        left[i] -= n

    for seed in order:
        if not left[seed]:
            continue
        seq: list[tuple[int, int, int]] = []
        room = window - int(left[seed])
        take(seq, seed, left[seed])
        scores = neighbours(seed) if room and left.any() else None
        while room and left.any():
            unused = np.flatnonzero(left)
            own = scores[unused]
            best = unused[np.lexsort((unused, -own))] if len(unused) <= BEST else unused[(top := np.argpartition(-own, BEST)[:BEST])[np.lexsort((unused[top], -own[top]))]]
            skipped = None
            for i in best.tolist():
                if left[i] <= room:
                    room -= int(left[i])
                    take(seq, i, left[i])
                elif skipped is None:
                    skipped = i
                if not room:
                    break
            if room and skipped is not None:
                take(seq, skipped, room)
                room = 0
        out.append(seq)
    return out


class Dealer:
    """The shard of a rest, by its content."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf.astype(np.float32)
        self.nodes = [(-1, -1, 0.0, 0, 1)]  # left, right (-1 in a leaf), threshold, first shard, shards
        self.cuts = np.zeros((1, DIMENSIONS), np.float32)
        self.projection = None

    def vectors(self, rests: list[np.ndarray]) -> np.ndarray:
        """Unit vectors of projected weights; of an empty rest, zeros."""
        if self.projection is None:
            self.projection = np.random.Generator(np.random.PCG64(20240607)).standard_normal((len(self.idf), DIMENSIONS), np.float32)
        out = np.zeros((len(rests), DIMENSIONS), np.float32)
        for i, ids in enumerate(rests):
            if len(ids):
                t, tf = _terms(ids)
                weight = self.idf[t] * (tf / (tf + K1)).astype(np.float32)
                out[i] = weight @ self.projection[t]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.float32(1e-9))

    def grow(self, vectors: np.ndarray, sizes: np.ndarray, shards: int) -> None:
        """Cut the sample until each leaf has its one shard."""
        nodes, cuts = [None], [np.zeros(DIMENSIONS, np.float32)]
        todo = [(0, np.arange(len(vectors)), 0, shards)]
        while todo:
            at, own, first, n = todo.pop()
            cut = self._cut(vectors[own], sizes[own], n) if n > 1 and len(own) >= LEAST else None
            if cut is None:
                nodes[at] = (-1, -1, 0.0, first, n)
                continue
            direction, threshold, left, n_left = cut
            nodes[at], cuts[at] = (len(nodes), len(nodes) + 1, threshold, first, n), direction
            todo += [(len(nodes), own[left], first, n_left), (len(nodes) + 1, own[~left], first + n_left, n - n_left)]
            nodes += [None, None]
            cuts += [cuts[0]] * 2
        self.nodes, self.cuts = nodes, np.array(cuts, np.float32)

    @staticmethod
    def _cut(v: np.ndarray, sizes: np.ndarray, n: int):
        """Direction, threshold, which are left of it, and their number of shards; None where all are alike."""
        centred = v - v.mean(0)
        side = centred @ np.linalg.eigh(centred.T.astype(np.float64) @ centred)[1][:, -1].astype(np.float32) < 0
        for _ in range(8):
            if side.all() or not side.any():
                return None
            a, b = v[side].mean(0), v[~side].mean(0)
            now = v @ (b - a) < (b - a) @ (a + b) / 2
            if (now == side).all():
                break
            side = now
        direction = (b - a).astype(np.float32)
        along = v @ direction
        order = np.argsort(along, kind="stable")
        mass = np.cumsum(sizes[order], dtype=np.float64)
        # as much of the tokens as whole shards hold, next to the cut of the means
        aim = min(n - 1, max(1, round(n * float(sizes[side].sum()) / mass[-1]))) / n
        threshold = float(along[order[min(len(v) - 1, int(np.searchsorted(mass, aim * mass[-1])) + 1)]])
        left = along < np.float32(threshold)
        if left.all() or not left.any():
            return None
        return direction, threshold, left, min(n - 1, max(1, round(n * float(sizes[left].sum()) / mass[-1])))

    def shards(self, rests: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        left, right, threshold, first, n = (np.array(x) for x in zip(*self.nodes, strict=True))
        at = np.zeros(len(rests), np.int64)
        if left[0] >= 0:
            v = self.vectors(rests)
            while len(open_ := np.flatnonzero(left[at] >= 0)):
                node = at[open_]
                at[open_] = np.where((v[open_] * self.cuts[node]).sum(1) < threshold[node], left[node], right[node])
        return first[at] + hashes % n[at]


def _rests(batches, small, more: str):
    """Batches of encoded documents in parts of few rows: the part, its rests, and a column of longs."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, [np.frombuffer(unpack(x), small) for x in part.column("rest").to_pylist()], np.array(part.column(more).to_pylist(), np.int64)


def _sampled(dealer: Dealer, small):
    def run(batches):
        import pyarrow as pa

        for _, rests, _ in _rests(batches, small, "h"):
            held = [r for r in rests if len(r)]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in dealer.vectors(held)], pa.binary()), pa.array([len(r) for r in held], pa.int64())], ["v", "size"])

    return run


def _deal(dealer: Dealer, small):
    def run(batches):
        import pyarrow as pa

        for part, rests, h in _rests(batches, small, "h"):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n", "crcs", "rest")), pa.array(dealer.shards(rests, h), pa.int64())], ["doc_id", "n", "crcs", "rest", "shard"])
        trim()

    return run


def deal(encoded: DataFrame, idf: np.ndarray, count: int, shards: int) -> DataFrame:
    """Rows of documents with their shard."""
    held = encoded.where("n >= 0")
    if shards == 1:
        return held.withColumn("shard", F.lit(0).cast("long"))
    small = np.uint16 if len(idf) <= 1 << 16 else np.uint32
    dealer = Dealer(idf)
    hashed = held.withColumn("h", F.xxhash64("doc_id", "place").bitwiseAND(F.lit((1 << 62) - 1)))
    sample = hashed.where(F.col("h") % -(-count // SAMPLE) == 0)
    got = sorted((bytes(r["v"]), r["size"]) for r in sample.mapInArrow(_sampled(dealer, small), "v binary, size long").collect())  # about SAMPLE rows of DIMENSIONS numbers
    dealer.projection = None  # made anew where it's used
    if got:
        dealer.grow(np.frombuffer(b"".join(v for v, _ in got), np.float32).reshape(-1, DIMENSIONS), np.array([n for _, n in got]), shards)
    else:
        dealer.nodes = [(-1, -1, 0.0, 0, shards)]
    return hashed.mapInArrow(_deal(dealer, small), "doc_id long, n long, crcs array<long>, rest binary, shard long")


def _pack(window: int, vocabulary: int, idf: np.ndarray, mean: float):
    def run(table):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        small = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        shard = table.column("shard")[0].as_py()
        docs = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "rest", "n", "crcs")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        out, sequence = defaultdict(list), shard << 32

        def piece(doc_id, n, start, length, crc, offset):
            for k, v in (("doc_id", doc_id), ("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", n), ("sequence_id", sequence), ("offset", offset)):
                out[k].append(v)

        rests, at = [], []
        for k, (doc_id, rest, n, crcs) in enumerate(docs):
            for i, crc in enumerate(crcs):
                piece(doc_id, n, i * window, window, crc, 0)
                sequence += 1
            ids = np.frombuffer(unpack(rest), small) if n % window else ()
            if len(ids):
                rests.append(ids)
                at.append(k)
        if rests:
            for seq in fill([len(r) for r in rests], Index(rests, idf, mean).scores, window):
                offset = 0
                for i, start, length in seq:
                    doc_id, _, n, crcs = docs[at[i]]
                    piece(doc_id, n, len(crcs) * window + start, length, zlib.crc32(rests[i][start : start + length].astype("<u4").tobytes()), offset)
                    offset += length
                sequence += 1
        return pa.table({k: pa.array(out[k], pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")})

    return run


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: a file that every worker has at the same path."""
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    encoded = staged(texts(documents).mapInArrow(_encode(path, window, vocabulary), "doc_id long, n long, crcs array<long>, rest binary, place long"), "encoded")
    total = encoded.where("n >= 0").agg(F.count("*"), F.sum("n"), F.sum(F.col("n") % window)).first()
    count, tokens, rest = (int(x or 0) for x in total)
    df = np.zeros(vocabulary, np.int64)
    for r in encoded.where("n < 0").select("rest").mapInArrow(_frequencies, "token int, df long").groupBy("token").agg(F.sum("df").alias("df")).collect():  # a row a token of the vocabulary
        df[r.token] = r.df
    idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
    shards = max(1, round(rest / shard_tokens))
    dealt = deal(encoded, idf, count, shards)
    release(spark)
    if shards > 1:  # some shards a task, however many there are
        dealt = dealt.repartition(min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_A_TASK))), "shard")
    return dealt.groupBy("shard").applyInArrow(_pack(window, vocabulary, idf, max(1.0, tokens / max(1, count))), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
