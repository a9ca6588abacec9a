"""Packing: words of any length keep all their ids, neighbours meet in a shard."""

import base64
import random

from tokenizers import Tokenizer

from tessera.llm import packing


def test_words_of_more_than_65535_ids():
    r = random.Random(3)
    e = packing.Encoder(packing.default_tokenizer(), 1 << 12)
    for word in (base64.b64encode(r.randbytes(150_000)).decode(), "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(60_000))):
        text = f"one {word} two"
        want = e._ids(text)
        assert len(want) > 1 << 16
        assert e.whole(text.encode()).tolist() == want


def test_neighbours_meet_in_a_shard(spark):
    r = random.Random(5)
    words = sorted(w[:-4] for w in Tokenizer.from_file(packing.default_tokenizer()).get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha() and len(w) > 8)
    topics = [words[60 * k : 60 * k + 60] for k in range(16)]
    rows = [(16 * i + k, " ".join(r.choices(topics[k], k=60))) for i in range(30) for k in range(16)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=512, shard_tokens=2_000).collect()
    shards = {}
    for p in got:
        shards.setdefault(p.doc_id, set()).add(p.sequence_id >> 32)
    assert len(set.union(*shards.values())) > 8
    # of two documents of a topic, most often both are in one shard; dealt by hash one in 16 or so would be
    together = [bool(shards[a] & shards[b]) for k in range(16) for a in range(k, 480, 16) for b in range(k, a, 16)]
    assert sum(together) > 0.5 * len(together)


def test_equal_copies_are_spread_over_shards(spark):
    rows = [(i, "the same words again and again " * 10) for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=256, shard_tokens=3_000).collect()
    sizes = {}
    for p in got:
        sizes[p.sequence_id >> 32] = sizes.get(p.sequence_id >> 32, 0) + p.length
    assert len(sizes) > 3 and max(sizes.values()) < 8_000


def test_special_tokens_and_many_different_words():
    """A text of 1.5 million different words with special tokens; what looks like one only in lower case is ordinary text."""
    e = packing.Encoder(packing.default_tokenizer(), 1 << 12)
    for text in ("a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "É <|endoftext|><|endoftext|>c", "x < y <| z |>", "<|endoftext|>", "a's 'ts don'ts 1're2 ''s 's't x_y-z@q.org:80/?a=b#c $5.00 (it'll) 'd've a1b22 ~`^ é, «mot» ½ª 3²x ß! ÿ-Ā. l'été ¿qué? a\xadb c\xa0d e\x85f ŉ's \x7f\x1c"):
        assert e.texts([text.encode(), b"one"])[0].tolist() == e._ids(text), text
    text = " ".join(f"{i:x}" for i in range(1_500_000)) + " <|endoftext|> end <|startoftext|>"
    got = packing.Encoder(packing.default_tokenizer()).whole(text.encode())
    assert got[-3:].tolist() == e._ids("<|endoftext|> end <|startoftext|>")
    at = len(e._ids(text[:4000].rpartition(" ")[0]))
    assert got[:at].tolist() == e._ids(text[:4000].rpartition(" ")[0])


def test_equal_rows_without_an_id_are_spread(spark):
    rows = [(None, "the same words again and again " * 10)] * 300
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=256, shard_tokens=3_000).collect()
    assert len({p.sequence_id >> 32 for p in got}) > 3 and sum(p.length for p in got) == 300 * got[0].doc_tokens


def test_a_worker_makes_its_encoder_once():
    """Tasks of a worker load the shipped function anew each time; the encoder stays."""
    from pyspark.cloudpickle import dumps, loads

    path = packing.default_tokenizer()
    made = loads(dumps(packing._encode(path, 4096, 10)))
    assert made.__globals__["_encoder"] is packing._encoder
    assert packing._encoder(path) is packing._encoder(path)


def test_workers_let_the_encoder_go_when_other_work_begins(spark):
    """Workers outlive stages; in the pipeline what they kept was on top of the next operators' memory."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text").repartition(8).persist()

    def encoders(batches):
        import gc

        import pyarrow as pa

        from tessera.llm.words import rows

        n = sum(1 for _ in rows(batches, "doc_id"))
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Encoder" for x in gc.get_objects())]), pa.array([n])], ["encoders", "n"])

    packing.pack(docs).collect()
    got = docs.mapInArrow(encoders, "encoders long, n long").collect()
    docs.unpersist()
    assert sum(r.n for r in got) == 400 and not any(r.encoders for r in got)


def test_trim_gives_arrow_memory_back():
    import gc

    import pyarrow as pa

    from tessera.llm.words import trim

    def mb():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    trim()
    before = mb()
    held = [pa.array([b"%07d" % i * 30 for i in range(1_000)]).cast(pa.large_binary()).take(pa.array(range(1_000))) for _ in range(600)]
    grown = mb() - before
    del held
    gc.collect()
    trim()
    assert grown > 50 and mb() - before < grown / 4


def test_steps_of_packing_keep_the_encoder(monkeypatch):
    """A step of the same operator doesn't drop it, so the next packing finds it; another operator's first row does."""
    from tessera.llm import words

    own = object()
    monkeypatch.setattr(words, "_kept", {})
    monkeypatch.setattr(words, "_tasks", {})
    for task, step, stays in ((1, lambda: words.keep("x", lambda: own), True), (2, lambda: list(packing._frequencies(iter([]))), True), (3, lambda: list(words.rows([], "text")), False)):
        monkeypatch.setattr(words, "_task", lambda t=task: t)
        step()
        assert (words._kept.get("x") is own) == stays
