"""Words of whole texts on the Python side, in bulk.

Texts are handled as UTF-8 bytes: every separator is ASCII, so byte and code-point views give the same words. Hashes are
64-bit: a polynomial over random byte values, mixed; equal words have equal hashes on every worker.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**63)) | 1
_POSITION = _rng.integers(1, 2**64, 64, dtype=np.uint64, endpoint=False) | np.uint64(1)
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z, and ASCII that is neither letter nor digit to a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SEP = np.zeros(256, bool)
_SEP[list(SPACES)] = True
CHUNK = 1 << 19
_powers: dict[str, np.ndarray] = {}
#: what this worker keeps between tasks, by key; the tasks that last asked for it and that last began
_kept: dict[str, object] = {}
_tasks: dict[str, int | None] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK * 2)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                table = np.full(size, np.uint64(base), np.uint64)
                table[0] = 1
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in bytes that begin and end with a separator."""
    sep = _SEP[data]
    change = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    return change[::2], change[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of byte ranges; none is empty or begins at 0."""
    up, down = _power(len(data))
    total = np.cumsum(_BYTE[data] * up[: len(data)])
    return mix((total[ends - 1] - total[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))


def pieces(doc: bytes) -> Iterator[bytes]:
    """A long text in parts, cut at separators."""
    at = 0
    while len(doc) - at > 2 * CHUNK:
        cut = max(doc.rfind(c, at, at + CHUNK) for c in (b" ", b"\n", b"\t", b"\r"))
        cut = cut if cut > at else min((x for c in (b" ", b"\n", b"\t", b"\r") if (x := doc.find(c, at + CHUNK)) >= 0), default=len(doc))
        yield doc[at:cut]
        at = cut
    yield doc[at:]


def hashed(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, in order, and where each text's begin (one more than texts)."""
    if len(docs) > 1 and sum(map(len, docs)) > 2 * CHUNK:
        parts = [hashed([d]) for d in docs]
        return np.concatenate([w for w, _ in parts]), np.cumsum([0, *(len(w) for w, _ in parts)])
    if docs and len(docs[0]) > 2 * CHUNK:
        every = np.concatenate([hashed([p])[0] if len(p) <= 2 * CHUNK else _hashed([p])[0] for p in pieces(docs[0])])
        return every, np.array([0, len(every)])
    return _hashed(docs)


def _hashed(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([b"", *docs, b""]), np.uint8)
    starts, ends = spans(data)
    at = np.cumsum([1, *(len(d) + 1 for d in docs)])
    return hash_spans(data, starts, ends), np.searchsorted(starts, at)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on, across texts too: len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _POSITION[0]
    for j in range(1, k):
        out += words[j : n + j] * _POSITION[j]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: len(x) - w + 1 of them."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def chunks(rows: Iterator[tuple], size: int = CHUNK) -> Iterator[list[tuple]]:
    """Rows (key, bytes, ...) in lists of about `size` bytes; a longer text comes alone. Between them freed memory goes back now and then."""
    held, total, number = [], 0, 0
    for row in rows:
        if held and total + len(row[1]) > size:
            yield held
            held, total, number = [], 0, number + 1
            if number % 32 == 0:
                trim()
        held.append(row)
        total += len(row[1])
    if held:
        yield held
    trim()


def rows(batches, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches; strings come as UTF-8 bytes."""
    import pyarrow as pa

    _begin()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # few rows at a time are Python objects
            columns = []
            for name in names:
                column = batch.column(name).slice(at, 256)
                if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                    column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
                columns.append(column.to_pylist())
            yield from zip(*columns, strict=True)


def trim() -> None:
    """Give freed memory back to the system, Arrow's too, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _task() -> int | None:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context and context.taskAttemptId()


def keep(key: str, make):
    """What a Python worker keeps between tasks that ask for it before their first row: made once, not once a task. It goes when a task that hasn't asked
    begins, so that it takes no memory from other operators: workers outlive stages."""
    stay()
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def stay() -> None:
    """What is kept outlives this task too: it's a step of the operator that keeps it. Called before the first row."""
    _tasks["asked"] = _task()


def _begin() -> None:
    """Once a task: what it hasn't asked for goes, and what earlier tasks have freed goes back."""
    task = _task()
    if _tasks.get("begun", -1) != task:
        _tasks["begun"] = task
        if _kept and _tasks["asked"] != task:
            _kept.clear()
            gc.collect()
        trim()


def compressed(docs, key: str = "doc_id"):
    """(key, z): texts as zstd frames, for shuffles that must carry whole texts."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            kept = [(k, pack(t)) for k, t in rows([batch], key, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([z for _, z in kept], pa.binary())], [key, "z"])

    return docs.mapInArrow(run, f"{key} long, z binary")
