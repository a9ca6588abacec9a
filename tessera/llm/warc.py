"""WARC archives with a two-level capture index.

Writing: one gzip member per record, one archive a task, in the folder given. Records of equal payloads (of `least_bytes` or more): the one with the
largest page_id is the response, the others are revisits that refer to it. Payloads are compared by SHA-256; only (hash, page_id) rows are shuffled for that, and the
texts of revisits are never written.

Index: the lower level is sorted lines, one a capture, of the reversed-host key of its URL, page_id, archive, offset and length, in
compressed blocks of `block_lines`; the upper level is sparse: each index file ends with a directory of its blocks (first key, last key, offset, length), and the directory table has
one row an index file (first key, last key, where the file's directory is). A lookup bisects these rows, the file's directory and the block's lines, and then reads the record's range: after the
first lookup in a file, two range reads for a key. Files are in order of keys, as many as the tasks that wrote them; only their rows are ever on the driver or in a task.

Reading back goes the same way: the pages' distinct keys are sorted, each is bisected, and the lines found are read range by range in the archives' order.

Each attempt of a task writes an archive of its own, through a temporary name and a rename, and the capture rows that Spark commits name it. So a lost
executor's work is done again, and what a failed attempt left is never read. Any store that pyarrow.fs opens will do (file, hdfs, s3, gs).

Defined results: null html is an empty payload, null and empty urls have one key; rows with a null page_id are written too (as responses, never
referred to, key only by URL); repeated rows of one page_id are one record each, and the first by place is the response; an empty table has no archives.
"""

from __future__ import annotations

import bisect
import gzip
import uuid
import zlib
from collections import defaultdict
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, ship, staged
from tessera.llm.words import rows

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: com,example,www)/path?query, lower-case host, no scheme, port 80/443, fragment or leading www."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return (url or "").replace("\n", "%0A").replace(" ", "%20")
    labels = host.split(".")
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    key = ",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in key)


def store(path: str):
    """(file system, path in it) for a Hadoop-style path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One record; payload None: a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",  # rows of one page_id share it; their places tell them apart
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url or ""),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(named fields, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _base32_sha1(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(folder: str):
    """Rows (key, page_id, archive, offset, length) of the records put into one archive a partition."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own = TaskContext.get()
        files, root = store(folder)
        name = f"pages-{own.partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        partial, out, stream, at = f"{root}/.{name}", defaultdict(list), None, 0
        for page_id, url, html, refers in rows(batches, "page_id", "url", "html", "refers_to"):
            stream = stream or files.open_output_stream(partial, compression=None)
            payload, url = html or b"", (url or b"").decode()
            data = gzip.compress(record(page_id, url, None if refers is not None else payload, len(payload), _base32_sha1(payload), refers), LEVEL, mtime=0)
            stream.write(data)
            for k, v in (("key", surt(url)), ("page_id", page_id), ("archive", name), ("offset", at), ("length", len(data))):
                out[k].append(v)
            at += len(data)
        if stream:
            stream.close()
            files.move(partial, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.string()), pa.array(out["page_id"], pa.int64()), pa.array(out["archive"], pa.string()), pa.array(out["offset"], pa.int64()), pa.array(out["length"], pa.int64())], ["key", "page_id", "archive", "offset", "length"])

    return run


def _blocks(folder: str, block_lines: int):
    """Writes sorted capture lines in compressed blocks, then the file's directory; a row a file."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own = TaskContext.get()
        files, root = store(folder)
        name = f"index-{own.partitionId():06d}-{uuid.uuid4().hex[:12]}.gz"
        partial, directory, stream, at, held, lines = f"{root}/.{name}", [], None, 0, [], 0

        def flush():
            nonlocal stream, at, lines
            stream = stream or files.open_output_stream(partial, compression=None)
            data = gzip.compress(b"\n".join(held), LEVEL, mtime=0)
            stream.write(data)
            directory.append(b"%s %s %d %d" % (held[0].split(b" ")[0], held[-1].split(b" ")[0], at, len(data)))
            at, lines = at + len(data), lines + len(held)
            held.clear()

        for key, page_id, archive, offset, length in rows(batches, "key", "page_id", "archive", "offset", "length"):
            held.append(b"%s %s %s %d %d" % (key, b"-" if page_id is None else b"%d" % page_id, archive, offset, length))
            if len(held) >= block_lines:
                flush()
        if held:
            flush()
        if stream:
            data = gzip.compress(b"\n".join(directory), LEVEL, mtime=0)
            stream.write(data)
            stream.close()
            files.move(partial, f"{root}/{name}")
            first, last = (directory[i].split(b" ")[k].decode() for i, k in ((0, 0), (-1, 1)))
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([lines], pa.int64())], ["first", "last", "file", "offset", "length", "lines"])

    return run


class Finder:
    """Bisection in the sparse directory. files: rows (first, last, file, offset, length) in order of keys; one file's directory and one block are held."""

    def __init__(self, folder: str, files: list[tuple[str, str, str, int, int]]):
        self.store, self.root = store(folder)
        self.files, self.lasts = files, [f[1] for f in files]
        self.held: dict[str, tuple] = {}
        self.reads = 0

    def _read(self, kind: str, place: tuple[str, int, int]) -> list[list[str]]:
        if self.held.get(kind, (None,))[0] != place:
            with self.store.open_input_file(f"{self.root}/{place[0]}") as f:
                data = f.read_at(place[2], place[1])
            self.reads += 1
            self.held[kind] = (place, [line.split(" ") for line in gzip.decompress(data).decode().split("\n")])
        return self.held[kind][1]

    def lines(self, key: str) -> list[tuple[str, int | None, str, int, int]]:
        """The captures of a key: (key, page_id, archive, offset, length)."""
        out = []
        for f in range(bisect.bisect_left(self.lasts, key), len(self.files)):
            first, _, file, offset, length = self.files[f]
            if first > key:
                break
            blocks = self._read("directory", (file, offset, length))
            for b in range(bisect.bisect_left(blocks, key, key=lambda x: x[1]), len(blocks)):
                if blocks[b][0] > key:
                    break
                lines = self._read("block", (file, int(blocks[b][2]), int(blocks[b][3])))
                for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]:
                    out.append((line[0], None if line[1] == "-" else int(line[1]), line[2], int(line[3]), int(line[4])))
        return out

    def record(self, archive: str, offset: int, length: int) -> bytes:
        with self.store.open_input_file(f"{self.root}/{archive}") as f:
            self.reads += 1
            return zlib.decompress(f.read_at(length, offset), 31)


class Archives:
    """Archives and their index in one folder; directory: a row an index file."""

    def __init__(self, folder: str, directory: DataFrame):
        self.folder, self.directory = folder, directory
        self._files: list | None = None

    def files(self) -> list[tuple[str, str, str, int, int]]:
        """The upper level, in order of keys: as many rows as tasks wrote index files."""
        if self._files is None:
            self._files = sorted((r["first"], r["last"], r["file"], r["offset"], r["length"]) for r in self.directory.collect())
        return self._files

    def lookup(self, url: str, finder: Finder | None = None) -> list[tuple[dict[str, str], bytes]]:
        """All records of a URL, by page_id."""
        finder = finder or Finder(self.folder, self.files())
        found = [(line[1], parse(finder.record(*line[2:]))) for line in finder.lines(surt(url))]
        return [x for _, x in sorted(found, key=lambda x: (x[0] is None, x[0] or 0))]

    def find(self, urls: DataFrame) -> DataFrame:
        """urls (url) -> (key, page_id, archive, offset, length): all captures of their keys. Keys are sorted, so a task walks its part of the index once."""
        folder, files = self.folder, self.files()

        def keyed(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([surt((u or b"").decode()) for (u,) in rows([batch], "url")], pa.string())], ["key"])

        def run(batches):
            import pyarrow as pa

            finder = Finder(folder, files)
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            for batch in batches:
                held = []
                for (key,) in rows([batch], "key"):
                    held += finder.lines(key.decode())
                    if len(held) >= 10_000:  # a key may have any number of captures
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], t) for i, t in enumerate(types)], ["key", "page_id", "archive", "offset", "length"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], t) for i, t in enumerate(types)], ["key", "page_id", "archive", "offset", "length"])

        ship(urls.sparkSession)
        keys = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(keyed, "key string").distinct()
        return keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key string, page_id long, archive string, offset long, length long")

    def read(self, urls: DataFrame) -> DataFrame:
        """The records of urls (url), found through the index: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
        folder = self.folder

        def run(batches):
            import pyarrow as pa

            files, root = store(folder)
            name, f = None, None
            for batch in batches:
                out = []
                for archive, offset, length in rows([batch], "archive", "offset", "length"):
                    if archive != name:
                        if f:
                            f.close()
                        name, f = archive, files.open_input_file(f"{root}/{archive.decode()}")
                    fields, block = parse(zlib.decompress(f.read_at(length, offset), 31))
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, size, digest = fields["warc-type"], int(fields["warc-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or _base32_sha1(payload) != digest):
                        raise ValueError(f"{fields['warc-record-id']}: its payload isn't what its header says")
                    ids = [int(x) if (x := fields.get(n, "").removeprefix("<urn:page:").removesuffix(">")) else None for n in ("warc-record-id", "warc-refers-to")]
                    out.append((ids[0], size, digest, kind, ids[1], fields.get("warc-target-uri", "")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
                )
            if f:
                f.close()

        located = self.find(urls).select("archive", "offset", "length")
        return located.repartitionByRange(F.col("archive"), F.col("offset")).sortWithinPartitions("archive", "offset").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, block_lines: int = 1_000) -> Archives:
    """Write pages (page_id, url, html) into archives and index them."""
    spark = pages.sparkSession
    ship(spark)
    files, root = store(folder)
    files.create_dir(root, recursive=True)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hashes = own.where("page_id IS NOT NULL").select("page_id", F.sha2("html", 256).alias("h"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    last = hashes.groupBy("h").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").select("h", "refers_to")
    revisits = hashes.join(last, "h").where("page_id < refers_to").groupBy("page_id").agg(F.max("refers_to").alias("refers_to"))
    rowed = own.join(revisits.hint("shuffle_hash"), "page_id", "left")
    written = staged(rowed.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder), "key string, page_id long, archive string, offset long, length long"), "captures")
    ordered = written.repartitionByRange(F.col("key"), F.col("page_id")).sortWithinPartitions("key", "page_id", "archive", "offset")
    directory = staged(ordered.mapInArrow(_blocks(folder, block_lines), "first string, last string, file string, offset long, length long, lines long"), "directory")
    return Archives(folder, directory)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every page, written and read back through the index."""
    folder = f"{shared_dir(spark)}/tessera/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return write(pages, folder).read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', x[i])]), '') AS bits FROM m)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(1, 6), lambda k: CASE WHEN bits[5 * j + k] = '1' THEN CAST(power(2, 5 - k) AS INTEGER) ELSE 0 END))::INTEGER]), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b
"""
