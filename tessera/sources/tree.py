"""Source trees and archives as tables (path, language, content, size, hash).

Spark's file sources skip names that begin with _ or a dot, so a tree is read by a Python data source of its own, format
"source_tree". Its partitions are slices of the sorted file list; only the slice's own files are read by a task.
"""

from __future__ import annotations

import io
import os
import subprocess
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators import classify as C
from tessera.session import ship

SCHEMA = "path string, content binary, error string"
MOST_BYTES = 1_000_000


class Slice(InputPartition):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root, names


def listed(root: str, extensions: set[str]) -> list[str]:
    """Files to read, sorted: what git knows of, else a walk without library and hidden folders."""
    try:
        out = subprocess.run(["git", "ls-files", "-z", "--cached", "--others", "--exclude-standard"], cwd=root, capture_output=True, check=True, timeout=60).stdout
        names = [n.decode(errors="replace") for n in out.split(b"\0") if n]
    except (OSError, subprocess.SubprocessError):
        names = []
        for folder, inside, files in os.walk(root):
            inside[:] = sorted(d for d in inside if d not in C.SKIP_FOLDERS and not d.startswith("."))
            names += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in files]

    def wanted(n: str) -> bool:
        *above, name = n.split("/")
        low = name.lower()
        return low.rpartition(".")[2] in extensions and ".min." not in low and not low.endswith(".bundle.js") and not any(p in C.SKIP_FOLDERS for p in above) and os.path.isfile(os.path.join(root, n)) and os.path.getsize(os.path.join(root, n)) <= MOST_BYTES

    return sorted({n for n in names if wanted(n)})


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.extensions = set(options.get("extensions", ",".join(C.LANGUAGES)).split(","))
        self.per = int(options.get("filesPerPartition", "256"))

    def partitions(self) -> list[InputPartition]:
        names = listed(self.root, self.extensions)
        return [Slice(self.root, names[i : i + self.per]) for i in range(0, len(names), self.per)] or [Slice(self.root, [])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for n in partition.names:
            try:
                with open(os.path.join(partition.root, n), "rb") as f:
                    yield n, f.read(), None
            except OSError as e:
                yield n, None, str(e)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, content, hash, error) of a source tree that all workers see."""
    ship(spark)
    spark.dataSource.register(SourceTree)
    found = spark.read.format("source_tree").load(root)
    return found.select("path", C.language(F.col("path")).alias("language"), "content", F.sha2("content", 256).alias("hash"), "error")


def read_zips(archives: DataFrame, most_files: int = 500, most_bytes: int = 60_000_000) -> DataFrame:
    """archives (path, content) -> (archive, path, content, skipped): entries of zip files without their common top folder. Links, encrypted entries and what
    would go over the limits are refused with a reason."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for name, data in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(data or b""))
                except zipfile.BadZipFile:
                    out.append((name, None, None, "not a zip file"))
                    continue
                infos = [i for i in z.infolist() if not i.is_dir()]
                tops = {i.filename.split("/")[0] for i in infos}
                cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in i.filename for i in infos) else 0
                total = count = 0
                for i in sorted(infos, key=lambda i: i.filename):
                    why = "link" if (i.external_attr >> 16) & 0o170000 == 0o120000 else "encrypted" if i.flag_bits & 1 else "too large" if i.file_size > MOST_BYTES or total + i.file_size > most_bytes else "too many files" if count >= most_files else None
                    content = None
                    if why is None:
                        with z.open(i) as f:
                            content = f.read(MOST_BYTES + 1)
                        if len(content) > MOST_BYTES:
                            content, why = None, "too large"
                        else:
                            total, count = total + len(content), count + 1
                    out.append((name, i.filename[cut:], content, why))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.string()))], ["archive", "path", "content", "skipped"])

    ship(archives.sparkSession)
    found = archives.select("path", "content").mapInArrow(run, "archive string, path string, content binary, skipped string")
    safe = C.safe_path(F.col("path"))
    reason = F.coalesce("skipped", F.when(safe.isNull(), "unsafe file names"), C.skip_reason(safe), F.when(F.instr(F.substring("content", 1, 8000).cast("string"), "\0") > 0, "binary"))
    return found.select("archive", F.coalesce(safe, "path").alias("path"), F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("skipped"))


def parse_diff(diffs: DataFrame) -> DataFrame:
    """diffs (id, text of a unified diff) -> hunks (id, path, old_path, status, old_start, old_len, new_start, new_len, lines), without Python: lines are
    numbered, file and hunk headers counted along, and each hunk's lines gathered."""
    from pyspark.sql import Window

    rows = diffs.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n")
    head = F.col("line").rlike("^@@ -[0-9]+")
    rows = rows.withColumn("file", F.sum(F.col("line").startswith("diff --git ").cast("int")).over(w)).withColumn("hunk", F.sum(head.cast("int")).over(w))
    per = Window.partitionBy("id", "file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.max(head.cast("int")).over(per)).where("file > 0")

    def said(prefix: str, pattern: str):
        return F.max(F.when((F.col("inside") == 0) & F.col("line").startswith(prefix), F.regexp_extract("line", pattern, 1)))

    files = rows.groupBy("id", "file").agg(
        said("diff --git ", "^diff --git a/.* b/(.*)$").alias("path"), said("rename from ", "^rename from (.*)$").alias("renamed"), said("diff --git ", "^diff --git a/(.*) b/").alias("old"),
        F.max(F.col("line").startswith("new file mode")).alias("added"), F.max(F.col("line").startswith("deleted file mode")).alias("deleted"),
    )
    number = lambda i: F.regexp_extract("head", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    length = lambda i: F.when(number(i) == "", 1).otherwise(number(i).try_cast("int"))
    hunks = rows.where("inside = 1").groupBy("id", "file", "hunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines")).withColumn("head", F.get("lines", F.lit(0)))
    status = F.when(F.col("added"), "added").when(F.col("deleted"), "deleted").when(F.col("renamed").isNotNull(), "renamed").otherwise("modified")
    return files.join(hunks, ["id", "file"], "left").select(
        "id", "path", F.when(~F.col("added"), F.coalesce("renamed", "old")).alias("old_path"), status.alias("status"),
        number(1).try_cast("int").alias("old_start"), length(2).alias("old_len"), number(3).try_cast("int").alias("new_start"), length(4).alias("new_len"), "lines",
    )
