"""Files read by executors in parts: the beginnings of files, and the records of one huge JSON object.

Spark lists the files; tasks open them through pyarrow's file systems and read the bytes that they need.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemes whose files tasks can open.
OPENED = ("", "file", "hdfs", "s3", "s3a", "gs")

#: What separates two records: the end of a list, a comma, a key and the start of the next list. Inside a string a quote
#: is escaped, and records have no lists inside, so nothing else looks like it.
_BETWEEN = re.compile(rb'\]\s*,\s*("(?:[^"\\]|\\.)*"\s*:\s*\[)', re.S)
#: The longest key, with what stands around it.
_KEY_BYTES = 1 << 16


def can_open(path: str) -> bool:
    """Whether tasks can read parts of files there; else Spark has to read them whole."""
    return (path.split("://")[0] if "://" in path else "file" if path.startswith("file:") else "") in OPENED


def opened(path: str) -> pa.NativeFile:
    """A file for reading anywhere in it."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", path))
    where, inner = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))
    return where.open_input_file(inner)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, length) of all files below a folder, of a file or a glob; nothing is opened. Spark doesn't
    list files without bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def with_digests(files: DataFrame, size: int = 16_384) -> DataFrame:
    """files (path, ...) with digest: the first 16 hex digits of the SHA-256 of each file's first `size` bytes, read by
    executors; empty where a file can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    with opened(path) as f:
                        found.append(hashlib.sha256(f.read(size)).hexdigest()[:16])
                except OSError:
                    found.append("")
            yield batch.append_column("digest", pa.array(found, pa.string()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{kinds}, digest string")


def _records(f: pa.NativeFile, length: int, start: int, stop: int) -> bytes:
    """The members of a JSON object whose keys start after a separator in [start, stop), or at the object's own start, as the
    text of an object."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(max(0, min(n, length - at)))

    text = read(start, stop - start + _KEY_BYTES)
    if start == 0:
        first = text.find(b"{") + 1
        head = first if first else len(text)
    else:
        found = _BETWEEN.search(text)
        if found is None or start + found.start() >= stop:
            return b"{}"
        head = found.start(1)
    # The first separator at or after stop ends the last record; without one it is the end of the object.
    at = max(head, stop - start)
    while True:
        found = _BETWEEN.search(text, at)
        if found is not None:
            return b"{" + text[head : found.start() + 1] + b"}"
        if start + len(text) >= length:
            return b"{" + text[head:].rstrip().removesuffix(b"}") + b"}"
        at = max(head, len(text) - _KEY_BYTES)
        text += read(start + len(text), stop - start + _KEY_BYTES)


def json_lists(spark: SparkSession, path: str, key: str, fields: dict[str, str], part_bytes: int = 8 << 20) -> DataFrame:
    """(key, fields): a row for each object in the lists of a JSON object from keys to lists of flat objects.

    fields: name to "string" or "double"; others are left out, and what is missing or of another kind is null (numbers in
    strings count as numbers). A file holds one object. It is cut into ranges of part_bytes, which different tasks read: a range has the
    records whose separator starts in it. A record is one task's, however long. Keys may have 64 KiB.
    """
    ranges = listed(spark, path).select("path", "length", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(part_bytes).cast("long"))).alias("start"))

    def number(v: object) -> float | None:
        try:
            return None if v is None or isinstance(v, bool) else float(v)
        except (TypeError, ValueError):
            return None

    def plain(v: object) -> str | None:
        return v if v is None or isinstance(v, str) else json.dumps(v)

    cast = {"string": plain, "double": number}
    kinds = {"string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, start in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start"))):
                with opened(name) as f:
                    found = json.loads(_records(f, length, start, min(length, start + part_bytes)))
                rows = [(k, x) for k, many in found.items() for x in many or [] if isinstance(x, dict)]
                columns = [pa.array([k for k, _ in rows], pa.string()), *(pa.array([cast[t](x.get(c)) for _, x in rows], kinds[t]) for c, t in fields.items())]
                yield pa.RecordBatch.from_arrays(columns, [key, *fields])

    dealt = ranges.repartition("path", "start")
    return dealt.mapInArrow(run, f"`{key}` string, " + ", ".join(f"`{c}` {t}" for c, t in fields.items()))
