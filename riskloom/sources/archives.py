"""Members of package archives as rows.

Archives are read as binary files, one task per group of files; members are listed and unpacked on the executors, an
archive at a time, and go to the JVM in small batches. Classification of the members stays with built-in functions.

Defined results: what is neither a tar nor a zip archive, or is damaged, gives the members read so far and one row with
an error; members over the size limit have a null content; bytes that are no UTF-8 are replaced; directories and links
give no rows.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_BYTES = 500_000
TEXT = ("py", "pyw", "js", "mjs", "cjs", "ts", "tsx", "jsx", "json", "toml", "cfg", "md", "rst", "txt")
SCHEMA = "archive string, path string, basename string, size bigint, content string, bytes binary, error string"


def members(raw: bytes) -> Iterator[tuple[str, int, bytes | None]]:
    """(path, size, bytes or None) of a tar (compressed or not), zip or wheel."""
    stream = io.BytesIO(raw)
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, info.file_size, z.read(info) if info.file_size <= MEMBER_BYTES else None
        return
    stream.seek(0)
    with tarfile.open(fileobj=stream, mode="r:*") as t:
        for info in t:
            if info.isfile():
                yield info.name, info.size, t.extractfile(info).read() if info.size <= MEMBER_BYTES else None


def read_archives(spark: SparkSession, path: str, keep_bytes: bool = False) -> DataFrame:
    """Members of every archive below `path`, schema SCHEMA; contents of text files, bytes of the others if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("archive", "path", "basename", "size", "content", "bytes", "error")
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())

        def flush(rows):
            columns = zip(*rows) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=fields)

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                try:
                    for path_, size, data in members(raw):
                        is_text = path_.rpartition(".")[2].lower() in TEXT
                        text = data.decode("utf-8", "replace") if data is not None and is_text else None
                        rows.append((name, path_, path_.rpartition("/")[2], size, text, data if keep_bytes and not is_text else None, None))
                        held += size
                        if held > 16_000_000:
                            yield flush(rows)
                            rows, held = [], 0
                except Exception as e:  # noqa: BLE001 - any damage becomes a row
                    rows.append((name, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
                yield flush(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def binary_kinds(rows: DataFrame) -> DataFrame:
    """Adds kind (pe, elf, macho or null) by the first bytes, and the printable strings of six characters or more."""
    head = F.hex(F.substring("bytes", 1, 4))
    kind = F.when(head.startswith("4D5A"), "pe").when(head == "7F454C46", "elf").when(head.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE"), "macho")
    text = F.regexp_replace(F.decode("bytes", "ISO-8859-1"), r"[^\x20-\x7e]+", "\n")
    strings = F.array_sort(F.array_distinct(F.filter(F.split(text, "\n"), lambda s: F.length(s) >= 6)))
    network = F.slice(F.filter(strings, lambda s: s.rlike(r"https?://|\b(?:\d{1,3}\.){3}\d{1,3}\b")), 1, 10)
    return rows.withColumns({"kind": kind, "network_strings": network})
