"""Layers of encoded literals in source texts, decoded as long as they hold more.

Decoders: base64 calls and literals, hex literals, `\\x` escapes, lists of character codes and percent escapes. Layers are
followed up to LAYERS times; decoded text is appended for matching, the source stays as it is.

Defined results: null texts give no layers; what does not decode to printable text is left out; equal layers count once.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYERS, MOST_CHARS = 3, 5_000_000
_QUOTED = re.compile(r"[\"']([^\"'\n]{16,})[\"']")
_CODES = re.compile(r"fromCharCode\(\s*(\d{1,5}(?:\s*,\s*\d{1,5}){3,})\s*\)|bytes\(\s*\[\s*(\d{1,3}(?:\s*,\s*\d{1,3}){3,})\s*\]")


def _printable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    good = sum(c.isprintable() or c in "\t\r\n" for c in text)
    return text if text and good > 0.8 * len(text) else None


def decode_literal(value: str) -> tuple[str, str] | None:
    """(encoding, text) of a literal, if it is an encoded text."""
    if re.fullmatch(r"(?:\\x[0-9a-fA-F]{2}){4,}", value):
        text = _printable(bytes.fromhex(value.replace("\\x", "")))
        return ("escape", text) if text else None
    if re.fullmatch(r"(?:[0-9a-fA-F]{2}){10,}", value):
        text = _printable(bytes.fromhex(value))
        if text:
            return "hex", text
    if re.fullmatch(r"[A-Za-z0-9+/_-]{16,}={0,2}", value):
        try:
            text = _printable(base64.b64decode(value.replace("-", "+").replace("_", "/") + "=" * (-len(value) % 4), validate=True))
        except (binascii.Error, ValueError):
            text = None
        if text:
            return "base64", text
    if len(re.findall(r"%[0-9a-fA-F]{2}", value)) >= 4:
        return "url", unquote(value)
    return None


def layers_of(text: str) -> list[tuple[int, str, str]]:
    """(depth, encoding, text) of what a source hides."""
    out, seen, level = [], set(), [text]
    for depth in range(1, LAYERS + 1):
        below = []
        for source in level:
            found = [decode_literal(m[1]) for m in _QUOTED.finditer(source)]
            for m in _CODES.finditer(source):
                codes = [int(x) for x in re.split(r"\s*,\s*", m[1] or m[2])]
                if all(c < 0x110000 for c in codes):
                    found.append(("codes", "".join(map(chr, codes))))
            for f in found:
                if f and f[1] not in seen and sum(map(len, seen)) < MOST_CHARS:
                    seen.add(f[1])
                    out.append((depth, *f))
                    below.append(f[1])
        level = below
        if not level:
            break
    return out


def decoded_layers(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, depth, encoding, text): the decoded layers of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(key, d, e, t.encode("utf-8", "replace").decode()) for d, e, t in layers_of(text)]
            columns = zip(*rows) if rows else [[]] * 4
            kinds = (batch.column(0).type, pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "depth", "encoding", "text"])

    kind = texts.schema[id_column].dataType.simpleString()
    gate = F.col(text_column).rlike(r"[\"'][^\"'\n]{16,}[\"']|fromCharCode|bytes\(\s*\[")
    rows = texts.where(gate).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, depth int, encoding string, text string").withColumnRenamed("id", id_column)


def augmented(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text): each source followed by its decoded layers."""
    layers = decoded_layers(texts, id_column, text_column)
    joined = layers.groupBy(id_column).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "text"))), lambda x: x["text"]), "\n").alias("_more"))
    j = texts.select(id_column, text_column).join(joined, id_column, "left")
    return j.select(id_column, F.concat_ws("\n", text_column, "_more").alias(text_column))
