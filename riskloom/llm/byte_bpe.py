"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list. Each adjacent pair that has a merge rank is filed in the bucket of that
rank; a bucket holds list positions. Which buckets are filled is kept in a two-level bitmap over the ranks, so the next
rank is found with two find-first-set steps. Entries are never removed when a neighbouring merge makes them stale: the
position's current rank is compared when the entry is popped, and stale ones are skipped. Every pair is filed at most
twice per merge, so a pre-token of n bytes takes O(n log n) steps (the log from sorting a bucket), however long it is.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskloom.runtime import env_path

#: Folder of the public vocabulary files.
TOKENIZER_DIR = env_path("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split for ASCII texts, written for the standard library's faster engine. \x1c-\x1f are no white space here.
ASCII_PATTERN = re.compile(
    r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"
)
#: Pre-tokens whose ids a worker remembers before it starts anew; longer ones are not remembered.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48
#: log2 of the width of a bitmap node.
NODE = 8
LOW = (1 << NODE) - 1
#: Bits of an id in the key of a pair.
SHIFT = 20


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; under a megabyte, as the vocabulary is fixed."""
    with open(path, "rb") as f:
        return f.read()


class ByteBPE:
    """Encoder of one vocabulary; ids equal the ranks."""

    def __init__(self, rank_file: bytes):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.nodes = [0] * ((max(self.ranks.values()) >> NODE) + 1)
        self.split = regex.compile(PATTERN).findall
        self.pairs = merge_table(self.ranks)
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.cache = _Packed(self)

    def encode_pretoken(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        # the queue: positions by rank, and the bitmap of filled buckets (a node covers 1 << NODE ranks)
        buckets: dict[int, list[int]] = {}
        nodes, top = self.nodes, 0
        get, byte_ids = self.pairs.get, self.byte_ids
        ids = [byte_ids[b] for b in raw]
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        filed = [*[get(a << SHIFT | b, -1) for a, b in zip(ids, ids[1:])], -1]  # rank of the pair at a position; -1: none
        for i, rank in enumerate(filed):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    node = rank >> NODE
                    nodes[node] |= 1 << (rank & LOW)
                    top |= 1 << node
        while top:
            node = (top & -top).bit_length() - 1
            bits = nodes[node]
            low = bits & -bits
            rank = (node << NODE) + low.bit_length() - 1
            positions = buckets.pop(rank)
            nodes[node] = bits = bits ^ low
            if not bits:
                top ^= 1 << node
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                if filed[i] != rank:
                    continue  # stale
                j = right[i]
                ids[i] = rank
                filed[j] = filed[i] = -1
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    new = filed[i] = get(rank << SHIFT | ids[k], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            node = new >> NODE
                            nodes[node] |= 1 << (new & LOW)
                            top |= 1 << node
                h = left[i]
                if h >= 0:
                    new = filed[h] = get(ids[h] << SHIFT | rank, -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            node = new >> NODE
                            nodes[node] |= 1 << (new & LOW)
                            top |= 1 << node
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = right[i]
        return out

    def pretokens(self, text: str) -> list[str]:
        return ASCII_PATTERN.findall(text) if text.isascii() else self.split(text)

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as native 32-bit integers; nothing for an empty or null text."""
        if not text:
            return b""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, self.pretokens(text)))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def sizes(self, pretokens: list[str]) -> list[int]:
        """Number of ids of each pre-token."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        return [len(x) >> 2 for x in map(self.cache.__getitem__, pretokens)]


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of every pair of ids that merges; a pair's key is first << SHIFT | second."""
    table = {}
    for whole, rank in ranks.items():
        for cut in range(1, len(whole)):
            a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
            if a is not None and b is not None:
                table[a << SHIFT | b] = rank
    return table


class _Packed(dict):
    """Packed ids by pre-token, filled on demand."""

    def __init__(self, owner: ByteBPE):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> bytes:
        packed = array("i", self.owner.encode_pretoken(word.encode("utf-8", "replace"))).tobytes()
        if len(word) <= CACHE_CHARS:
            self[word] = packed
        return packed


_encoders: dict[int, ByteBPE] = {}


def encoder(rank_file: bytes) -> ByteBPE:
    """This process's encoder of a vocabulary, built once."""
    key = hash(rank_file)
    if key not in _encoders:
        _encoders[key] = ByteBPE(rank_file)
    return _encoders[key]


def broadcast_ranks(spark: SparkSession, folder: str | None = None, name: str = VOCABULARY):
    """The rank file (fixed size, under 1 MB) for the workers, so that only the driver needs the folder."""
    return spark.sparkContext.broadcast(read_ranks(f"{folder or TOKENIZER_DIR}/{name}"))


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = array("i", [0])
    total = 0
    for p in parts:
        total += len(p) >> 2
        offsets.append(total)
    flat = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(parts))])
    ends = pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets.tobytes())])
    return pa.ListArray.from_arrays(ends, flat)


def token_ids(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None
) -> DataFrame:
    """(id, ids array<int>): every row's text as token ids without special tokens.

    Defined results: an empty and a null text give the empty list, never null; a null id is kept; repeated rows stay
    repeated; an empty table gives an empty result; other columns are not read. Lone surrogates count as `?`.
    """
    ranks = broadcast_ranks(df.sparkSession, folder)
    out = df.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(ranks.value).packed
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start in range(0, max(1, batch.num_rows), 512):
                some = texts.slice(start, 512).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, 512), _lists([packed(t) for t in some])], names=["id", "ids"]
                )

    narrow = df.select(df[id_column].alias("id"), df[text_column].alias("text"))
    return narrow.mapInArrow(encode, f"id {out}, ids array<int>").withColumnRenamed("id", id_column)


