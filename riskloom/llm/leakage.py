"""Held-out items that occur in a corpus, found by winnowing.

Of every window of W consecutive K-word hashes the smallest (the rightmost of equal ones) is a fingerprint, on both
sides. A shared run of at least W + K - 1 = MIN_WORDS words contains a whole window whose smallest hash both sides
select, so every such run yields a joined fingerprint. Joined fingerprints are then extended word by word in both
directions; a pair is reported if a run reaches MIN_WORDS, so there are neither misses nor chance hits.

Only fingerprints, and the texts of documents that share one, are shuffled. The item side, and the list of those
documents, are broadcast if their measured size allows it; beyond that the fingerprints are joined by salted keys, so that
a fingerprint of a third of all documents is spread over SALTS tasks, and the texts are filtered by a shuffled join. A pair
carries each shared fingerprint once, however often the texts repeat it.

Defined results: null, empty and wordless texts match nothing; texts of any length are processed whole; rows that
repeat an id count once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import words as W
from riskloom.runtime import BROADCAST_BYTES, cut, small_side

MIN_WORDS = 12
K = 8
WINDOW = MIN_WORDS - K + 1
#: Keys that a fingerprint is spread over where the item side is too large for a broadcast.
SALTS = 16
#: Places of shared fingerprints that a pair is extended from one by one; beyond it the run's length is searched for.
PLACES = 20_000


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: the rightmost minimum of every window."""
    if len(grams) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def fingerprints(df: DataFrame, id_column: str, text_column: str, name: str) -> DataFrame:
    """(name bigint, gram bigint): the distinct fingerprints of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = W.lower_words(text) if text else []
                if key is None or len(words) < MIN_WORDS:
                    continue
                hashes = W.grams(W.hashes(words), K)
                own = np.unique(hashes[winnow(hashes, WINDOW)])
                ids.append(np.full(len(own), key, np.int64))
                grams.append(own.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, grams)], names=[name, "gram"])

    narrow = df.select(df[id_column].cast("bigint"), df[text_column])
    return narrow.mapInArrow(run, f"{name} bigint, gram bigint")


def hits_of(doc: list[str], item: list[str], grams: list[int]) -> list[tuple[int, int]] | None:
    """Places (in doc, in item) of the shared fingerprints; None if there are more than PLACES."""
    shared = np.array(grams, np.int64)
    places = []
    for words in (doc, item):
        own = W.grams(W.hashes(words), K).view(np.int64)
        at = np.flatnonzero(np.isin(own, shared))
        found: dict[int, list[int]] = {}
        for k in at.tolist():
            found.setdefault(int(own[k]), []).append(k)
        places.append(found)
    if sum(len(at) * len(places[1].get(g, ())) for g, at in places[0].items()) > PLACES:
        return None
    return [(i, j) for g, at in places[0].items() for i in at for j in places[1].get(g, ())]


def longest_runs(doc: list[str], item: list[str], hits: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(words, start in doc, start in item) of the longest run that extends one of the hits; of equal ones the first."""
    best, done = (0, 0, 0), {}
    for i, j in sorted(hits):
        if done.get(i - j, -1) >= i:
            continue  # inside a run already extended on this diagonal
        a, b = i, j
        while a > 0 and b > 0 and doc[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        c, d = i, j
        while c < len(doc) and d < len(item) and doc[c] == item[d]:
            c, d = c + 1, d + 1
        done[i - j] = c - 1
        best = max(best, (c - a, -a, -b))
    return best[0], -best[1], -best[2]


def searched_run(doc: list[str], item: list[str]) -> tuple[int, int, int]:
    """The same for texts that repeat their fingerprints many times: the length is halved in on, and whether a common run
    of a length exists is told by the runs' hashes and then by their words; the cost does not grow with the repeats."""
    x, y = W.hashes(doc), W.hashes(item)

    def common(length: int) -> tuple[int, int] | None:
        a, b = W.spans(x, length), W.spans(y, length)
        firsts = {h: k for k, h in reversed(list(enumerate(b.tolist())))}
        for i in np.flatnonzero(np.isin(a, b)).tolist():
            j = firsts[int(a[i])]
            if doc[i : i + length] == item[j : j + length]:
                return i, j
        return None

    low, high, place = 0, min(len(doc), len(item)), (0, 0)
    while low < high:
        middle = (low + high + 1) // 2
        if found := common(middle):
            low, place = middle, found
        else:
            high = middle - 1
    return low, *place


def leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, words, doc_word, item_word): the longest shared run of each leaking pair."""
    probe = cut(fingerprints(items, item_id, text, "item_id").distinct())
    corpus = fingerprints(documents, doc_id, text, "doc_id")
    if probe.count() * 16 <= BROADCAST_BYTES:
        shared = corpus.join(F.broadcast(probe), "gram")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = corpus.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        shared = salted.join(probe.withColumn("salt", salts), ["gram", "salt"])
    pairs = cut(shared.groupBy("doc_id", "item_id").agg(F.collect_set("gram").alias("grams")))
    hit = cut(pairs.select("doc_id").distinct())
    texts = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("doc_text"))
    texts = texts.join(small_side(hit, hit.count() * 16), "doc_id", "left_semi")
    item_texts = items.select(items[item_id].cast("bigint").alias("item_id"), items[text].alias("item_text"))
    pairs = pairs.join(item_texts.dropDuplicates(["item_id"]), "item_id").join(texts, "doc_id")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = zip(*(batch.column(k).to_pylist() for k in range(5)))
            for doc, item, found, doc_text, item_text in rows:
                doc_words, item_words = W.lower_words(doc_text or ""), W.lower_words(item_text or "")
                places = hits_of(doc_words, item_words, found)
                words, a, b = searched_run(doc_words, item_words) if places is None else longest_runs(doc_words, item_words, places)
                if words >= MIN_WORDS:
                    out.append((doc, item, words, a, b))
            columns = zip(*out) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["doc_id", "item_id", "words", "doc_word", "item_word"],
            )

    return (
        pairs.select("doc_id", "item_id", "grams", "doc_text", "item_text")
        .mapInArrow(extend, "doc_id bigint, item_id bigint, words int, doc_word int, item_word int")
        .dropDuplicates(["doc_id", "item_id"])
    )
