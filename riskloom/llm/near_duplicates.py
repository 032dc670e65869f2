"""Files that share most of their text: MinHash LSH forest, then exact verification.

A file is its set of distinct runs of WORDS words; the similarity of two files is that of their sets (intersection over
union). Files with equal sets form a class, and only a class's representative goes on.

Forest. Each representative has TREES paths of DEPTH MinHash labels, packed into two integers. The paths of a tree are
sorted, so that its trie's subtries are runs of the sorted paths. Files that share a prefix of d labels are candidates with
probability s**d per tree. The search scans the sorted runs and takes, for each file and tree, the shortest prefix not
below BASE whose run has at most BUCKET files; BASE itself is the longest prefix whose recall over all trees,
1 - (1 - s**BASE)**TREES, reaches RECALL at the threshold. Partners of a file in a dense place may only meet it in its
dense runs, so its recall is reckoned from those trees alone where the prefix had to stay long; where it stays below
RECALL the file goes into another round of TREES trees with labels of their own, until all files have reached it (as no prefix is longer than DEPTH
labels, ROUNDS rounds are enough); a file with few dense trees is done before, as it shares more trees than those with any
partner. Files that agree in all DEPTH labels and are more than BUCKET are compared
in full, in blocks, as nearly all their pairs are results.

A scan holds at most BUCKET paths of a run. Runs that are too long for a task are found on a sample of the files and are
partitioned by longer prefixes from the start, which changes where they are scanned and how long their prefixes are, not
whether their recall is reached. The forest is made once per round and shuffled once.

Verification. The sets of candidates only are built again from the contents and intersected, so reported similarities
are exact (up to collisions of 64-bit hashes).

Copies. all_pairs reports every pair of files: classes are expanded whole, in blocks that are spread over tasks.
near_pairs is a shorter form: classes of up to COPIES files are expanded into their pairs, a larger class links each
member to its representative instead and near_groups carries the membership.

Defined results: null and empty contents and those with fewer than LEAST runs have no partner; rows that repeat a
file_id count once; contents of any length are processed whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import shingles as S
from riskloom.runtime import cut, small_side

THRESHOLD, LEAST = 0.6, 30
TREES, DEPTH, RECALL = 40, 7, 0.999
BASE = max(d for d in range(1, DEPTH) if 1 - (1 - THRESHOLD**d) ** TREES >= RECALL)
BUCKET, COPIES = 64, 1000
#: Dense trees of a file, all with prefixes DEPTH long, that reach RECALL.
NEEDED = math.ceil(math.log(1 - RECALL) / math.log(1 - THRESHOLD**DEPTH))


def _few(trees: int) -> int:
    """Largest number of shared paths of BASE labels that a partner at the threshold stays below, in so many trees, with
    probability 1 - RECALL. A file with no more dense trees has no partner that it shares but dense trees with."""
    p, below = THRESHOLD**BASE, 0.0
    for k in range(trees + 1):
        choose = math.lgamma(trees + 1) - math.lgamma(k + 1) - math.lgamma(trees - k + 1)
        below += math.exp(choose + k * math.log(p) + (trees - k) * math.log(1 - p))
        if below > 1 - RECALL:
            return k - 1
    return trees


#: Rounds after which every file has NEEDED dense trees or few enough.
ROUNDS = next(r for r in range(1, 1000) if _few(r * TREES) >= NEEDED)
#: Files of the sample that long runs are looked for in, and paths that one task may get of a run.
SAMPLE, RUN = 20_000, 50_000
#: Members of a class that a task joins with at once where all pairs are expanded.
BLOCK = 500


#: Hashings of the further rounds, so that none of their paths share a label.
MORE = math.ceil(TREES * DEPTH / S.PER_HASHING)


def _paths(turn: int) -> np.ndarray:
    """Bins that each tree's path takes its labels from. In the first round the first BASE labels of all trees differ, in
    further rounds, which are for dense places, all labels do."""
    rng = np.random.Generator(np.random.PCG64(7))
    if turn:
        return rng.permutation(MORE * S.PER_HASHING)[: TREES * DEPTH].reshape(TREES, DEPTH)
    assert TREES * BASE <= S.BINS
    heads = rng.permutation(S.BINS)[: TREES * BASE].reshape(TREES, BASE)
    tails = [rng.permutation(np.setdiff1d(np.arange(S.BINS), h))[: DEPTH - BASE] for h in heads]
    return np.hstack([heads, np.array(tails)])


def signatures(files: DataFrame, id_column: str = "file_id", least: int = LEAST, turn: int = 0) -> DataFrame:
    """(doc bigint, class binary, labels binary): the set's digest and its MinHash labels in a round, of files with enough
    runs."""
    factors = S.seeds(turn, MORE if turn else S.HASHINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, 1000):
                out: list[tuple] = []
                some = zip(ids.slice(start, 1000).to_pylist(), contents.slice(start, 1000).to_pylist())
                for key, text in some:
                    found = S.shingle_set(text)
                    if len(found) >= least:
                        out.append((key, xxhash.xxh3_128_digest(found.tobytes()), S.signature(found, factors).tobytes()))
                columns = zip(*out) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))],
                    names=["doc", "class", "labels"],
                )

    # a run of five words needs at least nine characters, and each further run two more
    narrow = files.select(files[id_column].cast("bigint"), files["content"])
    narrow = narrow.where(files["content"].isNotNull() & (F.length(files["content"]) >= 9 + least - 1))
    return narrow.mapInArrow(run, "doc bigint, class binary, labels binary")


def _forest(reps: DataFrame, turn: int) -> DataFrame:
    """(key bigint, rest bigint, doc bigint): one row per representative and tree; key is the tree and its first three
    labels, rest the others, both in the order of the path."""
    paths = _paths(turn)
    assert BASE == 3 and DEPTH == 7 and TREES < 1 << 15  # what two integers hold
    trees = np.arange(TREES, dtype=np.uint64) << np.uint64(48)

    def packed(labels: np.ndarray) -> np.ndarray:
        out = np.zeros(labels.shape[:-1], np.uint64)
        for k in range(labels.shape[-1]):
            out = (out << np.uint64(16)) | labels[..., k]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                docs = batch.column(0).slice(start, 1000).to_numpy(zero_copy_only=False)
                raw = b"".join(batch.column(1).slice(start, 1000).to_pylist())
                labels = np.frombuffer(raw, np.uint16).reshape(len(docs), -1).astype(np.uint64)[:, paths]
                key = (packed(labels[:, :, :BASE]) | trees).ravel()
                rest = (packed(labels[:, :, BASE:]) ^ np.uint64(1 << 63)).ravel()  # signed order is path order
                columns = [pa.array(c.view(np.int64)) for c in (key, rest)] + [pa.array(np.repeat(docs, TREES))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "rest", "doc"])

    return reps.select("doc", "labels").mapInArrow(run, "key bigint, rest bigint, doc bigint")


def _at(depth: int):
    """The labels behind BASE up to `depth`."""
    return F.shiftright("rest", 16 * (DEPTH - depth)) if depth > BASE else F.lit(0).cast("bigint")


def _long_runs(reps: DataFrame, turn: int, files: int) -> DataFrame | None:
    """(key, prefix, depth): prefixes of runs that are estimated to hold more than RUN files."""
    if files <= RUN:
        return None
    share = max(1, files // SAMPLE)
    some = _forest(reps.where(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0), turn)
    found, long_ = None, None
    for depth in range(BASE, DEPTH + 1):
        rows = some.select("key", _at(depth).alias("prefix"), "rest")
        if long_ is not None:
            rows = some.join(F.broadcast(long_.select("key", F.col("prefix").alias("_above"))), "key").where(F.col("_above") == _at(depth - 1))
            rows = rows.select("key", _at(depth).alias("prefix"), "rest")
        # a run of more than RUN files has RUN / share of the sample, so there are at most TREES * SAMPLE * share / RUN runs
        long_ = cut(rows.groupBy("key", "prefix").count().where(F.col("count") * share > RUN).select("key", "prefix"))
        if long_.isEmpty():
            break
        level = long_.withColumn("depth", F.lit(depth))
        found = level if found is None else found.unionByName(level)
    return found


class _Scan:
    """Candidates of one partition of sorted paths, read as a stream; see the module's text."""

    def __init__(self) -> None:
        empty = np.empty(0, np.int64)
        self.held = (empty, empty, empty, empty)
        self.large: dict[int, tuple[int, int]] = {}
        self.out: list[tuple[np.ndarray, np.ndarray, int]] = []

    def pairs(self, docs: np.ndarray, starts: np.ndarray, size: int) -> None:
        i, j = np.triu_indices(size, 1)
        a, b = docs[(starts[:, None] + i).ravel()], docs[(starts[:, None] + j).ravel()]
        keep = a != b
        self.out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], 0))

    def prefix(self, k: int, depth: int) -> tuple[int, int]:
        return int(self.key[k]), int(self.rest[k]) >> (16 * (DEPTH - depth)) if depth > BASE else 0

    def descend(self, low: int, high: int, depth: int, open_: bool) -> None:
        """Rows low to high share a prefix; `open_`: the next batch may bring more of them."""
        known = self.large.get(depth) == self.prefix(low, depth) or self.long[low] >= depth
        if high - low <= BUCKET and not known:
            if open_:
                self.held = tuple(c[low:high].copy() for c in (self.key, self.rest, self.doc, self.long))
                return
            if high - low > 1:
                self.pairs(self.doc, np.array([low]), high - low)
            if depth > BASE:
                own = np.unique(self.doc[low:high])
                self.out.append((own, own, depth))
            return
        if open_:
            self.large[depth] = self.prefix(low, depth)
        if depth == DEPTH:  # equal in all labels: compared in blocks; told by the path
            own = np.unique(self.doc[low:high])
            self.out.append((own, own, depth))
            self.out.append((own, np.full(len(own), hash(self.prefix(low, depth)), np.int64), -1))
            return
        labels = self.rest[low:high] >> (16 * (DEPTH - depth - 1))
        cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), high - low]
        for a, b in zip(cuts, cuts[1:]):
            self.descend(low + a, low + b, depth + 1, open_ and b == high - low)

    def feed(self, columns: tuple[np.ndarray, ...], last: bool) -> None:
        self.key, self.rest, self.doc, self.long = (np.concatenate(c) for c in zip(self.held, columns))
        self.held = tuple(c[:0] for c in self.held)
        n = len(self.key)
        if not n:
            return
        starts = np.concatenate([[0], np.flatnonzero(self.key[1:] != self.key[:-1]) + 1])
        sizes = np.diff(np.append(starts, n))
        plain = (sizes <= BUCKET) & (self.long[starts] < BASE)
        plain[0] &= self.large.get(BASE) != self.prefix(0, BASE)
        plain[-1] &= last
        for size in np.unique(sizes[plain]):
            if size > 1:
                self.pairs(self.doc, starts[plain & (sizes == size)], int(size))
        for k in np.flatnonzero(~plain):
            self.descend(int(starts[k]), int(starts[k] + sizes[k]), BASE, not last and k == len(starts) - 1)

    def taken(self) -> Iterator[pa.RecordBatch]:
        out, self.out = self.out, []
        if out:
            a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
            depth = np.repeat(np.array([x[2] for x in out], np.int32), [len(x[0]) for x in out])
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in (a, b, depth)], names=["a", "b", "depth"])


def _scanned(forest: DataFrame, long_: DataFrame | None) -> DataFrame:
    """(a, b, depth): with depth 0 a pair; with depth -1 a file and its run's number, for runs equal in all labels; else a
    file and the depth that its prefix had to keep in a tree."""
    rows = forest.withColumn("long", F.lit(0))
    place = [F.col("key")]
    if long_ is not None:
        bytes_ = long_.count() * 24
        for depth in range(BASE, DEPTH + 1):
            level = long_.where(F.col("depth") == depth).select("key", F.col("prefix").alias("_prefix"), F.lit(depth).alias("_depth"))
            rows = rows.withColumn("_prefix", _at(depth)).join(small_side(level, bytes_), ["key", "_prefix"], "left")
            rows = rows.select("key", "rest", "doc", F.coalesce("_depth", "long").alias("long"))
        # the rows of a long run go by one label more; of a run that is long at DEPTH, by the file, as it is not scanned
        deeper = F.expr(f"shiftright(rest, 16 * ({DEPTH - 1} - long))")
        place.append(F.when(F.col("long") >= DEPTH, F.xxhash64("doc")).when(F.col("long") >= BASE, deeper).otherwise(F.lit(0)))
    placed = rows.repartition(*place).sortWithinPartitions("key", "rest", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan()
        for batch in batches:
            scan.feed(tuple(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)), False)
            yield from scan.taken()
        scan.feed(tuple(np.empty(0, np.int64) for _ in range(4)), True)
        yield from scan.taken()

    return placed.select("key", "rest", "doc", F.col("long").cast("bigint")).mapInArrow(run, "a bigint, b bigint, depth int")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Pairs within large groups, by pairs of blocks: rows (key, count, doc) to (a, b)."""
    blocks = F.ceil(F.col("count") / BUCKET).cast("int")
    placed = rows.select("key", "doc", blocks.alias("blocks"), F.pmod(F.xxhash64("doc"), blocks).cast("int").alias("block"))
    left = placed.select("key", F.col("doc").alias("a"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = placed.select("key", F.col("doc").alias("b"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    joined = left.join(right, ["key", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def candidates(reps: DataFrame, count: int, again: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(a, b), a < b: distinct pairs of the `count` representatives to verify; `again` gives the labels that documents have
    in a further round."""
    found: list[DataFrame] = []
    left, losses = reps, None
    missing = math.log(1 - RECALL) + 1e-9
    for turn in range(ROUNDS):
        scanned = cut(_scanned(_forest(left, turn), _long_runs(left, turn, count)))
        found.append(scanned.where("depth = 0").select("a", "b"))
        equal = scanned.where("depth = -1").select(F.col("b").alias("key"), F.col("a").alias("doc")).distinct()
        if not equal.isEmpty():
            found.append(_block_pairs(equal.join(equal.groupBy("key").count(), "key")))
        loss = F.sum(F.log(1 - F.pow(F.lit(THRESHOLD), F.col("depth")))).alias("loss")
        now = scanned.where("depth > 0").groupBy(F.col("a").alias("doc")).agg(loss, F.count("*").alias("dense"))
        if losses is not None:
            before = losses.select("doc", F.col("loss").alias("loss_"), F.col("dense").alias("dense_"))
            total = [(F.coalesce(c, F.lit(0)) + F.col(c + "_")).alias(c) for c in ("loss", "dense")]
            now = before.join(now, "doc", "left").select("doc", *total)
        losses = cut(now.where((F.col("loss") > missing) & (F.col("dense") > _few(TREES * (turn + 1)))))
        short = losses.select("doc")
        count = short.count()
        if not count:
            break
        left = cut(again(small_side(short, count * 16), turn + 1))
    return _distinct(found)


def _distinct(found: list[DataFrame]) -> DataFrame:
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def verified(files: DataFrame, pairs: DataFrame, id_column: str = "file_id", threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of the pairs whose sets are similar enough."""
    wanted = cut(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc"))
    texts = files.select(files[id_column].cast("bigint").alias("doc"), files["content"]).where("content IS NOT NULL")
    texts = texts.join(small_side(wanted, wanted.count() * 16), "doc", "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                sets = [S.shingle_set(t).tobytes() for t in batch.column(1).slice(start, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, 1000), pa.array(sets, pa.binary())], names=["doc", "set"]
                )

    sets = cut(texts.mapInArrow(build, "doc bigint, set binary").dropDuplicates(["doc"]))
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b"
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                values.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["a", "b", "similarity"]
            )

    scored = both.select("a", "b", "set_a", "set_b").mapInArrow(judge, "a bigint, b bigint, similarity double")
    return scored.where(F.col("similarity") >= threshold)


def near_duplicates(files: DataFrame, id_column: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, similarity) between representatives; members (doc, rep), each class's files."""
    signed = cut(signatures(files, id_column))
    ids = signed.select("class", "doc").distinct()
    heads = ids.groupBy("class").agg(F.min("doc").alias("rep"))
    members = cut(ids.join(heads, "class").select("doc", "rep"))
    heads = members.where("doc = rep").select("doc")
    n = heads.count()
    # rows that repeat an id may bring their labels twice; a path that meets itself gives no pair
    reps = signed.select("doc", "labels").join(small_side(heads, n * 16), "doc", "left_semi")

    def again(docs: DataFrame, turn: int) -> DataFrame:
        texts = files.join(docs.withColumnRenamed("doc", "_doc"), files[id_column].cast("bigint") == F.col("_doc"), "left_semi")
        return signatures(texts, id_column, turn=turn).select("doc", "labels")

    links = verified(files, candidates(reps, n, again), id_column)
    return cut(links), members


def _ordered(pairs: DataFrame) -> DataFrame:
    """(file_a, file_b, similarity) of pairs (doc_a, doc_b, similarity), file_a < file_b."""
    return pairs.select(
        F.least("doc_a", "doc_b").alias("file_a"), F.greatest("doc_a", "doc_b").alias("file_b"), F.round("similarity", 6).alias("similarity")
    )


def all_pairs(files: DataFrame, id_column: str = "file_id") -> DataFrame:
    """(file_a, file_b, similarity), file_a < file_b: every pair, whatever the size of its classes."""
    links, members = near_duplicates(files, id_column)
    sizes = members.groupBy("rep").count()
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    placed = cut(members.join(sizes, "rep").select("doc", "rep", "count", F.pmod(F.xxhash64("doc"), blocks).cast("int").alias("block")))
    among = _block_pairs(placed.where("count > 1").select(F.col("rep").alias("key"), "count", "doc"))
    among = among.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.lit(1.0).alias("similarity"))
    across = links
    for side in ("a", "b"):
        ends = sizes.select(F.col("rep").alias(side), F.sequence(F.lit(0), blocks - 1).alias("all"))
        across = across.join(ends, side).withColumn(f"block_{side}", F.explode("all")).drop("all")
    for side in ("a", "b"):
        those = placed.select(F.col("rep").alias(side), F.col("block").alias(f"block_{side}"), F.col("doc").alias(f"doc_{side}"))
        across = across.join(those, [side, f"block_{side}"])
    return _ordered(across.select("doc_a", "doc_b", "similarity").unionByName(among))


def near_pairs(files: DataFrame, id_column: str = "file_id") -> DataFrame:
    """(file_a, file_b, similarity), file_a < file_b; a class of more than COPIES files by its representative only."""
    links, members = near_duplicates(files, id_column)
    a = members.select(F.col("doc").alias("doc_a"), F.col("rep").alias("a"))
    b = members.select(F.col("doc").alias("doc_b"), F.col("rep").alias("b"))
    sizes = members.groupBy("rep").count()
    large = sizes.where(F.col("count") > COPIES).select("rep")

    def expanded(side: DataFrame, rep: str) -> DataFrame:
        # a large class stands for itself by its representative
        kept = side.join(large.withColumnRenamed("rep", rep), rep, "left_anti")
        return kept.unionByName(large.select(F.col("rep").alias(f"doc_{rep}"), F.col("rep").alias(rep)))

    across = links.join(expanded(a, "a"), "a").join(expanded(b, "b"), "b").select("doc_a", "doc_b", "similarity")
    copies = members.where("doc > rep")
    to_rep = copies.select(F.col("rep").alias("doc_a"), F.col("doc").alias("doc_b"), F.lit(1.0).alias("similarity"))
    x = copies.join(large, "rep", "left_anti")
    among = x.select("rep", F.col("doc").alias("doc_a")).join(x.select("rep", F.col("doc").alias("doc_b")), "rep")
    among = among.where("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("similarity"))
    return _ordered(across.unionByName(to_rep).unionByName(among))


def components(links: DataFrame) -> DataFrame:
    """(doc, component) for undirected links (a, b): smallest document that links lead to, by alternating large-star
    and small-star steps; each step's links are written to the shared folder."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct())
        changed = after.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(after, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if changed:
            break
    tops = edges.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(tops)


def near_groups(files: DataFrame, id_column: str = "file_id") -> DataFrame:
    """(file_id, class_id, group_id, links): one row per file that has a partner; class_id is the smallest file of its
    equal set, group_id the smallest file that links lead to, links the number of other classes it is linked to."""
    links, members = near_duplicates(files, id_column)
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a")))
    degree = ends.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    group = components(links).select(F.col("doc").alias("rep"), "component")
    sizes = members.groupBy("rep").count()
    rows = members.join(sizes, "rep").join(degree, "rep", "left").join(group, "rep", "left")
    return rows.where("count > 1 OR links IS NOT NULL").select(
        F.col("doc").alias(id_column),
        F.col("rep").alias("class_id"),
        F.coalesce("component", "rep").alias("group_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
