"""Exact n-gram Jaccard self join over count-vector R-trees, grouped into components.

A document is the set of its distinct 5-word shingles (A-Z lower-cased), kept as 64-bit hashes.
Documents of equal sets form one class, known by a hash of the set, so copies are never paired.

Where classes meet: two sets with Jaccard >= t share one of their first n - ceil(t n) + 1 shingles in
any common order. The order is by hash, with shingles that lie in the first ones of more than ``HOT``
classes moved to the end, so common passages bring only those documents together that are made of
them. Each key's classes are the points of one small tree:

* a key of at most ``HOT`` classes is one leaf page; its pairs that fit in size go on;
* a hot key first yields a chain (neighbours in a key's own random order), enough to join most of a
  large group of near copies; then, once the components of what is linked are known, R-trees over
  the classes' count vectors find all pairs of different components that the bound allows. A pair is
  looked at only under the first hot key that its two classes share. A key's classes are dealt over
  blocks by size (powers of 4 / 3) and hash, at most about ``PAGE`` a block and each a tree of its own; only
  classes outside the key's largest component ask, in the blocks of their own and the two next sizes;
* moving hot shingles back brings others forward, some of which become common ("late" keys). They are
  found while sorted rows stream by and then go to the trees as well; a task that meets one often salts its
  further rows, so that at most a few rows a writing task meet in one.

Links are cut to spanning forests before components are labelled.

Count vectors: shingles are hashed into groups, as many as keep counts in a byte; a vector has the number of
shingles in each. Vectors of unlike length are folded to the shorter; the trees use GROUPS coordinates.
The sum of coordinate minima of two vectors bounds the overlap from above, and that of a vector and
the coordinate maxima of an R-tree node bounds it for all vectors below. Pairs within the bound are
verified on their shingles. Pairs inside a component need no look, so components are exact.

Defined cases: null, empty and blank texts have an empty set and link with nothing (their component is
their own doc_id); fewer than five words make one whole shingle; repeated rows of a doc_id, equal or
not, are classes' members like others; a null doc_id links like others and is the component's only where
there is no other; an empty table gives an empty table; extra columns are not read by
``groups`` and kept as they are by ``keep_one``. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenspool.llm import common
from lumenspool.llm import words as W
from lumenspool.llm.components import components, spanning_forest

SHINGLE, PERCENT = 5, 75
#: Classes of a key beyond which it is hot; classes of one block of a hot key, and of one part of its chain; hot keys sent to all tasks at most
#: (beyond, the limit for being hot doubles until they fit: the order stays common to all, so results do not change).
HOT, PAGE, CHAIN, HOT_KEYS = 32, 2048, 512, 200_000
GROUPS, FANOUT = 128, 16
#: Keys whose counts a writing task keeps to find late ones, and salts of such a key's rows.
WATCHED, SALTS = 4096, 1024
#: Bits a wanted id in the field by which tasks pass over other rows, and bits of one file of it.
MARK_BITS, MARK_FILE = 32, 1 << 20


def class_hash(s: np.ndarray) -> int:
    """Hash of a sorted shingle set, as a signed long; 0 for none."""
    if not len(s):
        return 0
    return int(W.mix(np.add.reduce(W.mix(s), keepdims=True) + np.uint64(len(s)))[0].view(np.int64)) or 1


def prefix(s: np.ndarray, hot: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles by which a set of sorted hashes meets others: cold ones by hash, then hot ones."""
    n = len(s)
    many = n - -(-percent * n // 100) + 1 if n else 0
    if not len(hot):
        return s[:many]
    is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
    return np.concatenate([s[~is_hot], s[is_hot]])[:many]


def counts(s: np.ndarray) -> np.ndarray:
    """Group counts of a set, one byte a group: GROUPS groups, doubled until a group has two shingles on average and 255 at most."""
    groups = GROUPS
    while 2 * groups < len(s):
        groups *= 2
    at = (s >> np.uint64(20)).astype(np.int64)
    while (many := np.bincount(at & (groups - 1), minlength=groups)).max() > 255:
        groups *= 2
    return many.astype(np.uint8)


def folded(vector: bytes, groups: int = GROUPS) -> np.ndarray:
    """Counts by fewer groups."""
    return np.frombuffer(vector, np.uint8).reshape(-1, groups).sum(0, dtype=np.int32)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least overlap of sets of n and m shingles with 100 x overlap >= percent x union."""
    return -(-percent * (n + m) // (100 + percent))


class CountTree:
    """R-tree of count vectors, bulk loaded: pages of ``FANOUT`` points and their coordinate maxima, level by level."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        # Points in order of size, then of the group that varies most, so that maxima stay tight.
        spread = vectors[:, int(np.argmax(vectors.var(0)))] if len(vectors) else sizes
        self.order = np.lexsort((spread, sizes))
        level, least = vectors[self.order].astype(np.int32), sizes[self.order]
        self.levels = [(level, least)]
        while len(level) > FANOUT:
            begin = np.arange(0, len(level), FANOUT)
            level, least = np.maximum.reduceat(level, begin), np.minimum.reduceat(least, begin)
            self.levels.append((level, least))

    def search(self, vector: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Numbers of the points whose bound allows an overlap that links."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            ok = np.minimum(top[nodes], vector).sum(1) >= least_overlap(least[nodes], size, percent)
            nodes = nodes[ok]
            if depth and len(nodes):
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]


def _sets(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in common.by_text(batches):
        offsets, data = common.utf8_parts(batch.column(text))
        yield batch, W.shingles(*W.word_hashes(offsets, data), SHINGLE)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def describe(docs: DataFrame, hot: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, h, hot, vector): set size, class, numbers of the prefix's hot shingles (null: none) and group counts of every row."""
    rows = _rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, 1):
            found: list[np.ndarray | None] = []
            for s in sets:
                p = prefix(s, hot, percent)
                numbers = np.minimum(np.searchsorted(hot, p), max(0, len(hot) - 1))
                own = numbers[hot[numbers] == p] if len(hot) else numbers[:0]
                found.append(own.astype(np.int32) if len(own) else None)
            yield pa.record_batch([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_hash(s) for s in sets], pa.int64()),
                pa.array(found, pa.list_(pa.int32())), pa.array([counts(s).tobytes() for s in sets], pa.binary())], ["doc_id", "n", "h", "hot", "vector"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, h long, hot array<int>, vector binary")


def _keys(docs: DataFrame, hot: np.ndarray, percent: int, full: bool) -> DataFrame:
    """A row a class and cold prefix shingle: key, and with ``full`` the class's h and n, and a salt.

    Salt 0, but for keys of which the task has already given more than 2 x HOT classes with salt 0 (counted
    by Misra and Gries' summary, which never counts too many): those of further classes are dealt over 1 .. SALTS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes that this task has given already; forgotten when many, which only repeats rows
        watched, weight = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, sets in _sets(batches, 0):
            key, own, size = [], [], []
            if len(seen) > 200_000:
                seen.clear()
                watched, weight = watched[:0], weight[:0]
            for s in sets:
                h = class_hash(s)
                if h in seen or not len(s):
                    continue
                seen.add(h)
                p = prefix(s, hot, percent)
                if len(hot):
                    p = p[hot[np.minimum(np.searchsorted(hot, p), len(hot) - 1)] != p]
                key.append(p)
                own.append(h)
                size.append(len(s))
            if key:
                many = [len(p) for p in key]
                keys = np.concatenate(key)
                columns = [pa.array(keys.view(np.int64))]
                if full:
                    h, n = (np.repeat(np.array(x, np.int64), many) for x in (own, size))
                    late = np.isin(keys, watched[weight > 2 * HOT])
                    salt = np.where(late, 1 + (W.mix(h.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
                    columns += [pa.array(x) for x in (h, n, salt)]
                    found, times = np.unique(keys[~late], return_counts=True)
                    watched, at = np.unique(np.concatenate([watched, found]), return_inverse=True)
                    weight = np.bincount(at, weights=np.concatenate([weight, times]), minlength=len(watched)).astype(np.int64)
                    if len(weight) > WATCHED:
                        weight = weight - np.partition(weight, -WATCHED - 1)[-WATCHED - 1]
                        watched, weight = watched[weight > 0], weight[weight > 0]
                yield pa.record_batch(columns, ["key", "h", "n", "salt"][: len(columns)])

    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "key long, h long, n long, salt long" if full else "key long")


def hot_keys(docs: DataFrame, percent: int = PERCENT) -> np.ndarray:
    """Sorted shingles that are in the prefixes of more than HOT classes, at most HOT_KEYS of them."""
    found = common.materialize(_keys(docs, np.zeros(0, np.uint64), percent, False).groupBy("key").count().where(F.col("count") > HOT), "hot")
    limit = HOT
    while found.where(F.col("count") > limit).count() > HOT_KEYS:
        limit *= 2
    keys = np.array([r.key for r in found.where(F.col("count") > limit).select("key").collect()], np.int64).view(np.uint64)
    common.discard(found)
    return np.sort(keys)


def _cold_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """What the keys that are not known as hot give, as rows (a, b, far, n).

    far 0 and 1: a pair of classes that fit in size, 0 for neighbours. far 2: class a, of size n, is under
    key b, which turned out to have more than 2 x HOT classes (or has a salt, which says the same).
    rows: key, h, n, salt, sorted by key, n, h in each partition. No more than one key's 2 x HOT classes are held.
    """
    large = 2 * HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, late_key = np.zeros((0, 3), np.int64), None

        def late(x: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in (x[:, 1], x[:, 0], np.full(len(x), 2), x[:, 2])], ["a", "b", "far", "n"])

        def once(x: np.ndarray) -> np.ndarray:
            same = np.zeros(len(x), bool)
            same[1:] = (x[1:, 0] == x[:-1, 0]) & (x[1:, 1] == x[:-1, 1])
            return x[~same]

        def pairs(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            x = once(x)
            _, run_of, run_size = np.unique(x[:, 0], return_inverse=True, return_counts=True)
            many = run_size[run_of] > large
            if many.any():
                yield late(x[many])
            x = x[~many]
            a, b, far, gap = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
            alive = np.arange(len(x))
            while len(alive):  # partners gap places on, at most ``large``
                alive = alive[alive + gap < len(x)]
                i, j = x[alive], x[alive + gap]
                alive = alive[(i[:, 0] == j[:, 0]) & (percent * j[:, 2] <= 100 * i[:, 2])]
                a.append(x[alive, 1])
                b.append(x[alive + gap, 1])
                far.append(np.full(len(alive), int(gap > 1), np.int64))
                gap += 1
            one, two, f = (np.concatenate(y) for y in (a, b, far))
            # Each pair once a slice, near before far.
            order = np.lexsort((f, np.maximum(one, two), np.minimum(one, two)))
            low, high, f = np.minimum(one, two)[order], np.maximum(one, two)[order], f[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            yield pa.record_batch([pa.array(c) for c in (low[new], high[new], f[new], np.zeros(int(new.sum()), np.int64))], ["a", "b", "far", "n"])

        for batch in batches:
            x = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            salted = batch.column(3).to_numpy() > 0
            if salted.any():
                yield late(x[salted])
                x = x[~salted]
            if late_key is not None:
                more = int(np.searchsorted(x[:, 0], late_key, "right"))
                if more:
                    yield late(x[:more])
                    x = x[more:]
            if not len(x):
                continue
            x, late_key = np.concatenate([rest, x]), None
            cut = int(np.searchsorted(x[:, 0], x[-1, 0], "left"))
            rest = once(x[cut:])
            if cut:
                yield from pairs(x[:cut])
            if len(rest) > large:
                late_key = rest[0, 0]
                yield late(rest)
                rest = rest[:0]
        if len(rest):
            yield from pairs(rest)

    return rows.select("key", "h", "n", "salt").mapInArrow(run, "a long, b long, far long, n long")


def _within_bound(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs whose count vectors allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = least_overlap(batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent).tolist()
            ok = []
            for v, w, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), least, strict=True):
                if len(v) == len(w):
                    bound = np.minimum(np.frombuffer(v, np.uint8), np.frombuffer(w, np.uint8)).sum()
                else:
                    groups = min(len(v), len(w))
                    bound = np.minimum(folded(v, groups), folded(w, groups)).sum()
                ok.append(bool(bound >= m))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(vectors.select("h", "vector", "n").toDF("a", "va", "na"), "a").join(vectors.select("h", "vector", "n").toDF("b", "vb", "nb"), "b")
    return joined.select("a", "b", "va", "vb", "na", "nb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(both) - shared))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    small = sets.select("h", "set")
    joined = pairs.join(small.toDF("a", "sa"), "a").join(small.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long")


def _hot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different roots under hot keys that the R-tree's bound allows.

    rows: number (of the key), block, asks (0: a point of the block, 1: a class of another root than the key's
    most common one that asks the block), h, n, hot, vector, root, sorted by number and block.
    """

    def page(x: pa.Table) -> tuple[list[int], list[int]]:
        number = x["number"][0].as_py()
        h, n, root, minor, asks = (x[c].to_numpy() for c in ("h", "n", "root", "minor", "asks"))
        points, asking = np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)
        if not len(points) or not len(asking):
            return [], []
        vectors = np.stack([folded(v) for v in x["vector"].to_pylist()])
        before = [[k for k in keys if k < number] for keys in x["hot"].to_pylist()]
        place = {k: i for i, k in enumerate(sorted({k for keys in before for k in keys}))}
        marks = np.zeros((len(h), max(1, len(place))), np.float32)
        for i, keys in enumerate(before):
            marks[i, [place[k] for k in keys]] = 1
        tree = CountTree(vectors[points], n[points])
        a, b = [], []
        for i in asking.tolist():
            j = points[tree.search(vectors[i], int(n[i]), percent)]
            # Where both classes ask, the lesser's question counts.
            j = j[(root[j] != root[i]) & ((minor[j] == 0) | (h[i] < h[j]))]
            if len(j):
                j = j[marks[j] @ marks[i] == 0]
            a += [int(h[i])] * len(j)
            b += h[j].tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> pa.RecordBatch:
            a, b = page(pa.Table.from_batches(held))
            low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
            both = np.unique(np.stack([low, high], 1), axis=0) if len(low) else np.zeros((0, 2), np.int64)
            return pa.record_batch([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if last is not None and last != (key[i], block[i]):
                    yield flush()
                    held = []
                last = (key[i], block[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield flush()

    return rows.mapInArrow(run, "a long, b long")


def _dealt(hot_rows: DataFrame, roots: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows of ``_hot_pairs``: hot_rows (h, n, number, hot) of keys with more than one root, as points and as questions."""
    labelled = hot_rows.join(roots.toDF("h", "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    shares = labelled.groupBy("number", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("number").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count(F.lit(1)).alias("roots"))
    band = F.floor(F.log("n") / math.log(4 / 3)).cast("long")
    rows = labelled.join(shares.where("roots > 1"), "number").withColumns({"band": band, "minor": (F.col("root") != F.col("major")).cast("int")})
    blocks = rows.groupBy("number", "band").agg(F.ceil(F.count(F.lit(1)) / PAGE).cast("long").alias("blocks"))
    columns = ["number", "band", "h", "n", "hot", "root", "minor"]
    points = rows.join(blocks, ["number", "band"]).select(*columns, F.pmod(F.xxhash64("h", F.lit(5)), "blocks").alias("salt"), F.lit(0).alias("asks"))
    near = rows.where("minor = 1").withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    asking = near.join(blocks, ["number", "band"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*columns, "salt", F.lit(1).alias("asks"))
    both = points.union(asking).withColumn("block", F.col("band") * (1 << 40) + F.col("salt"))
    return both.join(vectors.select("h", "vector"), "h").select("number", "block", "asks", "h", "n", "hot", "vector", "root", "minor")


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes of all rows: doc_id, n, h, hot; links between classes, enough to span all components: a, b)."""
    spark = docs.sparkSession
    common.ship(spark)
    parts = common.partitions(spark)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out = common.materialize(df, tag)
        common.release_shuffles(spark)
        return out

    hot = hot_keys(docs, percent)
    common.release_shuffles(spark)
    rows = keep(describe(docs, hot, percent), "classes")
    cold = _keys(docs, hot, percent, True).repartition(parts, "key", "salt").sortWithinPartitions("key", "n", "h")
    found = keep(_cold_pairs(cold, percent).groupBy("a", "b").agg(F.min("far").alias("far"), F.max("n").alias("n")), "cold")
    cold = found.where("far < 2").select("a", "b", "far")
    # A class and hot key a row, with all hot keys of the class; the chain goes through each part of a key's classes in the key's own random order.
    known = rows.where("hot is not null").groupBy("h", "n").agg(F.any_value("hot").alias("hot")).select("h", "n", F.explode("hot").alias("number"))
    ordered = spark.createDataFrame([(i, int(k)) for i, k in enumerate(hot.view(np.int64))], "number int, key long")
    hot_rows = known.join(F.broadcast(ordered), "number").select("h", "n", F.col("key").alias("number"))
    hot_rows = hot_rows.union(found.where("far = 2").select(F.col("a").alias("h"), "n", F.col("b").alias("number"))).distinct()
    lists = hot_rows.groupBy("h").agg(F.collect_list("number").alias("hot"))
    hot_rows = keep(hot_rows.join(lists, "h"), "hot-rows")
    blocks = hot_rows.groupBy("number").agg(F.ceil(F.count(F.lit(1)) / CHAIN).cast("int").alias("blocks"))
    w = Window.partitionBy("number", "salt").orderBy(F.xxhash64("number", "h"), "h")
    chain = hot_rows.join(blocks, "number").withColumn("salt", F.pmod(F.xxhash64("number", "h", F.lit(3)), "blocks")).select("h", "n", F.lead("h").over(w).alias("o"), F.lead("n").over(w).alias("m")).where(percent * F.greatest("n", "m") <= 100 * F.least("n", "m"))
    chain = keep(chain.where("o is not null").select(F.least("h", "o").alias("a"), F.greatest("h", "o").alias("b")).distinct(), "chain")
    # Count vectors of the classes that meet others, then shingles of those that the bound leaves.
    met = cold.select(F.explode(F.array("a", "b")).alias("h")).union(hot_rows.select("h")).distinct()
    vectors = keep(rows.where("n > 0").join(met, "h", "left_semi").groupBy("h").agg(F.any_value("n").alias("n"), F.any_value("vector").alias("vector"), F.min("doc_id").alias("doc_id")), "vectors")
    every = cold.select("a", "b", "far").union(chain.select("a", "b", F.lit(0).cast("long"))).groupBy("a", "b").agg(F.min("far").alias("far"))
    every = keep(every.join(_within_bound(every.select("a", "b"), vectors, percent), ["a", "b"]), "bounded")
    wanted = every.select(F.explode(F.array("a", "b")).alias("h")).union(hot_rows.select("h")).distinct()
    one = keep(vectors.join(wanted, "h", "left_semi").select("doc_id").where("doc_id is not null").distinct(), "ids")
    marks, files = _marks(one)
    sets = keep(_class_sets(docs, marks, files).join(wanted, "h", "left_semi"), "sets")
    common.remove(spark, marks)
    linked = keep(_verified(every.where("far = 0").select("a", "b"), sets, percent), "links")
    linked = keep(spanning_forest(linked), "links")
    # What is linked needs no further look: only pairs of different components go on.
    roots = components(linked)
    far = every.where("far = 1").select("a", "b")
    for c in ("a", "b"):
        far = far.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    far = far.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    dealt = _dealt(hot_rows, roots, vectors).repartition(parts, "number", "block").sortWithinPartitions("number", "block")
    rest = keep(far.union(_within_bound(_hot_pairs(dealt, percent).distinct(), vectors, percent)).distinct(), "bounded")
    more = keep(linked.union(_verified(rest, sets, percent)), "links")
    common.discard(sets, one, found, hot_rows, chain, every, vectors, rest, linked)
    linked = keep(spanning_forest(more), "links")
    common.discard(more)
    return rows, linked


def _mark(files: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(files * MARK_FILE))


def _marks(ids: DataFrame) -> tuple[str, int]:
    """(folder, number of files) of a bit field in which each of ids (a written table: doc_id) has its bit set; files without one are not written."""
    spark = ids.sparkSession
    files = max(1, -(-ids.count() * MARK_BITS // MARK_FILE))
    uri = common.shared_path(spark, "marks")

    def write(x: pa.Table) -> pa.Table:
        file = x["file"][0].as_py()
        field = np.zeros(MARK_FILE, bool)
        field[x["bit"].to_numpy()] = True
        common.publish(f"{uri}/{file}", bits=np.packbits(field, bitorder="little"))
        return pa.table({"file": pa.array([file], pa.int64())})

    at = ids.select(F.floor(_mark(files) / MARK_FILE).alias("file"), F.pmod(_mark(files), F.lit(MARK_FILE)).alias("bit"))
    at.groupBy("file").applyInArrow(write, "file long").count()
    return uri, files


def _class_sets(docs: DataFrame, marks: str, files: int) -> DataFrame:
    """(h, set), a row a class: the sets of all rows whose doc_id is marked or null, and of some others. No text is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[int, np.ndarray | None] = {}
        for batch in batches:
            mark = batch.column(0).to_numpy()
            file, bit = mark // MARK_FILE, mark % MARK_FILE
            ok = mark < 0
            for f in np.unique(file[~ok]).tolist():
                if f not in fields:
                    fields[f] = common.arrays(f"{marks}/{f}", keep=False)["bits"] if common.exists(f"{marks}/{f}") else None
                if fields[f] is not None:
                    here = np.flatnonzero(file == f)
                    ok[here] = (fields[f][bit[here] >> 3] >> (bit[here] & 7).astype(np.uint8)) & 1 == 1
            for _, sets in _sets(iter([batch.filter(pa.array(ok))]), 1):
                yield pa.record_batch([pa.array([class_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["h", "set"])

    rows = docs.select(F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(_mark(files)).alias("mark"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "h long, set binary").groupBy("h").agg(F.any_value("set").alias("set"))


def _labelled(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes of all rows: doc_id, n, h; a row a class: h, root, first, its least doc_id)."""
    rows, linked = links(docs, percent)
    least = rows.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("first"))
    roots = components(linked)
    joined = least.join(roots, least["h"] == roots["node"], "left").select("h", "first", F.coalesce("root", "h").alias("root"))
    ids = common.materialize(joined, "roots")
    common.discard(linked)
    return rows, ids


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), class_id of every row."""
    rows, ids = _labelled(docs, percent)
    component = ids.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = ids.join(component, "root").select("h", "component_id")
    return rows.join(of_class, "h", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("h").alias("class_id"))


def _with_class(docs: DataFrame, name: str) -> DataFrame:
    """docs with the class of each row's text (0: no words) as column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            text = whole.schema.get_field_index("text")
            at = 0
            column = whole.column(text)
            for part in common.by_text(iter([pa.record_batch([column.fill_null("") if column.null_count else column], ["text"])])):
                _, sets = next(_sets(iter([part]), 0))
                yield whole.slice(at, part.num_rows).append_column(name, pa.array([class_hash(s) for s in sets], pa.int64()))
                at += part.num_rows

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of docs a component: that of least doc_id (null last), then of least class.

    Rows that share that doc_id and its words are one; a row without words stays, rows that repeat its doc_id without words go.
    """
    rows, ids = _labelled(docs, percent)
    own = rows.where("n > 0").join(ids.select("h", "root"), "h")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first"))
    name = "_class"
    while name in docs.columns:
        name += "_"
    kept = first.select("first.doc_id", "first.h").union(rows.where("n = 0").select("doc_id", "h").distinct()).toDF("_k_id", "_k_class")
    keyed = _with_class(docs, name)
    # A class is in one component only, so a row stays if its class and doc_id are the kept ones.
    found = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["_k_id"]) & (keyed[name] == kept["_k_class"]), "left_semi")
    return found.dropDuplicates(["doc_id", name]).select(*[F.col(f"`{c}`") for c in docs.columns])
