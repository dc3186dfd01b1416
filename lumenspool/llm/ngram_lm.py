"""Bigram language model in an Elias-Fano trie.

Level one is the vocabulary: all distinct training tokens as sorted 64-bit hashes with exact counts;
a word's id is its rank. Level two has, for each context word, its successors: their ids relative to the
context (each range of ids continues behind the last value of the range before, so the level is monotone),
monotone pointers from contexts to their first successor, and smoothed probabilities quantised to 256
levels. A successor is searched in its context's range between two pointers. Monotone
sequences are coded in blocks of ``BLOCK`` by Elias-Fano (upper parts in unary, lower parts in whole
bytes), each level is dealt over shards by hash, and each shard is one file in the shared folder that
workers memory-map (or read, where the folder is no local file system).

Smoothing: absolute discounting of bigram counts by ``DISCOUNT``, interpolated with the add-one
unigram. Every bigram of the training tokens is kept, those seen once too.

Contexts with more than 1 / (4 x shards) of all tokens deal their successors over all shards by the
pair; there are fewer than 4 x shards of them, and their mass goes to the driver.

Defined cases: null text is empty and has one token, the end; an empty training set scores by
add-one over nothing (1 / (V + 1) with V = 0); ids that repeat are scored each; extra columns are not
read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspool.llm import common
from lumenspool.llm import words as W

BLOCK, LEVELS, DISCOUNT = 4096, 256, 0.75
#: Decoded blocks that a sequence keeps, in memory only.
HELD_BLOCKS = 256
#: Tokens looked up at once, distinct keys that a task counts before it passes them on: both bound memory only.
GROUP_TOKENS, COUNT_KEYS = 1 << 20, 1 << 20
#: Word types that a model may have: two ids share 64 bits. A corpus with more is refused, never mixed up.
MOST_TYPES = 1 << 32
END = np.uint64(0xE0F0E0F0E0F0E0F0)


# Elias-Fano sequences


def ef_pack(x: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the blocks of a sorted uint64 sequence."""
    first, start, data, at = [], [], [], 0
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK] - x[i]
        n = len(part)
        width = min(7, (max(0, (int(part[-1]) // n).bit_length()) + 7) // 8)
        low = part.view(np.uint8).reshape(n, 8)[:, :width]
        high = (part >> np.uint64(8 * width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1, np.uint8)
        bits[high] = 1
        block = np.concatenate([np.array([width], np.uint8), np.ascontiguousarray(low).ravel(), np.packbits(bits, bitorder="little")])
        first.append(x[i])
        start.append(at)
        data.append(block)
        at += len(block)
    return {"first": np.array(first, np.uint64), "start": np.array([*start, at], np.uint64), "data": np.concatenate(data) if data else np.zeros(0, np.uint8), "n": np.array([len(x)], np.uint64)}


class EliasFano:
    def __init__(self, first: np.ndarray, start: np.ndarray, data: np.ndarray, n: np.ndarray):
        self.first, self.start, self.data, self.n = first, start, data, int(n[0])
        self.held: dict[int, np.ndarray] = {}

    def block(self, b: int) -> np.ndarray:
        if b not in self.held:
            if len(self.held) >= HELD_BLOCKS:
                self.held.clear()
            self.held[b] = self._decoded(b)
        return self.held[b]

    def _decoded(self, b: int) -> np.ndarray:
        raw = self.data[int(self.start[b]) : int(self.start[b + 1])]
        n, width = min(BLOCK, self.n - b * BLOCK), int(raw[0])
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = raw[1 : 1 + n * width].reshape(n, width)
        high = np.flatnonzero(np.unpackbits(raw[1 + n * width :], bitorder="little"))[:n] - np.arange(n)
        return out.view(np.uint64).ravel() + (high.astype(np.uint64) << np.uint64(8 * width)) + self.first[b]

    def find(self, q: np.ndarray) -> np.ndarray:
        """Places of sorted values in the sequence, -1 where absent. Only blocks that can have one are decoded."""
        out = np.full(len(q), -1, np.int64)
        if not self.n:
            return out
        b = np.searchsorted(self.first, q, "right") - 1
        cuts = np.flatnonzero(np.diff(b)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(q)], strict=True):
            if j > i and b[i] >= 0:
                own = self.block(int(b[i]))
                at = np.minimum(np.searchsorted(own, q[i:j]), len(own) - 1)
                out[i:j] = np.where(own[at] == q[i:j], at + int(b[i]) * BLOCK, -1)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at sorted places."""
        out = np.zeros(len(at), np.uint64)
        b = at // BLOCK
        cuts = np.flatnonzero(np.diff(b)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            if j > i:
                out[i:j] = self.block(int(b[i]))[at[i:j] - int(b[i]) * BLOCK]
        return out


def relative(ordinal: np.ndarray, successor: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, bases): successors sorted by context, each context's ids behind the last value of the context before; where each begins, and the end."""
    last = np.append(start[1:], len(successor)) - 1
    bases = np.concatenate([np.zeros(1, np.uint64), np.cumsum(successor[last] + np.uint64(1))])
    return bases[:-1][ordinal] + successor, bases


def find_successors(pointer: EliasFano, bases: EliasFano, values: EliasFano, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Places of (ordinal of context, successor) pairs, sorted, in the level; -1 where absent.

    Each is searched relative to its context's base, below the next context's; a place found lies between the context's
    pointer and the next.
    """
    new = np.flatnonzero(np.diff(context, prepend=-1))
    own, many = context[new], np.diff(np.append(new, len(context)))
    base, end = bases.get(own), bases.get(own + 1)
    low, high = (np.repeat(pointer.get(x).astype(np.int64), many) for x in (own, own + 1))
    out = np.full(len(context), -1, np.int64)
    inside = np.flatnonzero(successor < np.repeat(end - base, many))
    at = values.find(np.repeat(base, many)[inside] + successor[inside])
    out[inside] = np.where((at >= low[inside]) & (at < high[inside]), at, -1)
    return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes uint8, codebook): logarithms in bins, half of them even in numbers, half even in width, each at its mean."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(LEVELS)
    half = LEVELS // 2
    edges = np.unique(np.concatenate([np.quantile(x, np.arange(1, half) / half), np.linspace(x.min(), x.max(), half + 1)[1:-1]]))
    code = np.searchsorted(edges, x, "right")
    sums = np.bincount(code, weights=x, minlength=LEVELS)
    return code.astype(np.uint8), sums / np.maximum(1, np.bincount(code, minlength=LEVELS))


def _sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano(*(arrays[f"{name}_{k}"] for k in ("first", "start", "data", "n")))


def _packed(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{name}_{k}": v for k, v in ef_pack(x).items()}


def range_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of hashes so that shards are ranges in order."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Model:
    """What workers need besides the files: places, sizes and the mass of the contexts that are dealt over all shards."""

    def __init__(self, root: str, shards: int):
        self.root, self.shards = root, shards
        self.base = np.zeros(shards + 1, np.int64)  # first id of each vocabulary shard
        self.tokens = 0
        self.hot: dict[int, float] = {}  # id of a hot context: its discounted mass
        self.ready = False

    @property
    def types(self) -> int:
        return int(self.base[-1])

    @property
    def hot_count(self) -> float:
        return self.tokens / (4 * self.shards)

    def file(self, level: int, shard: int) -> dict[str, np.ndarray]:
        return common.arrays(f"{self.root}/level{level}-{shard:05d}.ef")

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, -1 if unknown; training counts) of sorted distinct hashes."""
        ids, n = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = range_shard(hashes, self.shards)
        for s in np.unique(shard).tolist():
            if self.base[s + 1] > self.base[s]:
                own = np.flatnonzero(shard == s)
                arrays = self.file(1, s)
                at = _sequence(arrays, "word").find(hashes[own])
                known = at >= 0
                ids[own[known]] = at[known] + self.base[s]
                n[own[known]] = arrays["count_book"][arrays["count"][at[known]]]
        return ids, n

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        n = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.base, ids, "right") - 1
        for s in np.unique(shard).tolist():
            arrays, own = self.file(1, s), shard == s
            n[own] = arrays["count_book"][arrays["count"][ids[own] - self.base[s]]]
        return n

    def shard_of(self, context: np.ndarray, successor: np.ndarray, n: np.ndarray) -> np.ndarray:
        code = context.astype(np.uint64) << np.uint64(32)
        code = np.where(n > self.hot_count, code | successor.astype(np.uint64), code)
        return (W.mix(code) % np.uint64(self.shards)).astype(np.int64)

    def pairs(self, context: np.ndarray, successor: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(discounted probability, 0 if not kept; backoff weight) of distinct pairs; n: the contexts' counts."""
        p, back = np.zeros(len(context)), np.ones(len(context))
        shard = self.shard_of(context, successor, n)
        for s in np.unique(shard).tolist():
            arrays = self.file(2, s)
            own = np.flatnonzero(shard == s)
            own = own[np.lexsort((successor[own], context[own]))]
            at = _sequence(arrays, "context").find(context[own].astype(np.uint64))
            own, at = own[at >= 0], at[at >= 0]
            if len(own):
                back[own] = np.exp(arrays["back_book"][arrays["back"][at]])
                place = find_successors(_sequence(arrays, "pointer"), _sequence(arrays, "base"), _sequence(arrays, "successor"), at, successor[own].astype(np.uint64))
                hit = place >= 0
                p[own[hit]] = np.exp(arrays["p_book"][arrays["p"][place[hit]]])
        if self.hot:
            hot = np.flatnonzero(n > self.hot_count)
            back[hot] = [1 - self.hot.get(c, 0.0) for c in context[hot].tolist()]
        return p, back

    def successors(self, context: int) -> np.ndarray:
        """Ids of the kept successors of a context, by its pointers."""
        found = []
        for s in range(self.shards):
            arrays = self.file(2, s)
            at = int(_sequence(arrays, "context").find(np.array([context], np.uint64))[0])
            if at >= 0:
                a, b = (int(x) for x in _sequence(arrays, "pointer").get(np.array([at, at + 1])))
                found.append(_sequence(arrays, "successor").get(np.arange(a, b)) - _sequence(arrays, "base").get(np.array([at])))
        return np.sort(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first): each row's words, then the end."""
    h, first = W.word_hashes(offsets, data)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _grouped(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows, tokens and starts of about GROUP_TOKENS tokens at a time, rows whole."""
    held, parts, many, size = [], [], [], 0
    for batch in common.by_text(batches):
        h, first = tokens(*common.utf8_parts(batch.column(text)))
        held.append(batch)
        parts.append(h)
        many.append(np.diff(first))
        size += len(h)
        if size >= GROUP_TOKENS:
            yield held, np.concatenate(parts), np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(many))])
            held, parts, many, size = [], [], [], 0
    if held:
        yield held, np.concatenate(parts), np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(many))])


class _Counter:
    """Counts of keys, passed on in sorted parts when there are many."""

    def __init__(self):
        self.keys, self.n, self.size = [], [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        out = _summed(np.concatenate(self.keys), np.concatenate(self.n)) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.__init__()
        return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(n, start)


def _taken(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All (key, n) of a shard's rows, summed; merged as they come, so only distinct keys are held."""
    count = _Counter()
    for batch in batches:
        count.add(batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy())
        if count.size > 4 * COUNT_KEYS:
            count.add(*count.merged())
    return count.merged()


def is_held_out(col: str = "doc_id") -> Column:
    return common.crc32_of_id(col) % 7 == 2


def fit(docs: DataFrame, train: Column | None = None) -> Model:
    """The model of the rows that ``train`` admits (all but the held-out ones by default)."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.where(~is_held_out() if train is None else train).select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shards = max(8, common.partitions(spark))
    model = Model(common.shared_path(spark, "lm"), shards)

    def rows_of(keys: np.ndarray, n: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(shard.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["shard", "key", "n"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter()
        for _, h, _first in _grouped(batches, 0):
            count.add(*np.unique(h, return_counts=True))
            if count.size > COUNT_KEYS:
                keys, n = count.merged()
                yield rows_of(keys, n, range_shard(keys, shards))
        keys, n = count.merged()
        yield rows_of(keys, n, range_shard(keys, shards))

    def build_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _taken(batches)
        book, code = np.unique(n, return_inverse=True)
        code = code.astype(np.uint8 if len(book) <= 256 else np.uint16 if len(book) <= 65536 else np.uint32)
        shard = TaskContext.get().partitionId()
        common.publish(f"{model.root}/level1-{shard:05d}.ef", **_packed("word", keys), count=code, count_book=book)
        yield pa.record_batch([pa.array([shard]), pa.array([len(keys)]), pa.array([int(n.sum())])], ["shard", "types", "tokens"])

    dealt = rows.mapInArrow(count_words, "shard int, key long, n long").repartitionById(shards, "shard")
    for shard, types, n in dealt.mapInArrow(build_words, "shard long, types long, tokens long").collect():
        model.base[shard + 1], model.tokens = types, model.tokens + n
    model.base = np.cumsum(model.base)
    if model.types > MOST_TYPES:
        raise ValueError(f"{model.types} word types: pairs of ids hold {MOST_TYPES} at most")
    common.release_shuffles(spark)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter()

        def out() -> pa.RecordBatch:
            code, n = count.merged()
            context, successor = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
            return rows_of(code, n, model.shard_of(context, successor, _counts_by_id(model, context)))

        for _, h, first in _grouped(batches, 0):
            distinct, inverse = np.unique(h, return_inverse=True)
            ids, seen = model.words(distinct)
            context, successor = _contexts(inverse, first, int(np.searchsorted(distinct, END)))
            code = ids[context].astype(np.uint64) << np.uint64(32) | ids[successor].astype(np.uint64)
            count.add(*np.unique(code, return_counts=True))
            if count.size > COUNT_KEYS:
                yield out()
        yield out()

    def build_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = _taken(batches)
        context, successor = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
        own, start, ordinal = np.unique(context, return_index=True, return_inverse=True)
        total = model.counts_of(own.astype(np.int64))
        p = (n - DISCOUNT) / total[ordinal]
        mass = np.bincount(ordinal, weights=p, minlength=len(own))
        codes, book = quantise(np.log(p))
        backs, back_book = quantise(np.log(np.maximum(1 - mass, 1e-12)))
        shard = TaskContext.get().partitionId()
        values, bases = relative(ordinal, successor, start)
        common.publish(f"{model.root}/level2-{shard:05d}.ef", **_packed("context", own), **_packed("pointer", np.append(start, len(code)).astype(np.uint64)),
                **_packed("successor", values), **_packed("base", bases), p=codes, p_book=book, back=backs, back_book=back_book)
        hot = total > model.hot_count
        yield pa.record_batch([pa.array(own[hot].astype(np.int64)), pa.array(mass[hot])], ["context", "mass"])

    if model.types:
        dealt = rows.mapInArrow(count_pairs, "shard int, key long, n long").repartitionById(shards, "shard")
        for context, mass in sorted(dealt.mapInArrow(build_pairs, "context long, mass double").collect()):
            model.hot[context] = model.hot.get(context, 0.0) + mass
        model.ready = True
        common.release_shuffles(spark)
    return model


def _counts_by_id(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts of sorted ids, each looked up once."""
    distinct, inverse = np.unique(ids, return_inverse=True)
    return model.counts_of(distinct)[inverse]


def _contexts(inverse: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, successor) of every token, as numbers of distinct tokens; a text starts after an end."""
    context = np.empty_like(inverse)
    context[1:] = inverse[:-1]
    context[first[:-1]] = end
    return context, inverse


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for held, h, first in _grouped(batches, 1):
            distinct, inverse = np.unique(h, return_inverse=True)
            ids, seen = own.words(distinct) if own.types else (np.full(len(distinct), -1), np.zeros(len(distinct), np.int64))
            one = (seen + 1) / (own.tokens + own.types + 1)
            log_p = base = np.log10(one)[inverse]
            if own.ready:
                context, successor = _contexts(inverse, first, int(np.searchsorted(distinct, END)))
                ok = np.flatnonzero(ids[context] >= 0)
                pair, back_at = np.unique(context[ok].astype(np.int64) << 32 | successor[ok], return_inverse=True)
                c, s = pair >> 32, pair & 0xFFFFFFFF
                # A pair with an unknown successor was not seen, but its context's weight counts.
                p, back = own.pairs(ids[c], np.where(ids[s] >= 0, ids[s], 0), seen[c])
                p = np.where(ids[s] >= 0, p, 0.0)
                log_p = base.copy()
                log_p[ok] = np.log10(p + back * one[s])[back_at]
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            many = np.diff(first)
            sums = [np.bincount(row, weights=x, minlength=len(many)) for x in (base, log_p)]
            known = np.bincount(row, weights=seen[inverse] > 0, minlength=len(many)).astype(np.int64)
            ids_out = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            yield pa.record_batch([ids_out, pa.array(many), pa.array(known), pa.array(np.full(len(many), own.tokens)), pa.array(sums[0]), pa.array(sums[1])],
                                  ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
