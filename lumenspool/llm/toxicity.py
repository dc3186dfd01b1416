"""Toxicity by nearest labelled examples: exact cosine of associated TF-IDF vectors over inverted lists.

Features are lower-cased letter runs and their first 4, 5 and 6 bytes (so that unseen inflections of
a known stem still count). The labelled examples are at most ``EXAMPLES`` of either label, those of
least hash, so the index is bounded whatever the tables' size. One task builds it, workers map it from the
shared folder. All their features, of both labels, form
the vocabulary; document frequencies are counted over all documents. A vector is the unit-length
TF-IDF over the vocabulary, each feature weighed by its association with the label (log-likelihood
ratio). Cosines depend on ratios of weights only, so no feature is cut and no number of labels is a bound.

Search is exact: features that ``DENSE`` of the examples have are rows of a matrix, multiplied for
``ROWS`` documents at once, in single precision; the others' lists are summed. Lists whose maxima together
bound what they can add by ``SLACK`` are left out; what may be among the nearest within that bound and the
rounding is scored again over all features, in double precision. Votes weigh by squared
cosine, those of a label by how rarely its examples were drawn; a prior of ``PRIOR_WEIGHT`` votes at
the labels' base rate, half the threshold at most, makes documents without evidence score that rate, so
that they are clean whatever the share of toxic labels.

Defined cases: null and empty texts, and texts without a vocabulary feature, score the prior's rate (0
if there is no label at all); rows of the same document are scored each; contradicting labels of one
doc_id count as toxic; null labels are left out; ties of cosine go to the smaller doc_id; of rows that
share a labelled doc_id the least text is the example. An example of a text equal to the scored one is no
neighbour of it, so that no text is scored by its own label; the doc_id has no part in a score. Extra
columns of the tables are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspool.llm import common
from lumenspool.llm import words as W

EXAMPLES, NEIGHBOURS = 3000, 12
#: Share of examples from which on a feature's list is a matrix row; documents searched at once. Both bound cost only.
DENSE, ROWS = 0.04, 128
#: Most that the lists left out of a first search may add to a cosine; bounds cost only.
SLACK = 0.002
#: More than the relative rounding of a cosine, a sum of positive terms, in single precision.
ROUNDING = 1e-4
PRIOR_WEIGHT, THRESHOLD = 0.5, 0.3
PREFIXES = (4, 5, 6)

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes of all rows, first): whole letter runs, then their prefixes, row by row in any order."""
    low = W.LOWER[data]
    starts, ends, first = W.words(offsets, low, _NOT_LETTER)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes = W.SpanHasher(low)
    found, rows = [hashes(starts, ends)], [row]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        found.append(hashes(starts[long], starts[long] + n) ^ np.uint64(n))
        rows.append(row[long])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(row[order], np.arange(len(offsets)))


def text_hashes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """64-bit hash of each whole text."""
    return W.span_hashes(data, offsets[:-1], offsets[1:])


class Lookup:
    """Places in sorted hashes, by a table of where each range of leading bits begins."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.size, self.shift = len(keys), np.uint64(64 - bits)
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are keys, their places)."""
        at = self.start[hashes >> self.shift]
        live = np.flatnonzero(self.keys[at] < hashes)
        while len(live):
            at[live] += 1
            live = live[self.keys[at[live]] < hashes[live]]
        hit = np.flatnonzero((self.keys[at] == hashes) & (at < self.size))
        return hit, at[hit]


def association(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of features and the label; a of n1 toxic and b of n0 clean examples have each."""
    total = np.zeros(len(a))
    for x, of, n in ((a, a + b, n1), (b, a + b, n0), (n1 - a, n1 + n0 - a - b, n1), (n0 - b, n1 + n0 - a - b, n0)):
        some = x > 0
        total[some] += x[some] * np.log(x[some] * ((n1 + n0) / n) / of[some])
    return 2 * np.maximum(total, 0)


def is_held_out(col: str = "doc_id") -> Column:
    return common.crc32_of_id(col) % 4 == 2


@dataclass
class Index:
    """The bounded example index: vocabulary (sorted hashes), weights, features and counts by example, and by feature a matrix row or a list."""

    made: dict[str, np.ndarray]
    base_rate: float
    vote: tuple[float, float]

    @staticmethod
    def arrays(vocabulary: np.ndarray, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, first: np.ndarray, of: np.ndarray, tf: np.ndarray, texts: np.ndarray) -> dict[str, np.ndarray]:
        """What the search needs. Example e has features of[first[e] : first[e + 1]] with counts tf and the text hash texts[e]."""
        n = len(ids)
        who = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
        values = (1 + np.log(tf)) * weight[of]
        norm = np.sqrt(np.bincount(who, weights=values * values, minlength=n))
        norm = np.where(norm > 0, norm, 1.0)
        exact = values / norm[who]
        values = exact.astype(np.float32)
        many = np.bincount(of, minlength=len(vocabulary))
        most = np.zeros(len(vocabulary), np.float32)
        np.maximum.at(most, of, values)
        often = np.flatnonzero(many >= max(1, DENSE * n))
        head = np.full(len(vocabulary), -1, np.int32)
        head[often] = np.arange(len(often))
        matrix = np.zeros((len(often), n), np.float32)
        dense = head[of] >= 0
        matrix[head[of[dense]], who[dense]] = values[dense]
        listed = np.flatnonzero(~dense)
        listed = listed[np.argsort(of[listed], kind="stable")]
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(head < 0, many, 0))]).astype(np.int32)
        return {"vocabulary": vocabulary, "weight": weight, "ids": ids, "labels": labels.astype(np.int64), "first": first, "of": of.astype(np.int32), "exact": exact, "texts": texts,
                "most": most, "head": head, "matrix": matrix.ravel(), "begin": begin, "examples": who[listed], "listed": values[listed]}

    def __post_init__(self):
        m = self.made
        self.ids, self.labels, self.n = m["ids"], m["labels"], len(m["ids"])
        self.lookup = Lookup(m["vocabulary"])
        self.matrix = m["matrix"].reshape(-1, max(1, self.n))
        self.places: dict[int, list[int]] = {}
        for e, x in enumerate(m["texts"].tolist()):
            self.places.setdefault(x, []).append(e)

    def counted(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(feature numbers, counts) of each row's hashes in the vocabulary."""
        hit, at = self.lookup.find(hashes)
        cut = np.searchsorted(hit, first)
        return [np.unique(at[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def nearest(self, rows: list[tuple[np.ndarray, np.ndarray]], own: list[int]) -> Iterator[list[tuple[float, object, int]]]:
        """(cosine, id, label) of the nearest examples of each row, nearest first; exact. own: hashes of the rows' texts."""
        for i in range(0, len(rows), ROWS):
            part, texts = rows[i : i + ROWS], own[i : i + ROWS]
            found = self._nearest(part, texts, SLACK)
            again = [r for r, x in enumerate(found) if x is None]
            if again:  # too near to 0 for lists to be left out
                for r, x in zip(again, self._nearest([part[r] for r in again], [texts[r] for r in again], 0.0), strict=True):
                    found[r] = x
            yield from found

    def _nearest(self, rows: list[tuple[np.ndarray, np.ndarray]], own: list[int], slack: float) -> list:
        """The nearest of each row; None where leaving out lists could hide one without any other feature in common."""
        m, n = self.made, self.n
        head, begin, weight, first = m["head"], m["begin"], m["weight"], m["first"]
        full = np.zeros(len(weight))
        at = np.concatenate([x for x, _ in rows])
        who = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
        q = (1 + np.log(np.concatenate([c for _, c in rows]))) * weight[at] if len(at) else np.zeros(0)
        norm = np.sqrt(np.bincount(who, weights=q * q, minlength=len(rows)))
        q = q / np.where(norm > 0, norm, 1)[who]
        # Least bounds first, row by row: their sums say which lists can be left out.
        starts = np.searchsorted(who, np.arange(len(rows) + 1))
        bound = q * m["most"][at]
        order = np.lexsort((bound, who))
        sums = np.cumsum(bound[order])
        sums -= np.concatenate([np.zeros(1), sums])[starts[:-1]][who]
        out = sums <= slack
        left_out = np.zeros(len(rows))
        np.maximum.at(left_out, who[out], sums[out])
        live = np.ones(len(at), bool)
        live[order[out]] = False
        dense, listed = live & (head[at] >= 0), live & (head[at] < 0)
        left = np.zeros((len(rows), len(self.matrix)), np.float32)
        left[who[dense], head[at[dense]]] = q[dense]
        score = left @ self.matrix
        rare, x = at[listed], q[listed].astype(np.float32)
        cut = np.searchsorted(who[listed], np.arange(len(rows) + 1))
        for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            many = begin[rare[a:b] + 1] - begin[rare[a:b]]
            where = np.repeat(begin[rare[a:b]] - np.cumsum(many, dtype=np.int32) + many, many)
            where += np.arange(len(where), dtype=np.int32)
            score[r] += np.bincount(m["examples"][where], weights=np.repeat(x[a:b], many) * m["listed"][where], minlength=n)
        for r, text in enumerate(own):
            if text in self.places:
                score[r, self.places[text]] = -1
        least = np.partition(score, n - NEIGHBOURS, axis=1)[:, n - NEIGHBOURS] if n > NEIGHBOURS else np.zeros(len(rows))
        cut, found = starts, []
        for r in range(len(rows)):
            low = least[r] * (1 - ROUNDING) - left_out[r] * (1 + ROUNDING)
            if left_out[r] > 0 and low <= 0:
                found.append(None)
                continue
            near = np.flatnonzero((score[r] >= low) & (score[r] > 0))
            mine = at[cut[r] : cut[r + 1]]
            full[mine] = q[cut[r] : cut[r + 1]]
            many = first[near + 1] - first[near]
            where = np.repeat(first[near] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            sums = np.bincount(np.repeat(np.arange(len(near)), many), weights=full[m["of"][where]] * m["exact"][where], minlength=len(near))
            full[mine] = 0
            best = [(c, i, y) for c, i, y in zip(sums.tolist(), self.ids[near].tolist(), self.labels[near].tolist(), strict=True) if c > 0]
            found.append(sorted(best, key=lambda x: (-round(x[0], 12), x[1]))[:NEIGHBOURS])
        return found

    def found(self, offsets: np.ndarray, data: np.ndarray) -> list[list[tuple[float, object, int]]]:
        """The nearest examples of each row of text; equal texts are looked at once."""
        if not self.n:
            return [[]] * (len(offsets) - 1)
        own = text_hashes(offsets, data)
        _, once, which = np.unique(own, return_index=True, return_inverse=True)
        if len(once) < len(own):
            part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in once.tolist()])
            offsets, data = np.concatenate([np.zeros(1, np.int64), np.cumsum((offsets[1:] - offsets[:-1])[once])]), part
        else:
            once = which = np.arange(len(own))
        best = list(self.nearest(self.counted(*features(offsets, data)), own[once].tolist()))
        return [best[k] for k in which.tolist()]

    def neighbours(self, at: np.ndarray, tf: np.ndarray, own: int = 0) -> list[tuple[float, object, int]]:
        return next(self.nearest([(at, tf)], [own])) if self.n else []

    def score(self, best: list[tuple[float, object, int]]) -> float:
        votes, prior = [0.0, 0.0], min(self.base_rate, THRESHOLD / 2)
        for cosine, _, label in best:
            votes[label] += self.vote[label] * cosine * cosine
        return (PRIOR_WEIGHT * prior + votes[1]) / (PRIOR_WEIGHT + sum(votes))


@dataclass(frozen=True)
class Model:
    """Where the index lies, the labels' base rate and what an example of either label stands for."""

    uri: str | None
    base_rate: float
    vote: tuple[float, float]

    def index(self) -> Index:
        """The index, mapped for one task, so that workers hold it no longer; empty where one of the labels has no example."""
        none = np.zeros(0, np.int64)
        made = common.arrays(self.uri, keep=False) if self.uri else Index.arrays(np.zeros(0, np.uint64), np.zeros(0), none, none, np.zeros(1, np.int64), none, none, np.zeros(0, np.uint64))
        return Index(made, self.base_rate, self.vote)


def _example_features(rows: DataFrame) -> DataFrame:
    """(doc_id, label, features, counts, text_hash) of the examples (doc_id, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text(batches, most=1 << 18):
            offsets, data = common.utf8_parts(batch.column(2))
            hashes, first = features(offsets, data)
            found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([f.view(np.int64) for f, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int32())),
                                   pa.array(text_hashes(offsets, data).view(np.int64))], ["doc_id", "label", "features", "counts", "text_hash"])

    return rows.mapInArrow(run, "doc_id long, label int, features array<long>, counts array<int>, text_hash long")


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Model:
    """The index from the labelled rows that ``train`` admits (all but the held-out ones by default). doc_id is a long."""
    spark = docs.sparkSession
    common.ship(spark)
    train = ~is_held_out() if train is None else train
    known = labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [known.where(F.col("label") == x).orderBy("h", "doc_id").limit(EXAMPLES) for x in (0, 1)]
    sample = drawn[0].unionByName(drawn[1]).select("doc_id", "label")  # at most 2 x EXAMPLES rows
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    examples = common.materialize(_example_features(rows.select("doc_id", "label", "text")), "examples")
    n0, n1 = (r or 0 for r in examples.agg(F.sum(1 - F.col("label")), F.sum("label")).first())
    base = totals.get(1, 0) / max(1, sum(totals.values()))
    if not n0 or not n1:
        return Model(None, base, (1.0, 1.0))
    # What an example of a label stands for, labels' mean 1.
    stands = [totals.get(x, 0) / n for x, n in ((0, n0), (1, n1))]
    vote = tuple(min(1.0, s / max(stands)) for s in stands)
    root = common.shared_path(spark, "toxicity")

    def taken(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        """(ids, labels, first, hashes, counts, texts) of all examples, by label and id."""
        t = pa.Table.from_batches(list(batches)).sort_by([("label", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.list_value_length(t["features"]).to_numpy())])
        flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in t[name].chunks])
        return t["doc_id"].to_numpy(), t["label"].to_numpy().astype(np.int64), first, flat("features").view(np.uint64), flat("counts"), t["text_hash"].to_numpy().view(np.uint64)

    def name_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.unique(taken(batches)[3])
        common.publish(f"{root}/vocabulary", vocabulary=vocabulary)
        yield pa.record_batch([pa.array([len(vocabulary)])], ["n"])

    def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, n = Lookup(common.arrays(f"{root}/vocabulary", keep=False)["vocabulary"]), 0
        df = np.zeros(lookup.size, np.int64)
        for batch in common.by_text(batches):
            hashes, first = features(*common.utf8_parts(batch.column(0)))
            hit, at = lookup.find(hashes)
            cut = np.searchsorted(hit, first)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                df[np.unique(at[a:b])] += 1
            n += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["f", "n"])

    def publish_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(len(common.arrays(f"{root}/vocabulary", keep=False)["vocabulary"])), 0
        for batch in batches:
            f, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            df[f[f >= 0]] = n[f >= 0]
            total += int(n[f < 0].sum())
        common.publish(f"{root}/counts", df=df, total=np.array([total]))
        yield pa.record_batch([pa.array([total])], ["n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, first, hashes, tf, texts = taken(batches)
        vocabulary, counts = common.arrays(f"{root}/vocabulary", keep=False)["vocabulary"], common.arrays(f"{root}/counts", keep=False)
        of = np.searchsorted(vocabulary, hashes).astype(np.int32)
        both = np.bincount(of, minlength=len(vocabulary)).astype(float)
        toxic = np.bincount(of, weights=np.repeat(label, np.diff(first)), minlength=len(vocabulary))
        weight = (np.log((1 + int(counts["total"][0])) / (1 + counts["df"])) + 1) * association(toxic, both - toxic, n1, n0)
        common.publish(f"{root}/index", **Index.arrays(vocabulary, weight, ids, label, first, of, tf, texts))
        yield pa.record_batch([pa.array([len(ids)])], ["n"])

    # Bounded by EXAMPLES, so one task names the features, gathers their counts and builds the index.
    examples.coalesce(1).mapInArrow(name_features, "n long").collect()
    counted = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(count_documents, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    counted.coalesce(1).mapInArrow(publish_counts, "n long").collect()
    examples.coalesce(1).mapInArrow(build, "n long").collect()
    common.discard(examples)
    return Model(f"{root}/index", base, vote)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (the nearest examples: id, cosine, label) of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.index()
        for batch in common.by_text(batches):
            scores, why = [], []
            for best in own.found(*common.utf8_parts(batch.column(1))):
                scores.append(own.score(best))
                why.append([{"doc_id": d, "cosine": c, "label": y} for c, d, y in best])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(why, evidence)], ["doc_id", "score", "evidence"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")


def remove_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are; scored in the same pass."""
    spark = docs.sparkSession
    common.ship(spark)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.index()
        for whole in batches:
            text = whole.schema.get_field_index("text")
            column, at = whole.column(text), 0
            for batch in common.by_text(iter([pa.record_batch([column.fill_null("") if column.null_count else column], ["text"])])):
                keep = [not best or own.score(best) < threshold for best in own.found(*common.utf8_parts(batch.column(0)))]
                yield whole.slice(at, batch.num_rows).filter(pa.array(keep, pa.bool_()))
                at += batch.num_rows

    return docs.mapInArrow(run, schema)
