"""Harmonic packing of token sequences into sequences of a fixed capacity.

Class k of the harmonic scheme takes lengths whose reciprocal share of the capacity C is k (C // length
= k) and fills each of its bins with exactly k pieces. Documents may be cut, so every document is cut
into full pieces of C tokens and a rest. A rest stays whole where its class's bins waste little on it, and is
else cut where that costs least: a further piece costs as much as ``CUT`` tokens of padding. Each length is filled by
itself, so that offsets in a bin are multiples of it. Workers number the pieces of each length by themselves;
a prefix sum over the (task, length) counts joins these numbers to global ones, and bin and offset of a
piece follow by division. What is left over of each length (fewer pieces than fill a bin, so bounded by
the capacity alone) is filled together, first fit, whatever the data's size.

Tokenization happens once; what it yields (a row a piece, no text) is kept in the shared folder, so
numbers cannot change when an executor is lost.

Defined cases: null text is empty; a document always has the end id, so an empty one is one piece of
one token; repeated rows are packed as often as they occur; an empty table gives an empty table. Only
doc_id and text are read, so extra columns do not matter. Texts are tokenized whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.llm import common
from lumenspool.llm.pretokens import PieceStore

CAPACITY, CUT, END_ID = 2048, 24, 1


@lru_cache
def cuts(capacity: int = CAPACITY, cut: int = CUT) -> list[list[int]]:
    """For each rest 0 .. capacity - 1 the piece lengths that sum to it at least cost, longest first.

    A piece costs ``cut`` tokens and its share of what a bin of C // length such pieces leaves empty.
    """
    lengths = np.arange(1, capacity)
    price = cut + (capacity % lengths) / (capacity // lengths)
    cost, last = np.zeros(capacity), np.zeros(capacity, int)
    for rest in range(1, capacity):
        every = price[:rest] + cost[rest - lengths[:rest]]
        last[rest] = rest - int(np.argmin(every[::-1]))  # ties: the longest
        cost[rest] = every[last[rest] - 1]
    best: list[list[int]] = [[]]
    for rest in range(1, capacity):
        best.append(sorted([int(last[rest]), *best[rest - last[rest]]], reverse=True))
    return best


def last_bins(left: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, int], int, int]]:
    """First-fit decreasing of the classes' left-over pieces (length, number): (piece, bin, offset)."""
    fill: list[int] = []
    out = []
    begin = 0
    for piece in sorted(left, reverse=True):
        while begin < len(fill) and fill[begin] == capacity:
            begin += 1
        b = next((k for k in range(begin, len(fill)) if fill[k] + piece[0] <= capacity), len(fill))
        if b == len(fill):
            fill.append(0)
        out.append((piece, b, fill[b]))
        fill[b] += piece[0]
    return out


_stores: dict[str, PieceStore] = {}


def token_store(path: str) -> PieceStore:
    """This process's encoder for a byte-level tokenizer file, pieces cached."""
    if path not in _stores:
        from tokenizers import Tokenizer

        # The printable stand-ins of bytes in byte-level vocabularies.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
        model = Tokenizer.from_file(path).model
        _stores[path] = PieceStore(lambda words: [[t.id for t in model.tokenize(w.decode("latin-1").translate(stand_in))] for w in words])
        _stores[path].model = model
    return _stores[path]


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, task, ordinal (of its length in its task), ids if asked for."""
    common.ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "ordinal"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, rests, task = token_store(path), cuts(capacity), TaskContext.get().partitionId()
        counts = [0] * (capacity + 1)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in common.by_text(batches):
            offsets, data = common.utf8_parts(batch.column(1))
            ids, first = store.rows(offsets, data)
            raw, bounds = ids.astype("<u4").tobytes(), (first * 4).tolist()
            where, out, kept = [], [[] for _ in range(5)], []
            for i in range(batch.num_rows):
                own = raw[bounds[i] : bounds[i + 1]] + end
                n = len(own) // 4
                at = 0
                for length in [capacity] * (n // capacity) + rests[n % capacity]:
                    part = own[4 * at : 4 * (at + length)]
                    where.append(i)
                    for column, value in zip(out, (at, length, zlib.crc32(part), n, counts[length]), strict=True):
                        column.append(value)
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32))
                    counts[length] += 1
                    at += length
            start, length, crc, total, ordinal = (pa.array(x, pa.int64()) for x in out)
            columns = [batch.column(0).take(pa.array(where, pa.int64())), start, length, crc, total, pa.array(np.full(len(where), task)), ordinal]
            yield pa.record_batch(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names)
        store.known = {}  # the worker goes on to other work

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, ordinal long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    pieces = common.materialize(cut_documents(docs, path, capacity, with_ids), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # At most one row a class: bounded by the capacity, and so are the pieces of part filled bins.
    bins, base, full, left = 0, {}, {}, []
    for length, n in sorted(counts.groupBy("length").agg(F.sum("n")).collect()):
        base[length], per = bins, capacity // length
        full[length] = n // per * per
        left += [(length, k) for k in range(full[length], n)]
        bins += n // per
    spark = docs.sparkSession
    classes = spark.createDataFrame([(x, base[x], full[x]) for x in base], "length long, _p_base long, _p_full long")
    tails = spark.createDataFrame([(*x, bins + b, at) for x, b, at in last_bins(left, capacity)], "length long, _p_number long, _p_bin long, _p_at long")
    per_bin = F.expr(f"{capacity} div length")
    numbered = pieces.join(starts, ["length", "task"]).withColumn("_p_number", F.col("ahead") + F.col("ordinal")).join(F.broadcast(classes), "length")
    in_full = F.col("_p_number") < F.col("_p_full")
    return numbered.join(F.broadcast(tails), ["length", "_p_number"], "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(in_full, F.col("_p_base") + F.floor(F.col("_p_number") / per_bin)).otherwise(F.col("_p_bin")).alias("sequence_id"),
        F.when(in_full, F.pmod("_p_number", per_bin) * F.col("length")).otherwise(F.col("_p_at")).alias("offset"), *["ids"] * with_ids)
