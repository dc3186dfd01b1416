"""Compression of vectors to short codes: a codebook for each of 16 parts, nearest entries by segment-mean bounds.

Components become integers floor(256 x); all that follows is exact. For a part and an entry, the squared distance is at
least, summed over equal blocks, (difference of block sums)^2 / length + (difference of residual norms)^2, where the
residual is what the block's mean leaves. The bound is taken over the whole part first, then over halves, quarters and
so on; an entry is left out as soon as its bound, lowered by more than any rounding, is above the exact distance of the
entry with the least coarse bound. Entries that are left get exact integer distances.

Codebooks hold 16 x 64 entries at most; tasks get them whole and give back a sum and count for each entry they used, so
that what reaches the driver is of fixed size. The table is read four times (first entries, two rounds, codes) and
nothing but codes is written.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; the smallest vec_id with a
vector that is not empty gives the length, and rows of another length are left out too; a length that 16 does not
divide is refused. Of equal vec_ids the lesser vector comes first, null vec_ids last; fewer than 64 rows give fewer entries; an empty
table gives an empty table. Components beyond 65,536 in size are refused with an error, since squared distances would
leave 64 bits. Repeated rows are coded each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspool.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest size of an integer component.
LARGEST = 1 << 24
#: Rows that the kernel works on at once.
ROWS = 4096
#: By how much a bound is lowered, in parts of what it was made from; rounding is below 1e-14 of it.
SLACK = 1e-10


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector is there and finite."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", "label", F.col(column).alias("vector"))


def to_integers(values: np.ndarray) -> np.ndarray:
    whole = np.floor(values.astype(np.float64) * SCALE)
    if whole.size and np.abs(whole).max() > LARGEST:
        raise ValueError(f"vector components beyond {LARGEST // SCALE} in size")
    return whole.astype(np.int64)


class Bounds:
    """Block sums and residual norms of rows (n, width) at every block length from the whole width down: (length, (n, 2 x blocks) features).

    The squared distance of two rows' features over the length is a lower bound of the rows' own squared distance.
    """

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        self.levels, length = [], width
        while True:
            blocks = rows.reshape(n, width // length, length)
            sums = blocks.sum(2)
            self.levels.append((length, np.hstack([sums.astype(np.float64), np.sqrt((length * (blocks * blocks).sum(2) - sums * sums).astype(np.float64))])))
            if length % 2 or length == 2:
                return
            length //= 2


def _bounds(length: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(n, m) lower bounds of all rows and entries as one matrix product, lowered by the slack."""
    size_x, size_y = (x * x).sum(1), (y * y).sum(1)
    return np.column_stack([x, (1 - SLACK) * size_x, np.ones(len(x))]) @ np.vstack([-2 * y.T, np.ones(len(y)), (1 - SLACK) * size_y]) / length


def _bounds_of(length: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same of pairs of rows and entries."""
    return (((x - y) ** 2).sum(1) - SLACK * ((x * x).sum(1) + (y * y).sum(1))) / length


def nearest(rows: np.ndarray, entries: np.ndarray, entry_bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each row's nearest entry, the lower index on ties; and how many exact distances that took.

    At each level the entry with the least bound gets its exact distance, and entries whose bound is above the least
    exact distance so far go. While more than an eighth of all pairs are left, a level is one matrix product.
    """
    n = len(rows)
    exact = lambda i, j: ((rows[i] - entries[j]) ** 2).sum(1)
    most, left, pairs, every = np.full(n, np.iinfo(np.int64).max), np.ones((n, len(entries)), bool), None, np.arange(n)
    for (length, x), (_, y) in zip(Bounds(rows).levels, entry_bounds.levels, strict=True):
        if pairs is None:
            bound = _bounds(length, x, y)
            most = np.minimum(most, exact(every, bound.argmin(1)))
            left &= bound <= most[:, None]
            if left.sum() * 8 <= left.size:
                pairs = np.nonzero(left)
        else:
            fine = _bounds_of(length, x[pairs[0]], y[pairs[1]]) <= most[pairs[0]]
            pairs = pairs[0][fine], pairs[1][fine]
    i, j = np.nonzero(left) if pairs is None else pairs
    far = exact(i, j)
    starts = np.searchsorted(i, every)
    best = np.minimum.reduceat(far, starts) if n else np.zeros(0, np.int64)
    index = np.minimum.reduceat(np.where(far == best[i], j, len(entries)), starts) if n else np.zeros(0, np.int64)
    return index, best, len(i) + n * len(entry_bounds.levels)


class Coder:
    """Codes of rows of integers under codebooks (parts, entries, width)."""

    def __init__(self, books: np.ndarray):
        self.books, self.bounds = books, [Bounds(b) for b in books]
        self.exact = 0

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, parts) indexes and (n,) summed squared distances."""
        parts, _, width = self.books.shape
        codes, error = np.empty((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
        for p in range(parts):
            codes[:, p], far, used = nearest(rows[:, p * width : (p + 1) * width], self.books[p], self.bounds[p])
            error += far
            self.exact += used
        return codes, error


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch, to_integers(batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, size)


def _round(books: np.ndarray):
    """Sums and counts of the rows nearest to each entry, a row for each entry that a task used."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, count, total = Coder(books), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, rows in _slices(batches, parts * width):
            codes, _ = coder(rows)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                for k in range(width):  # weights are whole numbers under 2^53 in sum
                    total[p, :, k] += np.bincount(codes[:, p], weights=rows[:, p * width + k], minlength=entries).astype(np.int64)
        part, entry = np.nonzero(count)
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _encode(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books)
        for batch, rows in _slices(batches, parts * width):
            codes, error = coder(rows)
            text = codes.tobytes().hex()
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            yield pa.record_batch([column("vec_id"), column("label"), pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _first_entries(rows: DataFrame) -> np.ndarray | None:
    """(parts, entries, width) of the smallest vec_ids' vectors; None if there are none."""
    lead = rows.where(F.size("vector") > 0).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(1).select(F.size("vector").alias("n")).collect()
    if not lead:
        return None
    if lead[0].n % PARTS:
        raise ValueError(f"{PARTS} parts do not divide vectors of {lead[0].n} components")
    first = rows.where(F.size("vector") == lead[0].n).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").collect()
    whole = to_integers(np.array([r.vector for r in first], np.float64))
    return np.ascontiguousarray(whole.reshape(len(first), PARTS, -1).transpose(1, 0, 2))


def train(vectors: DataFrame, column: str = "embedding") -> np.ndarray | None:
    """Codebooks (parts, entries, width) after the rounds; None for a table without vectors."""
    rows = kept(vectors, column)
    common.ship(rows.sparkSession)
    books = _first_entries(rows)
    if books is None:
        return None
    parts, _, width = books.shape
    rows = rows.where(F.size("vector") == parts * width).select("vector")
    for _ in range(ROUNDS):
        some = rows.mapInArrow(_round(books), "part int, entry int, n bigint, sums array<bigint>")
        every = some.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
        books = books.copy()
        for r in every.collect():  # parts x entries rows at most
            books[r.part, r.entry] = [s // r.n for s in r.sums]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, column: str = "embedding") -> DataFrame:
    """(vec_id, label, code, error) of the rows that fit the codebooks."""
    rows = kept(vectors, column)
    common.ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    parts, _, width = books.shape
    return rows.where(F.size("vector") == parts * width).mapInArrow(_encode(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with ``vector``: the entries' components over 256 in the order of the parts."""
    table = F.lit(books.reshape(books.shape[0], -1).tolist())
    parts, _, width = books.shape
    part = lambda p: F.slice(table[p], F.conv(F.substr("code", F.lit(2 * p + 1), F.lit(2)), 16, 10).cast("int") * width + 1, width)
    return codes.withColumn("vector", F.transform(F.concat(*[part(p) for p in range(parts)]), lambda x: x / SCALE))


def report(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    books = train(vectors, column)
    if books is None:
        kind = vectors.schema["vec_id"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField("vec_id", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())]))
    coded = common.materialize(encode(vectors, books, column), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
