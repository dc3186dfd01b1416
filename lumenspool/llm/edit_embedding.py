"""Randomised edit embedding: fingerprints whose Hamming likeness follows edit distance.

All texts share one random walk: at step j the walk writes the character under its pointer and moves
on with probability one half, decided by a shared random bit of (step, character). Texts a few edits
apart fall into step again, so their written strings agree in most places (Chakraborty, Goldenberg
and Koucky's embedding). Shared randomness: the time that a character holds the pointer at a step is
read off a table of the next moving step by (step modulo ``PERIOD``, character class).

The fingerprint samples the written string, whatever its length: ``SAMPLES`` places of every octave
[2^k, 2^(k+1)) of steps that the walk reaches, shared by all texts, each giving one hashed bit; then
the length of the walk. Likeness of two fingerprints weighs octaves by their steps and rescales
agreement so that chance is 0; places beyond the shorter text's end disagree.

Near pairs: bits are sampled into bands (``bands``), all pairs of a band are verified on the fingerprint
(``near_pairs``). Documents' edited copies and next neighbours (``edited_report``) need no join: rows are
dealt by doc_id ranges (repartitionById), each range also gets the next lower one's first row.

Defined cases: null text is empty; an empty text's fingerprint is of length 0 and like itself (1) and
nothing else (0); equal texts have equal fingerprints; rows of equal doc_id follow each other by
text, null ids come last; an empty table gives an empty table; extra columns are not read. Texts are walked whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.llm import common
from lumenspool.llm import words as W

PERIOD, CLASSES = 4096, 256
#: Sampled places of an octave; octaves below the first share one.
SAMPLES, FIRST_OCTAVE = 128, 7
#: Code points walked at once: bounds scratch memory, not texts.
SLICE_CHARS = 2 << 20
#: Bands of near pairs: wanted probability that a pair of the least likeness meets; equal bits of unlike texts.
RECALL, UNLIKE = 0.999, 0.65

_moves: np.ndarray | None = None
_octaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _next_moves() -> np.ndarray:
    """[class * PERIOD + step]: steps until the walk has moved on, at least 1."""
    global _moves
    if _moves is None:
        bits = W.mix(np.arange(CLASSES * PERIOD, dtype=np.uint64) + np.uint64(0x5EED)) >> np.uint64(63)
        moves = bits.reshape(CLASSES, PERIOD).astype(bool)
        wait = np.zeros((CLASSES, PERIOD), np.int32)
        follow = np.full(CLASSES, PERIOD, np.int64)
        for j in range(2 * PERIOD - 1, -1, -1):
            follow = np.where(moves[:, j % PERIOD], 1, follow + 1)
            if j < PERIOD:
                wait[:, j] = follow
        _moves = wait.ravel()
    return _moves


def _octave(k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted sampled steps, salts) of octave k; octave FIRST_OCTAVE covers all steps below 2^(FIRST_OCTAVE + 1)."""
    if k not in _octaves:
        low = 0 if k == FIRST_OCTAVE else 1 << k
        draw = W.mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(k << 32))
        steps = np.sort(low + (draw % np.uint64((1 << (k + 1)) - low)).astype(np.int64))
        _octaves[k] = steps, W.mix(steps.astype(np.uint64) + np.uint64(k << 48) + np.uint64(SAMPLES) * np.arange(SAMPLES, dtype=np.uint64))
    return _octaves[k]


def walk(codes: np.ndarray, begin: np.ndarray, many: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Step at which each character of each text first is under the pointer, and the steps at the ends.

    codes: characters of all texts; text i has codes[begin[i] : begin[i] + many[i]] and starts at step
    at[i]. Texts advance side by side, one character a turn, the longest first.
    """
    wait = _next_moves()
    order = np.argsort(-many, kind="stable")
    sizes, start = many[order], begin[order]
    step = at[order].astype(np.int64)
    row = (codes.astype(np.int64) * PERIOD)
    first = np.empty(len(codes), np.int64)
    turns = int(sizes[0]) if len(sizes) else 0
    alive_at = np.searchsorted(-sizes, -np.arange(turns), "left")  # texts longer than each turn
    for i in range(turns):
        n = alive_at[i]
        place = start[:n] + i
        now = step[:n]
        first[place] = now
        step[:n] = now + wait[row[place] + (now & (PERIOD - 1))]
    end = np.empty(len(many), np.int64)
    end[order] = step
    return first, end


def fingerprint(values: np.ndarray, first: np.ndarray, end: int) -> bytes:
    """Length of the walk (4 bytes), then SAMPLES bits an octave. values: hashes of the characters."""
    out = [int(end).to_bytes(4, "big")]
    k = FIRST_OCTAVE
    while end and (k == FIRST_OCTAVE or 1 << k < end):
        steps, salts = _octave(k)
        inside = steps < end
        who = np.searchsorted(first, steps, "right") - 1
        bits = (W.mix(values[np.maximum(who, 0)] ^ salts) >> np.uint64(63)).astype(np.uint8) & inside
        out.append(np.packbits(bits).tobytes())
        k += 1
    return b"".join(out)


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: estimated share of steps at which the two walks wrote the same character."""
    n, m = int.from_bytes(a[:4], "big"), int.from_bytes(b[:4], "big")
    if n == 0 or m == 0:
        return float(n == m)
    if a == b:
        return 1.0
    width, total = SAMPLES // 8, 0.0
    for i in range(min(len(a), len(b)) // width):
        k = FIRST_OCTAVE + i
        steps, _ = _octave(k)
        low, high = (0 if i == 0 else 1 << k), min(n, m, 1 << (k + 1))
        if high <= low:
            break
        inside = int(np.searchsorted(steps, min(n, m)))
        if inside:
            x = np.unpackbits(np.frombuffer(a[4 + i * width : 4 + (i + 1) * width], np.uint8) ^ np.frombuffer(b[4 + i * width : 4 + (i + 1) * width], np.uint8))
            total += (high - low) * max(0.0, 1 - 2 * int(x[:inside].sum()) / inside)
    return total / max(n, m)


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


class Texts:
    """Character classes and hashes of a slice of texts, laid end to end."""

    def __init__(self, texts: list[np.ndarray]):
        self.many = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.many) - self.many
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        self.values = W.mix(flat.astype(np.uint64) + np.uint64(1 << 40))
        self.codes = (self.values % np.uint64(CLASSES)).astype(np.uint8)


def fingerprints(texts: list[np.ndarray]) -> list[bytes]:
    """Fingerprints of whole texts given as code points."""
    out: list[bytes] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_CHARS):
            size += len(texts[j])
            j += 1
        part = Texts(texts[i:j])
        first, end = walk(part.codes, part.begin, part.many, np.zeros(j - i, np.int64))
        for b, n, e in zip(part.begin.tolist(), part.many.tolist(), end.tolist(), strict=True):
            out.append(fingerprint(part.values[b : b + n], first[b : b + n], e))
        i = j
    return out


def edited(text: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last third (floor) of the code points replaced by the first as many, or all, of the following text."""
    third = len(text) // 3
    return np.concatenate([text[: len(text) - third], following[:third]])


def fingerprint_column(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint binary) of every row."""
    common.ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.by_text(batches):
            offsets, data = common.utf8_parts(batch.column(1))
            texts = [code_points(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(fingerprints(texts), pa.binary())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint binary")


def plan_bands(n: int, least: float) -> tuple[int, int]:
    """(bits, many) of bands for n fingerprints: a pair of likeness ``least`` shares a band with probability ``RECALL``.

    Over the steps that the bands of a pair sample, at most (1 - least) / least of the walk differs, and
    half of its bits; unlike texts of one language agree in up to ``UNLIKE`` of their bits.
    """
    if not 0.6 <= least <= 1:
        raise ValueError("least must be from 0.6 to 1")
    bits = min(28, max(4, math.ceil(math.log(max(1, n / 32)) / -math.log(UNLIKE))))
    same = (1 - (1 - least) / (2 * least)) ** bits
    return bits, 1 if same >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def _picks(steps: int, bits: int, many: int) -> np.ndarray:
    """[band, bit]: which bits of a fingerprint the bands of walks of at least ``steps`` steps take, octaves by their steps."""
    inside, share = [], []
    while not share or 1 << (FIRST_OCTAVE + len(share)) < steps:
        k = FIRST_OCTAVE + len(share)
        inside.append(int(np.searchsorted(_octave(k)[0], steps)))
        share.append((min(steps, 1 << (k + 1)) - (0 if k == FIRST_OCTAVE else 1 << k)) * (inside[-1] > 0))
    if not sum(share):
        return np.zeros((many, 0), np.int64)
    draw = W.mix(np.arange(2 * many * bits, dtype=np.uint64) + np.uint64(steps << 32)).reshape(2, many, bits)
    octave = np.searchsorted(np.cumsum(share), (draw[0] % np.uint64(sum(share))).astype(np.int64), "right")
    return octave * SAMPLES + (draw[1] % np.array(inside, np.uint64)[octave]).astype(np.int64)


def bands(prints: DataFrame, bits: int, many: int, least: float) -> DataFrame:
    """(band long, k) of prints (k long, fingerprint): ``many`` samples of ``bits`` bits a length class.

    Classes of length grow by 1 / least; a walk has the bands of its own class and of the one below,
    so that like ones share the shorter one's class, all of whose steps both have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        grow = max(1.05, 1 / least)
        for batch in batches:
            who, band = [], []
            for k, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = int.from_bytes(f[:4], "big")
                if not n:
                    continue
                top = int(math.log(n) / math.log(grow) + 1e-9)
                x = np.unpackbits(np.frombuffer(f[4:], np.uint8))
                for c in {top, max(0, top - 1)}:
                    if c not in made:
                        made[c] = _picks(max(1, int(grow**c)), bits, many)
                    for t, row in enumerate(np.packbits(x[made[c]], axis=1)):
                        who.append(k)
                        band.append(int.from_bytes(hashlib.blake2b(row.tobytes() + f"/{c}/{t}".encode(), digest_size=8).digest(), "big", signed=True))
            yield pa.record_batch([pa.array(band, pa.int64()), pa.array(who, pa.int64())], ["band", "k"])

    return prints.mapInArrow(run, "band long, k long")


def near_pairs(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, near_id, likeness) of all pairs of documents that share a band and verify, each once.

    Equal fingerprints are one class (its least doc_id). All pairs of a band are verified; the number of
    bits grows with that of the classes, so that unlike texts seldom meet, and the number of bands with it.
    """
    common.ship(docs.sparkSession)
    prints = fingerprint_column(docs).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    prints = common.materialize(prints.select(F.monotonically_increasing_id().alias("k"), "doc_id", "fingerprint"), "prints")
    dealt = bands(prints.select("k", "fingerprint"), *plan_bands(prints.count(), least), least)
    met = dealt.join(dealt.select("band", F.col("k").alias("o")), "band").where("k < o").select("k", "o").distinct()
    other = prints.select(F.col("k").alias("o"), F.col("doc_id").alias("near_id"), F.col("fingerprint").alias("near"))
    pairs = met.join(prints, "k").join(other, "o").select("doc_id", "fingerprint", "near_id", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [likeness(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            out = pa.record_batch([batch.column(0), batch.column(2), pa.array(found, pa.float64())], ["doc_id", "near_id", "likeness"])
            yield out.filter(pa.array([x >= least for x in found], pa.bool_()))

    kind = dict(prints.dtypes)["doc_id"]
    return pairs.mapInArrow(run, f"doc_id {kind}, near_id {kind}, likeness double")


def edited_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    parts = max(2, 2 * common.partitions(spark))
    # Bounds of the doc_id ranges: as many as there are partitions.
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    # Range 0 has the largest ids; a row's range is how many bounds are at least its id, null ids' the last.
    ranges = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    ranges = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(ranges)
    dealt = rows.withColumn("range", ranges.cast("int"))
    # The first row of each range, also given to the range before it: by least range with a row.
    order = [F.desc_nulls_last("doc_id"), "text"]
    heads = ids.withColumn("range", ranges.cast("int")).groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()
    held = sorted(((h.range, h.doc_id) for h in heads), key=lambda x: x[0])
    before = {held[(i + 1) % len(held)][1]: held[i][0] for i in range(len(held))} if held else {}
    given = spark.createDataFrame([(k, v) for k, v in before.items()], "doc_id long, extra int") if before else spark.createDataFrame([], "doc_id long, extra int")
    given = given.withColumnRenamed("doc_id", "head")
    first = dealt.join(F.broadcast(given), dealt["doc_id"].eqNullSafe(given["head"])).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("n = 1")
    ghosts = first.select("doc_id", "text", F.col("extra").alias("range"), F.lit(True).alias("ghost"))
    both = dealt.select("doc_id", "text", "range", F.lit(False).alias("ghost")).union(ghosts)
    placed = both.repartitionById(len(cuts) + 2, "range").sortWithinPartitions("ghost", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (doc_id, code points, fingerprint) that still waits for its next

        def rows_of() -> Iterator[tuple]:
            for batch in common.by_text(batches):
                offsets, data = common.utf8_parts(batch.column(1))
                texts = [code_points(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield list(zip(batch.column(0).to_pylist(), texts, fingerprints(texts), strict=True)), batch.column(3).to_pylist()

        for own, _ in rows_of():
            chain = ([last] if last else []) + own
            changed = [edited(a[1], b[1]) for a, b in zip(chain[:-1], chain[1:], strict=True)]
            prints = fingerprints(changed)
            out = [(a[0], len(a[1]), hashlib.sha256(e.tobytes().decode("utf-32-le").encode()).hexdigest(), a[2], p, b[2]) for a, b, e, p in zip(chain[:-1], chain[1:], changed, prints, strict=True)]
            last = chain[-1]
            if out:
                yield pa.record_batch([
                    pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out]),
                    pa.array([x[3].hex() for x in out]), pa.array([x[4].hex() for x in out]),
                    pa.array([likeness(x[3], x[4]) for x in out]), pa.array([likeness(x[3], x[5]) for x in out])],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
