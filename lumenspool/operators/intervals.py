"""Interval kernel: unions, bucketed range joins and anti joins, elementary intervals, islands.

Null times never overlap. Every function is a composition of windows and equi joins, so no plan has
a nested-loop join; range joins send a row to each bucket that its interval touches, long ones to coarse buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """df with a number per run of rows; ``starts`` is true where a new run begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def union(df: DataFrame, keys: list[str], touch_ms: int = 0) -> DataFrame:
    """Merged intervals by key; a gap of at most ``touch_ms`` joins. Negative times are clamped, empty intervals dropped."""
    rows = df.select(*keys, F.greatest(F.col("start_ms"), F.lit(0)).alias("start_ms"), F.greatest(F.col("end_ms"), F.lit(0)).alias("end_ms")).where("end_ms > start_ms")
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    rows = rows.withColumn("_reach", F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach") + touch_ms)
    return islands(rows, keys, ["start_ms", "end_ms"], new).groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


#: A coarse bucket's width in fine ones; an interval that touches more than ``FINE`` fine buckets is long and lies in coarse ones only.
COARSE, FINE = 256, 16
#: Who meets where: short with short in fine buckets; in coarse ones short with long, long with short, long with long (left side first).
SHORTS, SHORT_LONG, LONG_SHORT, LONGS = range(4)


def _bucketed(df: DataFrame, start: str, end: str, width_ms: int, prefix: str, is_left: bool) -> DataFrame:
    """df with a row for each bucket that a row's interval touches and each kind of meeting there that it takes part in.

    The kind is part of what is joined, so two short intervals never come together in a coarse bucket.
    """
    last = F.greatest(F.col(end), F.col(start) + 1) - 1
    at = lambda t, w: F.floor(t / w).cast("long")
    fine, coarse = F.sequence(at(F.col(start), width_ms), at(last, width_ms)), F.sequence(at(F.col(start), width_ms * COARSE), at(last, width_ms * COARSE))
    short = at(last, width_ms) - at(F.col(start), width_ms) < FINE
    place = lambda buckets, meeting: F.transform(buckets, lambda x: F.struct(F.lit(meeting).alias("meeting"), x.alias("bucket")))
    as_short, as_long = (SHORT_LONG, LONG_SHORT) if is_left else (LONG_SHORT, SHORT_LONG)
    every = F.when(short, F.concat(place(fine, SHORTS), place(coarse, as_short))).otherwise(F.concat(place(coarse, as_long), place(coarse, LONGS)))
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_at", F.explode(every))
    return rows.select(*df.columns, *[F.col(f"_at.{c}").alias(f"{prefix}{c}") for c in ("meeting", "bucket")])


def range_join(left: DataFrame, right: DataFrame, key: str, width_ms: int = 10_000, kind: str = "inner") -> DataFrame:
    """Pairs of equal key whose half-open intervals overlap. left has start_ms, end_ms; right has r_start, r_end and r_-columns.

    Intervals meet in fine buckets, long ones in coarse buckets, so that none is spread over many; each pair
    is kept in the bucket where the later of the two starts lies, so it appears once.
    kind: inner, left_semi or left_anti; equal left rows, and ones with nulls, each count.
    """
    given = left
    if kind != "inner":
        names = [F.col(f"`{c}`") for c in left.columns]
        left = left.withColumns({"_h": F.xxhash64(*names), "_i": F.xxhash64(F.lit(1), *names)})
        left = left.withColumn("_n", F.row_number().over(Window.partitionBy("_h", "_i").orderBy("_h")))
    l, r = candidates(left, right, key, width_ms)  # noqa: E741
    on = (l[key] == r["_key"]) & (l["_l_meeting"] == r["_r_meeting"]) & (l["_l_bucket"] == r["_r_bucket"]) & (l["start_ms"] < r["r_end"]) & (r["r_start"] < l["end_ms"])
    if kind == "inner":
        width = F.when(F.col("_l_meeting") == SHORTS, F.lit(width_ms)).otherwise(F.lit(width_ms * COARSE))
        home = F.floor(F.greatest("start_ms", "r_start") / width) == F.col("_l_bucket")
        return l.join(r, on).where(home).select(*left.columns, *[c for c in right.columns if c != key])
    hits = l.join(r, on, "left_semi").select("_h", "_i", "_n").distinct()
    return left.join(hits, ["_h", "_i", "_n"], kind).select(*[F.col(f"`{c}`") for c in given.columns])


def candidates(left: DataFrame, right: DataFrame, key: str, width_ms: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Both sides of a range join by bucket; right's key is named _key. What has equal key, meeting and bucket is compared."""
    return _bucketed(left, "start_ms", "end_ms", width_ms, "_l_", True), _bucketed(right.withColumnRenamed(key, "_key"), "r_start", "r_end", width_ms, "_r_", False)


#: Length up to which intervals are gathered for in the narrowest places, and how much wider the places of each class of longer ones are.
PLACE_MS, WIDER, CLASSES = 20_000, 16, 12
#: Left rows that one task takes of a place; of more, each slice meets all that overlap there.
SLICE = 20_000


def gathered(left: DataFrame, right: DataFrame, key: str, kernel: Callable[..., Iterator[pa.RecordBatch]], shape: str, place_ms: int | None = None, items: tuple[str, DataFrame] | None = None) -> DataFrame:
    """What kernel makes of some rows of left, each once, and of all rows of right that may overlap them. left has start_ms, end_ms; right has r_start, r_end and r_-columns.

    A row of left lies in one place only, that of its start, and right rows lie in each place where a row that they overlap
    may start; so what overlaps a row is together and in its order, and no pair is shuffled. Long rows of left have wider
    places. Rows without key or times meet none. The kernel compares, and yields batches of bounded size.
    items: the name of an array in left, and rows by key and ``item``; the kernel also gets those of all items of its rows.
    """
    narrow = place_ms or PLACE_MS
    length, start = F.col("end_ms") - F.col("start_ms"), F.col("start_ms")
    width = lambda c: (F.pow(F.lit(WIDER), F.col(c)) * narrow).cast("long")
    known = F.col(key).isNotNull() & start.isNotNull() & F.col("end_ms").isNotNull()
    names = [F.col(f"`{c}`") for c in left.columns]
    rows = left.withColumn("_class", F.when(known, sum((F.when(length > narrow * WIDER**k, 1).otherwise(0) for k in range(CLASSES)), F.lit(0))).otherwise(-1))
    rows = rows.withColumn("_place", F.when(known, F.floor(start / width("_class"))).otherwise(F.pmod(F.xxhash64(*names), F.lit(256))))
    places = rows.groupBy(key, "_class", "_place").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("_slices"))
    classes = places.where("_class >= 0").select(F.col(key).alias("_key"), "_class").distinct()
    others = right.where("r_start is not null and r_end is not null").join(classes, F.col(key) == F.col("_key")).drop("_key")
    first, last = F.floor((F.col("r_start") + 1) / width("_class")) - 1, F.floor((F.col("r_end") - 1) / width("_class"))
    others = others.withColumn("_place", F.explode(F.when(first <= last, F.sequence(first, last)))).join(places, [key, "_class", "_place"])
    others = others.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    whose = places.withColumnsRenamed({key: "_k", "_class": "_c", "_place": "_p"})
    rows = rows.join(whose, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_class") == F.col("_c")) & (F.col("_place") == F.col("_p")))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*names), F.col("_slices"))).drop("_k", "_c", "_p", "_slices")
    at = [key, "_class", "_place", "_slice"]
    parts = [(left.columns, rows), (right.columns, others)]
    if items:
        wanted = rows.select(*at, F.explode(items[0]).alias("item")).distinct()
        parts.append((items[1].columns, items[1].join(wanted, [key, "item"])))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("_part", F.lit(k)) for k, (_, df) in enumerate(parts)])
    columns = [list(names) for names, _ in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        part = table["_part"].combine_chunks()
        tables = [table.filter(pc.equal(part, k)).select(names) for k, names in enumerate(columns)]
        if len(tables[0]):
            yield from kernel(*tables)

    return every.groupBy(*at).applyInArrow(run, shape)


def ranked(df: DataFrame, coarse: list, fine: list, name: str = "rank") -> DataFrame:
    """df with the rank of each row in the order of coarse, then fine columns, without one global sort.

    coarse: (name, column, descending) that part the order ever finer, the first into few parts. The rows that go ahead of a
    part are those ahead of the part that it lies in and those of its earlier neighbours there, so only a part's own
    sub-parts are sorted together.
    """
    keys = [f"_{n}" for n, _, _ in coarse]
    rows = df.withColumns({f"_{n}": c for n, c, _ in coarse})
    counts, ahead = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")), None
    for i, (key, (_, _, down)) in enumerate(zip(keys, coarse, strict=True)):
        level = counts.groupBy(*keys[: i + 1]).agg(F.sum("_k").alias("_k"))
        before = Window.partitionBy(*keys[:i]).orderBy(F.desc(key) if down else F.asc(key)).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("_here", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
        ahead = level.withColumnRenamed("_here", "_ahead") if ahead is None else level.join(ahead, keys[:i]).withColumn("_ahead", F.col("_ahead") + F.col("_here")).drop("_here")
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*fine))).join(ahead, keys)
    return rows.withColumn(name, F.col("_ahead") + F.col("_place")).drop(*keys, "_place", "_ahead")


def complement(holes: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """What disjoint sorted-able holes (key, start_ms, end_ms) leave of outer (key, outer_start, outer_end): key, start_ms, end_ms."""
    marks = holes.select(key, "start_ms", "end_ms").join(outer, key)
    ends = outer.select(key, F.col("outer_end").alias("start_ms"), F.col("outer_end").alias("end_ms"), "outer_start", "outer_end")
    w = Window.partitionBy(key).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    rows = marks.unionByName(ends).withColumn("cursor", F.greatest(F.coalesce(F.max("end_ms").over(w), F.col("outer_start")), "outer_start"))
    return rows.where("start_ms > cursor").select(key, F.col("cursor").alias("start_ms"), F.col("start_ms").alias("end_ms"))


def covered(cues: DataFrame, speech: DataFrame, key: str) -> DataFrame:
    """Merged speech intervals (key, start_ms, end_ms) and how many ms of each the merged cues cover."""
    merged = union(speech, [key], 1)
    right = union(cues, [key], 1).select(key, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    found = range_join(merged, right, key).groupBy(key, "start_ms", "end_ms").agg(F.sum(F.least("end_ms", "r_end") - F.greatest("start_ms", "r_start")).alias("covered"))
    return merged.join(found, [key, "start_ms", "end_ms"], "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))


def coverage(cues: DataFrame, speech: DataFrame, key: str) -> DataFrame:
    """Per key: speech_ms, covered_ms, coverage, missing (speech intervals covered less than 35 %)."""
    rows = covered(cues, speech, key).withColumn("length", F.col("end_ms") - F.col("start_ms"))
    return rows.groupBy(key).agg(
        F.sum("length").alias("speech_ms"), F.sum("covered").alias("covered_ms"), F.round(F.sum("covered") / F.sum("length"), 6).alias("coverage"),
        F.count_if(F.col("covered") * 100 < F.col("length") * 35).alias("missing"))


def elementary_winners(df: DataFrame, key: str, rank: Column) -> DataFrame:
    """Atomic intervals between all boundaries; the best ranked covering row wins; equal neighbours merge. df: key, start_ms, end_ms, label.

    Intervals of one rank and label count as their union, so no more of them cover a point than there are labels.
    """
    same = [key, "_rank", "label"]
    w = Window.partitionBy(*same).orderBy("start_ms", "end_ms")
    rows = df.where("end_ms > start_ms").select(key, rank.alias("_rank"), "label", "start_ms", "end_ms").withColumn("_reach", F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach"))
    df = islands(rows, same, ["start_ms", "end_ms"], new).groupBy(*same, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")
    cuts = df.select(key, F.explode(F.array("start_ms", "end_ms")).alias("a")).distinct()
    atoms = cuts.withColumn("b", F.lead("a").over(Window.partitionBy(key).orderBy("a"))).where("b is not null").select(key, F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))
    right = df.select(key, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.struct(F.col("_rank").alias("rank"), "label").alias("r_best"))
    best = range_join(atoms, right, key).groupBy(key, "start_ms", "end_ms").agg(F.min("r_best").alias("best")).select(key, "start_ms", "end_ms", F.col("best.label").alias("label"))
    w = Window.partitionBy(key).orderBy("start_ms")
    new = F.lag("label").over(w).isNull() | (F.lag("label").over(w) != F.col("label")) | (F.lag("end_ms").over(w) != F.col("start_ms"))
    best = best.withColumn("_new", new)
    return islands(best, [key], ["start_ms"], F.col("_new")).groupBy(key, "island", "label").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def assign_speakers(segments: DataFrame, turns: DataFrame, key: str, tolerance_ms: int = 120) -> DataFrame:
    """segments with speaker of greatest overlap (earlier turn on ties) and whether the runner-up is within tolerance. turns: key, r_start, r_end, r_speaker, r_order."""
    overlap = F.least("end_ms", "r_end") - F.greatest("start_ms", "r_start")
    pairs = range_join(segments, turns, key).withColumn("overlap", overlap)
    w = Window.partitionBy(key, "source_order").orderBy(F.desc("overlap"), "r_order")
    best = pairs.withColumns({"rn": F.row_number().over(w), "second": F.lead("overlap").over(w)}).where("rn = 1")
    best = best.select(key, "source_order", F.col("r_speaker").alias("speaker"), "overlap", (F.coalesce(F.col("overlap") - F.col("second") <= tolerance_ms, F.lit(False))).alias("ambiguous"))
    return segments.join(best, [key, "source_order"], "left")


def sessions(df: DataFrame, key: str, max_gap_ms: int = 1500) -> DataFrame:
    """Runs of one speaker with gaps in [0, max_gap_ms]: key, speaker, start_ms, end_ms, members, text."""
    w = Window.partitionBy(key).orderBy("source_order")
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    rows = df.withColumn("_new", ~F.coalesce((F.lag("speaker").over(w) == F.col("speaker")) & gap.between(0, max_gap_ms), F.lit(False)))
    grouped = islands(rows, [key], ["source_order"], F.col("_new")).groupBy(key, "island", "speaker")
    return grouped.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("members"),
                       F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_order", "raw_text"))), lambda x: x["raw_text"]), "\n").alias("text")).drop("island")


def buckets(df: DataFrame, key: str, time: str, width_ms: int) -> DataFrame:
    """Tumbling buckets 0 .. last of each key, empty ones too: key, bucket, start_ms, n, and the rows joined."""
    last = df.groupBy(key).agg(F.max(F.floor(F.col(time) / width_ms)).alias("last"))
    every = last.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bucket"))
    return every.join(df.withColumn("bucket", F.floor(F.col(time) / width_ms)), [key, "bucket"], "left").withColumn("start_ms", F.col("bucket") * width_ms)


def chunks(df: DataFrame, key: str, chunk_ms: int, overlap_ms: int) -> DataFrame:
    """Sliding chunks of [0, duration_ms): key, chunk_start, chunk_end; the last is clipped. df: key, duration_ms."""
    step = chunk_ms - overlap_ms
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("duration_ms") - 1, F.lit(0)), F.lit(step).cast("long"))
    rows = df.where("duration_ms > 0").select(key, "duration_ms", F.explode(starts).alias("chunk_start"))
    rows = rows.where((F.col("chunk_start") == 0) | (F.col("chunk_start") + overlap_ms < F.col("duration_ms")))
    return rows.select(key, "chunk_start", F.least(F.col("chunk_start") + chunk_ms, F.col("duration_ms")).alias("chunk_end"))


def contained(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left (key, start_ms, end_ms, ..) with ``covered``: whether one interval of right (key, r_start, r_end) holds it whole; false for null times."""
    spans = left.select(key, "start_ms", "end_ms").where("start_ms < end_ms").distinct()
    held = range_join(spans, right.select(key, "r_start", "r_end"), key).where("r_start <= start_ms and r_end >= end_ms").select(key, "start_ms", "end_ms").distinct().withColumn("_held", F.lit(True))
    return left.join(held, [key, "start_ms", "end_ms"], "left").select(*[F.col(f"`{c}`") for c in left.columns], F.coalesce("_held", F.lit(False)).alias("covered"))
