"""Joining of recognised speech: chunks on one clock, repeated words at their borders, repair of suspect intervals.

segments: media_id, source_order, segment_id, start_ms, end_ms, text, confidence, words (array of structs text, start_ms, end_ms).
A media's segments are folded in order of time where what was kept decides what comes next.

Defined cases: untimed segments come last and merge with nothing; null confidence is the least; a segment
whose words all repeat goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.functions import columns as C
from lumenspool.functions import timing as M
from lumenspool.functions.text import normalized_token
from lumenspool.operators import intervals


def offset(segments: DataFrame, by: Column) -> DataFrame:
    """segments and their words moved by ms."""
    return segments.withColumns({"start_ms": F.col("start_ms") + by, "end_ms": F.col("end_ms") + by, "words": M.shift_words(F.col("words"), by)})


def _tokens(words: Column) -> Column:
    """What words are compared by: token, start_ms, end_ms."""
    return F.transform(words, lambda w: F.struct(normalized_token(w["text"]).alias("token"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms")))


def _repeats(before: Column, words: Column) -> Column:
    """``repeated_prefix`` of lists of tokens."""
    most = F.least(F.size(before), F.size(words))

    def alike(a: Column, b: Column) -> Column:
        return F.coalesce((a["token"] == b["token"]) & (F.least(a["end_ms"], b["end_ms"]) > F.greatest(a["start_ms"], b["start_ms"])), F.lit(False))

    def repeats(n: Column) -> Column:
        # The first words decide most lengths without a look at the others.
        first = alike(F.get(before, F.size(before) - n), F.get(words, F.lit(0)))
        return first & F.forall(F.zip_with(F.slice(before, F.size(before) - n + 1, n), F.slice(words, 1, n), alike), lambda x: x)

    sizes = F.when(most > 0, F.sequence(most, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(sizes, repeats), F.lit(0)), F.lit(0))


def repeated_prefix(before: Column, words: Column) -> Column:
    """Number of leading words that repeat, in wording and time, the words that end ``before``; the longest such run, 0 if there is none."""
    return _repeats(_tokens(before), _tokens(words))


def _said(text: Column) -> Column:
    """A text's words in small letters, a blank between."""
    return F.array_join(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), " ")


def trimmed(segment: Column, n: Column) -> Column:
    """A segment struct without its first n words, its text made from the rest."""
    words = F.slice(segment["words"], n + 1, F.greatest(F.size(segment["words"]) - n, F.lit(0)))
    texts = F.transform(words, lambda w: w["text"])
    text = F.when(F.exists(texts, lambda t: t.rlike(r"^\s")), F.array_join(texts, "")).otherwise(F.array_join(texts, " "))
    return F.struct(segment["source_order"].alias("source_order"), segment["segment_id"].alias("segment_id"), F.coalesce(F.get(words, F.lit(0))["start_ms"], segment["start_ms"]).alias("start_ms"), segment["end_ms"].alias("end_ms"), text.alias("text"), segment["confidence"].alias("confidence"), words.alias("words"))


def merge_overlapping(segments: DataFrame, least_overlap: float = 0.2) -> DataFrame:
    """segments without what overlapping chunks recognised twice, a fold over each stretch of a media in order of time.

    A stretch ends where a segment starts after all before it, words included, have ended: nothing merges across that, so a
    fold holds segments that overlap and no more. Untimed segments stand by themselves. Of two with the same words that overlap by at least ``least_overlap`` the more confident stays; otherwise repeated leading words are cut off.
    """
    fields = ("source_order", "segment_id", "start_ms", "end_ms", "text", "confidence", "words")
    ends = F.greatest("end_ms", "start_ms", F.array_max(F.transform("words", lambda w: w["end_ms"])))
    begins = F.least("start_ms", F.array_min(F.transform("words", lambda w: w["start_ms"])))
    w = Window.partitionBy("media_id").orderBy(F.asc_nulls_last("start_ms"), "end_ms", "source_order")
    reach = F.max(F.coalesce(ends, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(begins >= reach, F.lit(True)) | F.col("start_ms").isNull() | F.col("end_ms").isNull()
    segments = intervals.islands(segments.withColumn("_new", new), ["media_id"], [F.asc_nulls_last("start_ms"), "end_ms", "source_order"], F.col("_new"), "_stretch")
    # Tokens and wording are made once a segment, not at each comparison; the fold compares them and keeps the segments.
    given = F.struct(*fields)
    segments = segments.withColumns({"_tokens": _tokens(F.col("words")), "_said": _said(F.col("text"))})
    item = F.struct(F.col("start_ms").isNull().alias("untimed"), F.coalesce("start_ms", F.lit(0)).alias("a"), F.coalesce("end_ms", F.lit(0)).alias("b"), F.col("source_order").alias("o"), given.alias("s"), F.col("_tokens").alias("tokens"), F.col("_said").alias("said"))
    lists = segments.groupBy("media_id", "_stretch").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["s"].alias("s"), x["tokens"].alias("tokens"), x["said"].alias("said"))).alias("x"))
    kind = dict(lists.dtypes)["x"]

    def cut(x: Column, n: Column) -> Column:
        tokens = F.slice(x["tokens"], n + 1, F.greatest(F.size(x["tokens"]) - n, F.lit(0)))
        return C.once(trimmed(x["s"], n), lambda s: F.struct(s.alias("s"), tokens.alias("tokens"), _said(s["text"]).alias("said")))

    def step(acc: Column, last: Column, x: Column) -> Column:
        a, s = last["s"], x["s"]
        same = (last["said"] == x["said"]) & (M.overlap_ratio(a["start_ms"], a["end_ms"], s["start_ms"], s["end_ms"]) >= least_overlap)
        better = s["confidence"].isNotNull() & (a["confidence"].isNull() | (s["confidence"] > a["confidence"]))
        more = C.once(_repeats(last["tokens"], x["tokens"]), lambda n: F.when((n > 0) & (n == F.size(s["words"])), acc).when(n > 0, F.array_append(acc, cut(x, n))).otherwise(F.array_append(acc, x)))
        return F.when(same & better, F.array_append(F.slice(acc, 1, F.size(acc) - 1), x)).when(same, acc).otherwise(more)

    fold = lambda acc, x: F.when(F.size(acc) > 0, C.once(F.element_at(acc, -1), lambda last: step(acc, last, x))).otherwise(F.array_append(acc, x))
    return lists.select("media_id", F.explode(F.aggregate("x", F.array().cast(kind), fold)).alias("x")).select("media_id", "x.s.*")


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """Segments of chunks (segments' columns, offset_ms) on the media's clock, merged."""
    return merge_overlapping(offset(chunks, F.col("offset_ms")).drop("offset_ms"))


#: Bytes of text after which a batch is handed on.
BATCH_BYTES = 8 << 20


def _heard(own: pa.Table, others: pa.Table) -> Iterator[pa.RecordBatch]:
    """own with after and confidence; rows that meet the same of others share them."""
    others = others.sort_by([("r_order", "ascending"), ("r_text", "ascending")])
    number = lambda t, c: t[c].to_numpy().astype(np.int64)
    begins, ends = number(others, "r_start"), number(others, "r_end")
    texts = others["r_text"].combine_chunks()
    said, known = pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False), others["r_confidence"].is_valid().to_numpy()
    sure = others["r_confidence"].to_numpy()
    timed = own.filter(pc.and_(own["start_ms"].is_valid(), own["end_ms"].is_valid()))
    a, b = np.searchsorted(np.sort(ends), number(timed, "start_ms"), "right"), np.searchsorted(np.sort(begins), number(timed, "end_ms"), "left")
    order = np.lexsort((b, a))
    timed = timed.take(pa.array(order))
    starts, stops, same = number(timed, "start_ms"), number(timed, "end_ms"), np.diff(a[order], prepend=-1).astype(bool) | np.diff(b[order], prepend=-1).astype(bool)
    at, size, after, means = 0, 0, [], []

    def batch(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.append_column("after", pa.array(after, pa.string())).append_column("confidence", pa.array(means, pa.float64()))
        return rows.combine_chunks().to_batches()[0]

    for k, new in enumerate(same.tolist()):
        if new:
            met = np.flatnonzero((begins < stops[k]) & (ends > starts[k]))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n := int(said[met].sum())], pa.int32()), texts.take(pa.array(met[said[met]]))), " ")[0].as_py() if len(met) else ""
            heard = sure[met[known[met]]]
            mean = float(np.add.accumulate(heard)[-1] / len(heard)) if len(heard) else None  # summed one by one, in order
        after.append(text)
        means.append(mean)
        size += len(text)
        if size > BATCH_BYTES or k == len(timed) - 1:
            yield batch(timed.slice(at, k + 1 - at))
            at, size, after, means = k + 1, 0, [], []
    rest = own.filter(pc.or_(own["start_ms"].is_null(), own["end_ms"].is_null()))
    if len(rest):
        after, means = [""] * len(rest), [None] * len(rest)
        yield batch(rest)


def recognised_for(segments: DataFrame, recognised: DataFrame) -> DataFrame:
    """segments with after and confidence: what recognised (media_id, r_order, start_ms, end_ms, text, confidence) says in each segment's time, in order ('' for nothing), and its mean confidence.

    The mean is a sum in order of r_order by its count, so it is the same however rows lie in partitions. Texts are made
    where segment and words meet; neither they nor pairs go through a shuffle.
    """
    right = recognised.select("media_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.trim("text").alias("r_text"), F.col("confidence").cast("double").alias("r_confidence"), "r_order")
    shape = ", ".join(f"`{c}` {t}" for c, t in segments.dtypes)
    return intervals.gathered(segments, right, "media_id", _heard, f"{shape}, after string, confidence double")


def repair(segments: DataFrame, suspect: DataFrame, recognised: DataFrame, least_confidence: float = 0.50) -> DataFrame:
    """A row a segment in a merged suspect interval: before, after, confidence, action (replace, retain, unresolved).

    Words replace if there are any, differ and are confident enough (unknown confidence is); the same words retain.
    """
    merged = intervals.union(suspect, ["media_id"], 0).select("media_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    hit = intervals.range_join(segments.select("media_id", "source_order", "segment_id", "start_ms", "end_ms", F.col("text").alias("before")), merged, "media_id").withColumnsRenamed({"r_start": "interval_start", "r_end": "interval_end"})
    rows = recognised_for(hit, recognised).drop("start_ms", "end_ms")
    sure = (F.col("after") != "") & (F.col("confidence").isNull() | (F.col("confidence") >= least_confidence))
    action = F.when(sure & (F.col("after") != F.col("before")), "replace").when((F.col("after") == F.col("before")) & (F.col("after") != ""), "retain").otherwise("unresolved")
    return rows.withColumn("action", action)


def unresolved_intervals(suspect: DataFrame, repairs: DataFrame) -> DataFrame:
    """Merged suspect intervals without segments, or all of whose segments stay unresolved."""
    merged = intervals.union(suspect, ["media_id"], 0)
    done = repairs.where("action <> 'unresolved'").select("media_id", F.col("interval_start").alias("start_ms"), F.col("interval_end").alias("end_ms")).distinct()
    return merged.join(done, ["media_id", "start_ms", "end_ms"], "left_anti")
