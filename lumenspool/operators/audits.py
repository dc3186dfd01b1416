"""Audits of outputs against sources: tokens, coverage of segments by blocks, references, events, projects.

Texts are compared as tokens of functions.text. Multisets are compared by counts, never by pairs of tokens.
Order is compared by the sequences themselves. Null texts are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.functions import text as X
from lumenspool.operators.blocks import PENDING

#: Importance that marks an event as not important, descriptions that say nothing.
UNIMPORTANT = ("incidental", "0", "1", "none")
NOTHING_SEEN = ("", "[no visual source available]", PENDING)


def token_differences(pairs: DataFrame, keys: list[str], tokens) -> DataFrame:
    """(keys, token, missing, added): how often tokens of source are missing in output, and are added there. pairs: keys, source, output; tokens: text column to array."""
    both = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("s"), tokens(F.coalesce("source", F.lit(""))).alias("t")), F.struct(F.lit(-1).alias("s"), tokens(F.coalesce("output", F.lit(""))).alias("t")))).alias("x"))
    rows = both.select(*keys, "x.s", F.explode("x.t").alias("token")).groupBy(*keys, "token").agg(F.sum("s").alias("d")).where("d <> 0")
    return rows.select(*keys, "token", F.greatest(F.col("d"), F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("added"))


def token_audit(source: Column, output: Column, tokens) -> Column:
    """struct(faithful, reordered, source_tokens, output_tokens) of two texts: faithful if the token sequences are equal, reordered if only their order differs."""
    a, b = tokens(F.coalesce(source, F.lit(""))), tokens(F.coalesce(output, F.lit("")))
    return F.struct((a == b).alias("faithful"), ((a != b) & (F.array_sort(a) == F.array_sort(b))).alias("reordered"), F.size(a).alias("source_tokens"), F.size(b).alias("output_tokens"))


def block_coverage(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row a substantive segment (media_id, segment_id): missing, duplicated, partial (no block has its text), of what blocks (segment_ids, source_texts) map."""
    source = segments.where("substantive").select("media_id", "segment_id", F.col("text").alias("source"))
    mapped = blocks.select("media_id", F.posexplode("segment_ids").alias("i", "segment_id"), "source_texts").select("media_id", "segment_id", F.get("source_texts", F.col("i")).alias("mapped"))
    found = source.join(mapped, ["media_id", "segment_id"]).groupBy("media_id", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("mapped") == F.col("source")).alias("same"))
    rows = source.join(found, ["media_id", "segment_id"], "left")
    return rows.select("media_id", "segment_id", F.col("n").isNull().alias("missing"), (F.coalesce("n", F.lit(0)) > 1).alias("duplicated"), (F.col("n").isNotNull() & ~F.coalesce("same", F.lit(False))).alias("partial"))


def token_order(rows: DataFrame, keys: list[str], order: str, tokens: Column) -> DataFrame:
    """(keys, n, places, bag): of the tokens of all rows of a key in order, their number and digests that tell the sequence and the multiset.

    places combines a hash of each place and token, bag sums a hash of each token, both in 128 bits, so texts stay apart and no row holds
    a key's whole text.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(*keys, order, tokens.alias("_t")).withColumn("_n", F.size("_t"))
    placed = placed.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*keys, F.col("_first"), F.posexplode_outer("_t").alias("_i", "_token"))
    seed = lambda k, *c: F.xxhash64(F.lit(k), *c)
    at = F.when(F.col("_i").isNotNull(), F.col("_first") + F.col("_i"))
    both = [F.bit_xor(F.when(at.isNotNull(), seed(k, at, F.col("_token")))) for k in (1, 2)]
    sums = [F.sum(F.when(at.isNotNull(), seed(k, F.col("_token")).cast("decimal(20,0)"))) for k in (3, 4)]
    shown = lambda parts: F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return placed.groupBy(*keys).agg(F.count("_i").alias("n"), shown(both).alias("places"), shown(sums).alias("bag"))


def coverage_report(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row a media: substantive segments, covered, missing, duplicated, partial ones, and whether the ordered tokens of all blocks' texts are those of the segments."""
    per = block_coverage(segments, blocks).groupBy("media_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(c) for c in ("missing", "duplicated", "partial")])
    tokens = X.ordered_tokens(F.coalesce("text", F.lit("")))
    source = token_order(segments.where("substantive"), ["media_id"], "source_order", tokens)
    output = token_order(blocks.where("size(segment_ids) > 0"), ["media_id"], "ordinal", tokens)
    named = lambda df, p: df.select("media_id", *[F.col(c).alias(f"{p}_{c}") for c in ("n", "places", "bag")])
    rows = per.join(named(source, "s"), "media_id", "left").join(named(output, "o"), "media_id", "left")
    number = lambda p: F.coalesce(f"{p}_n", F.lit(0))
    none = (number("s") == 0) & (number("o") == 0)
    faithful = none | F.coalesce((number("s") == number("o")) & (F.col("s_places") == F.col("o_places")), F.lit(False))
    reordered = ~faithful & F.coalesce((number("s") == number("o")) & (F.col("s_bag") == F.col("o_bag")), F.lit(False))
    valid = (F.col("missing") == 0) & (F.col("duplicated") == 0) & (F.col("partial") == 0) & faithful
    return rows.select("media_id", "total", (F.col("total") - F.col("missing")).alias("covered"), "missing", "duplicated", "partial", faithful.alias("faithful"), reordered.alias("reordered"), valid.alias("valid"))


def dangling(references: DataFrame, known: DataFrame, on: list[str], finding: str) -> DataFrame:
    """(finding, on..) of references that nothing known answers to."""
    return references.join(known.select(*on).distinct(), on, "left_anti").select(F.lit(finding).alias("finding"), *on)


def project_findings(segments: DataFrame, blocks: DataFrame, events: DataFrame, frames: DataFrame, media: DataFrame, tolerance_ms: int = 250) -> DataFrame:
    """(media_id, finding, id) of a project's tables.

    segments: media_id, segment_id, substantive. blocks: media_id, block_id, ordinal, start_ms, end_ms, segment_ids, event_ids, frame_ids, claim_ids, visual.
    events: media_id, event_id, importance. frames: media_id, frame_id, requested_ms, actual_ms, offset_ms, timestamp_source. media: media_id, duration_ms.
    """
    out = lambda df, name, column: df.select("media_id", F.lit(name).alias("finding"), F.col(column).cast("string").alias("id"))
    b = blocks.join(media.select("media_id", "duration_ms"), "media_id", "left")
    w = Window.partitionBy("media_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.last("start_ms", True).over(w))
    mapped = blocks.select("media_id", F.explode("segment_ids").alias("segment_id"))
    counts = mapped.groupBy("media_id", "segment_id").agg(F.count(F.lit(1)).alias("n"))
    real = segments.where("substantive").join(counts, ["media_id", "segment_id"], "left")
    shown = blocks.select("media_id", F.explode("event_ids").alias("event_id"))
    grave = events.where(~F.col("importance").isin(*UNIMPORTANT))
    # A media none of whose events is important has all of them count.
    quiet = events.join(grave.select("media_id").distinct(), "media_id", "left_anti")
    f = frames.join(media.select("media_id", "duration_ms"), "media_id", "left")
    said = ~F.coalesce("visual", F.lit("")).isin(*NOTHING_SEEN)
    parts = [
        out(real.where("n is null"), "missing_segment", "segment_id"), out(real.where("n > 1"), "duplicate_mapping", "segment_id"),
        out(mapped.join(segments.select("media_id", "segment_id"), ["media_id", "segment_id"], "left_anti").distinct(), "cites_missing_segment", "segment_id"),
        out(grave.unionByName(quiet).join(shown, ["media_id", "event_id"], "left_anti"), "unrepresented_event", "event_id"),
        out(b.where("end_ms < start_ms"), "end_precedes_start", "block_id"), out(b.where("start_ms < before"), "non_monotonic_order", "block_id"), out(b.where(F.col("end_ms") > F.col("duration_ms") + tolerance_ms), "exceeds_duration", "block_id"),
        out(b.where(said & (F.size("frame_ids") > 0) & (F.size("claim_ids") == 0)), "unsupported_visual", "block_id"),
        out(f.where(~F.col("offset_ms").eqNullSafe(F.col("actual_ms") - F.col("requested_ms")) & F.col("actual_ms").isNotNull() & F.col("requested_ms").isNotNull()), "offset_disagrees", "frame_id"),
        out(f.where("actual_ms < 0 or actual_ms > duration_ms + 1000"), "frame_outside_media", "frame_id"), out(f.where("actual_ms is not null and timestamp_source is null"), "no_measurement_source", "frame_id"),
    ]
    return reduce(DataFrame.union, parts)


def ungrounded_events(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Events (media_id, event_id, evidence_ids, role_ids arrays) that cite unknown frames, or whose roles cite frames outside their evidence."""
    known = frames.groupBy("media_id").agg(F.collect_set("frame_id").alias("known"))
    rows = events.join(known, "media_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return rows.withColumns({"unknown_frames": F.size(F.array_except("evidence_ids", "known")), "stray_roles": F.size(F.array_except("role_ids", "evidence_ids"))}).where("unknown_frames > 0 or stray_roles > 0").select("media_id", "event_id", "unknown_frames", "stray_roles")


def same_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(media_id, compatible): whether two ordered lists of blocks (media_id, ordinal, block_id, start_ms, end_ms, segment_ids) are equal place by place."""
    place = lambda df: df.select("media_id", F.row_number().over(Window.partitionBy("media_id").orderBy("ordinal")).alias("place"), F.struct("block_id", "start_ms", "end_ms", "segment_ids").alias("b"))
    both = place(before).join(place(after).withColumnRenamed("b", "c"), ["media_id", "place"], "full")
    return both.groupBy("media_id").agg(F.every(F.col("b").eqNullSafe(F.col("c"))).alias("compatible"))
