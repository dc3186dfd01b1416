"""Script blocks, chapters and timelines: projections, grouping, ordering and their checks.

Segments: media_id, source_order, segment_id, start_ms, end_ms, speaker, text, uncertainty (array), substantive.
Rows of one media meet in windows over that media.

Defined cases: untimed blocks group with untimed ones only; null speakers are equal to each other; events
without a start lie outside speech; untimed rows come last in every order; ties end at the source order and id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.functions import identity as I
from lumenspool.operators import intervals

#: Order of kinds at one time, fields that can hold a start, kinds that are points.
KINDS = ("chapter", "scene", "speaker_turn", "transcript_segment", "transcript_word", "ocr", "visual_event", "snapshot", "non_speech_audio", "uncertainty", "review_decision")
STARTS = ("start_ms", "actual_time_ms", "timestamp_ms", "time_ms", "requested_time_ms")
POINTS = ("visual_event", "ocr", "snapshot", "uncertainty", "review_decision")
PENDING = "[visual evidence retained; semantic description pending review]"
BLOCK = ("media_id", "block_id", "kind", "start_ms", "end_ms", "speaker", "text", "segment_ids", "source_texts", "event_ids", "uncertainty", "ordinal")


def block_id(kind: Column | str, ids: Column) -> Column:
    """A block's id by its kind and what it is made of."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.concat(F.lit('["'), kind, F.lit('",['), F.array_join(F.transform(ids, I.json_text), ","), F.lit("]]"))
    return F.concat(F.lit("block_"), F.substring(F.sha2(text, 256), 1, 20))


def provisional_blocks(segments: DataFrame) -> DataFrame:
    """A speech block a substantive segment."""
    rows = segments.where("substantive").withColumn("segment_ids", F.array("segment_id"))
    none = F.array().cast("array<string>")
    return rows.withColumns({"block_id": block_id("speech", F.col("segment_ids")), "kind": F.lit("speech"), "source_texts": F.array("text"), "event_ids": none, "ordinal": F.col("source_order")}).select(*BLOCK)


def group_blocks(blocks: DataFrame, max_gap_ms: int = 1500, separator: str = "\n\n") -> DataFrame:
    """Neighbouring speech blocks of one speaker as one: none uncertain, both untimed or with a gap of 0 .. max_gap_ms to the last member's end."""
    w = Window.partitionBy("media_id").orderBy("ordinal")
    last = lambda c: F.lag(c).over(w)
    gap = F.col("start_ms") - last("end_ms")
    untimed = last("end_ms").isNull() & F.col("start_ms").isNull()
    timed = last("end_ms").isNotNull() & F.col("start_ms").isNotNull() & gap.between(0, max_gap_ms)
    joins = (last("kind") == "speech") & (F.col("kind") == "speech") & last("speaker").eqNullSafe(F.col("speaker")) & (F.size(last("uncertainty")) == 0) & (F.size("uncertainty") == 0) & (untimed | timed)
    rows = blocks.withColumn("_new", ~F.coalesce(joins, F.lit(False)))
    rows = intervals.islands(rows, ["media_id"], ["ordinal"], F.col("_new"))
    members = F.array_sort(F.collect_list(F.struct("ordinal", "start_ms", "end_ms", "segment_ids", "source_texts", "event_ids", "block_id", "text", "uncertainty")))
    out = rows.groupBy("media_id", "island").agg(members.alias("m"), F.any_value("speaker").alias("speaker"), F.any_value("kind").alias("kind"))
    all_of = lambda c: F.flatten(F.col(f"m.{c}"))
    one = F.size("m") == 1
    return out.select("media_id", F.when(one, F.col("m")[0]["block_id"]).otherwise(block_id("speech", all_of("segment_ids"))).alias("block_id"), "kind", F.col("m")[0]["start_ms"].alias("start_ms"), F.element_at("m", -1)["end_ms"].alias("end_ms"), "speaker",
                      F.when(one, F.col("m")[0]["text"]).otherwise(F.array_join(all_of("source_texts"), separator)).alias("text"), all_of("segment_ids").alias("segment_ids"), all_of("source_texts").alias("source_texts"),
                      all_of("event_ids").alias("event_ids"), F.col("m")[0]["uncertainty"].alias("uncertainty"), F.col("m")[0]["ordinal"].alias("ordinal"))


def events_outside_speech(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Events (media_id, start_ms, end_ms, ..) that no block overlaps; points last a millisecond."""
    names = events.columns
    rows = events.withColumns({"_s": F.col("start_ms"), "_e": F.col("end_ms")}).withColumn("end_ms", F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).otherwise(F.col("start_ms") + 1))
    right = blocks.where("start_ms is not null and end_ms is not null").select("media_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    out = intervals.range_join(rows, right, "media_id", kind="left_anti")
    return out.withColumns({"start_ms": F.col("_s"), "end_ms": F.col("_e")}).select(*names)


def visual_blocks(events: DataFrame, speech: DataFrame) -> DataFrame:
    """A block for every important event outside speech. events: media_id, event_id, start_ms, end_ms, important, description, ordinal."""
    rows = events_outside_speech(events.where(F.coalesce("important", F.lit(True))), speech).withColumn("event_ids", F.array("event_id"))
    none = F.array().cast("array<string>")
    text = F.coalesce(F.nullif("description", F.lit("")), F.lit(PENDING))
    return rows.withColumns({"block_id": block_id("visual_only", F.col("event_ids")), "kind": F.lit("visual_only"), "speaker": F.lit(None).cast("string"), "text": text, "segment_ids": none, "source_texts": none, "uncertainty": none}).select(*BLOCK)


def build_blocks(segments: DataFrame, events: DataFrame, group: bool = True, max_gap_ms: int = 1500, separator: str = "\n\n") -> DataFrame:
    """All blocks in order (column place): grouped speech, important events outside it, and a residual block for a substantive segment that no block has."""
    provisional = provisional_blocks(segments)
    speech = group_blocks(provisional, max_gap_ms, separator) if group else provisional
    both = speech.unionByName(visual_blocks(events, speech))
    mapped = both.select("media_id", F.explode("segment_ids").alias("segment_id"))
    lost = segments.where("substantive").join(mapped, ["media_id", "segment_id"], "left_anti")
    residual = provisional_blocks(lost).withColumns({"kind": F.lit("residual"), "block_id": block_id("residual", F.col("segment_ids")), "uncertainty": F.array(F.lit("automatic_grouping_mapping_failed"))})
    w = Window.partitionBy("media_id").orderBy(F.col("start_ms").isNull(), F.coalesce("start_ms", F.lit(0)), (F.col("kind") != "speech").cast("int"), "ordinal", "block_id")
    return both.unionByName(residual).withColumn("place", F.row_number().over(w))


def chapters(blocks: DataFrame, media: DataFrame, width_ms: int = 600_000) -> DataFrame:
    """Chapters of equal width up to the last block's, empty ones too; untimed blocks belong to the first; a media without blocks has one. media: media_id, duration_ms (null: unknown)."""
    rows = blocks.select("media_id", F.coalesce(F.floor(F.col("start_ms") / width_ms), F.lit(0)).alias("bucket"))
    counts = rows.groupBy("media_id", "bucket").agg(F.count(F.lit(1)).alias("blocks"))
    last = rows.groupBy("media_id").agg(F.max("bucket").alias("last"))
    every = media.join(last, "media_id", "left").select("media_id", "duration_ms", F.col("last").isNull().alias("bare"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0)))).alias("bucket"))
    out = every.join(counts, ["media_id", "bucket"], "left")
    start = F.when(F.col("duration_ms").isNotNull() | F.col("bare"), F.col("bucket") * width_ms)
    end = F.when(F.col("bare"), F.coalesce("duration_ms", F.lit(0))).otherwise(F.least((F.col("bucket") + 1) * width_ms, F.col("duration_ms")))
    end = F.when(F.col("bare") | F.col("duration_ms").isNotNull(), end)
    title = F.when(F.col("bare"), "Incomplete reconstruction (navigational)").otherwise(F.concat(F.lit("Navigational chapter "), F.col("bucket") + 1))
    return out.select("media_id", I.sequential("chapter", F.col("bucket") + 1).alias("chapter_id"), title.alias("title"), start.alias("start_ms"), end.alias("end_ms"), F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"))


def item_start(df: DataFrame) -> Column:
    """A record's start: the first of the known fields that it has."""
    return F.coalesce(*[F.col(c) for c in STARTS if c in df.columns], F.lit(None).cast("long")).cast("long")


def timeline_items(records: DataFrame, kind: str, media: DataFrame | None = None, tolerance_ms: int = 250) -> DataFrame:
    """records (media_id, source_order, source_id or null, start and end fields) of one kind as items: timeline_id, kind, source_id, start_ms, end_ms, timing_provenance.

    An end less than tolerance_ms behind the media's is clipped to it. Points end where they start.
    """
    start = item_start(records)
    end = F.col("end_ms").cast("long") if "end_ms" in records.columns else F.lit(None).cast("long")
    if kind in POINTS:
        end = F.coalesce(end, start)
    said = [F.col(c) for c in ("timing_provenance", "time_provenance", "provenance") if c in records.columns]
    measured = F.when(F.col("actual_time_ms").isNotNull(), "measured_frame_time") if kind == "snapshot" and "actual_time_ms" in records.columns else F.lit(None).cast("string")
    rows = records.withColumns({"_s": start, "_e": end})
    rows = rows.join(media.select("media_id", "duration_ms"), "media_id", "left") if media is not None else rows.withColumn("duration_ms", F.lit(None).cast("long"))
    clipped = (F.col("_s") < F.col("duration_ms")) & (F.col("duration_ms") < F.col("_e")) & (F.col("_e") <= F.col("duration_ms") + tolerance_ms)
    rows = rows.withColumn("_e", F.when(clipped, F.col("duration_ms")).otherwise(F.col("_e")))
    rows = rows.withColumn("source_id", I.source_id(F.lit(kind), F.col("source_order"), F.col("start_ms") if "start_ms" in records.columns else F.lit(None), F.col("end_ms") if "end_ms" in records.columns else F.lit(None), F.col("source_id")))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    text = F.concat(F.lit(f'["{kind}",'), I.json_text(F.col("source_id")), F.lit(","), shown("_s"), F.lit(","), shown("_e"), F.lit("]"))
    provenance = F.coalesce(*said, F.when(F.col("_s").isNull(), "untimed"), measured, F.lit("source_timing"))
    return rows.select("media_id", F.concat(F.lit("timeline_"), F.substring(F.sha2(text, 256), 1, 20)).alias("timeline_id"), F.lit(kind).alias("kind"), "source_id", F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms"), provenance.alias("timing_provenance"), "source_order")


def order_key() -> list[Column]:
    """Chronological order: untimed last, start, kind, end or start, source order, id."""
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(100))
    return [F.col("start_ms").isNull(), F.coalesce("start_ms", F.lit(0)), kind, F.coalesce("end_ms", "start_ms", F.lit(0)), F.col("source_order"), F.col("source_id")]


def build_timeline(parts: list[DataFrame]) -> DataFrame:
    """All items of all kinds with their place in their media."""
    return reduce(DataFrame.unionByName, parts).withColumn("place", F.row_number().over(Window.partitionBy("media_id").orderBy(*order_key())))


def timeline_errors(items: DataFrame, media: DataFrame, given: str = "place") -> DataFrame:
    """(media_id, timeline_id, error) of items: ids that come again, half a range, invalid range, beyond the media, order other than chronological (by column ``given``)."""
    rows = items.join(media.select("media_id", "duration_ms"), "media_id", "left")
    again = F.row_number().over(Window.partitionBy("media_id", "timeline_id").orderBy(given)) > 1
    right = F.row_number().over(Window.partitionBy("media_id").orderBy(*order_key(), given))
    rows = rows.withColumns({"again": again, "right": right, "have": F.row_number().over(Window.partitionBy("media_id").orderBy(given))})
    timed = F.col("start_ms").isNotNull()
    invalid = timed & ((F.col("start_ms") < 0) | F.col("end_ms").isNull() | (F.col("end_ms") < F.col("start_ms")))
    beyond = timed & ((F.col("start_ms") > F.col("duration_ms")) | (F.coalesce("end_ms", F.lit(0)) > F.col("duration_ms")))
    found = [("duplicate timeline id", F.col("again")), ("partial timing range", F.col("start_ms").isNull() != F.col("end_ms").isNull()), ("invalid timing range", invalid), ("timing exceeds media duration", beyond), ("out of order", F.col("right") != F.col("have"))]
    each = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(name)) for name, on in found]))
    return rows.select("media_id", "timeline_id", F.explode(each).alias("error"))


def clip_to_media(segments: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments with a source's cue cut at the media's end, its provenance and uncertainty saying so; the adjustments)."""
    rows = segments.join(media.select("media_id", "duration_ms"), "media_id", "left")
    hit = F.coalesce(F.col("timing_provenance").startswith("source_") & (F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("duration_ms")) & (F.col("duration_ms") < F.col("end_ms")), F.lit(False))
    said = F.concat(F.lit("Source cue end "), F.col("end_ms"), F.lit("ms exceeded media duration "), F.col("duration_ms"), F.lit("ms; canonical end clipped to playable media."))
    rows = rows.withColumn("_hit", hit)
    changed = rows.where("_hit").select("media_id", "segment_id", "start_ms", F.col("end_ms").alias("original_end_ms"), F.col("duration_ms").alias("clipped_end_ms"))
    out = rows.withColumns({"uncertainty": F.when(F.col("_hit"), F.array_append("uncertainty", said)).otherwise(F.col("uncertainty")), "timing_provenance": F.when(F.col("_hit"), F.concat("timing_provenance", F.lit("_clipped_to_media"))).otherwise(F.col("timing_provenance")),
                            "end_ms": F.when(F.col("_hit"), F.col("duration_ms")).otherwise(F.col("end_ms"))})
    return out.select(*segments.columns), changed


def primary_language(segments: DataFrame, key: str) -> DataFrame:
    """The language of at least 60 % of each key's text, if the next has less than 70 % of its weight; else null. segments: key, language, text."""
    code = F.element_at(F.split(F.replace(F.lower(F.trim(F.coalesce("language", F.lit("")))), F.lit("_"), F.lit("-")), "-"), 1)
    raw = F.replace(F.lower(F.trim(F.coalesce("language", F.lit("")))), F.lit("_"), F.lit("-"))
    known = F.when(raw.isin("", "und", "unknown", "auto", "none", "null"), None).when(code.isin("fil", "tl"), "tl").when(code.rlike("^[a-z]{2,3}$"), code)
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    weights = segments.select(key, known.alias("code"), size.alias("w")).where("code is not null and w > 0").groupBy(key, "code").agg(F.sum("w").alias("w"))
    w = Window.partitionBy(key).orderBy(F.desc("w"), "code")
    best = weights.withColumns({"rn": F.row_number().over(w), "second": F.coalesce(F.lead("w").over(w), F.lit(0)), "total": F.sum("w").over(Window.partitionBy(key))}).where("rn = 1")
    out = best.select(key, F.when((F.col("w") * 100 >= F.col("total") * 60) & (F.col("second") * 100 < F.col("w") * 70), F.col("code")).alias("language"))
    return segments.select(key).distinct().join(out, key, "left")


def single_blocks(segments: DataFrame, mode: str) -> DataFrame:
    """A block a segment (media_id, source_order, segment_id, start_ms, end_ms, speaker, human_verified_text, repaired_text, normalized_text, raw_text, confidence, verification_status), numbered in order, with defaults where the segment says nothing.

    The first wording that is not empty is spoken, in the order above.
    """
    given = [F.nullif(F.col(c), F.lit("")) for c in ("human_verified_text", "repaired_text", "normalized_text", "raw_text")]
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("source_order", "segment_id"))
    return segments.select(
        "media_id", F.concat(F.lit("B"), F.lpad(number.cast("string"), 6, "0")).alias("block_id"), F.lit("C001").alias("chapter_id"), "start_ms", "end_ms", F.coalesce(F.nullif("speaker", F.lit("")), F.lit("Speaker 1")).alias("speaker"),
        F.coalesce(*given, F.lit("")).alias("spoken_text"), F.array("segment_id").alias("segment_ids"), F.lit(mode).alias("fidelity_mode"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce(F.nullif("verification_status", F.lit("")), F.lit("unverified")).alias("verification_status"))
