"""Survey candidates and frame choice by rules: signals, cadences, profiles, protections, packets of frames.

A candidate has candidate_id, requested_ms, actual_ms (null: not measured), reasons and score. Rows of one media
meet in windows or arrays of that media's points only.

Defined cases: null measurements count as 0, null texts as empty; ties of time go by the given order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.functions import columns as C
from lumenspool.functions import text as X
from lumenspool.functions import timing as M
from lumenspool.operators.quantiles import quantiles
from lumenspool.sinks.shared import written

#: Reasons that always protect, roles of a sequence, words that mark a boundary of speech or chapter.
PROTECTED = ("scene_cut", "ocr_change", "deictic_speech_reference", "chapter_boundary")
SEQUENCE_ROLES = ("before", "action", "after", "result")
BOUNDARY_WORDS = ("chapter", "deictic", "speech", "subtitle", "transcript", "boundary", "meaning")
BOUNDARY_REASONS = ("deictic_speech_reference", "chapter_boundary", "transcript_change", "subtitle_boundary", "ocr_change")
HIGH, VERY_HIGH = 0.75, 0.90
WINDOW_MS = 250


def signal_candidates(signals: DataFrame, key: str, order: str, least: float = 0.04, motion: float = 0.35, perceptual: float = 0.10) -> DataFrame:
    """Candidates of measured signals (key, order, actual_ms, frame_difference, perceptual_change, motion, blur, ocr_text): reasons, score and a number in the media.

    A difference counts from the media's median plus 2.5 median absolute deviations, at least ``least``.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = signals.withColumn("difference", F.greatest(zero("frame_difference"), F.lit(0.0)))
    middle = written(quantiles(rows, [key], "difference", {"middle": "median"}), "medians")  # a row a media, read twice
    away = rows.join(middle, key).withColumn("away", F.abs(F.col("difference") - F.col("middle")))
    spread = written(quantiles(away, [key], "away", {"mad": "median"}).join(middle, key).select(key, F.greatest(F.lit(least), F.col("middle") + 2.5 * F.col("mad")).alias("limit")), "limits")
    w = Window.partitionBy(key).orderBy("actual_ms", order)
    text = X.comparable(F.col("ocr_text"))
    rows = rows.join(spread, key).withColumns({"read": text, "read_before": F.lag(text).over(w), "blur_before": F.lag(zero("blur")).over(w)})
    found = [("adaptive_frame_difference", zero("frame_difference") >= F.col("limit"), F.least(F.lit(1.0), zero("frame_difference"))),
             ("perceptual_change", zero("perceptual_change") >= perceptual, F.least(F.lit(1.0), zero("perceptual_change"))), ("motion_change", zero("motion") >= motion, F.least(F.lit(1.0), zero("motion"))),
             ("ocr_change", F.col("read_before").isNotNull() & (F.col("read_before") != F.col("read")), F.lit(1.0)), ("post_motion_stable", (F.col("blur_before") >= 0.5) & (zero("blur") <= 0.2), F.lit(0.7))]
    each = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(name).alias("reason"), strength.alias("strength"))) for name, on, strength in found]))
    rows = rows.withColumn("found", each).where(F.size("found") > 0).withColumns({"reasons": F.col("found.reason"), "score": F.array_max(F.col("found.strength"))})
    return rows.withColumn("candidate_id", F.concat(F.lit("VC"), F.lpad(F.row_number().over(w).cast("string"), 6, "0"))).select(key, order, "candidate_id", "actual_ms", "reasons", "score")


def context_candidates(chapters: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Candidates at chapter boundaries and at speech that points at something. Both: key, time_ms. Numbered in order of time, reason, score."""
    tagged = chapters.select(key, "time_ms", F.lit("chapter_boundary").alias("reason"), F.lit(0.65).alias("score")).union(
        references.select(key, "time_ms", F.lit("deictic_speech_reference").alias("reason"), F.lit(0.75).alias("score"))).where("time_ms >= 0")
    number = F.row_number().over(Window.partitionBy(key).orderBy("time_ms", "reason", "score"))
    return tagged.select(key, F.concat(F.lit("VC"), F.lpad(number.cast("string"), 6, "0")).alias("candidate_id"), F.col("time_ms").alias("requested_ms"), F.array("reason").alias("reasons"), "score")


def periodic_candidates(media: DataFrame, key: str, interval_seconds: float = 30.0, guard_ms: int = 250) -> DataFrame:
    """Safety samples of each media (key, duration_ms)."""
    rows = media.select(key, F.posexplode(M.periodic_times(F.col("duration_ms"), interval_seconds, guard_ms)).alias("n", "requested_ms"))
    return rows.select(key, F.concat(F.lit("VC"), F.lpad((F.col("n") + 1).cast("string"), 6, "0")).alias("candidate_id"), "requested_ms", F.array(F.lit("periodic_safety")).alias("reasons"), F.lit(0.25).alias("score"))


def importance(reasons: Column, score: Column) -> Column:
    """Strongest reason's importance or the score, within 0 .. 1."""
    weighed = F.transform(reasons, lambda r: C.lookup(F.replace(F.lower(F.trim(r)), F.lit("-"), F.lit("_")), C.REASON_IMPORTANCE, 0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.array_max(weighed), F.lit(0.0)), score))


def is_protected(reasons: Column, score: Column) -> Column:
    return (importance(reasons, score) >= HIGH) | F.arrays_overlap(F.transform(reasons, lambda r: F.replace(F.lower(F.trim(r)), F.lit("-"), F.lit("_"))), F.array(*[F.lit(p) for p in PROTECTED]))


def merge_candidates(candidates: DataFrame, key: str, order: str, near_ms: int = 250, adaptive_ms: int = 1000) -> DataFrame:
    """Candidates clustered along time: a gap of near_ms to the one before joins, one of adaptive_ms if both are adaptive only.

    A cluster is represented by its first candidate that is protected, important, measured and strong, in this order; it has all reasons and the best score.
    """
    time = F.coalesce("actual_ms", "requested_ms")
    adaptive = (F.size("reasons") > 0) & (F.size(F.array_except("reasons", F.array(F.lit("adaptive_frame_difference"), F.lit("motion_change")))) == 0)
    rows = candidates.withColumns({"time": time, "joined": F.array_join("reasons", ","), "adaptive": adaptive})
    w = Window.partitionBy(key).orderBy("time", F.desc("score"), "joined", order)
    gap = F.col("time") - F.lag("time").over(w)
    near = (gap <= near_ms) | ((gap <= adaptive_ms) & F.col("adaptive") & F.lag("adaptive").over(w))
    rows = rows.withColumns({"new": (~F.coalesce(near, F.lit(False))).cast("int"), "place": F.row_number().over(w)})
    rows = rows.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct(is_protected(F.col("reasons"), F.col("score")), importance(F.col("reasons"), F.col("score")), F.col("actual_ms").isNotNull(), "score", -F.col("place"))
    out = rows.groupBy(key, "cluster").agg(F.max_by(F.struct("requested_ms", "actual_ms"), best).alias("p"), F.count(F.lit(1)).alias("members"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.max("score").alias("score"))
    return out.select(key, F.concat(F.lit("VC"), F.lpad(F.col("cluster").cast("string"), 6, "0")).alias("candidate_id"), "p.requested_ms", "p.actual_ms", "members", "reasons", "score")


def survey(signals: DataFrame, media: DataFrame, chapters: DataFrame, references: DataFrame, key: str, order: str, interval_seconds: float = 30.0) -> DataFrame:
    """All candidates of a media, merged: measured, periodic and by context."""
    none = F.lit(None).cast("long")
    measured = signal_candidates(signals, key, order).select(key, F.col("actual_ms").alias("requested_ms"), "actual_ms", "reasons", "score", F.lit(0).alias("source"))
    asked = periodic_candidates(media, key, interval_seconds).select(key, "requested_ms", none.alias("actual_ms"), "reasons", "score", F.lit(1).alias("source"))
    told = context_candidates(chapters, references, key).select(key, "requested_ms", none.alias("actual_ms"), "reasons", "score", F.lit(2).alias("source"))
    return merge_candidates(measured.union(asked).union(told), key, "source")


def coverage(candidates: DataFrame, key: str, media: DataFrame | None = None, strict_gap_ms: int = 30_000) -> DataFrame:
    """A row a media: count, first and last time, greatest gap with head and tail, whether it keeps the limit, reasons and tiers counted, protected candidates."""
    rows = candidates.withColumns({"time": F.coalesce("actual_ms", "requested_ms"), "important": importance(F.col("reasons"), F.col("score"))})
    w = Window.partitionBy(key).orderBy("time", "candidate_id")
    rows = rows.withColumn("gap", F.col("time") - F.lag("time").over(w))
    tier = lambda name: F.count_if(C.tier(F.col("important")) == name).alias(name)
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"), F.min("time").alias("first_ms"), F.max("time").alias("last_ms"), F.coalesce(F.max("gap"), F.lit(0).cast("long")).alias("inner_gap"),
                                tier("very_high"), tier("high"), tier("supporting"), tier("low"), F.count_if(is_protected(F.col("reasons"), F.col("score"))).alias("protected"))
    reasons = rows.select(key, F.explode("reasons").alias("reason")).groupBy(key, "reason").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"))
    out = out.join(reasons, key, "left")
    gap = F.col("inner_gap")
    if media is not None:
        out = media.select(key, "duration_ms").join(out, key, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
        gap = F.greatest(F.coalesce(gap, F.lit(0)), F.coalesce("first_ms", "duration_ms"), F.greatest(F.lit(0), F.col("duration_ms") - F.coalesce("last_ms", F.lit(0))))
    return out.withColumn("max_gap_ms", gap).withColumn("within_limit", F.col("max_gap_ms") <= strict_gap_ms).drop("inner_gap", "duration_ms")


def classify(motion: Column, difference: Column, edges: Column, letters: Column, face: Column, n: Column) -> Column:
    """struct(labels, confidence) of a stretch by the means of its measurements."""
    text_heavy, slides = (letters >= 80) & (edges >= 0.08), letters >= 25
    found = F.array_compact(F.array(
        F.when(text_heavy, F.struct(F.lit("text-heavy-screen").alias("l"), F.least(F.lit(1.0), letters / 250 + edges).alias("s"))).when(slides, F.struct(F.lit("slides-or-interface").alias("l"), F.least(F.lit(1.0), letters / 100).alias("s"))),
        F.when((face >= 0.08) & (motion < 0.35), F.struct(F.lit("talking-head-or-interview").alias("l"), F.least(F.lit(1.0), face * 4).alias("s"))),
        F.when((motion >= 0.45) | (difference >= 0.3), F.struct(F.lit("motion-heavy").alias("l"), F.least(F.lit(1.0), F.greatest(motion, difference)).alias("s"))),
        F.when((motion < 0.08) & (difference < 0.04), F.struct(F.lit("static-visual").alias("l"), F.lit(0.8).alias("s")))))
    labels = F.when(n == 0, F.array(F.lit("unknown"))).when(F.size(found) == 0, F.array(F.lit("mixed-or-unclassified"))).otherwise(F.transform(found, lambda x: x["l"]))
    return F.struct(labels.alias("labels"), F.when(n == 0, 0.0).when(F.size(found) == 0, 0.25).otherwise(F.array_max(F.transform(found, lambda x: x["s"]))).alias("confidence"))


def profile(media: DataFrame, metrics: DataFrame, key: str, range_ms: int = 60_000) -> DataFrame:
    """Stretches of range_ms of each media (key, duration_ms) with means, labels and confidence; stretches without a metric are unknown.

    metrics: key, time_ms, motion, frame_difference, edge_density, ocr_character_count, face_area_ratio (may be null).
    """
    every = media.select(key, "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.col("duration_ms"), F.lit(1)) - 1) / range_ms))).alias("bucket"))
    names = ("motion", "frame_difference", "edge_density", "ocr_character_count", "face_area_ratio")
    sums = metrics.groupBy(key, F.floor(F.col("time_ms") / range_ms).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names])
    rows = every.join(sums, [key, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    said = classify(*[F.col(c) for c in names[:4]], F.coalesce("face_area_ratio", F.lit(0.0)), F.col("n"))
    return rows.select(key, (F.col("bucket") * range_ms).alias("start_ms"), F.least(F.col("duration_ms"), (F.col("bucket") + 1) * range_ms).alias("end_ms"), "n", said["labels"].alias("labels"), said["confidence"].alias("confidence"))


def media_profile(media: DataFrame, metrics: DataFrame, scenes: DataFrame, key: str) -> DataFrame:
    """A row a media: mean motion, scenes a minute, seconds between safety samples. scenes: key, time_ms."""
    motion = metrics.groupBy(key).agg(F.avg("motion").alias("motion"))
    count = scenes.groupBy(key).agg(F.count(F.lit(1)).alias("scenes"))
    rows = media.select(key, "duration_ms").join(motion, key, "left").join(count, key, "left").fillna(0.0, ["motion"]).fillna(0, ["scenes"])
    return rows.select(key, "motion", (F.col("scenes") / F.greatest(F.col("duration_ms") / 60_000, F.lit(1 / 60))).alias("scene_density"), M.periodic_interval(F.col("duration_ms"), F.col("scenes"), F.col("motion")).alias("interval_seconds"))


def request_groups(requests: DataFrame, key: str, time: str, order: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """requests with a group number: a request nearer than window_ms to the one before begins a new group, since looks ahead would overlap."""
    w = Window.partitionBy(key).orderBy(time, order)
    new = F.coalesce(F.col(time) - F.lag(time).over(w) < window_ms, F.lit(False)).cast("int")
    return requests.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def prefers_exact(n: Column, first_ms: Column, last_ms: Column) -> Column:
    """Whether a group of n requests is fetched one by one: few, or sparse over its span."""
    span = last_ms - first_ms
    density = F.try_divide(n, span / 1000)
    return (n <= 2) | (span <= 0) | ((n == 3) & (density <= 0.15)) | (density <= 4.0)


def reason_tokens(reasons: Column) -> Column:
    """Distinct words of all reasons, lower case with underscores."""
    words = F.flatten(F.transform(reasons, lambda r: F.split(F.trim(F.replace(F.lower(r), F.lit("-"), F.lit("_"))), r"\s+")))
    return F.array_distinct(F.filter(words, lambda x: x != ""))


def marks_boundary(reasons: Column) -> Column:
    """Whether a reason names a boundary of speech, transcript, subtitle, chapter or meaning, or a change of text."""
    joined = F.lower(F.replace(F.array_join(reasons, " "), F.lit("-"), F.lit("_")))
    return joined.rlike("|".join(BOUNDARY_WORDS)) | F.arrays_overlap(reason_tokens(reasons), F.array(*[F.lit(r) for r in BOUNDARY_REASONS]))


def protections(mandatory: Column, consequential: Column, important: Column, role: Column, reasons: Column, periodic: bool = True, high: float = HIGH, very_high: float = VERY_HIGH) -> Column:
    """Why a frame is never dropped as a duplicate, in order."""
    cases = [F.when(mandatory, "mandatory"), F.when(consequential, "consequential_change"), F.when(important >= very_high, "very_high_importance").when(important >= high, "high_importance"),
             F.when(role.isin(*SEQUENCE_ROLES), "before_action_after_role"), F.when(marks_boundary(reasons), "transcript_or_context_boundary")]
    if periodic:
        cases.append(F.when(F.lower(F.replace(F.array_join(reasons, " "), F.lit("-"), F.lit("_"))).contains("periodic_safety"), "periodic_coverage"))
    return F.array_distinct(F.array_compact(F.array(*cases)))


def frame_score(c: dict[str, Column], role: Column, consequential: Column) -> Column:
    """Evidence score of a frame, 0 to 1, with what a role in a sequence and a small consequential change add."""
    base = (0.18 * c["relevance"] + 0.17 * c["importance"] + 0.09 * c["proximity"] + 0.12 * c["sharpness"] + 0.09 * c["stability"] + 0.10 * c["novelty"] + 0.09 * c["ocr"] + 0.08 * c["completeness"])
    bonus = F.when(role.isin(*SEQUENCE_ROLES), 0.08).otherwise(0.0) + F.when(consequential, 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + bonus - 0.12 * c["transition_risk"]))


def duplicate_decision(hamming: Column, ratio: Column, mean: Column, edge: Column, region: Column, left_text: Column, right_text: Column, left_role: Column, right_role: Column, consequential: Column) -> Column:
    """struct(is_duplicate, ocr_changed, protected): whether two frames' measured difference makes them one, and what speaks against it."""
    a, b = X.comparable(left_text), X.comparable(right_text)
    changed = a != b
    roles = left_role.isin(*SEQUENCE_ROLES) & right_role.isin(*SEQUENCE_ROLES) & (left_role != right_role)
    against = F.array_compact(F.array(F.when(changed, "ocr_change"), F.when(consequential, "consequential_event"), F.when(roles, "before_action_after_role"),
                                      F.when((region >= 0.012) | (edge >= 0.0025), "localized_pixel_or_structure_change")))
    alike = (hamming <= 5) & (ratio <= 0.008) & (mean <= 0.006)
    return F.struct((alike & (F.size(against) == 0)).alias("is_duplicate"), changed.alias("ocr_changed"), against.alias("protected"))


def relaxed_duplicate(hamming: Column, ratio: Column, mean: Column, edge: Column, decided: Column, left: Column, right: Column) -> Column:
    """Whether two frames of low importance are one by the wider limits. decided: protections of the pair; left, right: each frame's."""
    free = ~F.arrays_overlap(decided, F.array(F.lit("ocr_change"), F.lit("consequential_event"), F.lit("before_action_after_role"))) & (F.size(left) == 0) & (F.size(right) == 0)
    return free & (hamming <= 8) & (ratio <= 0.05) & (mean <= 0.03) & (edge <= 0.03)


def guarded_motion(d: dict[str, Column], regions: Column, next_hamming: Column, ocr_stable: Column, reason: Column, width: Column, height: Column, boundary: Column) -> Column:
    """Whether a difference is motion at the picture's rim only: small, text unchanged, no boundary, every changed region (x, y, w, h) at an outer band."""
    rim = lambda r: (r["x"] <= width * 0.18) | (r["y"] <= height * 0.18) | (r["x"] + r["w"] >= width * 0.82) | (r["y"] + r["h"] >= height * 0.82)
    named = F.lower(reason).rlike("periodic|sequence|transcript|scene|chapter|ocr|before|action|after|deictic")
    small = (d["hamming"] <= 8) & (d["ratio"] <= 0.08) & (d["region"] <= 0.25) & (d["mean"] <= 0.08) & (d["edge"] <= 0.12)
    return F.coalesce(ocr_stable & ~boundary & ~named & (next_hamming <= 4) & small & (width > 0) & (height > 0) & (F.size(regions) > 0) & F.forall(regions, rim), F.lit(False))


def covers_frame(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return (x == 0) & (y == 0) & (w == width) & (h == height)


def packet_frames(frames: Column, focus_ms: Column, span_ms: int = 15_000) -> Column:
    """Frames (structs actual_ms, frame_id) nearest to the focus whose whole span stays within span_ms, in order of time."""
    near = F.array_sort(F.transform(F.array_distinct(frames), lambda f: F.struct(F.abs(f["actual_ms"] - focus_ms).alias("d"), f["actual_ms"].alias("actual_ms"), f["frame_id"].alias("frame_id"))))
    none = F.array().cast("array<struct<actual_ms: bigint, frame_id: string>>")
    start = F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), none.alias("kept"))

    def take(acc: Column, f: Column) -> Column:
        low, high = F.least(acc["low"], f["actual_ms"]), F.greatest(acc["high"], f["actual_ms"])
        mine = F.struct(f["actual_ms"].cast("long").alias("actual_ms"), f["frame_id"].cast("string").alias("frame_id"))
        return F.when(high - low <= span_ms, F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.array_append(acc["kept"], mine).alias("kept"))).otherwise(acc)

    return F.array_sort(F.aggregate(near, start, take)["kept"])


def within_bytes(sizes: Column, most: Column) -> Column:
    """Indexes (from 0) of evenly spread records whose sizes fit the budget; a second pass fills what is left in order."""
    n, total = F.size(sizes), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    wanted = F.least(n.cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(most / F.greatest(F.lit(1), F.floor(total / n)))))
    spread = F.when(wanted == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), wanted - 1), lambda i: F.bround(i * (n - 1) / (wanted - 1), 0).cast("long"))))
    order = F.concat(spread, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def take(acc: Column, i: Column) -> Column:
        size = F.get(sizes, i.cast("int"))
        fits = (acc["used"] + size <= most) & ~F.array_contains(acc["kept"], i)
        return F.when(fits, F.struct((acc["used"] + size).cast("long").alias("used"), F.array_append(acc["kept"], i).alias("kept"))).otherwise(acc)

    every = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    return F.when(n == 0, F.array().cast("array<bigint>")).when(total <= most, every).otherwise(F.array_sort(F.aggregate(order, start, take)["kept"]))
