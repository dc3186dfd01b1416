"""What observers say of packets: events, observations with proposed claims, links into events, blocks and reviews, bundles and their checks.

packets: packet_id, frames (array of structs frame_id, actual_ms, role, in the packet's order), questions (array of texts), ocr
(array of structs observation_id, frame_id, text, uncertain). annotations: packet_id, event_type, description, confidence,
uncertainty (array), roles (array of structs frame_id, role), evidence (array of frame ids), texts (array of structs frame_id,
text, confidence, uncertainty, region), changes (array of structs statement, confidence, uncertainty, before, action, after, region).
A packet has few frames and an annotation few claims, so they are arrays; everything else meets through joins on ids.

Defined cases: null arrays are empty; a packet without frames has no times; an annotation of an unknown packet gives
nothing; repeated annotations of a packet give their rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.functions import identity as I
from lumenspool.operators import intervals
from lumenspool.operators.blocks import PENDING

#: Texts of events that no observer has described, and of what links take away.
NO_ANNOTATOR = "No semantic annotator was available"
UNRESOLVED = "Semantic meaning unresolved for candidate reasons: "
NOTHING_ASSERTED = "no visual fact is asserted"
STILL_PENDING = "semantic visual analysis is pending"
NOT_INFERRED = "Deliberately not inferred: "
#: What makes a packet of an earlier observer worth another look.
RISK_PENDING, RISK_REVIEW, RISK_DOUBT, RISK_NOTES = 100.0, 50.0, 20.0, 10.0
RISKY = ("review_required", "disputed", "uncertain")
#: Claims of an image that a request shows, and characters of a statement.
SHOWN_CLAIMS, SHOWN_CHARACTERS = 12, 1000
#: Fixed value: uncertain characters that a prompt shows.
SHOWN_UNCERTAIN = 16
#: Why a transcript candidate was taken, or not.
BY_BACKEND = "Selected as the explicitly preferred usable local ASR backend."
BY_AUTHORITY = "Selected as the explicit local ASR authority while comparing supplied transcript candidates."
BY_RANK_LOCAL = "Selected as the highest-ranked usable independent local ASR candidate."
BY_RANK = "Selected as the highest-ranked usable independent transcript candidate."
NOT_TAKEN = "Preserved as an independent corroboration candidate; not selected."

_NONE = "array<string>"


def _list(column, kind: str = _NONE) -> Column:
    return F.coalesce(column, F.array().cast(kind))


def _ids(frames: Column) -> Column:
    return F.transform(frames, lambda f: f["frame_id"])


def _by_role(pairs: Column) -> Column:
    """Map from roles to their frames in order. pairs: array of structs role, frame_id."""
    roles = F.array_distinct(F.transform(pairs, lambda p: p["role"]))
    return F.map_from_arrays(roles, F.transform(roles, lambda r: _ids(F.filter(pairs, lambda p: p["role"] == r))))


def _span(packets: DataFrame) -> DataFrame:
    times = F.transform("frames", lambda f: f["actual_ms"])
    return packets.withColumns({"start_ms": F.array_min(times), "end_ms": F.array_max(times)})


def pending_events(packets: DataFrame) -> DataFrame:
    """An event a packet that nobody has described: its frames by role (the focus acts), its text, its questions as what is open."""
    pairs = F.transform("frames", lambda f: F.struct(F.when(f["role"] == "focus", "action").otherwise(f["role"]).alias("role"), f["frame_id"].alias("frame_id")))
    asked = _list(F.col("questions"))
    return _span(packets).select(
        "packet_id", "start_ms", "end_ms", F.lit("semantic_annotation_pending").alias("event_type"), _ids(F.col("frames")).alias("frame_ids"), _by_role(pairs).alias("roles"),
        F.transform("ocr", lambda o: o["observation_id"]).alias("ocr_ids"), F.lit(PENDING).alias("description"), F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit(NO_ANNOTATOR))).alias("uncertainty"),
        F.lit("supporting").alias("importance"), F.lit(None).cast("double").alias("confidence"), F.lit("review_required").alias("review_status"))


def annotated_events(annotations: DataFrame, packets: DataFrame) -> DataFrame:
    """An event an annotation: consequential if it names changes, to be reviewed if it names doubts, linked to the text of its evidence."""
    rows = annotations.join(_span(packets).select("packet_id", "start_ms", "end_ms", "ocr"), "packet_id")
    doubts = _list(F.col("uncertainty"))
    linked = F.transform(F.filter("ocr", lambda o: F.array_contains("evidence", o["frame_id"])), lambda o: o["observation_id"])
    return rows.select(
        "packet_id", "start_ms", "end_ms", "event_type", F.col("evidence").alias("frame_ids"), _by_role(F.col("roles")).alias("roles"), linked.alias("ocr_ids"), "description", doubts.alias("uncertainty"),
        F.when(F.size("changes") > 0, "consequential").otherwise("supporting").alias("importance"), "confidence", F.when(F.size(doubts) > 0, "review_required").otherwise("automatically_checked").alias("review_status"))


def survey_events(candidates: DataFrame, first: int = 1) -> DataFrame:
    """An event a survey candidate (media_id, requested_ms, actual_ms, reasons), numbered in order of requested time within its media."""
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("requested_ms", "actual_ms", F.array_join("reasons", ", "))) + (first - 1)
    at = F.coalesce("actual_ms", "requested_ms")
    return candidates.select("media_id", F.concat(F.lit("V"), F.lpad(number.cast("string"), 6, "0")).alias("event_id"), at.alias("start_ms"), at.alias("end_ms"), F.lit("survey_candidate").alias("event_type"),
                             F.lit(PENDING).alias("description"), F.concat(F.lit(UNRESOLVED), F.array_join("reasons", ", ")).alias("uncertainty"), F.lit("review_required").alias("review_status"))


def observed_images(annotations: DataFrame, packets: DataFrame) -> DataFrame:
    """(packet_id, image_ids, context_ids, unknowns): the packet's first focus, action or result frame, else the first of the evidence, then the rest of the evidence; what stays unknown."""
    rows = annotations.join(packets.select("packet_id", "frames"), "packet_id")
    acting = F.slice(_ids(F.filter("frames", lambda f: f["role"].isin("focus", "action", "result"))), 1, 1)
    primary = F.when(F.size(acting) > 0, acting).otherwise(F.slice("evidence", 1, 1))
    rows = rows.withColumn("_primary", primary).withColumn("_context", F.filter("evidence", lambda e: ~F.array_contains("_primary", e)))
    kept_back = F.transform(_list(F.col("not_inferred")), lambda t: F.concat(F.lit(NOT_INFERRED), t))
    return rows.select("packet_id", F.concat("_primary", "_context").alias("image_ids"), F.col("_context").alias("context_ids"), F.array_distinct(F.concat(_list(F.col("uncertainty")), kept_back)).alias("unknowns"))


def proposed_claims(annotations: DataFrame) -> DataFrame:
    """(packet_id, ordinal, claim_class, statement, importance, confidence, regions, uncertainty) that an annotation proposes, in order.

    The description first, unless the annotation is pending without confidence; then texts, then changes. regions: array of
    structs image_id, region (null: the whole frame); a change's region belongs to its last stage that has frames.
    """
    region = "array<struct<image_id: string, region: array<double>>>"
    whole = lambda ids: F.transform(ids, lambda i: F.struct(i.alias("image_id"), F.lit(None).cast("array<double>").alias("region"))).cast(region)
    doubts = F.nullif(F.array_join(_list(F.col("uncertainty")), "; "), F.lit(""))
    claim = lambda kind, statement, importance, confidence, regions, uncertainty: F.struct(F.lit(kind).alias("claim_class"), F.trim(statement).alias("statement"), F.lit(importance).alias("importance"), confidence.cast("double").alias("confidence"), regions.cast(region).alias("regions"), uncertainty.cast("string").alias("uncertainty"))
    seen = F.when((F.col("event_type") != "semantic_pending") | (F.col("confidence") > 0), F.array(claim("direct_visible", F.col("description"), "supporting", F.col("confidence"), whole(F.col("evidence")), doubts)))
    read = F.transform("texts", lambda t: claim("exact_text", t["text"], "supporting", t["confidence"], F.array(F.struct(t["frame_id"].alias("image_id"), t["region"].alias("region"))), t["uncertainty"]))

    def changed(c: Column) -> Column:
        before = F.when(c["before"].isNotNull(), F.array(c["before"])).otherwise(F.array().cast(_NONE))
        after, action = _list(c["after"]), _list(c["action"])
        ids = F.array_distinct(F.concat(before, action, after))
        target = F.when(F.size(after) > 0, after[0]).when(F.size(action) > 0, action[0]).otherwise(c["before"])
        marks = F.transform(ids, lambda i: F.struct(i.alias("image_id"), F.when(i == target, c["region"]).alias("region")))
        return claim("temporal_change", c["statement"], "consequential", c["confidence"], marks, c["uncertainty"])

    kind = "array<struct<claim_class: string, statement: string, importance: string, confidence: double, regions: " + region + ", uncertainty: string>>"
    every = F.concat(F.coalesce(seen.cast(kind), F.array().cast(kind)), F.coalesce(read.cast(kind), F.array().cast(kind)), F.coalesce(F.transform("changes", changed).cast(kind), F.array().cast(kind)))
    return annotations.select("packet_id", F.posexplode(every).alias("ordinal", "c")).select("packet_id", "ordinal", "c.*")


def linked_events(events: DataFrame, links: DataFrame) -> DataFrame:
    """events (event_id, event_type, description, provider, review_status, revision_ids, claim_ids) after links (event_id, event_type, description, confidence, uncertainty, provider, revision_id, claim_ids).

    A linked event takes the annotation's columns and gains its revision; it stays for review only if the annotation is pending, without confidence, and says that nothing is asserted.
    """
    nothing = (F.col("l.event_type") == "semantic_pending") & (F.col("l.confidence") <= 0) & F.exists(_list(F.col("l.uncertainty")), lambda u: F.contains(F.lower(u), F.lit(NOTHING_ASSERTED)))
    linked, old = F.col("l.event_id").isNotNull(), F.coalesce("e.revision_ids", F.array().cast(_NONE))
    rows = events.alias("e").join(links.alias("l"), F.col("e.event_id") == F.col("l.event_id"), "left")
    taken = lambda c: F.when(linked, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}")).alias(c)
    return rows.select("e.event_id", taken("event_type"), taken("description"), taken("provider"), F.when(~linked, F.col("e.review_status")).when(nothing, "review_required").otherwise("automatically_checked").alias("review_status"),
                       F.when(linked, F.array_union(old, F.array("l.revision_id"))).otherwise(F.col("e.revision_ids")).alias("revision_ids"), taken("claim_ids"))


def linked_blocks(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """blocks (block_id, frame_ids, uncertainty, verification_status) whose frames an observation (image_id, claim_ids, sufficiency) has described: pending notes go, and a sufficient one with claims checks the block."""
    images = links.groupBy("image_id").agg(F.bool_or((F.size("claim_ids") > 0) & (F.col("sufficiency") == "sufficient")).alias("_checked"))  # a row an image, so links do not multiply blocks
    hit = blocks.select("block_id", F.explode("frame_ids").alias("image_id")).join(images, "image_id").groupBy("block_id").agg(F.bool_or("_checked").alias("_checked"))
    rows = blocks.join(hit, "block_id", "left")
    left = F.filter("uncertainty", lambda u: ~F.contains(F.lower(u), F.lit(STILL_PENDING)))
    return rows.select("block_id", "frame_ids", F.when(F.col("_checked").isNotNull(), left).otherwise(F.col("uncertainty")).alias("uncertainty"), F.when(F.col("_checked"), "automatically_checked").otherwise(F.col("verification_status")).alias("verification_status"))


def resolved_reviews(reviews: DataFrame, links: DataFrame) -> DataFrame:
    """reviews (review_id, category, frame_ids, decision, reviewer): open ones of visual meaning are resolved by the provider with the least name of a sufficient observation with claims of one of their frames."""
    good = links.where("size(claim_ids) > 0 and sufficiency = 'sufficient'")
    asked = reviews.where((F.col("category") == "visual_semantic_annotation") & (F.coalesce("decision", F.lit("")) == ""))
    least = good.groupBy("image_id").agg(F.min("provider").alias("provider"))
    by = asked.select("review_id", F.explode("frame_ids").alias("image_id")).join(least, "image_id").groupBy("review_id").agg(F.min("provider").alias("_by"))
    rows = reviews.join(by, "review_id", "left")
    return rows.select("review_id", "category", "frame_ids", F.when(F.col("_by").isNotNull(), "resolved_by_semantic_observation").otherwise(F.col("decision")).alias("decision"), F.coalesce("_by", "reviewer").alias("reviewer"))


def legacy_packets(events: DataFrame, packets: DataFrame, providers: list[str], most: int) -> DataFrame:
    """(project, event_id, provider, priority, place, outcome): packets that an earlier provider described, for another look.

    events: project, event_id, event_type, provider, review_status, confidence, uncertainty. packets: project, event_id, score. outcome: selected
    (the first ``most`` of a project by score and risk), deferred, or missing (no packet; no place).
    """
    old = events.where(F.lower("provider").isin([p.lower() for p in providers]))
    doubt = F.when(F.col("confidence").isNotNull() & ~F.isnan("confidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("confidence"))) * RISK_DOUBT).otherwise(0.0)
    risk = (F.when(F.lower("event_type") == "semantic_pending", RISK_PENDING).otherwise(0.0) + F.when(F.lower("review_status").isin(*RISKY), RISK_REVIEW).otherwise(0.0) + doubt
            + F.least(F.lit(RISK_NOTES), F.size(_list(F.col("uncertainty"))).cast("double")))
    rows = old.withColumn("_risk", risk).join(packets, ["project", "event_id"], "left").withColumn("priority", F.round(F.col("score") + F.col("_risk"), 6))
    place = F.row_number().over(Window.partitionBy("project", F.col("priority").isNull()).orderBy(F.desc("priority"), "event_id"))
    rows = rows.withColumn("place", F.when(F.col("priority").isNotNull(), place))
    return rows.select("project", "event_id", "provider", "priority", "place", F.when(F.col("priority").isNull(), "missing").when(F.col("place") <= most, "selected").otherwise("deferred").alias("outcome"))


def metadata_context(frames: DataFrame, claims: DataFrame) -> DataFrame:
    """(packet_id, frame_id, ordinal, claim_id, statement) that a request shows of its frames (packet_id, frame_id): each image's first claims by impact, then doubt, then consequence, then their order.

    claims: image_id, ordinal, claim_id, statement, status, importance, high_impact. Claims without id or statement count but are not shown.
    """
    doubted = F.coalesce("status", F.lit("supported")).isin("disputed", "unresolved", "contradicted", "rejected")
    order = [F.desc(F.coalesce("high_impact", F.lit(False))), F.desc(doubted), F.desc(F.coalesce("importance", F.lit("supporting")) == "consequential"), "ordinal"]
    first = claims.withColumn("_place", F.row_number().over(Window.partitionBy("image_id").orderBy(*order))).where(F.col("_place") <= SHOWN_CLAIMS)
    shown = first.where((F.trim(F.coalesce("claim_id", F.lit(""))) != "") & (F.trim(F.coalesce("statement", F.lit(""))) != ""))
    rows = frames.select("packet_id", "frame_id").distinct().join(shown.withColumnRenamed("image_id", "frame_id"), "frame_id")
    return rows.select("packet_id", "frame_id", F.col("_place").alias("place"), "claim_id", F.substring(F.trim("statement"), 1, SHOWN_CHARACTERS).alias("statement"))


def has_textual_context(ocr: Column, blocks: Column, frames: Column) -> Column:
    """Whether a packet may depend on legible text: recognised text or uncertain characters, or text on screen of a nearby block that names no frames or one of the packet's (a crop counts as its frame).

    ocr: array of structs text, uncertain. blocks: array of structs on_screen (text), frame_ids. frames: array of frame ids.
    """
    own = F.array_union(frames, F.transform(frames, lambda f: F.split_part(f, F.lit("-C"), F.lit(1))))
    read = F.exists(ocr, lambda o: (F.trim(F.coalesce(o["text"], F.lit(""))) != "") | F.coalesce(o["uncertain"], F.lit(False)))
    near = F.exists(blocks, lambda b: (F.trim(F.coalesce(b["on_screen"], F.lit(""))) != "") & ((F.size(_list(b["frame_ids"])) == 0) | F.arrays_overlap(_list(b["frame_ids"]), own)))
    return F.coalesce(read, F.lit(False)) | F.coalesce(near, F.lit(False))


def bundle_findings(bundles: DataFrame, requests: DataFrame, events: DataFrame, packets: DataFrame, projects: DataFrame) -> DataFrame:
    """(bundle_id, finding, candidate_id) that keep a bundle from being applied.

    bundles: bundle_id, project, project_digest, mode (pending or legacy), providers. requests: bundle_id, candidate_id, packet_digest,
    source_provider, frames (array of structs frame_id, digest). events: project, event_id, provider. packets: project, event_id, digest,
    frames (the same). projects: project, digest.
    """
    legacy = F.col("mode") == "legacy"
    out = lambda df, name, candidate="candidate_id": df.select("bundle_id", F.lit(name).alias("finding"), (F.lit(None).cast("string") if candidate is None else F.col(candidate)).alias("candidate_id"))
    heads = bundles.join(projects.withColumnRenamed("digest", "_now"), "project", "left")
    found = [out(heads.where(~F.col("project_digest").eqNullSafe(F.col("_now"))), "project_changed", None),
             out(bundles.where(legacy & (F.size(_list(F.col("providers"))) == 0)), "legacy_without_providers", None), out(bundles.where(~legacy & (F.size(_list(F.col("providers"))) > 0)), "providers_without_legacy", None)]
    rows = requests.join(F.broadcast(bundles.select("bundle_id", "project", "mode", "providers")), "bundle_id")
    found.append(out(rows.groupBy("bundle_id", "candidate_id").count().where("count > 1"), "duplicate_candidate"))
    # One pass over the requests: each meets its event and packet once and lists what is wrong with it.
    keys = ["project", "candidate_id"]
    known = rows.join(events.select("project", F.col("event_id").alias("candidate_id"), F.col("provider").alias("_provider"), F.lit(True).alias("_event")).hint("merge"), keys, "left")
    known = known.join(packets.select("project", F.col("event_id").alias("candidate_id"), F.col("digest").alias("_digest"), F.col("frames").alias("_frames")).hint("merge"), keys, "left")
    allowed = F.exists(_list(F.col("providers")), lambda p: F.lower(p) == F.lower("_provider"))
    names = lambda c: F.array_sort(F.transform(c, lambda f: f["frame_id"]))
    changed = F.exists("frames", lambda f: F.exists("_frames", lambda g: (g["frame_id"] == f["frame_id"]) & ~g["digest"].eqNullSafe(f["digest"])))
    event, packet = F.col("_event").isNotNull(), F.col("_digest").isNotNull()
    faults = {"unknown_candidate": ~event, "provider_changed": legacy & event & ~F.coalesce(allowed, F.lit(False)), "source_provider_differs": legacy & event & ~F.col("source_provider").eqNullSafe(F.col("_provider")),
              "unexpected_source_provider": ~legacy & F.col("source_provider").isNotNull(), "packet_changed": ~F.col("packet_digest").eqNullSafe(F.col("_digest")), "frames_incomplete": packet & (names("frames") != names("_frames")), "frame_changed": packet & changed}
    listed = known.select("bundle_id", "candidate_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in faults.items()]))).alias("finding"))
    found.append(listed.select("bundle_id", "finding", "candidate_id"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.distinct()


def next_review_number(reviews: DataFrame) -> DataFrame:
    """(project, review_id) of the next review of each project: one more than the greatest number that an id R... has."""
    number = F.regexp_extract("review_id", r"^R([0-9]+)$", 1).try_cast("long")
    n = F.coalesce(F.max(number), F.lit(0)) + 1
    return reviews.groupBy("project").agg(F.concat(F.lit("R"), F.lpad(n.cast("string"), F.greatest(F.lit(6), F.length(n.cast("string"))), F.lit("0"))).alias("review_id"))


def bundle_bytes(packets: Column, request_bytes: int = 4 << 20, reserve: int = 1 << 20) -> Column:
    """Upper bound of a bundle's size; null without packets."""
    return F.when(packets > 0, packets * request_bytes + reserve)


def may_be_visual_only(kind: Column, segments: Column, completed_empty: Column, produced: Column, failed: Column) -> Column:
    """Whether a video may do without speech: every recogniser ended, none found any and none failed."""
    return (kind == "video") & (segments == 0) & completed_empty & ~produced & ~failed


def candidate_set(ranked: DataFrame, prefer_local: bool = False, preferred_backend: str | None = None) -> DataFrame:
    """ranked (media_id, candidate_id, source_type, origin, usable, rank) with selected and rationale.

    The best usable candidate that the local recogniser made, if that is preferred; else of the preferred backend; else the best usable one.
    """
    tier = F.lit(2)
    if preferred_backend:
        tier = F.when(F.lower("origin") == preferred_backend.lower(), 1).otherwise(tier)
    if prefer_local:
        tier = F.when(F.lower("source_type") == "local_asr", 0).otherwise(tier)
    best = F.min(F.when(F.col("usable"), F.struct(tier.alias("tier"), F.col("rank")))).over(Window.partitionBy("media_id"))
    local = F.min(F.when(F.lower("source_type") == "local_asr", 1).otherwise(0)).over(Window.partitionBy("media_id")) == 1
    rows = ranked.withColumns({"_best": best, "_local": local})
    selected = F.coalesce(F.col("usable") & (F.col("rank") == F.col("_best.rank")), F.lit(False))
    ranked_first = F.when(F.col("_local"), BY_RANK_LOCAL).otherwise(BY_RANK)
    why = F.lit(BY_BACKEND) if preferred_backend else F.lit(BY_AUTHORITY) if prefer_local else ranked_first
    return rows.select(*ranked.columns, selected.alias("selected"), F.when(selected, why).otherwise(NOT_TAKEN).alias("rationale"))


def crosschecked_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """segments (media_id, segment_id, start_ms, end_ms, speaker) with the one label that all overlapping turns (media_id, start_ms, end_ms, speaker) agree on, and uncertain where they do not."""
    right = turns.where("speaker is not null and speaker <> ''").select("media_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("speaker").alias("r_speaker"))
    met = intervals.range_join(segments.select("media_id", "segment_id", "start_ms", "end_ms"), right, "media_id")
    labels = met.groupBy("media_id", "segment_id").agg(F.count_distinct("r_speaker").alias("_n"), F.min("r_speaker").alias("_label"))
    rows = segments.join(labels, ["media_id", "segment_id"], "left")
    return rows.select(*[F.when(F.col("_n") == 1, F.col("_label")).otherwise(F.col("speaker")).alias("speaker") if c == "speaker" else F.col(c) for c in segments.columns], (F.coalesce("_n", F.lit(0)) > 1).alias("uncertain_boundary"))


def stale_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    """files (path, folder, name) of rejected frames that a finding names as without a mirror in the ledger; nothing else may go."""
    named = findings.select(F.regexp_extract("finding", r"^image_metadata: hidden candidate ([^/\\]+) lacks a canonical ledger mirror$", 1).alias("name")).where("name <> ''").distinct()
    return files.where("folder = 'rejected-frames'").join(named, "name", "left_semi")


def recorded_segments(segments: DataFrame) -> DataFrame:
    """segments (media_id, attempt, position, backend, words: array of structs text, start_ms, end_ms, ..) of a media's recognition attempts with candidate_id, segment_id and source_track, words with word_id.

    Segments are numbered through all attempts of a media in order; a word's id is made of its segment, place, times and text.
    """
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("attempt", "position"))
    rows = segments.withColumn("segment_id", I.sequential("transcript", number))
    word = lambda w, i: F.struct(w["text"].alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), I.deterministic("word", F.col("segment_id"), i, w["start_ms"], w["end_ms"], w["text"]).alias("word_id"))
    return rows.withColumns({"candidate_id": I.sequential("candidate", F.dense_rank().over(Window.partitionBy("media_id").orderBy("attempt"))), "source_track": F.concat(F.lit("local ASR backend="), "backend"), "words": F.transform("words", word)})


def prompt_text(characters: Column) -> Column:
    """struct(samples, count) of uncertain characters (array of texts): the first distinct ones that a prompt shows, and how many there are."""
    every = _list(characters)
    return F.struct(F.slice(F.array_distinct(every), 1, SHOWN_UNCERTAIN).alias("samples"), F.size(every).alias("count"))
