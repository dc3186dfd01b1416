"""Packets of visual evidence for review: scores, keys, proofs of no change, choice under a budget, links and retries.

packets: project, candidate_id, frames (array of structs frame_id, role, change), questions, selection_reason, ocr (array of
structs text, uncertain). A packet's frames are few; packets relate to frames, events and blocks by ids.

Defined cases: a packet without frames proves nothing; unknown frames make a proof impossible; null reasons are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.functions import text as X
from lumenspool.operators import intervals

#: What an event's importance and words of a reason add to a packet's score.
IMPORTANCE = {"incidental": 0.0, "supporting": 1.0, "consequential": 8.0, "high_impact": 12.0}
REASONS = {"hard-scene": 8.0, "scene-cut": 8.0, "consequential": 5.0, "ocr": 4.0, "adaptive": 2.0}


def score(importance: Column, has_scene: Column, claims: Column, frames: Column, reason: Column, ocr: Column, questions: Column) -> Column:
    """Priority of a packet by its event, roles, reasons, text, questions and measured change. importance is null for a packet without event."""
    event = F.coalesce(*[F.when(F.lower(importance) == k, F.lit(v)) for k, v in IMPORTANCE.items()], F.lit(1.0)) + F.when(has_scene, 2.0).otherwise(0.0) + F.least(F.lit(2.0), claims * 0.25)
    roles = F.size(F.array_intersect(F.transform(frames, lambda f: f["role"]), F.array(F.lit("focus"), F.lit("action"), F.lit("result")))) * 2.0
    said = F.replace(F.lower(F.coalesce(reason, F.lit(""))), F.lit("_"), F.lit("-"))
    words = sum((F.when(F.contains(said, F.lit(k)), v).otherwise(0.0) for k, v in REASONS.items()), F.lit(0.0))
    text = F.when(F.exists(ocr, lambda o: o["uncertain"]), 4.0).otherwise(0.0) + F.when(F.exists(ocr, lambda o: F.trim(o["text"]) != ""), 3.0).otherwise(0.0)
    asked = F.when(F.exists(questions, lambda q: F.contains(F.lower(q), F.lit("consequential"))), 3.0).otherwise(0.0)
    change = F.array_max(F.transform(frames, lambda f: f["change"]))
    moved = F.when(change.isNotNull(), F.least(F.lit(6.0), change * 6.0) + F.when((change > 0) & (change <= 0.05), 3.0).otherwise(0.0)).otherwise(0.0)
    return F.when(importance.isNotNull(), event).otherwise(0.0) + roles + words + text + asked + moved


def scope_key(*parts: Column) -> Column:
    """Digest of all that a packet shows and asks, but for its id."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def frame_proofs(packets: DataFrame, frames: DataFrame) -> DataFrame:
    """packets with proof: 'no_change' if at least two frames have one pixel hash, else 'stable_visible_state' if they have one verified perceptual hash, no measured change and certain, equal text; else null.

    frames: project, frame_id, pixel_hash, perceptual_hash, verified.
    """
    each = packets.select("project", "candidate_id", F.explode("frames").alias("f")).select("project", "candidate_id", "f.frame_id", "f.change").join(frames, ["project", "frame_id"], "left")
    one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    sums = each.groupBy("project", "candidate_id").agg(F.count(F.lit(1)).alias("_frames"), one("pixel_hash").alias("identical"), (one("perceptual_hash") & F.every(F.coalesce("verified", F.lit(False))) & F.every(F.col("change").isNull())).alias("steady"))
    rows = packets.join(sums, ["project", "candidate_id"], "left")
    certain = ~F.exists("ocr", lambda o: o["uncertain"]) & (F.size(F.array_distinct(F.transform("ocr", lambda o: X.comparable(o["text"])))) <= 1)
    proof = F.when(F.coalesce("_frames", F.lit(0)) < 2, None).when(F.col("identical"), "no_change").when(F.col("steady") & certain, "stable_visible_state")
    return rows.withColumn("proof", proof).drop("_frames", "identical", "steady")


def upgraded(annotations: DataFrame, proofs: DataFrame) -> DataFrame:
    """annotations (project, candidate_id, event_type, confidence) where a pending one without confidence gives way to a proof."""
    rows = annotations.join(proofs.select("project", "candidate_id", "proof"), ["project", "candidate_id"], "left")
    gives = (F.col("event_type") == "semantic_pending") & (F.col("confidence") == 0) & F.col("proof").isNotNull()
    sure = F.when(F.col("proof") == "no_change", 1.0).otherwise(0.98)
    return rows.withColumns({"confidence": F.when(gives, sure).otherwise(F.col("confidence")), "event_type": F.when(gives, F.col("proof")).otherwise(F.col("event_type")), "upgraded": gives}).drop("proof")


def remapped(ids: Column, source: Column, target: Column) -> Column:
    """Frame ids of one packet as those at the same places of another; ids that the source lacks stay. Null if the lists differ in length."""
    return F.when(F.size(source) == F.size(target), F.transform(ids, lambda i: F.coalesce(F.get(target, F.array_position(source, i).cast("int") - 1), i)))


def annotation_errors(candidate: Column, packet_candidate: Column, event_type: Column, confidence: Column, cited: Column, roles: Column, frames: Column, focus: Column) -> Column:
    """What is wrong with an annotation of a packet: other candidate, pending with confidence, cited or role frames outside the packet, no focus frame cited."""
    return F.array_compact(F.array(F.when(candidate != packet_candidate, "candidate mismatch"), F.when((event_type == "semantic_pending") & (confidence != 0), "pending must have zero confidence"), F.when(F.size(F.array_except(cited, frames)) > 0, "unknown evidence frame"),
                                   F.when(F.size(F.array_except(roles, cited)) > 0, "role outside evidence"), F.when(~F.arrays_overlap(cited, focus), "no focus frame")))


def completed_evidence(cited: Column, mentioned: Column, frames: Column) -> Column:
    """Evidence ids with those that the annotation mentions and the packet has."""
    return F.array_union(cited, F.array_intersect(mentioned, frames))


def pending(packets: DataFrame, events: DataFrame) -> DataFrame:
    """Packets whose event no provider has observed. events: project, event_id, annotation_provider."""
    seen = events.where("trim(annotation_provider) <> ''").select("project", F.col("event_id").alias("candidate_id"))
    return packets.join(seen, ["project", "candidate_id"], "left_anti")


def retry_counts(annotations: DataFrame, prompt: str) -> DataFrame:
    """(project, fallbacks, stale): pending annotations that record a failed request, and those made with another prompt. annotations also has uncertainty and prompt_hash."""
    rows = annotations.where("event_type = 'semantic_pending'")
    return rows.groupBy("project").agg(F.count_if(F.exists("uncertainty", lambda u: F.contains(u, F.lit("HTTP Error 400")))).alias("fallbacks"), F.count_if(F.col("prompt_hash").isNotNull() & (F.col("prompt_hash") != prompt)).alias("stale"))


def retry_priority(event_type: Column, confidence: Column) -> Column:
    """2 for a pending record that claims confidence, 1 for a pending one, else 0."""
    return F.when(event_type != "semantic_pending", 0).when(F.coalesce(confidence, F.lit(0.0)) > 0, 2).otherwise(1)


def select(packets: DataFrame, budget: int) -> DataFrame:
    """packets (project, candidate_id, ordinal, scope, score, proved, retry) with chosen: what is proved is free and what is to be retried comes first; half of the other slots go to evenly spread packets, the rest by score.

    Packets of one scope share the first one's slot.
    """
    first = F.row_number().over(Window.partitionBy("project", "scope").orderBy("ordinal", "candidate_id"))
    rows = packets.withColumn("lead", F.col("proved") | (first == 1))
    leads = rows.where("lead and not proved")
    by = lambda *order: F.row_number().over(Window.partitionBy("project").orderBy(*order))
    leads = leads.withColumns({"place": by(F.desc("retry"), "ordinal", "candidate_id"), "retries": F.count_if(F.col("retry")).over(Window.partitionBy("project"))})
    rest = leads.where("not retry").withColumns({"i": by("ordinal", "candidate_id") - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("project"))})
    slots = F.greatest(F.lit(budget) - F.col("retries"), F.lit(0))
    anchors = F.ceil(slots / 2)
    rest = rest.withColumns({"slots": slots, "anchors": anchors})
    step = F.when(F.col("anchors") > 1, F.exists(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("anchors") - 1, F.lit(0))), lambda k: F.bround(k * (F.col("n") - 1) / (F.col("anchors") - 1), 0) == F.col("i"))).otherwise((F.col("anchors") == 1) & (F.col("i") == 0))
    rest = rest.withColumn("anchor", F.when(F.col("n") <= F.col("slots"), True).otherwise(step))
    rest = rest.withColumn("left", F.col("slots") - F.count_if(F.col("anchor")).over(Window.partitionBy("project")))
    rest = rest.withColumn("by_score", F.row_number().over(Window.partitionBy("project", "anchor").orderBy(F.desc("score"), "ordinal", "candidate_id")))
    chosen = rest.where("anchor or by_score <= left").select("project", "scope").union(leads.where(F.col("retry") & (F.col("place") <= budget)).select("project", "scope")).distinct().withColumn("_hit", F.lit(True))
    return rows.join(chosen, ["project", "scope"], "left").withColumn("chosen", F.col("proved") | F.coalesce("_hit", F.lit(False))).drop("_hit", "lead")


#: Width of the places in which packets meet blocks, and rows after which a batch of them is handed on.
CONTEXT_MS, BATCH_ROWS = 60_000, 1 << 18


def _context(own: pa.Table, touching: pa.Table, linked: pa.Table) -> Iterator[pa.RecordBatch]:
    """Ranked blocks of each packet. Packets of equal frames share one sorted list, into which each puts those that it touches."""
    number = lambda t, c: pc.fill_null(t[c], 0).to_numpy().astype(np.int64)
    touching = touching.sort_by("r_start")
    names = ("block", "start", "given", "base")
    known = pa.concat_tables([t.select([p + n for n in names]).rename_columns(names) for p, t in (("r_", touching), ("i_", linked))])
    coded = known["block"].combine_chunks().dictionary_encode()
    codes, blocks = coded.indices.to_numpy(), coded.dictionary
    once = np.zeros(len(blocks), np.int64)
    once[codes[::-1]] = np.arange(len(codes))[::-1]
    unique = known.take(pa.array(once))
    base, tie = number(unique, "base"), np.empty(len(blocks), np.int64)
    tie[pc.sort_indices(unique, sort_keys=[("start", "ascending"), ("given", "ascending"), ("block", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(blocks))
    key = lambda priority, block: (-priority << 32) + tie[block]
    near, far = codes[: len(touching)], codes[len(touching) :]
    begins, ends = number(touching, "r_start"), number(touching, "r_end")
    reach = np.maximum.accumulate(ends)
    by_item: dict[str, list[int]] = {}
    for item, block in zip(linked["item"].to_pylist(), far.tolist(), strict=True):
        by_item.setdefault(item, []).append(block)
    frames = [tuple(f or ()) for f in own["frames"].to_pylist()]
    timed = pc.and_(own["start_ms"].is_valid(), own["end_ms"].is_valid()).to_numpy()
    starts, stops = number(own, "start_ms"), number(own, "end_ms")
    shared, at, rows, ranks, lists = None, np.full(len(blocks), -1), 0, [], []

    def batch() -> pa.RecordBatch:
        sizes = [len(x) for x in ranks]
        whose, which, rank = pa.array(np.repeat([k for k, _ in lists], sizes)), np.concatenate([x for _, x in lists]), np.concatenate(ranks)
        place = np.arange(len(rank)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) + 1
        return pa.RecordBatch.from_arrays([own["project"].combine_chunks().take(whose), own["candidate_id"].combine_chunks().take(whose), blocks.take(pa.array(which)), pa.array(-(rank >> 32)), pa.array(place.astype(np.int32))], ["project", "candidate_id", "block_id", "priority", "place"])

    for k in sorted(range(len(own)), key=lambda k: tuple(str(f) for f in frames[k])):
        if frames[k] != shared:
            shared = frames[k]
            mine = np.unique(np.array([b for f in set(shared) for b in by_item.get(f, ())], np.int64))
            keys = key(base[mine] + 4000, mine)
            order = np.argsort(keys)
            mine, keys = mine[order], keys[order]
            at[:] = -1
            at[mine] = np.arange(len(mine))
        which, rank = mine, keys
        if timed[k] and (i := np.searchsorted(reach, starts[k], "right")) < (j := np.searchsorted(begins, stops[k], "left")):
            met = i + np.flatnonzero(ends[i:j] > starts[k])
            block, place = near[met], at[near[met]]
            over = np.minimum(np.maximum(np.minimum(stops[k], ends[met]) - 1 - np.maximum(starts[k], begins[met]), 0), 60_000)
            added = key(np.where(place >= 0, 4000, 0) + base[block] + over // 100, block)
            order = np.argsort(added)
            rest = np.ones(len(mine), bool)
            rest[place[place >= 0]] = False
            to = np.searchsorted(keys[rest], added[order])
            which, rank = np.insert(mine[rest], to, block[order]), np.insert(keys[rest], to, added[order])
        if len(which):
            lists.append((k, which))
            ranks.append(rank)
            rows += len(which)
        if rows > BATCH_ROWS:
            yield batch()
            rows, ranks, lists = 0, [], []
    if rows:
        yield batch()


def context_blocks(packets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(project, candidate_id, block_id, priority, place): blocks that share a frame with a packet or touch its span (ends included), most important first.

    packets: project, candidate_id, start_ms, end_ms, frame_ids. blocks: project, block_id, start_ms, end_ms, frame_ids, unverified, uncertain, visual.
    Pairs are not shuffled: what packets of one stretch of time touch and what shares a frame with one of them comes to where they
    are, and places are those in each packet's own list. (project, candidate_id) and (project, block_id) are unique.
    """
    one = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    given = blocks.withColumn("base", one(F.col("unverified"), 1000) + one(F.col("uncertain"), 500) + one(F.col("visual"), 250))
    rows = packets.select("project", "candidate_id", F.array_sort(F.array_distinct("frame_ids")).alias("frames"), F.col("start_ms").cast("long").alias("start_ms"), (F.col("end_ms") + 1).cast("long").alias("end_ms"))
    named = lambda p: [F.col("block_id").alias(f"{p}block"), F.col("start_ms").cast("long").alias(f"{p}start"), F.col("end_ms").cast("long").alias(f"{p}given"), F.col("base").alias(f"{p}base")]
    right = given.select("project", *named("r_"), (F.coalesce("end_ms", "start_ms") + 1).cast("long").alias("r_end"))
    linked = given.select("project", F.explode(F.array_distinct("frame_ids")).alias("item"), *named("i_"))
    kinds = dict(packets.dtypes) | dict(blocks.dtypes)
    shape = f"project {kinds['project']}, candidate_id {kinds['candidate_id']}, block_id {kinds['block_id']}, priority bigint, place int"
    return intervals.gathered(rows, right, "project", _context, shape, CONTEXT_MS, ("frames", linked))


def prior_claims(packets: DataFrame, known: DataFrame, claims: DataFrame, most: int = 128) -> DataFrame:
    """(project, candidate_id, claim_ids): claims that packets' frames know (project, frame_id, position, claim_id), then those that cite them (project, claim_id, ordinal, image_ids); each once, the first ``most``."""
    wanted = packets.select("project", "candidate_id", F.explode("frame_ids").alias("frame_id")).distinct()
    a = wanted.join(known, ["project", "frame_id"]).select("project", "candidate_id", "claim_id", F.struct(F.lit(0).alias("t"), F.col("frame_id").alias("f"), F.col("position").cast("long").alias("o")).alias("at"))
    b = wanted.join(claims.select("project", "claim_id", "ordinal", F.explode("image_ids").alias("frame_id")), ["project", "frame_id"]).select("project", "candidate_id", "claim_id", F.struct(F.lit(1).alias("t"), F.lit("").alias("f"), F.col("ordinal").cast("long").alias("o")).alias("at"))
    first = a.union(b).groupBy("project", "candidate_id", "claim_id").agg(F.min("at").alias("at"))
    return first.groupBy("project", "candidate_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "claim_id"))), lambda x: x["claim_id"]), 1, most).alias("claim_ids"))
