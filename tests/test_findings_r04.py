"""Findings of round 4: what they name, on small tables made for it."""

import random

from lumenspool.operators import intervals, packets, repair, selection, speakers
from lumenspool.plans import catalog

HEARD = "media_id long, r_order long, start_ms long, end_ms long, text string, confidence double"
SPOKEN = "media_id long, source_order long, segment_id string, start_ms long, end_ms long, text string"


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def test_mean_confidence_is_summed_in_order(spark):
    confidences = [0.03, 0.54, 0.72, 0.83, 0.38]
    heard = [(1, i, 100 * i, 100 * i + 90, "w", c) for i, c in enumerate(confidences)]
    means = set()
    for rows in (heard, heard[::-1], heard[1::2] + heard[::2]):
        found = repair.repair(spark.createDataFrame([(1, 0, "s", 0, 1000, "w")], SPOKEN), spark.createDataFrame([(1, 0, 1000)], "media_id long, start_ms long, end_ms long"), spark.createDataFrame(rows, HEARD).coalesce(1))
        means.update((r.confidence, r.action) for r in found.collect())
    assert means == {(sum_in_order(confidences), "replace")}  # backwards the sum is below one half of them


def test_recognised_words_meet_segments_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(intervals, "PLACE_MS", 50)
    monkeypatch.setattr(intervals, "WIDER", 4)
    monkeypatch.setattr(intervals, "SLICE", 7)
    monkeypatch.setattr(repair, "BATCH_BYTES", 40)
    draw = random.Random(6)
    segments = [(draw.choice([0, 1, 2, None]), i, f"s{i}", s := draw.choice([None, *[draw.randrange(-200, 2000) for _ in range(8)]]), None if s is None or i % 37 == 5 else s + draw.choice([-5, 0, 1, 30, 200, 900, 100_000]), "w1 w2") for i in range(150)]
    heard = [(draw.choice([0, 1, 3, None]), i * 7919 % 400, s := draw.randrange(-300, 2200), None if i % 41 == 3 else s + draw.choice([-20, 0, 1, 40, 300, 5000]), draw.choice([None, "", " ", "w1", " w2 ", "w3"]), draw.choice([None, 0.1, 0.7, 0.55])) for i in range(400)]
    wanted = {}
    for media, order, _, start, end, _ in segments:
        met = sorted(h[1:] for h in heard if None not in (media, start, end, h[3]) and h[0] == media and h[2] < end and start < h[3])
        sure = [h[4] for h in met if h[4] is not None]
        wanted[order] = (" ".join(h[3].strip(" ") for h in met if (h[3] or "").strip(" ")), sum_in_order(sure) if sure else None)
    found = repair.recognised_for(spark.createDataFrame(segments, SPOKEN), spark.createDataFrame(heard, HEARD))
    assert {r.source_order: (r.after, r.confidence) for r in found.collect()} == wanted and found.count() == len(segments)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "r_text" not in plan[: plan.index("FlatMapGroupsInArrow")]  # a row a pair was shuffled and gathered by segment


def test_overlapping_turns_are_listed_in_order_of_time(spark, monkeypatch):
    monkeypatch.setattr(intervals, "PLACE_MS", 40)
    monkeypatch.setattr(intervals, "SLICE", 9)
    draw = random.Random(7)
    rows = [(draw.choice([0, 1, None]), i * 7919 % 250, s := draw.choice([None, *[draw.randrange(-100, 1500) for _ in range(9)]]), None if s is None or i % 31 == 3 else s + draw.choice([-5, 0, 1, 30, 90, 700, 50_000]), f"b{i % 5}") for i in range(250)]
    real = [r for r in rows if None not in r[:4] and r[3] > r[2]]
    wanted = {r[1]: [o[1] for o in sorted(real, key=lambda o: (o[2], o[3], o[1])) if r in real and o[0] == r[0] and o[1] != r[1] and o[2] < r[3] and r[2] < o[3]] for r in rows}
    found = speakers.with_overlaps(spark.createDataFrame(rows, "media_id long, turn_order long, start_ms long, end_ms long, backend_label string"))
    assert {r.turn_order: r.others for r in found.collect()} == wanted and found.count() == 250
    assert found.columns[:5] == ["media_id", "turn_order", "start_ms", "end_ms", "backend_label"]


def test_neutral_turns_name_those_that_overlap(spark):
    rows = catalog.QUERIES["neutralize_speaker_labels"](spark, "/root/testdata/sf0.001").collect()
    listed = {(r.media_id, r.turn_order): [int(x) for x in r.overlapping.split(",") if x] for r in rows}
    assert all(r.overlaps == len(listed[r.media_id, r.turn_order]) for r in rows) and any(listed.values())
    assert all(k in listed[m, o] for (m, k), others in listed.items() for o in others)  # only their number was given


def test_sufficiency_broadcasts_nothing(spark):
    for name in ("sufficiency_decisions", "evaluate_sufficiency"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan  # tables of a row an image went through the driver whole


def test_keys_of_hashes_are_not_broadcast(spark):
    rows = spark.range(300).selectExpr("id", "(id % 100) * 7919 as h")
    for most in (8, 0):
        plan = selection.hamming_pairs(rows, most)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan  # keys, 66 a hash, went through the driver


def test_context_blocks_meet_packets_where_they_are(spark, monkeypatch):
    draw = random.Random(8)
    frames = lambda: draw.choice([None, [], ["F0"], ["F1", "F2"], ["F2", None], ["F3"]])
    own = spark.createDataFrame([(draw.choice([0, 1, None]), f"V{i}", s := draw.choice([None, 300 * i]), s and s + draw.choice([0, 700, 9000]), frames()) for i in range(60)], "project long, candidate_id string, start_ms long, end_ms long, frame_ids array<string>")
    blocks = spark.createDataFrame([(draw.choice([0, 1, None]), f"B{i}", s := draw.choice([None, 290 * i]), s and draw.choice([None, s + 600, s + 8000]), frames(), i % 3 == 0, None, i % 7 == 0) for i in range(60)], "project long, block_id string, start_ms long, end_ms long, frame_ids array<string>, unverified boolean, uncertain boolean, visual boolean")
    rows = packets.context_blocks(own, blocks)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_sort(concat" not in plan  # what a packet touches was shuffled by packet, and each list sorted anew
    once = sorted(tuple(r) for r in rows.collect())
    monkeypatch.setattr(packets, "CONTEXT_MS", 1000)
    monkeypatch.setattr(intervals, "SLICE", 4)
    assert sorted(tuple(r) for r in packets.context_blocks(own, blocks).collect()) == once and len(once) > 100
    linked = {(p.candidate_id, b.block_id) for p in own.collect() for b in blocks.collect() if p.project is not None and p.project == b.project and ({*(p.frame_ids or ())} & {*(b.frame_ids or ())} - {None} or (None not in (p.start_ms, b.start_ms) and p.start_ms <= (b.start_ms if b.end_ms is None else b.end_ms) and b.start_ms <= p.end_ms))}
    assert {(r[1], r[2]) for r in once} == linked and len(linked) == len(once)
