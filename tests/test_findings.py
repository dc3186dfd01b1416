"""Findings of round 3: queries against their oracles on small tables made for them."""

import random
from types import SimpleNamespace

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lumenspool.operators import claims as K
from lumenspool.operators import observations as O
from lumenspool.operators import packets
from lumenspool.operators import repair
from lumenspool.operators import reuse as R
from lumenspool.operators import selection
from lumenspool.operators import speakers as P
from lumenspool.operators import trees as T
from lumenspool.plans import catalog
from lumenspool.sources import listing as L
from lumenspool.sources import media as M
from lumenspool.streaming import journal as J


def matches(spark, folder, query, **tables):
    """Whether a query gives its oracle's rows over tables given as DuckDB SELECTs."""
    c = duckdb.connect()
    for name, select in tables.items():
        c.execute(f"create table {name} as {select}")
        c.execute(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    found = sorted(tuple(r) for r in catalog.QUERIES[query](spark, str(folder)).collect())
    wanted = sorted(c.execute(catalog.ORACLE[query]).fetchall())
    assert found == wanted and wanted


def test_review_ids_of_seven_digits(spark, tmp_path):
    matches(spark, tmp_path, "next_review_ids", orders="select (995000 + i * 7)::bigint as o_orderkey, (i % 90)::bigint as o_custkey from range(3000) r(i)")


def test_durations_half_way_between_two_ms(spark, tmp_path):
    matches(spark, tmp_path, "periodic_candidates", orders="select i::bigint as o_orderkey, (4287.5 + i)::double as o_totalprice from range(20) r(i)")


def test_links_are_summed_by_image(spark, tmp_path):
    tables = {"orders": "select i::bigint as o_orderkey from range(700) r(i)", "customer": "select i::bigint as c_custkey, 'n' || i as c_name, 'm' || i % 5 as c_mktsegment from range(4000) r(i)"}
    for query in ("linked_blocks", "resolved_reviews"):
        matches(spark, tmp_path, query, **tables)
    blocks = spark.createDataFrame([(1, ["a", "b"], ["x"], "open")], "block_id long, frame_ids array<string>, uncertainty array<string>, verification_status string")
    links = spark.range(20_000).selectExpr("if(id % 2 = 0, 'a', 'b') as image_id", "array(string(id)) as claim_ids", "'sufficient' as sufficiency")
    joined = O.linked_blocks(blocks, links)
    joined.write.format("noop").mode("overwrite").save()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.rindex("Aggregate [image_id")  # links are summed below the join


def test_trees_are_folded_without_broadcasts(spark):
    rows = spark.range(50).select(F.col("id").alias("k"), F.parse_json(F.concat(F.lit('{"b":[1,{"c":[],"a":{}}],"a":"'), "id", F.lit('"}'))).alias("tree"))
    texts = T.folded(rows, ["k"], "tree")
    assert sorted(tuple(r) for r in texts.collect()) == [(i, '{"a":"%d","b":[1,{"a":{},"c":[]}]}' % i) for i in range(50)]
    assert "Join" not in texts._jdf.queryExecution().optimizedPlan().toString()  # a joined level may go through the driver whole


def test_overlaps_are_counted_without_pairs(spark):
    turns = spark.range(400).select(F.expr("if(id % 50 = 7, null, id % 3)").alias("media_id"), F.col("id").alias("turn_order"), F.expr("(id * 7919) % 200000 - 500").alias("start_ms"), F.expr("(id * 7919) % 200000 - 500 + (id % 12) * 6000 - 6000").alias("end_ms"))
    turns = turns.where("end_ms <> start_ms").union(spark.sql("select 1L, 900L, 5L, 10L union all select 1L, 901L, 10L, 20L union all select 1L, 902L, 5L, 10L"))
    rows = [r for r in turns.collect() if r.media_id is not None and r.end_ms > r.start_ms]
    counted = P.overlap_counts(turns)
    wanted = {(a.media_id, a.turn_order): sum(a.media_id == b.media_id and a.turn_order != b.turn_order and a.start_ms < b.end_ms and b.start_ms < a.end_ms for b in rows) for a in rows}
    assert {(r.media_id, r.turn_order): r.overlaps for r in counted.collect()} == wanted
    listed = P.overlapping_turns(turns.where("media_id is not null and end_ms > start_ms"))
    assert {(r.media_id, r.turn_order): len(r.others) for r in listed.collect()} == {k: n for k, n in wanted.items() if n}


def test_bundles_meet_events_and_packets_once(spark, tmp_path):
    tables = {"orders": "select i::bigint as o_orderkey, (i * 37 % 400)::bigint as o_custkey from range(3000) r(i)"}
    matches(spark, tmp_path, "bundle_findings", **tables)
    plan = catalog.QUERIES["bundle_findings"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Left") == 3 and plan.count("Join") == 5  # heads, requests twice, events, packets; no branch joins by itself


def test_independent_support_makes_no_pairs(spark):
    kinds = "observation_id string, actor string, provider string, model string, version string, prompt string, depth string, prior_visible boolean"
    seen = [(f"o{i}", "human" if i == 11 else None if i == 12 else "model", None if i % 4 == 3 else str(i % 2), "m", "1", "x", "blind" if i % 3 == 1 else "cumulative", None if i % 5 == 4 else i % 5 == 0) for i in range(13)]
    observations = spark.createDataFrame(seen, kinds)
    claims = spark.range(400).select((F.col("id") % 20).alias("image_id"), F.col("id").cast("string").alias("claim_id"), F.expr("transform(sequence(0, cast(id % 4 as int)), i -> concat('o', (id * 7 + i * i * 3 + i) % 15))").alias("supporting"))
    found = {tuple(r) for r in K.with_independent_support(claims, observations).collect()}
    pairs = {(r.image_id, r.claim_id) for r in K.independent_pairs(claims, observations).collect()}
    human = {(r.image_id, r.claim_id) for r in claims.collect() if "o11" in r.supporting}
    assert found == pairs | human and pairs - human and len(found) < 400
    plan = K.with_independent_support(claims, observations)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "collect_list" not in plan


def test_dense_turns_are_assigned_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 40)
    turns = spark.range(300).select((F.col("id") % 2).alias("media_id"), F.expr("(id * 7919) % 300").alias("turn_order"), F.expr("(id * 613) % 9000").alias("start_ms"), F.expr("(id * 613) % 9000 + if(id = 17, 400000, (id % 24 + 1) * 50)").alias("end_ms"), F.concat(F.lit("S"), F.col("id")).alias("label"), (F.col("id") % 23 == 0).alias("boundary_uncertain"))
    segments = spark.range(400).select((F.col("id") % 3).alias("media_id"), F.col("id").alias("source_order"), F.expr("(id * 211) % 30000 - 500").alias("start_ms"), F.expr("if(id % 31 = 0, null, (id * 211) % 30000 - 500 + (id * 37) % 1500 + 1)").alias("end_ms"), F.lit("kept").alias("speaker"), F.array().cast("array<string>").alias("uncertainty"))
    given = turns.collect()

    def wanted(s):
        met = sorted((-(min(s.end_ms, t.end_ms) - max(s.start_ms, t.start_ms)), t.turn_order, t) for t in given if s.end_ms and t.media_id == s.media_id and t.start_ms < s.end_ms and s.start_ms < t.end_ms)
        if not met:
            return "kept", []
        unsure = met[0][2].boundary_uncertain or (len(met) > 1 and met[1][0] - met[0][0] <= 120)
        return met[0][2].label, ["uncertain_speaker_boundary"] if unsure else []

    done = P.assign(segments, turns)
    assert {r.source_order: (r.speaker, r.uncertainty) for r in done.collect()} == {s.source_order: wanted(s) for s in segments.collect()}
    assert "CoGroup" in done._jdf.queryExecution().optimizedPlan().toString()


def test_dense_frames_are_chosen_without_pairs(spark):
    frames = spark.range(900).select((F.col("id") % 2).alias("media_id"), F.expr("(id * 7919) % 900").alias("frame_id"), F.expr("if(id % 97 = 5, null, (id * 613) % 700000)").alias("actual_ms"), F.expr("if(id % 41 = 3, null, (id * 31 % 50) / 50)").alias("score"), (F.col("id") % 11 == 4).alias("mandatory"), F.expr("(id % 8) ^ shiftleft(id % 5, 20) ^ if(id % 3 = 0, 1023L << 40, 0L)").alias("hash"))
    done = selection.select_greedy(frames, 12, chunk_ms=150_000)
    wanted = {}
    for media in (0, 1):
        kept = []
        for f in sorted((r for r in frames.collect() if r.media_id == media), key=lambda r: (not r.mandatory, r.score is None, -(r.score or 0), r.actual_ms is not None, r.actual_ms or 0, r.frame_id)):
            by = next((k.frame_id for k in kept if None not in (k.actual_ms, f.actual_ms) and abs(k.actual_ms - f.actual_ms) <= 120_000 and (k.hash ^ f.hash).bit_count() <= 5), None)
            taken = f.mandatory or (by is None and len(kept) < 12)
            if taken:
                kept.append(f)
            wanted[media, f.frame_id] = (taken, f.frame_id if taken else by)
    assert {(r.media_id, r.frame_id): (r.selected, r.representative) for r in done.collect()} == wanted
    assert "bit_count" not in done._jdf.queryExecution().optimizedPlan().toString()  # frames met all chosen ones of their windows


def test_edges_are_not_shuffled_to_be_distinct(spark, monkeypatch):
    plans, write = [], R.written
    monkeypatch.setattr(R, "written", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, tag))
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "y"), (None, "a"), ("b", None)], "source string, target string")
    found = R.downstream(edges, spark.createDataFrame([("a",), ("a",), (None,)], "node string"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 1)]
    assert plans[1:] and all("Aggregate [source" not in p for p in plans)


def test_repeated_words_are_made_alike_once(spark):
    words = lambda at, texts: [(t, at + i * 100, at + i * 100 + 90) for i, t in enumerate(texts)]
    kinds = "media_id long, source_order long, segment_id string, start_ms long, end_ms long, text string, confidence double, words array<struct<text: string, start_ms: long, end_ms: long>>"
    rows = [(m, i, f"s{i}", i * 300, i * 300 + 490, " ".join(t), 0.5, words(i * 300, t)) for m in range(2) for i, t in enumerate((["a", "B", "c", "d", "e"], ["D ", "e", "f", "g", "h"], ["g", "H", "x", "y", "g"], ["y", "g"]))]
    found = repair.merge_overlapping(spark.createDataFrame(rows, kinds))
    assert sorted((r.media_id, r.segment_id, r.text) for r in found.collect()) == [(m, s, t) for m in range(2) for s, t in (("s0", "a B c d e"), ("s1", "f g h"), ("s2", "x y g"))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1  # each comparison of words made them alike anew, several times over


def test_evidence_asks_its_state_by_batch(monkeypatch):
    calls = []

    class State:
        def __init__(self, schema=None):
            self.held = {}

        get = lambda self: calls.append("get") or self.held.get(())
        exists = lambda self: calls.append("exists") or () in self.held
        update = lambda self, value: calls.append("update") or self.held.update({(): value})
        getValue = lambda self, key: calls.append("get") or self.held.get(key)
        containsKey = lambda self, key: calls.append("contains") or key in self.held
        updateValue = lambda self, key, value: calls.append("update") or self.held.update({key: value})

    handle = SimpleNamespace(getValueState=lambda name, schema: State(), getMapState=lambda name, key, value: State())
    rows = [(k if k % 11 else None, f"o{k * 7 % 90}", "xy"[k % 5 == 0], max(0, k - k % 3)) for k in range(200)]

    def folded(size):
        monkeypatch.setattr(J, "ENTRY_IDS", size, raising=False)
        processor, out = J.EvidenceProcessor(True), []
        processor.init(handle)
        for k in range(0, len(rows), 40):
            frames = [pd.DataFrame(rows[i : i + 20], columns=["ordinal", "observation_id", "digest", "base"]).astype({"ordinal": object}) for i in (k, k + 20)]
            out += [tuple(r) for f in processor.handleInputRows(("i",), iter(frames), None) for r in f.astype(object).where(f.notna(), None).values]
        return out

    few = folded(256)
    assert len(calls) <= 5 * 5  # two states read and written a batch; each row took two calls or three
    accepted, wanted, latest = {}, [], 0
    for k in range(0, len(rows), 40):
        for ordinal, observation, digest, base in sorted(rows[k : k + 40], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            if observation in accepted:
                outcome, revision = ("duplicate" if accepted[observation] == digest else "conflict"), None
            else:
                outcome, latest, accepted[observation] = ("accepted" if base == latest else "accepted_stale"), latest + 1, digest
                revision = latest
            wanted.append(("i", ordinal, observation, outcome, revision, base))
    assert few == folded(3) == wanted  # 90 ids in 32 entries, dealt anew as they grow


def test_probe_reports_are_read_once(spark):
    video = '{"index":%s,"codec_type":"video","duration":"%s","r_frame_rate":"%s","avg_frame_rate":"25/1","width":8,"height":%d,"tags":{"rotate":"90"}}'
    one = '{"streams":[%s,%s,{"index":0},{"codec_type":"audio"}],"chapters":[{"id":1},{"id":2}],"format":{"format_name":"mp4"}}' % (video % (7, "2.5", "25", 6), video % (3, "1", "0/0", 4))
    files = spark.createDataFrame([("a", one), ("b", "no json"), ("c", '{"streams":[%s],"format":{"duration":"9","bit_rate":"5"}}' % (video % (1, "1", "24/1", 0)))], "path string, content string")
    found = M.media_identity(files, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string"))
    rows = {r.path: r for r in found.select("path", "duration_ms", "container", "bit_rate", "video_streams", "audio_streams", "subtitle_streams", "r_frame_rate", F.col("resolution.height").alias("height"), "rotation", "variable", "chapters").collect()}
    assert tuple(rows["a"])[1:] == (2500, "mp4", None, 2, 0, 0, "0/0", 4, 90, False, 2)
    assert tuple(rows["c"])[1:] == (9000, None, 5, 1, 0, 0, "24/1", None, 90, True, 0)
    assert tuple(rows["b"])[1:] == tuple(rows["d"])[1:] == (None, None, None, 0, 0, 0, None, None, None, None, 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("Join") == 1  # streams, chapters, rates and format each read the reports


def test_hashes_meet_half_way(spark, monkeypatch):
    flips, given = [], selection._xor_all
    monkeypatch.setattr(selection, "_xor_all", lambda value, masks: flips.append(len(masks)) or given(value, masks))
    draw = random.Random(5)
    seeds = [draw.getrandbits(63) for _ in range(12)]
    hashes = [s ^ sum(1 << b for b in draw.sample(range(63), draw.randrange(10))) for s in seeds for _ in range(12)] + seeds[:3] * 2 + [None]
    rows = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    for most in (8, 3, 0):
        wanted = sorted((i, j, d) for j, y in enumerate(hashes) for i, x in enumerate(hashes[:j]) if None not in (x, y) and (d := (x ^ y).bit_count()) <= most)
        assert sorted(tuple(r) for r in selection.hamming_pairs(rows, most).collect()) == wanted and wanted
    assert sum(flips[:6]) <= 132  # one side changed all bits, which made 696 keys a hash


def test_claims_are_audited_in_two_passes(spark):
    kinds = "image_id string, claim_id string, status string, importance string, high_impact boolean, image_ids array<string>, last_revision_id string"
    rows = [(None if i == 5 else f"i{i % 4}", f"c{i % 9}", ("supported", "proposed", "disputed", "unresolved", None)[i % 5], ("high_impact", "supporting", None)[i % 3], i % 7 == 0, [f"i{i % 4}", f"i{i % 3}"][: i % 3], f"r{i % 4}" if i % 8 else None) for i in range(40)]
    cited = [("i0", f"c{k}") for k in range(5)] * 2 + [("zz", "c0"), (None, "c5")]
    seen = {("i0", "r0"), ("i1", "r1"), ("i2", "r3"), ("i3", "r2")}
    claims = spark.createDataFrame(rows, kinds).localCheckpoint()
    found = K.claim_findings(claims, spark.createDataFrame(cited, "image_id string, claim_id string"), spark.createDataFrame(list(seen) * 2, "image_id string, revision_id string"))
    wanted = [("unsupported", i, c) for i, c in set(cited) for r in ([r for r in rows if r[:2] == (i, c) and i] or [(i, c, None)]) if r[2] != "supported"]
    wanted += [(f, r[0], r[1]) for r in rows for f, holds in (("disputed", r[2] == "disputed"), ("unresolved", r[2] in ("proposed", "unresolved")), ("guarded", r[2] in ("proposed", "unresolved", "disputed") and (r[4] or r[3] == "high_impact" or r[2] == "disputed"))) if holds]
    at = {r[:2] for r in rows if r[5] and r[6]}
    fresh = {r[:2] for r in rows if r[0] and r[5] and r[6] and any((i, r[6]) in seen for i in r[5])}
    wanted += [("stale", *k) for k in at - fresh]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=order) == sorted(wanted, key=order)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("last_revision_id#") and sum("LogicalRDD" in line and "last_revision_id" in line for line in plan.splitlines()) == 2  # six passes before


def test_files_are_summed_by_folder_before_they_meet_roots(spark):
    paths = [f"{root}/{at}{k}" for root in ("p", "o/q", "x") for at in ("", "a/", ".state/cache/", ".state/cached/", ".state/checkpoints/ocr/d/", "n/.state/cache/") for k in range(3)] + ["p/.state/cache", "p", "lone", "x/", "x/.state/cache/", "q/a"]
    files = [(p, len(p) if i % 5 else None) for i, p in enumerate(paths)]
    listing = spark.createDataFrame(files, "path string, length long").localCheckpoint()
    roots = ["p", "o/q", "none"]

    def wanted(root):
        below = [(p[len(root) + 1 :], n) for p, n in files if root == p.rpartition("/")[0] or p.startswith(root + "/") or (p == root and "/" not in p)]
        free = [n or 0 for rest, n in below if rest.startswith(L.RECLAIMABLE)]
        return root, len(below), sum(n or 0 for _, n in below), len(free), sum(free)

    found = L.usage(listing, spark.createDataFrame([(r,) for r in roots], "project string"), "project")
    assert sorted(tuple(r) for r in found.select("project", "files", "bytes", "reclaimable_files", "reclaimable_bytes").collect()) == sorted(map(wanted, roots))
    out = L.unclassified(listing, spark.createDataFrame([("p",), ("o/q",)], "root string"))
    assert sorted(r.path for r in out.collect()) == sorted(p for p in paths if not (p == "p" or p.startswith(("p/", "o/q/"))))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate explode") < plan.rindex("Aggregate [")  # every file went up the tree by itself


def test_context_blocks_are_ranked_without_a_shuffle_of_pairs(spark):
    rng = random.Random(3)
    frames = lambda: rng.choice([None, [], ["F0"], ["F1", "F2"], ["F2", "F1", "F1"], ["F3"]])
    flag = lambda: rng.choice([None, True, False])
    given = [(i % 2, f"V{i}", 500 * i, 500 * i + rng.choice([0, 700, 90_000]), frames()) for i in range(40)]
    blocks = [(i % 2, f"B{i}", rng.choice([None, 480 * i, 500 * i]), None, frames(), flag(), flag(), flag()) for i in range(20)]
    blocks += [(i % 2, f"B{i}", 450 * i, 450 * i + rng.choice([0, 600, 70_000]), frames(), flag(), flag(), flag()) for i in range(20, 40)]
    wanted = []
    for project, candidate, start, end, own in given:
        found = []
        for p, block, s, e, its, *flags in blocks:
            linked = bool(set(own or []) & set(its or []))
            touched = s is not None and start <= (s if e is None else e) and s <= end
            if p == project and (linked or touched):
                over = max(0, min(end, s if e is None else e) - max(start, s)) if touched else 0
                priority = 4000 * linked + sum(n for n, f in zip((1000, 500, 250), flags, strict=True) if f) + min(over, 60_000) // 100
                found.append((-priority, s is not None, s, e is not None, e, block))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0, x[3], x[4] or 0, x[5]))
        wanted += [(project, candidate, x[5], -x[0], place) for place, x in enumerate(found, 1)]
    rows = packets.context_blocks(
        spark.createDataFrame(given, "project long, candidate_id string, start_ms long, end_ms long, frame_ids array<string>"),
        spark.createDataFrame(blocks, "project long, block_id string, start_ms long, end_ms long, frame_ids array<string>, unverified boolean, uncertain boolean, visual boolean"))
    assert sorted(tuple(r) for r in rows.collect()) == sorted(wanted)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # Places come from each packet's own list: nothing is shuffled or sorted after the pairs are there.
    assert "Window" not in plan and "FullOuter" not in plan
