"""Small fixtures for semantics that the tables do not reach."""

import pytest
from pyspark.sql import functions as F

from lumenspool.functions import columns as C
from lumenspool.operators import captions, intervals


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_clock(spark):
    read = lambda t: spark.createDataFrame([(t,)], "t string").select(C.parse_clock(F.col("t")).alias("x")).first().x
    assert [read(t) for t in ("1:02:03,4567", "02:03.5", "90", "1.2345", "1:60", "x", "61:00")] == [3723456, 123500, 90000, 1234, None, None, None]
    assert one(spark, C.clock(F.col("t")), t=3723456) == "01:02:03.456"


def test_aliases(spark):
    assert one(spark, C.language_family(F.col("t")), t="TL_ph") == "fil"
    assert one(spark, C.source_priority(F.col("t"), F.lit(True)), t="Whisper") == 3
    assert one(spark, C.source_priority(F.col("t")), t="creator-caption") == 4
    assert one(spark, C.fence(F.col("t")), t="a ```` b") == "`````"


def test_union_touching_and_strict(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 11, 20), (1, 20, 30), (1, 5, 5), (1, -5, 3)], "k int, start_ms long, end_ms long")
    assert sorted((r.start_ms, r.end_ms) for r in intervals.union(df, ["k"], 1).collect()) == [(0, 30)]
    assert sorted((r.start_ms, r.end_ms) for r in intervals.union(df, ["k"], 0).collect()) == [(0, 10), (11, 30)]


def test_range_join_pairs_once(spark):
    left = spark.createDataFrame([("m", i, i * 700, i * 700 + 25_000) for i in range(20)], "k string, i int, start_ms long, end_ms long")
    right = spark.createDataFrame([("m", j, j * 900, j * 900 + 31_000) for j in range(20)], "k string, j int, r_start long, r_end long")
    got = sorted((r.i, r.j) for r in intervals.range_join(left, right, "k").collect())
    assert got == sorted((i, j) for i in range(20) for j in range(20) if i * 700 < j * 900 + 31_000 and j * 900 < i * 700 + 25_000)


def test_loops_and_duplicates(spark):
    texts = ["a", "b", "a", "b", "x", "x"]
    df = spark.createDataFrame([(1, i, t, i * 1000, i * 1000 + 900) for i, t in enumerate(texts)], "media_id int, source_order long, raw_text string, start_ms long, end_ms long")
    assert [(r.width, r.offset) for r in captions.loops(df).collect()] == [(2, 0)]
    flags = {r.source_order: r.duplicate for r in captions.flags(df).collect()}
    assert flags == {0: False, 1: False, 2: True, 3: True, 4: False, 5: True}


def test_untimed_and_broken_cues(spark):
    df = spark.createDataFrame([(1, 0, None, None, None), (1, 1, "ok", 5, None), (1, 2, "ok", 9, 3), (1, 3, "", 0, 9)], "media_id int, source_order long, raw_text string, start_ms long, end_ms long")
    rows = {r.source_order: r for r in captions.flags(df).collect()}
    assert rows[0].placeholder and rows[1].broken_boundary and rows[2].invalid_range and rows[3].placeholder
    assert not rows[0].overlap and not rows[1].invalid_range


def test_cue_files(spark):
    from lumenspool.sources import transcripts as T

    srt = "1\r\n00:00:00,000 --> 00:00:01,500\r\nHello\r\nthere\r\n\r\n00:00:02,000 --> 00:00:03,000\r\nSecond"
    vtt = "WEBVTT\n\nNOTE skip\n\nid\n00:01.000 --> 00:02.000 align:start\n<v Ann>Hi &amp; bye</v>\n"
    files = spark.createDataFrame([("a.srt", srt), ("b", vtt), ("c.srt", None), ("d.txt", "")], "path string, content string")
    got = [(r.path, r.source_order, r.start_ms, r.end_ms, r.speaker_label, r.normalized_text) for r in T.read_transcripts(files).orderBy("path", "source_order").collect()]
    assert got == [("a.srt", 0, 0, 1500, None, "Hello\nthere"), ("a.srt", 1, 2000, 3000, None, "Second"), ("b", 0, 1000, 2000, "Ann", "Hi & bye")]
    bad = spark.createDataFrame([("a.srt", "1\nno times\n")], "path string, content string")
    assert T.parse_srt(bad, lenient=True).count() == 0
    with pytest.raises(Exception, match="without times"):
        T.parse_srt(bad).collect()


def test_json_shapes(spark):
    from lumenspool.sources import transcripts as T

    contents = ['[{"text": "a", "start": 1.0005, "end": "0:02"}]', '{"text": ["b", "c"], "start_ms": 5}', '{"segments": [], "transcript": "d"}', '{"results": [{"transcript": "e", "duration": 2, "start": 1}]}']
    files = spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "path string, content string")
    assert [(r.path, r.start_ms, r.end_ms, r.raw_text, r.timing_provenance) for r in T.parse_json_transcript(files).orderBy("path").collect()] == [
        ("0", 1000, 2000, "a", "source_json"), ("1", 5, None, "b c", "source_json"), ("2", None, None, "d", "untimed_source"), ("3", 1000, 3000, "e", "source_json")]


def test_decode_is_without_loss(spark):
    from lumenspool.sources import transcripts as T

    rows = [(0, b"caf\xc3\xa9"), (1, b"\xef\xbb\xbfx"), (2, "ab".encode("utf-16")), (3, "ab".encode("utf-16-be")), (4, b"caf\xe9 \x80"), (5, b"a\x00" + b"b" * 20), (6, b"\x81"), (7, b"")]
    got = {r.i: (r.d.text, r.d.encoding) if r.d else None for r in spark.createDataFrame(rows, "i int, content binary").select("i", T.decode(F.col("content")).alias("d")).collect()}
    assert got == {0: ("café", "utf-8-sig"), 1: ("x", "utf-8-sig"), 2: ("ab", "utf-16"), 3: ("愀戀", "utf-16-le"), 4: ("café €", "cp1252"), 5: None, 6: None, 7: ("", "utf-8-sig")}


def test_semi_and_anti_joins_keep_repeats_and_nulls(spark):
    left = spark.createDataFrame([("m", 0, 5, None), ("m", 0, 5, None), ("m", 50, 60, "x"), ("m", None, None, "y"), ("m", 0, 90_000_000, "long")], "k string, start_ms long, end_ms long, note string")
    right = spark.createDataFrame([("m", 1, 2), ("m", 80_000_000, 80_000_001)], "k string, r_start long, r_end long")
    semi, anti = (sorted(str(r.note) for r in intervals.range_join(left, right, "k", kind=kind).collect()) for kind in ("left_semi", "left_anti"))
    assert semi == ["None", "None", "long"] and anti == ["x", "y"]
    assert intervals.range_join(left, right, "k").count() == 4


def test_rank_without_a_global_sort(spark):
    rows = [(i, (i * 37 % 11) / 10) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, score double")
    got = {r.i: r["rank"] for r in intervals.ranked(df, [("s", F.floor(F.col("score") * 10), True), ("b", F.shiftright("i", 4), False)], ["i"]).collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda x: (-int(x[1] * 10), x[0])))}


def test_greedy_selection(spark):
    from lumenspool.operators.selection import select_greedy

    rows = [(1, 1, 0, 0.9, False, 0), (1, 2, 1000, 0.8, False, 1), (1, 3, 500_000, 0.7, False, 0), (1, 4, 2000, 0.1, True, 0), (1, 5, 9000, 0.6, False, -1)]
    frames = spark.createDataFrame(rows, "media_id long, frame_id long, actual_ms long, score double, mandatory boolean, hash long")
    got = {r.frame_id: (r.selected, r.representative) for r in select_greedy(frames, 2).collect()}
    assert got == {4: (True, 4), 1: (False, 4), 2: (False, 4), 3: (True, 3), 5: (False, None)}


def test_streaming_profile(spark, tmp_path):
    from lumenspool.streaming.profile import tumbling_profile

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = tumbling_profile(stream).writeStream.outputMode("complete").format("memory").queryName("profile").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("profile").collect())) == sorted(map(tuple, tumbling_profile(events).collect()))


def test_packet_frames_stay_within_their_span(spark):
    from lumenspool.operators import survey

    rng = __import__("random").Random(4)
    rows = [(i, rng.randrange(40_000), sorted({(rng.randrange(40_000), f"F{k}") for k in range(rng.randrange(9))}, key=lambda x: rng.random())) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, focus long, frames array<struct<actual_ms: long, frame_id: string>>")
    got = {r.i: [tuple(x) for x in r.kept] for r in df.select("i", survey.packet_frames(F.col("frames"), F.col("focus")).alias("kept")).collect()}
    for i, focus, frames in rows:
        kept = []
        for f in sorted(frames, key=lambda f: (abs(f[0] - focus), f[0], f[1])):
            times = [x[0] for x in [*kept, f]]
            if max(times) - min(times) <= 15_000:
                kept.append(f)
        assert got[i] == sorted(kept)


def test_byte_budget_is_spread(spark):
    from lumenspool.operators import survey

    rng = __import__("random").Random(5)
    rows = [(i, [rng.randrange(1, 50) for _ in range(rng.randrange(0, 20))], rng.randrange(1, 300)) for i in range(60)]
    got = {r.i: r.k for r in spark.createDataFrame(rows, "i long, sizes array<long>, most long").select("i", survey.within_bytes(F.col("sizes"), F.col("most")).alias("k")).collect()}
    for i, sizes, most in rows:
        n, total = len(sizes), sum(sizes)
        if total <= most:
            want = list(range(n))
        else:
            wanted = max(1, min(n, most // max(1, total // n)))
            order = [0] if wanted == 1 else sorted({round(k * (n - 1) / (wanted - 1)) for k in range(wanted)})
            used, kept = 0, []
            for k in [*order, *range(n)]:
                if k not in kept and used + sizes[k] <= most:
                    kept.append(k)
                    used += sizes[k]
            want = sorted(kept)
        assert got[i] == want


def test_packet_choice(spark):
    from lumenspool.operators import packets

    rows = [(1, f"V{i:02d}", i, f"s{i // 2}", float(i % 5), i == 9, i in (4, 12)) for i in range(20)]
    df = spark.createDataFrame(rows, "project long, candidate_id string, ordinal long, scope string, score double, proved boolean, retry boolean")
    got = {r.candidate_id for r in packets.select(df, 6).where("chosen").collect()}
    leads = [f"V{i:02d}" for i in range(0, 20, 2)]
    assert {"V04", "V05", "V12", "V13", "V09", "V00", "V01", "V18", "V19"} <= got and len([x for x in got if x in leads]) == 6


def test_merging_keeps_repeats_at_other_times(spark):
    from lumenspool.operators import repair

    word = lambda t, a: {"text": t, "start_ms": a, "end_ms": a + 90}
    rows = [(1, 0, "a", 0, 300, "yes yes we", 0.5, [word("yes", 0), word("yes", 100), word("we", 200)]), (1, 1, "b", 190, 500, "we can", 0.5, [word("We", 210), word("can", 300)]), (1, 2, "c", 600, 700, "can", None, [word("can", 600)]),
            (1, 3, "d", 605, 700, "CAN", 0.9, [word("CAN", 605)]), (1, 4, "e", None, None, "can", None, []), (2, 0, "f", 0, 10, "x", None, None)]
    df = spark.createDataFrame(rows, "media_id long, source_order long, segment_id string, start_ms long, end_ms long, text string, confidence double, words array<struct<text: string, start_ms: long, end_ms: long>>")
    got = [(r.media_id, r.segment_id, r.start_ms, r.text) for r in repair.merge_overlapping(df).orderBy("media_id", "source_order").collect()]
    assert got == [(1, "a", 0, "yes yes we"), (1, "b", 300, "can"), (1, "d", 605, "CAN"), (1, "e", None, "can"), (2, "f", 0, "x")]


def test_json_sink_hides_secrets(spark, tmp_path):
    from lumenspool.sinks import documents

    df = spark.createDataFrame([(1, {"api_key": "x", "k": "v"}, "https://a.b/c?token=1")], "id long, m map<string,string>, url string")
    documents.write_json(df, f"file://{tmp_path}/j")
    row = spark.read.json(f"file://{tmp_path}/j").first()
    assert row.m.api_key == "[REDACTED]" and row.m.k == "v" and row.url == "https://a.b/c?[REDACTED]"
    documents.replace_rows(f"file://{tmp_path}/p", spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), ("k",))
    documents.replace_rows(f"file://{tmp_path}/p", spark.createDataFrame([(2, 3)], "k int, v int"), ("k",))
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"file://{tmp_path}/p").collect()) == [(1, 1), (2, 3)]


def test_greedy_selection_equals_brute_force(spark):
    from lumenspool.plans.catalog import QUERIES

    rows = QUERIES["selection_greedy"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault(r.media_id, []).append(r)
    for group in by.values():
        chosen = []
        for r in sorted(group, key=lambda r: (not r.mandatory, -r.score, r.actual_ms, r.frame_id)):
            near = next((c for c in chosen if abs(c.actual_ms - r.actual_ms) <= 120_000 and bin((c.hash ^ r.hash) & (2**64 - 1)).count("1") <= 5), None)
            take = r.mandatory or (near is None and len(chosen) < 40)
            assert r.selected == take and r.representative == (r.frame_id if take else near and near.frame_id)
            if take:
                chosen.append(r)


def _greedy(rows, budget):
    chosen, out = [], {}
    for media, frame, t, score, mandatory, h in sorted(rows, key=lambda r: (not r[4], r[3] is None, -(r[3] or 0), r[2] is not None, r[2] or 0, r[1])):
        near = next((c[1] for c in chosen if None not in (t, h, c[2], c[3]) and abs(c[2] - t) <= 120_000 and bin((c[3] ^ h) & (1 << 64) - 1).count("1") <= 5), None)
        take = mandatory or (near is None and len(chosen) < budget)
        if take:
            chosen.append((media, frame, t, h))
        out[frame] = (bool(take), frame if take else near)
    return out


@pytest.mark.parametrize("chunk_ms", [100_000, 400_000, 3_600_000])
def test_greedy_selection_by_brute_force(spark, chunk_ms):
    import random

    from lumenspool.operators.selection import select_greedy, selection_report

    rng = random.Random(chunk_ms)
    rows = [(m, m * 1000 + i, rng.choice([rng.randrange(2_000_000), rng.randrange(2_000_000), None if i % 20 == 0 else 5]), rng.choice([0.1, 0.5, rng.random(), None]), rng.random() < 0.05, rng.choice([rng.randrange(16), (1 << 40) - 1, -1, None if i % 25 == 0 else 0])) for m in range(2) for i in range(150)]
    rows += [(7, 7000 + i, 30_000 * i, i / 50, False, 0) for i in range(50)]  # scores rise with time: each choice waits for a later one
    frames = spark.createDataFrame(rows, "media_id long, frame_id long, actual_ms long, score double, mandatory boolean, hash long").repartition(3)
    chosen = select_greedy(frames, 12, chunk_ms=chunk_ms)
    want = {f: v for m in (0, 1, 7) for f, v in _greedy([r for r in rows if r[0] == m], 12).items()}
    assert {r.frame_id: (r.selected, r.representative) for r in chosen.collect()} == want
    for r in selection_report(chosen, F.when(F.col("score") > 0.5, "high").otherwise("low")).collect():
        own = [f for f in want if f // 1000 == r.media_id] if r.media_id else [f for f in want if f < 1000]
        assert (r.candidates, r.selected, r.low_score) == (len(own), sum(want[f][0] for f in own), sum(want[f][1] is None for f in own))
    assert select_greedy(frames.limit(0), 3).collect() == []


def test_thinning_of_one_long_media(spark):
    from lumenspool.operators.selection import thin_points

    n = 1_000_000
    points = spark.range(n).select(F.lit("m").alias("media_id"), (F.col("id") * 1000 + F.col("id") % 7).alias("t")).union(spark.createDataFrame([("a", 5), ("a", None), (None, 3), (None, 3)], "media_id string, t long"))
    found = [(r.media_id, r.t) for r in thin_points(points.repartition(4), "media_id", "t", 30_000).collect()]
    times = [i * 1000 + i % 7 for i in range(n)]
    want, last = [], None
    for t in times:
        if last is None or t - last >= 30_000:
            want.append(t)
            last = t
    assert sorted(t for m, t in found if m == "m") == sorted({*want, times[-1]})
    assert {x for x in found if x[0] != "m"} == {(None, 3), ("a", 5)}


def test_merging_of_one_long_media(spark):
    from lumenspool.operators.repair import merge_overlapping

    word = F.array(F.struct(F.concat(F.lit("w"), (F.col("id") / 2).cast("int")).alias("text"), F.col("start_ms"), F.col("end_ms")))
    rows = spark.range(20_000).withColumn("start_ms", F.floor(F.col("id") / 2) * 1000 + F.col("id") % 2 * 100).withColumn("end_ms", F.col("start_ms") + 700)
    rows = rows.select(F.lit(1).alias("media_id"), F.col("id").alias("source_order"), F.col("id").cast("string").alias("segment_id"), "start_ms", "end_ms", F.concat(F.lit("w"), (F.col("id") / 2).cast("int")).alias("text"), (F.col("id") % 2 / 2).alias("confidence"), word.alias("words"))
    out = merge_overlapping(rows)
    assert out.count() == 10_000 and out.where("source_order % 2 = 0").count() == 0  # of each pair the more confident stays


def test_composed_forms_and_references(spark):
    import html
    import unicodedata

    from lumenspool.functions import text as X

    texts = ["e\u0301 a\u0308", "plain", None, "&eacute;&#233;&#xe9; &amp;lt; &copy &hearts; & &unknown;", "<c.x>Tom &amp; Ann</c>", "ﬁ\u0323\u0307"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.recognized_text(F.col("t")).alias("n"), X.without_cue_tags(F.col("t")).alias("p")).collect():
        if r.t is None:
            assert r.n is None and r.p is None
        else:
            assert r.n == " ".join(unicodedata.normalize("NFC", r.t).split(" "))
            assert r.p == html.unescape(r.t.replace("<c.x>", "").replace("</c>", ""))


def test_ranks_by_levels_of_parts(spark):
    from lumenspool.operators import intervals

    rows = [(i, (i * 7919) % 101, i % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, a int, b int")
    coarse = [("x", F.floor(F.col("a") / 20), True), ("y", F.col("a"), True), ("z", F.col("b"), False)]
    got = {r.i: r["rank"] for r in intervals.ranked(df, coarse, ["i"]).collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-(r[1] // 20), -r[1], r[2], r[0])))}


def test_quantiles_by_brute_force(spark):
    import math
    import random
    import statistics

    from lumenspool.operators.quantiles import quantiles

    rng = random.Random(6)
    values = [0.0, -0.0, 1e-15, -1e-15, 3.5, 3.5, 1e12, -1e12, None, float("nan"), math.pi]
    rows = [(rng.choice(["a", "b", None]), rng.choice([*values, rng.gauss(0, 1), rng.random() * 1e6])) for _ in range(700)] + [("x", None), ("y", 2.0), ("z", float("nan"))]
    found = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", {"m": "median", "p95": 0.95, "p0": 0.0, "p1": 1.0}).collect()}
    assert set(found) == {k for k, _ in rows}
    for k, r in found.items():
        own = sorted(v for j, v in rows if j == k and v is not None and not math.isnan(v))
        if own:
            disc = lambda p: own[max(0, math.ceil(len(own) * p) - 1)]
            assert (r.m, r.p95, r.p0, r.p1) == (pytest.approx(statistics.median(own)), disc(0.95), own[0], own[-1])
        else:
            assert (r.m, r.p95) == (None, None)
    assert quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"m": "median"}).collect() == []


def test_scripts_are_written_as_sorted_lines(spark, tmp_path):
    from lumenspool.sinks import documents

    rows = [(m, part, chapter, place, f"{m}-{part}-{chapter}-{place}") for m in ("a", "b") for part, chapter in ((0, ""), (1, "C001"), (1, "C002"), (2, "")) for place in range(30)]
    lines = spark.createDataFrame(rows, "media_id string, part int, chapter string, place long, line string").repartition(6)
    documents.write_script_lines(lines, str(tmp_path / "s"))
    whole = {r.media_id: r.text for r in documents.scripts(lines).collect()}
    for m in ("a", "b"):
        files = sorted((tmp_path / "s" / f"media_id={m}").glob("part-*"))
        assert len(files) == 1 and files[0].read_text().rstrip("\n") == whole[m].rstrip("\n")


def test_order_of_tokens_by_digests(spark):
    from lumenspool.operators.audits import token_order

    rows = [("a", 0, ["x", "y"]), ("a", 1, []), ("a", 2, ["z"]), ("b", 0, ["x"]), ("b", 1, ["y", "z"]), ("c", 0, ["z", "y", "x"]), ("d", 0, ["x", "x", "y"]), ("e", 0, []), ("f", 0, ["x", "y"])]
    df = spark.createDataFrame(rows, "k string, o int, t array<string>")
    r = {x.k: x for x in token_order(df, ["k"], "o", F.col("t")).collect()}
    assert (r["a"].n, r["e"].n) == (3, 0) and r["a"].places == r["b"].places and r["a"].bag == r["b"].bag == r["c"].bag
    assert len({r[k].places for k in "acdef"}) == 5 and len({r[k].bag for k in "adef"}) == 4
