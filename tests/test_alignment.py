"""Alignment against difflib, JSON trees against json, frames against plain loops, range joins by pairs that are compared."""

import json
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspool.functions import alignment, identity, safety
from lumenspool.operators import frames, intervals, trees


def _pairs(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        k = rng.choice([1, 2, 5, 40])
        a = [rng.randrange(k) for _ in range(rng.randrange(30))]
        yield a, ([x for x in a if rng.random() < 0.8] + a[:3] if rng.random() < 0.5 else [rng.randrange(k) for _ in range(rng.randrange(30))])


@pytest.mark.parametrize("most", [8, 1 << 20])  # few points: lists are parted by row sweeps first
def test_blocks_equal_difflib(most):
    pairs = list(_pairs(1, 600))
    a, b = (np.array([x for p in pairs for x in p[k]], np.int64) for k in (0, 1))
    first = [np.cumsum([0] + [len(p[k]) for p in pairs]) for k in (0, 1)]
    found = alignment.matching_blocks(a, first[0], b, first[1], most)
    ops = [[] for _ in pairs]
    for row, tag, *ends in zip(*[x.tolist() for x in alignment.opcodes(len(pairs), np.diff(first[0]), np.diff(first[1]), *found)], strict=True):
        ops[row].append((alignment.TAGS[tag], *ends))
    for (x, y), got in zip(pairs, ops, strict=True):
        assert got == SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes()


def test_audit_of_rows(spark):
    rows = [(i, [str(x) for x in a], [str(x) for x in b]) for i, (a, b) in enumerate(_pairs(2, 100))]
    rows += [(1000, None, ["x"]), (1001, None, None), (1002, [], []), (1003, ["x", None], [None, "x"]), (0, ["a"], ["b"])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>").repartition(3)
    found = alignment.audit_ordered(df, "a", "b", ["id"]).collect()
    assert len(found) == len(rows)
    want = {}
    for i, a, b in rows[:-1]:
        a, b = a or [], b or []
        m = SequenceMatcher(a=a, b=b, autojunk=False)
        ops = m.get_opcodes()
        want[i] = (a == b, a != b and Counter(a) == Counter(b), m.ratio(), ops, [t for tag, x, y, _, _ in ops if tag in ("delete", "replace") for t in a[x:y]], [t for tag, _, _, x, y in ops if tag in ("insert", "replace") for t in b[x:y]],
                   [p for tag, i1, i2, j1, j2 in ops if tag == "replace" for p in zip(a[i1:i2], b[j1:j2])])
    for r in found:
        if r.id in want and not (r.id == 0 and r.missing == ["a"]):
            got = (r.faithful, r.reordered, r.ratio, [tuple(o) for o in r.opcodes], r.missing, r.added, [tuple(s) for s in r.substitutions])
            assert got[2] == pytest.approx(want[r.id][2]) and got[:2] + got[3:] == want[r.id][:2] + want[r.id][3:]
    assert alignment.audit_ordered(df.limit(0), "a", "b", ["id"]).collect() == []


def test_long_lists_of_one_pair():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 30_000, 60_000)
    b = np.delete(a, np.arange(0, len(a), 9))
    row, i, j, n = alignment.matching_blocks(a, np.array([0, len(a)]), b, np.array([0, len(b)]))
    assert all((a[x : x + k] == b[y : y + k]).all() for x, y, k in zip(i, j, n, strict=True)) and n.sum() >= 0.98 * len(b)


# JSON trees


def _masked(value, name=None):
    if isinstance(value, dict):
        return {k: "<id>" if k.lower() in trees.RUN_IDS else ["<id>" for _ in v] if k.lower().endswith("_ids") and isinstance(v, list) else _masked(v) for k, v in value.items()}
    return [_masked(v) for v in value] if isinstance(value, list) else value


def _tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([None, True, 0, -7, 12345678901, "", "x\ty", 'q"\\', "ä", "https://h.org/a?x=1", "\x01"])
    if kind < 0.6:
        return [_tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["b", "a", "frame_id", "segment_ids", "api_key", "ä", "Z"]): _tree(rng, depth - 1) for _ in range(rng.randrange(5))}


def test_trees_of_any_depth(spark):
    rng = random.Random(3)
    values = [_tree(rng, 7) for _ in range(60)] + [{}, [], 3, {"a": {"b": {"c": {"d": {"e": {"f": [[[[[1]]]]]}}}}}}]
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(-1, None), (-2, "{broken")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("tree", F.try_parse_json("text"))
    text = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    found = {r.id: r.text for r in trees.folded(df, ["id"], "tree").collect()}
    assert {i: json.loads(t) for i, t in found.items()} == dict(enumerate(values))
    assert all(found[i] == text(v) for i, v in enumerate(values))
    masked = {r.id: r.text for r in trees.folded(df, ["id"], "tree", trees.mask_ids).collect()}
    assert masked == {i: text(_masked(v)) for i, v in enumerate(values)}
    assert trees.folded(df.limit(0), ["id"], "tree").collect() == []


def test_secrets_at_any_depth(spark):
    value = {"x": [{"Access-Token": {"deep": 1}, "ok": ["https://h.org/a?Signature=1#f", "http://h.org/?page=2", "see https://h.org/?sig=1"]}], "passwords": 5, "monkey": "k", "path": "/usr/lib/x", "n": [1] * 150}
    df = spark.createDataFrame([(1, json.dumps(value))], "id int, text string").withColumn("tree", F.parse_json("text"))
    hidden = json.loads(trees.redacted(df, ["id"], "tree").first().text)
    assert hidden == {"x": [{"Access-Token": safety.HIDDEN, "ok": [f"https://h.org/a?{safety.HIDDEN}#f", "http://h.org/?page=2", "see https://h.org/?sig=1"]}], "passwords": safety.HIDDEN, "monkey": "k", "path": "/usr/lib/x", "n": [1] * 150}
    shown = json.loads(trees.diagnostics(df, ["id"], "tree").first().text)
    assert shown["path"] == safety.HIDDEN and shown["n"] == [1] * 100 and shown["passwords"] == 5


def test_json_texts_read_back(spark):
    texts = ["", "a\"b\\c", "".join(map(chr, range(32))), "ä中 ", None]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", identity.json_text(F.col("t")).alias("j")).collect():
        assert r.j is None if r.t is None else json.loads(r.j) == r.t


# Frames


def _plain(now, before, h, w):
    d = [[abs(now[y][x] - before[y][x]) for x in range(w)] for y in range(h)]
    edge = lambda g: [[g[y][x] if x in (0, w - 1) or y in (0, h - 1) else max(0, min(255, 9 * g[y][x] - sum(g[y + b][x + a] for a in (-1, 0, 1) for b in (-1, 0, 1)))) for x in range(w)] for y in range(h)]
    e, f = edge(now), edge(before)
    regions = []
    for r in range(8):
        for c in range(8):
            top, bottom, left, right = r * h // 8, (r + 1) * h // 8, c * w // 8, (c + 1) * w // 8
            tile = [d[y][x] for y in range(top, bottom) for x in range(left, right)]
            if tile and sum(tile):
                regions.append((left, top, right - left, bottom - top, sum(v >= 12 for v in tile) / len(tile), sum(tile) / len(tile) / 255))
    regions.sort(key=lambda t: (-t[4], -t[5]))
    flat = [v for row in d for v in row]
    return sum(v >= 12 for v in flat) / len(flat), sum(flat) / len(flat) / 255, sum(abs(e[y][x] - f[y][x]) for y in range(h) for x in range(w)) / len(flat) / 255, regions


def test_frames_by_plain_loops(spark):
    rng = random.Random(1)
    rows, grids = [], {}
    for media, w, h, n in ((1, 20, 12, 4), (2, 5, 3, 3), (3, 1, 1, 2)):
        for s in range(n):
            grids[media, s] = [[rng.choice([0, 5, 100, 110, 255]) for _ in range(w)] for _ in range(h)]
            rows.append((media, s, w, h, [v for row in grids[media, s] for v in row]))
    rows += [(1, 4, 10, 10, [7] * 100), (1, 6, 10, 10, [7] * 100), (4, 0, 2, 2, [1, 2, 3]), (4, 1, 1, 1, [None]), (4, 2, 1, 1, None), (5, 0, 1, 1, [300])]
    df = spark.createDataFrame(rows, "media_id int, seq int, width int, height int, pixels array<int>").repartition(3)
    found = {(r.media_id, r.seq): r for r in frames.compare_adjacent(df).collect()}
    assert set(found) == {(m, s) for m, s in grids if s} | {(1, 4)}
    for (m, s), r in found.items():
        if (m, s) == (1, 4):
            assert (r.hamming, r.changed_ratio, [tuple(x) for x in r.regions]) == (64, 1.0, [(0, 0, 10, 10, 1.0, 1.0)])
            continue
        g = grids[m, s]
        changed, mean, edge, regions = _plain(g, grids[m, s - 1], len(g), len(g[0]))
        assert (r.changed_ratio, r.mean_difference, r.edge_difference) == pytest.approx((changed, mean, edge))
        assert [tuple(x) for x in r.regions] == [pytest.approx(x) for x in regions]
    assert frames.analyse(df).count() == len(grids) + 2
    assert frames.analyse(df.limit(0)).collect() == []
    flat = spark.createDataFrame([(1, 0, 9, 8, [9 - x for _ in range(8) for x in range(9)]), (1, 1, 9, 8, [x for _ in range(8) for x in range(9)])], "media_id int, seq int, width int, height int, pixels array<int>")
    assert [r.dhash for r in frames.assess(flat).orderBy("seq").collect()] == ["f" * 16, "0" * 16]


# Range joins


def _intervals(spark, n, long_share, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([rng.randrange(0, 4_000_000), 9_999, 10_000, 2_560_000, -5])
        rows.append((rng.randrange(3), i, start, start + (rng.randrange(200_000, 3_000_000) if rng.random() < long_share else rng.choice([0, 1, 500, 9_000, 150_000]))))
    return rows + [(1, -1, None, 5), (1, -2, 5, None), (None, -3, 0, 10)]


@pytest.mark.parametrize("shares", [(0.0, 0.0), (0.3, 0.0), (0.0, 0.3), (0.4, 0.4)])
def test_range_join_of_mixed_lengths(spark, shares):
    a, b = (_intervals(spark, 150, s, k) for k, s in enumerate(shares))
    left = spark.createDataFrame(a, "k int, i int, start_ms long, end_ms long")
    right = spark.createDataFrame(b, "k int, r_i int, r_start long, r_end long")
    found = Counter((r.i, r.r_i) for r in intervals.range_join(left, right, "k").collect())
    meets = lambda x, y: None not in (*x, *y) and x[0] == y[0] and x[2] < y[3] and y[2] < x[3]
    want = Counter((x[1], y[1]) for x in a for y in b if meets(x, y))
    assert found == want
    for kind in ("left_semi", "left_anti"):
        got = {r.i for r in intervals.range_join(left, right, "k", kind=kind).collect()}
        assert got == {x[1] for x in a if any(meets(x, y) for y in b) == (kind == "left_semi")}


def test_short_intervals_are_not_compared_in_coarse_buckets(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 500).alias("end_ms"))
    right = rows.select("k", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    left, other = intervals.candidates(rows, right, "k")
    compared = left.join(other, (left["k"] == other["_key"]) & (left["_l_meeting"] == other["_r_meeting"]) & (left["_l_bucket"] == other["_r_bucket"]))
    per = compared.groupBy("_l_meeting").count().collect()
    assert [r._l_meeting for r in per] == [intervals.SHORTS] and per[0]["count"] < 20_000 * 120
