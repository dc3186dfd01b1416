"""Exact deduplication, prefix tries and vector codes against brute force on small tables with nulls, ties, repeats and extra columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspool.llm import exact_dedup, prefix_trie, vector_codes

SF = "/root/testdata/sf0.001"


# Exact deduplication

DOCS = "doc_id long, text string, extra int"


def _docs(spark):
    rng = random.Random(5)
    words = ["ä b", " äb", "ä\tb\n", None, "", " \r\v\f", " ", "c", "C", "x" * 50_000, " " * 10 + "x" * 50_000]
    rows = [(i if rng.random() < 0.9 else None, rng.choice(words), i) for i in range(300)]
    return spark.createDataFrame(rows + rows[:40] + [(7, "c", 1)] * 3, DOCS).repartition(5)


def _kept(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups["".join(c for c in text or "" if c not in " \t\n\v\f\r")].append((-len(text or ""), doc_id is None, doc_id or 0))
    return groups


def test_exact_dedup_by_brute_force(spark):
    docs = _docs(spark).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = _kept(rows)
    found = exact_dedup.report(docs).collect()
    assert len(found) == len(rows)
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = defaultdict(int)
    for r in found:
        group = by_digest[r.text_sha256]
        best = min(group)
        assert r.group_size == len(group)
        assert r.keep_id == (None if best[1] else best[2])
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and set(kept) == set(by_digest)


def test_remove_copies_keeps_columns_and_one_row_of_a_group(spark, tmp_path):
    _docs(spark).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = exact_dedup.remove_copies(docs)
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(min(v) for v in _kept(rows).values()) == sorted(v[0] for v in _kept(left).values())
    assert all(len(v) == 1 for v in _kept(left).values())


def test_heavy_digests_are_named_and_light_ones_shuffled(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 10)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("w"), F.col("id") % 900)).otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.digests(docs)
    heavy = exact_dedup.heavy_winners(rows).collect()
    assert [h._x_size for h in heavy] == [1000] and heavy[0]._x_best.doc_id == 0
    sizes = {r.group_size for r in exact_dedup.report(docs).where("kept").collect()}
    assert 1000 in sizes and 1 in sizes
    plan = exact_dedup.classified(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan


def test_exact_dedup_of_nothing_and_of_reserved_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.report(empty).collect() == [] and exact_dedup.remove_copies(empty).collect() == []
    with pytest.raises(ValueError):
        exact_dedup.remove_copies(empty.withColumn("_x_rank", F.lit(1)))


# Prefix tries

TURNS = "conv_id long, turn long, role string, text string, family int, words int"


def _rebuilt(rows):
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            given[c].append(((turn is not None, turn or 0, digest), role, text))
    given = {c: [(r, t) for _, r, t in sorted(v)] for c, v in given.items()}
    out = {}
    for c, own in given.items():
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = given.get(base, [])[:h] + own[h:]
    return out


def _trie(rows):
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in _rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def under(node):
        yield node
        for k in kids[node]:
            yield from under(k)

    count = lambda text: len([w for w in "".join(" " if x in "\t\n\v\f\r" else x for x in text).split(" ") if w])
    out = []
    for node, own in members.items():
        below = list(under(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids[node]), sum(not kids[n] for n in below),
                    sum((len(members[n]) - 1) * count(n[-1][1]) for n in below if n), hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=str)


def _found(df):
    return sorted([(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_prefix_trie_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 90), 60):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([turn, turn, None, 2]), rng.choice(["u", "a", None]), rng.choice(["x y", "x\ty", "z", "", None, "z  z\n"]), 1, 2))
    rows += rows[:20] + [(None, 1, "u", "lost", 0, 0)] * 3 + [(100, 0, "u", "w " * 20_000, 0, 0), (101, 0, "u", "w " * 20_000, 0, 0)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    assert _found(prefix_trie.report(df)) == _trie([r[:4] for r in rows])


def test_prefix_trie_of_long_and_of_equal_conversations(spark):
    rows = [(1, t, "u", str(t // 2), 0, 0) for t in range(300)] + [(c, t, "u", "same text", 0, 0) for c in range(20, 400) for t in range(3)]
    assert _found(prefix_trie.report(spark.createDataFrame(rows, TURNS).repartition(3))) == _trie([r[:4] for r in rows])


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.report(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.report(spark.createDataFrame([(None, 1, "u", "x", 0, 0)], TURNS)).collect() == []


# Vector codes

VECTORS = "vec_id long, embedding array<float>, label int, part string"


def _codes(rows):
    fine = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and len(r[1]) == 32]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = np.floor(np.array([r[1] for r in fine], np.float32).astype(np.float64) * 256).astype(int)
    parts = ints.reshape(len(fine), 16, 2)
    books = [[list(v) for v in parts[:64, p].tolist()] for p in range(16)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for turn in range(3):
        got = [[near(v[p].tolist(), books[p]) for p in range(16)] for v in parts]
        if turn < 2:
            for p in range(16):
                for k in range(len(books[p])):
                    mine = [parts[i, p] for i in range(len(fine)) if got[i][p][1] == k]
                    if mine:
                        books[p][k] = [int(s) // len(mine) for s in np.sum(mine, axis=0)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in g) for g in got]
    by_label = defaultdict(int)
    for r, e in zip(fine, errors, strict=True):
        by_label[r[2]] += e
    return sorted([(r[0], "".join(f"{k:02x}" for _, k in g), e, by_label[r[2]], digest) for r, g, e in zip(fine, got, errors, strict=True)], key=str)


def test_vector_codes_by_brute_force(spark):
    rng = np.random.default_rng(3)
    vector = lambda: [float(x) for x in rng.choice([-1.5, -0.001, 0.0, 0.25, 3.0], 32) + (rng.normal(size=32) if rng.random() < 0.7 else 0)]
    rows = [(int(rng.integers(0, 150)) if i % 30 else None, [float(np.float32(x)) for x in vector()], int(i % 3) if i % 5 else None, "x") for i in range(200)]
    rows += rows[:25]
    broken = [(1, None, 1, ""), (2, [None] * 32, 1, ""), (3, [float("nan")] + [0.0] * 31, 1, ""), (4, [float("inf")] + [0.0] * 31, 1, ""), (5000, [], 1, ""), (5001, [1.0] * 16, 1, "")]
    found = vector_codes.report(spark.createDataFrame(rows + broken, VECTORS).repartition(4)).collect()
    assert sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found], key=str) == _codes(rows + broken)


def test_vector_codes_of_few_and_of_no_vectors(spark):
    few = [(k, [float(k)] * 32, None, "") for k in range(3)]
    found = vector_codes.report(spark.createDataFrame(few, VECTORS)).collect()
    assert sorted(r.code for r in found) == ["00" * 16, "01" * 16, "02" * 16] and {r.error for r in found} == {0}
    for rows in ([], [(1, None, 1, "")]):
        assert vector_codes.report(spark.createDataFrame(rows, VECTORS)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.report(spark.createDataFrame([(1, [1.0] * 30, 1, "")], VECTORS))


def test_codes_decode_to_their_entries(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = vector_codes.train(vectors)
    coded = vector_codes.encode(vectors, books).join(vectors.select("vec_id", "embedding"), "vec_id")
    for r in vector_codes.decode(coded, books).collect():
        far = np.floor(np.array(r.embedding, np.float64) * 256) - np.array(r.vector) * 256
        assert int((far**2).sum()) == r.error


def test_bounds_never_exclude_the_nearest():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 4, 6, 8, 12):
        for high in (3, 300, vector_codes.LARGEST):
            rows, entries = rng.integers(-high, high + 1, (500, width)), rng.integers(-high, high + 1, (64, width))
            entries[7] = entries[3]
            index, best, _ = vector_codes.nearest(rows, entries, vector_codes.Bounds(entries))
            far = ((rows[:, None] - entries[None]) ** 2).sum(2)
            assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


