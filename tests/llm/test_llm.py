"""The llm operators on small fixtures: brute force, round trips, edge rows."""

import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspool.llm import bpe, common, edit_embedding, language_id, ngram_join, ngram_lm, packing, pretokens, quality_rules, queries, sharding, toxicity, warc
from lumenspool.llm import words as W

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 911}x{i % 37}" for i in range(30_000))
EDGE = [None, "", " \n\t ", "one", "a b c d", "same words here five now six", "same words here five now six", "it's  we'll\n\n x'", "é中文 ٣ !?", "<|endoftext|>", LONG, "for " * 700]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, None if i % 2 else "en", "s", None) for i, t in enumerate(EDGE)] + [(3, "one", "en", "s", 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


def test_bpe_equals_tiktoken_and_round_trips(edge, none):
    import tiktoken
    from public_tokenizers import PATTERN

    path = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    own, _ = bpe.worker(path)
    whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    got = bpe.round_trip_digests(edge, path).collect()
    assert len(got) == len(EDGE) + 1 and bpe.round_trip_digests(none, path).count() == 0
    for r in got:
        text = EDGE[r.doc_id] or ""
        ids = whole.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    rows = bpe.decode_column(bpe.encode_column(edge, path), path).collect()
    assert all(bytes(r.bytes) == (EDGE[r.doc_id] or "").encode() for r in rows)


def test_bpe_long_words():
    import tiktoken
    from public_tokenizers import PATTERN

    own, _ = bpe.worker(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    words = [(a * 400)[:n].encode() for a in ("a", "ab", "=", "étranger", "thecat", "-=") for n in (64, 65, 200, 390)]
    assert own.encode(words) == [whole._core_bpe.encode_single_piece(w) for w in words]


def test_pieces_equal_pattern():
    import random

    import pyarrow as pa
    import regex
    from public_tokenizers import PATTERN

    pattern, rng = regex.compile(PATTERN), random.Random(3)
    letters = " \t\n'stremvldx12é!-  中٣" + "'' "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    offsets, data = common.utf8_parts(pa.array(texts))
    a, b, first = pretokens.pieces(offsets, data)
    for i, t in enumerate(texts):
        assert [data[x:y].tobytes().decode() for x, y in zip(a[first[i] : first[i + 1]], b[first[i] : first[i + 1]])] == pattern.findall(t)


def test_edit_embedding(edge, none):
    got = edit_embedding.edited_report(edge).collect()
    rows = sorted([(i, t or "") for i, t in enumerate(EDGE)] + [(3, "one")], key=lambda x: (-x[0], x[1]))
    assert len(got) == len(rows) and edit_embedding.edited_report(none).count() == 0
    want = Counter()
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - third] + n[:third]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(EDGE[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_edit_embedding_follows_edits(spark, docs):
    a = np.frombuffer(LONG[:6000].encode("utf-32-le"), np.uint32)
    b = np.concatenate([a[:3000], a[3001:]])
    c = np.frombuffer(LONG[6000:12000][::-1].encode("utf-32-le"), np.uint32)
    x, y, z = edit_embedding.fingerprints([a, b, c])
    assert edit_embedding.likeness(x, x) == 1 and edit_embedding.likeness(x, y) > 0.8 > 0.3 > edit_embedding.likeness(x, z)
    pairs = edit_embedding.near_pairs(docs).collect()
    assert pairs and all(p.likeness >= 0.75 and p.doc_id != p.near_id for p in pairs)


@pytest.mark.parametrize("ids", [[None], [None, None, None], [7, None], [1, 2, 3, 4, 5, 6, None, None], [5, 5, 5, None]])
def test_edit_embedding_null_ids(spark, ids):
    rows = [(i, f"text number {k} of the table") for k, i in enumerate(ids)]
    got = edit_embedding.edited_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    rows = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        third = len(t) // 3
        want[i, hashlib.sha256((t[: len(t) - third] + rows[(k + 1) % len(rows)][1][:third]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(25):
        text = rng.choice(list("etaoin shrdlu"), int(rng.integers(60, 4000)))
        for k in range(12):
            x = text.copy()
            at = rng.integers(0, len(x), int(len(x) * k * 0.004))
            x[at] = rng.choice(list("xyz"), len(at))
            rows.append((len(rows), "".join(x[: len(x) - k * len(x) // 60])))
    prints = edit_embedding.fingerprints([np.frombuffer(t.encode("utf-32-le"), np.uint32) for _, t in rows])
    first = {}
    for i, f in enumerate(prints):
        first.setdefault(f, i)
    ids = list(first.values())
    want = {(i, j) for a, i in enumerate(ids) for j in ids[a + 1 :] if edit_embedding.likeness(prints[i], prints[j]) >= 0.75}
    got = [tuple(sorted((p.doc_id, p.near_id))) for p in edit_embedding.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want) > 200


def repeats(words):
    seen, at = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            at |= {i, i + 1, i + 2}
    return len(at)


def test_quality_measures(spark, edge, none, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for table, text in ((edge, lambda i: EDGE[i] or ""), (docs, texts.__getitem__)):
        for r in quality_rules.quality_report(table).collect():
            words = WORDS.findall(text(r.doc_id))
            lines = [x for x in text(r.doc_id).split("\n") if WORDS.search(x)]
            want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text(r.doc_id))), len(lines) - len(set(lines)), repeats(words))
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (len(words) < 50 or 2 * want[4] > len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_report(none).count() == 0
    with pytest.raises(ValueError):
        quality_rules.measure(edge.withColumn("_q_kept", edge.lang))


def test_quality_separates_labels(spark, docs):
    labels = common.table(spark, SF, "labels")
    rows = quality_rules.quality_report(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert rows and all(r.kept == (r.quality == 1) for r in rows)
    clean = quality_rules.clean_lines(spark.createDataFrame([(1, "A good line of text ends here.\nHome | News | About | Help | More\nOk\nAccept all cookies")], "doc_id long, text string")).first()
    assert clean.clean_text == "A good line of text ends here."


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORDS.findall(lowered(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("hot", [32, 4])
def test_ngram_join_equals_brute_force(spark, edge, none, docs, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "PAGE", 8)
    rng = np.random.default_rng(5)
    base = LONG.split()[:120]
    near = [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in rng.integers(0, 120, 15)] + [" ".join(np.where(rng.random(120) < 0.05, "q", base)) for _ in range(10)]
    rows = [(r.doc_id, r.text) for r in docs.limit(10).collect()] + [(5000 + i, t) for i, t in enumerate(near + EDGE)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets, root = brute_components([t for _, t in rows])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    want = {i: (len(s), least[r]) for (i, _), s, r in zip(rows, sets, root)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(table).collect()} == want
    kept = ngram_join.keep_one(table.withColumn("n", table.doc_id))
    assert kept.columns == ["doc_id", "text", "n"] and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    if hot == 32:
        assert ngram_join.groups(none).count() == 0


def test_ngram_join_late_and_hot_keys(spark, monkeypatch):
    # One key of thousands of classes, in tasks that salt it, and unlike roots under it.
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "PAGE", 64)
    monkeypatch.setattr(ngram_join, "CHAIN", 32)
    common_part = [f"c{i}" for i in range(90)]
    texts = [" ".join(common_part + [f"u{k}x{i}" for i in range(6 + k % 30)]) for k in range(1200)]
    texts += [" ".join(common_part[:60] + [f"v{k % 40}y{i}" for i in range(12)] + [f"z{k}"]) for k in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    sets, root = brute_components(texts)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(i, least.get(r, i))
    assert {r.doc_id: r.component_id for r in ngram_join.groups(table).collect()} == {i: least[r] for i, r in enumerate(root)}


def test_texts_stay_where_they_are(spark, monkeypatch):
    # Sets are made of the wanted rows without a shuffle of all texts; equal texts, equal doc_ids and null ones count.
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(i, " ".join(f"t{i}x{k}" for k in range(300))) for i in range(200)]
    rows += [(300, same), (301, same), (302, same + " end"), (None, "begin " + same), (300, rows[7][1] + " end")]
    plans, write = {}, common.materialize

    def record(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, tag)

    monkeypatch.setattr(common, "materialize", record)
    found = {r.doc_id: r.component_id for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id not in (None, 300)}
    assert found == {i: i for i in range(200)} | {301: 300, 302: 300}
    assert "hashpartitioning(doc_id" not in plans["sets"]


def test_marks_let_wanted_rows_through(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MARK_FILE", 1 << 10)
    table = spark.range(5000).selectExpr("if(id % 1000 = 999, null, id) as doc_id", "concat('text number ', id) as text").repartition(3)
    ids = common.materialize(table.where("doc_id % 20 = 0").select("doc_id"), "ids")
    marks, files = ngram_join._marks(ids)
    found = {r.h for r in ngram_join._class_sets(table, marks, files).collect()}
    every = {r.doc_id: r.h for r in ngram_join.describe(table, np.zeros(0, np.uint64)).collect() if r.doc_id is not None}
    assert files > 1 and found >= {h for i, h in every.items() if i % 20 == 0} and 255 <= len(found) < 600
    common.remove(spark, marks)
    assert not common.exists(marks)


def test_late_rows_stream(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 2)
    rows = [(7, h, 10, 0) for h in range(1, 12)] + [(7, h, 10, 3) for h in range(20, 25)] + [(9, h, 10, 0) for h in range(1, 4)]
    found = ngram_join._cold_pairs(spark.createDataFrame(rows, "key long, h long, n long, salt long").coalesce(1).sortWithinPartitions("key", "n", "h"), 75).collect()
    assert {r.a for r in found if r.far == 2 and r.b == 7} == {*range(1, 12), *range(20, 25)}
    assert {(r.a, r.b) for r in found if r.far < 2} == {(1, 2), (2, 3), (1, 3)}


def test_keep_one_by_row_and_not_by_doc_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (3, a), (None, b), (None, c), (None, c), (4, ""), (4, None), (5, "  "), (9, b + " tail")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "_class": F.lit("x"), "root": F.lit(None).cast("int")})
    got = ngram_join.keep_one(table)
    assert got.columns == table.columns
    assert sorted((str(r.doc_id), (r.text or "").strip()) for r in got.collect()) == sorted([("1", a), ("1", b), ("None", c), ("4", ""), ("5", "")])
    assert {(r.doc_id, r.component_id) for r in ngram_join.groups(table).collect()} == {(1, 1), (3, 1), (None, 1), (None, None), (4, 4), (5, 5), (9, 1)}
    assert ngram_join.keep_one(table.limit(0)).count() == 0


def test_spanning_forest_keeps_components(spark):
    from lumenspool.llm.components import spanning_forest

    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (4000, 2))] + [(1000, 1001), (1001, 1000)]
    links = common.materialize(spark.createDataFrame(pairs, "a long, b long"), "links")
    rows = spanning_forest(links).collect()
    assert len(rows) == len({x for p in pairs for x in p}) - 2 and {(r.a, r.b) for r in rows} <= set(pairs)


def test_count_tree_bound_never_loses(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, 90).astype(np.uint64)) for _ in range(40)]
    sets += [np.sort(np.concatenate([s[:80], rng.integers(0, 1 << 62, 8).astype(np.uint64)])) for s in sets]
    vectors, sizes = np.stack([ngram_join.folded(ngram_join.counts(s).tobytes()) for s in sets]), np.array([len(s) for s in sets])
    tree = ngram_join.CountTree(vectors, sizes)
    for i, s in enumerate(sets):
        found = set(tree.search(vectors[i], int(sizes[i])).tolist())
        for j, t in enumerate(sets):
            x = len(np.intersect1d(s, t))
            assert j in found or 100 * x < 75 * (len(s) + len(t) - x)


def test_toxicity(spark, edge, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    index = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, index).join(labels, "doc_id").collect()
    toxic = [r.score >= 0.3 for r in rows if r.toxic]
    clean = [r.score >= 0.3 for r in rows if not r.toxic]
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.05
    assert toxicity.score(none, index).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(edge, index).collect())
    kept = toxicity.remove_toxic(edge.withColumn("_row", edge.doc_id), index)
    assert kept.count() <= len(EDGE) + 1 and kept.columns[-1] == "_row"
    empty = toxicity.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.score(edge, empty).collect()} == {0.0}


def test_toxicity_has_no_least_number_of_labels(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    index = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, index).join(labels, "doc_id").collect()
    found = [r.score >= toxicity.THRESHOLD for r in rows if r.toxic]
    assert len(found) == 11 and sum(found) >= 6
    assert np.mean([r.score >= toxicity.THRESHOLD for r in rows if not r.toxic]) < 0.05
    # Both labels' features are in the index, and all texts with a letter run of it have neighbours.
    assert {x.label for r in rows for x in r.evidence} == {0, 1} and sum(len(r.evidence) > 0 for r in rows) > 0.9 * len(rows)


def test_toxicity_without_evidence_is_clean(spark):
    texts = ["a calm and friendly note", "you worthless idiot", "the friendly garden", "such an idiot", "worthless, worthless"] * 8 + ["", None, "zzz qqq", "a friendly garden"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 in (1, 3, 4))) for i in range(40)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, labels, F.lit(True))
    assert index.base_rate == 0.6
    score = {r.doc_id: r.score for r in toxicity.score(docs, index).collect()}
    assert all(score[i] < toxicity.THRESHOLD for i in (0, 2, 40, 41, 42, 43)) and min(score[1], score[3], score[4]) >= toxicity.THRESHOLD
    assert {40, 41, 42} <= {r.doc_id for r in toxicity.remove_toxic(docs, index, 0.1).collect()}


def test_toxicity_scores_texts_and_not_ids(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    index = toxicity.fit(docs, labels)
    odd = docs.withColumns({"doc_id": F.col("doc_id") + 12345, "score": F.lit("x"), "evidence": F.lit(1), "toxic": F.lit(0), "label": F.lit(0)})
    here = {r.doc_id: round(r.score, 9) for r in toxicity.score(docs, index).collect()}
    assert {r.doc_id - 12345: round(r.score, 9) for r in toxicity.score(odd, index).collect()} == here
    # Repeated doc_ids, null labels and null ids of labels, nulls in documents.
    rows = [(1, "you idiot"), (1, "calm words"), (2, "you idiot"), (None, "you idiot"), (3, None), (4, "calm garden")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (1, None), (2, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    small = toxicity.fit(table, marks, F.lit(True))
    assert sorted(zip(small.index().ids.tolist(), small.index().labels.tolist())) == [(1, 0), (2, 1), (3, 0)]
    assert len(toxicity.score(table, small).collect()) == 6


def test_toxicity_scores_equal_brute_force(spark):
    # Features, association, TF-IDF, cosine and votes anew, with dictionaries.
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    index = toxicity.fit(docs, labels)

    def grams(text):
        runs = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
        runs = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in runs]
        return Counter([("", x) for x in runs] + [(k, x[:k]) for x in runs for k in (4, 5, 6) if len(x) > k])

    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    label = {r.doc_id: int(r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    own = {i: grams(t) for i, t in rows.items()}
    df = Counter(f for g in own.values() for f in g)
    n1 = sum(label.values())
    n0 = len(label) - n1
    a, b = (Counter(f for i in label if label[i] == y for f in own[i]) for y in (1, 0))

    def llr(f):
        cells = ((a[f], n1, a[f] + b[f]), (b[f], n0, a[f] + b[f]), (n1 - a[f], n1, n1 + n0 - a[f] - b[f]), (n0 - b[f], n0, n1 + n0 - a[f] - b[f]))
        return 2 * max(0.0, sum(x * np.log(x * (n1 + n0) / n / of) for x, n, of in cells if x))

    weight = {f: (np.log((1 + len(rows)) / (1 + df[f])) + 1) * llr(f) for f in set(a) | set(b)}

    def vector(g):
        v = {f: (1 + np.log(k)) * weight[f] for f, k in g.items() if f in weight}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()} if norm else {}

    examples = {i: vector(own[i]) for i in label}
    got = {r.doc_id: r.score for r in toxicity.score(docs, index).collect()}
    for i in list(rows)[::7]:
        q = vector(own[i])
        near = sorted(((sum(x * q.get(f, 0.0) for f, x in e.items()), -j) for j, e in examples.items() if rows[j] != rows[i]), reverse=True)[: toxicity.NEIGHBOURS]
        votes = [0.0, 0.0]
        for c, j in near:
            votes[label[-j]] += c * c
        want = (toxicity.PRIOR_WEIGHT * min(n1 / (n0 + n1), toxicity.THRESHOLD / 2) + votes[1]) / (toxicity.PRIOR_WEIGHT + sum(votes))
        assert abs(got[i] - want) < 1e-6


def test_toxicity_search_is_exact():
    rng = np.random.default_rng(2)
    examples = [(i, i % 2, np.sort(rng.choice(50, 6, False)), rng.integers(1, 4, 6)) for i in range(400)]
    idf = rng.random(50) + 0.5
    rows = sorted(examples, key=lambda x: (x[1], x[0]))
    ids, labels = (np.array([x[k] for x in rows]) for k in (0, 1))
    first = np.arange(401) * 6
    made = toxicity.Index.arrays(np.arange(50, dtype=np.uint64), idf, ids, labels, first, np.concatenate([x[2] for x in rows]), np.concatenate([x[3] for x in rows]), (ids + 1).astype(np.uint64))
    index = toxicity.Index(made, 0.5, (1.0, 1.0))
    dense = np.zeros((400, 50))
    for i, _, at, tf in examples:
        v = (1 + np.log(tf)) * idf[at]
        dense[i, at] = v / np.sqrt((v * v).sum())
    for i in range(0, 400, 37):
        best = index.neighbours(examples[i][2], examples[i][3], i + 1)
        want = sorted(((-round(float(c), 9), j) for j, c in enumerate(dense @ dense[i]) if j != i and c > 0))[: toxicity.NEIGHBOURS]
        assert [round(c, 9) for c, _, _ in best] == [-c for c, _ in want]


def test_packing(edge, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rows = packing.pack(edge.where("doc_id <> 3"), path).toPandas()
    for i, g in rows.groupby("doc_id"):
        ids = np.array(whole.encode(EDGE[i] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in g.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= rows.length.sum() // 2048 + 2
    assert packing.pack(none, path).count() == 0
    assert all(sum(c) == n and len(c) <= 4 for n, c in enumerate(packing.cuts()))


def test_sharding(spark, edge, none):
    rows = sharding.assign(edge.select("doc_id", "text")).toPandas()
    assert len(rows) == len(EDGE) + 1
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for r in rows.itertuples():
        raw = (EDGE[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    big = sharding.assign(common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")).toPandas()
    sizes = big.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() < 0.01 * sizes.mean()
    assert big.groupby("text_crc32").shard.nunique().max() == 1
    assert sharding.assign(none.select("doc_id", "text")).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(edge.withColumn("slot", edge.doc_id))


def test_sharding_parts_only_groups_over_a_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", 2)  # so that small groups share the large ones' blocks
    texts = ["hot " * 10] * 400 + ["warm " * 8] * 60 + ["warmer " * 6] * 60 + [f"small {i // 3} text" for i in range(900)]
    rows = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert len(rows) == len(texts) and all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    parted = rows.groupby("text").shard.nunique()
    assert set(parted[parted > 1].index) == {"hot " * 10}


def test_resharding_moves_little_and_rewrites_only_what_changes(spark, tmp_path):
    rows = [(i, f"{'x' * (i % 50)} {i // 2}") for i in range(3000)] + [(None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = sharding.assign(docs).toPandas()
    old = out.groupby("old_shard")["size"].sum().reindex(range(6), fill_value=0)
    total = old.sum()
    least = total - sum(min(old[i], total // 8 + (i < total % 8)) for i in range(6))  # what any even layout has to move
    moved = out[out.old_shard != out["shard"]]["size"].sum()
    assert least - 8 * 64 <= moved <= least + 0.02 * total  # shards are even to about a row
    path = f"file://{tmp_path}/shards"
    other = spark.createDataFrame([(1, "stays")], "doc_id long, text string").withColumn("shard", F.lit(99))
    other.write.partitionBy("shard").parquet(path)
    moves = sharding.rewrite(docs, path).collect()
    assert sum(m.moved_bytes for m in moves) == moved
    back = spark.read.parquet(path)
    assert back.where("shard = 99").count() == 1
    written = back.where("shard <> 99").toPandas()
    touched = {k for m in moves for k in (m.old_shard, m.shard)}
    want = out[out["shard"].isin(touched)]
    assert sorted(map(str, zip(written.doc_id, written.text, written["shard"], written.slot))) == sorted(map(str, zip(want.doc_id, want.text, want["shard"], want.slot)))
    with pytest.raises(ValueError):
        sharding.rewrite(spark.read.parquet(path).select("doc_id", "text"), path)
    with pytest.raises(ValueError):
        sharding.assign(docs.withColumn("_s_text", docs.lang))


def test_min_cost_flow_is_least():
    supply, demand = [7, 1, 4], [3, 3, 3, 3]
    cost = [[int(i != j) for j in range(4)] for i in range(3)]
    flow = sharding.min_cost_flow(supply, demand, cost)
    assert [sum(f) for f in flow] == supply and [sum(f[j] for f in flow) for j in range(4)] == demand
    assert sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(4)) == 12 - (3 + 1 + 3)


def test_ngram_lm(spark, docs, none, edge):
    table = docs.unionByName(edge.withColumn("doc_id", edge.doc_id + 100_000)).withColumns({"score": F.lit("x"), "n_tokens": F.lit(None)})
    model = ngram_lm.fit(table)
    rows = [(r.doc_id, r.text, [*WORDS.findall(lowered(r.text or "")), "\0"]) for r in table.collect()]
    train = [w for i, _, w in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs, kinds = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(["\0", *w[:-1]], w)), Counter()
    for a, _ in pairs:
        kinds[a] += 1
    n, v = sum(c.values()), len(c)
    want, scores = Counter(), {}
    for i, text, w in rows:
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want[i, len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
        scores[i, len(w), round(base, 6)] = sum(np.log10((max(pairs[a, b] - 0.75, 0) / c[a] if a in c else 0) + (0.75 * kinds[a] / c[a] if a in c else 1) * (c[b] + 1) / (n + v + 1)) for a, b in zip(["\0", *w[:-1]], w))
    got = ngram_lm.score(table, model).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    for r in got:  # probabilities are quantised to 256 levels
        assert abs(r.score - scores[r.doc_id, r.n_tokens, round(r.base_score, 6)]) < 0.01 * r.n_tokens
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert ngram_lm.score(none, model).count() == 0
    assert {round(r.score, 9) for r in ngram_lm.score(edge.where("text is null"), ngram_lm.fit(none)).collect()} == {0.0}
    # The pointers give each context's successors.
    word = max(kinds, key=kinds.get)
    ids, _ = model.words(np.array([ngram_lm.END if word == "\0" else W.word_hashes(np.array([0, len(word.encode())]), np.frombuffer(word.encode(), np.uint8))[0][0]], np.uint64))
    assert len(model.successors(int(ids[0]))) == kinds[word]


def test_ngram_lm_keeps_bigrams_seen_once(spark, docs):
    train = docs.where("doc_id % 3 > 0")
    model = ngram_lm.fit(train, train=F.lit(True))
    c, pairs, kinds = Counter(), Counter(), Counter()
    for r in train.collect():
        w = [*WORDS.findall(lowered(r.text or "")), "\0"]
        c.update(w)
        pairs.update(zip(["\0", *w[:-1]], w))
    for a, _ in pairs:
        kinds[a] += 1
    n, v = sum(c.values()), len(c)
    assert sum(k == 1 for k in pairs.values()) > len(pairs) / 2
    rows = {r.doc_id: r for r in ngram_lm.score(docs, model).collect()}
    for r in docs.collect():
        w = [*WORDS.findall(lowered(r.text or "")), "\0"]
        want = sum(np.log10((max(pairs[a, b] - 0.75, 0) / c[a] if a in c else 0) + (0.75 * kinds[a] / c[a] if a in c else 1) * (c[b] + 1) / (n + v + 1)) for a, b in zip(["\0", *w[:-1]], w))
        # Probabilities are quantised to 256 levels.
        assert abs(rows[r.doc_id].score - want) < 0.01 * len(w)


def test_elias_fano():
    rng = np.random.default_rng(4)
    for top in (10, 1 << 20, 1 << 63):
        x = np.unique(rng.integers(0, top, 9000, dtype=np.uint64))
        ef = ngram_lm.EliasFano(*(ngram_lm.ef_pack(x)[k] for k in ("first", "start", "data", "n")))
        assert (np.concatenate([ef.block(b) for b in range(len(ef.first))]) == x).all()
        q = np.unique(np.concatenate([x[::7], x[::5] + np.uint64(1)]))
        at = ef.find(q)
        assert ((at >= 0) == np.isin(q, x)).all() and (x[at[at >= 0]] == q[at >= 0]).all()


def test_language_id(spark, none):
    pages = common.table(spark, SF, "pages")
    docs = common.table(spark, SF, "documents")
    rows = language_id.identify(pages, docs).collect()
    assert len(rows) == pages.count() and np.mean([r.lang == r.declared for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None, None), (2, "http://x.example.de/de/", ""), (2, "http://x.example.de/de/", "")], "page_id long, url string, html string")
    assert sorted(r.page_id for r in language_id.identify(odd, docs).collect()) == [1, 2, 2]
    assert {r.lang for r in language_id.identify(odd, none).collect()} == {None}
    assert language_id.identify(pages.limit(0), docs).count() == 0


def test_language_id_equals_brute_force(spark):
    pages, docs = common.table(spark, SF, "pages"), common.table(spark, SF, "documents")
    odd = spark.createDataFrame([(9001, None, None), (9002, "http://a.example.de/de/x", "<html lang='fr'>"), (9003, "http://a.example.de/", "<p>der die das und nicht</p>")], "page_id long, url string, html string")
    table = pages.unionByName(odd).withColumns({"lang": F.lit(1), "host": F.lit("h"), "prior": F.lit(0.5), "text": F.lit("t"), "own": F.lit(1)})
    langs, logs = language_id.train(docs)
    k = len(langs)
    rows = []
    for r in pages.unionByName(odd).select("page_id", "url", "html", language_id.visible("html").alias("text")).collect():
        bucket, _ = language_id.trigram_rows(np.array([0, len(r.text.encode())]), np.frombuffer(r.text.encode(), np.uint8))
        text = logs.astype(np.float32)[:, bucket].astype(np.float64).sum(1) * min(1.0, language_id.TEXT_WORTH / max(1, len(bucket)))
        text -= text.max()
        host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", r.url or "")
        host = host[1].lower() if host else ""
        said = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", r.html or "")
        domain = re.search(r"([^.]+\.[^.]+)$", host)
        top, path = re.search(r"\.([a-z]{2,})$", host), re.match(r"[a-zA-Z]+://[^/?#]+/([a-zA-Z]{2})(?:[/?#]|$)", r.url or "")
        suffix = f"{top[1] if top else ''}/{path[1].lower() if path else ''}"
        share = np.exp(text) / np.exp(text).sum()
        rows.append((r.page_id, text, {"declared": said[1].lower() if said else "", "suffix": suffix, "domain": domain[1] if domain else "", "host": host}, np.floor(1000 * share + 1e-12)))
    votes = {}
    for _, _, keys, own in rows:
        for c, x in keys.items():
            if x:
                votes[c, x] = votes.get((c, x), 0) + own
    total = sum(own for *_, own in rows)
    got = {r.page_id: r for r in language_id.identify(table, docs).collect()}
    assert len(got) == len(rows)
    for i, text, keys, own in rows:
        def share(v, parent, w):
            left = (v - own) / 1000
            return (left + w * parent) / (left.sum() + w)

        even = np.full(k, 1 / k)
        prior = share(total, even, float(k))
        for c in ("domain", "host"):
            prior = share(votes[c, keys[c]], prior, language_id.HOST_WEIGHT) if keys[c] else prior
        full = text + np.log(prior)
        for c in ("declared", "suffix"):
            if keys[c]:
                full = full + np.log(k * share(votes[c, keys[c]], even, language_id.EVEN_WEIGHT))
        p = np.exp(full - full.max())
        assert abs(got[i].confidence - 1 / p.sum()) < 2e-3 and (got[i].lang == langs[int(np.argmax(full))] or p[langs.index(got[i].lang)] > 0.99)


def test_warc_damage_is_an_error(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"page {i} " * 40) for i in range(30)]
    whole = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), whole)
    file = next(f for f in tmp_path.glob("w/part-*") if f.stat().st_size)
    good = file.read_bytes()
    starts = [i for i in range(len(good)) if good.startswith(warc.MAGIC, i)]
    middle = starts[12]
    for k, bad in enumerate([good[:-40], good[: middle + 200] + b"\xff" * 8 + good[middle + 208 :], good[: middle + 1] + b"\0" + good[middle + 2 :], b"\0\0\0" + good[3:], good[:middle] + b"junk" + good[middle:]]):
        at = tmp_path / f"bad{k}"
        at.mkdir()
        (at / "part-0").write_bytes(bad)
        for size in (1000, 8 << 20):
            with pytest.raises(Exception, match="at byte"):
                warc.read(spark, f"file://{at}", size).collect()
        left = {r.page_id for r in warc.read(spark, f"file://{at}", errors="skip").collect()}
        assert len(left) >= 28 and left < set(range(30)) or k == 4 and len(left) == 30
    same = spark.createDataFrame([(None, "u", "c" * 1000), (3, "u", "c" * 1000), (5, "u", "c" * 1000), (None, "u", "d" * 1000), (None, "u", "d" * 1000)], "page_id long, url string, html string").withColumns({"digest": F.lit(1), "payload": F.lit("p"), "refers_to": F.lit(2)})
    warc.write(same, f"file://{tmp_path}/null")
    got = [((r.page_id or 0), r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/null").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(0, "revisit", 5), (3, "revisit", 5), (5, "response", None), (0, "response", None), (0, "response", None)]))


def test_warc_round_trip(spark, tmp_path):
    big = "".join(chr(33 + i * 7919 % 90) for i in range(30_000)) * 600
    rows = [(1, "http://a/é b", "a" * 1000), (2, None, "a" * 1000), (3, "u", None), (4, "u", "b" * 999), (5, "u", "b" * 999), (7, "u", big), (8, "u", big), (None, "v", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    for size in (20_000, 8 << 20):
        got = warc.read(spark, path, size).collect()
        assert len(got) == len(rows)
        by = {r.page_id: r for r in got}
        for i, url, html in rows:
            raw = (html or "").encode()
            r = by[i]
            assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(raw), hashlib.sha1(raw).hexdigest())
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
        assert {i: r.refers_to for i, r in by.items() if r.record_type == "revisit"} == {1: 2, 7: 8}
    for f in tmp_path.glob("w/part-*"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1") or not f.stat().st_size
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    index = toxicity.fit(docs, labels)
    calm = {r.doc_id for r in toxicity.score(docs, index).collect() if r.score < toxicity.THRESHOLD}
    good = {r.doc_id for r in quality_rules.quality_report(docs).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in calm & good]
    _, root = brute_components([t for _, t in rows])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(least.values()) and len(corpus_pipeline.STAGES) == 4


def test_word_kernel():
    import pyarrow as pa

    offsets, data = common.utf8_parts(pa.array([t or "" for t in EDGE]))
    h, first = W.word_hashes(offsets, data)
    words = [w for t in EDGE for w in WORDS.findall(lowered(t or ""))]
    assert len(h) == len(words) == first[-1] and len(set(h.tolist())) == len(set(words))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_sharding_query_reads_what_was_rewritten(spark):
    rows = queries.op7_sharding(spark, SF).toPandas()
    want = sharding.assign(common.table(spark, SF, "documents").select("doc_id", "text")).toPandas()
    assert sorted(map(str, zip(rows.doc_id, rows["size"], rows["shard"], rows.slot, rows.text_crc32))) == sorted(map(str, zip(want.doc_id, want["size"], want["shard"], want.slot, want.text_crc32)))


def test_pipeline_edge_rows(spark, tmp_path):
    import corpus_pipeline

    good, other = (" ".join(f"{x}{i} walked{i} home{i} again." for i in range(40)) + " " for x in ("river", "tower"))
    rows = [(1, good), (2, good), (2, good), (None, good), (None, other), (3, None), (4, ""), (5, "short"), (6, other + "It stood there for years.")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "n": F.lit(1), "label": F.lit("x"), "score": F.lit(None).cast("double"), "_class": F.lit(0), "length": F.lit(1)})
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    whole = [len(g) for _, g in out.groupby("doc_id", dropna=False)]
    assert sorted(out.doc_id.dropna().unique()) == [1, 6] and sum(whole) == len(out) and out.doc_id.isna().sum() == 0
    none = f"{tmp_path}/none"
    table.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_tokens_do_not_care_for_clashing_columns(spark, edge):
    odd = edge.withColumns({"length": F.lit("x"), "task": F.lit(1), "ids": F.lit(2), "start": F.lit(3), "n_tokens": F.lit(4)})
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rows = lambda df: sorted(tuple(r) for r in packing.pack(df.where("doc_id <> 3"), path).select("doc_id", "start", "length", "ids_crc32").collect())
    assert rows(odd) == rows(edge)
    multi = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    digests = lambda df: sorted(tuple(r) for r in bpe.round_trip_digests(df, multi).select("doc_id", "n_tokens", "ids_sha256").collect())
    assert digests(odd) == digests(edge)
