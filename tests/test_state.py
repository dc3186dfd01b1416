"""Keyed tables, journals, evidence, reuse, change data, postings and JSON records: restarts, repeats, refusals."""

import glob
import json
import os
import random
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lumenspool.operators import claims, postings, reuse
from lumenspool.sinks.keyed import KeyedTable, StaleBase, bundle
from lumenspool.sources import json_records
from lumenspool.streaming import journal

KIND = "key string, value string, ordinal long"


def _rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def _table(spark, path, rows=(), buckets=8):
    t = KeyedTable(str(path), ("key",), buckets)
    t.create(spark.createDataFrame(list(rows), KIND))
    return t


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/**/part-*", recursive=True)}


def test_changes_rewrite_only_their_buckets(spark, tmp_path):
    t = _table(spark, tmp_path / "t", [(f"k{i}", "old", 0) for i in range(40)])
    before = _files(t.path)
    change = spark.createDataFrame([("k3", "new", 1), ("k3", "older", 0), (None, "lost", 9)], KIND)
    assert t.apply(change, "one") and not t.apply(change, "one")
    after = _files(t.path)
    same = [f for f in before if f in after]
    assert len(same) == len(before) - 1 and all(before[f] == after[f] for f in same)
    assert dict((r[0], r[1]) for r in _rows(t.read(spark)))["k3"] == "new" and t.read(spark).count() == 40
    assert [(r.receipt, r.changes, r.touched) for r in t.receipts(spark).collect()] == [("one", 1, 1)]


@pytest.mark.parametrize("step", ["staged", "replaced", "receipt"])
def test_a_change_set_goes_on_where_it_broke_off(spark, tmp_path, step):
    t = _table(spark, tmp_path / "t", [(f"k{i}", "old", 0) for i in range(10)])
    change = spark.createDataFrame([("k1", "new", 1), ("k2", None, 1), ("n", "added", 1)], KIND)

    def lost(at):
        if at == step:
            raise RuntimeError(at)

    with pytest.raises(RuntimeError):
        t.apply(change, "one", lost)
    assert t.apply(change, "one") == (step != "receipt")
    assert not t.apply(change, "one")
    assert {r[0]: r[1] for r in _rows(t.read(spark))} == {f"k{i}": "old" for i in range(10)} | {"k1": "new", "k2": None, "n": "added"}
    assert t.receipts(spark).count() == 1


def test_late_changes_deletions_and_patches(spark, tmp_path):
    t = _table(spark, tmp_path / "t", [("a", "x", 5), ("b", "y", 5)])
    t.apply(spark.createDataFrame([("a", "late", 4), ("b", "gone", 6)], KIND).withColumn("deleted", F.col("key") == "b"), "one")
    assert _rows(t.read(spark)) == [("a", "x", 5)]
    t.apply(spark.createDataFrame([("b", "too late", 5)], KIND), "two")  # what was deleted at 6 stays deleted
    assert _rows(t.read(spark)) == [("a", "x", 5)]
    patch = t.patched(spark.createDataFrame([("a", 7), ("c", 7)], "key string, ordinal long"))
    t.apply(patch.select("key", "value", "ordinal"), "three")
    assert _rows(t.read(spark)) == [("a", "x", 7), ("c", None, 7)]
    t.apply(spark.createDataFrame([], KIND), "none")
    assert t.applied(spark, "none") and t.read(spark).count() == 2


def test_an_empty_table_takes_changes(spark, tmp_path):
    t = _table(spark, tmp_path / "t")
    assert t.read(spark).collect() == []
    t.apply(spark.createDataFrame([("a", "x", None)], KIND), "one")
    assert _rows(t.read(spark)) == [("a", "x", None)]


def test_stale_bundles_are_refused_whole(spark, tmp_path):
    t = _table(spark, tmp_path / "t", [(f"k{i}", "open", 0) for i in range(6)])
    made = bundle(t, t.read(spark), 2)
    assert made.count() == 6 and made.groupBy("bundle").count().agg(F.max("count")).first()[0] <= 2
    kept = [tuple(r) for r in made.drop("bundle").withColumns({"value": F.lit("done"), "ordinal": F.lit(1).cast("long")}).collect()]
    later = spark.createDataFrame(kept, "key string, value string, ordinal long, base string")
    t.apply(spark.createDataFrame([("k0", "edited", 1)], KIND), "edit")
    with pytest.raises(StaleBase):
        t.apply(later, "bundle")
    assert Counter(r[1] for r in _rows(t.read(spark))) == {"open": 5, "edited": 1}
    assert t.apply(later.where("key <> 'k0'"), "bundle")
    assert Counter(r[1] for r in _rows(t.read(spark))) == {"done": 5, "edited": 1}


@pytest.mark.parametrize("step", ["staged", "replaced", "receipt"])
def test_journal_stream_restarts_between_write_and_commit(spark, tmp_path, step):
    entries = [(f"k{i % 7}", f"v{i}", i) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(entries[k * 20:k * 20 + 20], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "j"))
    t = _table(spark, tmp_path / "t", buckets=3)
    stream = lambda: spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "j"))

    def lost(number, at):
        if (number, at) == (1, step):
            raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        journal.replay(stream(), t, "j", str(tmp_path / "c"), lost).awaitTermination()
    assert t.receipts(spark).count() == (2 if step == "receipt" else 1)
    for checkpoint in ("c", "c2"):  # goes on; then everything is delivered again
        journal.replay(stream(), t, "j", str(tmp_path / checkpoint)).awaitTermination()
        assert _rows(t.read(spark)) == sorted(dict((k, (k, v, o)) for k, v, o in entries).values())
        assert t.receipts(spark).count() == 3


def test_torn_and_invalid_lines(spark):
    lines = [("a", 1, '{"x":1}'), ("a", 2, " "), ("a", 3, '{"x":'), ("b", 1, '{"x":'), ("b", 2, "[1]"), ("c", 1, '{"x":2}')]
    found = journal.torn(spark.createDataFrame(lines, "journal string, line int, raw string"))
    assert sorted((r.journal, r.line, r.fault) for r in found.select("journal", "line", "fault").collect()) == [("a", 1, None), ("a", 3, "torn"), ("b", 1, "invalid"), ("b", 2, "invalid"), ("c", 1, None)]


OBS = "image_id string, ordinal long, observation_id string, digest string, base_revision long"


def _folded(rows, allow_stale):
    out, state = [], {}
    for image, ordinal, observation, digest, base in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if image is None or observation is None:
            out.append((image, ordinal, observation, "invalid", None, base or 0))
            continue
        latest, seen = state.setdefault(image, [0, {}])
        if observation in seen:
            out.append((image, ordinal, observation, "duplicate" if seen[observation] == (digest or "") else "conflict", None, base or 0))
        elif (base or 0) != latest and not allow_stale:
            out.append((image, ordinal, observation, "stale", None, base or 0))
        else:
            out.append((image, ordinal, observation, "accepted" if (base or 0) == latest else "accepted_stale", latest + 1, base or 0))
            state[image][0], seen[observation] = latest + 1, digest or ""
    return sorted(out, key=str)


def _observations():
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([i, i, None]), rng.choice([f"o{rng.randrange(40)}", None]), rng.choice(["x", "y", None]), rng.choice([0, 1, 2, 3, None, i // 6])) for i in range(300)]
    return rows + rows[:30]


@pytest.mark.parametrize("allow_stale", [True, False])
def test_revisions_by_brute_force(spark, allow_stale):
    rows = _observations()
    found = journal.revisions(spark.createDataFrame(rows, OBS).repartition(3), allow_stale)
    assert _rows(found) == _folded(rows, allow_stale)
    assert journal.revisions(spark.createDataFrame([], OBS)).collect() == []


def test_evidence_stream_restarts(spark, tmp_path):
    rows = [(f"i{k % 3}", k, f"o{k // 2}", "x" if k % 5 else "y", k // 4) for k in range(60)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):  # the query is started anew for each part of the journal and goes on from its checkpoint
            spark.createDataFrame(rows[k * 20:k * 20 + 20], OBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "j"))
            stream = journal.revisions_stream(spark.readStream.schema(OBS).parquet(str(tmp_path / "j")), False)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert _rows(spark.read.parquet(str(tmp_path / "out"))) == _folded(rows, False)


# Reuse and change data


def test_downstream_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), (None, "z"), ("b", None), ("a", "b")], "source string, target string")
    found = reuse.downstream(edges, spark.createDataFrame([("a",), ("a",), (None,)], "node string"))
    assert _rows(found) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert reuse.downstream(edges, spark.createDataFrame([], "node string")).collect() == []


def test_later_stages_fall(spark):
    marks = spark.createDataFrame([(i, s) for i in range(2) for s in ("probe", "survey", "ocr", "render")], "item int, stage string")
    assert {r.stage for r in reuse.invalidated(["probe", "survey", "ocr", "render"], marks, "ocr").collect()} == {"ocr", "render"}
    with pytest.raises(ValueError):
        reuse.invalidated(["probe"], marks, "nothing")


def test_second_run_computes_nothing(spark, tmp_path):
    results = reuse.results_table(str(tmp_path / "r"), 4)
    calls = []

    def compute(missing):
        rows = missing.select("content_key", F.length("content_key").cast("long").alias("size"))
        calls.append(missing.count())
        return rows

    results.create(spark.createDataFrame([], "content_key string, size long, ordinal long"))
    requests = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "id int, content_key string")
    first = reuse.reuse(requests, results, compute, "one")
    assert sorted((r.id, r.size) for r in first.collect()) == [(1, 2), (2, 2), (3, 1), (4, None)]
    changed = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "ccc"), (4, None)], "id int, content_key string")
    reuse.reuse(changed, results, compute, "two")
    reuse.reuse(changed, results, compute, "two")  # done before: not asked again
    reuse.reuse(changed, results, compute, "three")
    assert calls == [2, 1, 0]


def test_changes_turn_old_into_new(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None, ""])) for _ in range(n)]
    for old, new in ((make(40), make(40)), ([], make(5)), (make(5), []), ([], [])):
        kind = "k int, v string"
        found = reuse.changes(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), ["k"], ["v"]).collect()
        left = Counter(old)
        signature = {v: spark.range(1).select(reuse.signature(F.lit(v).cast("string"))).first()[0] for v in {v for _, v in old + new}}
        named = {s: v for v, s in signature.items()}
        for r in found:
            assert r.op in ("insert", "update", "delete") and r.before != r.after
            if r.before:
                left[(r.k, named[r.before])] -= 1
            if r.after:
                left[(r.k, named[r.after])] += 1
                assert r.v == named[r.after]
        assert +left == Counter(new) and min(left.values(), default=0) >= 0


def test_budget_markers_without_frontier(spark):
    items = spark.createDataFrame([("p", 1, ["e"], None), ("p", 2, ["e"], ""), ("q", 3, ["e"], "done")], "project string, review_id int, event_ids array<string>, decision string")
    nothing = spark.createDataFrame([], "project string, event_id string")
    assert {(r.review_id, r.state) for r in claims.budget_markers(nothing, items).collect()} == {(1, "closed"), (2, "closed")}
    some = spark.createDataFrame([("p", "x"), ("q", "y")], "project string, event_id string")
    assert {(r.project, r.review_id, r.state) for r in claims.budget_markers(some, items).collect()} == {("p", 2, "moved"), ("p", 1, "closed"), ("q", None, "new")}


def test_lookup_reads_the_buckets_of_its_ids(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("key"), F.array(F.concat(F.lit("F"), F.col("id") % 50), F.concat(F.lit("F"), F.col("id") % 50), F.lit(None)).alias("ids"))
    postings.write(postings.postings({"t": (rows, "key", ["ids"])}), str(tmp_path / "p"), 16)
    found = postings.lookup(spark, str(tmp_path / "p"), ["F7", "none"], 16)
    assert sorted(int(r.key) for r in found.collect()) == list(range(7, 1000, 50))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


# Typed records


def _record(i, **other):
    return json.dumps({"candidate_id": f"C{i}", "frames": [{"frame_id": "F1"}], "questions": [], "max_span_ms": 5} | other, ensure_ascii=False).encode()


@pytest.mark.parametrize("split", [37, 1000, 1 << 26])
def test_records_in_ranges_of_any_size(spark, tmp_path, split):
    lines = [_record(0), b"", _record(1, questions=["ä" * 50]), b"\xff\xfe", b"{", b"3", _record(2, max_span_ms=True), _record(3, frames=[{}]), b'{"candidate_id":5}', b"x" * 3000, _record(4)]
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(lines))
    (tmp_path / "b.jsonl").write_bytes(b"\n".join([_record(5), _record(6)]) + b"\n")
    (tmp_path / "_skipped").write_bytes(b"{}")
    (tmp_path / "c.jsonl").write_bytes(b"")
    json_records.register(spark)
    df = spark.read.format("json_records").option("path", str(tmp_path)).option("kind", "packet").option("max_bytes", 2000).option("split_bytes", split).load()
    found = df.collect()
    reasons = Counter(r.reason for r in found)
    assert reasons == {None: 5, "not utf-8": 1, "not json": 1, "not an object": 1, "max_span_ms is no number": 1, "frame without frame_id": 1, "candidate_id is no text": 1, "too large": 1}
    assert sorted(r.candidate_id for r in found if r.reason is None) == ["C0", "C1", "C4", "C5", "C6"]
    assert all(json.loads(r.record)["candidate_id"] == r.candidate_id for r in found if r.reason is None)
    only = df.where("file = 'b.jsonl'")
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert only.count() == 2 and "b.jsonl)" not in plan.split("BatchScan")[0]  # the source has taken the filter over


def test_records_of_a_missing_path_and_kind(spark, tmp_path):
    json_records.register(spark)
    with pytest.raises(Exception, match="FileNotFoundError|nothing"):
        spark.read.format("json_records").option("path", str(tmp_path / "nothing")).load().collect()
    with pytest.raises(Exception, match="unknown kind"):
        spark.read.format("json_records").option("path", str(tmp_path)).option("kind", "song").load().collect()
