"""Queries over state: journals and evidence as streams, reviews applied with receipts, reuse, change data, lookups."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.operators import claims as K
from lumenspool.operators import postings as P
from lumenspool.operators import reuse as R
from lumenspool.plans.registry import query
from lumenspool.sinks.keyed import KeyedTable, StaleBase, bundle
from lumenspool.sinks.shared import shared_path, written
from lumenspool.sources.adapters import table
from lumenspool.streaming import journal as J

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_parts(df, order: str, parts: int, tag: str) -> str:
    """A folder to which a table's rows are added in ``parts`` steps of ascending order, as a journal grows."""
    path, last = shared_path(df.sparkSession, tag), df.agg(F.max(order)).collect()[0][0] or 0
    for k in range(parts):
        step = (F.col(order) > last * k // parts) | F.lit(k == 0)
        df.where(step & ((F.col(order) <= last * (k + 1) // parts) | F.lit(k == parts - 1))).coalesce(1).write.mode("append").parquet(path)
    return path


@query("select user_id as key, arg_max(event_type, event_id) as value, max(event_id) as ordinal from events where user_id is not null group by 1")
def journal_replay(spark, sf):
    """_SemanticBatchJournal.recover: a stream of entries folds into a keyed table; it breaks off between writing and receipt, goes on, and is replayed from the start."""
    entries = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("ordinal"))
    at = _in_parts(entries, "ordinal", 3, "journal")
    state = KeyedTable(shared_path(spark, "state"), ("key",), 4)
    state.create(entries.limit(0))

    def stream():
        return spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(at)

    def broken(number: int, step: str) -> None:
        if (number, step) == (1, "replaced"):
            raise RuntimeError("lost between writing and receipt")

    first, again = shared_path(spark, "checkpoint"), shared_path(spark, "checkpoint")
    for checkpoint, fault in ((first, broken), (first, None), (again, None)):
        try:
            J.replay(stream(), state, "events", checkpoint, fault).awaitTermination()
        except StreamingQueryException:
            if fault is None:
                raise
    return state.read(spark)


_OBS = """o as (select user_id::varchar as image_id, event_id as ordinal, 'VA' || lpad((event_id // 3)::varchar, 6, '0') as observation_id, md5(event_type) as digest, greatest(n - (event_id % 4 = 0)::int - (event_id % 9 = 0)::int, 0)::bigint as base, n from
 (select *, row_number() over (partition by user_id order by event_id) - 1 as n from events))"""


def _observations(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    late = F.when(F.pmod("event_id", F.lit(4)) == 0, 1).otherwise(0) + F.when(F.pmod("event_id", F.lit(9)) == 0, 1).otherwise(0)
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("image_id"), F.col("event_id").alias("ordinal"), F.concat(F.lit("VA"), F.lpad(F.floor(F.col("event_id") / 3).cast("string"), 6, "0")).alias("observation_id"),
        F.md5("event_type").alias("digest"), F.greatest(n - late, F.lit(0)).cast("long").alias("base_revision"))


def _evidence_sql(modes: str) -> str:
    return f"""with recursive {_OBS}, m(allow_stale) as (values {modes}),
r as (select image_id, allow_stale, -1::bigint as n, 0::bigint as latest, [''] as ids, [''] as digests, null::bigint as ordinal, '' as observation_id, '' as outcome, null::bigint as revision, 0::bigint as base from (select distinct image_id from o), m
 union all select image_id, allow_stale, n, latest + ok::int, case when ok then list_append(ids, observation_id) else ids end, case when ok then list_append(digests, digest) else digests end, ordinal, observation_id, outcome, case when ok then latest + 1 end, base from
 (select *, outcome like 'accepted%' as ok from (select r.image_id, r.allow_stale, o.n, r.latest, r.ids, r.digests, o.ordinal, o.observation_id, o.digest, o.base,
  case when list_contains(r.ids, o.observation_id) then case when r.digests[list_position(r.ids, o.observation_id)] = o.digest then 'duplicate' else 'conflict' end
   when o.base <> r.latest and not r.allow_stale then 'stale' when o.base = r.latest then 'accepted' else 'accepted_stale' end as outcome from r join o on o.image_id = r.image_id and o.n = r.n + 1)))
select {{}}image_id, ordinal, observation_id, outcome, revision, base as base_revision from r where n >= 0"""


@query(_evidence_sql("(true), (false)").format("allow_stale, "))
def evidence_revisions(spark, sf):
    """ingest_observation: append-only revisions with optimistic bases, stale ones merged or refused."""
    o = written(_observations(spark, sf), "observations")
    return J.revisions(o, True).withColumn("allow_stale", F.lit(True)).union(J.revisions(o, False).withColumn("allow_stale", F.lit(False)))


@query(_evidence_sql("(false)").format(""))
def evidence_stream(spark, sf):
    """The same of a stream in three batches, a state for each image."""
    o = written(_observations(spark, sf), "observations")
    at, out = _in_parts(o, "ordinal", 3, "evidence"), shared_path(spark, "revisions")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream = J.revisions_stream(spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(at), False)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(out)


@query("select o_orderkey as review_id, o_orderstatus as status, case when o_orderpriority like '1%' then 'accepted' end as decision, case when o_orderpriority like '1%' then 1 else 0 end::bigint as ordinal from orders")
def review_bundle_applied(spark, sf):
    """create_review_bundle, apply_review_bundle: decisions of a bundle are applied once; a bundle made against rows that have changed since is refused as a whole."""
    o = table(spark, sf, "orders")
    items = KeyedTable(shared_path(spark, "reviews"), ("review_id",), 8)
    items.create(o.select(F.col("o_orderkey").alias("review_id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("decision"), F.lit(0).cast("long").alias("ordinal")))
    urgent = lambda *first: o.where(F.substring("o_orderpriority", 1, 1).isin(*first)).select(F.col("o_orderkey").alias("review_id"))
    made = lambda ids, ordinal: written(bundle(items, items.read(spark).join(ids, "review_id", "left_semi")).drop("bundle").withColumns({"decision": F.lit("accepted"), "ordinal": F.lit(ordinal).cast("long")}), "bundle")
    one, two = made(urgent("1"), 1), made(urgent("1", "2"), 2)  # both made before any is applied
    first, again = items.apply(one, "bundle-1"), items.apply(one, "bundle-1")
    try:
        refused = not items.apply(two, "bundle-2")
    except StaleBase:
        refused = True
    if one.isEmpty():
        return items.read(spark)
    if not (first and refused) or again:
        raise AssertionError("a bundle was applied twice, or against other rows")
    return items.read(spark)


@query("""with f as (select o_custkey % 50 as project, o_orderkey as event_id from orders where o_orderstatus = 'O' and o_custkey % 50 <> 7), i as (select o_custkey % 50 as project, o_orderkey as review_id, [o_orderkey] as event_ids, case when o_orderstatus = 'F' then 'done' else ' ' end as decision from orders where o_orderpriority like '5%' and o_custkey % 50 <> 9),
n as (select project, list(distinct event_id order by event_id) as now from f group by 1), l as (select *, row_number() over (partition by project order by review_id desc) as rn from i where trim(decision) = ''), b as (select coalesce(l.project, n.project) as project, review_id, event_ids, now, case when review_id is null then 'new' when now is null or rn > 1 then 'closed' else 'moved' end as state from l full join n on l.project = n.project)
select project, review_id, md5(array_to_string(case when state = 'closed' then event_ids else now end, ',')) as events, state from b""")
def budget_markers(spark, sf):
    """_sync_semantic_budget_review_item: one live marker a project."""
    o = table(spark, sf, "orders").withColumn("project", F.pmod("o_custkey", F.lit(50)))
    frontier = o.where("o_orderstatus = 'O' and project <> 7").select("project", F.col("o_orderkey").alias("event_id"))
    items = o.where("o_orderpriority like '5%' and project <> 9").select("project", F.col("o_orderkey").alias("review_id"), F.array("o_orderkey").alias("event_ids"), F.when(F.col("o_orderstatus") == "F", "done").otherwise(" ").alias("decision"))
    return K.budget_markers(frontier, items).select("project", "review_id", F.md5(F.array_join("event_ids", ",")).alias("events"), "state")


@query("""with recursive e as (select 's' || l_suppkey as source, 'p' || l_partkey as target from lineitem union select 'p' || l_partkey, 'o' || l_orderkey from lineitem union select 'o' || o_orderkey, 'c' || o_custkey from orders),
r(node, steps) as (select 's' || s_suppkey, 0 from supplier where s_acctbal < 0 union select e.target, r.steps + 1 from r join e on e.source = r.node) select node, min(steps)::int as steps from r group by 1""")
def stale_downstream(spark, sf):
    """StageCache.invalidate_from over a graph: parts, orders and customers that depend on suppliers whose record has changed."""
    i, o, s = (table(spark, sf, t) for t in ("lineitem", "orders", "supplier"))
    node = lambda kind, c: F.concat(F.lit(kind), c)
    edges = i.select(node("s", "l_suppkey").alias("source"), node("p", "l_partkey").alias("target")).union(i.select(node("p", "l_partkey"), node("o", "l_orderkey"))).union(o.select(node("o", "o_orderkey"), node("c", "o_custkey")))
    return R.downstream(edges, s.where("s_acctbal < 0").select(node("s", "s_suppkey").alias("node")))


@query("""with d as (select doc_id, text, case when lang = 'en' then coalesce(text, '') || ' edited' else text end as new from documents), k as (select distinct sha256(text) as k from d where text is not null)
select doc_id, len(regexp_extract_all(new, '[^ ]+'))::bigint as words, new is not null and sha256(new) not in (select k from k) as computed from d""")
def reused_results(spark, sf):
    """_load_or_run_ocr, _restore_ocr_cache: results are kept by content; after an edit only contents without one are computed, and a run that is repeated computes nothing."""
    d = table(spark, sf, "documents")
    results = R.results_table(shared_path(spark, "results"), 8)
    request = lambda text: d.select("doc_id", text.alias("content")).withColumn("content_key", F.sha2("content", 256))
    compute = lambda missing: missing.select("content_key", F.size(F.regexp_extract_all("content", F.lit("[^ ]+"), 0)).cast("long").alias("words"))
    results.create(compute(request(d["text"]).limit(0)).withColumn("ordinal", F.lit(0).cast("long")))
    R.reuse(request(d["text"]), results, compute, "first")
    known = written(results.read(spark).select(F.col("content_key").alias("known")), "known")
    new = request(F.when(F.col("lang") == "en", F.concat(F.coalesce("text", F.lit("")), F.lit(" edited"))).otherwise(F.col("text")))
    R.reuse(new, results, compute, "second")
    if not R.misses(new, results.read(spark)).isEmpty():
        raise AssertionError("contents without a result are left")
    out = R.reuse(new, results, compute, "third").join(known, F.col("content_key") == F.col("known"), "left")
    return out.select("doc_id", "words", (F.col("content_key").isNotNull() & F.col("known").isNull()).alias("computed"))


_SIG = "sha256(coalesce(length(a) || ':' || a, '-') || ',' || coalesce(length(b::varchar) || ':' || b::varchar, '-'))"


def _two_states(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id"), F.when(F.pmod("user_id", F.lit(50)) != 0, F.col("user_id")).alias("k"), F.col("event_type").alias("a"), F.round(F.col("value") * 100).cast("long").alias("b"))
    keep = lambda r: F.pmod("event_id", F.lit(10)) != r
    return e.where(keep(3)).drop("event_id"), e.where(keep(4)).withColumn("a", F.when(F.pmod("event_id", F.lit(7)) == 0, "x").otherwise(F.col("a"))).drop("event_id")


@query(f"""with e as (select event_id, case when user_id % 50 <> 0 then user_id end as k, event_type as a, round(value * 100)::bigint as b from events), o as (select k, a, b from e where event_id % 10 <> 3), n as (select k, case when event_id % 7 = 0 then 'x' else a end as a, b from e where event_id % 10 <> 4),
r as (select k, a, b, {_SIG} as s, -1 as side from o union all select k, a, b, {_SIG}, 1 from n), c as (select k, a, b, s, sum(side) as d from r group by all having sum(side) <> 0), x as (select k, a, b, s, sign(d) as side, unnest(range(abs(d)::bigint)) from c),
y as (select *, row_number() over (partition by k, side order by s) as i from x), f as (select * from y where side < 0), t as (select * from y where side > 0)
select coalesce(f.k, t.k) as k, case when f.s is null then 'insert' when t.s is null then 'delete' else 'update' end as op, t.a, t.b, f.s as before, t.s as after from f full join t on f.k is not distinct from t.k and f.i = t.i""")
def change_data(spark, sf):
    """_ocr_signature, ocr_changed: what turns one state of a table into another, repeats and null keys included."""
    return R.changes(*_two_states(spark, sf), ["k"], ["a", "b"])


@query("""with old as (select doc_id, lang as reading, source as decision from documents where doc_id % 9 <> 2), new as (select doc_id, case when doc_id % 5 = 0 then upper(lang) else lang end as reading from documents where doc_id % 9 <> 4)
select coalesce(new.doc_id, old.doc_id) as doc_id, new.reading, old.decision from new left join old on old.doc_id = new.doc_id""")
def refreshed_readings(spark, sf):
    """refresh_project_ocr: only what changed is replaced, decisions stay, what is gone goes."""
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 9 <> 2").select("doc_id", F.col("lang").alias("reading"), F.col("source").alias("decision"))
    new = d.where("doc_id % 9 <> 4").select("doc_id", F.when(F.pmod("doc_id", F.lit(5)) == 0, F.upper("lang")).otherwise(F.col("lang")).alias("reading"))
    delta = R.changes(old.select("doc_id", "reading"), new, ["doc_id"], ["reading"])
    return R.refreshed(old, delta, ["doc_id"], ["reading"], ["decision"])


@query("select doc_id, case when doc_id % 4 <> 1 then lang || source end as state, doc_id % 4 <> 1 as reused from documents")
def carried_state(spark, sf):
    """_reuse_visual_state: items keep the state of an earlier run if what they show is unchanged."""
    d = table(spark, sf, "documents")
    earlier = d.select("doc_id", "text", F.concat("lang", "source").alias("state"))
    now = d.select("doc_id", F.when(F.pmod("doc_id", F.lit(4)) == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text")).alias("text"))
    return R.carried_state(now, earlier, "doc_id", ["text"], ["state"]).select("doc_id", "state", "reused")


@query("""with a as (select conv_id, turn, ['F' || conv_id, 'F' || (conv_id + turn) % 100, 'F' || conv_id] as ids, 'F' || (conv_id // 2) as base from conversations), p as (select distinct 'observations' as source, 'ids' as role, conv_id || '-' || turn as key, unnest(ids) as id from a union all select 'observations', 'base', conv_id || '-' || turn, base from a
 union all select 'revisions', 'image', o_orderkey::varchar, 'F' || o_custkey from orders union all select distinct 'packets', 'frames', user_id || '-' || event_id, unnest(['F' || user_id, 'F' || event_id % 300]) from events)
select id, source, role, key from p where id in (select 'F' || c_custkey from customer where c_acctbal < 0)""")
def evidence_lookup(spark, sf):
    """show_image_metadata, SemanticBatchContext.from_project: everything that holds the ids of a table, out of postings in buckets."""
    c = table(spark, sf, "conversations")
    image = lambda n: F.concat(F.lit("F"), n.cast("string"))
    row = F.concat_ws("-", "conv_id", "turn")
    observations = c.select(row.alias("key"), F.array(image(F.col("conv_id")), image(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(100))), image(F.col("conv_id"))).alias("ids"), image(F.floor(F.col("conv_id") / 2)).alias("base"))
    revisions = table(spark, sf, "orders").select("o_orderkey", image(F.col("o_custkey")).alias("image"))
    packets = table(spark, sf, "events").select(F.concat_ws("-", "user_id", "event_id").alias("key"), F.array(image(F.col("user_id")), image(F.pmod("event_id", F.lit(300)))).alias("frames"))
    path = shared_path(spark, "postings")
    P.write(P.postings({"observations": (observations, "key", ["ids", "base"]), "revisions": (revisions, "o_orderkey", ["image"]), "packets": (packets, "key", ["frames"])}), path, 16)
    asked = table(spark, sf, "customer").where("c_acctbal < 0").select(image(F.col("c_custkey")).alias("id"))
    return P.lookup_all(spark, path, asked, 16)
