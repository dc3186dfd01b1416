"""Registered queries of claims, review and evaluation, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspool.operators import claims as K
from lumenspool.operators import evaluation as E
from lumenspool.plans.registry import query
from lumenspool.sources.adapters import table

# A part is an image, its items are claims, suppliers are observations.
CLAIMS = """l0 as (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) as rn from lineitem),
c as (select l_partkey as image_id, rn as ordinal, 'IC' || lpad(rn::varchar, 6, '0') as claim_id, l_linestatus as claim_class, 'Size  ' || (l_quantity::int % 7) || case when rn % 2 = 0 then ' .' else '' end as statement, case when l_tax > 0.04 then 'V' end as value, case l_returnflag when 'A' then 'supported' when 'N' then 'proposed' else 'disputed' end as status,
 case when l_discount >= 0.09 then 'high_impact' else 'supporting' end as importance, l_discount = 0.05 as high_impact, l_tax > 0.01 as region, rn % 9 <> 0 as pictured, l_suppkey as k1, l_suppkey % 7 as k2, 'MR' || (rn % 4) as last_revision_id from l0),
o as (select s_suppkey as k, s_suppkey % 5 = 0 as human, s_suppkey % 2 as provider, s_suppkey % 3 as model, s_suppkey % 4 = 1 as blind, s_suppkey % 3 = 0 as prior_visible from supplier),
ip as (select distinct c.image_id, c.claim_id, 'o' || a.k as left_id, 'o' || b.k as right_id from c join o a on a.k = c.k1 join o b on b.k = c.k2 where a.human or b.human or (((a.blind and not a.prior_visible) or (b.blind and not b.prior_visible)) and (a.provider <> b.provider or a.model <> b.model or a.prior_visible <> b.prior_visible or a.blind <> b.blind))),
sup as (select image_id, claim_id from ip union select image_id, claim_id from c join o on o.k in (c.k1, c.k2) where o.human)"""


def claims(spark, sf):
    i = table(spark, sf, "lineitem").withColumn("rn", F.expr("row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag)"))
    none = F.array().cast("array<string>")
    return i.select(
        F.col("l_partkey").alias("image_id"), F.col("rn").cast("long").alias("ordinal"), F.format_string("IC%06d", "rn").alias("claim_id"), F.col("l_linestatus").alias("claim_class"), F.concat(F.lit("Size  "), F.pmod(F.col("l_quantity").cast("int"), F.lit(7)), F.when(F.pmod("rn", F.lit(2)) == 0, " .").otherwise("")).alias("statement"),
        F.when(F.col("l_tax") > 0.04, "V").alias("value"), F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "N", "proposed").otherwise("disputed").alias("status"), F.when(F.col("l_discount") >= 0.09, "high_impact").otherwise("supporting").alias("importance"), (F.col("l_discount") == 0.05).alias("high_impact"),
        (F.col("l_tax") > 0.01).alias("region"), F.when(F.pmod("rn", F.lit(9)) != 0, F.array(F.col("l_partkey").cast("string"))).otherwise(none).alias("image_ids"), F.array(F.concat(F.lit("o"), "l_suppkey"), F.concat(F.lit("o"), F.pmod("l_suppkey", F.lit(7)))).alias("supporting"), none.alias("contradicting"), F.concat(F.lit("MR"), F.pmod("rn", F.lit(4))).alias("last_revision_id"))


def observations(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(F.concat(F.lit("o"), k).alias("observation_id"), F.when(F.pmod(k, F.lit(5)) == 0, "human").otherwise("model").alias("actor"), F.pmod(k, F.lit(2)).cast("string").alias("provider"), F.pmod(k, F.lit(3)).cast("string").alias("model"), F.lit("1").alias("version"),
                                               F.lit("x").alias("prompt"), F.when(F.pmod(k, F.lit(4)) == 1, "blind").otherwise("cumulative").alias("depth"), (F.pmod(k, F.lit(3)) == 0).alias("prior_visible"))


@query(f"with {CLAIMS} select * from ip")
def independent_observation_pairs(spark, sf):
    """independent_observation_pairs and observation_can_independently_check."""
    return K.independent_pairs(claims(spark, sf), observations(spark, sf)).distinct()


@query(f"""with {CLAIMS}, k as (select *, claim_class || '|' || regexp_replace(lower(trim(regexp_replace(statement, '\\s+', ' ', 'g'))), '[. ]+$', '') || '|' || lower(coalesce(value, '')) as key from c), f as (select image_id, key, arg_min(claim_id, ordinal) as first_id from k group by 1, 2)
select k.image_id, k.claim_id, f.first_id as equivalent_id, (sup.claim_id is not null) as independent, case when high_impact or importance = 'high_impact' then 'proposed' else 'supported' end as initial from k join f using (image_id, key) left join sup using (image_id, claim_id)""")
def claim_equivalence(spark, sf):
    """claim_equivalence_key, find_equivalent_claim, claim_has_independent_support, proposed_to_claim."""
    c = claims(spark, sf)
    found = K.find_equivalent(c, c, ["image_id"]).select("image_id", "claim_id", "equivalent_id", K.initial_status(F.lit("new"), F.col("claim_class"), F.col("high_impact"), F.col("importance")).alias("initial"))
    sure = K.with_independent_support(c, observations(spark, sf)).withColumn("independent", F.lit(True))
    return found.join(sure, ["image_id", "claim_id"], "left").withColumn("independent", F.coalesce("independent", F.lit(False)))


@query(f"""with {CLAIMS} select image_id, 'IC' || lpad((max(ordinal) + 1)::varchar, 6, '0') as next_id, md5(coalesce(string_agg(case when status = 'supported' then case when regexp_matches(statement, '[.!?]$') then trim(statement) else trim(statement) || '.' end end, ' ' order by ordinal), '')) as description_md5 from c group by 1""")
def claim_summaries(spark, sf):
    """next_claim_id and synthesize_factual_description."""
    c = claims(spark, sf)
    return K.next_number(c, "claim_id", "image_claim", ["image_id"]).join(K.description(c), "image_id").select("image_id", "next_id", F.md5(F.coalesce("description", F.lit(""))).alias("description_md5"))


_ANSWERS = CLAIMS + """, u as (select c.image_id, c.claim_id, status, high_impact or importance = 'high_impact' or status = 'disputed' as guarded, status = 'supported' and region and pictured and (not (high_impact or importance = 'high_impact') or sup.claim_id is not null) as usable from c left join sup using (image_id, claim_id)),
qs as (select p_partkey as image_id, 'Q1' as question_id, unnest(['IC000001', 'IC000003', 'IC000099']) as claim_id, p_size as precision from part union all select p_partkey, 'Q2', 'IC000002', p_size from part),
a as (select qs.image_id, question_id, any_value(precision) as precision, coalesce(bool_or(usable), false) as usable, coalesce(bool_or(status = 'disputed'), false) as disputed, coalesce(bool_or(guarded), false) as guarded, coalesce(string_agg(case when usable then u.claim_id end, ',' order by u.claim_id), '') as ids from qs left join u using (image_id, claim_id) group by 1, 2),
answers as (select image_id, question_id, usable and image_id % 13 <> 0 as answered, case when usable and image_id % 13 <> 0 then ids else '' end as claims, case when usable and image_id % 13 <> 0 then null when image_id % 13 = 0 then 'image payload is stale, corrupt, or mismatched' when disputed then 'credible image claims remain disputed' when guarded then 'high-impact/disputed evidence lacks an independent blind check' else 'no current supported claim answers at ' || precision end as gap from a)"""


def answers(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_size").cast("string").alias("precision"))
    ask = lambda name, *ids: part.select("image_id", F.lit(name).alias("question_id"), "precision", F.array(*[F.lit(i) for i in ids]).alias("candidate_claim_ids"))
    questions = ask("Q1", "IC000001", "IC000003", "IC000099").union(ask("Q2", "IC000002"))
    return K.sufficiency(questions, claims(spark, sf), observations(spark, sf), part.where("image_id % 13 <> 0").select("image_id"))


@query(f"with {_ANSWERS} select * from answers")
def evaluate_sufficiency(spark, sf):
    """evaluate_sufficiency: answered questions, supporting claims, exact gaps."""
    return answers(spark, sf).withColumn("claims", F.array_join("claims", ","))


@query(f"""with {_ANSWERS}, d as (select image_id, count_if(not answered)::bigint as unanswered from answers group by 1), s as (select *, case when unanswered = 0 then 'sufficient' when image_id % 4 = 0 then 'semantic_observer_unavailable' when image_id % 4 = 1 then 'limit_reached' when image_id % 4 = 2 then 'no_further_evidence' else 'insufficient' end as status from d)
select image_id, unanswered, status, status = 'insufficient' and image_id % 3 < 2 as again from s""")
def sufficiency_decisions(spark, sf):
    """The status ladder of evaluate_sufficiency and should_request_another_pass."""
    k = F.col("image_id")
    state = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id")).select("image_id", (F.pmod(k, F.lit(4)) != 0).alias("observer_available"), (F.pmod(k, F.lit(4)) == 1).alias("limit_reached"), (F.pmod(k, F.lit(4)) == 2).alias("no_further_evidence"))
    d = K.decisions(answers(spark, sf), state)
    return d.select("image_id", "unanswered", "status", K.wants_another_pass(F.col("status"), F.pmod(k, F.lit(3)), F.lit(True)).alias("again"))


# Two steps a claim: one by each of its observers; the kind by their numbers.
_KIND = "case (ordinal + {n}) % 5 when 0 then 'contradict' when 1 then 'reject' when 2 then 'narrow' else 'confirm' end"
_STEP = """case {k} when 'confirm' then case when {s} in ('proposed', 'unresolved') and {n} = 0 and (not (high_impact or importance = 'high_impact' or {s} = 'disputed') or {m}) then 'supported' else {s} end when 'contradict' then 'disputed' when 'reject' then 'rejected' else 'superseded' end"""


@query(f"""with {CLAIMS}, a as (select *, {_KIND.format(n=0)} as a1, {_KIND.format(n=1)} as a2 from c), b as (select *, {_STEP.format(k="a1", s="status", n="0", m="k1 % 5 = 0")} as st1, case when a1 in ('contradict', 'reject') then 1 else 0 end as n1 from a), d as (select *, {_STEP.format(k="a2", s="st1", n="n1", m="k2 % 5 = 0")} as st2 from b)
select image_id, claim_id, st2 as status, (case when k1 = k2 then 1 else 2 end + case when a1 = 'confirm' or a2 = 'confirm' then 1 else 0 end)::int as supporting, (case when a1 in ('contradict', 'reject') and a2 in ('contradict', 'reject') then 1 when a1 in ('contradict', 'reject') or a2 in ('contradict', 'reject') then 1 else 0 end)::int as contradicting from d""")
def reconcile_claims(spark, sf):
    """reconcile_observation: confirm, contradict, reject and narrow in order; history stays."""
    c = claims(spark, sf).withColumn("supporting", F.array_distinct("supporting"))
    k1 = F.regexp_extract(F.col("supporting")[0], r"(\d+)", 1).cast("long")
    step = lambda n, may: c.select("image_id", "claim_id", F.lit(n).cast("long").alias("step"), F.expr(_KIND.format(n=n)).alias("kind"), F.lit("observed").alias("observation_id"), may.alias("may_check"))
    actions = step(0, F.pmod(k1, F.lit(5)) == 0).union(step(1, F.pmod(F.pmod(k1, F.lit(7)), F.lit(5)) == 0)).withColumnRenamed("step", "ordinal")
    return K.reconcile(c, actions).select("image_id", "claim_id", "status", F.size("supporting").alias("supporting"), F.size("contradicting").alias("contradicting"))


@query(f"""with {CLAIMS}, cited as (select distinct image_id, 'IC' || lpad(((image_id % 5) + 1)::varchar, 6, '0') as claim_id from c), g as (select *, high_impact or importance = 'high_impact' or status = 'disputed' as guard from c)
select 'unsupported' as finding, cited.image_id, cited.claim_id from cited left join c using (image_id, claim_id) where c.status is null or c.status <> 'supported' union all select 'disputed', image_id, claim_id from g where status = 'disputed' union all select 'unresolved', image_id, claim_id from g where status = 'proposed'
union all select 'guarded', image_id, claim_id from g where status in ('proposed', 'disputed') and guard union all select 'stale', image_id, claim_id from g where pictured and last_revision_id not in ('MR0', 'MR1')""")
def claim_findings(spark, sf):
    """audit_project: claims that are cited unsupported, disputed, unresolved, guarded or stale."""
    c = claims(spark, sf).withColumn("image_id", F.col("image_id").cast("string"))
    images = c.select("image_id").distinct()
    cited = images.select("image_id", F.format_string("IC%06d", F.pmod(F.col("image_id").cast("long"), F.lit(5)) + 1).alias("claim_id"))
    revisions = images.select("image_id", F.explode(F.array(F.lit("MR0"), F.lit("MR1"))).alias("revision_id"))
    return K.claim_findings(c, cited, revisions).select("finding", F.col("image_id").cast("long").alias("image_id"), "claim_id")


@query("""with k as (select 'V' || lpad(e.event_id::varchar, 6, '0') as id, 'k' || e.user_id as stable_key, event_id from events e where event_id between 1 and 900000 qualify row_number() over (partition by user_id order by event_id) = 1 and user_id % 3 = 0), w as (select 'k' || user_id as stable_key, min(event_id) as ordinal from events group by 1),
n as (select stable_key, ordinal, row_number() over (order by ordinal, stable_key) as rn from w where stable_key not in (select stable_key from k)), t as (select max(substr(id, 2)::bigint) as top from k)
select stable_key, id from w join k using (stable_key) union all select stable_key, 'V' || lpad((top + rn)::varchar, 6, '0') from n, t""")
def stable_ids(spark, sf):
    """StableIdAllocator: known keys keep their ids, new ones get the next."""
    e = table(spark, sf, "events").select(F.concat(F.lit("k"), "user_id").alias("stable_key"), "event_id", "user_id")
    known = e.where("user_id % 3 = 0 and event_id between 1 and 900000").groupBy("stable_key").agg(F.min("event_id").alias("n")).select("stable_key", F.format_string("V%06d", "n").alias("id"))
    return K.allocate(known, e.select("stable_key", F.col("event_id").alias("ordinal")), "visual_event")


@query("""with i as (select o_custkey as key, o_orderkey as ordinal, o_orderstatus as value from orders), e as (select *, case when ordinal % 3 = 0 then 1 else 0 end as change from i where ordinal % 3 <> 0 or key % 10 <> 7) select key, value, ordinal from e qualify row_number() over (partition by key order by change desc, ordinal desc) = 1""")
def journal_upsert(spark, sf):
    """_journal_upsert and _journal_upsert_nested: the last change of a key wins, changes without key do nothing."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("value"))
    changes = o.where("ordinal % 3 = 0").withColumn("key", F.when(F.pmod("key", F.lit(10)) != 7, F.col("key")))
    return K.upsert(o.where("ordinal % 3 <> 0"), changes, "key")


_REVIEW = """q as (select o_custkey % 50 as project, o_orderkey as review_id, case o_orderpriority[1] when '1' then 'transcript' when '2' then 'wording' when '3' then 'visual' else 'spoken' end as category, o_orderkey % 4 as parts from orders),
d as (select l_orderkey as review_id, l_linenumber, case l_returnflag when 'A' then 'accept' else 'reject' end as decision, 'r' || l_suppkey as reviewer, case when l_tax > 0.02 then 'text ' || l_suppkey end as replacement, l_orderkey::bigint * 1000000000 + l_partkey * 1000 + (l_quantity * 10)::bigint % 1000 as ordinal from lineitem where l_discount > 0),
x as (select review_id, arg_max(decision, o) as decision, arg_max(reviewer, o) as reviewer, arg_max(coalesce(replacement, ''), o) as replacement from (select *, ordinal * 100000 + substr(reviewer, 2)::bigint as o from d) group by 1)"""


def reviews(spark, sf):
    o = table(spark, sf, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    n = F.pmod("o_orderkey", F.lit(4))
    items = o.select(F.pmod("o_custkey", F.lit(50)).alias("project"), F.col("o_orderkey").alias("review_id"), F.when(first == "1", "transcript").when(first == "2", "wording").when(first == "3", "visual").otherwise("spoken").alias("category"),
                     F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("s"), F.pmod("o_orderkey", F.lit(97)) + i)).alias("segment_ids"))
    i = table(spark, sf, "lineitem")
    made = i.select("l_orderkey", F.when(F.col("l_returnflag") == "A", "accept").otherwise("reject").alias("decision"), F.concat(F.lit("r"), "l_suppkey").alias("reviewer"), F.when(F.col("l_tax") > 0.02, F.concat(F.lit("text "), "l_suppkey")).alias("replacement"),
                    F.when(F.col("l_discount") > 0, "why").otherwise(" ").alias("rationale"), ((F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.pmod((F.col("l_quantity") * 10).cast("long"), F.lit(1000))).cast("decimal(38,0)") * 100_000 + F.col("l_suppkey")).alias("ordinal"))
    decided = made.join(items.select("project", F.col("review_id").alias("l_orderkey")), "l_orderkey").withColumnRenamed("l_orderkey", "review_id")
    return items, decided


@query(f"with {_REVIEW} select q.project, q.review_id, category, decision, reviewer, nullif(replacement, '') as replacement from q left join x using (review_id)".replace("ordinal * 100000", "ordinal::hugeint * 100000"))
def review_queue(spark, sf):
    """list_review_items and apply_review: the latest valid decision of each item."""
    return K.review_queue(*reviews(spark, sf)).select("project", "review_id", "category", "decision", "reviewer", "replacement")


@query(f"""with {_REVIEW}, f as (select project, 's' || (review_id % 97 + 1) as segment_id, nullif(replacement, '') as replacement, review_id from q join x using (review_id) where category in ('transcript', 'wording', 'spoken') and parts <= 1), g as (select project, segment_id, arg_max(replacement, review_id) as text from f where replacement is not null group by 1, 2),
s as (select p as project, 's' || i as segment_id from range(0, 50) a(p), range(1, 100) b(i)) select s.project, s.segment_id, coalesce(g.text, 'old') as text, case when g.text is not null then 'human_reviewed' else 'unverified' end as verification_status from s left join g using (project, segment_id)""".replace("ordinal * 100000", "ordinal::hugeint * 100000"))
def corrected_segments(spark, sf):
    """apply_review: text corrections of exactly one segment."""
    segments = spark.range(50).select(F.col("id").alias("project"), F.explode(F.sequence(F.lit(1), F.lit(99))).alias("i")).select("project", F.concat(F.lit("s"), "i").alias("segment_id"), F.lit("old").alias("human_verified_text"), F.lit("unverified").alias("verification_status"))
    return K.corrected_segments(segments, K.review_queue(*reviews(spark, sf))).select("project", "segment_id", F.col("human_verified_text").alias("text"), "verification_status")


@query("""with d as (select doc_id, coalesce(text, '') as text, substr(coalesce(text, ''), 1, 30) as a, substr(coalesce(text, ''), 40, 25) as b from documents), n as (select *, (length(text) - length(replace(text, a, ''))) / greatest(length(a), 1) as na, case when length(b) > 0 then (length(text) - length(replace(text, b, ''))) / length(b) else 0 end as nb, case when a <> '' then instr(text, a) else 0 end as pa, case when b <> '' then instr(text, b) else 0 end as pb from d)
select doc_id, (case when na = 1 then 1 else 0 end + case when nb = 1 then 1 else 0 end)::int as spoken_matches, pa > 0 and pb > 0 and pa <= pb as in_order, (case when contains(text, 'e') then 1 else 0 end + case when contains(text, 'qqqz') then 1 else 0 end)::int as token_matches from n""")
def fixture_checks(spark, sf):
    """validate_fixture_output: expected sentences exactly once and in order, tokens contained."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.array(F.substring("text", 1, 30), F.substring("text", 40, 25)).alias("expected_spoken"), F.array(F.lit("e"), F.lit("qqqz")).alias("expected_tokens"))
    return E.fixture_checks(d).select("doc_id", "spoken_matches", "in_order", "token_matches")


_CASES = """b as (select o_orderkey as case_id, (o_orderkey % 5)::int as spoken, (o_orderkey % 3)::int as tokens, case when o_orderkey % 4 = 0 then null else 2 end::int as events, case when o_orderkey % 6 = 0 then null else o_totalprice / 1000 end as baseline_seconds from orders),
r as (select o_orderkey as case_id, o_orderkey % 11 <> 0 as valid, (o_orderkey % 5 - case when o_orderkey % 13 = 0 then 1 else 0 end)::int as spoken_count, (o_orderkey % 3)::int as token_count, (o_orderkey % 5 - case when o_orderkey % 17 = 0 then 1 else 0 end)::int as spoken_matches, (o_orderkey % 3)::int as token_matches, (o_orderkey % 6)::int as events_seen, case when o_orderkey % 7 = 0 then o_totalprice / 1000 * 1.2 end as median_seconds, case when o_orderkey % 9 <> 0 then o_totalprice / 1000 * 1.1 end as elapsed_seconds from orders where o_orderkey % 10 <> 9),
e as (select b.case_id, case when r.case_id is null then ['no evaluator result was produced'] else list_sort(list_filter([case when not valid then 'production output validation failed' end, case when spoken_count is distinct from spoken then 'expected_spoken_count' end, case when spoken_matches < spoken then 'spoken_matches' end, case when events_seen < events then 'visual_event_count' end], lambda x: x is not null)) end as errors,
 case when r.case_id is null then 'missing' when baseline_seconds is null then 'not_compared' when coalesce(median_seconds, elapsed_seconds) is null then 'unavailable' else 'compared' end as status, case when baseline_seconds is not null then coalesce(median_seconds, elapsed_seconds) / baseline_seconds - 1 end as reg from b left join r using (case_id))"""


def cases(spark, sf):
    k = F.col("o_orderkey")
    m = lambda n: F.pmod(k, F.lit(n)).cast("int")
    o = table(spark, sf, "orders")
    base = o.select(k.alias("case_id"), m(5).alias("spoken"), m(3).alias("tokens"), F.when(m(4) != 0, 2).alias("events"), F.when(m(6) != 0, F.col("o_totalprice") / 1000).alias("baseline_seconds"))
    seen = o.where(m(10) != 9).select(k.alias("case_id"), (m(11) != 0).alias("production_valid"), (m(5) - (m(13) == 0).cast("int")).alias("spoken_count"), m(3).alias("token_count"), (m(5) - (m(17) == 0).cast("int")).alias("spoken_matches"), m(3).alias("token_matches"), m(6).alias("events_seen"),
                                       F.when(m(7) == 0, F.col("o_totalprice") / 1000 * 1.2).alias("median_seconds"), F.when(m(9) != 0, F.col("o_totalprice") / 1000 * 1.1).alias("elapsed_seconds"))
    return E.evaluate_cases(base, seen)


@query(f"with {_CASES} select case_id, len(errors) = 0 as quality_pass, array_to_string(errors, ',') as errors, status, case when status in ('missing', 'unavailable') then false when status = 'compared' then reg <= 0.15 end as passed, case when status = 'compared' then round(reg, 6)::double end as regression from e")
def evaluate_reports(spark, sf):
    """evaluate_reports, _performance_comparison, _current_elapsed."""
    return cases(spark, sf).withColumn("errors", F.array_join("errors", ","))


@query(f"with {_CASES}, f as (select *, case when status in ('missing', 'unavailable') then false when status = 'compared' then reg <= 0.15 end as passed, len(errors) = 0 as q from e) select bool_and(q) as quality_pass, case when bool_or(passed = false) then false when count_if(status = 'compared') > 0 then true end as performance_pass, bool_and(q) and coalesce(case when bool_or(passed = false) then false when count_if(status = 'compared') > 0 then true end, true) as gate_pass from f")
def corpus_gate(spark, sf):
    """The gate of evaluate_reports."""
    return E.gate(cases(spark, sf))


_POLICY = {"workload_id": "EUROPE", "min_media_duration_s": 20, "contract": "O", "max_elapsed_seconds": 200.0, "max_p95_seconds": 250.0}
_REPORTS = """rp as (select o_orderkey as id, o_custkey % 200 as host, list_filter([case when o_orderpriority <> '1-URGENT' then 'workload_id mismatch' end, case when o_orderkey % 8 = 0 then 'cache_reused must be false' end, case when o_orderstatus = 'P' then 'validation_valid must be true' end, case when o_orderkey % 5 = 0 then 'missing quality.media_duration_ms' end,
 case when o_orderkey % 5 <> 0 and o_totalprice < 20000 then 'media duration is below policy minimum' end, case when o_orderstatus <> 'O' then 'quality_contract_sha256 mismatch' end, case when o_orderkey % 7 = 0 then 'missing elapsed_seconds' end, case when o_orderkey % 7 <> 0 and o_totalprice / 1000 > 200 then 'elapsed_seconds exceeds policy target' end, case when o_totalprice / 1000 > 250 then 'timing_summary.p95_seconds exceeds policy target' end], lambda x: x is not null) as reasons, case when o_orderkey % 50 <> 0 then o_custkey % 3 end as cpu, o_orderstatus as os from orders)"""


def policy_reports(spark, sf):
    k = F.col("o_orderkey")
    seconds = F.col("o_totalprice") / 1000
    report = {"workload_id": F.when(F.col("o_orderpriority") == "1-URGENT", "EUROPE").otherwise("x"), "cache_reused": F.pmod(k, F.lit(8)) == 0, "validation_valid": F.col("o_orderstatus") != "P", "media_duration_ms": F.when(F.pmod(k, F.lit(5)) != 0, F.col("o_totalprice")), "contract": F.col("o_orderstatus"),
              "elapsed_seconds": F.when(F.pmod(k, F.lit(7)) != 0, seconds), "p95_seconds": seconds}
    return table(spark, sf, "orders").select(k.alias("id"), F.pmod("o_custkey", F.lit(200)).alias("host"), E.policy_reasons(report, _POLICY).alias("reasons"), F.when(F.pmod(k, F.lit(50)) != 0, F.pmod("o_custkey", F.lit(3))).alias("cpu"), F.col("o_orderstatus").alias("os"))


@query(f"with {_REPORTS} select id, array_to_string(reasons, ',') as reasons from rp")
def policy_check(spark, sf):
    """evaluate_report of owner policies."""
    return policy_reports(spark, sf).select("id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""with {_REPORTS}, f as (select host, 'cpu' as field, case when count_if(cpu is null) > 0 then 'missing' when min(cpu) <> max(cpu) then 'not identical' end as reason from rp group by 1 union all select host, 'os', case when min(os) <> max(os) then 'not identical' end from rp group by 1),
v as (select host, count(*) as reports, sum(len(reasons)) as n from rp group by 1) select v.host, reports, case when n > 0 or reports < 2 or exists (select 1 from f where f.host = v.host and reason is not null) then 'rejected' else 'qualified' end as verdict, (select string_agg(field || ' ' || reason, ',' order by field) from f where f.host = v.host and reason is not null) as together from v""")
def qualification(spark, sf):
    """_fingerprint_reasons and evaluate_files."""
    r = policy_reports(spark, sf)
    f = E.fingerprints(r, "host", ["cpu", "os"])
    together = f.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "field", "reason"))), ",").alias("together"))
    return E.verdicts(r, f, "host", 2).join(together, "host", "left")


@query("""with m as (select 'c' || (p_partkey % 180) as case_id, case when p_partkey % 6 = 0 then 'xyz' else sha256(p_name) end as h, case p_size % 4 when 0 then 'covered' when 1 then 'planned' when 2 then 'blocked' else 'other' end as s from part)
select 'duplicate case id' as error, case_id from m group by 2 having count(*) > 1 union all select 'malformed sha256', case_id from m where h = 'xyz' union all select 'unknown coverage status', case_id from m where s = 'other' union all select 'unknown case', x from (select 'c' || unnest(range(170, 190)) as x) where x not in (select case_id from m)""")
def manifest_errors(spark, sf):
    """validate_manifest: repeated ids, hashes, coverage, cross references."""
    size = F.pmod("p_size", F.lit(4))
    m = table(spark, sf, "part").select(F.concat(F.lit("c"), F.pmod("p_partkey", F.lit(180))).alias("case_id"), F.when(F.pmod("p_partkey", F.lit(6)) == 0, "xyz").otherwise(F.sha2("p_name", 256)).alias("media_sha256"), F.when(size == 0, "covered").when(size == 1, "planned").when(size == 2, "blocked").otherwise("other").alias("coverage"))
    return E.manifest_errors(m, spark.range(170, 190).select(F.concat(F.lit("c"), "id").alias("case_id")))
