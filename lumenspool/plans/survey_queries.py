"""Registered queries of survey candidates, profiles, frame protections and cadences, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspool.functions import timing as M
from lumenspool.operators import survey as V
from lumenspool.plans.catalog import SIG
from lumenspool.plans.registry import query
from lumenspool.sources import adapters as A
from lumenspool.sources.adapters import table

MEASURED = SIG + """, m as (select *, value / 1000 as frame_difference, (event_id % 29) / 100 as perceptual_change, (event_id % 53) / 100 as motion, (event_id % 10) / 10 as blur from signals), media as (select media_id, max(actual_ms) + 1 as duration_ms from signals group by 1)"""
# Reasons of a measured signal, in order, and their strengths.
CANDS = MEASURED + """, md as (select media_id, median(greatest(frame_difference, 0)) as med from m group by 1), lim as (select m.media_id, greatest(0.04, any_value(med) + 2.5 * median(abs(greatest(frame_difference, 0) - med))) as lim from m join md using (media_id) group by 1),
l as (select m.*, lim, lag(event_type) over w as pe, lag(blur) over w as pb from m join lim using (media_id) window w as (partition by media_id order by actual_ms, event_id)),
c as (select *, list_filter([case when frame_difference >= lim then 'adaptive_frame_difference' end, case when perceptual_change >= 0.10 then 'perceptual_change' end, case when motion >= 0.35 then 'motion_change' end, case when pe <> event_type then 'ocr_change' end, case when pb >= 0.5 and blur <= 0.2 then 'post_motion_stable' end], lambda x: x is not null) as reasons,
 greatest(case when frame_difference >= lim then least(1.0, frame_difference) else 0 end, case when perceptual_change >= 0.10 then perceptual_change else 0 end, case when motion >= 0.35 then motion else 0 end, case when pe <> event_type then 1.0 else 0 end, case when pb >= 0.5 and blur <= 0.2 then 0.7 else 0 end)::double as score from l),
cands as (select *, 'VC' || lpad((row_number() over (partition by media_id order by actual_ms, event_id))::varchar, 6, '0') as candidate_id from c where len(reasons) > 0)"""
WEIGHTS = "list_max(list_transform(reasons, lambda r: case r when 'scene_cut' then 0.98 when 'ocr_change' then 0.98 when 'perceptual_change' then 0.90 when 'adaptive_frame_difference' then 0.88 when 'motion_change' then 0.72 when 'post_motion_stable' then 0.70 when 'deictic_speech_reference' then 0.76 when 'chapter_boundary' then 0.74 when 'periodic_safety' then 0.25 else 0.0 end))"


def measured(spark, sf):
    e = F.col("event_id")
    share = lambda n, k: F.pmod(e, F.lit(n)) / k
    return A.signals(spark, sf).select("media_id", "event_id", "actual_ms", (F.col("value") / 1000).alias("frame_difference"), share(29, 100).alias("perceptual_change"), share(53, 100).alias("motion"), share(10, 10).alias("blur"), F.col("event_type").alias("ocr_text"))


def media(spark, sf):
    return A.signals(spark, sf).groupBy("media_id").agg((F.max("actual_ms") + 1).alias("duration_ms"))


@query(f"with {CANDS} select media_id, event_id, candidate_id, array_to_string(reasons, ',') as reasons, round(score, 6) as score from cands")
def adaptive_signal_candidates(spark, sf):
    return V.signal_candidates(measured(spark, sf), "media_id", "event_id").select("media_id", "event_id", "candidate_id", F.array_join("reasons", ",").alias("reasons"), F.round("score", 6).alias("score"))


_CONTEXT = SIG + """, ctx as (select media_id, actual_ms as t, 'chapter_boundary' as reason, 0.65 as score from signals where event_type = 'error' union all select media_id, actual_ms, 'deictic_speech_reference', 0.75 from signals where event_type = 'signup')"""


def context(spark, sf):
    s = A.signals(spark, sf).withColumnRenamed("actual_ms", "time_ms")
    return s.where("event_type = 'error'"), s.where("event_type = 'signup'")


@query(f"with {_CONTEXT} select media_id, 'VC' || lpad((row_number() over (partition by media_id order by t, reason, score))::varchar, 6, '0') as candidate_id, t as requested_ms, reason, score::double as score from ctx")
def contextual_candidates(spark, sf):
    return V.context_candidates(*context(spark, sf), "media_id").select("media_id", "candidate_id", "requested_ms", F.col("reasons")[0].alias("reason"), "score")


_PERIODIC = """p0 as (select k, d, list_transform(range(0, greatest(d, 1), 30000), lambda x: x::bigint) as ts from dur), p1 as (select k, d, case when d - ts[-1] > 30000 then list_append(ts, d - 1) else ts end as ts from p0),
p2 as (select k, d, case when d > 0 and d - ts[-1] < 250 then list_distinct(list_append(list_filter(ts, lambda t: t <= greatest(d - 250, 0)), greatest(d - 250, 0))) else ts end as ts from p1), periodic as (select k, unnest(list_sort(ts)) as t from p2)"""


@query(f"""with dur as (select o_orderkey as k, (o_totalprice * 7)::bigint % 400000 as d from orders), {_PERIODIC} select k, t, 'VC' || lpad((row_number() over (partition by k order by t))::varchar, 6, '0') as candidate_id from periodic""")
def periodic_candidates(spark, sf):
    """periodic_candidate_times and periodic_candidates, with the guard at the end."""
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.pmod(F.rint(F.col("o_totalprice") * 7).cast("long"), F.lit(400000)).alias("duration_ms"))
    return V.periodic_candidates(d, "k").select("k", F.col("requested_ms").alias("t"), "candidate_id")


_ALL = CANDS + """, dur as (select media_id as k, duration_ms as d from media), """ + _PERIODIC + """, every as (select media_id, actual_ms as requested_ms, actual_ms, reasons, score, 0 as source from cands union all select k, t, null, ['periodic_safety'], 0.25, 1 from periodic
 union all select media_id, actual_ms, null, ['chapter_boundary'], 0.65, 2 from signals where event_type = 'error' union all select media_id, actual_ms, null, ['deictic_speech_reference'], 0.75, 2 from signals where event_type = 'signup')"""
_MERGED = _ALL + f""", s1 as (select *, coalesce(actual_ms, requested_ms) as t, array_to_string(reasons, ',') as j, greatest({WEIGHTS}, score) as imp, len(list_filter(reasons, lambda r: r not in ('adaptive_frame_difference', 'motion_change'))) = 0 as ad, len(list_filter(reasons, lambda r: r in ('scene_cut', 'ocr_change', 'deictic_speech_reference', 'chapter_boundary'))) > 0 as pr from every),
s2 as (select *, row_number() over w as place, case when t - lag(t) over w <= 250 or (t - lag(t) over w <= 1000 and ad and lag(ad) over w) then 0 else 1 end as n from s1 window w as (partition by media_id order by t, score desc, j, source)),
s3 as (select *, sum(n) over (partition by media_id order by place) as k from s2), s4 as (select *, row_number() over (partition by media_id, k order by (imp >= 0.75 or pr) desc, imp desc, (actual_ms is not null) desc, score desc, place) as pick from s3),
merged as (select media_id, 'VC' || lpad(k::varchar, 6, '0') as candidate_id, max(case when pick = 1 then requested_ms end) as requested_ms, max(case when pick = 1 then actual_ms end) as actual_ms, count(*) as members, list_sort(list_distinct(flatten(list(reasons)))) as reasons, max(score) as score from s4 group by media_id, k)"""


def survey(spark, sf):
    return V.survey(measured(spark, sf), media(spark, sf), *context(spark, sf), "media_id", "event_id")


@query(f"with {_MERGED} select media_id, candidate_id, t, members, array_to_string(reasons, ',') as reasons, round(score, 6) as score from (select *, coalesce(actual_ms, requested_ms) as t from merged)")
def survey_video_candidates(spark, sf):
    """survey_video_candidates: measured, periodic and context candidates, merged. Ties of time between equal candidates only differ in which of them stands for both."""
    return survey(spark, sf).select("media_id", "candidate_id", F.coalesce("actual_ms", "requested_ms").alias("t"), "members", F.array_join("reasons", ",").alias("reasons"), F.round("score", 6).alias("score"))


@query(f"""with {_MERGED}, g as (select m.*, coalesce(actual_ms, requested_ms) as t, greatest({WEIGHTS}, score) as imp, len(list_filter(reasons, lambda r: r in ('scene_cut', 'ocr_change', 'deictic_speech_reference', 'chapter_boundary'))) > 0 as pr from merged m), h as (select *, t - lag(t) over (partition by media_id order by t, candidate_id) as gap from g)
select h.media_id, count(*) as candidates, min(t) as first_ms, max(t) as last_ms, greatest(coalesce(max(gap), 0), min(t), any_value(duration_ms) - max(t)) as max_gap_ms, greatest(coalesce(max(gap), 0), min(t), any_value(duration_ms) - max(t)) <= 30000 as within_limit, count_if(imp >= 0.9)::bigint as very_high, count_if(imp < 0.45)::bigint as low, count_if(imp >= 0.75 or pr)::bigint as protected, count_if(list_contains(reasons, 'ocr_change'))::bigint as ocr_changes from h join media using (media_id) group by 1""")
def survey_receipt(spark, sf):
    """survey_coverage of merged candidates, with head and tail gaps, tiers, reasons and protected ones."""
    c = V.coverage(survey(spark, sf), "media_id", media(spark, sf))
    return c.select("media_id", "candidates", "first_ms", "last_ms", "max_gap_ms", "within_limit", "very_high", "low", "protected", F.coalesce(F.element_at("reason_counts", F.lit("ocr_change")), F.lit(0).cast("long")).alias("ocr_changes"))


METRICS = SIG + """, me as (select media_id, actual_ms as time_ms, (event_id % 101) / 100 as motion, value / 1000 as difference, (event_id % 37) / 100 as edges, event_id % 120 as letters, case when event_id % 3 = 0 then (event_id % 40) / 100 end as face from signals), media as (select media_id, max(actual_ms) + 1 as duration_ms from signals group by 1)"""


def metrics(spark, sf):
    e = F.col("event_id")
    return A.signals(spark, sf).select("media_id", F.col("actual_ms").alias("time_ms"), (F.pmod(e, F.lit(101)) / 100).alias("motion"), (F.col("value") / 1000).alias("frame_difference"), (F.pmod(e, F.lit(37)) / 100).alias("edge_density"),
                                       F.pmod(e, F.lit(120)).alias("ocr_character_count"), F.when(F.pmod(e, F.lit(3)) == 0, F.pmod(e, F.lit(40)) / 100).alias("face_area_ratio"))


@query(f"""with {METRICS}, b as (select media_id, duration_ms, unnest(range(0, (duration_ms - 1) // 60000 + 1)) as k from media), a as (select b.media_id, b.k, any_value(duration_ms) as d, count(time_ms) as n, avg(motion) as motion, avg(difference) as difference, avg(edges) as edges, avg(letters) as letters, coalesce(avg(face), 0.0) as face from b left join me on me.media_id = b.media_id and me.time_ms // 60000 = b.k group by 1, 2),
l as (select *, list_filter([case when letters >= 80 and edges >= 0.08 then {{'l': 'text-heavy-screen', 's': least(1.0, letters / 250 + edges)}} when letters >= 25 then {{'l': 'slides-or-interface', 's': least(1.0, letters / 100)}} end, case when face >= 0.08 and motion < 0.35 then {{'l': 'talking-head-or-interview', 's': least(1.0, face * 4)}} end,
 case when motion >= 0.45 or difference >= 0.3 then {{'l': 'motion-heavy', 's': least(1.0, greatest(motion, difference))}} end, case when motion < 0.08 and difference < 0.04 then {{'l': 'static-visual', 's': 0.8}} end], lambda x: x is not null) as f from a)
select media_id, k * 60000 as start_ms, least(d, (k + 1) * 60000) as end_ms, n, case when n = 0 then 'unknown' when len(f) = 0 then 'mixed-or-unclassified' else array_to_string(list_transform(f, lambda x: x.l), ',') end as labels, round(case when n = 0 then 0.0 when len(f) = 0 then 0.25 else list_max(list_transform(f, lambda x: x.s)) end, 6)::double as confidence from l""")
def video_profile_ranges(spark, sf):
    """profile_video_ranges and _classify, with faces and confidence."""
    return V.profile(media(spark, sf), metrics(spark, sf), "media_id").select("media_id", "start_ms", "end_ms", "n", F.array_join("labels", ",").alias("labels"), F.round("confidence", 6).alias("confidence"))


@query(f"""with {METRICS}, a as (select media_id, avg(motion) as motion from me group by 1), s as (select media_id, count(*) as scenes from signals where event_type = 'error' group by 1), j as (select media_id, motion, coalesce(scenes, 0) as scenes, greatest(duration_ms / 60000, 1 / 60) as minutes from media join a using (media_id) left join s using (media_id))
select media_id, round(motion, 6) as motion, round(scenes / minutes, 6) as scene_density, round(greatest(2.0, 30.0 * (1.0 - 0.6 * least(0.9, least(1.0, greatest(0.0, scenes / minutes / 12.0) + greatest(0.0, motion) * 0.5)))), 6)::double as interval_seconds from j""")
def video_profile(spark, sf):
    """build_video_profile and adaptive_periodic_interval_seconds."""
    scenes = A.signals(spark, sf).where("event_type = 'error'").withColumnRenamed("actual_ms", "time_ms")
    p = V.media_profile(media(spark, sf), metrics(spark, sf), scenes, "media_id")
    return p.select("media_id", *[F.round(c, 6).alias(c) for c in ("motion", "scene_density", "interval_seconds")])


@query(f"""with {SIG}, g as (select *, case when actual_ms - lag(actual_ms) over w < 250 then 1 else 0 end as n from signals window w as (partition by media_id order by actual_ms, event_id)), k as (select *, sum(n) over (partition by media_id order by actual_ms, event_id) as grp from g)
select media_id, grp::bigint as grp, count(*) as n, case when count(*) <= 2 or max(actual_ms) - min(actual_ms) <= 0 then true else count(*) / ((max(actual_ms) - min(actual_ms)) / 1000) <= 4.0 end as exact from k group by media_id, grp""")
def frame_request_groups(spark, sf):
    """_batch_request_groups and _prefer_exact_group."""
    g = V.request_groups(A.signals(spark, sf), "media_id", "actual_ms", "event_id").groupBy("media_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("actual_ms").alias("a"), F.max("actual_ms").alias("b"))
    return g.select("media_id", "grp", "n", F.coalesce(V.prefers_exact(F.col("n"), F.col("a"), F.col("b")), F.lit(True)).alias("exact"))


_ROLE = "case event_id % 6 when 0 then 'before' when 1 then 'action' when 2 then 'context' when 3 then 'result' else null end"
_REASONS = "case event_id % 5 when 0 then ['Scene-cut', 'periodic safety'] when 1 then ['subtitle boundary'] when 2 then ['ocr-change x'] when 3 then ['periodic-safety'] else ['motion'] end"
_REASONS_SPARK = _REASONS.replace("[", "array(").replace("]", ")")


@query(f"""with e as (select event_id, event_type = 'error' as mandatory, event_id % 7 = 0 as small, (event_id % 101) / 100 as imp, {_ROLE} as role, {_REASONS} as reasons from events), r as (select *, replace(lower(array_to_string(reasons, ' ')), '-', '_') as j from e)
select event_id, array_to_string(list_filter([case when mandatory then 'mandatory' end, case when small then 'consequential_change' end, case when imp >= 0.9 then 'very_high_importance' when imp >= 0.75 then 'high_importance' end, case when role in ('before', 'action', 'after', 'result') then 'before_action_after_role' end,
 case when regexp_matches(j, 'chapter|deictic|speech|subtitle|transcript|boundary|meaning') or regexp_matches(j, '(^| )ocr_change( |$)') then 'transcript_or_context_boundary' end, case when contains(j, 'periodic_safety') then 'periodic_coverage' end], lambda x: x is not null), ',') as protections,
 array_to_string(list_sort(list_distinct(string_split(j, ' '))), ',') as tokens from r""")
def frame_protections(spark, sf):
    """_dedup_protected_reasons, _has_transcript_boundary, _reason_tokens."""
    e = table(spark, sf, "events").select("event_id", (F.col("event_type") == "error").alias("mandatory"), (F.pmod("event_id", F.lit(7)) == 0).alias("small"), (F.pmod("event_id", F.lit(101)) / 100).alias("imp"), F.expr(_ROLE).alias("role"), F.expr(_REASONS_SPARK).alias("reasons"))
    p = V.protections(F.col("mandatory"), F.col("small"), F.col("imp"), F.coalesce("role", F.lit("")), F.col("reasons"))
    return e.select("event_id", F.array_join(p, ",").alias("protections"), F.array_join(F.array_sort(V.reason_tokens(F.col("reasons"))), ",").alias("tokens"))


_PAIR = """p as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) as i, (l_quantity::int % 12) as hamming, l_discount / 10 as ratio, l_tax / 10 as mean, (l_partkey % 9) / 1000 as edge, (l_suppkey % 20) / 1000 as region, case when l_linenumber % 3 = 0 then 'a  b' when l_linenumber % 3 = 1 then 'a b ' end as lt, case when l_linenumber % 2 = 0 then ' a b' end as rt,
 case l_linestatus when 'O' then 'before' else 'context' end as lr, case l_returnflag when 'A' then 'after' when 'R' then 'before' end as rr, l_quantity = 7 as c from lineitem)"""


def pairs(spark, sf):
    i = F.expr("row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), i.cast("long").alias("i"), F.pmod(F.col("l_quantity").cast("int"), F.lit(12)).alias("hamming"), (F.col("l_discount") / 10).alias("ratio"), (F.col("l_tax") / 10).alias("mean"), (F.pmod("l_partkey", F.lit(9)) / 1000).alias("edge"),
        (F.pmod("l_suppkey", F.lit(20)) / 1000).alias("region"), F.expr("case when l_linenumber % 3 = 0 then 'a  b' when l_linenumber % 3 = 1 then 'a b ' end").alias("lt"), F.expr("case when l_linenumber % 2 = 0 then ' a b' end").alias("rt"),
        F.when(F.col("l_linestatus") == "O", "before").otherwise("context").alias("lr"), F.when(F.col("l_returnflag") == "A", "after").when(F.col("l_returnflag") == "R", "before").otherwise("").alias("rr"), (F.col("l_quantity") == 7).alias("c"))


@query(f"""with {_PAIR}, n as (select *, trim(regexp_replace(coalesce(lt, ''), '\\s+', ' ', 'g')) as a, trim(regexp_replace(coalesce(rt, ''), '\\s+', ' ', 'g')) as b from p), q as (select *, list_filter([case when a <> b then 'ocr_change' end, case when c then 'consequential_event' end, case when lr = 'before' and rr = 'after' then 'before_action_after_role' end, case when region >= 0.012 or edge >= 0.0025 then 'localized_pixel_or_structure_change' end], lambda x: x is not null) as against from n)
select o, i, a <> b as ocr_changed, array_to_string(against, ',') as protected, hamming <= 5 and ratio <= 0.008 and mean <= 0.006 and len(against) = 0 as is_duplicate, hamming <= 8 and ratio <= 0.05 and mean <= 0.03 and edge <= 0.03 and len(list_filter(against, lambda x: x <> 'localized_pixel_or_structure_change')) = 0 and not c as relaxed from q""")
def duplicate_decisions(spark, sf):
    """deduplication_decision and _low_importance_near_duplicate over measured pairs."""
    p = pairs(spark, sf)
    c = F.col
    p = p.withColumn("d", V.duplicate_decision(c("hamming"), c("ratio"), c("mean"), c("edge"), c("region"), c("lt"), c("rt"), c("lr"), c("rr"), c("c")))
    mine = F.when(c("c"), F.array(F.lit("mandatory"))).otherwise(F.array().cast("array<string>"))
    relaxed = V.relaxed_duplicate(c("hamming"), c("ratio"), c("mean"), c("edge"), c("d.protected"), mine, F.array().cast("array<string>"))
    return p.select("o", "i", c("d.ocr_changed").alias("ocr_changed"), F.array_join("d.protected", ",").alias("protected"), c("d.is_duplicate").alias("is_duplicate"), relaxed.alias("relaxed"))


@query(f"""with {_PAIR}, q as (select *, (o % 1000) as x, (i * 90) as y from p) select o, i, coalesce(a, false) as motion_only from (select o, i, lt is null and not c and lr = 'context' and hamming <= 8 and ratio <= 0.08 and region <= 0.25 and mean <= 0.08 and edge <= 0.12 and i % 6 <= 4 and (x <= 1280 * 0.18 or y <= 720 * 0.18 or x + 100 >= 1280 * 0.82 or y + 50 >= 720 * 0.82) as a from q)""")
def guarded_motion(spark, sf):
    """_is_guarded_motion_only."""
    p = pairs(spark, sf).withColumns({"x": F.pmod("o", F.lit(1000)), "y": F.col("i") * 90})
    c = F.col
    region = F.array(F.struct(c("x"), c("y"), F.lit(100).alias("w"), F.lit(50).alias("h")))
    d = {k: c(k) for k in ("hamming", "ratio", "region", "mean", "edge")}
    return p.select("o", "i", V.guarded_motion(d, region, F.pmod("i", F.lit(6)), c("lt").isNull(), F.concat(F.lit("by "), c("lr")), F.lit(1280), F.lit(720), c("c")).alias("motion_only"))


PARTS = {"relevance": 7, "importance": 11, "proximity": 13, "sharpness": 17, "stability": 19, "novelty": 23, "ocr": 29, "completeness": 31, "transition_risk": 37}
_P = ", ".join(f"((event_id * {p}) % 101) / 100.0::double as {k}" for k, p in PARTS.items())


@query(f"""with p as (select event_id, event_id % 7 = 0 as small, {_ROLE} as role, {_P} from events) select event_id, round(greatest(0.0::double, least(1.0::double, 0.18::double*relevance + 0.17::double*importance + 0.09::double*proximity + 0.12::double*sharpness + 0.09::double*stability + 0.10::double*novelty + 0.09::double*ocr + 0.08::double*completeness
 + case when role in ('before', 'action', 'result') then 0.08 else 0.0 end::double + case when small then 0.10 else 0.0 end::double - 0.12::double*transition_risk)), 6) as score from p""")
def frame_evidence_score(spark, sf):
    """score_candidate of frames, with role and small-change bonuses."""
    e = table(spark, sf, "events").select("event_id", F.expr(_ROLE).alias("role"), (F.pmod("event_id", F.lit(7)) == 0).alias("small"), *[(F.pmod(F.col("event_id") * p, F.lit(101)) / 100).alias(k) for k, p in PARTS.items()])
    return e.select("event_id", F.round(V.frame_score({k: F.col(k) for k in PARTS}, F.coalesce("role", F.lit("")), F.col("small")), 6).alias("score"))


@query(f"""with {SIG}, d as (select media_id, list_sort(list_distinct(list(actual_ms))) as ts from signals group by 1), s as (select media_id, case when len(ts) <= 64 then ts else list_distinct(list_transform(range(0, 64), lambda i: ts[round_even(i * (len(ts) - 1) / 63, 0)::int + 1])) end as ts from d) select media_id, unnest(ts) as t from s""")
def spread_times(spark, sf):
    """_bounded_shared_survey_emission_times."""
    d = A.signals(spark, sf).groupBy("media_id").agg(F.array_sort(F.collect_set("actual_ms")).alias("ts"))
    return d.select("media_id", F.explode(F.transform(M.spread_index(F.size("ts"), 64), lambda i: F.get("ts", i.cast("int")))).alias("t"))


@query(f"""with {SIG}, media as (select media_id, max(actual_ms) - 60000 as duration_ms from signals group by 1), p as (select distinct media_id, least(greatest(case when event_id % 3 = 0 then actual_ms else actual_ms - 7 end, 0), greatest(duration_ms - 1, 0)) as t from signals join media using (media_id)), done as (select distinct media_id, actual_ms as t from signals where event_type = 'view')
select media_id, t from p where not exists (select 1 from done d where d.media_id = p.media_id and d.t = p.t)""")
def warmup_times(spark, sf):
    """_survey_candidate_point and _transcript_independent_warmup_times."""
    s = A.signals(spark, sf)
    m = s.groupBy("media_id").agg((F.max("actual_ms") - 60000).alias("duration_ms"))
    points = s.join(m, "media_id").select("media_id", F.greatest(F.lit(0), M.survey_point(F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("actual_ms")), F.col("actual_ms") - 7, F.greatest(F.col("duration_ms"), F.lit(1)))).alias("t")).distinct()
    return points.join(s.where("event_type = 'view'").select("media_id", F.col("actual_ms").alias("t")), ["media_id", "t"], "left_anti")
