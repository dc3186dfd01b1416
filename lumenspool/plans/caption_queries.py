"""Registered queries of caption validation and candidate ranking, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspool.operators import captions
from lumenspool.plans.catalog import ISEG
from lumenspool.plans.registry import query
from lumenspool.sources import adapters as A

# Cues with every kind of fault, their media's durations, and speech: of equal number and drifting in every fourth media.
FAULTS = ISEG.replace("segments as (", "iseg2 as (") + """, segments as (select media_id, source_order, case when (media_id + source_order) % 17 = 0 then raw_text || ' Ã©' when (media_id + source_order) % 19 = 0 then 'call 555?? now' else raw_text end as raw_text,
 case when (media_id + source_order) % 23 = 0 then null else start_ms end as start_ms, case when (media_id + source_order) % 29 = 0 then start_ms - 5 else end_ms end as end_ms, case when (media_id + source_order) % 5 = 0 then 'en' else 'tl' end as language from iseg2),
media as (select media_id, greatest(max(end_ms) - 2000, 1) as duration_ms from segments group by 1),
speech as (select media_id, start_ms + case when media_id % 4 = 0 then source_order * 700 else 300 end as start_ms, start_ms + case when media_id % 4 = 0 then source_order * 700 else 300 end + greatest(200, end_ms - start_ms) as end_ms from segments where start_ms >= 0 and end_ms > start_ms and (media_id % 4 = 0 or (media_id + source_order) % 5 <> 0))"""


def faulty(spark, sf):
    """(segments, media, speech) as in FAULTS."""
    k = F.col("media_id") + F.col("source_order")
    every = lambda n: F.pmod(k, F.lit(n)) == 0
    s = A.issue_segments(spark, sf).select(
        "media_id", "source_order", F.when(every(17), F.concat("raw_text", F.lit(" Ã©"))).when(every(19), "call 555?? now").otherwise(F.col("raw_text")).alias("raw_text"),
        F.when(~every(23), F.col("start_ms")).alias("start_ms"), F.when(every(29), F.col("start_ms") - 5).otherwise(F.col("end_ms")).alias("end_ms"), F.when(every(5), "en").otherwise("tl").alias("language"))
    media = s.groupBy("media_id").agg(F.greatest(F.max("end_ms") - 2000, F.lit(1).cast("long")).alias("duration_ms"))
    shift = F.when(F.pmod("media_id", F.lit(4)) == 0, F.col("source_order") * 700).otherwise(F.lit(300).cast("long"))
    speech = s.where("start_ms >= 0 and end_ms > start_ms").where((F.pmod("media_id", F.lit(4)) == 0) | ~every(5))
    speech = speech.select("media_id", (F.col("start_ms") + shift).alias("start_ms"), (F.col("start_ms") + shift + F.greatest(F.lit(200), F.col("end_ms") - F.col("start_ms"))).alias("end_ms"))
    return s, media, speech


_CAUTION = "(?i)\\b[0-9]+(?:[.,:][0-9]+)*(?:%|mg|kg|cm|mm|ml|gb|mb|kb)?\\b|https?://\\S+|\\b\\S+@\\S+\\.\\S+\\b|(?:^|\\s)--?[A-Za-z][\\p{L}\\p{N}_-]*|(?:[A-Za-z]:[\\\\/]|/)\\S+"
_UNION = """{name}0 as (select media_id, greatest(start_ms, 0) as s, greatest(end_ms, 0) as e from {source} where greatest(end_ms, 0) > greatest(start_ms, 0)), {name}1 as (select *, max(e) over (partition by media_id order by s, e rows between unbounded preceding and 1 preceding) as r from {name}0),
{name}2 as (select *, sum(case when r is null or s > r + 1 then 1 else 0 end) over (partition by media_id order by s, e rows between unbounded preceding and current row) as k from {name}1), {name} as (select media_id, min(s) as s, max(e) as e from {name}2 group by media_id, k)"""
ISSUES = FAULTS + f""", n as (select s.*, duration_ms, lower(trim(regexp_replace(raw_text, '\\s+', ' ', 'g'))) as norm, coalesce(start_ms >= 0 and end_ms > start_ms, false) as valid from segments s join media using (media_id)),
v as (select *, lag(end_ms) over t as pe, lag(start_ms) over (partition by media_id order by source_order) as ps from n where valid window t as (partition by media_id order by start_ms, end_ms, source_order)),
d as (select *, lag(norm, 1) over t as n1, lag(norm, 2) over t as n2, lag(norm, 3) over t as n3, lag(start_ms, 1) over t as s1, lag(start_ms, 2) over t as s2, lag(start_ms, 3) over t as s3, lag(end_ms, 1) over t as e1, lag(end_ms, 2) over t as e2, lag(end_ms, 3) over t as e3 from v window t as (partition by media_id order by start_ms, end_ms, source_order)),
o as (select *, row_number() over (partition by media_id order by source_order) - 1 as i, count(*) over (partition by media_id) as cnt from n),
{_UNION.format(name="sm", source="speech")}, {_UNION.format(name="cm", source="v")},
cov as (select sm.media_id, sm.s, sm.e, coalesce(sum(least(sm.e, cm.e) - greatest(sm.s, cm.s)) filter (cm.s is not null), 0) as covered from sm left join cm on cm.media_id = sm.media_id and cm.s < sm.e and sm.s < cm.e group by 1, 2, 3),
zc as (select media_id, start_ms, end_ms, row_number() over (partition by media_id order by start_ms, end_ms, source_order) as p, count(*) over (partition by media_id) as c from v), zs as (select media_id, start_ms, row_number() over (partition by media_id order by start_ms, end_ms) as p, count(*) over (partition by media_id) as c from speech),
issues as (
 select media_id, 'encoding_corruption' as code, 'error' as severity, start_ms, end_ms from n where regexp_matches(raw_text, '�|Ã.|Â.|â€|ðŸ')
 union all select media_id, 'placeholder', 'warning', start_ms, end_ms from n where trim(raw_text) = '' or regexp_matches(raw_text, '^\\s*[.·…_-]{{2,}}\\s*$')
 union all select media_id, 'broken_boundary', 'error', start_ms, end_ms from n where (start_ms is null) <> (end_ms is null)
 union all select media_id, 'invalid_range', 'error', greatest(start_ms, 0), greatest(greatest(start_ms, 0) + 1, end_ms) from n where not valid and start_ms is not null and end_ms is not null
 union all select media_id, 'non_monotonic', 'error', start_ms, end_ms from v where start_ms < ps
 union all select media_id, 'duration_mismatch', 'error', start_ms, end_ms from v where start_ms >= duration_ms or end_ms > duration_ms + 250
 union all select media_id, 'reading_rate', 'warning', start_ms, end_ms from v where len(regexp_extract_all(raw_text, '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)?')) * 1000.0 / (end_ms - start_ms) > 6 or length(regexp_replace(raw_text, '\\s', '', 'g')) * 1000.0 / (end_ms - start_ms) > 30
 union all select media_id, 'language_mismatch', 'warning', start_ms, end_ms from v where language <> 'tl'
 union all select media_id, 'suspicious_high_impact_token', 'error', start_ms, end_ms from v where regexp_matches(raw_text, '{_CAUTION}') and regexp_matches(raw_text, '\\?{{2,}}|�|(?i)\\[uncertain')
 union all select media_id, 'overlap', 'warning', start_ms, least(end_ms, pe) from v where start_ms < pe - 80
 union all select media_id, 'long_gap', 'warning', pe, start_ms from v where start_ms - pe > 15000
 union all select media_id, 'duplicate', 'warning', least(start_ms, case when n3 = norm then s3 when n2 = norm then s2 else s1 end), greatest(end_ms, case when n3 = norm then e3 when n2 = norm then e2 else e1 end) from d where norm <> '' and (coalesce(n1 = norm, false) or coalesce(n2 = norm, false) or coalesce(n3 = norm, false))
 union all select a.media_id, 'hallucination_loop', 'error', (select min(start_ms) from o x where x.media_id = a.media_id and x.i between a.i and a.i + 2 * w.width - 1), (select max(end_ms) from o x where x.media_id = a.media_id and x.i between a.i and a.i + 2 * w.width - 1) from o a, (values (2), (3), (4), (5)) w(width)
  where w.width < least(6, a.cnt // 2 + 1) and (select count(*) from o x join o y on y.media_id = x.media_id and y.i = x.i + w.width where x.media_id = a.media_id and x.i between a.i and a.i + w.width - 1 and x.norm = y.norm and x.norm <> '') = w.width
 union all select media_id, 'drift', 'error', min(zc.start_ms), max_by(zc.end_ms, zc.p) from zc join zs using (media_id, p) where zc.c = zs.c and zc.c >= 2 group by media_id having max(zc.start_ms - zs.start_ms) - min(zc.start_ms - zs.start_ms) > 1000
 union all select media_id, 'missing_speech', 'error', s, e from cov where (e - s) * 0.35 > covered
 union all select media_id, 'speech_activity_mismatch', 'error', null, null from cov group by media_id having sum(covered) / sum(e - s) < 0.65)"""
REPORT = ISSUES + """, c as (select media_id, count(*) as segment_count, count_if(valid)::bigint as timed_segment_count from n group by 1),
q as (select media_id, count(*) as issue_count, count_if(code = 'placeholder')::bigint as placeholder_count, count_if(code = 'duplicate')::bigint as duplicate_count, count_if(code = 'overlap')::bigint as overlap_count, count_if(code in ('encoding_corruption', 'invalid_range', 'speech_activity_mismatch')) as fatal,
 count_if(severity = 'warning') * 0.08::double + count_if(severity = 'error') * 0.22::double as penalty from issues group by 1),
p as (select c.*, coalesce(issue_count, 0) as issue_count, coalesce(placeholder_count, 0) as placeholder_count, coalesce(duplicate_count, 0) as duplicate_count, coalesce(overlap_count, 0) as overlap_count, coalesce(fatal, 0) as fatal, greatest(0.0::double, least(1.0::double, 1 - coalesce(penalty, 0.0) / sqrt(segment_count))) as score from c left join q using (media_id)),
report as (select media_id, segment_count, timed_segment_count, issue_count, placeholder_count, duplicate_count, overlap_count, (select round(sum(covered) / sum(e - s), 6) from cov where cov.media_id = p.media_id) as speech_coverage, round(score, 6) as quality_score, placeholder_count < segment_count and score >= 0.35 and not (fatal > 0 and score < 0.6) as usable from p)"""


@query(f"with {ISSUES} select media_id, code, severity, start_ms::bigint as start_ms, end_ms::bigint as end_ms from issues")
def validation_issues(spark, sf):
    """Every rule of validate_segments, with drift, missing speech, speech and duration mismatch."""
    s, media, speech = faulty(spark, sf)
    return captions.issues(s, media, speech, "fil").drop("source_order")


@query(f"with {REPORT} select * from report")
def validation_report(spark, sf):
    s, media, speech = faulty(spark, sf)
    return captions.report(s, captions.issues(s, media, speech, "fil"), speech)


_BAD = _UNION.format(name="bad", source="(select * from issues where start_ms is not null and end_ms > start_ms)")
_GOOD = """g as (select media_id, s, e, max(e) over (partition by media_id order by s, e rows between unbounded preceding and 1 preceding) as r, duration_ms from (select media_id, s, e from bad union all select media_id, duration_ms, duration_ms from media) join media using (media_id)), good as (select media_id, greatest(coalesce(r, 0), 0) as s, s as e from g where s > greatest(coalesce(r, 0), 0))"""


@query(f"""with {ISSUES}, {_BAD}, {_GOOD} select media_id, s as start_ms, e as end_ms, true as reliable, '' as codes from good
union all select bad.media_id, s, e, false, array_to_string(list_sort(list_distinct(list(code))), ',') from bad join issues i on i.media_id = bad.media_id and i.start_ms < bad.e and bad.s < i.end_ms group by 1, 2, 3""")
def interval_diagnostics(spark, sf):
    s, media, speech = faulty(spark, sf)
    return captions.diagnostics(s, captions.issues(s, media, speech, "fil"), media).withColumn("codes", F.array_join("codes", ","))


_KIND = "case media_id % 7 when 0 then 'user_human_transcript' when 1 then 'provided subtitle' when 2 then 'Embedded-Subtitle' when 3 then 'creator_caption' when 4 then 'auto caption' when 5 then 'whisper' else 'other' end"
_PRIORITY = "case media_id % 7 when 0 then 7 when 1 then 6 when 2 then 5 when 3 then 4 when 4 then case when human then 3 else 2 end when 5 then case when human then 3 else 1 end else 0 end"
RANKED = REPORT + f""", ranked as (select *, row_number() over (partition by work order by score desc, priority desc, candidate_id)::int as rank from (select media_id // 5 as work, media_id as candidate_id, usable, {_PRIORITY} as priority,
 round(greatest(0.0::double, least(1.0::double, (quality_score * 0.62::double + {_PRIORITY} / 7 * 0.20::double + coalesce(timed_segment_count / segment_count, 0) * 0.08::double + least(1.0, greatest(0.0, coalesce(speech_coverage, 0.75)))::double * 0.10::double) * case when usable then 1.0::double else 0.35::double end)), 6) as score from (select *, media_id % 2 = 0 as human from report)))"""


def candidates(spark, sf):
    """Candidates of a work: every five media are transcripts of one."""
    return A.issue_segments(spark, sf).select("media_id").distinct().select(
        F.floor(F.col("media_id") / 5).alias("work"), F.col("media_id").alias("candidate_id"), F.expr(_KIND).alias("source_type"), (F.pmod("media_id", F.lit(2)) == 0).alias("human_authored"))


def _ranked(spark, sf):
    s, media, speech = faulty(spark, sf)
    reports = captions.report(s, captions.issues(s, media, speech, "fil"), speech).withColumnRenamed("media_id", "candidate_id")
    return captions.rank_candidates(candidates(spark, sf).withColumnRenamed("work", "media_id"), reports).withColumnRenamed("media_id", "work")


@query(f"with {RANKED} select work, candidate_id, score, priority, rank from ranked")
def rank_candidates(spark, sf):
    return _ranked(spark, sf).select("work", "candidate_id", "score", "priority", "rank")


@query(f"with {RANKED} select work, candidate_id, rank from (select *, min(rank) over (partition by work) as best from ranked where usable) where rank = best")
def select_candidate(spark, sf):
    return captions.select_candidate(_ranked(spark, sf).withColumnRenamed("work", "media_id")).select(F.col("media_id").alias("work"), "candidate_id", "rank")
