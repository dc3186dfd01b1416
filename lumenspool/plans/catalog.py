"""The registered queries over the star-schema tables and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.functions import columns as C
from lumenspool.functions import text as X
from lumenspool.operators import captions, intervals, selection
from lumenspool.operators.quantiles import quantiles
from lumenspool.plans.registry import ORACLE, QUERIES, query
from lumenspool.sinks.shared import written
from lumenspool.sources import adapters as A
from lumenspool.sources.adapters import table

REBUILD = "(?i)https?://\\S+|\\b[^\\s@]+@[^\\s@]+\\.[^\\s@]+\\b|(?:[A-Za-z]:[\\\\/]|/)\\S+|--?[A-Za-z][\\p{L}\\p{N}_-]*|\\b[0-9]+(?:[.,:][0-9]+)*(?:%|mg|kg|cm|mm|ml|gb|mb|kb)?\\b"
SEG = """seg as (
 select conv_id as media_id, turn as source_order, text as raw_text, case when (conv_id + turn) % 4 < 2 then 'A' else 'B' end as speaker,
  greatest(0, coalesce(sum(400 + 55*length(text) + (conv_id*7919 + turn*104729) % 2600 - 300) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0))::bigint as start_ms, 400 + 55*length(text) as d from conversations),
segments as (select *, start_ms + d as end_ms from seg)"""
ISEG = """iseg0 as (
 select conv_id as media_id, turn as source_order, case when conv_id % 7 = 0 then 'loop line ' || (turn % 2) when (conv_id+turn) % 11 = 0 then '...' when (conv_id+turn) % 13 = 0 then coalesce(lag(text) over (partition by conv_id order by turn), text) else text end as raw_text,
  case when (conv_id+turn) % 3 = 0 then (400 + 55*length(text)) // 4 else 400 + 55*length(text) end as d,
  ((conv_id*7919 + turn*104729) % 2600 - 300) * case when (conv_id+turn) % 7 = 0 then 10 else 1 end as g, (conv_id+turn) % 9 = 0 as back from conversations),
iseg1 as (select *, greatest(0, coalesce(sum(d + g) over (partition by media_id order by source_order rows between unbounded preceding and 1 preceding), 0))::bigint as s from iseg0),
segments as (select media_id, source_order, raw_text, case when back then greatest(0, s - 40000) else s end as start_ms, case when back then greatest(0, s - 40000) else s end + d as end_ms from iseg1)"""
SIG = f"""signals as (select user_id % 10 as media_id, event_id, (epoch_us(ts) // 1000 - {A.EPOCH_MS}) // 1000 as actual_ms, event_type, value from events)"""
IVL = SIG + """, intervals as (select media_id, event_id, actual_ms as start_ms, actual_ms + (1 + event_id % 24) * 500 as end_ms, event_type as label from signals)"""
FLAGS = ISEG + """, n as (select *, lower(trim(regexp_replace(raw_text, '\\s+', ' ', 'g'))) as norm from segments),
flags as (select *,
  trim(raw_text) = '' or regexp_matches(raw_text, '^\\s*[.·…_-]{2,}\\s*$') as placeholder,
  start_ms < lag(start_ms) over (partition by media_id order by source_order) as non_monotonic,
  len(regexp_extract_all(raw_text, '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)?')) * 1000.0 / (end_ms - start_ms) > 6 or length(regexp_replace(raw_text, '\\s', '', 'g')) * 1000.0 / (end_ms - start_ms) > 30 as reading_rate,
  start_ms < lag(end_ms) over t - 80 as overlap, start_ms - lag(end_ms) over t > 15000 as long_gap,
  norm <> '' and (coalesce(norm = lag(norm, 1) over t, false) or coalesce(norm = lag(norm, 2) over t, false) or coalesce(norm = lag(norm, 3) over t, false)) as duplicate
  from n window t as (partition by media_id order by start_ms, end_ms, source_order))"""
LOOPS = """loops as (select a.media_id, w.width, a.source_order as o from n a, (values (2), (3), (4), (5)) w(width)
  join (select media_id, count(*) as cnt from n group by 1) c on true where c.media_id = a.media_id and w.width < least(6, c.cnt // 2 + 1) and a.source_order + 2 * w.width <= c.cnt
  and (select bool_and(x.norm = y.norm and x.norm <> '') from n x join n y on y.media_id = x.media_id and y.source_order = x.source_order + w.width where x.media_id = a.media_id and x.source_order >= a.source_order and x.source_order < a.source_order + w.width))"""


@query(f"with {FLAGS} select media_id, source_order, placeholder, coalesce(non_monotonic, false) as non_monotonic, reading_rate, coalesce(overlap, false) as overlap, coalesce(long_gap, false) as long_gap, duplicate from flags")
def caption_issue_lag(spark, sf):
    return captions.flags(A.issue_segments(spark, sf)).select("media_id", "source_order", "placeholder", "non_monotonic", "reading_rate", "overlap", "long_gap", "duplicate")


@query(f"""with {FLAGS}, {LOOPS}, s as (select media_id, count(*) as segment_count, count_if(placeholder) as p, count_if(placeholder) + count_if(reading_rate) + count_if(overlap) + count_if(long_gap) + count_if(duplicate) as w, count_if(non_monotonic) as e from flags group by 1),
t as (select s.*, coalesce(l.k, 0) as k from s left join (select media_id, count(*) as k from loops group by 1) l using (media_id)),
q as (select *, round(greatest(0.0::double, least(1.0::double, 1.0::double - (w * 0.08::double + (e + k) * 0.22::double) / sqrt(segment_count))), 6) as quality_score from t)
select media_id, segment_count, w + e + k as issue_count, quality_score, p < segment_count and quality_score >= 0.35 as usable, (row_number() over (order by quality_score desc, media_id))::bigint as rank from q""")
def caption_quality_rank(spark, sf):
    q = captions.quality(A.issue_segments(spark, sf)).select("media_id", "segment_count", "issue_count", "quality_score", "usable")
    coarse = [("score", F.floor(F.col("quality_score") * 1000), True), ("block", F.floor(F.col("quality_score") * 1_000_000), True), ("media", F.shiftright("media_id", 16), False)]
    return intervals.ranked(q, coarse, [F.desc("quality_score"), "media_id"])


@query(f"with {FLAGS}, {LOOPS} select media_id, width, o as \"offset\" from loops")
def caption_loops(spark, sf):
    return captions.loops(A.issue_segments(spark, sf)).select("media_id", "width", F.col("offset").cast("long").alias("offset"))


def _union_sql(touch: int) -> str:
    return f"""with {IVL}, r as (select *, max(end_ms) over (partition by media_id order by start_ms, end_ms, event_id rows between unbounded preceding and 1 preceding) as reach from intervals),
i as (select *, sum(case when reach is null or start_ms > reach + {touch} then 1 else 0 end) over (partition by media_id order by start_ms, end_ms, event_id) as k from r)
select media_id, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by media_id, k"""


@query(_union_sql(1))
def interval_union_touching(spark, sf):
    return intervals.union(A.intervals(spark, sf), ["media_id"], 1)


@query(_union_sql(0))
def interval_union_strict(spark, sf):
    return intervals.union(A.intervals(spark, sf), ["media_id"], 0)


@query(f"""with {SEG}, speech as (select media_id, start_ms + 100 as s, end_ms - 100 as e from segments where (media_id + source_order) % 5 <> 0), cues as (select * from segments where (media_id + source_order) % 3 <> 1),
pts as (select media_id, s, e from speech), m0 as (select *, max(e) over (partition by media_id order by s, e rows between unbounded preceding and 1 preceding) as r from pts), m1 as (select *, sum(case when r is null or s > r + 1 then 1 else 0 end) over (partition by media_id order by s, e) as k from m0), m as (select media_id, min(s) as s, max(e) as e from m1 group by media_id, k),
c0 as (select *, max(end_ms) over (partition by media_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as r from cues), c1 as (select *, sum(case when r is null or start_ms > r + 1 then 1 else 0 end) over (partition by media_id order by start_ms, end_ms) as k from c0), c as (select media_id, min(start_ms) as s, max(end_ms) as e from c1 group by media_id, k),
o as (select m.media_id, m.s, m.e, coalesce(sum(case when c.s is not null then least(m.e, c.e) - greatest(m.s, c.s) end), 0) as covered from m left join c on c.media_id = m.media_id and c.s < m.e and m.s < c.e group by 1, 2, 3)
select media_id, sum(e - s)::bigint as speech_ms, sum(covered)::bigint as covered_ms, round(sum(covered) / sum(e - s), 6) as coverage, count_if(covered * 100 < (e - s) * 35)::bigint as missing from o group by 1""")
def speech_coverage(spark, sf):
    s = A.segments(spark, sf)
    k = F.col("media_id") + F.col("source_order")
    speech = s.where(F.pmod(k, F.lit(5)) != 0).select("media_id", (F.col("start_ms") + 100).alias("start_ms"), (F.col("end_ms") - 100).alias("end_ms"))
    return intervals.coverage(s.where(F.pmod(k, F.lit(3)) != 1), speech, "media_id")


RANK = "case label when 'purchase' then 1 when 'click' then 2 when 'signup' then 3 when 'error' then 4 else 5 end"


@query(f"""with {IVL}, p as (select distinct media_id, t from (select media_id, start_ms as t from intervals union all select media_id, end_ms from intervals)), a as (select media_id, t as s, lead(t) over (partition by media_id order by t) as e from p),
w as (select a.media_id, a.s, a.e, min(({RANK}) || label) as b from a join intervals i on i.media_id = a.media_id and i.start_ms <= a.s and i.end_ms >= a.e where a.e is not null group by 1, 2, 3),
f as (select *, case when lag(b) over (partition by media_id order by s) = b and lag(e) over (partition by media_id order by s) = s then 0 else 1 end as n from w), g as (select *, sum(n) over (partition by media_id order by s) as k from f)
select media_id, substr(b, 2) as label, min(s) as start_ms, max(e) as end_ms from g group by media_id, k, b""")
def elementary_interval_winner(spark, sf):
    return intervals.elementary_winners(A.intervals(spark, sf), "media_id", F.expr(RANK))


@query(f"""with {SEG}, {IVL}, t as (select media_id, start_ms as rs, end_ms as re, label as sp, event_id from intervals),
o as (select s.media_id, s.source_order, t.sp, t.event_id, least(s.end_ms, t.re) - greatest(s.start_ms, t.rs) as ov from segments s join t on t.media_id = s.media_id and s.start_ms < t.re and t.rs < s.end_ms),
b as (select *, row_number() over w as rn, lead(ov) over w as second from o window w as (partition by media_id, source_order order by ov desc, event_id))
select s.media_id, s.source_order, b.sp as speaker, b.ov as overlap, coalesce(b.ov - b.second <= 120, false) as ambiguous from segments s join b on b.media_id = s.media_id and b.source_order = s.source_order and b.rn = 1""")
def speaker_overlap_assign(spark, sf):
    turns = A.intervals(spark, sf).select("media_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("label").alias("r_speaker"), F.col("event_id").alias("r_order"))
    out = intervals.assign_speakers(A.segments(spark, sf).drop("speaker"), turns, "media_id")
    return out.where("speaker is not null").select("media_id", "source_order", "speaker", "overlap", "ambiguous")


@query(f"with {SEG}, {IVL} select media_id, event_id, start_ms from intervals i where not exists (select 1 from segments s where s.media_id = i.media_id and s.start_ms < i.end_ms and i.start_ms < s.end_ms)")
def visual_outside_speech(spark, sf):
    right = A.segments(spark, sf).select("media_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return intervals.range_join(A.intervals(spark, sf), right, "media_id", kind="left_anti").select("media_id", "event_id", "start_ms")


@query(f"""with {SEG}, f as (select *, case when lag(speaker) over w = speaker and start_ms - lag(end_ms) over w between 0 and 1500 then 0 else 1 end as n from segments window w as (partition by media_id order by source_order)),
g as (select *, sum(n) over (partition by media_id order by source_order) as k from f) select media_id, speaker, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as members, md5(string_agg(raw_text, chr(10) order by source_order)) as text_md5 from g group by media_id, k, speaker""")
def speaker_sessions(spark, sf):
    return intervals.sessions(A.segments(spark, sf), "media_id").withColumn("text_md5", F.md5("text")).drop("text")


@query(f"""with {SIG}, m as (select media_id, max(actual_ms) // 600000 as last from signals group by 1), c as (select media_id, unnest(range(0, last + 1)) as bucket from m)
select c.media_id, c.bucket, c.bucket * 600000 as start_ms, count(s.event_id) as events from c left join signals s on s.media_id = c.media_id and s.actual_ms // 600000 = c.bucket group by 1, 2""")
def chapters_600s(spark, sf):
    return intervals.buckets(A.signals(spark, sf), "media_id", "actual_ms", 600_000).groupBy("media_id", "bucket", "start_ms").agg(F.count("event_id").alias("events"))


@query(f"""with {SIG}, d as (select media_id, max(actual_ms) + 1 as n from signals group by 1), s as (select media_id, n, unnest(range(0, n, 270000)) as a from d)
select media_id, a as chunk_start, least(a + 300000, n) as chunk_end from s where a = 0 or a + 30000 < n""")
def chunk_ranges(spark, sf):
    d = A.signals(spark, sf).groupBy("media_id").agg((F.max("actual_ms") + 1).alias("duration_ms"))
    return intervals.chunks(d, "media_id", 300_000, 30_000)


@query(f"""with {SIG}, v as (select *, greatest(value / 1000, 0) as x, lag(event_type) over (partition by media_id order by actual_ms, event_id) as prior from signals), b as (select media_id, median(x) as med from v group by 1),
t as (select v.media_id, greatest(0.04, any_value(med) + 2.5 * median(abs(x - med))) as threshold from v join b using (media_id) group by 1)
select media_id, event_id, actual_ms, case when x >= threshold and prior <> event_type then 'adaptive_frame_difference,ocr_change' when x >= threshold then 'adaptive_frame_difference' else 'ocr_change' end as reasons,
 round(case when prior <> event_type then 1.0 else least(1.0, x) end, 6) as score from v join t using (media_id) where x >= threshold or prior <> event_type""")
def mad_candidates(spark, sf):
    w = Window.partitionBy("media_id").orderBy("actual_ms", "event_id")
    v = A.signals(spark, sf).withColumns({"x": F.greatest(F.col("value") / 1000, F.lit(0.0)), "prior": F.lag("event_type").over(w)})
    middle = written(quantiles(v, ["media_id"], "x", {"med": "median"}), "medians")
    away = v.join(middle, "media_id").withColumn("away", F.abs(F.col("x") - F.col("med")))
    spread = written(quantiles(away, ["media_id"], "away", {"mad": "median"}).join(middle, "media_id"), "limits")
    v = v.join(spread, "media_id").withColumns({"far": F.col("x") >= F.greatest(F.lit(0.04), F.col("med") + 2.5 * F.col("mad")), "changed": F.coalesce(F.col("prior") != F.col("event_type"), F.lit(False))})
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("far"), "adaptive_frame_difference"), F.when(F.col("changed"), "ocr_change"))), ",")
    return v.where("far or changed").select("media_id", "event_id", "actual_ms", reasons.alias("reasons"), F.round(F.when(F.col("changed"), 1.0).otherwise(F.least(F.lit(1.0), F.col("x"))), 6).alias("score"))


REASON = "case event_type when 'error' then 'scene_cut' when 'click' then 'motion_change' when 'purchase' then 'perceptual_change' when 'signup' then 'adaptive_frame_difference' else 'periodic_safety' end"
WEIGHT = "case event_type when 'error' then 0.98 when 'click' then 0.72 when 'purchase' then 0.9 when 'signup' then 0.88 else 0.25 end"


def _candidates(spark, sf):
    s = A.signals(spark, sf).withColumn("reason", F.expr(REASON)).withColumn("score", F.least(F.lit(1.0), F.col("value") / 1000))
    s = s.withColumn("importance", C.survey_importance(F.col("reason"), F.col("score")))
    return s.withColumn("protected", (F.col("importance") >= 0.75) | F.col("reason").isin("scene_cut", "ocr_change", "deictic_speech_reference", "chapter_boundary"))


@query(f"""with {SIG}, i as (select event_id, {REASON} as reason, greatest({WEIGHT}::double, least(1.0, value / 1000)) as importance from signals)
select event_id, reason, round(importance, 6) as importance, case when importance >= 0.9 then 'very_high' when importance >= 0.75 then 'high' when importance >= 0.45 then 'supporting' else 'low' end as tier, importance >= 0.75 or reason = 'scene_cut' as protected from i""")
def survey_importance(spark, sf):
    return _candidates(spark, sf).select("event_id", "reason", F.round("importance", 6).alias("importance"), C.tier(F.col("importance")).alias("tier"), "protected")


@query(f"""with {SIG}, i as (select *, {REASON} as reason, least(1.0, value / 1000) as score from signals), j as (select *, greatest({WEIGHT}::double, score) as importance, reason in ('motion_change', 'adaptive_frame_difference') as ad from i),
f as (select *, case when actual_ms - lag(actual_ms) over w <= 250 or (actual_ms - lag(actual_ms) over w <= 1000 and ad and lag(ad) over w) then 0 else 1 end as n from j window w as (partition by media_id order by actual_ms, score desc, reason, event_id)),
g as (select *, sum(n) over (partition by media_id order by actual_ms, score desc, reason, event_id) as k, row_number() over (partition by media_id order by actual_ms, score desc, reason, event_id) as rn from f),
r as (select *, row_number() over (partition by media_id, k order by (importance >= 0.75 or reason = 'scene_cut') desc, importance desc, score desc, rn) as pick from g)
select media_id, k::bigint as cluster, max(case when pick = 1 then event_id end) as event_id, count(*) as members, string_agg(distinct reason, ',' order by reason) as reasons, round(max(score), 6) as score from r group by media_id, k""")
def survey_clusters(spark, sf):
    w = Window.partitionBy("media_id").orderBy("actual_ms", F.desc("score"), "reason", "event_id")
    rows = _candidates(spark, sf).withColumn("adaptive", F.col("reason").isin("motion_change", "adaptive_frame_difference"))
    gap = F.col("actual_ms") - F.lag("actual_ms").over(w)
    rows = rows.withColumns({"new": ~F.coalesce((gap <= 250) | ((gap <= 1000) & F.col("adaptive") & F.lag("adaptive").over(w)), F.lit(False)), "rn": F.row_number().over(w)})
    rows = intervals.islands(rows, ["media_id"], ["actual_ms", F.desc("score"), "reason", "event_id"], F.col("new"), "cluster")
    first = F.max_by("event_id", F.struct("protected", "importance", "score", -F.col("rn")))
    return rows.groupBy("media_id", "cluster").agg(first.alias("event_id"), F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.round(F.max("score"), 6).alias("score"))


@query(f"""with {SIG}, g as (select *, actual_ms - coalesce(lag(actual_ms) over (partition by media_id order by actual_ms, event_id), 0) as gap from signals)
select media_id, count(*) as n, min(actual_ms) as first_ms, max(actual_ms) as last_ms, max(gap) as max_gap_ms, count_if(event_type = 'error')::bigint as cuts, count_if(event_type = 'view')::bigint as periodic from g group by 1""")
def survey_coverage(spark, sf):
    w = Window.partitionBy("media_id").orderBy("actual_ms", "event_id")
    rows = A.signals(spark, sf).withColumn("gap", F.col("actual_ms") - F.coalesce(F.lag("actual_ms").over(w), F.lit(0)))
    return rows.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), F.min("actual_ms").alias("first_ms"), F.max("actual_ms").alias("last_ms"), F.max("gap").alias("max_gap_ms"), F.count_if(F.col("event_type") == "error").alias("cuts"), F.count_if(F.col("event_type") == "view").alias("periodic"))


@query(f"""with {SIG}, m as (select media_id, max(actual_ms) // 60000 as last from signals group by 1), c as (select media_id, unnest(range(0, last + 1)) as bucket from m),
b as (select c.media_id, c.bucket, count(event_id) as n, sum(event_id % 100) / count(event_id) / 100 as motion, sum(cast(round(value * 1000) as bigint)) / count(event_id) / 1000000 as difference, sum(event_id % 37) / count(event_id) / 100 as edges, sum(event_id % 120) / count(event_id) as ocr
 from c left join signals s on s.media_id = c.media_id and s.actual_ms // 60000 = c.bucket group by 1, 2)
select media_id, bucket, n, case when n = 0 then 'unknown' else coalesce(nullif(concat_ws(',', case when ocr >= 80 and edges >= 0.08 then 'text-heavy-screen' when ocr >= 25 then 'slides-or-interface' end,
 case when motion >= 0.45 or difference >= 0.3 then 'motion-heavy' end, case when motion < 0.08 and difference < 0.04 then 'static-visual' end), ''), 'mixed-or-unclassified') end as labels from b""")
def profile_60s(spark, sf):
    b = intervals.buckets(A.signals(spark, sf), "media_id", "actual_ms", 60_000).groupBy("media_id", "bucket")
    mean = lambda e, k: F.try_divide(F.sum(e), F.count("event_id")) / k
    b = b.agg(F.count("event_id").alias("n"), mean(F.pmod("event_id", F.lit(100)), 100).alias("motion"), mean(F.round(F.col("value") * 1000).cast("long"), 1_000_000).alias("difference"), mean(F.pmod("event_id", F.lit(37)), 100).alias("edges"), mean(F.pmod("event_id", F.lit(120)), 1).alias("ocr"))
    labels = F.array_join(F.array_compact(F.array(
        F.when(F.expr("ocr >= 80 and edges >= 0.08"), "text-heavy-screen").when(F.col("ocr") >= 25, "slides-or-interface"),
        F.when(F.expr("motion >= 0.45 or difference >= 0.3"), "motion-heavy"), F.when(F.expr("motion < 0.08 and difference < 0.04"), "static-visual"))), ",")
    return b.select("media_id", "bucket", "n", F.when(F.col("n") == 0, "unknown").otherwise(F.coalesce(F.nullif(labels, F.lit("")), F.lit("mixed-or-unclassified"))).alias("labels"))


@query(f"""with {SIG}, c as (select actual_ms as ms, event_id from signals) select event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) as clock, ms from c""")
def clock_round_trip(spark, sf):
    s = A.signals(spark, sf).select("event_id", C.clock(F.col("actual_ms")).alias("clock"))
    return s.withColumn("ms", C.parse_clock(F.col("clock")))


@query("""select p_partkey, case when p_partkey % 5 = 0 then '_com' || (p_partkey % 9 + 1) || '.txt' else coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(trim('  ' || p_name || '--/ x__.'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[ ._-]+|[ ._-]+$', '', 'g'), '-+', '-', 'g'), 1, 100), ''), 'item') end as slug, regexp_replace(regexp_replace(lower(p_name), '[ \\t\\n]+', '-', 'g'), '[^a-z0-9-]', '', 'g') as anchor,
 'IC' || lpad(p_partkey::varchar, 6, '0') as claim_id, 'M' || upper(substr(sha256(p_name), 1, 16)) as media_id from part""")
def slugs_and_ids(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", C.slug(F.when(F.pmod("p_partkey", F.lit(5)) == 0, F.concat(F.lit("com"), F.pmod("p_partkey", F.lit(9)) + 1, F.lit(".txt"))).otherwise(F.concat(F.lit("  "), n, F.lit("--/ x__."))), "item").alias("slug"), C.anchor(n).alias("anchor"), C.sequential_id("IC", F.col("p_partkey")).alias("claim_id"), C.media_id(n).alias("media_id"))


@query("""select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) as escaped_md5,
 case when regexp_matches(url, '^https?://') then 'remote_media' else 'unsupported' end as kind, regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages""")
def page_escape(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.md5(C.escape_html(F.col("html"))).alias("escaped_md5"), F.when(F.col("url").rlike("^https?://"), "remote_media").otherwise("unsupported").alias("kind"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


@query("""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')) as visible_md5,
 md5(regexp_replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), '[. ]+$', '', 'g')) as claim_md5, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[-''./:@][\\p{L}\\p{N}_]+)*|[^\\p{L}\\p{N}_\\s]'))::int as tokens from documents""")
def document_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(C.normalize_visible(t)).alias("visible_md5"), F.md5(C.claim_text(t)).alias("claim_md5"), F.regexp_count(t, F.lit(C.AUDIT_TOKEN)).alias("tokens"))


@query("""select lang, source, case lang when 'tl' then 'fil' when 'iw' then 'he' else lang end as family, case source when 'whisper' then 1 when 'official_caption' then 4 else 0 end as priority, count(*) as n, sum(length(text))::bigint as chars from documents group by 1, 2""")
def language_family(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return d.select("lang", "source", C.language_family(F.col("lang")).alias("family"), C.source_priority(F.col("source")).alias("priority"), "n", "chars")


@query("""with t as (select source, lang, sum(length(text)) as w from documents group by 1, 2), r as (select *, row_number() over (partition by source order by w desc, lang) as rn, lead(w) over (partition by source order by w desc, lang) as second, sum(w) over (partition by source) as total from t)
select source, case when w * 100 >= total * 60 and coalesce(second, 0) * 100 < w * 70 then lang end as primary_language, w::bigint as weight from r where rn = 1""")
def primary_language(spark, sf):
    t = table(spark, sf, "documents").groupBy("source", "lang").agg(F.sum(F.length("text")).alias("w"))
    w = Window.partitionBy("source").orderBy(F.desc("w"), "lang")
    r = t.withColumns({"rn": F.row_number().over(w), "second": F.coalesce(F.lead("w").over(w), F.lit(0)), "total": F.sum("w").over(Window.partitionBy("source"))}).where("rn = 1")
    return r.select("source", F.when((F.col("w") * 100 >= F.col("total") * 60) & (F.col("second") * 100 < F.col("w") * 70), F.col("lang")).alias("primary_language"), F.col("w").alias("weight"))


@query(f"""with t as (select doc_id, unnest(regexp_extract_all(text, '{REBUILD}')) as x from documents), k as (select doc_id, regexp_replace(x, '[.,;!?]+$', '') as tok, count(*) as n from t group by 1, 2), b as (select doc_id // 2 as pair, doc_id % 2 as side, tok, n from k)
select coalesce(a.pair, c.pair) as pair, coalesce(a.tok, c.tok) as token, greatest(coalesce(a.n, 0) - coalesce(c.n, 0), 0)::bigint as missing, greatest(coalesce(c.n, 0) - coalesce(a.n, 0), 0)::bigint as added
from (select * from b where side = 0) a full join (select * from b where side = 1) c on a.pair = c.pair and a.tok = c.tok where coalesce(a.n, 0) <> coalesce(c.n, 0)""")
def high_impact_multiset_diff(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(X.rebuild_high_impact(F.col("text"))).alias("token"))
    side = lambda s: F.count_if(F.pmod("doc_id", F.lit(2)) == s)
    k = t.groupBy(F.floor(F.col("doc_id") / 2).alias("pair"), "token").agg(side(0).alias("a"), side(1).alias("b")).where("a <> b")
    return k.select("pair", "token", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("missing"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added"))


PARTS = {"relevance": 7, "importance": 11, "proximity": 13, "sharpness": 17, "stability": 19, "novelty": 23, "ocr": 29, "completeness": 31, "transition_risk": 37}
SQLP = ", ".join(f"((event_id * {p}) % 101) / 100.0::double as {k}" for k, p in PARTS.items())
SQLSCORE = "greatest(0.0::double, least(1.0::double, 0.18::double*relevance + 0.17::double*importance + 0.09::double*proximity + 0.12::double*sharpness + 0.09::double*stability + 0.10::double*novelty + 0.09::double*ocr + 0.08::double*completeness - 0.12::double*transition_risk))"


def _frames(spark, sf):
    s = A.signals(spark, sf).withColumns({k: F.pmod(F.col("event_id") * p, F.lit(101)) / 100 for k, p in PARTS.items()})
    return s.withColumn("score", F.round(C.frame_score({k: F.col(k) for k in PARTS}), 6)).withColumn("mandatory", F.col("event_type") == "error")


@query(f"with {SIG}, p as (select event_id, {SQLP} from signals) select event_id, round({SQLSCORE}, 6) as score, case when importance >= 0.9 then 'very_high' when importance >= 0.75 then 'high' when importance >= 0.45 then 'supporting' else 'low' end as tier from p")
def frame_score(spark, sf):
    return _frames(spark, sf).select("event_id", "score", C.tier(F.col("importance")).alias("tier"))


@query(f"""with {SIG}, p as (select media_id, event_id, actual_ms, event_type, {SQLP} from signals), s as (select *, round({SQLSCORE}, 6) as score, event_type = 'error' as mandatory from p),
b as (select media_id, greatest(1, ceil(greatest(max(actual_ms) / 60000.0, 1 / 60.0) * 2.0), 3 * count_if(importance >= 0.99))::bigint as budget from s group by 1),
r as (select s.*, budget, row_number() over (partition by s.media_id order by mandatory desc, score desc, actual_ms, event_id) as rn from s join b using (media_id))
select media_id, event_id, rn::int as rn, budget from r where rn <= budget or mandatory""")
def selection_within_budget(spark, sf):
    f = _frames(spark, sf)
    b = f.groupBy("media_id").agg(C.selection_budget(F.max("actual_ms"), F.count_if(F.col("importance") >= 0.99), F.lit(2.0)).cast("long").alias("budget"))
    w = Window.partitionBy("media_id").orderBy(F.desc("mandatory"), F.desc("score"), "actual_ms", "event_id")
    return f.withColumn("rn", F.row_number().over(w)).join(b, "media_id").where("rn <= budget or mandatory").select("media_id", "event_id", "rn", "budget")


_BITS = "list_sum([case when embedding[i] > embedding[i+1] then (1::bigint << (i-1)) else 0::bigint end for i in range(1, 64)])::bigint"


@query(f"""with e as (select vec_id, {_BITS} as h from embeddings), b as (select vec_id as id, h from e union all select vec_id + 10000000, xor(h, (((1::bigint << (vec_id % 12)) - 1) << (vec_id % 40)))::bigint from e)
select x.id as a, y.id as b, bit_count(xor(x.h, y.h))::int as distance from b x join b y on x.id < y.id where bit_count(xor(x.h, y.h)) <= 8""")
def near_dup_hamming(spark, sf):
    """perceptual_hamming pairs within the relaxed limit, among gradient hashes and copies of them with up to 11 bits changed."""
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), lambda acc, i: acc + F.when(F.get("embedding", i) > F.get("embedding", i + 1), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    h = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("h"))
    return selection.hamming_pairs(h.union(h.select(F.col("id") + 10_000_000, F.expr("h ^ shiftleft(shiftleft(1L, cast(id % 12 as int)) - 1, cast(id % 40 as int))"))), 8)


KINDS = """k as (select 'event' as kind, 1 as r, event_id as id, date_diff('day', date '1992-01-01', ts::date) as start_ms from events union all select 'order', 2, o_orderkey, date_diff('day', date '1992-01-01', o_orderdate::date) from orders
 union all select 'item', 3, l_orderkey, min(date_diff('day', date '1992-01-01', l_shipdate::date)) from lineitem group by l_orderkey)"""


def _timeline(spark, sf):
    day = lambda c: F.date_diff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))
    e = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.lit(1).alias("r"), F.col("event_id").alias("id"), day("ts").alias("start_ms"))
    o = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.lit(2).alias("r"), F.col("o_orderkey").alias("id"), day("o_orderdate").alias("start_ms"))
    i = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(day("l_shipdate")).alias("start_ms")).select(F.lit("item").alias("kind"), F.lit(3).alias("r"), F.col("l_orderkey").alias("id"), "start_ms")
    return e.unionByName(o).unionByName(i)


@query(f"with {KINDS} select kind, id, start_ms::int as start_ms, (row_number() over (partition by start_ms order by r, id))::int as place from k")
def timeline_union_order(spark, sf):
    # The total order is by day first: places within a day plus the days' sizes give it without one global sort.
    return _timeline(spark, sf).select("kind", "id", "start_ms", F.row_number().over(Window.partitionBy("start_ms").orderBy("r", "id")).alias("place"))


@query(f"with {KINDS}, d as (select *, count(*) over (partition by id) as n from k) select kind, count_if(n > 1)::bigint as shared_ids, count_if(start_ms > 2500)::bigint as beyond, count(*) as n from d group by 1")
def timeline_validate(spark, sf):
    t = _timeline(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    return t.groupBy("kind").agg(F.count_if(F.col("n") > 1).alias("shared_ids"), F.count_if(F.col("start_ms") > 2500).alias("beyond"), F.count(F.lit(1)).alias("n"))


@query(f"""with {SEG}, m as (select media_id, source_order, (media_id + source_order) % 13 = 0 as dropped, (media_id + source_order) % 17 = 0 as twice from segments)
select media_id, count_if(dropped)::bigint as missing, count_if(not dropped and twice)::bigint as duplicated, count(*) as segments from m group by 1""")
def block_coverage_audit(spark, sf):
    s = A.segments(spark, sf).select("media_id", "source_order", (F.col("media_id") + F.col("source_order")).alias("k"))
    blocks = s.where("k % 13 <> 0").select("media_id", "source_order", F.explode(F.when(F.expr("k % 17 = 0"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    mapped = blocks.groupBy("media_id", "source_order").agg(F.count(F.lit(1)).alias("n"))
    return s.join(mapped, ["media_id", "source_order"], "left").groupBy("media_id").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("duplicated"), F.count(F.lit(1)).alias("segments"))


@query("""select 'dangling_customer' as finding, count(*) as n from orders where o_custkey not in (select c_custkey from customer) union all select 'order_without_items', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select 'dangling_part', count(*) from lineitem where l_partkey not in (select p_partkey from part) union all select 'duplicate_item', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""")
def referential_audit(spark, sf):
    t = lambda n: table(spark, sf, n)
    finding = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
    o, i = t("orders"), t("lineitem")
    return (finding("dangling_customer", o.join(t("customer"), o.o_custkey == F.col("c_custkey"), "left_anti"))
            .union(finding("order_without_items", o.join(i, o.o_orderkey == i.l_orderkey, "left_anti")))
            .union(finding("dangling_part", i.join(t("part"), i.l_partkey == F.col("p_partkey"), "left_anti")))
            .union(finding("duplicate_item", i.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"))))


@query("""with c as (select l_orderkey as q, count_if(l_returnflag = 'A') as s, count_if(l_returnflag = 'R') as d, count_if(l_discount >= 0.09) as h from lineitem group by 1)
select o_orderkey as question, case when c.q is null or (s = 0 and d = 0) then 'insufficient' when d > s then 'disputed' when s > 0 and h = 0 then 'sufficient' else 'review_required' end as status from orders left join c on c.q = o_orderkey""")
def sufficiency_status(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("question")).agg(F.count_if(F.col("l_returnflag") == "A").alias("s"), F.count_if(F.col("l_returnflag") == "R").alias("d"), F.count_if(F.col("l_discount") >= 0.09).alias("h"))
    status = F.when(F.expr("s is null or (s = 0 and d = 0)"), "insufficient").when(F.expr("d > s"), "disputed").when(F.expr("s > 0 and h = 0"), "sufficient").otherwise("review_required")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("question")).join(c, "question", "left").select("question", status.alias("status"))


@query("""with c as (select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'A') select l_partkey, count(*) as observers, (count(*) * (count(*) - 1) // 2)::bigint as pairs from c group by 1 having count(*) > 1""")
def independent_pairs(spark, sf):
    c = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select("l_partkey", "l_suppkey").distinct()
    return c.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("observers")).where("observers > 1").withColumn("pairs", F.expr("observers * (observers - 1) div 2"))


@query("select event_type, count(*) as n, round(min(value), 6) as min, round(median(value), 6) as median, round(quantile_disc(value, 0.95), 6) as p95, round(max(value), 6) as max from events group by 1")
def p95_summary(spark, sf):
    e = table(spark, sf, "events")
    sums = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max"))
    found = quantiles(e, ["event_type"], "value", {"median": "median", "p95": 0.95})
    return sums.join(found, sums["event_type"].eqNullSafe(found["event_type"])).select(sums["event_type"], "n", "min", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "max")


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) select o_custkey, o_orderkey, rn::int as rn from r where rn > 3")
def retention_keep_k(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).where("rn > 3")


@query(f"""with {SIG}, g as (select *, case when actual_ms - lag(actual_ms) over (partition by media_id order by actual_ms, event_id) < 2000 then 1 else 0 end as n from signals), k as (select *, sum(n) over (partition by media_id order by actual_ms, event_id) as grp from g)
select media_id, grp::bigint as grp, min(actual_ms) as first_ms, max(actual_ms) as last_ms, count(*) as n from k group by media_id, grp""")
def batch_request_groups(spark, sf):
    w = Window.partitionBy("media_id").orderBy("actual_ms", "event_id")
    rows = A.signals(spark, sf).withColumn("new", F.coalesce(F.col("actual_ms") - F.lag("actual_ms").over(w) < 2000, F.lit(False)))
    return intervals.islands(rows, ["media_id"], ["actual_ms", "event_id"], F.col("new"), "grp").groupBy("media_id", "grp").agg(F.min("actual_ms").alias("first_ms"), F.max("actual_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))


@query("""with r as (select user_id, event_id, sum(1 + event_id % 97) over (partition by user_id order by ts desc, event_id desc) as kept from events) select user_id, count_if(kept <= 1000)::bigint as kept, count_if(kept > 1000)::bigint as pruned from r group by 1""")
def cache_prune_plan(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, sf, "events").select("user_id", F.sum(1 + F.pmod("event_id", F.lit(97))).over(w).alias("total"))
    return r.groupBy("user_id").agg(F.count_if(F.col("total") <= 1000).alias("kept"), F.count_if(F.col("total") > 1000).alias("pruned"))


_GREEDY = f"""{SIG}, p as (select media_id, event_id, actual_ms, event_type, {SQLP} from signals), f as (select media_id, event_id as frame_id, actual_ms as t, importance, round({SQLSCORE}, 6) as score, event_type = 'error' as mandatory,
 xor(xor(('0x' || substr(md5(event_type), 1, 15))::bigint, event_id % 8), (event_id % 7) << 20) as h from p), o as (select *, row_number() over (partition by media_id order by mandatory desc, score desc, t, frame_id) as rn from f),
r as (select media_id, 0::bigint as rn, []::struct(id bigint, t bigint, h bigint)[] as sel, null::bigint as frame_id, false as selected, null::bigint as representative from (select distinct media_id from o) union all
 select media_id, rn, case when take then list_append(sel, {{'id': frame_id, 't': t, 'h': h}}) else sel end, frame_id, take, case when take then frame_id else near end from (select *, mandatory or (near is null and len(sel) < 40) as take from
 (select o.media_id, o.rn, r.sel, o.frame_id, o.mandatory, o.t, o.h, list_filter(r.sel, lambda s: abs(s.t - o.t) <= 120000 and bit_count(xor(s.h, o.h)) <= 5)[1].id as near from r join o on o.media_id = r.media_id and o.rn = r.rn + 1)))"""


def _chosen(spark, sf):
    hashed = F.conv(F.substring(F.md5("event_type"), 1, 15), 16, 10).cast("long").bitwiseXOR(F.pmod("event_id", F.lit(8))).bitwiseXOR(F.shiftleft(F.pmod("event_id", F.lit(7)), 20))
    f = _frames(spark, sf).select("media_id", F.col("event_id").alias("frame_id"), "actual_ms", "importance", "score", "mandatory", hashed.alias("hash"))
    return selection.select_greedy(f, 40, chunk_ms=600_000)


@query(f"with recursive {_GREEDY} select media_id, frame_id, t as actual_ms, f.score, f.mandatory, h as hash, selected, representative from r join f using (media_id, frame_id) where rn > 0")
def selection_greedy(spark, sf):
    """select_frames: greedy choice within a budget, near frames covered by chosen ones."""
    return _chosen(spark, sf).drop("importance")


@query(f"""with recursive {_GREEDY}, c as (select r.*, f.t, case when importance >= 0.9 then 'very_high' when importance >= 0.75 then 'high' when importance >= 0.45 then 'supporting' else 'low' end as tier from r join f using (media_id, frame_id) where rn > 0),
g as (select media_id, max(t - before) as gap from (select media_id, t, lag(t) over (partition by media_id order by t) as before from c where selected) group by 1)
select media_id, count(*) as candidates, count_if(selected) as selected, count_if(not selected and representative is not null) as duplicates, count_if(representative is null) as low_score, count_if(representative is not null) as covered, {", ".join(f"count_if(tier = '{t}') as {t}_candidates, count_if(selected and tier = '{t}') as {t}_selected, case when count_if(tier = '{t}') > 0 then round(count_if(selected and tier = '{t}') / count_if(tier = '{t}'), 6) else 1.0 end as {t}_coverage" for t in ("very_high", "high", "supporting", "low"))},
 coalesce(any_value(gap), 0) as max_gap_ms from c left join g using (media_id) group by media_id""")
def selection_report(spark, sf):
    """select_frames: what was chosen, covered and left out, by importance."""
    return selection.selection_report(_chosen(spark, sf), C.tier(F.col("importance")))


@query(f"""with recursive {SIG}, p as (select distinct media_id, actual_ms as t from signals), r(media_id, t) as (select media_id, min(t) from p group by 1 union all
 select media_id, n from (select r.media_id, (select min(p.t) from p where p.media_id = r.media_id and p.t >= r.t + 30000) as n from r) where n is not null)
select media_id, t as actual_ms from r union select media_id, max(t) from p group by 1""")
def thinned_points(spark, sf):
    return selection.thin_points(A.signals(spark, sf), "media_id", "actual_ms", 30_000)


from lumenspool.plans import alignment_queries, audit_queries, block_queries, bounded_queries, caption_queries, claim_queries, frame_queries, media_queries, observation_queries, sink_queries, source_queries, state_queries, surface_queries, survey_queries, text_queries, tree_queries  # noqa: E402, F401
