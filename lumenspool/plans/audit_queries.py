"""Registered queries of audits, repair and packets, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspool.functions import text as X
from lumenspool.operators import audits as D
from lumenspool.operators import packets as P
from lumenspool.operators import repair as R
from lumenspool.plans.catalog import IVL, SEG, SIG
from lumenspool.plans.registry import query
from lumenspool.plans.text_queries import _AUDIT, _ORDERED, _REBUILD
from lumenspool.sources import adapters as A
from lumenspool.sources.adapters import table

_PAIRED = "c as (select conv_id, turn, text as source, case turn % 4 when 0 then text || ' extra 5mg' when 1 then text when 2 then array_to_string(list_reverse(string_split(text, ' ')), ' ') else coalesce(lag(text) over (partition by conv_id order by turn), '') end as output from conversations)"


def text_pairs(spark, sf):
    out = F.expr("case turn % 4 when 0 then text || ' extra 5mg' when 1 then text when 2 then array_join(reverse(split(text, ' ')), ' ') else coalesce(lag(text) over (partition by conv_id order by turn), '') end")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("source"), out.alias("output"))


def _difference_sql(pattern: str, trim: bool) -> str:
    tok = "regexp_replace(t, '[.,;!?]+$', '')" if trim else "t"
    return f"""with {_PAIRED}, u as (select conv_id, turn, 1 as s, unnest(regexp_extract_all(source, '{pattern}')) as t from c union all select conv_id, turn, -1, unnest(regexp_extract_all(output, '{pattern}')) from c), g as (select conv_id, turn, {tok} as token, sum(s) as d from u group by 1, 2, 3 having sum(s) <> 0)
select conv_id, turn, token, greatest(d, 0)::bigint as missing, greatest(-d, 0)::bigint as added from g"""


@query(_difference_sql(_AUDIT, False))
def high_impact_discrepancies(spark, sf):
    return D.token_differences(text_pairs(spark, sf), ["conv_id", "turn"], X.audit_high_impact)


@query(_difference_sql(_REBUILD, True))
def rebuild_token_differences(spark, sf):
    """audit_high_impact_tokens: both ways, as multisets."""
    return D.token_differences(text_pairs(spark, sf), ["conv_id", "turn"], X.rebuild_high_impact)


_TOKS = f"""with {_PAIRED}, m as (select conv_id, turn, regexp_replace(source, '(^|\\s)/', '\\1' || chr(1) || '/', 'g') as a, regexp_replace(output, '(^|\\s)/', '\\1' || chr(1) || '/', 'g') as b from c), t as (select conv_id, turn, list_transform(list_filter(list_transform(regexp_extract_all(a, '{_ORDERED}'), lambda x: replace(x, chr(1), '')), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]') or x[1] in ('/', '-')), lambda x: lower(x)) as a,
 list_transform(list_filter(list_transform(regexp_extract_all(b, '{_ORDERED}'), lambda x: replace(x, chr(1), '')), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]') or x[1] in ('/', '-')), lambda x: lower(x)) as b from m)"""


@query(_TOKS + " select conv_id, turn, a = b as faithful, a <> b and list_sort(a) = list_sort(b) as reordered, len(a)::int as source_tokens, len(b)::int as output_tokens from t")
def audit_ordered_tokens(spark, sf):
    return text_pairs(spark, sf).select("conv_id", "turn", D.token_audit(F.col("source"), F.col("output"), X.ordered_tokens).alias("t")).select("conv_id", "turn", "t.*")


# Blocks of two segments each; some segments dropped, some repeated, some with other texts.
_BLK = SEG + """, s as (select media_id, source_order, 'T' || source_order as segment_id, 'say ' || source_order as text, (media_id + source_order) % 17 <> 0 as substantive from segments), k as (select s.*, source_order // 2 as ordinal, case when (media_id + source_order) % 7 = 0 then 0 when (media_id + source_order) % 11 = 0 then 2 else 1 end as copies from s),
m as (select media_id, ordinal, segment_id, source_order, unnest(range(0, copies)) as copy, case when (media_id + source_order) % 5 = 0 then 'other' else text end as mapped from k)"""


def block_parts(spark, sf):
    k = F.col("media_id") + F.col("source_order")
    every = lambda n: F.pmod(k, F.lit(n)) == 0
    s = A.segments(spark, sf).select("media_id", "source_order", F.concat(F.lit("T"), "source_order").alias("segment_id"), F.concat(F.lit("say "), "source_order").alias("text"), (~every(17)).alias("substantive"))
    copies = F.when(every(7), 0).when(every(11), 2).otherwise(1)
    m = s.select("media_id", F.floor(F.col("source_order") / 2).alias("ordinal"), "source_order", "segment_id", F.when(every(5), "other").otherwise(F.col("text")).alias("mapped"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"))
    b = m.groupBy("media_id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("source_order", "segment_id", "mapped"))).alias("m"))
    return s, b.select("media_id", "ordinal", F.col("m.segment_id").alias("segment_ids"), F.col("m.mapped").alias("source_texts"), F.array_join(F.col("m.mapped"), " ").alias("text"))


_COV = _BLK + """, cov as (select s.media_id, s.segment_id, count(m.copy) as n, coalesce(bool_or(m.mapped = s.text), false) as same from s left join m on m.media_id = s.media_id and m.segment_id = s.segment_id where substantive group by 1, 2)"""


@query(f"with {_COV} select media_id, segment_id, n = 0 as missing, n > 1 as duplicated, n > 0 and not same as partial from cov")
def block_coverage(spark, sf):
    """audit_block_coverage: missing, duplicated and partial segments."""
    return D.block_coverage(*block_parts(spark, sf))


@query(f"""with {_COV}, t as (select media_id, count(*) as total, count_if(n > 0)::bigint as covered, count_if(n = 0)::bigint as missing, count_if(n > 1)::bigint as duplicated, count_if(n > 0 and not same)::bigint as partial from cov group by 1),
a as (select media_id, string_agg(text, ' ' order by source_order) as x from s where substantive group by 1), b as (select media_id, string_agg(mapped, ' ' order by ordinal, source_order) as y from m group by 1),
j as (select t.*, string_split(x, ' ') as x, string_split(coalesce(y, ''), ' ') as y from t join a using (media_id) left join b using (media_id)) select media_id, total, covered, missing, duplicated, partial, x = y as faithful, x <> y and list_sort(x) = list_sort(y) as reordered, missing = 0 and duplicated = 0 and partial = 0 and x = y as valid from j""")
def coverage_report(spark, sf):
    """audit_block_coverage: the report of a media, with the ordered token audit."""
    return D.coverage_report(*block_parts(spark, sf))


_PROJECT = SEG + """, bl as (select media_id, source_order as ordinal, 'B' || source_order as block_id, case when (media_id + source_order) % 8 = 0 then start_ms - 90000 when (media_id + source_order) % 31 = 0 then null else start_ms end as start_ms, case when (media_id + source_order) % 12 = 0 then start_ms - 100000 else end_ms end as end_ms,
 case (media_id + source_order) % 6 when 0 then [] when 1 then ['T' || source_order, 'Tx'] else ['T' || source_order] end as sids, case when source_order % 2 = 0 then ['V' || source_order] else [] end as eids, (media_id + source_order) % 4 = 0 as framed, (media_id + source_order) % 8 = 4 as claimed, case when source_order % 3 = 0 then 'a chart' when source_order % 3 = 1 then '[no visual source available]' end as visual from segments),
md as (select media_id, (max(end_ms) - 500)::bigint as duration_ms from segments group by 1), se as (select media_id, 'T' || source_order as id, (media_id + source_order) % 17 <> 0 as substantive from segments), ev as (select media_id, 'V' || source_order as id, case when media_id % 3 = 0 then 'incidental' when source_order % 4 = 0 then 'incidental' else 'consequential' end as importance from segments),
fr as (select media_id, 'F' || source_order as id, start_ms as requested, start_ms + 5 as actual, case when source_order % 5 = 0 then 4 else 5 end as off, case when source_order % 6 <> 0 then 'log' end as src from segments),
bb as (select b.*, duration_ms, last_value(start_ms ignore nulls) over (partition by b.media_id order by ordinal rows between unbounded preceding and 1 preceding) as before from bl b join md using (media_id)), mp as (select media_id, unnest(sids) as id from bl), ec as (select media_id, unnest(eids) as id from bl)"""


@query(f"""with {_PROJECT}, cnt as (select media_id, id, count(*) as n from mp group by 1, 2) select s.media_id, case when n is null then 'missing_segment' else 'duplicate_mapping' end as finding, s.id from se s left join cnt using (media_id, id) where substantive and coalesce(n, 0) <> 1
union all select distinct media_id, 'cites_missing_segment', id from mp where not exists (select 1 from se where se.media_id = mp.media_id and se.id = mp.id) union all select media_id, 'unrepresented_event', id from ev where (importance <> 'incidental' or media_id not in (select media_id from ev where importance <> 'incidental')) and not exists (select 1 from ec where ec.media_id = ev.media_id and ec.id = ev.id)
union all select media_id, 'end_precedes_start', block_id from bb where end_ms < start_ms union all select media_id, 'non_monotonic_order', block_id from bb where start_ms < before union all select media_id, 'exceeds_duration', block_id from bb where end_ms > duration_ms + 250 union all select media_id, 'unsupported_visual', block_id from bb where visual = 'a chart' and framed and not claimed
union all select media_id, 'offset_disagrees', id from fr where off <> actual - requested union all select fr.media_id, 'frame_outside_media', id from fr join md using (media_id) where actual < 0 or actual > duration_ms + 1000 union all select media_id, 'no_measurement_source', id from fr where src is null""")
def project_findings(spark, sf):
    """audit_project and validate_project: references, mapping, order, bounds, unsupported visuals, frame times, events."""
    s = A.segments(spark, sf)
    k = F.col("media_id") + F.col("source_order")
    n = F.col("source_order")
    m = lambda d: F.pmod(k, F.lit(d))
    none = F.array().cast("array<string>")
    own = F.concat(F.lit("T"), n)
    blocks = s.select("media_id", n.alias("ordinal"), F.concat(F.lit("B"), n).alias("block_id"), F.when(m(8) == 0, F.col("start_ms") - 90_000).when(m(31) != 0, F.col("start_ms")).alias("start_ms"), F.when(m(12) == 0, F.col("start_ms") - 100_000).otherwise(F.col("end_ms")).alias("end_ms"),
                      F.when(m(6) == 0, none).when(m(6) == 1, F.array(own, F.lit("Tx"))).otherwise(F.array(own)).alias("segment_ids"), F.when(F.pmod(n, F.lit(2)) == 0, F.array(F.concat(F.lit("V"), n))).otherwise(none).alias("event_ids"), F.when(m(4) == 0, F.array(F.lit("f"))).otherwise(none).alias("frame_ids"),
                      F.when(m(8) == 4, F.array(F.lit("c"))).otherwise(none).alias("claim_ids"), F.when(F.pmod(n, F.lit(3)) == 0, "a chart").when(F.pmod(n, F.lit(3)) == 1, "[no visual source available]").alias("visual"))
    media = s.groupBy("media_id").agg((F.max("end_ms") - 500).alias("duration_ms"))
    segments = s.select("media_id", own.alias("segment_id"), (m(17) != 0).alias("substantive"))
    events = s.select("media_id", F.concat(F.lit("V"), n).alias("event_id"), F.when((F.pmod("media_id", F.lit(3)) == 0) | (F.pmod(n, F.lit(4)) == 0), "incidental").otherwise("consequential").alias("importance"))
    frames = s.select("media_id", F.concat(F.lit("F"), n).alias("frame_id"), F.col("start_ms").alias("requested_ms"), (F.col("start_ms") + 5).alias("actual_ms"), F.when(F.pmod(n, F.lit(5)) == 0, 4).otherwise(5).cast("long").alias("offset_ms"), F.when(F.pmod(n, F.lit(6)) != 0, "log").alias("timestamp_source"))
    return D.project_findings(segments, blocks, events, frames, media)


@query(f"""with {SEG}, e as (select media_id, 'E' || source_order as event_id, ['F' || source_order, 'F' || (source_order + 1)] as ev, ['F' || (source_order + source_order % 3)] as ro from segments), f as (select media_id, list('F' || source_order) as known from segments where source_order % 5 <> 4 group by 1)
select e.media_id, event_id, len(list_filter(ev, lambda x: not list_contains(coalesce(known, []), x)))::int as unknown_frames, len(list_filter(ro, lambda x: not list_contains(ev, x)))::int as stray_roles from e left join f using (media_id) where len(list_filter(ev, lambda x: not list_contains(coalesce(known, []), x))) > 0 or len(list_filter(ro, lambda x: not list_contains(ev, x))) > 0""")
def ungrounded_events(spark, sf):
    """validate_event_grounding."""
    s = A.segments(spark, sf)
    f = lambda k: F.concat(F.lit("F"), k)
    n = F.col("source_order")
    events = s.select("media_id", F.concat(F.lit("E"), n).alias("event_id"), F.array(f(n), f(n + 1)).alias("evidence_ids"), F.array(f(n + F.pmod(n, F.lit(3)))).alias("role_ids"))
    return D.ungrounded_events(events, s.where("source_order % 5 <> 4").select("media_id", f(n).alias("frame_id")))


@query(f"""with {SEG} select media_id, bool_and(case when media_id % 4 = 0 then false else (media_id % 4 <> 1 or source_order <> 1) end) as compatible from (select media_id, source_order from segments union all select media_id, 0 from segments where media_id % 4 = 0) group by 1""")
def same_blocks(spark, sf):
    """_visual_reuse_transcript_compatible: ordered lists compared place by place."""
    s = A.segments(spark, sf).select("media_id", F.col("source_order").alias("ordinal"), "segment_id", "start_ms", "end_ms").withColumnRenamed("segment_id", "block_id").withColumn("segment_ids", F.array("block_id"))
    moved = s.withColumn("end_ms", F.when((F.pmod("media_id", F.lit(4)) == 1) & (F.col("ordinal") == 1), F.col("end_ms") + 1).otherwise(F.col("end_ms"))).where("media_id % 4 <> 0 or ordinal > 0")
    return D.same_blocks(s, moved)


@query(f"""with {SEG}, {IVL}, su0 as (select user_id % 50 as media_id, (event_id * 37) % 60000 as s, (event_id * 37) % 60000 + 900 as e from events where event_type = 'error'), su1 as (select *, max(e) over (partition by media_id order by s, e rows between unbounded preceding and 1 preceding) as r from su0), su2 as (select *, sum(case when r is null or s > r then 1 else 0 end) over (partition by media_id order by s, e rows between unbounded preceding and current row) as k from su1), su as (select media_id, min(s) as s, max(e) as e from su2 group by media_id, k),
sg as (select media_id % 50 as media_id, media_id * 100 + source_order as source_order, start_ms, end_ms, 'w' || source_order % 3 as text from segments), rc as (select user_id % 50 as media_id, event_id as o, (event_id * 53) % 60000 as s, (event_id * 53) % 60000 + 700 as e, case when event_id % 4 = 0 then '' else 'w' || event_id % 3 end as t, case when event_id % 5 <> 0 then (event_id % 100) / 100 end as conf from events),
hit as (select sg.*, su.s as i0, su.e as i1 from sg join su on su.media_id = sg.media_id and su.s < sg.end_ms and sg.start_ms < su.e), au as (select sg.media_id, sg.source_order, coalesce(string_agg(case when t <> '' then t end, ' ' order by o), '') as after, avg(conf) as conf from sg join rc on rc.media_id = sg.media_id and rc.s < sg.end_ms and sg.start_ms < rc.e group by 1, 2)
select hit.media_id, hit.source_order, i0 as interval_start, i1 as interval_end, md5(coalesce(after, '')) as after_md5, floor(conf * 1000000 + 0.001)::bigint as confidence, case when coalesce(after, '') <> '' and (conf is null or conf >= 0.5) and after <> text then 'replace' when after = text and after <> '' then 'retain' else 'unresolved' end as action from hit left join au using (media_id, source_order)""")
def repair_suspect_intervals(spark, sf):
    """repair_suspect_intervals, _recognized_text_for_segment, _confidence: without the recogniser, whose output is a table."""
    e = table(spark, sf, "events").withColumn("media_id", F.pmod("user_id", F.lit(50)))
    at = lambda k: F.pmod(F.col("event_id") * k, F.lit(60_000))
    suspect = e.where("event_type = 'error'").select("media_id", at(37).alias("start_ms"), (at(37) + 900).alias("end_ms"))
    heard = e.select("media_id", F.col("event_id").alias("r_order"), at(53).alias("start_ms"), (at(53) + 700).alias("end_ms"), F.when(F.pmod("event_id", F.lit(4)) == 0, "").otherwise(F.concat(F.lit("w"), F.pmod("event_id", F.lit(3)))).alias("text"), F.when(F.pmod("event_id", F.lit(5)) != 0, F.pmod("event_id", F.lit(100)) / 100).alias("confidence"))
    s = A.segments(spark, sf).select(F.pmod("media_id", F.lit(50)).alias("media_id"), (F.col("media_id") * 100 + F.col("source_order")).alias("source_order"), "segment_id", "start_ms", "end_ms", F.concat(F.lit("w"), F.pmod("source_order", F.lit(3))).alias("text"))
    r = R.repair(s, suspect, heard)
    return r.select("media_id", "source_order", "interval_start", "interval_end", F.md5("after").alias("after_md5"), F.floor(F.col("confidence") * 1_000_000 + 0.001).alias("confidence"), "action")


# Every conversation is recognised in chunks whose first two words repeat the last two of the chunk before.
@query("""with w as (select conv_id, turn, unnest(string_split(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) as word, generate_subscripts(string_split(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), 1) as i from conversations), n as (select conv_id, word, row_number() over (partition by conv_id order by turn, i) - 1 as p from w where word <> '')
select conv_id as media_id, count(*) as words, md5(string_agg(lower(word), ' ' order by p)) as text_md5 from n group by 1""")
def merge_chunk_results(spark, sf):
    """merge_chunk_results, merge_overlapping_segments, _duplicate_word_prefix, _trim_duplicate_words, offset_transcript_timestamps: what chunks repeat comes out once."""
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ")).alias("i", "word")).where("word <> ''")
    w = w.withColumn("p", F.expr("row_number() over (partition by conv_id order by turn, i) - 1"))
    # A chunk has eight words of its own and the two before them; its times count from its start.
    home = F.floor(F.col("p") / 8)
    both = F.when((F.pmod("p", F.lit(8)) >= 6), F.array(home, home + 1)).otherwise(F.array(home))
    n = w.withColumn("n", F.expr("count(*) over (partition by conv_id)")).select("conv_id", "word", "p", "n", F.explode(both).alias("chunk")).where("chunk * 8 < n")
    start = F.col("chunk") * 8000
    words = F.array_sort(F.collect_list(F.struct((F.col("p") * 1000 - start).alias("start_ms"), (F.col("p") * 1000 + 900 - start).alias("end_ms"), F.when(F.pmod("chunk", F.lit(2)) == 0, F.col("word")).otherwise(F.upper("word")).alias("text"))))
    c = n.groupBy("conv_id", "chunk").agg(words.alias("words")).select(
        F.col("conv_id").alias("media_id"), F.col("chunk").alias("source_order"), F.concat(F.lit("T"), "chunk").alias("segment_id"), F.col("words")[0]["start_ms"].alias("start_ms"), F.element_at("words", -1)["end_ms"].alias("end_ms"), F.array_join(F.transform("words", lambda x: x["text"]), " ").alias("text"),
        F.lit(0.5).alias("confidence"), "words", (F.col("chunk") * 8000).alias("offset_ms"))
    merged = R.merge_chunks(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_order", "text"))), lambda x: x["text"]), " ")
    return merged.groupBy("media_id").agg(F.sum(F.size("words")).alias("words"), F.md5(F.lower(text)).alias("text_md5"))


_PACK = SEG + """, p as (select media_id as project, 'V' || source_order as candidate_id, source_order as n, case (media_id + source_order) % 5 when 0 then 'high_impact' when 1 then 'Consequential' when 2 then null when 3 then 'incidental' else 'odd' end as importance, case (media_id + source_order) % 3 when 0 then 'hard_scene; ocr' when 1 then 'adaptive' end as reason, (media_id + source_order) % 7 as r from segments)"""


def packets(spark, sf):
    s = A.segments(spark, sf)
    k = F.col("media_id") + F.col("source_order")
    m = lambda d: F.pmod(k, F.lit(d))
    n = F.col("source_order")
    frame = lambda i, role, change: F.struct(F.concat(F.lit("F"), n + i).alias("frame_id"), F.lit(role).alias("role"), change.alias("change"))
    none = F.lit(None).cast("double")
    return s.select(F.col("media_id").alias("project"), F.concat(F.lit("V"), n).alias("candidate_id"), n.alias("n"), F.when(m(5) == 0, "high_impact").when(m(5) == 1, "Consequential").when(m(5) == 3, "incidental").when(m(5) == 4, "odd").alias("importance"),
                    F.when(m(3) == 0, "hard_scene; ocr").when(m(3) == 1, "adaptive").alias("selection_reason"), m(7).alias("r"), F.array(frame(0, "focus", none), frame(1, "after", F.when(m(7) < 4, m(7) / 50))).alias("frames"),
                    F.array(F.struct(F.when(m(7) == 6, "").otherwise(F.lit("x ")).alias("text"), (m(7) == 5).alias("uncertain"))).alias("ocr"), F.array(F.when(m(7) == 2, "A CONSEQUENTIAL change?").otherwise("what?")).alias("questions"))


@query(f"""with {_PACK} select project, candidate_id, round(case when importance is null then 0 else case lower(importance) when 'high_impact' then 12.0 when 'consequential' then 8.0 when 'incidental' then 0.0 else 1.0 end + 2.0 + least(2.0, n * 0.25) end + 2.0 + case when reason like 'hard%' then 12.0 when reason = 'adaptive' then 2.0 else 0.0 end + case when r = 5 then 4.0 else 0.0 end + case when r <> 6 then 3.0 else 0.0 end + case when r = 2 then 3.0 else 0.0 end
 + case when r < 4 then least(6.0, r / 50 * 6.0) + case when r between 1 and 2 then 3.0 else 0.0 end else 0.0 end, 6)::double as score from p""")
def packet_score(spark, sf):
    """_semantic_packet_score."""
    p = packets(spark, sf)
    return p.select("project", "candidate_id", F.round(P.score(F.col("importance"), F.lit(True), F.col("n"), F.col("frames"), F.col("selection_reason"), F.col("ocr"), F.col("questions")), 6).alias("score"))


@query(f"""with {_PACK}, f as (select media_id as project, source_order as n, 'h' || (source_order // 3) as ph, 'd' || (source_order // 4) as dh, source_order % 9 <> 8 as verified from segments), q as (select p.project, p.candidate_id, p.r, a.ph as a1, b.ph as b1, a.dh as a2, b.dh as b2, a.verified and b.verified as ver, b.n is not null as known from p join f a on a.project = p.project and a.n = p.n left join f b on b.project = p.project and b.n = p.n + 1),
x as (select *, case when known and a1 = b1 then 'no_change' when known and a2 = b2 and ver and r >= 4 and r <> 5 then 'stable_visible_state' end as proof from q)
select project, candidate_id, proof, case when r % 2 = 0 and proof is not null then proof when r % 2 = 0 then 'semantic_pending' else 'seen' end as event_type, case when r % 2 = 0 and proof = 'no_change' then 1.0 when r % 2 = 0 and proof is not null then 0.98 else 0.0 end::double as confidence from x""")
def frame_proofs(spark, sf):
    """_deterministic_identical_frame_annotation, _deterministic_stable_frame_annotation, _upgrade_semantic_pending_annotation."""
    p = packets(spark, sf)
    n = F.col("source_order")
    frames = A.segments(spark, sf).select(F.col("media_id").alias("project"), F.concat(F.lit("F"), n).alias("frame_id"), F.concat(F.lit("h"), F.floor(n / 3)).alias("pixel_hash"), F.concat(F.lit("d"), F.floor(n / 4)).alias("perceptual_hash"), (F.pmod(n, F.lit(9)) != 8).alias("verified"))
    proofs = P.frame_proofs(p, frames)
    said = p.select("project", "candidate_id", F.when(F.pmod("r", F.lit(2)) == 0, "semantic_pending").otherwise("seen").alias("event_type"), F.lit(0.0).alias("confidence"))
    return proofs.select("project", "candidate_id", "proof").join(P.upgraded(said, proofs).drop("upgraded"), ["project", "candidate_id"])


@query(f"""with {_PACK} select project, candidate_id, array_to_string(['F' || (n + 100), 'x'], ',') as remapped, array_to_string(list_filter([case when r = 6 then 'candidate mismatch' end, case when r = 5 then 'pending must have zero confidence' end, case when r = 4 then 'unknown evidence frame' end, case when r = 3 then 'role outside evidence' end, case when r = 2 then 'no focus frame' end], lambda x: x is not null), ',') as errors,
 case when r = 2 then 'F' || (n + 1) || ',F' || n else 'F' || n || case when r = 4 then ',Fx' else '' end || ',F' || (n + 1) end as completed from p""")
def annotation_checks(spark, sf):
    """validate_annotation_for_packet, normalize_annotation_evidence, _remap_reused_annotation."""
    p = packets(spark, sf)
    f = lambda k: F.concat(F.lit("F"), F.col("n") + k)
    r = F.col("r")
    ids = F.array(f(0), f(1))
    cited = F.when(r == 2, F.array(f(1))).when(r == 4, F.array(f(0), F.lit("Fx"))).otherwise(F.array(f(0)))
    roles = F.when(r == 3, F.array(f(1))).otherwise(F.slice(cited, 1, 1))
    errors = P.annotation_errors(F.when(r == 6, "other").otherwise(F.col("candidate_id")), F.col("candidate_id"), F.when(r == 5, "semantic_pending").otherwise("seen"), F.lit(0.5), cited, roles, ids, F.array(f(0)))
    return p.select("project", "candidate_id", F.array_join(P.remapped(F.array(f(0), F.lit("x")), ids, F.array(f(100), f(101))), ",").alias("remapped"), F.array_join(errors, ",").alias("errors"), F.array_join(P.completed_evidence(cited, F.array(f(0), f(1), F.lit("zz")), ids), ",").alias("completed"))


@query(f"""with {_PACK} select project, count_if(n % 3 <> 0 and r % 2 = 0 and r = 2)::bigint as fallbacks, count_if(r % 2 = 0 and r >= 4)::bigint as stale, count_if(r % 2 = 1)::bigint as settled, (count(*) - count_if(n % 3 = 0))::bigint as pending from p group by 1""")
def retry_queues(spark, sf):
    """_retryable_semantic_counts, _semantic_pending_retry_priority, _pending_semantic_event_ids, pending_packet_count, _semantic_event_is_observed."""
    p = packets(spark, sf)
    events = p.select("project", F.col("candidate_id").alias("event_id"), F.when(F.pmod("n", F.lit(3)) == 0, "a model").otherwise(" ").alias("annotation_provider"))
    left = P.pending(p, events).groupBy("project").agg(F.count(F.lit(1)).alias("pending"))
    kind = F.when(F.pmod("r", F.lit(2)) == 0, "semantic_pending").otherwise("seen")
    said = p.select("project", kind.alias("event_type"), F.array(F.when((F.col("r") == 2) & (F.pmod("n", F.lit(3)) != 0), "HTTP Error 400: x").otherwise("none")).alias("uncertainty"), F.when(F.col("r") >= 4, "old").otherwise("new").alias("prompt_hash"))
    settled = p.groupBy("project").agg(F.count_if(P.retry_priority(kind, F.lit(0.0)) == 0).alias("settled"))
    return settled.join(P.retry_counts(said, "new"), "project", "left").join(left, "project", "left").fillna(0, ["fallbacks", "stale", "pending"])


@query(f"""with {SIG}, b as (select media_id as project, 'B' || event_id as block_id, actual_ms as s, case when event_id % 4 = 0 then null else actual_ms + 3000 end as e, 'F' || (event_id % 40) as frame, event_id % 3 = 0 as unverified, event_id % 5 = 0 as uncertain, event_id % 7 = 0 as visual from signals where event_type = 'error'),
p as (select media_id as project, 'V' || event_id as candidate_id, actual_ms as s, actual_ms + 2000 as e, 'F' || (event_id % 40) as frame from signals where event_type = 'purchase'),
j as (select p.project, p.candidate_id, b.block_id, case when b.frame = p.frame then 4000 else 0 end + case when unverified then 1000 else 0 end + case when uncertain then 500 else 0 end + case when visual then 250 else 0 end + case when p.s <= coalesce(b.e, b.s) and b.s <= p.e then greatest(0, least(p.e, coalesce(b.e, b.s)) - greatest(p.s, b.s)) // 100 else 0 end as priority, b.s, b.e from p join b on b.project = p.project and (b.frame = p.frame or (p.s <= coalesce(b.e, b.s) and b.s <= p.e)))
select project, candidate_id, block_id, priority::bigint as priority, (row_number() over (partition by project, candidate_id order by priority desc, s, e nulls first, block_id))::int as place from j""")
def context_blocks(spark, sf):
    """_script_context: blocks linked by frame or by closed overlap, by priority."""
    s = A.signals(spark, sf)
    e = F.col("event_id")
    frame = F.array(F.concat(F.lit("F"), F.pmod(e, F.lit(40))))
    blocks = s.where("event_type = 'error'").select(F.col("media_id").alias("project"), F.concat(F.lit("B"), e).alias("block_id"), F.col("actual_ms").alias("start_ms"), F.when(F.pmod(e, F.lit(4)) != 0, F.col("actual_ms") + 3000).alias("end_ms"), frame.alias("frame_ids"), (F.pmod(e, F.lit(3)) == 0).alias("unverified"), (F.pmod(e, F.lit(5)) == 0).alias("uncertain"), (F.pmod(e, F.lit(7)) == 0).alias("visual"))
    p = s.where("event_type = 'purchase'").select(F.col("media_id").alias("project"), F.concat(F.lit("V"), e).alias("candidate_id"), F.col("actual_ms").alias("start_ms"), (F.col("actual_ms") + 2000).alias("end_ms"), frame.alias("frame_ids"))
    return P.context_blocks(p, blocks)


@query(f"""with {SEG}, p as (select media_id as project, 'V' || source_order as candidate_id, source_order as n from segments), a as (select p.project, candidate_id, 'c' || (s.source_order % 4) as claim_id, 0 as t, 'F' || s.source_order as f, 0 as o from p join segments s on s.media_id = p.project and s.source_order in (n, n + 1)), b as (select p.project, candidate_id, 'd' || (s.source_order % 3) as claim_id, 1 as t, '' as f, s.source_order as o from p join segments s on s.media_id = p.project and s.source_order in (n, n + 1)),
u as (select project, candidate_id, claim_id, min({{'t': t, 'f': f, 'o': o}}) as pos from (select * from a union all select * from b) group by 1, 2, 3) select project, candidate_id, string_agg(claim_id, ',' order by pos, claim_id) as claims from u group by 1, 2""")
def prior_claims(spark, sf):
    """_prior_claim_context_ids."""
    s = A.segments(spark, sf)
    n = F.col("source_order")
    f = lambda k: F.concat(F.lit("F"), k)
    p = s.select(F.col("media_id").alias("project"), F.concat(F.lit("V"), n).alias("candidate_id"), F.array(f(n), f(n + 1)).alias("frame_ids"))
    known = s.select(F.col("media_id").alias("project"), f(n).alias("frame_id"), F.lit(0).alias("position"), F.concat(F.lit("c"), F.pmod(n, F.lit(4))).alias("claim_id"))
    claims = s.select(F.col("media_id").alias("project"), F.concat(F.lit("d"), F.pmod(n, F.lit(3))).alias("claim_id"), n.alias("ordinal"), F.array(f(n)).alias("image_ids"))
    return P.prior_claims(p, known, claims).select("project", "candidate_id", F.array_join("claim_ids", ",").alias("claims"))
