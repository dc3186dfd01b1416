"""Queries through the SQL surface, and of numbering, containment and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspool.operators import blocks as B
from lumenspool.operators import claims as K
from lumenspool.operators import intervals
from lumenspool.operators import observations as O
from lumenspool.plans import sql
from lumenspool.plans.alignment_queries import _BLOCKS, _WORDS, edited
from lumenspool.plans.registry import query
from lumenspool.sources.adapters import table


@query(_WORDS + _BLOCKS + " select conv_id, turn, printf('%02d:%02d:%02d.%03d', 0, 0, turn, conv_id % 1000) as at, count(*) filter (tag <> 'equal') as edits, count(*) filter (tag = 'equal') as kept, sum(greatest(0, least(a_end, 10) - a_start))::bigint as early from ops group by conv_id, turn")
def sql_surface(spark, sf):
    """Lateral table function, SQL functions and a view of token pairs, in SQL."""
    sql.register(spark)
    edited(spark, sf).createOrReplaceTempView("token_pairs")
    return spark.sql("""select conv_id, turn, clock(turn * 1000 + conv_id % 1000) as at, count_if(tag <> 'equal') as edits, count_if(tag = 'equal') as kept, sum(overlap_ms(a_start, a_end, 0, 10)) as early
        from token_pairs, lateral align_tokens(a, b) group by conv_id, turn""")


@query("""with s as (select conv_id // 3 as media_id, conv_id % 3 as attempt, turn from conversations), n as (select *, row_number() over (partition by media_id order by attempt, turn) as k, dense_rank() over (partition by media_id order by attempt) as c from s)
select media_id, attempt, turn as position, 'TC' || lpad(c::varchar, 6, '0') as candidate_id, 'T' || lpad(k::varchar, 6, '0') as segment_id, 'local ASR backend=b' || attempt as source_track, 2 as n_words from n""")
def recorded_segments(spark, sf):
    """_record_asr_candidate."""
    c = table(spark, sf, "conversations")
    word = lambda i: F.struct(F.concat(F.lit("w"), F.lit(i)).alias("text"), (F.col("turn") * 1000 + i).alias("start_ms"), (F.col("turn") * 1000 + i + 5).alias("end_ms"))
    s = c.select(F.floor(F.col("conv_id") / 3).alias("media_id"), F.pmod("conv_id", F.lit(3)).alias("attempt"), F.col("turn").alias("position"), F.concat(F.lit("b"), F.pmod("conv_id", F.lit(3))).alias("backend"), F.array(word(0), word(1)).alias("words"))
    return O.recorded_segments(s).select("media_id", "attempt", "position", "candidate_id", "segment_id", "source_track", F.size(F.array_distinct(F.transform("words", lambda w: w["word_id"]))).alias("n_words"))


@query("""select conv_id as media_id, 'B' || lpad((row_number() over (partition by conv_id order by turn))::varchar, 6, '0') as block_id, case when turn % 4 = 0 then 'Speaker 1' else role end as speaker, md5(case when turn % 3 = 0 then 'human' when turn % 3 = 1 then 'repaired' else coalesce(text, '') end) as text_md5,
case when turn % 2 = 0 then 1.0 else 0.5 end as confidence, case when turn % 5 = 0 then 'human_reviewed' else 'unverified' end as verification_status from conversations""")
def single_blocks(spark, sf):
    """_build_blocks."""
    turn = F.col("turn")
    k = lambda n, r: F.pmod(turn, F.lit(n)) == r
    s = table(spark, sf, "conversations").select(F.col("conv_id").alias("media_id"), turn.alias("source_order"), F.concat(F.lit("T"), turn).alias("segment_id"), F.lit(0).alias("start_ms"), F.lit(1).alias("end_ms"), F.when(k(4, 0), "").otherwise(F.col("role")).alias("speaker"),
                                                   F.when(k(3, 0), "human").otherwise("").alias("human_verified_text"), F.when(k(3, 1), "repaired").alias("repaired_text"), F.lit(None).cast("string").alias("normalized_text"), F.col("text").alias("raw_text"), F.when(k(2, 1), 0.5).alias("confidence"), F.when(k(5, 0), "human_reviewed").alias("verification_status"))
    return B.single_blocks(s, "lossless").select("media_id", "block_id", "speaker", F.md5("spoken_text").alias("text_md5"), "confidence", "verification_status")


@query("""with a as (select user_id % 10 as media_id, event_id, event_id * 50 as s, event_id * 50 + (event_id % 40) * 20 as e from events), b as (select user_id % 10 as media_id, event_id * 50 as s, event_id * 50 + case when event_id % 97 = 0 then 400000 else (event_id % 30) * 40 end as e from events where event_id % 3 = 0)
select media_id, event_id, s < e and exists (select 1 from b where b.media_id = a.media_id and b.s <= a.s and b.e >= a.e) as covered from a""")
def contained_intervals(spark, sf):
    """_covers."""
    e = table(spark, sf, "events")
    k, at = F.col("event_id"), F.col("event_id") * 50
    media = F.pmod("user_id", F.lit(10)).alias("media_id")
    left = e.select(media, "event_id", at.alias("start_ms"), (at + F.pmod(k, F.lit(40)) * 20).alias("end_ms"))
    right = e.where("event_id % 3 = 0").select(media, at.alias("r_start"), (at + F.when(F.pmod(k, F.lit(97)) == 0, 400_000).otherwise(F.pmod(k, F.lit(30)) * 40)).alias("r_end"))
    return intervals.contained(left, right, "media_id").select("media_id", "event_id", "covered")


@query("""with i as (select o_custkey % 25 as project, 'F' || lpad(o_orderkey::varchar, 7, '0') as image_id, o_orderkey as k from orders), d as (select *, 'MS' || lpad((k % 5000)::varchar, 6, '0') as decision_id from i where k % 4 = 0), l as (select project, max(substr(decision_id, 3)::bigint) as last from d group by 1)
select project, 'MS' || lpad((coalesce(last, 0) + row_number() over (partition by project order by image_id))::varchar, 6, '0') as decision_id, image_id, case when k % 3 = 0 then 'insufficient' when k % 2 = 0 then 'sufficient' when k % 5 = 0 then 'limit_reached' else 'insufficient' end as status from i left join l using (project) where k % 4 <> 0""")
def ensured_decisions(spark, sf):
    """_ensure_sufficiency_decisions."""
    k = F.col("o_orderkey")
    i = table(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(25)).alias("project"), F.concat(F.lit("F"), F.lpad(k.cast("string"), 7, "0")).alias("image_id"), k.alias("k"))
    existing = i.where("k % 4 = 0").select("project", "image_id", F.concat(F.lit("MS"), F.lpad(F.pmod("k", F.lit(5000)).cast("string"), 6, "0")).alias("decision_id"))
    answers = i.where("k % 3 <> 0").select("image_id", (F.pmod("k", F.lit(2)) == 0).alias("answered"))
    state = i.select("image_id", F.lit(True).alias("observer_available"), (F.pmod("k", F.lit(5)) == 0).alias("limit_reached"), F.lit(False).alias("no_further_evidence"))
    return K.ensured_decisions(i, existing, answers, state)


@query("select doc_id, len(list_distinct(c)[1:16])::int as shown, len(c)::int as n from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^a-zA-Z ]') as c from documents)")
def prompt_characters(spark, sf):
    """_compact_prompt_ocr: uncertain characters as a sample and a count."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^a-zA-Z ]"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", O.prompt_text(found).alias("p")).select("doc_id", F.size("p.samples").alias("shown"), F.col("p.count").alias("n"))
