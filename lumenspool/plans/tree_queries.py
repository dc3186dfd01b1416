"""Queries over JSON trees: content keys, scope keys, redaction and diagnostics at any depth; typed JSON records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspool.functions.identity import json_text
from lumenspool.operators import trees as T
from lumenspool.plans.registry import query
from lumenspool.sinks.shared import shared_path
from lumenspool.sources import json_records
from lumenspool.sources.adapters import table

# Packets of two runs: ids and the order of keys differ between them, contents do not, except where the turn is a multiple of 5.
_PACKET = """p as (select conv_id, turn, run, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') as said, role, (turn % 5 = 0)::int * run as other from conversations, (values (0), (1)) as r(run) where text is not null and role is not null)"""


def packets(spark, sf):
    """(packet_id, run, tree): nested packets whose ids, and in run 1 the order of keys, are a run's own."""
    c = table(spark, sf, "conversations").where("text is not null and role is not null").withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    own = F.concat(F.lit('"C'), F.col("conv_id"), F.lit("-"), F.col("turn"), F.lit("-"), F.col("run"), F.lit('"'))
    said, who = json_text(F.col("text")), json_text(F.col("role"))
    other = F.when(F.pmod("turn", F.lit(5)) == 0, F.col("run")).otherwise(0).cast("string")
    inner = F.concat(F.lit('{"event_id":'), own, F.lit(',"states":[[1,{"frame_id":'), own, F.lit(',"ocr":'), said, F.lit('}],[],{}],"segment_ids":['), own, F.lit(","), own, F.lit("]}"))
    first = F.concat(F.lit('{"candidate_id":'), own, F.lit(',"role":'), who, F.lit(',"context":'), inner, F.lit(',"max_span_ms":'), F.col("turn"), F.lit(',"seen":true,"other":'), other, F.lit("}"))
    second = F.concat(F.lit('{"other":'), other, F.lit(',"seen":true,"max_span_ms":'), F.col("turn"), F.lit(',"context":'), inner, F.lit(',"role":'), who, F.lit(',"candidate_id":'), own, F.lit("}"))
    text = F.when(F.col("run") == 0, first).otherwise(second)
    return c.select(F.concat_ws("-", "conv_id", "turn", "run").alias("packet_id"), F.try_parse_json(text).alias("tree"))


@query(f"""with {_PACKET} select conv_id || '-' || turn || '-' || run as packet_id,
 sha256('{{"candidate_id":"<id>","context":{{"event_id":"<id>","segment_ids":["<id>","<id>"],"states":[[1,{{"frame_id":"<id>","ocr":"' || said || '"}}],[],{{}}]}},"max_span_ms":' || turn || ',"other":' || other || ',"role":"' || role || '","seen":true}}') as content_key from p""")
def content_keys(spark, sf):
    """_semantic_content_context: contents that differ in ids and order of keys only have one key."""
    return T.content_key(packets(spark, sf), ["packet_id"], "tree")


@query(f"""with {_PACKET}, q as (select *, '"C' || conv_id || '-' || turn || '-' || run || '"' as own from p) select conv_id || '-' || turn || '-' || run as packet_id,
 sha256('{{"context":{{"event_id":' || own || ',"segment_ids":[' || own || ',' || own || '],"states":[[1,{{"frame_id":' || own || ',"ocr":"' || said || '"}}],[],{{}}]}},"max_span_ms":' || turn || ',"other":' || other || ',"role":"' || role || '","seen":true}}') as scope_key from q""")
def scope_keys(spark, sf):
    """_semantic_packet_scope_key: everything but the candidate's own id counts."""
    return T.scope_key(packets(spark, sf), ["packet_id"], "tree")


@query("""with g as (select packet_id, sum((pixel_hash = '' and file_hash is null)::int) as open, string_agg('{"digest":"' || case when pixel_hash <> '' then pixel_hash else coalesce(file_hash, '') end || '","role":"' || role || '"}', ',' order by place, role, case when pixel_hash <> '' then pixel_hash else coalesce(file_hash, '') end, frame_id) as shown,
 list(frame_id order by place, role, case when pixel_hash <> '' then pixel_hash else coalesce(file_hash, '') end, frame_id) as ids from (select event_id // 3 as packet_id, event_id as frame_id, event_type as role, event_id % 3 as place, case when event_id % 6 <> 0 then md5(event_type) else '' end as pixel_hash, case when event_id % 30 <> 0 then 'f' || event_type end as file_hash from events) group by 1)
select packet_id, sha256('{"context":{"frame_id":"<id>","question":"q' || packet_id % 7 || '"},"frames":[' || shown || ']}') as content_key, array_to_string(ids, ',') as frames from g where open = 0""")
def visual_content_keys(spark, sf):
    """_semantic_visual_content_key, _packet_frame_hashes: packets by the digests of their frames, file digests where pixels have none."""
    e = table(spark, sf, "events")
    packet = F.floor(F.col("event_id") / 3)
    frames = e.select(packet.alias("packet_id"), F.col("event_id").alias("frame_id"), F.col("event_type").alias("role"), F.pmod("event_id", F.lit(3)).alias("place"))
    hashes = e.select(F.col("event_id").alias("frame_id"), F.when(F.pmod("event_id", F.lit(6)) != 0, F.md5("event_type")).otherwise("").alias("pixel_hash"), F.when(F.pmod("event_id", F.lit(30)) != 0, F.concat(F.lit("f"), "event_type")).alias("file_hash"))
    text = F.concat(F.lit('{"question":"q'), F.pmod("packet_id", F.lit(7)), F.lit('","frame_id":"F'), F.col("packet_id"), F.lit('"}'))
    made = frames.select("packet_id").distinct().select("packet_id", F.parse_json(text).alias("context"))
    return T.visual_content_key(made, frames, hashes).select("packet_id", "content_key", F.array_join("frame_ids", ",").alias("frames"))


def _secrets(spark, sf):
    """(doc_id, tree): settings with secrets at several depths, made of documents' columns."""
    d = table(spark, sf, "documents").where("doc_id is not null and lang is not null and source is not null")
    q = lambda c: json_text(F.col(c))
    text = F.concat(F.lit('{"list":[{"API-Key":"k'), F.col("doc_id"), F.lit('","lang":'), q("lang"), F.lit('},["https://h.org/a?sig=1&n='), F.col("doc_id"), F.lit('#top",{"client_secret":{"deep":[1,2]},"n":null}]],"Path":"/usr/bin/x","note":"token: abc in /home/me/file, ok","source":'), q("source"), F.lit(',"url":"https://h.org/a?page=2"}'))
    return d.select("doc_id", F.parse_json(text).alias("tree"))


@query("""select doc_id, '{"Path":"/usr/bin/x","list":[{"API-Key":"[REDACTED]","lang":"' || lang || '"},["https://h.org/a?[REDACTED]#top",{"client_secret":"[REDACTED]","n":null}]],"note":"token: abc in /home/me/file, ok","source":"' || source || '","url":"https://h.org/a?page=2"}' as text
from documents where doc_id is not null and lang is not null and source is not null""")
def redacted_trees(spark, sf):
    """redact, atomic_write_json: secrets hidden at any depth of a tree."""
    return T.redacted(_secrets(spark, sf), ["doc_id"], "tree")


@query("""select doc_id, '{"Path":"[REDACTED]","list":[{"API-Key":"[REDACTED]","lang":"' || lang || '"},["https:/[REDACTED_PATH]",{"client_secret":{"deep":[1,2]},"n":null}]],"note":"[REDACTED] in [REDACTED_PATH], ok","source":"' || source || '","url":"https:/[REDACTED_PATH]"}' as text
from documents where doc_id is not null and lang is not null and source is not null""")
def diagnostic_trees(spark, sf):
    """sanitize_diagnostic_value: sensitive keys, secrets in texts and paths hidden at any depth."""
    return T.diagnostics(_secrets(spark, sf), ["doc_id"], "tree")


@query("""with r as (select conv_id, turn, (conv_id * 8 + turn) % 11 as fault from conversations) select conv_id || '-' || turn as candidate_id, case fault when 3 then 'missing questions' when 5 then 'max_span_ms is no number' when 7 then 'frame without frame_id' end as reason, count(*)::bigint as n from r where fault not in (1, 2, 9) group by 1, 2
union all select null, case fault when 1 then 'not json' when 2 then 'not an object' when 9 then 'too large' end, count(*) from r where fault in (1, 2, 9) group by 1, 2""")
def packet_records(spark, sf):
    """load_vision_packet: JSON lines made of a table, read through the data source; broken ones are rows with reasons."""
    c = table(spark, sf, "conversations").withColumn("fault", F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(11)))
    key = F.concat_ws("-", "conv_id", "turn")
    whole = lambda questions='"questions":["?"],', span="5", frame='"frame_id":"F1"': F.concat(F.lit('{"candidate_id":"'), key, F.lit(f'","frames":[{{{frame}}}],{questions}"max_span_ms":{span}}}'))
    line = F.when(F.col("fault") == 1, F.lit('{"candidate_id":')).when(F.col("fault") == 2, "[1]").when(F.col("fault") == 3, whole("")).when(F.col("fault") == 5, whole(span='"5"')).when(F.col("fault") == 7, whole(frame='"id":1')).when(
        F.col("fault") == 9, F.concat(F.lit('{"candidate_id":"'), F.repeat(F.lit("x"), 5000), F.lit('"}'))).otherwise(whole())
    path = shared_path(spark, "packets")
    c.select(line.alias("value")).write.text(path)
    json_records.register(spark)
    rows = spark.read.format("json_records").option("path", path).option("kind", "packet").option("max_bytes", 4096).option("split_bytes", 10_000).load()
    return rows.groupBy("candidate_id", "reason").agg(F.count(F.lit(1)).alias("n"))
