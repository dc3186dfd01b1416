"""Registered queries of transcript and media sources: files are made from the tables, read by the library, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspool.functions import columns as C
from lumenspool.plans.registry import query
from lumenspool.sources import adapters as A
from lumenspool.sources import transcripts as T
from lumenspool.sources.adapters import table

_ONE_LINE = "trim(regexp_replace(text, '[^A-Za-z0-9.,]+', ' ', 'g'))"
_SEG = f"""seg as (select conv_id, turn, {_ONE_LINE} as t, greatest(0, coalesce(sum(400 + 55*length(text) + (conv_id*7919 + turn*104729) % 2600 - 300) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0))::bigint as start_ms, 400 + 55*length(text) as d,
 (row_number() over (partition by conv_id order by turn) - 1)::bigint as i from conversations)"""


def cue_files(spark, sf, suffix: str, header: str, cue, between: str = "\n") -> DataFrame:
    """A file a conversation: rows (path, content) with a cue a turn."""
    s = A.segments(spark, sf).withColumns({"t": F.trim(F.regexp_replace("raw_text", "[^A-Za-z0-9.,]+", " ")), "who": F.when(F.col("speaker") == "A", "Ann").otherwise("Bo")})
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_order", cue(s).alias("c")))), lambda x: x["c"]), between)
    return s.groupBy("media_id").agg(F.concat(F.lit(header), body).alias("content")).select(F.concat("media_id", F.lit(suffix)).alias("path"), "content")


def _clock(column: str, comma: str = "."):
    return F.replace(C.clock(F.col(column)), F.lit("."), F.lit(comma))


def _times(comma: str = "."):
    return F.concat(_clock("start_ms", comma), F.lit(" --> "), _clock("end_ms", comma))


def _cues(df: DataFrame) -> DataFrame:
    return df.select("path", "source_order", "segment_id", "start_ms", "end_ms", "timing_provenance", "normalized_text", "speaker_label")


def _cue_sql(suffix: str, kind: str, speaker: str = "null", text: str = "t") -> str:
    return f"""with {_SEG} select conv_id || '{suffix}' as path, i as source_order, 'T' || lpad((i + 1)::varchar, 6, '0') as segment_id, start_ms, start_ms + d as end_ms, 'source_{kind}' as timing_provenance, {text} as normalized_text, {speaker} as speaker_label from seg"""


_WHO = "case when (conv_id + turn) % 4 < 2 then 'Ann' else 'Bo' end"


@query(_cue_sql(".srt", "srt"))
def parse_srt(spark, sf):
    files = cue_files(spark, sf, ".srt", "﻿", lambda s: F.concat_ws("\r\n", F.when(F.pmod("source_order", F.lit(2)) == 0, (F.col("source_order") + 1).cast("string")), _times(","), "t", F.lit("")), "\r\n")
    return _cues(T.parse_srt(files))


@query(_cue_sql(".vtt", "vtt", _WHO, "t || ' & more'"))
def parse_vtt(spark, sf):
    cue = lambda s: F.concat_ws("\n", F.when(F.pmod("source_order", F.lit(3)) == 0, F.lit("NOTE a\nremark\n")), F.when(F.pmod("source_order", F.lit(2)) == 0, F.lit("name")), F.concat(_times(), F.lit(" align:start")), F.concat(F.lit("<v "), "who", F.lit(">"), "t", F.lit(" &amp; <i>more</i></v>")), F.lit(""))
    return _cues(T.parse_vtt(cue_files(spark, sf, ".vtt", "WEBVTT - title\n\n", cue)))


@query(_cue_sql(".ass", "ass", _WHO, "'x, ' || t || chr(10) || 'end'").replace("start_ms, start_ms + d as end_ms", "start_ms // 10 * 10 as start_ms, (start_ms + d) // 10 * 10 as end_ms"))
def parse_ass(spark, sf):
    cue = lambda s: F.concat(F.lit("Dialogue: 0,"), F.substring(_clock("start_ms"), 1, 11), F.lit(","), F.substring(_clock("end_ms"), 1, 11), F.lit(", "), "who", F.lit(",,x, {\\b1}"), "t", F.lit("\\Nend"))
    return _cues(T.parse_ass(cue_files(spark, sf, ".ass", "[Script Info]\nDialogue: none\n\n[Events]\nFormat: Layer, Start, End, Name, Effect, Text\n; remark\n", cue)))


@query(f"""with {_SEG} select conv_id || '.json' as path, i as source_order, start_ms, case when i % 3 = 1 then null else start_ms + d end as end_ms, case when i % 4 = 3 then 'untimed_source' else 'source_json' end as timing_provenance, t as normalized_text, {_WHO} as speaker_label,
 case when i % 2 = 0 then 'fil' else 'en' end as language, case when i % 2 = 0 then round((turn % 10) / 10.0, 1)::double end as confidence from seg""".replace("start_ms, case when i % 3 = 1 then null else start_ms + d end as end_ms", "case when i % 4 <> 3 then start_ms end as start_ms, case when i % 4 <> 3 then start_ms + d end as end_ms"))
def parse_json_transcript(spark, sf):
    def cue(s):
        times = (F.when(F.pmod("source_order", F.lit(4)) == 0, F.concat(F.lit('"start_ms":'), "start_ms", F.lit(',"end_ms":'), "end_ms"))
                 .when(F.pmod("source_order", F.lit(4)) == 1, F.concat(F.lit('"start":"'), _clock("start_ms"), F.lit('","duration":'), (F.col("end_ms") - F.col("start_ms")) / 1000))
                 .when(F.pmod("source_order", F.lit(4)) == 2, F.concat(F.lit('"time_unit":"ms","start_time":'), "start_ms", F.lit(',"end_time":'), "end_ms")).otherwise(F.lit('"note":1')))
        rest = F.when(F.pmod("source_order", F.lit(2)) == 0, F.concat(F.lit(',"language":"fil","confidence":0.'), F.pmod("source_order", F.lit(10)))).otherwise(F.lit(""))
        return F.concat(F.lit("{"), times, F.lit(',"speaker":"'), "who", F.lit('","text":"'), "t", F.lit('"'), rest, F.lit("}"))

    files = cue_files(spark, sf, ".json", "", cue, ",").withColumn("content", F.concat(F.lit('{"lang":"en","cues":['), "content", F.lit("]}")))
    return T.parse_json_transcript(files).select("path", "source_order", "start_ms", "end_ms", "timing_provenance", "normalized_text", "speaker_label", "language", "confidence")


@query("""with w as (select conv_id || '.json' as path, 0::bigint as source_order, (row_number() over (partition by conv_id order by turn) - 1)::int as word_order, role as text, (turn * 500)::bigint as start_ms, (turn * 500 + 400)::bigint as end_ms from conversations),
f as (select *, 'T000001' as a, word_order::varchar as b, start_ms::varchar as c, end_ms::varchar as d from w), g as (select *, unhex(lpad(to_hex(length(a)), 16, '0')) || encode(a) || unhex(lpad(to_hex(length(b)), 16, '0')) || encode(b) || unhex(lpad(to_hex(length(c)), 16, '0')) || encode(c) || unhex(lpad(to_hex(length(d)), 16, '0')) || encode(d) || unhex(lpad(to_hex(length(text)), 16, '0')) || encode(text) as framed from f)
select path, source_order, word_order, case when word_order % 2 = 0 then 'own' || word_order else 'W' || lpad((('0x' || substr(sha256(framed), 1, 16))::ubigint % 999999 + 1)::varchar, 6, '0') end as word_id, text, start_ms, end_ms, null::double as confidence from g""")
def json_transcript_words(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", F.expr("row_number() over (partition by conv_id order by turn) - 1"))
    word = F.concat(F.lit('{"word":"'), "role", F.lit('","start":'), F.col("turn") * 500 / 1000, F.lit(',"end_ms":'), F.col("turn") * 500 + 400, F.when(F.pmod("n", F.lit(2)) == 0, F.concat(F.lit(',"word_id":"own'), "n", F.lit('"'))).otherwise(F.lit("")), F.lit("}"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", word.alias("w")))), lambda x: x["w"]), ",")
    files = c.groupBy("conv_id").agg(F.concat(F.lit('[{"text":"all","words":['), words, F.lit("]}]")).alias("content")).select(F.concat("conv_id", F.lit(".json")).alias("path"), "content")
    return T.json_words(files)


@query(f"""with {_SEG} select conv_id || '.txt' as path, i as source_order, start_ms, case when i % 2 = 0 then start_ms + d end as end_ms, case when i % 2 = 0 then 'source_text_range' else 'source_text_point' end as timing_provenance, case when i % 3 = 0 then t || chr(10) || 'more' else t end as normalized_text from seg""")
def parse_plain_timed(spark, sf):
    cue = lambda s: F.concat(F.lit("["), _clock("start_ms"), F.when(F.pmod("source_order", F.lit(2)) == 0, F.concat(F.lit(" - "), _clock("end_ms"))).otherwise(F.lit("")), F.lit("] "), "t", F.when(F.pmod("source_order", F.lit(3)) == 0, F.lit("\n\nmore")).otherwise(F.lit("")))
    return T.parse_plain_text(cue_files(spark, sf, ".txt", "", cue)).select("path", "source_order", "start_ms", "end_ms", "timing_provenance", "normalized_text")


@query("""with p as (select doc_id, list_filter(string_split_regex(regexp_replace(text, '\\d', 'n', 'g'), '\\n\\s*\\n'), lambda x: not regexp_matches(x, '^\\s*$')) as parts from documents), u as (select doc_id, unnest(parts) as x, generate_subscripts(parts, 1) as i from p)
select doc_id || '.md' as path, (i - 1)::bigint as source_order, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\\n+|\\n+$', '', 'g'), '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')) as text_md5 from u""")
def parse_plain_paragraphs(spark, sf):
    files = table(spark, sf, "documents").select(F.concat("doc_id", F.lit(".md")).alias("path"), F.regexp_replace("text", r"\d", "n").alias("content"))
    return T.parse_plain_text(files).select("path", "source_order", F.md5("normalized_text").alias("text_md5"))


_NAME = "case doc_id % 8 when 0 then 'a.SRT' when 1 then 'b.ssa' when 2 then 'c' when 3 then 'd.json' when 4 then 'e' when 5 then 'f.md' when 6 then 'g' else 'h' end"
_BODY = "case doc_id % 8 when 2 then 'WEBVTT ' || text when 4 then chr(10) || '[Events]' || chr(10) || text when 6 then '{\"a\": 1}' when 7 then '1' || chr(10) || '00:01 --> 00:02' || chr(10) || text else text end"


@query("""select doc_id, case doc_id % 8 when 0 then 'srt' when 1 then 'ass' when 2 then 'vtt' when 3 then 'json' when 4 then 'ass' when 5 then 'text' when 6 then 'json' else 'srt' end as format from documents""")
def infer_subtitle_format(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.infer_format(F.expr(_NAME), F.expr(_BODY.replace("chr(10)", "char(10)"))).alias("format"))


@query("""select doc_id, case doc_id % 4 when 1 then 'utf-16' when 2 then 'utf-16-le' when 3 then 'cp1252' else 'utf-8-sig' end as encoding, md5(case when doc_id % 4 = 3 then 'caf' || chr(233) || ' ' || chr(8364) || ' ' || regexp_replace(text, '[^ -~]', '', 'g') when doc_id % 4 = 2 then regexp_replace(text, '[^ -~]', '', 'g') || ' ab' else text end) as text_md5 from documents""")
def decode_subtitle_bytes(spark, sf):
    """UTF-8, UTF-16 with a mark, UTF-16 without one, Windows-1252."""
    ascii_only = F.regexp_replace("text", "[^ -~]", "")
    content = (F.when(F.pmod("doc_id", F.lit(4)) == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(F.pmod("doc_id", F.lit(4)) == 2, F.encode(F.concat(ascii_only, F.lit(" ab")), "UTF-16LE"))
               .when(F.pmod("doc_id", F.lit(4)) == 3, F.concat(F.unhex(F.lit("636166E9208020")), F.encode(ascii_only, "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))))
    d = table(spark, sf, "documents").select("doc_id", T.decode(content).alias("d"))
    return d.select("doc_id", F.col("d.encoding").alias("encoding"), F.md5("d.text").alias("text_md5"))


@query(f"""with {_SEG}, k as (select *, case conv_id % 3 when 0 then 'srt' when 1 then 'ass' else 'text' end as f from seg)
select f as format, count(*) as cues, sum(start_ms)::bigint as starts, sum(length(t) + case f when 'ass' then 7 else 0 end)::bigint as letters from (select f, t, case when f = 'ass' then start_ms // 10 * 10 else start_ms end as start_ms from k) group by 1""")
def read_transcripts(spark, sf):
    """parse_transcript and parse_subtitle_text: each file by its own format, through its bytes."""
    srt = cue_files(spark, sf, ".srt", "", lambda s: F.concat_ws("\n", _times(","), "t", F.lit("")))
    ass = cue_files(spark, sf, ".ass", "[Events]\nFormat: Start, End, Text\n", lambda s: F.concat(F.lit("Dialogue: "), F.substring(_clock("start_ms"), 1, 11), F.lit(","), F.substring(_clock("end_ms"), 1, 11), F.lit(",x, "), "t", F.lit("\\Nend")))
    text = cue_files(spark, sf, ".txt", "", lambda s: F.concat(_clock("start_ms"), F.lit(": "), "t"))
    number = lambda df, k: df.where(F.pmod(F.regexp_extract("path", r"^(\d+)", 1).cast("long"), F.lit(3)) == k)
    files = number(srt, 0).union(number(ass, 1)).union(number(text, 2)).select("path", F.encode("content", "UTF-8").alias("content"))
    cues = T.read_transcripts(T.text_files(files)).withColumn("format", F.element_at(F.create_map(F.lit("srt"), F.lit("srt"), F.lit("ass"), F.lit("ass"), F.lit("txt"), F.lit("text")), F.regexp_extract("path", r"\.(\w+)$", 1)))
    return cues.groupBy("format").agg(F.count(F.lit(1)).alias("cues"), F.sum("start_ms").alias("starts"), F.sum(F.length("normalized_text")).cast("long").alias("letters"))
