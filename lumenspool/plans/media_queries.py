"""Registered queries of media sources and file listings, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspool.plans.registry import query
from lumenspool.sources import listing as L
from lumenspool.sources import media as M
from lumenspool.sources.adapters import table

_FILE = "case p_partkey % 12 when 0 then 'a.MP4' when 1 then 'b.mkv' when 2 then 'c.wav' when 3 then 'd.m4a' when 4 then 'e.srt' when 5 then 'f.SSA' when 6 then 'g.json' when 7 then 'h.md' when 8 then 'i.exe' when 9 then 'noext' when 10 then 'https://x.example.org/v' else 'http://127.0.0.1/v' end"


@query(f"""with p as (select p_partkey, p_name, {_FILE} as f from part), s as (select *, lower(regexp_extract(f, '\\.([^./\\\\]+)$', 1)) as x from p), k as (select *, case when x in ('mp4', 'mkv') then 'video' when x in ('wav', 'm4a') then 'audio' when x in ('srt', 'ssa') then 'subtitle' when x = 'json' then 'timestamped_transcript' when x = 'md' then 'plain_transcript' end as kind from s)
select p_partkey, kind, case when f like 'https://x%' then 'remote_media' when f like 'http://%' then null when kind in ('video', 'audio') then kind when kind is not null then 'transcript' end as input_kind from k""")
def source_kinds(spark, sf):
    """classify_local_source and classify_input."""
    f = F.expr(_FILE)
    return table(spark, sf, "part").select("p_partkey", M.source_kind(f).alias("kind"), M.input_kind(f).alias("input_kind"))


@query("select doc_id || '.txt' as path, 'plain_transcript' as kind, sha256(text) as content_hash, octet_length(encode(text))::bigint as byte_size, 'M' || upper(substr(sha256(text), 1, 16)) as media_id from documents")
def ingest_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return M.ingest(d.union(d.select(F.lit("x.exe"), "content").limit(1)))


# An order is a media, its items are streams in the order of part and ship date.
_STREAMS = """s as (select l_orderkey as o, (row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1)::int as i, l_quantity::int as q, l_suppkey as k from lineitem),
t as (select *, case when i % 3 = 2 then 'subtitle' when i % 3 = 1 then 'audio' else 'video' end as codec_type, case q % 5 when 0 then 'SubRip' when 1 then 'mov_text' when 2 then 'dvd_subtitle' when 3 then null else 'webvtt' end as codec,
 case q % 4 when 0 then '30000/1001' when 1 then '25' when 2 then '0/0' else '24/1' end as r, case q % 3 when 0 then '25/1' when 1 then '30/1' else '24/1' end as a from s)"""


def probes(spark, sf):
    """Probe reports (path, content) as in _STREAMS, with a chapter a stream."""
    i = table(spark, sf, "lineitem").select("l_orderkey", F.expr("row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1").alias("i"), F.col("l_quantity").cast("int").alias("q"), F.col("l_suppkey").alias("k"))
    stream = F.expr("""struct(i as index, case when i % 3 = 2 then 'subtitle' when i % 3 = 1 then 'audio' else 'video' end as codec_type, case q % 5 when 0 then 'SubRip' when 1 then 'mov_text' when 2 then 'dvd_subtitle' when 3 then null else 'webvtt' end as codec_name,
     concat(q, '.0004') as duration, case q % 4 when 0 then '30000/1001' when 1 then '25' when 2 then '0/0' else '24/1' end as r_frame_rate, case q % 3 when 0 then '25/1' when 1 then '30/1' else '24/1' end as avg_frame_rate,
     if(i % 3 = 0, 1280 + q, null) as width, if(i % 3 = 0, 720, null) as height, map('language', if(k % 2 = 0, 'en', 'fil'), 'title', if(k % 3 = 0, 'Auto generated', if(k % 3 = 1, 'Creator', 'x'))) as tags, if(q % 7 = 0, array(struct(-90.0 as rotation)), null) as side_data_list)""")
    chapter = F.expr("struct(i as id, concat(i, '.5') as start_time, concat(i + 1, '.5') as end_time, map('title', concat('Part ', q)) as tags)")
    g = i.select("l_orderkey", "i", F.to_json(stream).alias("s"), F.to_json(chapter).alias("c")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", "s", "c"))).alias("x"))
    part = lambda name: F.array_join(F.transform("x", lambda e: e[name]), ",")
    rest = F.to_json(F.struct(F.lit("mov,mp4").alias("format_name"), F.when(F.pmod("l_orderkey", F.lit(2)) == 0, F.lit("61.25")).alias("duration"), F.lit("800").alias("bit_rate")))
    return g.select(F.concat("l_orderkey", F.lit(".mp4")).alias("path"), F.concat(F.lit('{"streams":['), part("s"), F.lit('],"chapters":['), part("c"), F.lit('],"format":'), rest, F.lit("}")).alias("content"))


@query(f"""with {_STREAMS} select o || '.mp4' as path, i as "index", codec_type, codec as codec_name, (q * 1000)::bigint as duration_ms, r as r_frame_rate, a as avg_frame_rate, case when i % 3 = 0 then 1280 + q end as width, case when k % 2 = 0 then 'en' else 'fil' end as language, case when q % 7 = 0 then -90 else 0 end as rotation from t""")
def probe_streams(spark, sf):
    """parse_ffprobe_json: streams."""
    return M.probe_streams(probes(spark, sf)).select("path", "index", "codec_type", "codec_name", "duration_ms", "r_frame_rate", "avg_frame_rate", "width", "language", "rotation")


@query(f"""with {_STREAMS} select o || '.mp4' as path, i as position, case when i = 0 then i else i end as chapter_id, (i * 1000 + 500)::bigint as start_ms, (i * 1000 + 1500)::bigint as end_ms, 'Part ' || q as title from t""")
def probe_chapters(spark, sf):
    return M.probe_chapters(probes(spark, sf))


_VFR = "bool_or(abs(case r when '30000/1001' then 30000 / 1001 when '25' then 25 when '24/1' then 24 end - case a when '25/1' then 25 when '30/1' then 30 else 24 end) > 0.001)"


@query(f"""with {_STREAMS}, v as (select o, {_VFR} as variable from t where codec_type = 'video' group by 1), f as (select * from t where codec_type = 'video' qualify row_number() over (partition by o order by i) = 1)
select o || '.mp4' as path, case when o % 2 = 0 then 61250 else max(q * 1000) end::bigint as duration_ms, count_if(codec_type = 'video')::bigint as video_streams, count_if(codec_type = 'audio')::bigint as audio_streams, count_if(codec_type = 'subtitle')::bigint as subtitle_streams,
 any_value(f.r) as r_frame_rate, any_value(1280 + f.q)::int as width, any_value(case when f.q % 7 = 0 then -90 else 0 end)::int as rotation, any_value(v.variable) as variable, count(*) as chapters from t join v using (o) join (select o, r, q from f) f using (o) group by t.o""".replace("max(q *", "max(t.q *"))
def media_identity(spark, sf):
    """to_media_identity and variable_frame_rate."""
    p = probes(spark, sf)
    return M.media_identity(p, p.select("path")).select("path", "duration_ms", "video_streams", "audio_streams", "subtitle_streams", "r_frame_rate", F.col("resolution.width").alias("width"), "rotation", "variable", "chapters")


@query(f"""with {_STREAMS} select o || '.mp4' as path, i as "index", lower(coalesce(codec, 'unknown')) as codec, case lower(codec) when 'subrip' then 'srt' when 'mov_text' then 'srt' when 'webvtt' then 'webvtt' end as output_format, case when k % 2 = 0 then 'en' else 'fil' end as language, case k % 3 when 0 then 'Auto generated' when 1 then 'Creator' else 'x' end as title,
 case when k % 3 = 0 then 'automatic_caption' else 'embedded_human_subtitle' end as source_type, case k % 3 when 0 then 'auto_generated' when 1 then 'human' else 'unknown' end as authorship from t where codec_type = 'subtitle'""")
def embedded_tracks(spark, sf):
    """discover_embedded_subtitle_tracks."""
    return M.embedded_tracks(M.probe_streams(probes(spark, sf)))


@query("""select user_id || '.log' as path, (row_number() over (partition by user_id order by event_id) - 1)::int as output_index, (event_id * 512)::bigint as raw_pts, (event_id * 100 + event_id % 10)::bigint as actual_ms, '1/12800' as time_base, case when user_id % 2 = 0 then 640 end::int as width, case when user_id % 2 = 0 then 360 end::int as height from events""")
def frame_logs(spark, sf):
    """parse_showinfo, parse_survey_frame_timings, parse_scene_showinfo."""
    e = table(spark, sf, "events").withColumn("n", F.expr("row_number() over (partition by user_id order by event_id) - 1"))
    line = F.concat(F.lit("[Parsed_showinfo] n:   "), "n", F.lit(" pts:  "), F.col("event_id") * 512, F.lit(" pts_time:"), F.format_string("%d.%03d", F.floor((F.col("event_id") * 100 + F.pmod("event_id", F.lit(10))) / 1000), F.pmod(F.col("event_id") * 100 + F.pmod("event_id", F.lit(10)), F.lit(1000))),
                    F.lit(" pos: 1 fmt:yuv420p"), F.when(F.pmod("user_id", F.lit(2)) == 0, F.lit(" s:640x360 i:P")).otherwise(F.lit("")))
    logs = e.groupBy("user_id").agg(F.concat(F.lit("config in time_base: 1/12800, frame_rate: 25\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n")).alias("content"))
    return M.frame_log(logs.select(F.concat("user_id", F.lit(".log")).alias("path"), "content"))


_TEXT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"""with w as (select conv_id, turn, unnest(string_split({_TEXT}, ' ')) as word, generate_subscripts(string_split({_TEXT}, ' '), 1) as i from conversations), b as (select *, (turn * 7 + i) % 101 - 1 as conf, (i * 10)::int as l, (turn * 20)::int as t, (5 + i % 3)::int as wd, 12 as h from w where word <> ''),
l as (select conv_id, turn, string_agg(word, ' ' order by i) as line from b group by 1, 2), p as (select conv_id, string_agg(line, chr(10) order by turn) as raw from l group by 1)
select b.conv_id::varchar as frame_id, md5(any_value(raw)) as raw_md5, md5(any_value(raw)) as normalized_md5, round(avg(conf) filter (conf >= 0) / 100, 6) as confidence, min(l) as "left", min(t) as top, max(l + wd) - min(l) as width, max(t + h) - min(t) as height, count_if(conf < 80)::bigint as uncertain_words from b join p using (conv_id) group by 1""")
def recognised_pages(spark, sf):
    """parse_tesseract_tsv: words, lines, boxes and confidence."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("j", "word")).withColumn("i", F.col("j") + 1)
    row = F.concat_ws("\t", F.lit(5), F.lit(1), F.lit(1), F.lit(1), "turn", "i", F.col("i") * 10, F.col("turn") * 20, 5 + F.pmod("i", F.lit(3)), F.lit(12), F.pmod(F.col("turn") * 7 + F.col("i"), F.lit(101)) - 1, "word")
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    t = c.groupBy(F.col("conv_id").cast("string").alias("frame_id")).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "i", row.alias("r")))), lambda x: x["r"]), "\n")).alias("content"))
    p = M.recognised_pages(M.recognised_words(t))
    return p.select("frame_id", F.md5("raw_text").alias("raw_md5"), F.md5("normalized_text").alias("normalized_md5"), F.round("confidence", 6).alias("confidence"), "left", "top", "width", "height", "uncertain_words")


# A user is a folder: two thirds are projects, some of the rest have a generated footprint.
_LIST = """f as (select event_id, 'out/g' || user_id % 7 || '/u' || user_id as d, user_id, 1 + event_id % 97 as length, case event_type when 'view' then 'talk' || event_id % 5 || '.mp4' when 'click' then 'talk' || event_id % 5 || case event_id % 3 when 0 then '.srt' else '.VTT' end when 'signup' then '.state/cache/c' || event_id when 'error' then '.state/checkpoints/ocr/o' || event_id else 'notes/n' || event_id end as x from events),
listing as (select distinct d || '/' || x as path, (length(x) * 3 % 11)::bigint as length from f union select distinct d || '/.state/canonical-project.json', 10::bigint from f where user_id % 3 > 0)"""


def listing(spark, sf):
    d = F.concat(F.lit("out/g"), F.pmod("user_id", F.lit(7)), F.lit("/u"), "user_id")
    x = F.expr("case event_type when 'view' then 'talk' || event_id % 5 || '.mp4' when 'click' then 'talk' || event_id % 5 || case event_id % 3 when 0 then '.srt' else '.VTT' end when 'signup' then '.state/cache/c' || event_id when 'error' then '.state/checkpoints/ocr/o' || event_id else 'notes/n' || event_id end")
    f = table(spark, sf, "events").select(d.alias("d"), "user_id", x.alias("x"))
    return f.select(F.concat("d", F.lit("/"), "x").alias("path"), F.pmod(F.length("x") * 3, F.lit(11)).cast("long").alias("length")).union(
        f.where("user_id % 3 > 0").select(F.concat("d", F.lit(L.MARKER)), F.lit(10).cast("long"))).distinct()


@query(f"""with {_LIST}, v as (select path, regexp_replace(path, '\\.[^./]+$', '') as stem from listing where path like '%.mp4')
select v.path, l.path as sidecar, case when l.path like '%.srt' then 0 else 1 end::int as preference from v join listing l on regexp_replace(l.path, '\\.[^./]+$', '') = v.stem and (l.path like '%.srt' or l.path like '%.VTT') and l.length > 0""")
def sidecars(spark, sf):
    """discover_videos and discover_sidecars."""
    return L.sidecars(listing(spark, sf))


@query(f"""with {_LIST}, p as (select distinct regexp_extract(path, '^(.*)/\\.state/canonical', 1) as project from listing where path like '%/canonical-project.json')
select p.project, count(*) as files, sum(length)::bigint as bytes, count_if(path like '%/.state/cache/%' or path like '%/.state/checkpoints/ocr/%')::bigint as reclaimable_files, coalesce(sum(length) filter (path like '%/.state/cache/%' or path like '%/.state/checkpoints/ocr/%'), 0)::bigint as reclaimable_bytes from p join listing l on starts_with(l.path, p.project || '/') group by 1""")
def project_usage(spark, sf):
    """discover_projects, discover_review_projects, directory_usage."""
    files = listing(spark, sf)
    return L.usage(files, L.projects(files), "project")


_ORPHANS = """o as (select d as orphan, array_to_string(list_sort(list_distinct(list(m))), ',') as markers from (select regexp_extract(path, '^(.*?)/\\.state/', 1) as d, case when path like '%/.state/cache/%' then '.state/cache' else '.state/checkpoints' end as m from listing where path like '%/.state/cache/%' or path like '%/.state/checkpoints/%') where d || '/.state/canonical-project.json' not in (select path from listing) group by 1)"""


@query(f"with {_LIST}, {_ORPHANS} select * from o")
def orphan_trees(spark, sf):
    """discover_orphans."""
    return L.orphans(listing(spark, sf)).withColumn("markers", F.array_join("markers", ","))


@query(f"""with {_LIST}, {_ORPHANS}, k as (select path, length, regexp_extract(path, '^(out/g\\d/u\\d+)/', 1) as d, path like '%/.state/cache/%' or path like '%/.state/checkpoints/ocr/%' as free from listing), c as (select k.*, case when d || '/.state/canonical-project.json' in (select path from listing) then 'projects' when d in (select orphan from o) then 'orphans' else 'unclassified' end as kind from k)
select k.kind, case when k.kind = 'unclassified' then 0 else count(distinct d) end as trees, count(path) as files, coalesce(sum(length), 0)::bigint as bytes, case when k.kind = 'unclassified' then 0 else count_if(free) end::bigint as reclaimable_files, case when k.kind = 'unclassified' then 0 else coalesce(sum(length) filter (free), 0) end::bigint as reclaimable_bytes
 from (values ('projects'), ('orphans'), ('unclassified')) k(kind) left join c using (kind) group by 1""")
def retention_report(spark, sf):
    """retention_report and _unclassified_usage."""
    return L.retention_report(listing(spark, sf))


@query(f"""with {_LIST} select regexp_extract(path, '^(.*?)/\\.state/', 1) as project, 'ocr' as kind, count(*) as files, sum(length)::bigint as bytes from listing where path like '%/.state/checkpoints/ocr/%' group by 1""")
def compaction_plan(spark, sf):
    """compact_completed_checkpoints, as a plan."""
    return L.compaction_plan(listing(spark, sf))


@query("""with c as (select case when o_totalprice / 1000 <= 180 then 'short' when o_totalprice / 1000 <= 1800 then 'medium' else 'long' end as k, o_totalprice / 1000 as seconds, (o_orderkey % 9973 + 1) * 1000 as bytes, o_orderkey from orders), r as (select k, median(bytes / seconds) as rate from c where o_orderkey % 2 = 0 group by 1)
select o_orderkey, c.k as duration_class, least(5368709120, greatest(67108864, floor(greatest(1.0, seconds) * coalesce(r.rate, case c.k when 'short' then 1500000.0 when 'medium' then 400000.0 else 250000.0 end) * 1.5)))::bigint as bytes from c left join r on r.k = c.k""")
def size_forecast(spark, sf):
    """_historical_rates and estimate_project_bytes: median rate by duration class, joined back."""
    from lumenspool.functions import text as X
    from lumenspool.functions.timing import forecast_bytes
    from lumenspool.operators.quantiles import quantiles

    seconds = F.col("o_totalprice") / 1000
    c = table(spark, sf, "orders").select("o_orderkey", seconds.alias("seconds"), X.duration_class(seconds).alias("duration_class"), ((F.pmod("o_orderkey", F.lit(9973)) + 1) * 1000).alias("done"))
    rates = quantiles(c.where("o_orderkey % 2 = 0").withColumn("_rate", F.col("done") / F.col("seconds")), ["duration_class"], "_rate", {"rate": "median"})
    return c.join(F.broadcast(rates), "duration_class", "left").select("o_orderkey", "duration_class", forecast_bytes(F.col("seconds"), F.col("duration_class"), F.col("rate")).alias("bytes"))
