"""Media sources as tables: kinds of files, probe reports, decoder logs, recognised words, embedded tracks. Built-in expressions only.

Decoding and probing are done by outside programs; what they print is read here. Rows whose text does
not parse give nulls, never errors; nulls in give nulls out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspool.functions import columns as C
from lumenspool.functions import identity as I
from lumenspool.functions import safety as S
from lumenspool.functions import text as X

#: Suffixes by kind.
KINDS = {"mp4": "video", "mkv": "video", "mov": "video", "webm": "video", "wav": "audio", "flac": "audio", "mp3": "audio", "m4a": "audio", "srt": "subtitle", "vtt": "subtitle",
         "ass": "subtitle", "ssa": "subtitle", "json": "timestamped_transcript", "txt": "plain_transcript", "md": "plain_transcript"}
#: Subtitle codecs that can be read as text, and what they become.
TEXT_CODECS = {"ass": "ass", "ssa": "ass", "subrip": "srt", "srt": "srt", "text": "srt", "mov_text": "srt", "webvtt": "webvtt"}
_STREAM = ("index string, codec_type string, codec_name string, duration string, start_time string, time_base string, width string, height string, sample_aspect_ratio string, r_frame_rate string, "
           "avg_frame_rate string, channels string, sample_rate string, tags map<string,string>, disposition map<string,int>, side_data_list array<struct<rotation: string>>")
PROBE = f"streams array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _STREAM.split(', '))}>>, chapters array<struct<id: string, start_time: string, end_time: string, time_base: string, tags: map<string,string>>>, format struct<format_name: string, duration: string, size: string, bit_rate: string, tags: map<string,string>>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def source_kind(path: Column) -> Column:
    """Kind of a file by its suffix; null if it is not supported."""
    return C.lookup(suffix(path), KINDS)


def input_kind(value: Column) -> Column:
    """remote_media for an open http(s) address, else video, audio or transcript by suffix; null if not supported."""
    kind = source_kind(value)
    local = F.when(kind.isin("video", "audio"), kind).when(kind.isNotNull(), "transcript")
    return F.when(value.rlike("^https?://"), F.when(S.is_open_address(value), "remote_media")).otherwise(local)


def ingest(binary: DataFrame) -> DataFrame:
    """path, kind, content_hash, byte_size, media_id of Spark's binaryFile rows of supported kinds."""
    rows = binary.select("path", source_kind(F.col("path")).alias("kind"), F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("byte_size")).where("kind is not null")
    return rows.withColumn("media_id", I.media(F.col("content_hash")))


def _ms(text: Column) -> Column:
    return F.bround(text.try_cast("double") * 1000, 0).cast("long")


def rational(text: Column) -> Column:
    """struct(num, den) of 'a/b' or 'a'; null for anything else and for a zero denominator."""
    num, den = F.regexp_extract(text, r"^(-?\d+)(?:/(\d+))?$", 1).try_cast("long"), F.coalesce(F.nullif(F.regexp_extract(text, r"^(-?\d+)(?:/(\d+))?$", 2), F.lit("")).try_cast("long"), F.lit(1).cast("long"))
    return F.when(num.isNotNull() & (den != 0), F.struct(num.alias("num"), den.alias("den")))


def _numbered(streams: Column) -> Column:
    """The streams that have an index."""
    return F.filter(streams, lambda s: s["index"].try_cast("int").isNotNull())


def _rotation(s: Column) -> Column:
    """A stream's rotation: its tag, else the first one of its side data, else 0."""
    return F.coalesce(F.bround(F.element_at(s["tags"], F.lit("rotate")).try_cast("double"), 0).cast("int"),
                      F.element_at(F.filter(F.transform(s["side_data_list"], lambda x: F.bround(x["rotation"].try_cast("double"), 0).cast("int")), lambda x: x.isNotNull()), 1), F.lit(0))


def _kind(s: Column) -> Column:
    return F.coalesce(s["codec_type"], F.lit("unknown"))


def _varies(nominal: Column, average: Column) -> Column:
    return C.once(rational(nominal), lambda a: C.once(rational(average), lambda b: F.abs(a["num"] / a["den"] - b["num"] / b["den"]) > 0.001))


def probe_streams(files: DataFrame) -> DataFrame:
    """A row a stream of probe reports (path, content): path, index, codec_type, codec_name, duration_ms, start_ms, time_base, size, rates, language, rotation, tags, disposition."""
    s = files.select("path", F.explode(_numbered(F.from_json("content", PROBE)["streams"])).alias("s"))
    return s.select(
        "path", F.col("s.index").cast("int").alias("index"), _kind(F.col("s")).alias("codec_type"), F.nullif("s.codec_name", F.lit("")).alias("codec_name"),
        _ms(F.col("s.duration")).alias("duration_ms"), _ms(F.col("s.start_time")).alias("start_ms"), "s.time_base", F.col("s.width").try_cast("int").alias("width"), F.col("s.height").try_cast("int").alias("height"),
        "s.sample_aspect_ratio", "s.r_frame_rate", "s.avg_frame_rate", F.col("s.channels").try_cast("int").alias("channels"), F.col("s.sample_rate").try_cast("int").alias("sample_rate"),
        F.element_at("s.tags", F.lit("language")).alias("language"), _rotation(F.col("s")).alias("rotation"), "s.tags", "s.disposition")


def probe_chapters(files: DataFrame) -> DataFrame:
    """path, position, chapter_id, start_ms, end_ms, title of the chapters of probe reports."""
    c = files.select("path", F.posexplode(F.from_json("content", PROBE)["chapters"]).alias("position", "c"))
    number = F.coalesce(F.nullif(F.col("c.id").try_cast("int"), F.lit(0)), F.col("position"))
    return c.select("path", "position", number.alias("chapter_id"), _ms(F.col("c.start_time")).alias("start_ms"), _ms(F.col("c.end_time")).alias("end_ms"), F.nullif(F.element_at("c.tags", F.lit("title")), F.lit("")).alias("title"))


def variable_frame_rate(streams: DataFrame) -> DataFrame:
    """path, variable: whether a video stream's nominal and average rates differ by more than 0.001; null where none has both."""
    return streams.where("codec_type = 'video'").groupBy("path").agg(F.bool_or(_varies(F.col("r_frame_rate"), F.col("avg_frame_rate"))).alias("variable"))


def media_identity(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """A row a media: ingested columns, duration, container, bit rate, numbers of streams, first video stream's rates and size, rotation, chapters.

    A report is read once, and its streams are summed where it is read. Reports of one path are summed together, a row each.
    """
    parsed = files.where("path is not null").select("path", F.from_json("content", PROBE).alias("p"))
    lists = parsed.select("path", F.col("p.format").alias("f"), F.size(F.coalesce("p.chapters", F.array())).cast("long").alias("chapters"), F.coalesce(_numbered(F.col("p.streams")), F.array()).alias("s"))
    lists = lists.withColumn("videos", F.filter("s", lambda s: _kind(s) == "video"))
    lists = lists.withColumn("at", F.array_min(F.transform("videos", lambda s, i: F.struct(s["index"].cast("int").alias("index"), i.alias("i"))))).withColumn("v", F.get("videos", F.col("at.i")))
    v = F.struct("v.r_frame_rate", "v.avg_frame_rate", "v.time_base", F.col("v.width").try_cast("int").alias("width"), F.col("v.height").try_cast("int").alias("height"), _rotation(F.col("v")).alias("rotation"))
    first = F.when(F.col("at").isNotNull(), F.struct("at.index", "at.i", v.alias("v")))
    of = lambda kind: F.size(F.filter("s", lambda s: _kind(s) == kind)).cast("long").alias(f"{kind}_streams")
    each = lists.select("path", F.struct(_ms(F.col("f.duration")).alias("duration_ms"), F.col("f.format_name").alias("container"), F.col("f.bit_rate").try_cast("long").alias("bit_rate")).alias("f"), "chapters", F.size("videos").cast("long").alias("video_streams"), of("audio"), of("subtitle"),
                        F.array_max(F.transform("s", lambda s: _ms(s["duration"]))).alias("longest"), first.alias("first"), F.array_max(F.transform("videos", lambda s: _varies(s["r_frame_rate"], s["avg_frame_rate"]))).alias("variable"))
    counts = [f"{k}_streams" for k in ("video", "audio", "subtitle")]
    sums = each.groupBy("path").agg(F.collect_list("f").alias("f"), F.max("longest").alias("longest"), F.min("first").alias("first"), F.bool_or("variable").alias("variable"), *[F.sum(c).alias(c) for c in ("chapters", *counts)])
    rows = ingested.join(sums.withColumn("f", F.explode("f")).withColumn("v", F.col("first.v")), "path", "left")
    return rows.select(*ingested.columns, F.coalesce("f.duration_ms", "longest").alias("duration_ms"), "f.container", "f.bit_rate",
                       *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], "v.r_frame_rate", "v.avg_frame_rate", "v.time_base",
                       F.when((F.col("v.width") > 0) & (F.col("v.height") > 0), F.struct("v.width", "v.height")).alias("resolution"), "v.rotation", "variable", F.coalesce("chapters", F.lit(0).cast("long")).alias("chapters"))


def embedded_tracks(streams: DataFrame) -> DataFrame:
    """Subtitle streams: path, index, codec, output format (null: not supported as text), language, title, source_type, authorship."""
    tag = lambda name: F.element_at("tags", F.lit(name))
    rows = streams.where("codec_type = 'subtitle'").withColumn("codec", F.lower(F.coalesce("codec_name", F.lit("unknown"))))
    said = X.track_authorship(F.coalesce(tag("title"), F.lit("")), F.coalesce(tag("handler_name"), F.lit("")), F.coalesce(tag("comment"), F.lit("")))
    return rows.select("path", "index", "codec", C.lookup(F.col("codec"), TEXT_CODECS).alias("output_format"), "language", F.coalesce(F.nullif(tag("title"), F.lit("")), F.nullif(tag("handler_name"), F.lit(""))).alias("title"),
                       said["source_type"].alias("source_type"), said["authorship"].alias("authorship"))


def frame_log(logs: DataFrame) -> DataFrame:
    """Frames that a decoder's log (path, content) lists: path, output_index, raw_pts, actual_ms, time_base, width, height (null where the log has none)."""
    pattern = r"\bn:\s*(\d+)\s+pts:\s*(-?\d+)\s+pts_time:\s*(-?[0-9.eE+]+)(?:[^\n]*?\bs:\s*(\d+)x(\d+))?"
    part = lambda k: F.regexp_extract("m", pattern, k)
    base = F.nullif(F.regexp_extract("content", r"config in time_base:\s*(\d+/\d+)", 1), F.lit(""))
    rows = logs.select("path", base.alias("time_base"), F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("m"))
    ms = F.bround(part(3).try_cast("double").cast("decimal(30,9)") * 1000, 0).cast("long")
    return rows.select("path", part(1).cast("int").alias("output_index"), part(2).cast("long").alias("raw_pts"), ms.alias("actual_ms"), "time_base",
                       F.nullif(part(4), F.lit("")).cast("int").alias("width"), F.nullif(part(5), F.lit("")).cast("int").alias("height"))


def recognised_words(tables: DataFrame) -> DataFrame:
    """Words of a recogniser's tab-separated tables (frame_id, content): frame_id, page, block, par, line, word, box, confidence (null below 0), text. Quotes are plain marks."""
    lines = tables.select("frame_id", F.split(F.regexp_replace("content", "\r", ""), "\n").alias("lines"))
    rows = lines.select("frame_id", F.transform(F.split(F.get("lines", F.lit(0)), "\t"), F.lower).alias("names"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("position", "line"))
    rows = rows.withColumn("cells", F.split("line", "\t"))
    cell = lambda name: F.try_element_at("cells", F.array_position("names", name).cast("int"))
    text = F.when(F.array_position("names", "text") > 0, cell("text"))
    rows = rows.where(F.coalesce(text, F.lit("")).rlike(r"\S"))
    number = lambda name: cell(name).try_cast("int").alias(name.removesuffix("_num"))
    conf = cell("conf").try_cast("double")
    return rows.select("frame_id", "position", *[number(n) for n in ("page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")], F.when(conf >= 0, conf).alias("confidence"), text.alias("text"))


def recognised_pages(words: DataFrame, uncertain_below: float = 80.0) -> DataFrame:
    """A row a frame: raw_text (lines in order), normalized_text, confidence (0 to 1), bounding box, number of uncertain words."""
    lines = words.groupBy("frame_id", "page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("line_text"))
    text = lines.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block", "par", "line", "line_text"))), lambda x: x["line_text"]), "\n").alias("raw_text"))
    box = words.groupBy("frame_id").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"),
                                        (F.avg("confidence") / 100).alias("confidence"), F.count_if(F.col("confidence").isNull() | (F.col("confidence") < uncertain_below)).alias("uncertain_words"))
    return text.join(box, "frame_id").select("frame_id", "raw_text", X.recognized_text(F.col("raw_text")).alias("normalized_text"), "confidence", "left", "top", (F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"), "uncertain_words")
