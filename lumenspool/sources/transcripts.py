"""Caption and transcript files as tables: one row a cue from rows (path, content). Built-in expressions only.

SRT, WebVTT, ASS/SSA, JSON and plain text come out with one schema:
path, source_order, segment_id, start_ms, end_ms, timing_provenance, raw_text, normalized_text,
speaker_label, language, confidence, substantive. Cue formats are read by blocks of lines between blank
ones, ASS and plain text by lines, JSON by paths. Rows of one file meet only in windows over that file.

Defined cases: null and empty content has no cues; what does not parse raises, or goes with
``lenient``; a byte order mark and other line ends are understood; a word without own id gets one
derived from its segment. Extra columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.functions import columns as C
from lumenspool.functions import identity as I
from lumenspool.functions import text as X

COLUMNS = ("path", "source_order", "segment_id", "start_ms", "end_ms", "timing_provenance", "raw_text", "normalized_text", "speaker_label", "language", "confidence", "substantive")
#: Suffixes of transcript files.
SUFFIXES = {"srt": "srt", "vtt": "vtt", "ass": "ass", "ssa": "ass", "json": "json", "txt": "text", "md": "text"}
_CLOCK = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[,.]\d+)?"
CUE_TIMES = rf"^\s*({_CLOCK})\s*-->\s*({_CLOCK})(?:\s.*)?$"
LINE_RANGE = rf"^\s*[\[(]?({_CLOCK})\s*(?:-->|[-–—])\s*({_CLOCK})[\])]?\s*[:\-]?\s*(.*)$"
LINE_POINT = rf"^\s*[\[(]?({_CLOCK})(?:[\])]\s*|\s*[:\-]\s*)(.+)$"
#: Names under which JSON transcripts keep their records, in order.
RECORD_KEYS = ("segments", "cues", "captions", "transcript", "results")
ASS_FIELDS = ("Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text")
_UPPER_HALF = [(b, bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]


def decode(content: Column) -> Column:
    """struct(text, encoding) of bytes: UTF-8, UTF-16 where marked or likely, else Windows-1252; null where none fits without loss."""
    latin = F.decode(content, "ISO-8859-1")
    nulls, n = F.length(latin) - F.length(F.replace(latin, F.lit("\0"), F.lit(""))), F.length(latin)
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    likely = ~marked & (n > 0) & (nulls / n > 0.15)
    plain = lambda text: F.when(~F.contains(text, F.lit("\0")), text)
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^﻿", ""))
    even = F.pmod(n, F.lit(2)) == 0
    known = [(chr(b), c) for b, c in _UPPER_HALF if c]
    unknown = "[" + "".join(chr(b) for b, c in _UPPER_HALF if not c) + "]"
    windows = F.when(~latin.rlike(unknown), F.translate(latin, "".join(a for a, _ in known), "".join(c for _, c in known)))
    ladder = [("utf-8-sig", F.lit(True), utf8), ("utf-16", marked & even, F.decode(content, "UTF-16")), ("utf-16-le", likely & even, F.decode(content, "UTF-16LE")),
              ("utf-16-be", likely & even, F.decode(content, "UTF-16BE")), ("cp1252", F.lit(True), windows)]
    return F.coalesce(*[F.when(on & plain(text).isNotNull(), F.struct(plain(text).alias("text"), F.lit(name).alias("encoding"))) for name, on, text in ladder])


def _lines(content: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(content, "^﻿+", ""), "\r\n?", "\n"), "\n")


def infer_format(path: Column, content: Column) -> Column:
    """srt, vtt, ass, json or text: by suffix, else by content."""
    head = F.regexp_replace(content, "^[﻿ \t\r\n]+", "")
    json = head.rlike(r"^[\[{]") & F.try_parse_json(head).isNotNull()
    by_content = (F.when(head.startswith("WEBVTT"), "vtt").when(head.rlike(r"(?im)^\s*\[events\]\s*$"), "ass").when(json, "json")
                  .when(F.exists(F.split(head, "\r\n?|\n"), lambda line: line.rlike(CUE_TIMES)), "srt").otherwise("text"))
    return F.coalesce(C.lookup(F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1)), SUFFIXES), by_content)


def _finish(rows: DataFrame, order: list) -> DataFrame:
    """Numbers the cues of each file and adds what every format shares. rows: path, start_ms, end_ms, timing_provenance, raw_text, visible and, if known, the rest."""
    for name, kind in (("speaker_label", "string"), ("language", "string"), ("confidence", "double")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("source_order", (F.row_number().over(Window.partitionBy("path").orderBy(*order)) - 1).cast("long"))
    rows = rows.withColumns({"segment_id": I.sequential("transcript", F.col("source_order") + 1), "normalized_text": C.normalize_visible(F.col("visible"))})
    return rows.withColumn("substantive", F.col("normalized_text") != "").select(*COLUMNS)


def _or_raise(value: Column, why: str, lenient: bool) -> Column:
    return value if lenient else F.coalesce(value, F.raise_error(F.concat(F.lit(why + " in "), F.col("path"))).cast("string"))


def _cue_blocks(files: DataFrame, header: bool) -> DataFrame:
    """(path, block, lines): runs of lines that are not blank; with ``header`` the first line of the file goes if it says WEBVTT."""
    lines = _lines(F.col("content"))
    if header:
        lines = F.when(F.trim(lines[0]).startswith("WEBVTT"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    clean = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^\s*$"), F.lit("")).otherwise(x)), "\n")
    blocks = files.where("content is not null").select("path", F.posexplode(F.split(clean, "\n{2,}")).alias("block", "body"))
    return blocks.select("path", "block", F.filter(F.split("body", "\n"), lambda x: x != "").alias("lines")).where("size(lines) > 0")


def _timed(blocks: DataFrame, title: Column, kind: str, lenient: bool) -> DataFrame:
    """Blocks as cues: times on the first line, or on the second where ``title`` says that the first is a number or name."""
    at = F.when(title, 1).otherwise(0)
    timing = F.get("lines", at)
    rows = blocks.withColumns({"at": at, "timing": F.when(timing.rlike(CUE_TIMES), timing)})
    rows = rows.where("timing is not null") if lenient else rows.withColumn("timing", _or_raise(F.col("timing"), f"{kind} cue without times", False))
    raw = F.array_join(F.slice("lines", F.col("at") + 2, F.greatest(F.size("lines") - F.col("at") - 1, F.lit(0))), "\n")
    return rows.select("path", "block", C.parse_clock(F.regexp_extract("timing", CUE_TIMES, 1)).alias("start_ms"), C.parse_clock(F.regexp_extract("timing", CUE_TIMES, 2)).alias("end_ms"),
                       F.lit(f"source_{kind}").alias("timing_provenance"), raw.alias("raw_text"))


def parse_srt(files: DataFrame, lenient: bool = False) -> DataFrame:
    blocks = _cue_blocks(files, False)
    numbered = F.get("lines", F.lit(0)).rlike(r"^\s*\d+\s*$") & (F.size("lines") > 1)
    return _finish(_timed(blocks, numbered, "srt", lenient).withColumn("visible", F.col("raw_text")), ["block"])


def parse_vtt(files: DataFrame, lenient: bool = False) -> DataFrame:
    blocks = _cue_blocks(files, True).where(~F.get("lines", F.lit(0)).rlike(r"(?i)^\s*(NOTE|STYLE|REGION)(\s|$)"))
    named = ~F.get("lines", F.lit(0)).rlike(CUE_TIMES) & (F.size("lines") > 1)
    cues = _timed(blocks, named, "vtt", lenient)
    return _finish(cues.withColumns({"visible": X.without_cue_tags(F.col("raw_text")), "speaker_label": X.voice(F.col("raw_text"))}), ["block"])


def parse_ass(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Dialogue lines of the Events section by its latest Format line; override blocks go, line breaks and hard blanks are decoded."""
    lines = files.where("content is not null").select("path", F.posexplode(_lines(F.col("content"))).alias("pos", "line"))
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    bare = F.trim("line")
    lines = lines.withColumn("section", F.last(F.when(bare.rlike(r"^\[.*\]$"), F.lower(bare)), True).over(before)).where("section = '[events]'")
    lines = lines.withColumns({"key": F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))), "value": F.regexp_extract("line", r"^[^:]*:(.*)$", 1)}).where(~bare.startswith(";"))
    given = F.last(F.when(F.col("key") == "format", F.transform(F.split("value", ","), lambda x: F.lower(F.trim(x)))), True).over(before)
    rows = lines.withColumn("fields", F.coalesce(given, F.array(*[F.lit(x.lower()) for x in ASS_FIELDS]))).where("key = 'dialogue'")
    rows = rows.withColumn("parts", F.split(F.ltrim("value"), ",", F.size("fields")))
    rows = rows.withColumn("record", F.when(F.size("parts") == F.size("fields"), F.map_from_arrays("fields", "parts")))
    text = F.element_at("record", F.lit("text"))
    rows = rows.withColumn("raw_text", _or_raise(text, "malformed dialogue", lenient)).where("raw_text is not null")
    visible = F.regexp_replace("raw_text", r"\{[^{}]*\}", "")
    for a, b in (("\\N", "\n"), ("\\n", "\n"), ("\\h", " ")):
        visible = F.replace(visible, F.lit(a), F.lit(b))
    at = lambda name: C.parse_clock(F.element_at("record", F.lit(name)))
    return _finish(rows.select("path", "pos", at("start").alias("start_ms"), at("end").alias("end_ms"), F.lit("source_ass").alias("timing_provenance"), "raw_text", visible.alias("visible"),
                               F.nullif(F.trim(F.element_at("record", F.lit("name"))), F.lit("")).alias("speaker_label")), ["pos"])


def _get(record: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", kind)


def json_records(content: Column) -> tuple[Column, Column, Column]:
    """(records array<variant>, document language, document time unit) of a JSON transcript: a list, a list under a known name, or one record."""
    doc = F.parse_json(content)
    lists = [F.try_variant_get(doc, f"$.{k}", "array<variant>") for k in RECORD_KEYS]
    one = F.when(reduce(lambda a, b: a | b, [F.try_variant_get(doc, f"$.{k}", "variant").isNotNull() for k in ("text", "raw_text", "transcript")]), F.array(doc))
    found = F.coalesce(*lists)
    records = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.when(F.size(found) > 0, found), one, found)
    return records, F.coalesce(F.nullif(_get(doc, "language", "string"), F.lit("")), _get(doc, "lang", "string")), F.coalesce(_get(doc, "time_unit", "string"), F.lit("seconds"))


def json_time(record: Column, base: str, unit: Column) -> Column:
    """Milliseconds of a boundary: an _ms field, else a clock or a number in the unit (seconds unless it says milliseconds); rounded half to even."""
    exact = F.bround(_get(record, f"{base}_ms", "double"), 0).cast("long")
    value = F.coalesce(_get(record, base, "string"), _get(record, f"{base}_time", "string"))
    number = value.try_cast("double")
    return F.coalesce(exact, F.when(F.contains(value, F.lit(":")), C.parse_clock(value)).otherwise(F.bround(F.when(unit.isin("ms", "millisecond", "milliseconds"), number).otherwise(number * 1000), 0).cast("long")))


def _json_rows(files: DataFrame) -> DataFrame:
    rows = files.where("content is not null and trim(content) <> ''")
    records, language, unit = json_records(F.col("content"))
    rows = rows.select("path", language.alias("doc_language"), unit.alias("doc_unit"), F.posexplode(records).alias("pos", "r"))
    r = F.col("r")
    listed = F.array_join(F.coalesce(F.try_variant_get(r, "$.raw_text", "array<string>"), F.try_variant_get(r, "$.text", "array<string>"), F.try_variant_get(r, "$.transcript", "array<string>")), " ")
    texts = F.coalesce(listed, _get(r, "raw_text", "string"), _get(r, "text", "string"), _get(r, "transcript", "string"), F.lit(""))
    rows = rows.withColumns({"raw_text": texts, "unit": F.lower(F.coalesce(_get(r, "time_unit", "string"), "doc_unit"))})
    rows = rows.withColumns({"start_ms": json_time(r, "start", F.col("unit")), "given_end": json_time(r, "end", F.col("unit"))})
    scale = F.when(F.col("unit").startswith("ms") | F.col("unit").startswith("milli"), 1).otherwise(1000)
    lasting = F.col("start_ms") + F.bround(_get(r, "duration", "double") * scale, 0).cast("long")
    return rows.select("path", "pos", "start_ms", F.coalesce("given_end", lasting).alias("end_ms"), F.when(F.col("start_ms").isNotNull(), "source_json").otherwise("untimed_source").alias("timing_provenance"),
                       "raw_text", F.coalesce(_get(r, "normalized_text", "string"), "raw_text").alias("visible"), _get(r, "speaker", "string").alias("speaker_label"),
                       F.coalesce(_get(r, "language", "string"), "doc_language").alias("language"), _get(r, "confidence", "double").alias("confidence"), F.try_variant_get(r, "$.words", "array<variant>").alias("words"), "unit")


def parse_json_transcript(files: DataFrame) -> DataFrame:
    return _finish(_json_rows(files), ["pos"])


def json_words(files: DataFrame) -> DataFrame:
    """(path, source_order, word_order, word_id, text, start_ms, end_ms, confidence) of the words that JSON records list."""
    rows = _json_rows(files).select("path", F.col("pos").cast("long").alias("source_order"), "unit", F.posexplode("words").alias("word_order", "w"))
    w = F.col("w")
    unit = F.lower(F.coalesce(_get(w, "time_unit", "string"), "unit"))
    rows = rows.select("path", "source_order", "word_order", _get(w, "word_id", "string").alias("given"), F.coalesce(_get(w, "text", "string"), _get(w, "word", "string"), F.lit("")).alias("text"),
                       json_time(w, "start", unit).alias("start_ms"), json_time(w, "end", unit).alias("end_ms"), _get(w, "confidence", "double").alias("confidence"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    own = I.deterministic("word", I.sequential("transcript", F.col("source_order") + 1), F.col("word_order"), shown("start_ms"), shown("end_ms"), F.col("text"))
    return rows.withColumn("word_id", F.coalesce("given", own)).select("path", "source_order", "word_order", "word_id", "text", "start_ms", "end_ms", "confidence")


def parse_plain_text(files: DataFrame) -> DataFrame:
    """Lines that begin with a time or range start cues and take the lines that follow; without any such line, paragraphs without times."""
    rows = files.where("content is not null").select("path", _lines(F.col("content")).alias("lines"))
    timed = F.exists("lines", lambda x: x.rlike(LINE_RANGE) | x.rlike(LINE_POINT))
    rows = rows.withColumn("timed", timed)
    lines = rows.where("timed").select("path", F.posexplode("lines").alias("pos", "line")).where(~F.col("line").rlike(r"^\s*$"))
    ranged, point = F.col("line").rlike(LINE_RANGE), F.col("line").rlike(LINE_POINT)
    lines = lines.withColumns({
        "start_ms": F.when(ranged, C.parse_clock(F.regexp_extract("line", LINE_RANGE, 1))).when(point, C.parse_clock(F.regexp_extract("line", LINE_POINT, 1))),
        "end_ms": F.when(ranged, C.parse_clock(F.regexp_extract("line", LINE_RANGE, 2))),
        "kind": F.when(ranged, "source_text_range").when(point, "source_text_point"),
        "part": F.when(ranged, F.regexp_extract("line", LINE_RANGE, 3)).when(point, F.regexp_extract("line", LINE_POINT, 2)).otherwise(F.col("line")),
    })
    run = F.count("kind").over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    cues = lines.withColumn("run", run).groupBy("path", "run").agg(
        F.min("pos").alias("pos"), F.first("start_ms", True).alias("start_ms"), F.first("end_ms", True).alias("end_ms"), F.coalesce(F.first("kind", True), F.lit("untimed_source")).alias("timing_provenance"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n").alias("raw_text"))
    cues = cues.select("path", "pos", "start_ms", "end_ms", "timing_provenance", "raw_text")
    paragraphs = rows.where("not timed").select("path", F.posexplode(F.split(F.array_join("lines", "\n"), r"\n\s*\n")).alias("pos", "body")).where(~F.col("body").rlike(r"^\s*$"))
    none = F.lit(None).cast("long")
    paragraphs = paragraphs.select("path", "pos", none.alias("start_ms"), none.alias("end_ms"), F.lit("untimed_source").alias("timing_provenance"), F.regexp_replace("body", r"^\n+|\n+$", "").alias("raw_text"))
    both = cues.unionByName(paragraphs)
    return _finish(both.withColumn("visible", F.col("raw_text")), ["pos"])


def read_transcripts(files: DataFrame, lenient: bool = False) -> DataFrame:
    """All cues of rows (path, content) by each file's own format. files may come from ``text_files``."""
    files = files.select("path", "content", infer_format(F.col("path"), F.col("content")).alias("format"))
    of = lambda kind: files.where(F.col("format") == kind)
    parts = [parse_srt(of("srt"), lenient), parse_vtt(of("vtt"), lenient), parse_ass(of("ass"), lenient), parse_json_transcript(of("json")), parse_plain_text(of("text"))]
    return reduce(DataFrame.unionByName, parts)


def text_files(binary: DataFrame, lenient: bool = False) -> DataFrame:
    """(path, content, encoding) of Spark's binaryFile rows (path, content)."""
    rows = binary.select("path", decode(F.col("content")).alias("d"))
    text = _or_raise(F.col("d.text"), "encoding not known without loss", lenient)
    return rows.select("path", text.alias("content"), F.col("d.encoding").alias("encoding"))
