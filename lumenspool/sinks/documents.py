"""Sinks: scripts as Markdown, tables as JSON with secrets hidden, packets a folder each, tables replaced by partition.

Writers are Spark's own, so commit and retry are too. A document is made from lines with an order key; lines of
one media meet in one row only at the end, where the media's document is wanted as one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspool.functions import columns as C
from lumenspool.functions import safety as S
from lumenspool.functions import text as X


def script_lines(media: DataFrame, chapters: DataFrame, blocks: DataFrame, reviews: DataFrame) -> DataFrame:
    """(media_id, part, chapter, place, line) of each media's script: front matter, chapters with their blocks in order, open reviews.

    media: media_id, title, status, language. chapters: media_id, chapter_id, title, start_ms. blocks: media_id, chapter_id, place, start_ms, end_ms, speaker, text, visual. reviews: media_id, review_id, reason.
    """
    row = lambda df, part, chapter, place, line: df.select("media_id", F.lit(part).alias("part"), chapter.alias("chapter"), place.cast("long").alias("place"), line.alias("line"))
    none, first = F.lit(""), F.lit(0)
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), X.yaml_scalar(F.col("title"))), F.concat(F.lit("status: "), X.yaml_scalar(F.col("status"))), F.concat(F.lit("language: "), X.yaml_scalar(F.col("language"))), F.lit("---"), F.concat(F.lit("# "), X.evidence_text(F.col("title"))))
    heading = F.concat(F.lit('## <a id="'), C.anchor(F.col("chapter_id")), F.lit('"></a>'), X.evidence_text(F.col("title")), F.lit(" ("), C.clock(F.col("start_ms")), F.lit(")"))
    shown = F.when(F.coalesce(F.trim("visual"), F.lit("")) != "", F.concat(F.lit("\n> "), X.evidence_text(F.regexp_replace("visual", r"\s*\n\s*", " ")))).otherwise("")
    said = F.concat(F.lit("**"), X.evidence_text(F.coalesce("speaker", F.lit("Speaker 1"))), F.lit("** ["), C.clock(F.col("start_ms")), F.lit(" - "), C.clock(F.col("end_ms")), F.lit("]\n"), X.evidence_text(F.coalesce("text", F.lit(""))), shown)
    item = F.concat(F.lit("- "), F.col("review_id"), F.lit(": "), X.evidence_text(F.col("reason")))
    parts = [row(media, 0, none, first, head), row(chapters, 1, F.col("chapter_id"), F.lit(-1), heading), row(blocks, 1, F.col("chapter_id"), F.col("place"), said),
             row(reviews.select("media_id").distinct(), 2, none, first, F.lit("## Open reviews")), row(reviews, 3, F.col("review_id"), first, item)]
    return reduce(DataFrame.union, parts)


def scripts(lines: DataFrame) -> DataFrame:
    """(media_id, text): a media's lines in order, an empty line between parts."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "chapter", "place", "line"))), lambda x: x["line"])
    return lines.groupBy("media_id").agg(F.concat(F.array_join(ordered, "\n\n"), F.lit("\n")).alias("text"))


def write_scripts(texts: DataFrame, path: str) -> None:
    """A folder a media with its script as text, replacing what was there for these media only."""
    texts.select("media_id", F.col("text").alias("value")).write.partitionBy("media_id").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n\n\n").mode("overwrite").text(path)


def write_script_lines(lines: DataFrame, path: str) -> None:
    """A folder a media with its script as text, written line by line in order, so that no row holds a media's document."""
    ordered = lines.repartition("media_id").sortWithinPartitions("media_id", "part", "chapter", "place")
    ordered.select("media_id", F.concat("line", F.lit("\n")).alias("value")).write.partitionBy("media_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").text(path)


def write_json(table: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    """A table as JSON lines, maps of texts and addresses with secrets hidden."""
    shown = [S.redact(F.col(f"`{n}`")).alias(n) if t == "map<string,string>" else S.hide_signature(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in table.dtypes]
    table.select(*shown).write.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def replace_rows(path: str, changed: DataFrame, partitions: tuple[str, ...]) -> None:
    """Writes the partitions that changed has, whole; others stay. changed must not be read from path."""
    changed.write.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
