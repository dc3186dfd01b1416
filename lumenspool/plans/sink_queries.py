"""Registered queries of sinks, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspool.plans.catalog import SEG
from lumenspool.plans.registry import query
from lumenspool.sinks import documents as W
from lumenspool.sources import adapters as A

_ESC = "replace(replace(regexp_replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?m)^(\\s{{0,3}})([#>-]|[0-9]+[.)])', '\\1\\\\\\2', 'g'), '[', '\\['), ']', '\\]')"
_CLOCK = "printf('%02d:%02d:%02d.%03d', {x} // 3600000, ({x} // 60000) % 60, ({x} // 1000) % 60, {x} % 1000)"


@query(f"""with {SEG}, b as (select *, 'C' || lpad((start_ms // 600000 + 1)::varchar, 3, '0') as chapter_id from segments), l as (select distinct media_id, 0 as part, '' as chapter, 0 as place, '---' || chr(10) || 'title: "Talk \\"' || media_id || '\\""' || chr(10) || 'status: "review_required"' || chr(10) || 'language: "en"' || chr(10) || '---' || chr(10) || '# Talk "' || media_id || '"' as line from b
 union all select distinct media_id, 1, chapter_id, -1, '## <a id="' || lower(chapter_id) || '"></a>Part ' || chapter_id || ' (' || {_CLOCK.format(x="(substr(chapter_id, 2)::int - 1) * 600000")} || ')' from b
 union all select media_id, 1, chapter_id, source_order, '**' || speaker || '** [' || {_CLOCK.format(x="start_ms")} || ' - ' || {_CLOCK.format(x="end_ms")} || ']' || chr(10) || {_ESC.format(x="raw_text")} || case when source_order % 3 = 0 then chr(10) || '> seen \\[x\\] &lt;b&gt;' else '' end from b
 union all select distinct media_id, 2, '', 0, '## Open reviews' from b where source_order % 5 = 1 union all select media_id, 3, 'R' || lpad(source_order::varchar, 6, '0'), 0, '- R' || lpad(source_order::varchar, 6, '0') || ': check' from b where source_order % 5 = 1)
select media_id, md5(string_agg(line, chr(10) || chr(10) order by part, chapter, place) || chr(10)) as text_md5 from l group by 1""")
def render_markdown(spark, sf):
    """render_markdown: front matter, chapters, blocks in order, open reviews, all wordings escaped."""
    s = A.segments(spark, sf).withColumn("chapter_id", F.format_string("C%03d", F.floor(F.col("start_ms") / 600_000) + 1))
    media = s.select("media_id").distinct().select("media_id", F.concat(F.lit('Talk "'), "media_id", F.lit('"')).alias("title"), F.lit("review_required").alias("status"), F.lit("en").alias("language"))
    chapters = s.select("media_id", "chapter_id").distinct().select("media_id", "chapter_id", F.concat(F.lit("Part "), "chapter_id").alias("title"), ((F.substring("chapter_id", 2, 9).cast("long") - 1) * 600_000).alias("start_ms"))
    blocks = s.select("media_id", "chapter_id", F.col("source_order").alias("place"), "start_ms", "end_ms", "speaker", F.col("raw_text").alias("text"), F.when(F.pmod("source_order", F.lit(3)) == 0, "seen [x]\n <b>").alias("visual"))
    reviews = s.where("source_order % 5 = 1").select("media_id", F.format_string("R%06d", "source_order").alias("review_id"), F.lit("check").alias("reason"))
    return W.scripts(W.script_lines(media, chapters, blocks, reviews)).select("media_id", F.md5("text").alias("text_md5"))
