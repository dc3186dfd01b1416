"""Registered queries of text, identity and safety columns, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspool.functions import columns as C
from lumenspool.functions import identity as I
from lumenspool.functions import safety as S
from lumenspool.functions import text as X
from lumenspool.plans.registry import query
from lumenspool.sources.adapters import table

_AUDIT = "(?i)\\b[0-9]+(?:[.,:][0-9]+)*(?:%|mg|kg|ml|gb|mb|px|ms|s)?\\b|https?://\\S+|\\b\\S+@\\S+\\.\\S+\\b|--?[A-Za-z][\\p{L}\\p{N}_-]*|(?:[A-Za-z]:\\\\|/)\\S+"
_REBUILD = "(?i)https?://\\S+|\\b[^\\s@]+@[^\\s@]+\\.[^\\s@]+\\b|(?:[A-Za-z]:[\\\\/]|/)\\S+|--?[A-Za-z][\\p{L}\\p{N}_-]*|\\b[0-9]+(?:[.,:][0-9]+)*(?:%|mg|kg|cm|mm|ml|gb|mb|kb)?\\b"
# The oracle marks a slash after a blank, since its dialect has no lookbehind.
_ORDERED = "(?i)https?://\\S+|[A-Za-z]:[\\\\/]\\S+|\u0001/\\S+|--?[A-Za-z][\\p{L}\\p{N}_-]*|[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*(?:[.,:][0-9]+)*(?:%|mg|kg|cm|mm|ml|gb|mb|kb)?|[^\\p{L}\\p{N}_\\s\u0001]"


def _joined(tokens):
    return F.md5(F.array_join(tokens, "\n"))


@query(f"""with t as (select doc_id, text, regexp_replace(text, '(^|\\s)/', '\\1' || chr(1) || '/', 'g') as marked from documents),
h as (select doc_id, regexp_extract_all(text, '{_AUDIT}') as a, list_transform(regexp_extract_all(text, '{_REBUILD}'), lambda x: regexp_replace(x, '[.,;!?]+$', '')) as r,
 list_transform(regexp_extract_all(marked, '{_ORDERED}'), lambda x: replace(x, chr(1), '')) as o from t)
select doc_id, len(a)::int as audit_n, md5(array_to_string(a, chr(10))) as audit_md5, len(r)::int as rebuild_n, md5(array_to_string(r, chr(10))) as rebuild_md5,
 len(list_filter(o, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]') or x[1] in ('/', '-')))::int as ordered_n, md5(array_to_string(list_transform(list_filter(o, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]') or x[1] in ('/', '-')), lambda x: lower(x)), chr(10))) as ordered_md5 from h""")
def token_rules(spark, sf):
    """audit and reconstruction high-impact tokens, ordered tokens."""
    t = F.col("text")
    d = table(spark, sf, "documents").select("doc_id", X.audit_high_impact(t).alias("a"), X.rebuild_high_impact(t).alias("r"), X.ordered_tokens(t).alias("o"))
    return d.select("doc_id", F.size("a").alias("audit_n"), _joined("a").alias("audit_md5"), F.size("r").alias("rebuild_n"), _joined("r").alias("rebuild_md5"), F.size("o").alias("ordered_n"), _joined("o").alias("ordered_md5"))


_WORDINGS = """w as (select conv_id, turn, case when (conv_id + turn) % 7 = 0 then '[human] ' || text end as human, case when (conv_id + turn) % 5 = 0 then '' when (conv_id + turn) % 5 = 1 then text || ' [fixed]' end as repaired,
 case when turn % 3 = 0 then trim(text) end as normalized, case when (conv_id + turn) % 4 = 0 then '   ' else '  ' || text || '  ' end as raw from conversations)"""


def wordings(spark, sf):
    """Segments with several wordings: conv_id, turn, human, repaired, normalized, raw."""
    k = F.col("conv_id") + F.col("turn")
    mod = lambda n: F.pmod(k, F.lit(n))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(mod(7) == 0, F.concat(F.lit("[human] "), "text")).alias("human"), F.when(mod(5) == 0, "").when(mod(5) == 1, F.concat("text", F.lit(" [fixed]"))).alias("repaired"),
        F.when(F.pmod("turn", F.lit(3)) == 0, F.trim("text")).alias("normalized"), F.when(mod(4) == 0, "   ").otherwise(F.concat(F.lit("  "), "text", F.lit("  "))).alias("raw"))


@query(f"""with {_WORDINGS} select conv_id, turn, md5(coalesce(human, repaired, normalized, raw, '')) as given_md5, md5(coalesce(nullif(human, ''), nullif(repaired, ''), nullif(normalized, ''), nullif(raw, ''), '')) as filled_md5,
 md5(coalesce(nullif(trim(raw, ' ' || chr(9) || chr(10)), ''), nullif(trim(human), ''), nullif(trim(normalized), ''), '')) as visible_md5 from w""")
def wording_precedence(spark, sf):
    """segment_text, the audit's and renderer's precedence, the diarization's precedence."""
    c = F.col
    return wordings(spark, sf).select("conv_id", "turn", F.md5(X.first_given(c("human"), c("repaired"), c("normalized"), c("raw"))).alias("given_md5"),
                                      F.md5(X.first_filled(c("human"), c("repaired"), c("normalized"), c("raw"))).alias("filled_md5"), F.md5(X.first_visible(c("raw"), c("human"), c("normalized"))).alias("visible_md5"))


@query("""select doc_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> ''), chr(10))) as recognized_md5,
 md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as comparable_md5,
 md5(replace(replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?m)^(\\s{0,3})([#>-]|[0-9]+[.)])', '\\1\\\\\\2', 'g'), '[', '\\['), ']', '\\]')) as evidence_md5,
 md5('"' || replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(13), ' '), chr(10), ' ') || '"') as yaml_md5,
 md5(repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: len(x))), 0) + 1)::int) || 'text' || chr(10) || text || chr(10) || repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: len(x))), 0) + 1)::int)) as fenced_md5,
 case when n_chars <= 180 then 'short' when n_chars <= 1800 then 'medium' else 'long' end as duration_class from documents""")
def text_rendering(spark, sf):
    """normalize_ocr_text, normalize_ocr_for_comparison, safe_evidence_text, yaml_scalar, safe_fenced_block, _duration_class."""
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(X.recognized_text(t)).alias("recognized_md5"), F.md5(X.comparable(t)).alias("comparable_md5"), F.md5(X.evidence_text(t)).alias("evidence_md5"),
        F.md5(X.yaml_scalar(t)).alias("yaml_md5"), F.md5(X.fenced_block(t)).alias("fenced_md5"), X.duration_class(F.col("n_chars")).alias("duration_class"))


_TAGS = "case p_partkey % 4 when 0 then p_type || ' (auto)' when 1 then 'Official ' || p_name when 2 then 'speech to text' else p_name end"


@query(f"""with t as (select p_partkey, p_name, p_brand, {_TAGS} as title from part)
select p_partkey, case when regexp_matches(title || ' ' || p_brand, '(?i)\\b(auto|automatic|generated|speech[- ]to[- ]text)\\b') then 'automatic_caption' else 'embedded_human_subtitle' end as source_type,
 case when regexp_matches(title || ' ' || p_brand, '(?i)\\b(auto|automatic|generated|speech[- ]to[- ]text)\\b') then 'auto_generated' when regexp_matches(title || ' ' || p_brand, '(?i)\\b(human|manual|official|creator)\\b') then 'human' else 'unknown' end as authorship,
 coalesce(nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), ''), 'track') as label, lower(trim(p_brand)) as token from t""")
def track_labels(spark, sf):
    """_track_authorship, safe_track_label, _normalized_token."""
    p = table(spark, sf, "part").withColumn("title", F.expr(_TAGS.replace("||", "||")))
    said = X.track_authorship(F.col("title"), F.col("p_brand"))
    return p.select("p_partkey", said["source_type"].alias("source_type"), said["authorship"].alias("authorship"), X.track_label(F.col("title")).alias("label"), X.normalized_token(F.col("p_brand")).alias("token"))


@query("""with t as (select doc_id, case when doc_id % 3 = 0 then '<v.loud Ann Lee>' when doc_id % 3 = 1 then ' <v  Bo >' else '' end || '<b>' || text || '</b> <c.red>a &lt; b &amp;amp; c</c>' as x from documents)
select doc_id, nullif(trim(regexp_extract(x, '(?i)^\\s*<v\\s+([^>]+)>', 1)), '') as voice, md5(replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?i)</?(?:c(?:\\.[^ >]+)?|v(?:\\s+[^>]*)?|lang(?:\\s+[^>]*)?|ruby|rt|b|i|u)>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&')) as plain_md5 from t""")
def cue_tags(spark, sf):
    """_clean_vtt_text: voice and plain text."""
    x = F.expr("case when doc_id % 3 = 0 then '<v.loud Ann Lee>' when doc_id % 3 = 1 then ' <v  Bo >' else '' end || '<b>' || text || '</b> <c.red>a &lt; b &amp;amp; c</c>'")
    return table(spark, sf, "documents").select("doc_id", X.voice(x).alias("voice"), F.md5(X.without_cue_tags(x)).alias("plain_md5"))


_ID = "case event_id % 6 when 0 then 'F' || lpad(event_id::varchar, 6, '0') when 1 then 'IC000000' when 2 then 'C' || lpad((event_id % 999 + 1)::varchar, 3, '0') when 3 then 'M' || upper(substr(sha256(event_type), 1, 16)) when 4 then 'RUN' || event_id else 'T12345' end"


@query(f"""with e as (select *, (epoch_us(ts) // 1000) % 200000000 as ms, {_ID} as given from events), f as (select *, unhex(lpad(to_hex(octet_length(encode(event_type))), 16, '0')) || encode(event_type) || unhex(lpad(to_hex(length(user_id::varchar)), 16, '0')) || encode(user_id::varchar) as framed from e)
select event_id, 'W' || lpad((('0x' || substr(sha256(framed), 1, 16))::ubigint % 999999 + 1)::varchar, 6, '0') as word_id, case when event_id >= 1 then 'V' || lpad(event_id::varchar, greatest(6, length(event_id::varchar))::int, '0') end as sequential,
 case when regexp_matches(given, '^F[0-9]{{6}}$') and regexp_matches(given, '[1-9]') then 'frame' when regexp_matches(given, '^C[0-9]{{3}}$') then 'chapter' when regexp_matches(given, '^M[0-9A-F]{{16}}$') then 'media' when regexp_matches(given, '^RUN[0-9]{{6}}$') and regexp_matches(given, '[1-9]') then 'run' end as namespace,
 case when regexp_matches(given, '^F[0-9]{{6}}$') and regexp_matches(given, '[1-9]') then substr(given, 2)::bigint when regexp_matches(given, '^C[0-9]{{3}}$') then substr(given, 2)::bigint when regexp_matches(given, '^RUN[0-9]{{6}}$') then substr(given, 4)::bigint end as number,
 printf('%02d-%02d-%02d-%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) as slug,
 case when event_id % 3 = 0 then 'own' || event_id else event_type || '_' || substr(sha256('["' || event_type || '",' || event_id || ',' || ms || ',null]'), 1, 16) end as source_id,
 sha256('{{"event":"' || event_type || '","id":' || event_id || ',"missing":null}}') as cache_key from f""")
def identifiers(spark, sf):
    """deterministic_id, sequential_id, validate_id, parse_id, timestamp_slug, _source_id, cache_key, canonical digests."""
    e = table(spark, sf, "events").withColumn("ms", F.expr("unix_millis(cast(ts as timestamp)) % 200000000"))
    given = F.expr("case event_id % 6 when 0 then 'F' || lpad(event_id, 6, '0') when 1 then 'IC000000' when 2 then 'C' || lpad(event_id % 999 + 1, 3, '0') when 3 then 'M' || upper(substr(sha2(event_type, 256), 1, 16)) when 4 then 'RUN' || event_id else 'T12345' end")
    e = e.withColumn("given", given)
    return e.select(
        "event_id", I.deterministic("word", F.col("event_type"), F.col("user_id")).alias("word_id"), I.sequential("visual_event", F.col("event_id")).alias("sequential"),
        I.namespace_of(F.col("given")).alias("namespace"), I.number_of(F.col("given")).alias("number"), I.timestamp_slug(F.col("ms")).alias("slug"),
        I.source_id(F.col("event_type"), F.col("event_id"), F.col("ms"), F.lit(None), F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("own"), "event_id"))).alias("source_id"),
        I.cache_key({"event": I.json_text(F.col("event_type")), "id": F.col("event_id").cast("string"), "missing": F.lit(None).cast("string")}).alias("cache_key"))


_URL = """case page_id % 9 when 0 then url when 1 then 'http://10.0.0.' || (page_id % 256) || '/a' when 2 then 'https://LOCALHOST:80/x' when 3 then 'ftp://files.example.org/x' when 4 then 'https://u@8.8.4.4/q?sig=abc&x=1'
 when 5 then 'http://172.' || (page_id % 40) || '.1.1/' when 6 then 'http://[fe80::1]/x' when 7 then 'http://198.51.100.7/' else 'https://cdn.example.org/v?page=' || page_id || '#t' end"""
_HOST = "lower(regexp_replace(regexp_extract(u, '(?i)^https?://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1), '^\\[|\\]$|\\.$', '', 'g'))"


@query(f"""with p as (select page_id, {_URL} as u from pages), h as (select *, {_HOST} as host from p), o as (select *, try_cast(nullif(regexp_extract(host, '^(\\d{{1,3}})\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$', 1), '') as int) as a, try_cast(nullif(regexp_extract(host, '^\\d{{1,3}}\\.(\\d{{1,3}})\\.\\d{{1,3}}\\.\\d{{1,3}}$', 1), '') as int) as b, try_cast(nullif(regexp_extract(host, '^\\d{{1,3}}\\.\\d{{1,3}}\\.(\\d{{1,3}})\\.\\d{{1,3}}$', 1), '') as int) as c from h)
select page_id, host, host <> '' and host not in ('localhost', 'localhost.localdomain') and not coalesce(a >= 224 or a in (0, 10, 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 198 and b between 18 and 19) or (a = 192 and b = 0 and c in (0, 2)) or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113), false)
 and not (contains(host, ':') and regexp_matches(host, '^(::1?$|f[cd]|fe[89ab]|ff)')) as open,
 case when regexp_matches(u, '^https?://[^?#]*\\?[^#]*(?i:signature|sig|token|key|credential|expires|x-amz-[^=]+)') then regexp_replace(u, '^(https?://[^?#]*\\?)[^#]*', '\\1[REDACTED]') else u end as shown from o""")
def remote_addresses(spark, sf):
    """validate_remote_url and the address part of redact."""
    p = table(spark, sf, "pages").withColumn("u", F.expr(_URL))
    return p.select("page_id", S.host(F.col("u")).alias("host"), S.is_open_address(F.col("u")).alias("open"), S.hide_signature(F.col("u")).alias("shown"))


@query("""with e as (select event_id, event_type, props, props ->> 'k' as k from events)
select event_id, '{"k":"' || k || '","client_secret":"[REDACTED]","link":"https://a.b/c?[REDACTED]","Auth-Token":"[REDACTED]"}' as redacted,
 '[REDACTED_PATH], x=' || event_type || ', [REDACTED]' as note, '[REDACTED]' as home from e""")
def redacted_maps(spark, sf):
    """redact and sanitize_diagnostic_value over maps."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    fields = F.create_map(F.lit("k"), F.col("k"), F.lit("client_secret"), F.col("event_type"), F.lit("link"), F.concat(F.lit("https://a.b/c?Expires="), F.col("event_id")), F.lit("Auth-Token"), F.lit("t"))
    shown = S.diagnostics(F.create_map(F.lit("note"), F.concat(F.lit("/home/user/"), "event_type", F.lit("/file.txt, x="), "event_type", F.lit(", password: abc")), F.lit("home"), F.col("event_type")))
    return e.select("event_id", S.redact_json(F.to_json(fields)).alias("redacted"), shown["note"].alias("note"), shown["home"].alias("home"))
