"""The registered queries of the llm operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspool.llm import bpe, common, edit_embedding, exact_dedup, language_id, ngram_join, ngram_lm, packing, prefix_trie, quality_rules, sharding, toxicity, vector_codes, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op2_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edited_report(common.table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index).select(
        "doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as they lie in the rewritten shards; a shard that nothing enters or leaves is not written and is given as assigned."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path, shards = common.shared_path(spark, "shards"), 8
    touched = {k for m in sharding.rewrite(docs, path, shards).collect() for k in (m.old_shard, m.shard)}
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard"]
    if not touched:
        return sharding.assign(docs, shards).select(columns)
    out = spark.read.parquet(path).select(columns)
    return out if touched >= set(range(shards)) else out.union(sharding.assign(docs, shards).where(~F.col("shard").isin(*touched)).select(columns))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(common.table(spark, sf_dir, "documents"))


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = ngram_lm.score(docs, ngram_lm.fit(docs))
    return found.select("doc_id", ngram_lm.is_held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payload=False).drop("url")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(common.table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(common.table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(common.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_edit_embedding": op2_edit_embedding,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op8_ngram_lm": op8_ngram_lm,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = "[^\\x20\\x09-\\x0D]+"
_NEAREST = """{name} as (select vec_id, label, part, entry, far from (select v.vec_id, v.label, v.part, e.entry, list_sum(list_transform(list_zip(v.x, e.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as far from v join {books} e using (part))
 qualify row_number() over (partition by vec_id, part order by far, entry) = 1)"""
_MEANS = """{name} as (select b.part, b.entry, coalesce(m.y, b.y) as y from {books} b left join (select part, entry, list((s - ((s % n) + n) % n) // n order by place) as y from
 (select part, entry, place, sum(x)::bigint as s, count(*) as n from (select a.part, a.entry, unnest(v.x) as x, generate_subscripts(v.x, 1) as place from {near} a join v using (vec_id, part)) group by all) group by all) m using (part, entry))"""
_MARKS = ", ".join("'" + c.replace("'", "''") + "'" for c in quality_rules.ENDINGS)

ORACLE: dict[str, str] = {
    # Lines and windows of words as rows; phrases and marks as in quality_rules.
    "op3_quality_rules": f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '{_WORD}') as words, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '{_WORD}')) as lines from d),
x as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
y as (select doc_id, i, word || ' ' || lead(word) over p || ' ' || lead(word, 2) over p as g from x window p as (partition by doc_id order by i)),
z as (select doc_id, i, count(*) over (partition by doc_id, g) as k from y where g is not null),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from z where k > 1) group by 1),
l as (select doc_id, line, trim(line, {_BLANKS}) as s from (select doc_id, unnest(list_distinct(lines)) as line from w)),
m as (select *, length(s) - length(replace(s, ' ', '')) + 1 as n, len(regexp_extract_all(s, '[#*$%&|<>»·•]|!!')) as marks from l),
f as (select *, (marks >= n * 0.2 and (len(list_filter(string_split(s, ' ')[2:-2], lambda t: t in ('|', '>', '»', '·', '•'))) >= n * 0.2 or len(regexp_extract_all(s, '[#*$%&|<>]')) >= n * 0.3 or (n >= 3 and len(regexp_extract_all(s, '!!')) >= n * 0.3)))
 or (n <= 30 and regexp_matches(lower(s), '{"|".join(quality_rules.PHRASES)}')) or (n < 4 and right(s, 1) not in ({_MARKS})) as fails from m),
c as (select doc_id, sum(length(line)) filter (not fails) as clean from f group by 1),
t as (select w.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda s: length(s))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
 (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(list_sum(list_transform(lines, lambda s: length(s))), 0) as total, coalesce(clean, 0) as clean from w left join r using (doc_id) left join c using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, case when total > 0 then 1 - clean / total else 1.0 end as lost from t)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost <= 0.5 as kept, round(lost::double, 6) as lost_share from v""",
    # All pairs that share a shingle, then the closure of the links: for the small tables of the check only.
    "op4_ngram_jaccard": f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as words from documents),
x as (select doc_id, len(words) as n, unnest(words) as word, generate_subscripts(words, 1) as i from w),
s as (select distinct doc_id, g from (select doc_id, word || ' ' || lead(word) over p || ' ' || lead(word, 2) over p || ' ' || lead(word, 3) over p || ' ' || lead(word, 4) over p as g from x where n >= 5 window p as (partition by doc_id order by i)) where g is not null
 union select doc_id, array_to_string(words, ' ') from w where len(words) between 1 and 4),
n as (select doc_id, count(*) as n from s group by 1),
k as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select k.a, k.b from k join n p on p.doc_id = k.a join n q on q.doc_id = k.b where 100 * k.k >= 75 * (p.n + q.n - k.k)),
r(a, b) as (select doc_id, doc_id from w union select r.a, l.b from r join l on l.a = r.b)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.b) as component_id from w join r on r.a = w.doc_id left join n on n.doc_id = w.doc_id group by w.doc_id""",
    "op10_warc": """
with p as (select page_id, coalesce(html, '') as html from pages), q as (select *, octet_length(encode(html))::bigint as payload_bytes, max(page_id) over (partition by html) as last from p)
select page_id, payload_bytes, sha1(html) as payload_digest, case when payload_bytes >= 1000 and page_id < last then 'revisit' else 'response' end as record_type, case when payload_bytes >= 1000 and page_id < last then last end as refers_to from q""",
    "op11_exact_dedup": f"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(translate(coalesce(text, ''), {_BLANKS}, '')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by text_sha256) as group_size, row_number() over best = 1 as kept, text_sha256
from d window best as (partition by text_sha256 order by n desc, doc_id nulls last)""",
    # Every prefix of every rebuilt conversation as a row; subtrees by what their members' paths hold.
    "op12_prefix_trie": f"""
with t as (select conv_id, conv_id - conv_id % 20 as base, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i from conversations where conv_id is not null),
c as (select distinct conv_id, base from t),
h as (select conv_id, base, (list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)), lambda a, x: list_reduce(list_concat([xor(a, x)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda r, _: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end))) as register from c),
o as (select conv_id, base, (4294967295 - register) % 4 as h from h),
r as (select o.conv_id, b.i as place, b.role, b.text from o join t b on b.conv_id = o.base and b.i <= o.h
 union all select t.conv_id, 100 + t.i, t.role, t.text from o join t using (conv_id) where t.i > o.h),
s as (select conv_id, row_number() over (partition by conv_id order by place) as depth, length(role) || ':' || role || text as turn, len(regexp_extract_all(text, '{_WORD}')) as words from r),
l as (select conv_id, list(sha256(turn) order by depth) as turns, list(words order by depth) as words from s group by 1),
p as (select conv_id, 0 as depth, '' as key, null as parent, 0 as words from c
 union all select conv_id, depth, array_to_string(turns[1:depth], '') as key, array_to_string(turns[1:depth - 1], '') as parent, words[depth] from (select *, unnest(range(1, len(turns) + 1)) as depth from l)),
n as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(parent) as parent, any_value(words) as words from p group by key, depth),
k as (select parent as key, count(*) as n_children from n where depth > 0 group by 1),
u as (select distinct a.key, b.key as below from p a join p b on a.conv_id = b.conv_id and b.depth >= a.depth),
sums as (select u.key, count(*) filter (k.key is null) as n_leaves, sum((n.n_convs - 1) * n.words)::bigint as saved_tokens from u join n on n.key = u.below left join k on k.key = u.below group by 1),
e as (select key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from (select *, lead(depth) over (partition by conv_id order by depth) is null as last from p) where last group by 1)
select n.conv_id, n.depth::bigint as depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, sums.n_leaves, sums.saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from n left join n q on q.key = n.parent and n.depth > 0 left join k on k.key = n.key join sums on sums.key = n.key left join e on e.key = n.key""",
    "op13_vector_codes": f"""
with w as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select vec_id, label, part, x[part * (len(x) // 16) + 1:(part + 1) * (len(x) // 16)] as x from w, (select unnest(range(16)) as part)),
b0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as y from v where vec_id in (select vec_id from w order by vec_id limit 64)),
{_NEAREST.format(name="n0", books="b0")}, {_MEANS.format(name="b1", books="b0", near="n0")}, {_NEAREST.format(name="n1", books="b1")}, {_MEANS.format(name="b2", books="b1", near="n1")}, {_NEAREST.format(name="n2", books="b2")},
c as (select vec_id, any_value(label) as label, string_agg(printf('%02x', entry::integer), '' order by part) as code, sum(far)::bigint as error from n2 group by 1),
k as (select sha256(array_to_string(flatten(list(y order by part, entry)), ',')) as codebooks_sha256 from b2)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c, k""",
}
