"""Queries over aligned token lists: opcodes as rows, coverage in order, full audits of order.

The oracle finds the longest common run of each span by islands on diagonals and parts the span there, again and again.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.functions import alignment as L
from lumenspool.functions import columns as C
from lumenspool.functions import text as X
from lumenspool.plans.audit_queries import _TOKS, text_pairs
from lumenspool.plans.registry import query
from lumenspool.sources.adapters import table

#: Blocks of the pairs of token lists t (conv_id, turn, a, b); ops: what lies between them, and they themselves.
_BLOCKS = """pa as (select conv_id, turn, unnest(a) as tok, generate_subscripts(a, 1) - 1 as i from t), pb as (select conv_id, turn, unnest(b) as tok, generate_subscripts(b, 1) - 1 as j from t),
pts as materialized (select pa.conv_id, pa.turn, i, j from pa join pb on pa.conv_id = pb.conv_id and pa.turn = pb.turn and pa.tok = pb.tok),
r(conv_id, turn, alo, ahi, blo, bhi, bi, bj, bk) as (select conv_id, turn, 0::bigint, len(a)::bigint, 0::bigint, len(b)::bigint, -1::bigint, -1::bigint, 0::bigint from t union all
 select conv_id, turn, case x when 0 then alo else i + k end, case x when 0 then i else ahi end, case x when 0 then blo else j + k end, case x when 0 then j else bhi end, i, j, k from
 (select * from (select conv_id, turn, alo, ahi, blo, bhi, min(i) as i, min(j) as j, count(*) as k from (select r.conv_id, r.turn, alo, ahi, blo, bhi, i, j, i - j as d, i - row_number() over (partition by r.conv_id, r.turn, alo, ahi, blo, bhi, i - j order by i) as g
  from r join pts p on p.conv_id = r.conv_id and p.turn = r.turn and i >= alo and i < ahi and j >= blo and j < bhi) group by conv_id, turn, alo, ahi, blo, bhi, d, g) qualify row_number() over (partition by conv_id, turn, alo, ahi, blo, bhi order by k desc, i, j) = 1), (values (0), (1)) as s(x)),
bl as (select distinct conv_id, turn, bi as i, bj as j, bk as k from r where bk > 0),
nb as (select *, coalesce(lag(i + k) over w = i and lag(j + k) over w = j, false) as joins from bl window w as (partition by conv_id, turn order by i)),
mb as (select conv_id, turn, min(i) as i, min(j) as j, sum(k)::bigint as k from (select *, sum((not joins)::int) over (partition by conv_id, turn order by i) as n from nb) group by conv_id, turn, n),
ends as (select * from mb union all select conv_id, turn, len(a), len(b), 0 from t),
gaps as (select *, coalesce(lag(i + k) over w, 0) as pi, coalesce(lag(j + k) over w, 0) as pj from ends window w as (partition by conv_id, turn order by i, j, k desc)),
ops as (select conv_id, turn, case when i > pi and j > pj then 'replace' when i > pi then 'delete' else 'insert' end as tag, pi as a_start, i as a_end, pj as b_start, j as b_end from gaps where i > pi or j > pj union all select conv_id, turn, 'equal', i, i + k, j, j + k from gaps where k > 0)"""
_AUDIT_TOKENS = C.AUDIT_TOKEN.replace("'", "''")
_WORDS = """with recursive w as (select conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[^ \\t\\n\\x0b\\f\\r]+') as a from conversations),
t as (select conv_id, turn, a, list_transform(list_filter(list_zip(a, range(len(a))), lambda z: (z[2] + conv_id) % 7 <> 3), lambda z: case when (z[2] + turn) % 11 = 5 then 'x' || z[2] else z[1] end) || a[1:3] as b from w), """


def edited(spark, sf):
    """(conv_id, turn, a, b): words of turns and of an edited wording: some left out, some replaced, the first three repeated."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[^ \t\n\x0b\f\r]+"), 0).alias("a"))
    numbered = F.transform("a", lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))
    kept = F.filter(numbered, lambda z: F.pmod(z["i"] + F.col("conv_id"), F.lit(7)) != 3)
    return c.withColumn("b", F.concat(F.transform(kept, lambda z: F.when(F.pmod(z["i"] + F.col("turn"), F.lit(11)) == 5, F.concat(F.lit("x"), z["i"])).otherwise(z["x"])), F.slice("a", 1, 3)))


@query(_WORDS + _BLOCKS + " select conv_id, turn, tag, a_start::int as a_start, a_end::int as a_end, b_start::int as b_start, b_end::int as b_end from ops")
def sequence_alignment(spark, sf):
    """sequence_alignment: opcodes between two wordings, a row each."""
    return L.align(edited(spark, sf), F.col("a"), F.col("b"), ["conv_id", "turn"]).select("conv_id", "turn", F.inline("opcodes"))


@query(_WORDS + _BLOCKS + """, s as (select conv_id, turn, sum(k)::bigint as k from mb group by 1, 2)
select conv_id, turn, coalesce(k, 0) as matched, case when len(a) + len(b) > 0 then round(2.0 * coalesce(k, 0) / (len(a) + len(b)), 6)::double else 1.0 end as ratio from t left join s using (conv_id, turn)""")
def ordered_similarity(spark, sf):
    return L.align(edited(spark, sf), F.col("a"), F.col("b"), ["conv_id", "turn"]).select("conv_id", "turn", "matched", F.round("ratio", 6).alias("ratio"))


@query(f"""with recursive p as (select conv_id, turn, lag(text) over (partition by conv_id order by turn) as before, text from conversations), t as (select conv_id, turn, regexp_extract_all(lower(before), '{_AUDIT_TOKENS}') as a, regexp_extract_all(lower(text), '{_AUDIT_TOKENS}') as b from p where before is not null), {_BLOCKS},
s as (select conv_id, turn, sum(k)::bigint as k from mb group by 1, 2)
select conv_id, turn, len(a)::bigint as source_tokens, coalesce(k, 0) as matched, case when len(a) > 0 then round(coalesce(k, 0) / len(a), 6) else 1.0 end as ratio, a = b as exact from t left join s using (conv_id, turn)""")
def ordered_coverage(spark, sf):
    """ordered_coverage: how much of a turn the next one has in order."""
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    rows = c.select("conv_id", "turn", C.audit_tokens(F.col("before")).alias("a"), C.audit_tokens(F.col("text")).alias("b"))
    found = L.align(rows.withColumn("exact", F.col("a") == F.col("b")), F.col("a"), F.col("b"), ["conv_id", "turn", "exact"])
    return found.select("conv_id", "turn", F.col("a_count").alias("source_tokens"), "matched", F.when(F.col("a_count") > 0, F.round(F.col("matched") / F.col("a_count"), 6)).otherwise(1.0).alias("ratio"), "exact")


@query(_TOKS.replace("with ", "with recursive ", 1) + ", " + _BLOCKS + """, m1 as (select o.conv_id, o.turn, string_agg(array_to_string(a[a_start + 1:a_end], ' '), ' ' order by a_start, b_start) as missing from ops o join t using (conv_id, turn) where tag in ('delete', 'replace') group by 1, 2),
m2 as (select o.conv_id, o.turn, string_agg(array_to_string(b[b_start + 1:b_end], ' '), ' ' order by a_start, b_start) as added from ops o join t using (conv_id, turn) where tag in ('insert', 'replace') group by 1, 2),
m3 as (select o.conv_id, o.turn, sum(least(a_end - a_start, b_end - b_start))::bigint as n from ops o where tag = 'replace' group by 1, 2)
select conv_id, turn, a = b as faithful, a <> b and list_sort(a) = list_sort(b) as reordered, coalesce(missing, '') as missing, coalesce(added, '') as added, coalesce(n, 0)::int as n_substitutions from t left join m1 using (conv_id, turn) left join m2 using (conv_id, turn) left join m3 using (conv_id, turn)""")
def ordered_audit(spark, sf):
    """audit_ordered_tokens in full: missing and added tokens and substitutions by aligned opcodes."""
    rows = text_pairs(spark, sf).select("conv_id", "turn", X.ordered_tokens(F.col("source")).alias("a"), X.ordered_tokens(F.col("output")).alias("b"))
    r = L.audit_ordered(rows, "a", "b", ["conv_id", "turn"])
    return r.select("conv_id", "turn", "faithful", "reordered", F.array_join("missing", " ").alias("missing"), F.array_join("added", " ").alias("added"), F.size("substitutions").alias("n_substitutions"))
