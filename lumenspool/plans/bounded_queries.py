"""Queries of choices under a bound and of sinks that are read back, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspool.operators import packets as P
from lumenspool.operators import survey as S
from lumenspool.plans.registry import query
from lumenspool.sinks import documents as W
from lumenspool.sinks.shared import shared_path
from lumenspool.sources.adapters import table


@query("""with recursive f as (select conv_id, (conv_id % 8) * 4000 as focus, turn * 4000 + (turn * conv_id) % 900 as t, 'F' || turn as id from conversations), o as (select *, row_number() over (partition by conv_id order by abs(t - focus), t, id) as n from f),
r as (select conv_id, 0::bigint as n, null::bigint as low, null::bigint as high, []::varchar[] as kept, []::bigint[] as times from (select distinct conv_id from o) union all
 select conv_id, n, case when ok then least(coalesce(low, t), t) else low end, case when ok then greatest(coalesce(high, t), t) else high end, case when ok then list_append(kept, id) else kept end, case when ok then list_append(times, t) else times end from
 (select o.conv_id, o.n, o.t, o.id, r.low, r.high, r.kept, r.times, greatest(coalesce(high, t), t) - least(coalesce(low, t), t) <= 15000 as ok from r join o on o.conv_id = r.conv_id and o.n = r.n + 1)),
l as (select * from r qualify row_number() over (partition by conv_id order by n desc) = 1) select conv_id, array_to_string(list_transform(list_sort(list_zip(times, kept)), lambda z: z[2]), ',') as frames from l""")
def bounded_packet_frames(spark, sf):
    """_bounded_packet_frames: frames nearest to the focus whose span stays within 15 s."""
    turn, k = F.col("turn"), F.col("conv_id")
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct((turn * 4000 + F.pmod(turn * k, F.lit(900))).alias("actual_ms"), F.concat(F.lit("F"), turn).alias("frame_id"))).alias("f"))
    kept = S.packet_frames(F.col("f"), F.pmod(k, F.lit(8)) * 4000)
    return rows.select("conv_id", F.array_join(F.transform(kept, lambda f: f["frame_id"]), ",").alias("frames"))


@query("""with recursive s as (select conv_id, list(length(coalesce(text, ''))::bigint order by turn) as sizes, (conv_id % 5 * 300)::bigint as most from conversations group by 1), t as (select *, len(sizes) as n, list_sum(sizes)::bigint as total from s),
w as (select *, least(n, greatest(1, floor(most / greatest(1, floor(total / n)))))::bigint as wanted from t), o as (select *, list_concat(case when wanted = 1 then [0::bigint] else list_transform(range(wanted), lambda i: round_even(i * (n - 1) / (wanted - 1), 0)::bigint) end, range(n)) as ord from w),
r as (select conv_id, 0::bigint as k, 0::bigint as used, []::bigint[] as kept from o union all select conv_id, k + 1, case when ok then used + size else used end, case when ok then list_append(kept, i) else kept end from
 (select *, used + size <= most and not list_contains(kept, i) as ok from (select r.conv_id, r.k, r.used, r.kept, o.most, o.ord[r.k + 1] as i, o.sizes[o.ord[r.k + 1] + 1] as size from r join o on o.conv_id = r.conv_id and r.k < len(o.ord)))),
l as (select * from r qualify row_number() over (partition by conv_id order by k desc) = 1) select conv_id, array_to_string(case when total <= most then range(n) else list_sort(kept) end, ',') as kept from l join o using (conv_id)""")
def bounded_frame_records(spark, sf):
    """_bounded_shared_frame_records: evenly spread records within a budget of bytes."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size")))).alias("s"))
    kept = S.within_bytes(F.transform("s", lambda x: x["size"]), (F.pmod("conv_id", F.lit(5)) * 300).cast("long"))
    return rows.select("conv_id", F.array_join(kept, ",").alias("kept"))


@query("""with p as (select o_custkey % 30 as project, o_orderkey as candidate_id, o_orderkey // 3 as ordinal, o_orderkey // 2 as scope, round(o_totalprice, 2) as score, o_orderkey % 17 = 0 as proved, o_orderkey % 23 = 0 as retry from orders),
f as (select *, row_number() over (partition by project, scope order by ordinal, candidate_id) = 1 or proved as lead from p), l as (select *, row_number() over (partition by project order by retry desc, ordinal, candidate_id) as place, count_if(retry) over (partition by project) as retries from f where lead and not proved),
t as (select *, row_number() over (partition by project order by ordinal, candidate_id) - 1 as i, count(*) over (partition by project) as n, greatest(12 - retries, 0) as slots from l where not retry), a as (select *, ceil(slots / 2)::bigint as anchors from t),
b as (select *, case when n <= slots then true when anchors > 1 then len(list_filter(range(anchors), lambda k: round_even(k * (n - 1) / (anchors - 1), 0) = i)) > 0 else anchors = 1 and i = 0 end as anchor from a),
c as (select *, slots - count_if(anchor) over (partition by project) as rest, row_number() over (partition by project, anchor order by score desc, ordinal, candidate_id) as by_score from b),
h as (select project, scope from c where anchor or by_score <= rest union select project, scope from l where retry and place <= 12)
select p.project, p.candidate_id, proved or h.scope is not null as chosen from p left join h using (project, scope)""")
def selected_packet_files(spark, sf):
    """_select_semantic_packet_files: packets of a pass under a budget of slots."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(30)).alias("project"), k.alias("candidate_id"), F.floor(k / 3).alias("ordinal"), F.floor(k / 2).alias("scope"), F.round("o_totalprice", 2).alias("score"), (F.pmod(k, F.lit(17)) == 0).alias("proved"), (F.pmod(k, F.lit(23)) == 0).alias("retry"))
    return P.select(rows, 12).select("project", "candidate_id", "chosen")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'replaced' else o_orderpriority end as note, o_orderstatus as status from orders")
def replaced_partitions(spark, sf):
    """atomic_write_bytes, atomic_update_json_fields: partitions are replaced whole, others stay."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("note"), F.col("o_orderstatus").alias("status"))
    path = shared_path(spark, "partitions")
    o.write.partitionBy("status").parquet(path)
    W.replace_rows(path, o.where("status = 'F'").withColumn("note", F.lit("replaced")), ("status",))
    return spark.read.parquet(path).select("o_orderkey", "note", "status")


@query("""select conv_id, turn, '[REDACTED]' as token, 'https://h.org/p?' || case when turn % 2 = 0 then '[REDACTED]' else 'page=' || turn end as url, role from conversations""")
def written_packets(spark, sf):
    """atomic_write_json, write_vision_packet: JSON in a folder each kind, secrets hidden, read back."""
    url = F.concat(F.lit("https://h.org/p?"), F.when(F.pmod("turn", F.lit(2)) == 0, "sig=1").otherwise(F.concat(F.lit("page="), "turn")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.create_map(F.lit("access_token"), F.lit("t"), F.lit("role"), "role").alias("fields"), url.alias("url"), F.pmod("conv_id", F.lit(4)).alias("kind"))
    path = shared_path(spark, "json")
    W.write_json(rows, path, ("kind",))
    back = spark.read.schema("conv_id bigint, turn bigint, fields map<string,string>, url string").json(path)
    return back.select("conv_id", "turn", F.col("fields")["access_token"].alias("token"), "url", F.col("fields")["role"].alias("role"))
