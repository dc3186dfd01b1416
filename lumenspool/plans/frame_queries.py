"""Queries over decoded frames: vectors of a table as grey grids of 8 x 8."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.operators import frames as R
from lumenspool.plans.registry import query
from lumenspool.sources.adapters import table

_FRAMES = """f as (select label as media_id, row_number() over (partition by label order by vec_id) as seq, list_transform(embedding, lambda x: greatest(0, least(255, floor(128 + 600 * x::double)))::int) as px from embeddings),
x as (select media_id, seq, unnest(px) as p, generate_subscripts(px, 1) - 1 as k from f), g as (select media_id, seq, k, p, k // 8 as y, k % 8 as x from x),
e as (select a.media_id, a.seq, a.k, case when a.x in (0, 7) or a.y in (0, 7) then any_value(a.p) else greatest(0, least(255, 9 * any_value(a.p) - sum(b.p)))::int end as e from g a join g b on a.media_id = b.media_id and a.seq = b.seq and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by a.media_id, a.seq, a.k, a.x, a.y),
h as (select media_id, seq, sum((px[y * 8 + greatest(c * 8 // 9, 0) + 1] > px[y * 8 + (c + 1) * 8 // 9 + 1])::int::hugeint << (y * 8 + c)) as bits from f, range(8) as r(y), range(8) as s(c) group by 1, 2)"""


def grids(spark, sf):
    seq = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 600 * x.cast("double")))).cast("int"))
    return table(spark, sf, "embeddings").select(F.col("label").alias("media_id"), seq.alias("seq"), F.lit(8).alias("width"), F.lit(8).alias("height"), grey.alias("pixels"))


@query(f"with {_FRAMES} select media_id, seq, lpad(lower(hex(bits::ubigint)), 16, '0') as dhash from h")
def frame_hashes(spark, sf):
    """perceptual_dhash."""
    return R.assess(grids(spark, sf)).select("media_id", "seq", "dhash")


@query(f"""with {_FRAMES}, m as (select media_id, seq, avg(p) / 255 as brightness, stddev_pop(p) / 127.5 as contrast, avg((p < 5)::int) as dark, avg((p >= 251)::int) as light from g group by 1, 2), n as (select media_id, seq, least(1, var_pop(e) / 2500) as sharpness, avg((e >= 24)::int) as density from e group by 1, 2),
q as (select *, least(1, 0.65 * greatest(0, 0.18 - contrast) / 0.18 + 0.35 * least(1, dark + light)) as risk from m join n using (media_id, seq))
select media_id, seq, round(sharpness, 6) as sharpness, round(brightness, 6) as brightness, round(least(1, contrast), 6) as contrast, round(density, 6) as edge_density, round(dark, 6) as clipped_dark, round(light, 6) as clipped_light, round(risk, 6) as transition_risk,
 round(greatest(0, least(1, 0.5 * sharpness + 0.2 * least(1, contrast) + 0.15 * least(1, density * 3) + 0.15 * (1 - risk))), 6) as overall from q""")
def frame_quality(spark, sf):
    """assess_frame_quality."""
    return R.assess(grids(spark, sf)).select("media_id", "seq", *[F.round(m, 6).alias(m) for m in R.MEASURES])


@query(f"""with {_FRAMES}, d as (select a.media_id, a.seq, a.k, abs(a.p - b.p) as d, abs(ea.e - eb.e) as de from g a join g b on b.media_id = a.media_id and b.seq = a.seq - 1 and b.k = a.k join e ea on ea.media_id = a.media_id and ea.seq = a.seq and ea.k = a.k join e eb on eb.media_id = a.media_id and eb.seq = b.seq and eb.k = a.k),
s as (select media_id, seq, avg((d >= 12)::int) as changed, sum(d) / (255 * 64.0) as mean, sum(de) / (255 * 64.0) as edge, max((d >= 12)::int)::double as most, count(*) filter (d > 0) as n_regions from d group by 1, 2)
select s.media_id, s.seq, bit_count(xor(a.bits, b.bits))::bigint as hamming, round(changed, 6) as changed_ratio, round(mean, 6) as mean_difference, round(edge, 6) as edge_difference, most as maximum_region, n_regions::int as n_regions
from s join h a on a.media_id = s.media_id and a.seq = s.seq join h b on b.media_id = s.media_id and b.seq = s.seq - 1""")
def frame_differences(spark, sf):
    """compare_frames, analyze_frame_sequence_with_hash: each frame against the one before it."""
    r = R.compare_adjacent(grids(spark, sf))
    return r.select("media_id", "seq", "hamming", *[F.round(c, 6).alias(c) for c in ("changed_ratio", "mean_difference", "edge_difference")], "maximum_region", F.size("regions").alias("n_regions"))


@query(f"""with {_FRAMES}, d as (select a.media_id, a.seq, a.x, a.y, abs(a.p - b.p) as d from g a join g b on b.media_id = a.media_id and b.seq = a.seq - 1 and b.k = a.k where a.p <> b.p)
select media_id, seq, (row_number() over (partition by media_id, seq order by (d >= 12) desc, d desc, y, x) - 1)::int as place, x::int as x, y::int as y, 1 as width, 1 as height, (d >= 12)::int::double as changed_ratio, round(d / 255.0, 9) as mean_difference from d""")
def changed_regions(spark, sf):
    """_changed_regions: tiles that differ, most changed first."""
    return R.changed_regions(grids(spark, sf)).withColumn("mean_difference", F.round("mean_difference", 9))


@query(f"""with {_FRAMES} select media_id, seq, sha256(unhex('{b"sha256-rgba8-srgb-v1".hex()}000000000800000008' || array_to_string(list_transform(px, lambda p: printf('%02x%02x%02xff', p, p, p)), ''))) as pixel_hash from f""")
def pixel_hashes(spark, sf):
    """normalized_pixel_hash of grey frames."""
    return grids(spark, sf).select("media_id", "seq", R.pixel_hash(F.col("pixels"), F.col("width"), F.col("height")).alias("pixel_hash"))
