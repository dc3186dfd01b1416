"""Trees of files as tables: videos, sidecars, projects, orphans, usage and retention, over rows (path, length) of a listing.

``files`` lists a folder with Spark and reads no contents. Paths use forward slashes. A project is a
folder with ``.state/canonical-project.json`` below it; an orphan is a folder with a generated footprint
and no such file. Nothing here deletes: plans say what could go. Rows relate by the folders above a path,
each an equality key, so no path is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.sources.media import KINDS, suffix

MARKER = "/.state/canonical-project.json"
#: Subtitle suffixes in order of preference, footprints of generated trees, what a project can do without.
SIDECARS = ("srt", "vtt", "ass", "ssa")
FOOTPRINTS = (".state/cache", ".state/checkpoints", ".state/timeline", ".state/vision", "evidence/full", "evidence/crops")
RECLAIMABLE = (".state/cache/", ".state/checkpoints/visual-frames/", ".state/checkpoints/ocr/")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of all files below root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def videos(listing: DataFrame) -> DataFrame:
    return listing.where(suffix(F.col("path")).isin(*[s for s, k in KINDS.items() if k == "video"]))


def sidecars(listing: DataFrame) -> DataFrame:
    """(path, sidecar, preference): the non-empty subtitle files of the same folder and stem as each video."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    own = videos(listing).select("path", stem.alias("stem"))
    other = listing.where("length > 0").select(F.col("path").alias("sidecar"), stem.alias("stem"), F.array_position(F.array(*[F.lit(s) for s in SIDECARS]), suffix(F.col("path"))).alias("preference")).where("preference > 0")
    return own.join(other, "stem").select("path", "sidecar", (F.col("preference") - 1).cast("int").alias("preference"))


def above(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def projects(listing: DataFrame) -> DataFrame:
    """(project): folders with a canonical file; those inside another project are not apart."""
    found = listing.where(F.endswith("path", F.lit(MARKER))).select(F.expr(f"substr(path, 1, length(path) - {len(MARKER)})").alias("project")).distinct()
    nested = found.select("project", F.explode(above(F.col("project"))).alias("outer")).join(found.withColumnRenamed("project", "outer"), "outer", "left_semi").select("project").distinct()
    return found.join(nested, "project", "left_anti")


def orphans(listing: DataFrame) -> DataFrame:
    """(orphan, markers): folders with a footprint that are no project, hold none and lie in none, nor in another orphan."""
    known = listing.where(F.endswith("path", F.lit(MARKER))).select(F.expr(f"substr(path, 1, length(path) - {len(MARKER)})").alias("project")).distinct()
    marks = F.array_compact(F.array(*[F.when(F.col("path").rlike(f"/{m.replace('.', chr(92) + '.')}(/|$)"), F.struct(F.regexp_extract("path", f"^(.*?)/{m.replace('.', chr(92) + '.')}(/|$)", 1).alias("orphan"), F.lit(m).alias("marker"))) for m in FOOTPRINTS]))
    found = listing.select(F.explode(marks).alias("m")).groupBy(F.col("m.orphan").alias("orphan")).agg(F.array_sort(F.collect_set("m.marker")).alias("markers"))
    state = listing.where(F.contains("path", F.lit("/.state/"))).select(F.regexp_extract("path", r"^(.*?)/\.state/", 1).alias("orphan")).distinct()
    holding = known.select(F.explode(F.concat(above(F.col("project")), F.array("project"))).alias("orphan")).distinct()
    free = found.join(state, "orphan", "left_semi").join(holding, "orphan", "left_anti")
    inside = free.select("orphan", F.explode(above(F.col("orphan"))).alias("outer")).join(free.select(F.col("orphan").alias("outer")), "outer", "left_semi").select("orphan").distinct()
    return free.join(inside, "orphan", "left_anti")


def _folder(path: Column) -> Column:
    """The folder of a path; a path without folder is its own."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "(?s)^(.*)/", 1)).otherwise(path)


def _folders(listing: DataFrame) -> DataFrame:
    """(folder, files, bytes): files summed by folder, since what lies above a file and whether it can go depend on its folder only."""
    return listing.groupBy(_folder(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def _and_above(folder: Column) -> Column:
    return F.array_distinct(F.concat(above(folder), F.array(folder)))


def usage(listing: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """roots with files, bytes, reclaimable_files and reclaimable_bytes of all files below each. roots: a column ``name``."""
    below = _folders(listing).select("folder", "files", "bytes", F.explode(_and_above(F.col("folder"))).alias(name)).join(roots, name)
    rest = F.expr(f"substr(concat(folder, '/'), length({name}) + 2)")
    free = F.array_contains(F.array(*[F.startswith(rest, F.lit(p)) for p in RECLAIMABLE]), True)
    sums = below.groupBy(name).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), *[F.coalesce(F.sum(F.when(free, F.col(c))), F.lit(0).cast("long")).alias(f"reclaimable_{c}") for c in ("files", "bytes")])
    return roots.join(sums, name, "left").fillna(0, ["files", "bytes", "reclaimable_files", "reclaimable_bytes"])


def _loose(folders: DataFrame, covered: DataFrame) -> DataFrame:
    """folders that are none of the covered ones and lie in none."""
    hit = folders.select("folder", F.explode(_and_above(F.col("folder"))).alias("root")).join(covered, "root", "left_semi").select("folder").distinct()
    return folders.join(hit, "folder", "left_anti")


def unclassified(listing: DataFrame, covered: DataFrame) -> DataFrame:
    """Files that lie in none of the covered folders. covered: a column root."""
    inside = _loose(listing.select(_folder(F.col("path")).alias("folder")).distinct(), covered)
    return listing.withColumn("_folder", _folder(F.col("path"))).join(inside.withColumnRenamed("folder", "_at"), F.col("_folder").eqNullSafe(F.col("_at")), "left_semi").drop("_folder")


def retention_report(listing: DataFrame) -> DataFrame:
    """(kind, trees, files, bytes, reclaimable_files, reclaimable_bytes) of projects, orphans, unclassified files and all."""
    own, left = projects(listing), orphans(listing).select("orphan")
    sums = ("files", "bytes", "reclaimable_files", "reclaimable_bytes")
    total = lambda df, kind: df.agg(F.count(F.lit(1)).alias("trees"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums]).select(F.lit(kind).alias("kind"), "trees", *sums)
    covered = own.toDF("root").union(left.toDF("root"))
    loose = _loose(_folders(listing), covered).select("files", "bytes", F.lit(0).alias("reclaimable_files"), F.lit(0).alias("reclaimable_bytes"))
    return (total(usage(listing, own, "project"), "projects").unionByName(total(usage(listing, left, "orphan"), "orphans"))
            .unionByName(total(loose, "unclassified").withColumn("trees", F.lit(0).cast("long"))))


def prune_plan(runs: DataFrame, keep: int, group: str = "root") -> DataFrame:
    """runs (group, project, modified_ms, bytes) with place, and whether a plan that keeps the newest ``keep`` a group would remove each."""
    w = Window.partitionBy(group).orderBy(F.desc("modified_ms"), F.desc("project"))
    return runs.withColumn("place", F.row_number().over(w)).withColumn("removable", F.col("place") > keep)


def compaction_plan(listing: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(project, kind, files, bytes): the visual caches of each project that a completed run can do without, but for those kept."""
    kinds = {"visual-frames": "/.state/checkpoints/visual-frames/", "ocr": "/.state/checkpoints/ocr/"}
    kind = F.coalesce(*[F.when(F.contains("path", F.lit(v)), F.lit(k)) for k, v in kinds.items()])
    rows = listing.withColumn("kind", kind).where(F.col("kind").isNotNull() & ~F.col("kind").isin(*keep, ""))
    return rows.groupBy(F.regexp_extract("path", r"^(.*?)/\.state/", 1).alias("project"), "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
