"""JSON trees of any depth as VARIANT: walked level by level, folded bottom-up; content keys, redaction, diagnostics.

All rows' trees are walked together. A level is the children of the objects and lists of the level above, a row each,
and levels end when one has none. Going back up, the children of a node meet in one group and give its text, so a
group is as large as one node is wide. What a rule replaces is not looked into.

Text is canonical JSON: no blanks, keys in ascending order, values as the VARIANT holds them.

Defined cases: text that is no JSON and null trees give null; empty objects and lists stay; equal keys within an object
are refused by the parser and give null; repeated rows need keys of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspool.functions import safety as S
from lumenspool.functions.identity import json_text
from lumenspool.sinks.shared import written

#: Fields that name things within one run only.
RUN_IDS = ("candidate_id", "event_id", "frame_id", "image_id", "observation_id", "segment_id", "block_id", "claim_id", "revision_id")
MASK = '"<id>"'
#: Most items of a list that diagnostics show.
SHOWN_ITEMS = 100

#: A rule gets a node's columns (name, within: the name of the node it lies in, place, kind, value) and gives the JSON text that stands for it, null to go on.
Rule = Callable[[DataFrame], Column]


def _marked(level: DataFrame, rule: Rule | None) -> DataFrame:
    shape = F.schema_of_variant("value")
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "list").otherwise("scalar")
    level = level.withColumn("kind", kind)
    return level.withColumn("given", rule(level) if rule else F.lit(None).cast("string"))


def levels(df: DataFrame, keys: list[str], tree: str, rule: Rule | None = None, items: int | None = None) -> list[DataFrame]:
    """Nodes by depth, written: keys, at (positions from the root), up (at of the node above), name, within, place, kind, value, given. items: lists' first items only."""
    top = df.where(F.col(tree).isNotNull()).select(*keys, F.lit("").alias("at"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("within"), F.lit(0).alias("place"), F.col(tree).alias("value"))
    found = [written(_marked(top, rule), "tree")]
    tvf = df.sparkSession.tvf
    while True:
        inner = found[-1].where("kind <> 'scalar' and given is null").select(*keys, F.col("at").alias("up"), F.col("name").alias("within"), F.col("value").alias("_whole"))
        below = inner.lateralJoin(tvf.variant_explode(F.col("_whole").outer()))
        below = below.select(*keys, F.concat_ws(".", "up", F.col("pos").cast("string")).alias("at"), "up", F.col("key").alias("name"), "within", F.col("pos").alias("place"), "value")
        if items is not None:
            below = below.where(F.col("name").isNotNull() | (F.col("place") < items))
        level = written(_marked(below, rule), "tree")
        if level.isEmpty():
            return found
        found.append(level)


def folded(df: DataFrame, keys: list[str], tree: str, rule: Rule | None = None, drop: tuple[str, ...] = (), items: int | None = None) -> DataFrame:
    """keys and ``text``, the canonical JSON of each tree after the rule; fields of the root that are in ``drop`` are left out."""
    nodes = levels(df, keys, tree, rule, items)
    text = None
    for depth in range(len(nodes) - 1, -1, -1):
        level = nodes[depth].withColumn("_own", F.coalesce("given", F.when(F.col("kind") == "scalar", F.to_json("value"))))
        if text is not None:
            # A node and its children meet under one grouping; a join would let Spark send whole levels through the driver.
            nothing = {c: F.lit(None).cast(t).alias(c) for c, t in level.select("up", "name", "place", "kind", "_own").dtypes}
            child = F.struct("name", "place", "text")
            kin = text.select(*keys, F.col("up").alias("at"), *nothing.values(), child.alias("_child"))
            own = level.select(*keys, "at", *nothing, F.lit(None).cast(kin.schema["_child"].dataType).alias("_child"))
            level = own.union(kin).groupBy(*keys, "at").agg(*[F.first(c, ignorenulls=True).alias(c) for c in nothing], F.collect_list("_child").alias("children"))
            pair = lambda c: F.concat(json_text(c["name"]), F.lit(":"), c["text"])
            whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort("children"), pair), ","), F.lit("}"))).otherwise(
                F.concat(F.lit("["), F.array_join(F.transform(F.array_sort("children", lambda a, b: a["place"] - b["place"]), lambda c: c["text"]), ","), F.lit("]")))
        else:
            whole = F.when(F.col("kind") == "object", "{}").otherwise("[]")
        text = level.select(*keys, "up", "name", "place", F.coalesce("_own", whole).alias("text"))
        if depth == 1 and drop:
            text = text.where(F.col("name").isNull() | ~F.col("name").isin(*drop))
    return text.select(*keys, "text")


def mask_ids(level: DataFrame) -> Column:
    """Rule: run-specific ids are one placeholder each, so that equal contents of different runs have equal text."""
    name, within = F.lower("name"), F.lower("within")
    return F.when(name.isin(*RUN_IDS), F.lit(MASK)).when(F.col("name").isNull() & within.endswith("_ids"), F.lit(MASK))


def hide_secrets(level: DataFrame) -> Column:
    """Rule: values of secret keys hidden at any depth, addresses with a signed query without it."""
    hidden = json_text(F.lit(S.HIDDEN))
    address = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    shown = S.hide_signature(address)
    return F.when(S.is_secret_key(F.col("name")), hidden).when(shown != address, json_text(shown))


def fit_to_show(level: DataFrame) -> Column:
    """Rule: sensitive keys hidden at any depth, texts through diagnostic_text."""
    text = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    return F.when(S.is_sensitive_key(F.col("name")), json_text(F.lit(S.HIDDEN))).when(text.isNotNull(), json_text(S.diagnostic_text(text)))


def content_key(df: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """keys and ``content_key``: digest of a tree that is equal for trees which differ in run ids and order of keys only."""
    return folded(df, keys, tree, mask_ids).select(*keys, F.sha2("text", 256).alias("content_key"))


def scope_key(df: DataFrame, keys: list[str], tree: str, own: tuple[str, ...] = ("candidate_id",)) -> DataFrame:
    """keys and ``scope_key``: digest of a tree without the fields that name the candidate itself; all other ids count."""
    return folded(df, keys, tree, drop=own).select(*keys, F.sha2("text", 256).alias("scope_key"))


def redacted(df: DataFrame, keys: list[str], tree: str) -> DataFrame:
    return folded(df, keys, tree, hide_secrets)


def diagnostics(df: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """keys and ``text``: a tree fit to show; lists are cut to their first items."""
    return folded(df, keys, tree, fit_to_show, items=SHOWN_ITEMS)


def visual_content_key(packets: DataFrame, frames: DataFrame, hashes: DataFrame) -> DataFrame:
    """(packet_id, content_key, frame_ids): packets whose frames all have a digest, by digests and roles of their frames in order and by context without run ids.

    packets: packet_id, context (VARIANT). frames: packet_id, place, frame_id, role. hashes: frame_id, pixel_hash, file_hash; the file's stands in for the pixels'.
    Packets without frames have no key.
    """
    digest = F.coalesce(F.when(F.col("pixel_hash") != "", F.col("pixel_hash")), F.when(F.col("file_hash") != "", F.col("file_hash")))
    known = frames.join(hashes.select("frame_id", digest.alias("digest")), "frame_id", "left").groupBy("packet_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "digest", "frame_id"))).alias("f"), F.count_if(F.col("digest").isNull()).alias("_open")).where("_open = 0")
    shown = F.array_join(F.transform("f", lambda x: F.concat(F.lit('{"digest":'), json_text(x["digest"]), F.lit(',"role":'), json_text(x["role"]), F.lit("}"))), ",")
    rows = known.join(folded(packets, ["packet_id"], "context", mask_ids), "packet_id")
    key = F.sha2(F.concat(F.lit('{"context":'), F.col("text"), F.lit(',"frames":['), shown, F.lit("]}")), 256)
    return rows.select("packet_id", key.alias("content_key"), F.transform("f", lambda x: x["frame_id"]).alias("frame_ids"))
