"""Prefix trie of conversations, merged by family first.

A conversation c is rebuilt from the opening of its base c - c % 20 and its own later turns (``rebuilt``). Conversations
of one base, a family, lie in one task; there they are rebuilt, and turns that begin alike are combined into the nodes
of the family's small trie (``family_tries``). Only these nodes are shuffled for the global trie (``global_nodes``).
Texts do not move: a turn travels as a digest of its role and text and its count of words. A node's key is its depth
and 128 bits: the exclusive or of 64-bit hashes of (position, digest) under two seeds, over the positions up to it.

What a subtree sums up is found without walking the trie. Of each node the smallest member is the owner; the nodes that
a conversation owns are the end of its path. So a node's saved words are, over its members, the words of later turns
that the member does not own, and its leaves are the members that own a leaf. Both are sums over conversations, made
within families by suffix sums and combined like the nodes.

A node's list of ends is hashed as a stream: families come in ascending order of ids, and a task holds one batch of
them. Hashing a list is one sequence of steps, so a node at which a third of all conversations end is read by one task,
a row for each family.

Defined cases: turns are ordered by turn, null first, equal turns by their digest; null roles and texts are empty; rows
without conv_id are no conversation and are left out; repeated rows are repeated turns; an empty table has no root and
gives no rows; extra columns are ignored. All turns of a conversation pass through one task's sort, which spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.llm import common

#: Ids of a family, and one more than the longest opening that is taken from its base.
FAMILY, OPENINGS = 20, 4
_NODE = ["depth", "k1", "k2"]


def family_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def opening_of(conv: Column) -> Column:
    """How many turns of its base a conversation opens with."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(OPENINGS)).cast("int")


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        family_of(F.col("conv_id")).alias("family"), "conv_id", "turn", F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, depth, digest, words): each rebuilt conversation's turns from depth 1, and its root at depth 0. Families lie together."""
    own = Window.partitionBy("family", "conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    rows = _turns(conversations).repartition("family").withColumn("place", F.row_number().over(own))
    first = F.when((F.col("conv_id") == F.col("family")) & (F.col("place") < OPENINGS), F.struct(F.col("place").alias("depth"), "digest", "words"))
    rows = rows.withColumn("base", F.array_sort(F.collect_list(first).over(Window.partitionBy("family")))).withColumn("h", opening_of(F.col("conv_id")))
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words")))
    opened = F.when(F.col("place") == 1, F.concat(root, F.filter("base", lambda t: t["depth"] <= F.col("h")))).otherwise(F.filter(root, lambda _: F.lit(False)))
    later = F.array(F.struct((F.col("place") - F.col("h") + F.least("h", F.size("base"))).alias("depth"), "digest", "words"))
    every = F.concat(opened, F.when(F.col("place") > F.col("h"), later).otherwise(F.filter(root, lambda _: F.lit(False))))
    return rows.select("family", "conv_id", F.explode(every).alias("t")).select("family", "conv_id", "t.depth", "t.digest", "t.words")


def family_tries(conversations: DataFrame) -> DataFrame:
    """Nodes of each family's trie: family, depth, k1, k2, the parent's p1, p2, words, convs and ends (ascending ids of at most a family)."""
    along = Window.partitionBy("family", "conv_id").orderBy("depth")
    rows = rebuilt(conversations).withColumns({f"g{i}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "digest")).otherwise(0) for i in (1, 2)})
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"k1": F.bit_xor("g1").over(so_far), "k2": F.bit_xor("g2").over(so_far), "last": F.lead("depth").over(along).isNull()})
    nodes = rows.groupBy("family", *_NODE).agg(
        F.max("g1").alias("g1"), F.max("g2").alias("g2"), F.max("words").alias("words"),
        F.sort_array(F.collect_list("conv_id")).alias("convs"), F.sort_array(F.collect_list(F.when(F.col("last"), F.col("conv_id")))).alias("ends"))
    return nodes.select("family", *_NODE, *[F.col(f"k{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)], "words", "convs", "ends")


def global_nodes(families: DataFrame) -> DataFrame:
    """The trie's nodes: depth, k1, k2, p1, p2, conv_id (owner), n_convs, n_children."""
    nodes = families.groupBy(*_NODE).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min(F.col("convs")[0]).alias("conv_id"), F.sum(F.size("convs")).alias("n_convs"))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(kids, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def subtree_sums(families: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, k1, k2, n_leaves, saved_tokens)."""
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    paths = families.select("family", *_NODE, "words", F.explode("convs").alias("conv_id"))
    rows = paths.unionByName(owned.withColumn("family", family_of(F.col("conv_id"))), allowMissingColumns=True).repartition("family")
    one, up = Window.partitionBy("family", "conv_id"), Window.partitionBy("family", "conv_id").orderBy(F.desc_nulls_last("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"own_from": F.max("own_from").over(one), "leaf": F.coalesce(F.max("leaf").over(one), F.lit(0))})
    rows = rows.withColumn("saved", F.sum(F.when(F.col("own_from").isNull() | (F.col("depth") < F.col("own_from")), F.col("words")).otherwise(0)).over(up)).where("depth is not null")
    within = rows.groupBy("family", *_NODE).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    return within.groupBy(*_NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces joined by commas. Rows are sorted by node; a node may go on over many batches."""
    at, running, found = None, None, []

    def flush():
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*_NODE, "ends_sha256"])

    for batch in batches:
        for *node, piece in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*_NODE, "piece")], strict=True):
            if node != at:
                if at is not None:
                    found.append((*at, running.hexdigest()))
                at, running = node, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        yield flush()
        found.clear()
    if at is not None:
        found.append((*at, running.hexdigest()))
    yield flush()


def end_hashes(families: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end."""
    common.ship(families.sparkSession)
    pieces = families.where(F.size("ends") > 0).select(*_NODE, "family", F.array_join("ends", ",").alias("piece"))
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "family").mapInArrow(hash_runs, "depth int, k1 bigint, k2 bigint, ends_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    families = common.materialize(family_tries(conversations), "families")
    nodes = common.materialize(global_nodes(families), "nodes")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.join(subtree_sums(families, nodes), _NODE).join(end_hashes(families), _NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
