"""Resuming work: what a change makes stale, results kept by content, change data between two states.

``downstream`` follows dependencies from what has changed; ``reuse`` computes only contents without a result and keeps
theirs; ``changes`` compares two tables by key and says what was added, removed or altered, ``refreshed`` applies that.

Defined cases: null ends of a dependency are no dependency; cycles end, since nothing is visited twice; null contents
have no result; equal contents are computed once; rows of equal key are compared as multisets (equal ones cancel, what
is left is paired in order of signature); null keys equal one another; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.sinks.keyed import KeyedTable
from lumenspool.sinks.shared import written


def downstream(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, steps): what depends on changed nodes (column node) and by how few steps; changed ones at 0. edges: source, target.

    A round joins only what the round before found, and leaves out what any round found, so each edge is followed once.
    Equal edges are not brought together: only those that start at the frontier count, and what they reach is made distinct.
    """
    edges = edges.where("source is not null and target is not null")
    frontier = written(changed.select("node").where("node is not null").distinct().withColumn("steps", F.lit(0)), "stale")
    rounds = [frontier]
    while not frontier.isEmpty():
        seen = rounds[0]
        for more in rounds[1:]:
            seen = seen.union(more)
        reached = edges.join(frontier.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        frontier = written(reached.join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(len(rounds))), "stale")
        rounds.append(frontier)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.union(more)
    return out


def invalidated(stages: list[str], markers: DataFrame, stage: str) -> DataFrame:
    """markers (item, stage, ..) that fall when a stage of an ordered list runs anew: its own and those of later stages."""
    if stage not in stages:
        raise ValueError(f"unknown stage: {stage}")
    return markers.where(F.col("stage").isin(stages[stages.index(stage):]))


def results_table(path: str, buckets: int = 16) -> KeyedTable:
    """A table of results by content: content_key, the results' columns, ordinal."""
    return KeyedTable(path, ("content_key",), buckets)


def misses(requests: DataFrame, results: DataFrame) -> DataFrame:
    """One request of each content (column content_key) that has no result."""
    return requests.where("content_key is not null").dropDuplicates(["content_key"]).join(results.select("content_key"), "content_key", "left_anti")


def reuse(requests: DataFrame, table: KeyedTable, compute: Callable[[DataFrame], DataFrame], receipt: str) -> DataFrame:
    """requests with the results' columns; what has none is computed first (compute: misses to content_key and results) and kept.

    receipt names the run: when it is repeated after a loss it goes on from what it had kept. A run without misses writes its receipt only.
    """
    spark = requests.sparkSession
    if not table.applied(spark, receipt):
        found = written(compute(misses(requests, table.read(spark))).withColumn("ordinal", F.lit(0).cast("long")), "results")
        table.apply(found, receipt)
    return requests.join(table.read(spark).drop("ordinal"), "content_key", "left")


def signature(*columns: Column) -> Column:
    """Digest of values in which nulls differ from every text, whatever the texts hold."""
    framed = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(",", *framed), 256)


def changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, ``op`` (insert, update, delete), new columns (null for deletes), before and after (signatures): what turns old into new."""
    def counted(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*keys, *columns, signature(*[F.col(c) for c in columns]).alias("_s"), F.lit(sign).alias("_side"))

    rows = counted(old, -1).union(counted(new, 1))
    alike = Window.partitionBy(*keys, "_s")
    place = F.row_number().over(Window.partitionBy(*keys, "_s", "_side").orderBy("_side"))
    both = F.least(F.count_if(F.col("_side") < 0).over(alike), F.count_if(F.col("_side") > 0).over(alike))
    left = rows.withColumns({"_place": place, "_both": both}).where("_place > _both")  # equal rows of both sides cancel
    left = left.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_side").orderBy("_s")))
    of = lambda side, c: F.max(F.when(F.col("_side") == side, F.struct(c))).getField(c)
    out = left.groupBy(*keys, "_n").agg(of(-1, "_s").alias("before"), of(1, "_s").alias("after"), *[of(1, c).alias(c) for c in columns])
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return out.select(*keys, op.alias("op"), *columns, "before", "after")


def refreshed(table: DataFrame, delta: DataFrame, keys: list[str], columns: list[str], keep: list[str]) -> DataFrame:
    """table (one row a key: keys, columns, keep) after ``changes`` of other tables: altered columns replaced, ``keep`` (decisions, say) as it was, new keys added, deleted ones gone."""
    marked = delta.select(*[F.col(k).alias(f"_{k}") for k in keys], "op", *[F.col(c).alias(f"_n_{c}") for c in columns])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    both = table.withColumn("_there", F.lit(True)).join(marked, on, "full_outer").where("op is null or op <> 'delete'")
    new = F.col("op").isNotNull()
    return both.select(*[F.when(F.col("_there"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys], *[F.when(new, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in columns], *keep)


def carried_state(items: DataFrame, earlier: DataFrame, key: str, compared: list[str], state: list[str]) -> DataFrame:
    """items with ``state`` of the earlier item of the same key if their signatures are equal, else null; and ``reused``. One earlier item a key: the last by signature."""
    s = signature(*[F.col(c) for c in compared])
    last = earlier.select(F.col(key).alias("_key"), s.alias("_was"), *[F.col(c).alias(f"_{c}") for c in state])
    last = last.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_was")))).where("_rn = 1")
    rows = items.withColumn("_is", s).join(last, F.col(key) == F.col("_key"), "left")
    same = F.coalesce(F.col("_is") == F.col("_was"), F.lit(False))
    return rows.select(*items.columns, *[F.when(same, F.col(f"_{c}")).alias(c) for c in state], same.alias("reused"))
