"""Exact deduplication with the heavy digests split off, DataFrame functions only.

A document's digest is the SHA-256 of its text without blanks ``[\\x20\\x09-\\x0D]``. A mergeable Misra-Gries
summary (Spark's frequent-items aggregate) over all digests names every digest that may hold 1/4096 of the rows or
more; those are counted exactly, and the winners of the ones that do are broadcast (at most 4,096 rows of about 100
bytes, whatever the table's size), so that their copies are recognised where they are read. All other digests are
shuffled as usual: none of them can hold more than 1/4096 of the rows. Summaries merge in two steps, so that no task
gets one from each task of the scan.

Of equal texts the row with the most code points stays, then the smallest doc_id (null last), then the first place in
the table; so of rows that are equal throughout exactly one stays.

Defined cases: null text counts as empty; empty texts and texts of blanks only equal one another; a null doc_id is a
row like others; an empty table gives an empty table. Extra columns are dropped by ``report`` and kept by
``remove_copies``; working columns have the prefix ``_x_`` and input columns that have it are refused. ``remove_copies``
tells repeated rows apart by their place, so its input must give the same rows in the same order when read again, as
a table in files does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.llm import common

BLANKS = " \t\n\x0b\x0c\r"
#: A digest of at least this part of all rows is heavy.
HEAVY = 4096
#: Counters of the summary. Its error stays under 3.5 rows in 2 * TRACKED, so every heavy digest is among those it names.
TRACKED = 4 * HEAVY
#: Groups of tasks whose summaries merge first.
FAN = 256


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _digested(docs: DataFrame) -> DataFrame:
    clash = [c for c in docs.columns if c.startswith("_x_")]
    if clash:
        raise ValueError(f"columns with the reserved prefix _x_: {clash}")
    return docs.withColumns({
        "_x_digest": F.unhex(F.sha2(normalized(docs["text"]), 256)),
        "_x_rank": F.struct((-F.length(common.text_column(docs))).alias("chars"), docs["doc_id"].isNull().alias("no_id"), docs["doc_id"].alias("doc_id"), F.monotonically_increasing_id().alias("row")),
    })


def digests(docs: DataFrame) -> DataFrame:
    """One row per document, written to the shared folder: _x_digest and _x_rank, the order in which equal texts are preferred."""
    return common.materialize(_digested(docs.select("doc_id", "text")).select("_x_digest", "_x_rank"), "digests")


def candidates(rows: DataFrame) -> DataFrame:
    """(_x_item, _x_rows): hashes of digests that may be heavy, at most TRACKED of them, and the number of all rows."""
    items = rows.select(F.xxhash64("_x_digest").alias("item"), F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("fan"))
    some = items.groupBy("fan").agg(F.expr(f"approx_top_k_accumulate(item, {TRACKED})").alias("summary"), F.count(F.lit(1)).alias("n"))
    # Grouped by a constant: the aggregate fails to merge the summary that a global one makes of an empty partition.
    whole = some.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {TRACKED}), {TRACKED})").alias("top"), F.sum("n").alias("n"))
    named = whole.select("n", F.explode("top").alias("t"))
    return named.where((F.col("t.count") > 1) & (F.col("t.count") * HEAVY >= F.col("n"))).select(F.col("t.item").alias("_x_item"), F.col("n").alias("_x_rows"))


def heavy_winners(rows: DataFrame) -> DataFrame:
    """(_x_digest, _x_best, _x_size) of the heavy digests, counted exactly; written to the shared folder."""
    named = F.broadcast(candidates(rows))
    counted = rows.withColumn("_x_item", F.xxhash64("_x_digest")).join(named, "_x_item").groupBy("_x_digest").agg(F.min("_x_rank").alias("_x_best"), F.count(F.lit(1)).alias("_x_size"), F.max("_x_rows").alias("_x_rows"))
    return common.materialize(counted.where(F.col("_x_size") * HEAVY >= F.col("_x_rows")).drop("_x_rows"), "heavy")


def classified(rows: DataFrame) -> DataFrame:
    """rows of ``digests`` with _x_best, the row that stays, and _x_size, how many texts are equal."""
    winners = F.broadcast(heavy_winners(rows))
    heavy = rows.join(winners, "_x_digest")
    same = Window.partitionBy("_x_digest")
    rest = rows.join(winners, "_x_digest", "left_anti").withColumns({"_x_best": F.min("_x_rank").over(same), "_x_size": F.count(F.lit(1)).over(same)})
    return heavy.unionByName(rest)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return classified(digests(docs)).select(
        F.col("_x_rank.doc_id").alias("doc_id"), F.col("_x_best.doc_id").alias("keep_id"), F.col("_x_size").alias("group_size"),
        (F.col("_x_rank.row") == F.col("_x_best.row")).alias("kept"), F.lower(F.hex("_x_digest")).alias("text_sha256"))


def remove_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the input's own columns. Copies of heavy digests go where they are read; one shuffle finds the others."""
    winners = F.broadcast(heavy_winners(digests(docs)).select("_x_digest", "_x_best"))
    rows = _digested(docs).join(winners, "_x_digest", "left").where(F.col("_x_best").isNull() | (F.col("_x_best.row") == F.col("_x_rank.row")))
    place = F.row_number().over(Window.partitionBy("_x_digest").orderBy("_x_rank"))
    return rows.withColumn("_x_place", place).where("_x_place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
