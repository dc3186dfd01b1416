"""Keyed tables: changes go into the buckets that hold their keys, each change set exactly once.

A keyed table is a folder of Parquet files, one subfolder a bucket, a row's bucket being a hash of its key. A change set
is applied in steps that may each be repeated: what the touched buckets are to hold is written to a folder of its own;
it replaces those buckets; a receipt is added. Whoever finds the first step done and no receipt goes on from there, so a
driver may be lost at any point. A change set whose receipt is there changes nothing. Other buckets' files stay as they are.

Defined cases: changes without a key do nothing; of several changes of a key the one with the highest ordinal counts,
equal ordinals by the greater row hash; a change with a lower ordinal than the row that is there is too late and does
nothing; null ordinals are the lowest; a change marked as a deletion leaves a row that remembers its ordinal and is not
read; an empty change set leaves a receipt only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class StaleBase(ValueError):
    """A change set was made against rows that have changed since."""


@dataclass(frozen=True)
class KeyedTable:
    """path: its folder. keys: columns that name a row. buckets: fixed when the table is created. ordinal: column by which later changes win."""

    path: str
    keys: tuple[str, ...]
    buckets: int = 16
    ordinal: str = "ordinal"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _exists(self, spark: SparkSession, name: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def create(self, rows: DataFrame) -> None:
        """Writes the first rows, one a key."""
        marked = rows.withColumns({"deleted": F.lit(False), "bucket": self._bucket()})
        marked.limit(0).write.parquet(f"{self.path}/like")  # holds the schema, also while there are no rows
        marked.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows")

    def _rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(spark.read.parquet(f"{self.path}/like").schema).parquet(f"{self.path}/rows")

    def read(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark).where(~F.col("deleted")).drop("deleted", "bucket")

    def receipts(self, spark: SparkSession) -> DataFrame:
        """(receipt, changes, touched): applied change sets, keys they changed and buckets they rewrote."""
        kind = "receipt string, changes bigint, touched int"
        return spark.read.schema(kind).parquet(f"{self.path}/receipts") if self._exists(spark, "receipts") else spark.createDataFrame([], kind)

    def applied(self, spark: SparkSession, receipt: str) -> bool:
        return bool(self.receipts(spark).where(F.col("receipt") == receipt).take(1))

    def patched(self, fields: DataFrame) -> DataFrame:
        """Whole rows for ``apply`` from changes of some columns only: the others are taken from the rows that are there, null for new keys. Only fields' own buckets are read."""
        rows = self._rows(fields.sparkSession)
        given = [c for c in fields.columns if c not in self.keys]
        asked = fields.select(*self.keys, *[F.col(f"`{c}`").alias(f"_f_{c}") for c in given]).withColumn("bucket", self._bucket())
        there = rows.where(~F.col("deleted")).drop("deleted", *given)
        return asked.join(there, ["bucket", *self.keys], "left").select(*self.keys, *[F.col(f"_f_{c}").alias(c) for c in given], *[c for c in there.columns if c not in (*self.keys, "bucket")])

    def stale(self, changes: DataFrame) -> DataFrame:
        """Changes with a column base (digest of the row they were made against, null: none) whose row is another now."""
        now = self.read(changes.sparkSession)
        now = now.select(*self.keys, row_digest(now).alias("_now"))
        return changes.join(now, [*self.keys], "left").where(~F.col("base").eqNullSafe(F.col("_now")))

    def apply(self, changes: DataFrame, receipt: str, fault=None) -> bool:
        """Merges changes (the table's columns; deleted and base are optional); false if the receipt is there already.

        A column base makes every change depend on the row that it was made against: if any is stale, nothing is applied and StaleBase is raised.
        fault: called with the name of each step when it is done; tests and replays break off there.
        """
        spark, staged = changes.sparkSession, f"_staged-{receipt}"
        fault = fault or (lambda step: None)
        if self.applied(spark, receipt):
            return False
        if not self._exists(spark, f"{staged}/_SUCCESS"):
            changes = changes.where(F.concat(*[F.col(f"`{k}`").cast("string") for k in self.keys]).isNotNull())
            if "base" in changes.columns:
                if late := self.stale(changes).limit(5).collect():
                    raise StaleBase(f"{receipt}: made against other rows: {[tuple(r[k] for k in self.keys) for r in late]}")
                changes = changes.drop("base")
            if "deleted" not in changes.columns:
                changes = changes.withColumn("deleted", F.lit(False))
            changes = changes.withColumn("bucket", self._bucket())
            touched = [r.bucket for r in changes.select("bucket").distinct().collect()]  # at most the table's buckets
            there = self._rows(spark).where(F.col("bucket").isin(touched))
            self._latest(there, changes).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{staged}")
            fault("staged")
        given = spark.read.schema(self._rows(spark).schema).parquet(f"{self.path}/{staged}")
        marks = given.agg(F.countDistinct("bucket").cast("int").alias("touched")).collect()[0]
        if marks.touched:
            given.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/rows")
        fault("replaced")
        n = changes.select(*self.keys).distinct().count()
        spark.createDataFrame([(receipt, n, marks.touched)], "receipt string, changes bigint, touched int").coalesce(1).write.mode("append").parquet(f"{self.path}/receipts")
        fault("receipt")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{staged}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return True

    def _latest(self, there: DataFrame, changes: DataFrame) -> DataFrame:
        # At equal ordinals a change goes before the row that is there: replaying a change set gives the same rows.
        every = there.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
        order = [F.desc_nulls_last(self.ordinal), F.desc("_new"), F.desc(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in there.columns]))]
        return every.withColumn("_place", F.row_number().over(Window.partitionBy("bucket", *self.keys).orderBy(*order))).where("_place = 1").select(*[F.col(f"`{c}`") for c in there.columns])


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's columns, by name."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def bundle(table: KeyedTable, items: DataFrame, size: int = 100) -> DataFrame:
    """Rows of a table that await review (items: its columns) with base, the digest that a later apply must find, and a bundle number a run of ``size`` keys in each bucket."""
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*table.keys))
    rows = items.withColumns({"base": row_digest(items), "_bucket": table._bucket()})
    return rows.withColumn("bundle", F.concat_ws("-", "_bucket", F.floor((place - 1) / size).cast("string"))).drop("_bucket")
