"""Lookup of one id's evidence: an inverted table from ids to the rows of any table that hold them.

Every column that holds an id or a list of ids gives a row (id, source, role, key) for each id; the rows are written
once, in buckets of the id, so a lookup reads the buckets of the ids that are asked for and no other file.

Defined cases: null ids and null or empty lists give nothing; an id that stands twice in a list counts once; an id that
nothing holds finds nothing; repeated rows of a table give one posting each time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def postings(sources: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(id, source, role, key). sources: name to (table, its key column, columns of ids or lists of ids); role is the column's name."""
    def of(name: str, table: DataFrame, key: str, column: str) -> DataFrame:
        ids = F.explode(F.array_distinct(F.transform(F.col(column), lambda x: x.cast("string")))) if dict(table.dtypes)[column].startswith("array") else F.col(column).cast("string")
        return table.select(ids.alias("id"), F.lit(name).alias("source"), F.lit(column).alias("role"), F.col(key).cast("string").alias("key")).where("id is not null")

    return reduce(DataFrame.union, [of(name, table, key, c) for name, (table, key, columns) in sources.items() for c in columns])


def _bucket(id_column, buckets: int):
    return F.pmod(F.xxhash64(id_column), F.lit(buckets)).cast("int")


def write(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings in files by bucket, sorted by id within, so that statistics of files skip most of a bucket, too."""
    marked = rows.withColumn("bucket", _bucket(F.col("id"), buckets))
    marked.repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, ids: list[str], buckets: int = 64) -> DataFrame:
    """Postings of a few given ids; the plan's partition filter names their buckets."""
    wanted = [r.b for r in spark.createDataFrame([(i,) for i in ids], "id string").select(_bucket(F.col("id"), buckets).alias("b")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted) & F.col("id").isin(ids)).drop("bucket")


def lookup_all(spark: SparkSession, path: str, ids: DataFrame, buckets: int = 64) -> DataFrame:
    """Postings of a table of ids (column id), joined on bucket and id so that partitions are pruned while it runs."""
    asked = ids.select("id").where("id is not null").distinct().withColumn("bucket", _bucket(F.col("id"), buckets))
    return spark.read.parquet(path).join(asked, ["bucket", "id"]).drop("bucket")
