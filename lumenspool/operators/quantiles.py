"""Exact medians and discrete percentiles of large groups: a histogram first, then only the bins that hold the ranks asked for.

Bins are a fixed function of the value, ascending with it, 1,024 to a doubling, so the histogram needs no look at the
data before and is combined in the tasks that read them. The ranks' bins are found from its sums; only their values
are counted one by one. No task holds a group's values, as an aggregate of the whole group would.

Defined cases: nulls and NaN do not count; a group without values has null results; null keys are a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PER_DOUBLING = 1024


def _bin(value: Column) -> Column:
    """Place of a value in an ascending series of bins: signed logarithm, finer near zero than 1e-12."""
    return F.signum(value).cast("long") * F.floor(F.log2(1 + F.abs(value) * 1e12) * PER_DOUBLING)


def _ranks(n: Column, what: float | str) -> list[Column]:
    """Places from 0, of n values in order, whose mean is the result."""
    if what == "median":
        return [F.floor((n - 1) / 2), F.floor(n / 2)]
    return [F.greatest(F.ceil(n * F.lit(what)) - 1, F.lit(0))]


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float | str]) -> DataFrame:
    """keys and a column for each of wanted: "median" (the mean of both middle values) or a share (the least value with that share of values up to it)."""
    x = F.col(value).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(x), x).alias("_x")).withColumn("_bin", _bin(F.col("_x")))
    counts = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    histogram = counts.where("_bin is not null").withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    asked = [F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, what in wanted.items() for r in _ranks(F.col("_all"), what)]
    targets = histogram.withColumn("_t", F.explode(F.array_distinct(F.array(*asked)))).where((F.col("_t.rank") >= F.col("_before")) & (F.col("_t.rank") < F.col("_before") + F.col("_n")))
    targets = targets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), "_before", F.col("_t.name").alias("_name"), F.col("_t.rank").alias("_rank"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_bin") == F.col("_b"))
    inside = targets.select(*[f"_k{i}" for i in range(len(keys))], "_b").distinct()
    counted = rows.join(inside, same, "left_semi").groupBy(*keys, "_bin", "_x").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_ahead", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    found = counted.join(targets, same).where((F.col("_rank") >= F.col("_before") + F.col("_ahead")) & (F.col("_rank") < F.col("_before") + F.col("_ahead") + F.col("_n")))
    results = found.groupBy(*keys).agg(*[F.avg(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in wanted])
    every = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return every.join(results, on, "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *wanted)
