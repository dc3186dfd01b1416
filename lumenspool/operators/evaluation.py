"""Evaluation of outputs: expected sentences, baselines, timings, owner policies. A case is a row; nothing meets but by case.

Defined cases: a case without report fails; a baseline of null or 0 is not compared; null measurements are missing evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text without overlap; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def fixture_checks(cases: DataFrame) -> DataFrame:
    """cases (case_id, text, expected_spoken, expected_tokens arrays) with spoken_matches (exactly once), in_order, token_matches, valid.

    A null text is empty; an empty expectation is never found, so it is neither matched nor in order.
    """
    cases = cases.withColumn("text", F.coalesce("text", F.lit("")))
    places = F.transform("expected_spoken", lambda s: F.when(F.length(s) > 0, F.position(s, F.col("text"))).otherwise(0))
    rows = cases.withColumn("places", places)
    once = F.size(F.filter("expected_spoken", lambda s: occurrences(F.col("text"), s) == 1))
    found = F.size(F.filter("expected_tokens", lambda t: F.contains(F.col("text"), t)))
    ordered = F.forall("places", lambda p: p > 0) & (F.array_sort("places") == F.col("places"))
    rows = rows.withColumns({"spoken_matches": once, "in_order": ordered, "token_matches": found})
    return rows.withColumn("valid", (F.col("spoken_matches") == F.size("expected_spoken")) & F.col("in_order") & (F.col("token_matches") == F.size("expected_tokens"))).drop("places")


def elapsed(median: Column, single: Column) -> Column:
    return F.coalesce(median, single)


def performance(reported: Column, current: Column, baseline: Column, threshold: float) -> Column:
    """struct(status, pass, regression) of a case's time against its baseline."""
    regression = current / baseline - 1
    status = F.when(~reported, "missing").when(baseline.isNull() | (baseline <= 0), "not_compared").when(current.isNull(), "unavailable").otherwise("compared")
    ok = F.when(status.isin("missing", "unavailable"), F.lit(False)).when(status == "compared", regression <= threshold)
    return F.struct(status.alias("status"), ok.alias("passed"), F.when(status == "compared", F.round(regression, 6)).alias("regression"))


def evaluate_cases(baseline: DataFrame, reports: DataFrame, threshold: float = 0.15) -> DataFrame:
    """A row a baseline case: quality errors and the comparison of times.

    baseline: case_id, spoken, tokens, events, baseline_seconds. reports: case_id, production_valid, spoken_count, token_count, spoken_matches, token_matches, events_seen, median_seconds, elapsed_seconds.
    """
    rows = baseline.join(reports.withColumn("_reported", F.lit(True)), "case_id", "left").withColumn("_reported", F.coalesce("_reported", F.lit(False)))
    c = F.col
    differs = lambda seen, want: c(want).isNotNull() & ~c(seen).eqNullSafe(c(want))
    short = lambda seen, want: c(want).isNotNull() & (c(seen).isNull() | (c(seen) < c(want)))
    rules = [("production output validation failed", ~F.coalesce("production_valid", F.lit(False))), ("expected_spoken_count", differs("spoken_count", "spoken")), ("expected_token_count", differs("token_count", "tokens")),
             ("spoken_matches", short("spoken_matches", "spoken")), ("token_matches", short("token_matches", "tokens")), ("visual_event_count", short("events_seen", "events"))]
    found = F.array_sort(F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in rules])))
    errors = F.when(~c("_reported"), F.array(F.lit("no evaluator result was produced"))).otherwise(found)
    return rows.select("case_id", errors.alias("errors"), performance(c("_reported"), elapsed(c("median_seconds"), c("elapsed_seconds")), c("baseline_seconds"), threshold).alias("p")).select("case_id", (F.size("errors") == 0).alias("quality_pass"), "errors", "p.*")


def gate(cases: DataFrame, require_performance: bool = False) -> DataFrame:
    """One row: quality_pass, performance_pass (null if nothing was compared), gate_pass."""
    row = cases.agg(F.every("quality_pass").alias("quality_pass"), F.when(F.bool_or(F.col("passed") == False), False).when(F.count_if(F.col("status") == "compared") > 0, True).alias("performance_pass"))  # noqa: E712
    performance_ok = F.coalesce(F.col("performance_pass"), F.lit(not require_performance))
    return row.withColumn("gate_pass", F.col("quality_pass") & performance_ok)


def policy_reasons(report: dict[str, Column], policy: dict) -> Column:
    """Why a report fails an owner's policy, in order."""
    must = [("workload_id mismatch", report["workload_id"] == policy["workload_id"]), ("cache_reused must be false", ~report["cache_reused"]), ("validation_valid must be true", report["validation_valid"]),
            ("missing quality.media_duration_ms", report["media_duration_ms"].isNotNull()), ("media duration is below policy minimum", F.coalesce(report["media_duration_ms"] >= policy["min_media_duration_s"] * 1000, F.lit(True))),
            ("quality_contract_sha256 mismatch", report["contract"] == policy["contract"]), ("missing elapsed_seconds", report["elapsed_seconds"].isNotNull()), ("elapsed_seconds exceeds policy target", F.coalesce(report["elapsed_seconds"] <= policy["max_elapsed_seconds"], F.lit(True))),
            ("missing timing_summary.p95_seconds", report["p95_seconds"].isNotNull()), ("timing_summary.p95_seconds exceeds policy target", F.coalesce(report["p95_seconds"] <= policy["max_p95_seconds"], F.lit(True)))]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in must]))


def fingerprints(reports: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, reason): runtime fields that a report of the key lacks or in which its reports differ."""
    sums = reports.groupBy(key).agg(*[F.struct(F.count_if(F.col(f).isNull()).alias("missing"), F.min(f).cast("string").alias("low"), F.max(f).cast("string").alias("high")).alias(f) for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f"{f}.missing") > 0, "missing").when(F.col(f"{f}.low") != F.col(f"{f}.high"), "not identical").alias("reason")) for f in fields])
    return sums.select(key, F.explode(each).alias("x")).select(key, "x.*").where("reason is not null")


def verdicts(reports: DataFrame, combined: DataFrame, key: str, minimum: int) -> DataFrame:
    """(key, reports, verdict): qualified if all of at least ``minimum`` reports are without reasons and nothing speaks against them together. reports: key, reasons."""
    sums = reports.groupBy(key).agg(F.count(F.lit(1)).alias("reports"), F.sum(F.size("reasons")).alias("_reasons"))
    against = combined.groupBy(key).agg(F.count(F.lit(1)).alias("_together"))
    rows = sums.join(against, key, "left")
    bad = (F.col("_reasons") > 0) | (F.coalesce("_together", F.lit(0)) > 0) | (F.col("reports") < minimum)
    return rows.select(key, "reports", F.when(bad, "rejected").otherwise("qualified").alias("verdict"))


def manifest_errors(manifest: DataFrame, cases: DataFrame) -> DataFrame:
    """(error, case_id) of a manifest (case_id, media_sha256, coverage): repeated ids, malformed hashes, unknown coverage; and references to cases that it does not have."""
    again = manifest.groupBy("case_id").count().where("count > 1").select(F.lit("duplicate case id").alias("error"), "case_id")
    rules = [("malformed sha256", ~F.coalesce(F.col("media_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))), ("unknown coverage status", ~F.coalesce(F.col("coverage").isin("covered", "planned", "blocked"), F.lit(False)))]
    bad = [manifest.where(on).select(F.lit(why).alias("error"), "case_id") for why, on in rules]
    lost = cases.join(manifest.select("case_id").distinct(), "case_id", "left_anti").select(F.lit("unknown case").alias("error"), "case_id")
    return reduce(DataFrame.union, [again, *bad, lost])
