"""Language ID of web pages by Bayesian evidence fusion.

The posterior over languages adds up log evidence from four sources:

* text: multinomial naive Bayes over hashed letter trigrams of the page's visible text, trained on all
  of ``documents`` by its lang (a page's text counts at most as ``TEXT_WORTH`` trigrams, since neighbours
  depend on each other);
* the declared lang attribute of the markup, by how often declarations of a language are right;
* the address suffix: top-level domain and first path segment;
* the host, by hierarchically smoothed priors: host shrinks to its registered domain, that to all pages.

The last three are tables of votes made by grouped aggregation over all pages' text verdicts; they are
smoothed by pseudo-counts, and a page's own vote is taken out again where its evidence is summed, so
that its text counts once. Grouped sums are partial before they are shuffled, so a host with a third of
all pages is one row a task. Trigrams are hashed into ``BUCKETS``, which merges rare ones; tables join by key.

Defined cases: a page without text, url and declaration gets the overall prior's best language and
that prior as confidence; null html or url is missing evidence; ties go to the alphabetically first
language; no labelled document at all gives a null language; repeated pages are scored each; an empty
table gives an empty table; extra columns are not read. Pages are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspool.llm import common

BUCKETS, TEXT_WORTH, SMOOTH = 1 << 15, 60.0, 0.5
#: Pseudo-counts of the parent level in a host's prior, of evenness in declared and suffix tables.
HOST_WEIGHT, EVEN_WEIGHT = 4.0, 2.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_LETTER, np.arange(256) | np.where(np.arange(256) < 128, 32, 0), 32).astype(np.uint32)


def trigram_rows(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all byte trigrams with at least two letters, none across rows."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _FOLD[data]
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(17)
    row = np.searchsorted(offsets, np.arange(len(code)), "right") - 1
    ok = ((x[:-2] != 32).astype(np.int8) + (x[1:-1] != 32) + (x[2:] != 32) >= 2) & (np.arange(len(code)) + 2 < offsets[row + 1])
    return code[ok].astype(np.int64), row[ok]


def visible(html: str) -> Column:
    """Text of a page: scripts, styles, navigation, comments and tags gone."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(body, r"&[a-zA-Z#0-9]{1,8};", " ")


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood [language, bucket]) from all documents with a lang."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.by_text(batches):
            offsets, data = common.utf8_parts(batch.column(1))
            bucket, row = trigram_rows(offsets, data)
            lang = batch.column(0).dictionary_encode()
            names, number = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            for k, name in enumerate(names):
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                sums[name] += np.bincount(bucket[number[row] == k], minlength=BUCKETS)
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(s[at])], ["lang", "bucket", "n"])

    found = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((len(langs), BUCKETS), SMOOTH)
    for k, name in enumerate(langs):
        own = found[found["lang"] == name]
        table[k, own["bucket"]] += own["n"]
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def text_evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """pages (page_id, url, declared, text) with text_log array<double> in place of text."""
    shared = pages.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    kinds = ", ".join(f"{c} {t}" for c, t in pages.dtypes if c != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in common.by_text(batches):
            at = batch.schema.get_field_index("text")
            offsets, data = common.utf8_parts(batch.column(at))
            bucket, row = trigram_rows(offsets, data)
            many = np.bincount(row, minlength=batch.num_rows)
            scores = np.stack([np.bincount(row, weights=x[bucket], minlength=batch.num_rows) for x in logs], 1) if len(logs) else np.zeros((batch.num_rows, 0))
            scores = scores.astype(np.float64) * (np.minimum(1.0, TEXT_WORTH / np.maximum(many, 1)))[:, None]
            scores -= scores.max(1, keepdims=True) if len(logs) else 0
            rest = batch.remove_column(at)
            yield rest.append_column("text_log", pa.array(list(scores), pa.list_(pa.float64())))

    return pages.mapInArrow(run, f"{kinds}, text_log array<double>")


def _shares(votes: Column, own: Column, parent: Column, weight: float) -> Column:
    """Each language's share of the votes (thousandths) without the page's own, shrunk to the parent's shares by ``weight`` votes."""
    left = F.zip_with(votes, own, lambda v, o: (v - o) / 1000)
    total = F.aggregate(left, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(left, parent, lambda v, p: (v + weight * p) / (total + weight))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host of every page."""
    common.ship(pages.sparkSession)
    langs, table = train(docs)
    k = len(langs)
    if not k:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.select(
        "page_id", host.alias("host"), declared.alias("declared"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.concat_ws("/", F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))).alias("suffix"),
        visible("html").alias("text"))
    rows = common.materialize(text_evidence(rows, langs, table), "page-evidence")
    # Soft votes of the text's verdict, in whole thousandths so that sums do not depend on order.
    weights = F.transform("text_log", lambda x: F.exp(x))
    rows = rows.withColumn("own", F.transform(weights, lambda x: F.floor(1000 * x / F.aggregate(weights, F.lit(0.0), lambda a, y: a + y))))
    votes = F.array(*[F.sum(F.col("own")[i]) for i in range(k)])
    overall = rows.agg(votes.alias("votes")).first().votes
    tables = {c: rows.where(F.col(c) != "").groupBy(c).agg(votes.alias(f"{c}_votes")) for c in ("declared", "suffix", "domain", "host")}
    fused = rows
    for c, found in tables.items():
        fused = fused.join(found, c, "left")
    every = F.array(*[F.lit(int(v or 0)).cast("long") for v in overall])
    # Shares of each table without the page's own vote; null where the page has no such key.
    level = lambda name, parent, weight: _shares(F.col(f"{name}_votes"), F.col("own"), parent, weight)
    even = F.array(*[F.lit(1.0 / k)] * k)
    fused = fused.withColumn("prior", _shares(every, F.col("own"), even, float(k)))
    fused = fused.withColumn("prior", F.coalesce(level("domain", F.col("prior"), HOST_WEIGHT), F.col("prior")))
    fused = fused.withColumn("prior", F.coalesce(level("host", F.col("prior"), HOST_WEIGHT), F.col("prior")))
    # Declared and suffix shares count as likelihood ratios against evenness, the host's as the prior.
    ratio = lambda name, i: F.coalesce(F.log(level(name, even, EVEN_WEIGHT)[i] * k), F.lit(0.0))
    logs = F.array(*[F.col("text_log")[i] + ratio("declared", i) + ratio("suffix", i) + F.log(F.col("prior")[i]) for i in range(k)])
    fused = fused.withColumn("logs", logs).withColumn("best", F.array_max("logs"))
    names = F.array(*[F.lit(x) for x in langs])
    share = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    pick = lambda c, m: F.element_at(names, F.array_position(c, m).cast("int"))
    return fused.select(
        "page_id", pick(F.col("logs"), F.col("best")).alias("lang"), F.round(share, 6).alias("confidence"),
        pick(F.col("text_log"), F.array_max("text_log")).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), F.nullif("host", F.lit("")).alias("host"))
