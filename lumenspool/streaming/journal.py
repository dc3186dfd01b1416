"""Journals as streams: latest change by key with exactly-once effect, and append-only evidence by image.

``replay`` folds a stream of journal entries into a keyed table: each micro-batch is a change set whose receipt is the
journal's name and the batch's number, so a batch that is delivered again changes nothing, wherever the run before
broke off. ``revisions_stream`` keeps a small state for each image and says of every observation whether it became a
revision; ``revisions`` does the same for a table.

Evidence rules: an observation whose id the image has accepted before is a duplicate (equal content) or a conflict
(other content) and is refused; one whose base is not the image's latest revision is stale, and is refused or, if stale
bases are allowed, accepted and marked; any other is accepted. An accepted observation is the image's next revision.

Defined cases: observations without image or id are refused as invalid; a null base means that there was no revision
yet; observations come in the order of their ordinals, equal ordinals by id and digest; null ordinals first. A stream
orders what one batch brings; a later batch comes later whatever its ordinals.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lumenspool.sinks.keyed import KeyedTable

OUTCOMES = "image_id string, ordinal bigint, observation_id string, outcome string, revision bigint, base_revision bigint"


def replay(entries: DataFrame, table: KeyedTable, journal: str, checkpoint: str, fault=None) -> StreamingQuery:
    """Starts folding a stream of entries (the table's columns) into the table, all that is there now; runs until that is done.

    fault: as in KeyedTable.apply, called with (batch number, step).
    """
    def apply(batch: DataFrame, number: int) -> None:
        table.apply(batch, f"{journal}-{number}", fault and (lambda step: fault(number, step)))

    return entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def torn(lines: DataFrame) -> DataFrame:
    """lines (journal, line, raw) with entry (VARIANT) and fault: null, torn (the last line of its journal is no JSON: it was never finished) or invalid."""
    last = lines.groupBy("journal").agg(F.max("line").alias("_last"))
    rows = lines.where("trim(raw) <> ''").withColumn("entry", F.try_parse_json("raw")).join(last, "journal")
    broken = F.col("entry").isNull() | ~F.schema_of_variant("entry").startswith("OBJECT")
    return rows.withColumn("fault", F.when(F.col("entry").isNull() & (F.col("line") == F.col("_last")), "torn").when(broken, "invalid")).drop("_last")


class _Evidence:
    """What is known of one image: its latest revision and the digest of each accepted observation."""

    def __init__(self, allow_stale: bool, latest: int = 0):
        self.allow_stale, self.latest = allow_stale, latest

    def judge(self, known: str | None, digest: str, base: int) -> tuple[str, int | None]:
        if known is not None:
            return ("duplicate" if known == digest else "conflict"), None
        if base != self.latest and not self.allow_stale:
            return "stale", None
        outcome = "accepted" if base == self.latest else "accepted_stale"
        self.latest += 1
        return outcome, self.latest


def _prepared(observations: DataFrame) -> DataFrame:
    """(image_id, ordinal, observation_id, digest, base, valid) of observations (image_id, ordinal, observation_id, digest, base_revision)."""
    return observations.select("image_id", F.col("ordinal").cast("long").alias("ordinal"), "observation_id", F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("base_revision", F.lit(0)).cast("long").alias("base"))


def revisions(observations: DataFrame, allow_stale: bool = True) -> DataFrame:
    """(image_id, ordinal, observation_id, outcome, revision, base_revision) of each observation, a fold along each image.

    Images are dealt over tasks and read in order as a stream of batches, so a task holds one batch and one image's accepted ids.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, state, seen = None, _Evidence(allow_stale), {}
        for batch in batches:
            rows = batch.to_pydict()
            outcomes, numbers = [], []
            for at, observation, digest, base in zip(rows["image_id"], rows["observation_id"], rows["digest"], rows["base"], strict=True):
                if at != image:
                    image, state, seen = at, _Evidence(allow_stale), {}
                outcome, number = state.judge(seen.get(observation), digest, base)
                if number:
                    seen[observation] = digest
                outcomes.append(outcome)
                numbers.append(number)
            yield pa.record_batch([*[batch.column(batch.schema.get_field_index(c)) for c in ("image_id", "ordinal", "observation_id")], pa.array(outcomes, pa.string()), pa.array(numbers, pa.int64()), batch.column(batch.schema.get_field_index("base"))],
                                  names=["image_id", "ordinal", "observation_id", "outcome", "revision", "base_revision"])

    rows = _prepared(observations)
    valid = F.col("image_id").isNotNull() & F.col("observation_id").isNotNull()
    refused = rows.where(~valid).select("image_id", "ordinal", "observation_id", F.lit("invalid").alias("outcome"), F.lit(None).cast("long").alias("revision"), F.col("base").alias("base_revision"))
    return rows.where(valid).repartition("image_id").sortWithinPartitions("image_id", F.asc_nulls_first("ordinal"), "observation_id", "digest").mapInArrow(fold, OUTCOMES).union(refused)


#: Accepted ids of an image that lie in one entry of its state, on average at most.
ENTRY_IDS = 256


class EvidenceProcessor(StatefulProcessor):
    """State of an image: its latest revision, the digest of each accepted observation. Images that stay quiet for ``quiet_ms`` are forgotten if that is above 0.

    A call to the state costs far more than a row, so accepted ids lie in entries by hash, as many (a power of two) as keep
    ENTRY_IDS in one on average; a batch reads and writes each entry that its ids touch once. The latest revision
    is the number of accepted ids, which says how many entries there are; when these double, all are dealt anew.
    """

    def __init__(self, allow_stale: bool = True, quiet_ms: int = 0):
        self.allow_stale, self.quiet_ms = allow_stale, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", StructType([StructField("revision", LongType())]))
        self.accepted = handle.getMapState("accepted", StructType([StructField("entry", LongType())]), StructType([StructField(c, ArrayType(StringType())) for c in ("ids", "digests")]))

    @staticmethod
    def _entries(accepted: int) -> int:
        return 1 << max(0, -(-accepted // ENTRY_IDS) - 1).bit_length()

    def _read(self, entry: int) -> dict[str, str]:
        ids, digests = self.accepted.getValue((entry,)) or ((), ())
        return dict(zip(ids, digests, strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = [[x for frame in frames for x in frame] for frames in zip(*[[r[c].tolist() for c in ("ordinal", "observation_id", "digest", "base")] for r in rows], strict=True)]
        whole = sorted(zip(*columns, strict=True), key=lambda r: (not pd.isna(r[0]), 0 if pd.isna(r[0]) else r[0], r[1], r[2]))
        before = (self.latest.get() or (0,))[0]
        state, entries = _Evidence(self.allow_stale, before), self._entries(before)
        held: dict[int, dict[str, str]] = {}
        touched, outcomes, numbers = set(), [], []
        for _, observation, digest, base in whole:
            entry = crc32(observation.encode()) % entries
            if entry not in held:
                held[entry] = self._read(entry) if before else {}
            outcome, number = state.judge(held[entry].get(observation), digest, int(base))
            if number:
                held[entry][observation] = digest
                touched.add(entry)
            outcomes.append(outcome)
            numbers.append(number)
        if (more := self._entries(state.latest)) > entries:
            every = [x for i in range(entries) for x in (held[i] if i in held else self._read(i)).items()]
            held, touched = {i: {} for i in range(more)}, set(range(more))
            for observation, digest in every:
                held[crc32(observation.encode()) % more][observation] = digest
        for entry in touched:
            self.accepted.updateValue((entry,), (list(held[entry]), list(held[entry].values())))
        if state.latest > before:
            self.latest.update((state.latest,))
        if self.quiet_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        ordinals, observations, _, bases = zip(*whole, strict=True)
        yield pd.DataFrame({"image_id": key[0], "ordinal": pd.array([None if pd.isna(o) else int(o) for o in ordinals], "Int64"), "observation_id": observations, "outcome": outcomes, "revision": pd.array(numbers, "Int64"), "base_revision": bases})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        self.accepted.clear()
        yield from ()

    def close(self) -> None:
        pass


def revisions_stream(observations: DataFrame, allow_stale: bool = True, quiet_ms: int = 0) -> DataFrame:
    """As ``revisions`` for a stream. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    rows = _prepared(observations).where(F.col("image_id").isNotNull() & F.col("observation_id").isNotNull())
    return rows.groupBy("image_id").transformWithStateInPandas(EvidenceProcessor(allow_stale, quiet_ms), OUTCOMES, "append", "processingTime" if quiet_ms else "none")
