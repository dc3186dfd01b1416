"""Greedy frame selection, point thinning and duplicate predicates.

Greedy choice depends on what was chosen before, but only within two minutes, so stretches of a media are decided side
by side, in rounds; the budget is a rank of what they choose (see also the catalog's ``selection_within_budget``).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspool.sinks.shared import written

WINDOW_MS = 120_000


def strict_duplicate(hamming: Column, ratio: Column, mean: Column, protected: Column) -> Column:
    return (hamming <= 5) & (ratio <= 0.008) & (mean <= 0.006) & ~protected


def relaxed_duplicate(hamming: Column, ratio: Column, mean: Column, edge: Column, protected: Column) -> Column:
    return (hamming <= 8) & (ratio <= 0.05) & (mean <= 0.03) & (edge <= 0.03) & ~protected


def thin_points(df: DataFrame, key: str, time: str, spacing_ms: int) -> DataFrame:
    """(key, time): first and last points, and inner ones at least spacing_ms after the last kept one. Null times are no points.

    Points are read in order as a stream of batches and the last kept time is all that is carried on, so a key may have any number of them.
    """
    kinds = dict(df.dtypes)

    def jump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            keys, times = batch.column(0), batch.column(1).to_numpy()
            runs = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(times)]
            kept = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if (name := keys[i].as_py()) != at or last is None:
                    at, last = name, None
                k = i
                while k < j:
                    if last is not None:
                        k += int(np.searchsorted(times[k:j], last + spacing_ms))
                        if k >= j:
                            break
                    kept.append(k)
                    last = int(times[k])
            yield pa.record_batch([c.take(pa.array(kept, pa.int64())) for c in batch.columns], names=[key, time])

    points = df.select(key, F.col(time).cast("bigint").alias(time)).where(F.col(time).isNotNull()).distinct()
    kept = points.repartition(key).sortWithinPartitions(key, time).mapInArrow(jump, f"`{key}` {kinds[key]}, `{time}` bigint")
    return kept.union(points.groupBy(key).agg(F.max(time).alias(time))).distinct()


def hamming_pairs(df: DataFrame, most: int, parts: int = 3, bits: int = 63) -> DataFrame:
    """(a, b, distance): pairs a < b of df (id, h long) whose hashes differ in at most ``most`` bits.

    One of ``parts`` parts differs in at most most / parts bits. Each of two hashes changes half of those bits, so they meet by
    equality and each has far fewer keys than if one changed them all. The lower bits are the first one's to change, and the first
    part that is near enough counts, so a pair is found once. Wide parts make chance meetings rare: with 21 bits one in two million.
    Equal hashes are one until ids are put in. Joins merge: keys are many times the table whose size Spark knows, and none goes through the driver.
    """
    cuts = [(bits * i // parts, bits * (i + 1) // parts) for i in range(parts)]
    part = lambda h, i: F.shiftright(h, cuts[i][0]).bitwiseAND(F.lit((1 << (cuts[i][1] - cuts[i][0])) - 1))
    flips = lambda i, limit: [sum(1 << b for b in chosen) for r in range(limit + 1) for chosen in combinations(range(cuts[i][1] - cuts[i][0]), r)]
    reach = most // parts
    rows = df.where("h is not null")
    hashes = rows.select("h").distinct()
    keys = lambda limit: hashes.select("h", F.posexplode(F.array(*[_xor_all(part(F.col("h"), i), flips(i, limit)) for i in range(parts)])).alias("p", "ks")).select("h", "p", F.explode("ks").alias("k"))
    met = keys(-(-reach // 2)).withColumnRenamed("h", "ha").join(keys(reach // 2).withColumnRenamed("h", "hb").hint("merge"), ["p", "k"]).where("ha < hb")
    by_part = lambda make: F.element_at(F.array(*[make(i) for i in range(parts)]), F.col("p") + 1)
    ea, eb = (F.col("k").bitwiseXOR(by_part(lambda i, c=c: part(F.col(c), i))) for c in ("ha", "hb"))
    own = (F.bit_count(ea) - F.bit_count(eb)).isin(0, 1) & ((eb == 0) | (ea < eb.bitwiseAND(-eb)))
    apart = [F.bit_count(part(F.col("ha").bitwiseXOR(F.col("hb")), i)) > reach for i in range(parts)]
    first = by_part(lambda i: reduce(Column.__and__, apart[:i], F.lit(True)))
    near = met.withColumn("distance", F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))).where((F.col("distance") <= most) & own & first).select("ha", "hb", "distance")
    named = lambda name, h: rows.select(F.col("id").alias(name), F.col("h").alias(h))
    unlike = near.join(named("x", "ha").hint("merge"), "ha").join(named("y", "hb").hint("merge"), "hb").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    alike = named("a", "h").join(named("b", "h").hint("merge"), "h").where("a < b").select("a", "b", F.lit(0).alias("distance"))
    return unlike.union(alike).distinct()


def _xor_all(value: Column, flips: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: value.bitwiseXOR(f))


#: Width of the stretches of time that are decided by themselves.
CHUNK_MS = 3_600_000
_RANK = ("mandatory", "score", "actual_ms", "frame_id")


def _order() -> list[Column]:
    return [F.desc_nulls_last("mandatory"), F.desc_nulls_last("score"), F.asc_nulls_first("actual_ms"), F.asc("frame_id")]


class _Reach:
    """Times at which frames were put down, by hash: what lies within WINDOW_MS and ``most_bits`` of one is reached.

    A frame whose whole window its own hash's earlier times reach already adds nothing and is passed over, so the
    lists stay as short as a stretch has windows, however many frames there are.
    """

    def __init__(self, hashes: np.ndarray, most_bits: int):
        self.hashes, self.most_bits = hashes, most_bits
        self.put_down: dict[int, list[int]] = {}
        self.reached: dict[int, list[int]] = {}
        self.near: dict[int, list[int]] = {}

    @staticmethod
    def _add(times: list[int], t: int) -> bool:
        i = bisect_left(times, t)
        if i < len(times) and (times[i] == t or (i > 0 and times[i] - times[i - 1] <= 2 * WINDOW_MS)):
            return False
        times.insert(i, t)
        return True

    def put(self, h: int, t: int) -> list[int]:
        """Puts down a frame of the h-th hash at t; the hashes that it may reach anew."""
        if not self._add(self.put_down.setdefault(h, []), t):
            return []
        if h not in self.near:
            self.near[h] = np.flatnonzero(np.bitwise_count(self.hashes ^ self.hashes[h]) <= self.most_bits).tolist()
        return [k for k in self.near[h] if self._add(self.reached.setdefault(k, []), t)]

    def __contains__(self, frame: tuple[int, int]) -> bool:
        h, t = frame
        times = self.reached.get(h, ())
        i = bisect_left(times, t - WINDOW_MS)
        return i < len(times) and times[i] <= t + WINDOW_MS


def _hashes(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, and each row's place among them."""
    return np.unique(group["hash"].to_numpy(np.int64).view(np.uint64), return_inverse=True)


def _decide(most_bits: int):
    """Decides the open frames of a stretch as far as the frames around allow: 1 selected, 2 covered, 0 open still."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(_RANK), ascending=[False, False, True, True], ignore_index=True)
        hashes, which = _hashes(group)
        selected, waiting, status = _Reach(hashes, most_bits), _Reach(hashes, most_bits), group["_status"].tolist()
        for k, (h, t, guest) in enumerate(zip(which.tolist(), group["actual_ms"].tolist(), group["_guest"].tolist(), strict=True)):
            if status[k] == 0 and not guest:
                status[k] = 2 if (h, t) in selected else 0 if (h, t) in waiting else 1
            if status[k] < 2:
                (selected if status[k] else waiting).put(h, t)
        group["_status"] = np.array(status, np.int8)
        return group[~group["_guest"].to_numpy(bool)].drop(columns=["_guest", "_chunk"])

    return run


def _represent(most_bits: int):
    """The first chosen frame, by place, that reaches each frame of a stretch: media_id, frame_id, _by."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes, which = _hashes(group)
        times = group["actual_ms"].to_numpy(np.int64)
        by = np.full(len(group), -1, np.int64)
        ordered = np.lexsort((times, which))
        first = np.searchsorted(which[ordered], np.arange(len(hashes) + 1))
        reach, place = _Reach(hashes, most_bits), group["_place"].to_numpy(np.float64)
        chosen = np.flatnonzero(~np.isnan(place))
        for k in chosen[np.argsort(place[chosen], kind="stable")].tolist():
            t = int(times[k])
            for h in reach.put(int(which[k]), t):
                own = ordered[first[h]:first[h + 1]]
                some = own[np.searchsorted(times[own], t - WINDOW_MS, "left"):np.searchsorted(times[own], t + WINDOW_MS, "right")]
                by[some[by[some] < 0]] = k
        own = (by >= 0) & ~group["_guest"].to_numpy(bool)
        found = group.loc[own, ["media_id", "frame_id"]].reset_index(drop=True)
        found["_by"] = group["frame_id"].to_numpy()[by[own]]
        return found

    return run


def select_greedy(frames: DataFrame, budget: int, most_bits: int = 5, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """frames (media_id, frame_id, actual_ms, score, mandatory, hash) with selected and representative.

    Order: mandatory, score, earlier time, id. A frame within 120 s and ``most_bits`` of a selected one is
    covered by it unless mandatory; the budget binds all but mandatory frames.

    Without a budget the choice is that of the first independent set in order of rank. Stretches of a media decide their
    frames side by side; a frame whose better-ranked neighbour lies in another stretch and is open waits for the next
    round. The best open frame never waits, so rounds end. The budget then keeps the best ones of those selected, since
    what it cuts off comes after all that it keeps.

    Defined cases: frames without time or hash cover nothing and are covered by nothing; null scores rank last, null
    mandatory counts as not mandatory; an empty table gives an empty table; frame ids are a media's own.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in frames.dtypes)
    state = frames.withColumn("mandatory", F.coalesce("mandatory", F.lit(False)))
    alone = F.col("actual_ms").isNull() | F.col("hash").isNull()
    state = written(state.withColumn("_status", F.when(F.col("mandatory") | alone, 1).otherwise(0).cast("tinyint")), "frames")
    chunk = lambda t: F.floor(t / chunk_ms)
    while not state.where("_status = 0").isEmpty():
        open_ = state.where("_status = 0").select("media_id", chunk(F.col("actual_ms")).alias("_chunk")).distinct()
        placed = state.where(~alone).withColumn("_chunk", F.explode(F.sequence(chunk(F.col("actual_ms") - WINDOW_MS), chunk(F.col("actual_ms") + WINDOW_MS))))
        placed = placed.withColumn("_guest", F.col("_chunk") != chunk(F.col("actual_ms"))).join(open_, ["media_id", "_chunk"], "left_semi")
        decided = placed.groupBy("media_id", "_chunk").applyInPandas(_decide(most_bits), f"{kinds}, _status tinyint")
        home = F.when(~alone, chunk(F.col("actual_ms")))  # frames that meet no others are in no stretch and stay as they are
        rest = state.withColumn("_chunk", home).join(open_, ["media_id", "_chunk"], "left_anti").select(*frames.columns, "_status")
        state = written(decided.select(*frames.columns, "_status").union(rest), "frames")
    place = F.row_number().over(Window.partitionBy("media_id").orderBy(*_order()))
    chosen = state.where("_status = 1").withColumn("_place", place).where((F.col("_place") <= budget) | F.col("mandatory"))
    # The best selected frame near each other frame, again by stretches.
    marked = state.join(chosen.select("media_id", "frame_id", "_place"), ["media_id", "frame_id"], "left").where(~alone).select("media_id", "frame_id", "actual_ms", "hash", "_place")
    placed = marked.withColumn("_chunk", F.explode(F.sequence(chunk(F.col("actual_ms") - WINDOW_MS), chunk(F.col("actual_ms") + WINDOW_MS)))).withColumn("_guest", F.col("_chunk") != chunk(F.col("actual_ms")))
    kinds = dict(frames.dtypes)
    best = placed.where("not _guest or _place is not null").groupBy("media_id", "_chunk").applyInPandas(_represent(most_bits), f"media_id {kinds['media_id']}, frame_id {kinds['frame_id']}, _by {kinds['frame_id']}")
    taken = chosen.select("media_id", "frame_id", F.lit(True).alias("_taken"))
    rows = state.join(taken, ["media_id", "frame_id"], "left").join(best, ["media_id", "frame_id"], "left")
    selected = F.coalesce("_taken", F.lit(False))
    return rows.select(*frames.columns, selected.alias("selected"), F.when(selected, F.col("frame_id")).otherwise(F.col("_by")).alias("representative"))


def selection_report(chosen: DataFrame, tier: Column) -> DataFrame:
    """A row a media of select_greedy's result: candidates, selected, duplicates, low_score, covered, max_gap_ms, and of each tier candidates, selected and coverage.

    tier: column of very_high, high, supporting or low. A tier without candidates is wholly covered. The gap is 0 below two selected frames with times.
    """
    tiers = ("very_high", "high", "supporting", "low")
    rows = chosen.withColumn("_tier", tier)
    covered = F.col("representative").isNotNull()
    counts = rows.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("selected").alias("selected"), F.count_if(~F.col("selected") & covered).alias("duplicates"), F.count_if(~F.col("selected") & ~covered).alias("low_score"), F.count_if(covered).alias("covered"),
        *[F.count_if(F.col("_tier") == t).alias(f"{t}_candidates") for t in tiers], *[F.count_if(F.col("selected") & (F.col("_tier") == t)).alias(f"{t}_selected") for t in tiers])
    counts = counts.withColumns({f"{t}_coverage": F.when(F.col(f"{t}_candidates") > 0, F.round(F.col(f"{t}_selected") / F.col(f"{t}_candidates"), 6)).otherwise(1.0) for t in tiers})
    times = rows.where("selected and actual_ms is not null")
    gap = F.col("actual_ms") - F.lag("actual_ms").over(Window.partitionBy("media_id").orderBy("actual_ms"))
    gaps = times.withColumn("_gap", gap).groupBy("media_id").agg(F.max("_gap").alias("_gap"))
    return counts.join(gaps, "media_id", "left").withColumn("max_gap_ms", F.coalesce("_gap", F.lit(0).cast("long"))).drop("_gap")
