"""Decoded frames as pixel arrays: difference hashes, quality, comparison with the frame before, changed regions.

frames: media_id, seq, width, height, pixels (array of grey values 0 to 255 by rows, whatever integer type). Decoding, colour
and scaling down to comparison size are done before. A frame meets the one before it through an equality join on
(media_id, seq), so no media is gathered in one task; batches of equally large frames are worked on together by numpy.

Defined cases: frames whose pixel count is not width x height, or that hold nulls, have no measures (null) and no
neighbours; the first frame of a media and one after a gap in seq have no difference; frames of different sizes differ
wholly, in one region; repeated (media_id, seq) are compared with each frame before them; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SIZE, TILES, THRESHOLD = 8, 8, 12
REGION = "struct<x: int, y: int, width: int, height: int, changed_ratio: double, mean_difference: double>"
_REGION = pa.struct([("x", pa.int32()), ("y", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("changed_ratio", pa.float64()), ("mean_difference", pa.float64())])


def dhash_bits(grey: np.ndarray, size: int = HASH_SIZE) -> np.ndarray:
    """(n, size * size) bits of frames (n, height, width): whether a cell is brighter than its right neighbour, by the nearest pixels of a size x (size + 1) grid."""
    _, height, width = grey.shape
    rows, columns = np.arange(size) * height // size, np.arange(size + 1) * width // (size + 1)
    cells = grey[:, rows][:, :, columns]
    return (cells[:, :, :-1] > cells[:, :, 1:]).reshape(len(grey), -1)


def hash_text(bits: np.ndarray) -> list[str]:
    """Bits, lowest first, as hex digits, highest first."""
    packed = np.packbits(bits, axis=1, bitorder="little")[:, ::-1]
    return [row.tobytes().hex() for row in packed]


def edges(grey: np.ndarray) -> np.ndarray:
    """Eight times a pixel less its eight neighbours, kept within 0 and 255; border pixels stay as they are."""
    g = grey.astype(np.int32)
    out = g.copy()
    if min(g.shape[1:]) > 2:
        around = sum(g[:, 1 + dy : g.shape[1] - 1 + dy, 1 + dx : g.shape[2] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[:, 1:-1, 1:-1] = np.clip(9 * g[:, 1:-1, 1:-1] - around, 0, 255)
    return out


def quality(grey: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of frames (n, height, width) between 0 and 1."""
    n = len(grey)
    flat, rim = grey.reshape(n, -1).astype(np.float64), edges(grey).reshape(n, -1).astype(np.float64)
    contrast = flat.std(1) / 127.5
    dark, light = (flat < 5).mean(1), (flat >= 251).mean(1)
    sharpness, density = np.minimum(1, rim.var(1) / 2500), (rim >= 24).mean(1)
    risk = np.minimum(1, 0.65 * np.maximum(0, 0.18 - contrast) / 0.18 + 0.35 * np.minimum(1, dark + light))
    overall = 0.5 * sharpness + 0.2 * np.minimum(1, contrast) + 0.15 * np.minimum(1, density * 3) + 0.15 * (1 - risk)
    return {"sharpness": sharpness, "brightness": flat.mean(1) / 255, "contrast": np.minimum(1, contrast), "edge_density": density, "clipped_dark": dark, "clipped_light": light, "transition_risk": risk, "overall": np.clip(overall, 0, 1)}


def regions(difference: np.ndarray, tiles: int = TILES, threshold: int = THRESHOLD) -> list[list[dict]]:
    """Tiles (of tiles x tiles) in which frames differ: place, share of pixels from the threshold on, mean over 255; most changed first."""
    n, height, width = difference.shape
    tops, lefts = np.arange(tiles + 1) * height // tiles, np.arange(tiles + 1) * width // tiles
    sums = lambda x: np.pad(x, ((0, 0), (1, 0), (1, 0))).cumsum(1).cumsum(2)[:, tops][:, :, lefts]
    inside = lambda s: s[:, 1:, 1:] - s[:, :-1, 1:] - s[:, 1:, :-1] + s[:, :-1, :-1]
    area = np.diff(tops)[:, None] * np.diff(lefts)[None, :]
    ratio = inside(sums((difference >= threshold).astype(np.int64))) / np.maximum(area, 1)
    mean = inside(sums(difference.astype(np.int64))) / (255.0 * np.maximum(area, 1))
    out: list[list[dict]] = [[] for _ in range(n)]
    frame, row, column = np.nonzero((mean > 0) & (area > 0))
    order = np.lexsort((column, row, -mean[frame, row, column], -ratio[frame, row, column], frame))
    for f, r, c in zip(frame[order].tolist(), row[order].tolist(), column[order].tolist(), strict=True):
        out[f].append({"x": int(lefts[c]), "y": int(tops[r]), "width": int(lefts[c + 1] - lefts[c]), "height": int(tops[r + 1] - tops[r]), "changed_ratio": float(ratio[f, r, c]), "mean_difference": float(mean[f, r, c])})
    return out


def _by_size(width: np.ndarray, height: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for w, h in sorted(set(zip(width.tolist(), height.tolist(), strict=True))):
        yield w, h, np.flatnonzero((width == w) & (height == h))


def _stack(column: pa.Array, rows: np.ndarray, w: int, h: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(len(rows), h, w)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _usable(frames: DataFrame) -> Column:
    whole = F.col("width") * F.col("height") == F.size("pixels")
    return F.coalesce(whole & (F.col("width") > 0) & F.forall("pixels", lambda p: p.isNotNull() & p.between(0, 255)), F.lit(False))


MEASURES = ("sharpness", "brightness", "contrast", "edge_density", "clipped_dark", "clipped_light", "transition_risk", "overall")


def _assess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        out, digest = {m: np.full(n, np.nan) for m in MEASURES}, np.full(n, None, object)
        for w, h, rows in _by_size(*[np.asarray(_column(batch, c)) for c in ("width", "height")]):
            grey = _stack(_column(batch, "pixels"), rows, w, h)
            for m, values in quality(grey).items():
                out[m][rows] = values
            digest[rows] = hash_text(dhash_bits(grey))
        yield pa.record_batch([_column(batch, "media_id"), _column(batch, "seq"), pa.array(digest, pa.string()), *[pa.array(out[m]) for m in MEASURES]], names=["media_id", "seq", "dhash", *MEASURES])


def assess(frames: DataFrame) -> DataFrame:
    """(media_id, seq, dhash, measures) of each usable frame."""
    kinds = dict(frames.dtypes)
    rows = frames.where(_usable(frames)).select("media_id", "seq", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    return rows.mapInArrow(_assess, f"media_id {kinds['media_id']}, seq {kinds['seq']}, dhash string, " + ", ".join(f"{m} double" for m in MEASURES))


def _compare(threshold: int, tiles: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size = {c: np.asarray(_column(batch, c)) for c in ("width", "height", "p_width", "p_height")}
            same = (size["width"] == size["p_width"]) & (size["height"] == size["p_height"])
            hamming, out = np.full(n, HASH_SIZE * HASH_SIZE, np.int64), {m: np.ones(n) for m in ("changed_ratio", "mean_difference", "edge_difference", "maximum_region")}
            found = [[{"x": 0, "y": 0, "width": int(w), "height": int(h), "changed_ratio": 1.0, "mean_difference": 1.0}] for w, h in zip(size["width"], size["height"], strict=True)]
            at = np.flatnonzero(same)
            for w, h, k in _by_size(size["width"][at], size["height"][at]):
                rows = at[k]
                now, before = (_stack(_column(batch, c), rows, w, h) for c in ("pixels", "p_pixels"))
                difference = np.abs(now.astype(np.int32) - before)
                hamming[rows] = (dhash_bits(now) != dhash_bits(before)).sum(1)
                out["changed_ratio"][rows] = (difference >= threshold).mean((1, 2))
                out["mean_difference"][rows] = difference.sum((1, 2)) / (255.0 * w * h)
                out["edge_difference"][rows] = np.abs(edges(now) - edges(before)).sum((1, 2)) / (255.0 * w * h)
                for row, listed in zip(rows.tolist(), regions(difference, tiles, threshold), strict=True):
                    found[row] = listed
                    out["maximum_region"][row] = max((r["changed_ratio"] for r in listed), default=0.0)
            yield pa.record_batch([_column(batch, "media_id"), _column(batch, "seq"), pa.array(hamming), *[pa.array(v) for v in out.values()], pa.array(found, pa.list_(_REGION))], names=["media_id", "seq", "hamming", *out, "regions"])

    return run


def compare_adjacent(frames: DataFrame, threshold: int = THRESHOLD, tiles: int = TILES) -> DataFrame:
    """(media_id, seq, hamming, changed_ratio, mean_difference, edge_difference, maximum_region, regions) of each usable frame against the one before it."""
    kinds = dict(frames.dtypes)
    rows = frames.where(_usable(frames)).select("media_id", "seq", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    before = rows.select("media_id", (F.col("seq") + 1).cast(kinds["seq"]).alias("seq"), *[F.col(c).alias(f"p_{c}") for c in ("width", "height", "pixels")])
    return rows.join(before, ["media_id", "seq"]).mapInArrow(_compare(threshold, tiles), f"media_id {kinds['media_id']}, seq {kinds['seq']}, hamming bigint, changed_ratio double, mean_difference double, edge_difference double, maximum_region double, regions array<{REGION}>")


def analyse(frames: DataFrame) -> DataFrame:
    """``assess`` with ``compare_adjacent``'s columns, null where there is no frame before."""
    return assess(frames).join(compare_adjacent(frames), ["media_id", "seq"], "left")


def changed_regions(frames: DataFrame) -> DataFrame:
    """A row for each changed tile of each frame, place 0 the most changed: media_id, seq, place and the region's columns."""
    return compare_adjacent(frames).select("media_id", "seq", F.posexplode("regions").alias("place", "r")).select("media_id", "seq", "place", "r.*")


def pixel_hash(pixels: Column, width: Column, height: Column) -> Column:
    """SHA-256 of a grey frame as 8-bit RGBA: a fixed head, both sizes in four bytes, then each pixel's bytes."""
    two = lambda p: F.lpad(F.hex(p), 2, "0")
    body = F.array_join(F.transform(pixels, lambda p: F.concat(two(p), two(p), two(p), F.lit("FF"))), "")
    head = F.concat(F.lit(b"sha256-rgba8-srgb-v1\x00".hex()), F.lpad(F.hex(width), 8, "0"), F.lpad(F.hex(height), 8, "0"))
    return F.sha2(F.unhex(F.concat(head, body)), 256)
