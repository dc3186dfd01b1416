"""Shared plumbing of the llm operators: tables, shared storage, code shipping, Arrow helpers.

Intermediate tables go only to the shared folder named by ``spark.checkpoint.dir``; where that is
unset in local mode (tests) a temporary folder of the single machine is used and set as checkpoint dir.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels work on at once; bounds their scratch memory, not the text.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set to a temporary folder only where unset and in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lumenspool-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lumenspool-{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lumenspool-" in root:
                path = spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of published files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now rather than at the driver's next collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so that workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenspool_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    at = os.path.join(tempfile.mkdtemp(prefix="lumenspool-code-"), "lumenspool_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted((root / "lumenspool").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(at)
    sc._lumenspool_shipped = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(col) -> F.Column:
    """crc32 of the decimal text of an id (long)."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def text_column(docs: DataFrame) -> F.Column:
    """The text, null read as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def utf8_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64 of n + 1, bytes uint8) of a string column without nulls, offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows whose bytes come to about ``most``; a longer single row stands alone and whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def by_text(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches (zero copy) so that each holds about ``most`` bytes of text, rows whole."""
    for batch in batches:
        if batch.num_rows:
            offsets, _ = utf8_parts(batch.column(batch.schema.get_field_index(name)))
            for i, j in slices(offsets, most):
                yield batch.slice(i, j - i)


# Array files: what tasks build for other tasks to map into memory


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, **arrays: np.ndarray) -> None:
    """Writes one-dimensional arrays as one file, at once: a retried task replaces the file by an equal one."""
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = [x.dtype.str, at, len(x)]
        at += -(-x.nbytes // 8) * 8
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)
    own = f"{uri}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"

    def fill(f) -> None:
        f.write(len(top).to_bytes(8, "little") + top)
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).data)
            f.write(b"\0" * (-x.nbytes % 8))

    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(own), "wb") as f:
            fill(f)
        os.replace(_local(own), path)
    else:
        system, path = _system(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(_system(own)[1]) as f:
            fill(f)
        system.move(_system(own)[1], path)


def exists(uri: str) -> bool:
    if path := _local(uri):
        return os.path.exists(path)
    from pyarrow import fs

    system, path = _system(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


_files: dict[str, dict[str, np.ndarray]] = {}


def arrays(uri: str, keep: bool = True) -> dict[str, np.ndarray]:
    """A published file's arrays, memory-mapped where the shared folder is a file system, so that workers of a machine share them.

    keep: whether the worker goes on holding them.
    """
    if uri not in _files:
        if len(_files) > 4096:
            _files.clear()
        if path := _local(uri):
            raw = np.memmap(path, np.uint8, "r")
        else:
            system, path = _system(uri)
            raw = np.frombuffer(system.open_input_file(path).read(), np.uint8)
        size = int(raw[:8].view(np.uint64)[0])
        body = raw[8 + size :]
        _files[uri] = {k: body[at : at + n * np.dtype(t).itemsize].view(t) for k, (t, at, n) in json.loads(raw[8 : 8 + size].tobytes()).items()}
    return _files[uri] if keep else _files.pop(uri)
