"""Shared plumbing of the training-data operators: scratch tables, Arrow batches, hashing."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, and the words between it.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of text that an operator works on at once, and bytes of an Arrow batch: both bound a Python
#: worker's memory.
TEXT_ROWS = 400
BATCH_BYTES = 8 << 20
#: Bytes of a row group of a stored table: bounds what a writer holds.
GROUP_BYTES = 32 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}
_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset and driver and executors
    are one process, a temporary folder. A cluster without the setting is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        app = spark.sparkContext.applicationId
        return _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="loomwork-"))
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder, once, and read it back. What nobody
    discards is deleted when the driver ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    where, files = _hadoop(df.sparkSession, path)
    files.deleteOnExit(where)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._loomwork_path = path  # type: ignore[attr-defined]
    return back


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_loomwork_path", None)
        if path:
            where, files = _hadoop(df.sparkSession, path)
            files.delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Python workers of other machines need this package: send it, once per application."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or sc.master.split("[")[0] == "local":
        return
    archive = Path(tempfile.mkdtemp(prefix="loomwork-")) / "loomwork.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (root / "loomwork").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


_RELEASED = [0.0]


def release() -> None:
    """Give memory back to the system at the end of a task: workers are kept for later stages, and
    what they hold idle is missing there."""
    if time.monotonic() - _RELEASED[0] < 0.5:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    _RELEASED[0] = time.monotonic()


def released(f: Callable) -> Callable:
    """f, a function of tables (a group, or a key and a group, or two groups) or a generator over
    batches, with release() after it."""
    if inspect.isgeneratorfunction(f):

        def stream(batches: Iterator) -> Iterator:
            try:
                yield from f(batches)
            finally:
                release()

        return stream

    def one(a):
        try:
            return f(a)
        finally:
            release()

    def two(a, b):
        try:
            return f(a, b)
        finally:
            release()

    return one if len(inspect.signature(f).parameters) == 1 else two


def bounded_batches(spark: SparkSession) -> None:
    """Every operator that runs Python calls this first. The bound on a batch's bytes is the same
    for all of them, so it does not matter which one ran last; rows are cut in map_batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | list | None], schema: str, rows: int = TEXT_ROWS) -> DataFrame:
    """mapInArrow for a function of one batch of at most `rows` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                out = f(b.slice(at, rows))
                if out is None:
                    continue
                yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(released(run), schema)


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words_of(text: str) -> list[str]:
    """The words of a text: maximal runs of characters other than space, tab, line feed, vertical
    tab, form feed and carriage return. str.split() also parts at other white space, so it serves
    only where there is none."""
    if text.isascii() and not (set(text) & {"\x1c", "\x1d", "\x1e", "\x1f"}):
        return text.split()
    import re

    return re.findall(WORD, text)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bounded_sample(df: DataFrame, key: list[str], size: int, rows: int) -> DataFrame:
    """At most size rows, those of the lowest key hashes. df has about `rows` rows: a filter first
    leaves a few times size of them, so that tasks do not each send size rows to the driver."""
    h = F.xxhash64(*key)
    if rows > 4 * size:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 4 * size / rows))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), h, *key).limit(size)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keep_id(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
