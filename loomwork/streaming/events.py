"""Event logs as streams: windowed counts with a watermark, and pairing of starts and ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwork.sources.storage import folder


def read_log(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str, late: str) -> DataFrame:
    """(start, keys, n) per window; rows later than the watermark are dropped."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), *keys, "n")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into Parquet in the shared folder, and read that."""
    import uuid

    spark = stream.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """(day, event_type, n). A window is written once the watermark passes its end, and the log
    ends before the last ones do; those are counted from the batch side of the same log."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0])
    rows = source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    done = run_to_end(windowed_counts(rows, "ts", ["event_type"], "1 day", "1 hour"), "daily")
    batch = spark.read.parquet(path).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = done.agg(F.max("start")).first()[0]
    open_ = batch.where(F.lit(True) if last is None else F.col("ts") >= F.lit(last) + F.expr("interval 1 day"))
    rest = open_.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    out = done.unionByName(rest).groupBy("start", "event_type").agg(F.sum("n").alias("n"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def pair_starts_and_ends(stream: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, start, end, outcome) from a stream of (key, t double, kind): state per key is the start
    that is still open."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for at, kind in zip(rows["t"], rows["kind"]):
            if kind == "worker_started":
                open_ = at
            elif open_ is not None:
                out.append((k[0], open_, at, kind))
                open_ = None
        if open_ is None:
            if state.exists:
                state.remove()
        else:
            state.update((open_,))
        yield pd.DataFrame(out, columns=["key", "start", "end", "outcome"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"key {kind}, start double, end double, outcome string", "open double", "append", GroupStateTimeout.NoTimeout)
