"""Documents packed into blocks of bounded bytes, stored once and bucketed by block, so that several
passes over them read no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, released

#: Blocks in a bucket, on average and at most where there are many, and buckets of a table.
BUCKET_BLOCKS, MAX_BUCKETS = 16, 100_000


def to_blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def pack_blocks(docs: DataFrame, block_bytes: int, sample: Callable[[pa.Table], list[bytes]]) -> DataFrame:
    """(block, blob, sample): consecutive rows up to block_bytes of text (or one longer text)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([to_blob(table)], pa.binary()), pa.array([sample(table)], pa.list_(pa.binary()))], ["block", "blob", "sample"])

        for b in batches:
            at = 0
            sizes = [len(t or "") for t in b.column(names.index("text")).to_pylist()]
            for k, n in enumerate(sizes):
                size += n
                if size >= block_bytes:
                    held.append(b.slice(at, k + 1 - at))
                    yield row()
                    number, held, size, at = number + 1, [], 0, k + 1
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield row()

    return docs.mapInArrow(released(run), "block long, blob binary, sample array<binary>")


def store_blocks(docs: DataFrame, block_bytes: int, sample: Callable[[pa.Table], list[bytes]] = lambda table: []) -> tuple[DataFrame, str]:
    """The blocks of the documents as a table bucketed by block, and the table's name, which whoever
    asks for it drops. Few rows a partition (many small files) do not mean many small blocks."""
    spark = docs.sparkSession
    bounded_batches(spark)
    name = f"loomwork_blocks_{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.coalesce(max(1, ceil(size / (2 * block_bytes))))
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / (BUCKET_BLOCKS * block_bytes))))
    pack_blocks(docs, block_bytes, sample).repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    return spark.table(name), name
