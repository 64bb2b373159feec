"""Registered sources: Parquet, JSON lines (strict), CSV, whole text files, JSON exports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.base import ORD, Value, with_order
from loomwork.plans.types import Type, TypeFault, from_spark, spark_schema, table

MAX_LINE = 1 << 20


@dataclass
class Registry:
    """Names to typed tables. A source's order of rows is that of its key columns, if given."""

    spark: SparkSession
    entries: dict[str, Value] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame, order: list[str] | None = None, domain: str | None = None, revision: str | None = None, indexes: list | None = None) -> Value:
        plain = df.select(*[F.col(f.name).cast("timestamp") if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f.name) for f in df.schema.fields])
        row = from_spark(plain.schema)
        t = Type("Table", schema=row.schema, domain=domain, revision=revision, metadata={"indexes": indexes or []})
        if order:
            plain = with_order(plain, *order)
        self.entries[name] = Value(plain, Type("DatasetRef", item=t))
        return self.entries[name]

    def parquet(self, name: str, path: str, **more) -> Value:
        """Without order keys rows stand in the order of the files and of the rows within each:
        predicates still reach the scan, and the order does not depend on how files are split."""
        value = self.add(name, self.spark.read.parquet(path), **more)
        if not more.get("order"):
            place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
            value.data = value.df.withColumn(ORD, place)
        return value

    def view(self, name: str) -> None:
        """Make the source readable from SQL."""
        self.entries[name].df.drop(ORD).createOrReplaceTempView(name)

    def __getitem__(self, name: str) -> Value:
        if name not in self.entries:
            raise TypeFault(f"no source {name!r}")
        return self.entries[name]


def read_json_lines(spark: SparkSession, path: str, row: Type, expected_rows: int | None = None, sha256: str | None = None) -> DataFrame:
    """Strict rows: exactly the declared fields with exactly their JSON types, finite numbers, lines
    of at most MAX_LINE bytes. The file's digest and row count are checked if given. A bad line
    fails the query that reads it."""
    if sha256 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()
        if [r[0] for r in found] != [sha256]:
            raise TypeFault("SOURCE_DIGEST")
    lines = spark.read.text(path)
    schema = spark_schema(row)
    shape = {"Int64": r"-?(0|[1-9]\d*)", "Float64": r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", "Bool": "true|false"}
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.from_json("value", "map<string,string>").alias("m"))
    names = sorted(n for n, _ in row.rows)
    good = (F.octet_length("value") <= MAX_LINE) & (F.sort_array(F.map_keys("m")) == F.array(*map(F.lit, names))) & F.col("r").isNotNull()
    for n, t in row.rows:
        text = F.col("m")[n]
        fits = text.rlike(f"^({shape[t.base.kind]})$") if t.base.kind in shape else F.lit(True)
        present = F.col(f"r.{n}").isNotNull() & fits
        good = good & (F.coalesce(present, F.lit(False)) | text.isNull() if t.nullable else F.coalesce(present, F.lit(False)))
    checked = parsed.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("ROW_INVALID "), F.substring("value", 1, 200))).cast("boolean")))
    df = checked.select("r.*")
    if expected_rows is not None and df.count() != expected_rows:
        raise TypeFault("ROW_COUNT")
    return df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Strict CSV with a header, which must name the schema's columns; a byte order mark before it
    is skipped."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def list_files(files: DataFrame, prefix: str = "", path: str = "path") -> DataFrame:
    return files.select(path).where(F.col(path).startswith(prefix)).orderBy(path)


def read_json_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """An append-only log of JSON lines; readers may tail it as a stream."""
    df.write.mode("append").json(path)


def column_facts(spark: SparkSession, views: list[str]) -> DataFrame:
    """(table, position, name, type) of registered views."""
    rows = [(v, i, f.name, f.dataType.simpleString()) for v in views for i, f in enumerate(spark.table(v).schema.fields)]
    return spark.createDataFrame(rows, "table string, position int, name string, type string")


def document_index(df: DataFrame, id_field: str = "id", text_field: str = "text", domain: str = "documents", revision: str = "1") -> Value:
    row = from_spark(df.schema)
    return Value(df, Type("DocumentIndex", schema=row.schema, domain=domain, revision=revision, metadata={"id_field": id_field, "text_field": text_field, "id_type": row.column(id_field).base}))


def id_set(df: DataFrame, index: Value | None = None, kind: str = "IDSet") -> Value:
    item = from_spark(df.schema).rows[0][1].base
    t = index.type if index is not None else Type("Set")
    return Value(df.distinct(), Type(kind, item=item, domain=t.domain, revision=t.revision))


def plain_table(df: DataFrame) -> Value:
    return Value(df, table(from_spark(df.schema).schema))
