"""Tables from files, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet file or folder if the path ends in ``.parquet``, else CSV with a header, gzipped or not.

    A CSV without a ``schema`` is text in all columns. A gzipped CSV is read by one task and spread right after.
    """
    path = str(path)
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False) if schema else spark.read.csv(path, header=True)
        if path.endswith(".gz"):
            df = df.repartition(spark.sparkContext.defaultParallelism)
    return df.select(*columns) if columns else df


def load_indexed_csv(spark: SparkSession, path: str, key: str = "cell_id") -> DataFrame:
    """A CSV whose first column, often without a name, is the row's key."""
    df = spark.read.csv(str(path), header=True)
    return df.withColumnRenamed(df.columns[0], key)


def load_parts(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """All Parquet files of a folder as one table."""
    df = spark.read.parquet(str(folder))
    return df.select(*columns) if columns else df


def batches(df: DataFrame, rows: int = 1_000_000) -> Iterator[pa.Table]:
    """``df`` in Arrow tables of ``rows`` rows, one partition at a time on the driver; for consumers outside Spark."""
    held: list[pa.Table] = []
    n = 0
    for batch in _arrow(df):
        at = 0
        batch = pa.Table.from_batches([batch])
        while at < batch.num_rows:
            part = batch.slice(at, rows - n)
            held.append(part)
            at += part.num_rows
            n += part.num_rows
            if n == rows:
                yield pa.concat_tables(held)
                held, n = [], 0
    if n:
        yield pa.concat_tables(held)


def _arrow(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows as the Arrow batches that executors make of them, one partition at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["batch"])

    for r in df.mapInArrow(pack, "batch binary").toLocalIterator(prefetchPartitions=True):
        yield from pa.ipc.open_stream(r["batch"])


def with_row_index(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the row's place, from 0, in the order in which it is read: the rows of each partition are counted, one
    number per partition comes to the driver, and nothing is shuffled or sorted."""
    at = F.monotonically_increasing_id()
    tagged = df.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33))
    counts = {r[0]: r[1] for r in tagged.groupBy("_part").count().collect()}
    before, total = [], 0
    for p in sorted(counts):
        before += [F.lit(p), F.lit(total)]
        total += counts[p]
    if not before:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    index = F.try_element_at(F.create_map(*before), F.col("_part")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.withColumn(name, index.cast("bigint")).drop("_at", "_part")
