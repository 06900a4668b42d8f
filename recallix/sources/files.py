"""Sources and sinks: event logs as JSON, vector files, upload parts, append-only tables, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored

#: One event of the log; legacy flat fields are read as they are, missing ones are null.
EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("event_id", "tenant_id", "workspace_id", "agent_id", "session_id", "event_type", "event_time", "ingest_time", "visible_time", "parent_event_id", "source", "visibility")]
    + [T.StructField("logical_ts", T.LongType()), T.StructField("version", T.LongType()), T.StructField("causal_refs", T.ArrayType(T.StringType())), T.StructField("payload", T.MapType(T.StringType(), T.StringType())), T.StructField("importance", T.DoubleType())]
)


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines of events with a fixed schema: no inference pass. Lines that aren't JSON give null rows, dropped."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT).json(path).where("event_id is not null")


_VECTOR_TYPES = {"fvecs": "<f4", "ivecs": "<i4", "fbin": "<f4", "ibin": "<i4"}


def read_vectors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(vec_id, embedding) of vector files by Spark's binary reader: fvecs and ivecs (a length before each row), fbin
    and ibin (rows and width first). Ids count rows of a file from 0, after the file's name where there are several."""
    dtype = np.dtype(_VECTOR_TYPES[kind])
    element = pa.float32() if dtype.kind == "f" else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                if kind.endswith("bin"):
                    n, width = raw[:8].view("<i4")
                    rows = raw[8 : 8 + int(n) * int(width) * 4].view(dtype).reshape(int(n), int(width))
                else:
                    width = int(raw[:4].view("<i4")[0]) if len(raw) else 0
                    rows = raw.reshape(-1, 4 * (width + 1))[:, 4:].copy().view(dtype) if width else np.zeros((0, 0), dtype)
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, max(1, part.shape[1]), dtype=np.int32), pa.array(part.ravel(), element))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), lists], ["file", "vec_id", "embedding"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"file string, vec_id long, embedding array<{'float' if dtype.kind == 'f' else 'int'}>")


def assemble_documents(parts: DataFrame) -> DataFrame:
    """(batch_id, text) of uploads (batch_id, idx, total, text) of which all parts are there, in order; of a part sent
    twice the first by text counts."""
    once = parts.groupBy("batch_id", "idx").agg(F.min("text").alias("text"), F.max("total").alias("total"))
    whole = once.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("parts"), F.max("total").alias("total"), F.count(F.lit(1)).alias("n"))
    return whole.where("n = total").select("batch_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def with_lsn(events: DataFrame, start: int, order: list[str]) -> DataFrame:
    """Log sequence numbers from ``start`` + 1 in the given order, without a window over all rows: rows are sorted in
    ranges, and each range starts after the counts of those before it. The ranges are written once, with each row's
    range and place in it, so that counts and rows speak of the same ranges whatever is computed again. The ranges'
    counts are few, one a partition."""
    part, row = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stored(events.orderBy(*order).withColumns({"_part": part, "_row": row}), "log-ranges")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(base), "_part").withColumn("lsn", F.col("_row") + F.col("_base") + 1 + start).drop("_part", "_row", "_base")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append to a log or table of Parquet files."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("errorifexists").format(fmt).save(path)


def purge(df: DataFrame, condition: Column, dependents: dict[str, tuple[DataFrame, str]], id_col: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The rows that stay after a hard delete, and each dependent table without rows of what went."""
    gone = df.where(condition).select(F.col(id_col).alias("_gone")).distinct()
    stay = df.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    return stay, {name: rows.join(gone, F.col(key) == F.col("_gone"), "left_anti") for name, (rows, key) in dependents.items()}
