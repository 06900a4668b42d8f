"""Structured Streaming over the log.

The projection functions are those of the batch path, so a stream that has seen the whole log gives the batch tables.
The visible watermark is a prefix of sequence numbers, not an event-time bound: it is a table, moved on per batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import materialize as mz
from ..sources.scratch import stored


def project(events: DataFrame, checkpoint: str, out: str, accept: Column | None = None) -> StreamingQuery:
    """Write memories' edges and states of each micro-batch under ``out``, rejected rows to a dead-letter table.

    Replays are dropped by event id inside a batch and against what is there already (an anti join), so a batch that
    runs twice after a failure adds nothing; each batch writes its own folder, overwritten on a second run."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        # Rejected rows are split off first: rows without an id, or several under one, all reach the dead letters.
        ok = F.coalesce(accept if accept is not None else F.col("event_id").isNotNull() & F.col("event_type").isNotNull(), F.lit(False))
        good, bad = df.where(ok).dropDuplicates(["event_id"]), df.where(~ok)
        earlier = _batches(spark, f"{out}/events", number)
        if earlier is not None:
            good = good.join(earlier.select("event_id"), "event_id", "left_anti")
        good.write.mode("overwrite").parquet(f"{out}/events/batch={number}")
        done = spark.read.schema(good.schema).parquet(f"{out}/events/batch={number}")
        mz.derived_edges(done).write.mode("overwrite").parquet(f"{out}/edges/batch={number}")
        mz.states(done).write.mode("overwrite").parquet(f"{out}/states/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/dead_letters/batch={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark, path: str, before: int) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return None
    found = spark.read.parquet(path)
    return found.where(F.col("batch") < before) if "batch" in found.columns else None


def visible_watermark(log: DataFrame, visible: DataFrame) -> DataFrame:
    """One row: the highest lsn without an invisible one before it. An aggregate over the first gap, not a window."""
    gap = log.join(visible.select("lsn"), "lsn", "left_anti").agg(F.min("lsn").alias("gap"))
    return log.agg(F.max("lsn").alias("last"), F.min("lsn").alias("first")).crossJoin(gap).select(F.coalesce(F.col("gap") - 1, F.col("last")).alias("watermark"))


def read_at(log: DataFrame, mode: str, watermark: int, bound: int = 0) -> DataFrame:
    """Rows a reader may see: strict up to the watermark, bounded up to ``bound`` beyond it, eventual all."""
    if mode == "strict":
        return log.where(F.col("lsn") <= watermark)
    if mode == "bounded":
        return log.where(F.col("lsn") <= watermark + bound)
    if mode == "eventual":
        return log
    raise ValueError(f"unknown consistency mode {mode}")


def breaches(accepted: DataFrame, seconds: float) -> DataFrame:
    """Rows (lsn, accepted_at, visible_at) that became visible later than the deadline."""
    late = F.unix_micros(F.col("visible_at").cast("timestamp")) - F.unix_micros(F.col("accepted_at").cast("timestamp"))
    return accepted.where(late > seconds * 1_000_000)


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and summed values by type and window, for streams and tables alike."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding_rate(events: DataFrame, size: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def every_nth(events: DataFrame, n: int = 10) -> DataFrame:
    """(agent_id, count) each time an agent's event count passes a multiple of n, with the count kept as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        import pandas as pd

        seen = state.get[0] if state.exists else 0
        new = seen + sum(len(b) for b in batches)
        state.update((new,))
        marks = list(range((seen // n + 1) * n, new + 1, n))
        yield pd.DataFrame({"agent_id": [key[0]] * len(marks), "at": marks})

    return events.groupBy("agent_id").applyInPandasWithState(step, "agent_id string, at long", "seen long", "append", GroupStateTimeout.NoTimeout)


def project_with_retry(rows: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], attempts: int = 3, delay: float = 0.1, longest: float = 5.0) -> DataFrame:
    """The rows with the number of the attempt that settled them and whether it ended ``visible`` or as a ``dead_letter``.

    ``attempt`` gets the rows still open and the attempt's number, and returns them with a column ok; each attempt's
    outcome is a table, so rows that went through aren't tried again when an executor is lost. The wait doubles
    after each attempt, up to ``longest`` seconds. An ok that is null counts as failed; no rows give no rows."""
    out, columns = None, rows.columns
    for n in range(1, attempts + 1):
        tried = stored(attempt(rows, n).withColumn("ok", F.coalesce("ok", F.lit(False))), "attempt")
        last = n == attempts
        settled = (tried if last else tried.where("ok")).select(*columns, F.lit(n).cast("long").alias("attempts"), F.when(F.col("ok"), "visible").otherwise("dead_letter").alias("outcome"))
        out = settled if out is None else out.unionByName(settled)
        rows = tried.where(~F.col("ok")).select(*columns)
        if last or rows.isEmpty():
            return out
        time.sleep(min(longest, delay * 2 ** (n - 1)))
    return out


def micro_batches(log: DataFrame, size: int = 32) -> DataFrame:
    """(batch, n, first_lsn, last_lsn): a gapless log cut into batches of ``size`` entries from its first one; the last
    batch holds what was there when the queue was flushed."""
    batch = F.floor((F.col("lsn") - 1) / size).cast("long")
    return log.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def poll(log: DataFrame, after: int, size: int) -> DataFrame:
    """What a subscriber that has read up to ``after`` gets next: the following entries in order, ``size`` at most."""
    return log.where(F.col("lsn") > after).orderBy("lsn").limit(size)
