"""Shared building blocks of the training-data operators: scratch tables, links to groups, text helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words in the contracts: the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_written: list[tuple[SparkSession, str]] = []


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it (a no-op if it is installed there)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set (tests, local mode)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="recallix-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/recallix-{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _filesystem(spark, path)
    fs.delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


def _clean() -> None:
    for spark, path in list(_written):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already when the driver ends
            return


_memories: dict[str, Callable[[], None]] = {}


def sole_memory(name: str, forget: Callable[[], None]) -> None:
    """Called in a Python worker by an operator that remembers words between tasks: the other operators' memories go,
    as a worker serves one stage after another and its memory must not grow with their number."""
    for other in [k for k in _memories if k != name]:
        _memories.pop(other)()
    _memories[name] = forget


class Table:
    """A DataFrame written once to the shared folder: it cuts the lineage and survives a lost executor."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(columns: Sequence[str], stem: str) -> str:
    """A column name that clashes with none of the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; other columns, also clashing ones, play no part."""
    return df.select(*(col(n) for n in names))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_FEW_LINKS = 1 << 15


def _closed(u: np.ndarray, v: np.ndarray) -> pa.Table:
    """(node, component) of the ends of links: larger roots hang on smaller ones, and paths are halved, until no link
    joins two roots."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, (a, b) = np.arange(len(names)), at.reshape(2, -1)
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != root[root]).any():
            root = root[root]
    return pa.table({"node": pa.array(names, pa.int64()), "component": pa.array(names[root], pa.int64())})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected groups of an undirected graph: (src, dst) longs to (node, component = smallest node reachable).

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round is joins and minima, whose
    partial aggregates run before the shuffle; a hub is only ever one side of an inner join, which adaptive
    execution may split. Each round's links are a table in the shared folder, so the lineage stays short. Rounds
    grow with the logarithm of the longest path. Up to _FEW_LINKS links are closed on the driver instead: a round of so
    few is all exchanges, each of which leaves the driver a thread. Rows with a null end and self-links add nothing; an
    empty graph gives an empty result.
    """
    current = Table(edges.where("src is not null and dst is not null and src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    mark = _mark(current.df)
    if mark[0] <= _FEW_LINKS:
        links = current.df.toArrow()
        current.drop()
        return edges.sparkSession.createDataFrame(_closed(links["u"].to_numpy(), links["v"].to_numpy()))
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = current.df.unionByName(current.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = Table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        current.drop()
        current, last, mark = new, mark, _mark(new.df)
        if mark == last:
            break
    else:
        raise RuntimeError(f"groups not closed after {max_rounds} rounds")
    members = current.df.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of a table of links, to see whether a round changed it."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
    return row["n"], row["x"]


def one_of_equal(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Of rows that are equal in the named columns (null equals null) one stays, that with the smallest hash of its
    columns other than maps. Only repeated rows are shuffled whole; each task keeps one of a group's rows before that."""
    again = narrow(df, *names).groupBy(*(col(n) for n in names)).count().where("count > 1").drop("count")
    again = again.toDF(*(f"_rx_again{i}" for i in range(len(names))))
    if again.isEmpty():
        return df
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & col(n).eqNullSafe(F.col(f"_rx_again{i}"))
    kept = [col(c) for c in df.columns]
    turn = free_name(df.columns, "_rx_turn")
    plain = [col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    one = Window.partitionBy(*(col(n) for n in names)).orderBy(F.xxhash64(*plain))
    repeated = df.join(again, same, "left_semi").select(*kept).withColumn(turn, F.row_number().over(one)).where(col(turn) == 1).select(*kept)
    return df.join(again, same, "left_anti").select(*kept).unionByName(repeated)
