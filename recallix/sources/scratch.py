"""Tables that queries write on their way, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path that is used once and removed when the driver ends. Without the setting a temporary folder takes its place in
    a local session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="recallix-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"))
    return _written[-1][1]


def remove(spark: SparkSession, path: str) -> None:
    """A table that is read no more goes before the driver ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


def _clean() -> None:
    for spark, path in list(_written):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already when the driver ends
            return


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written as a table and read again: it cuts the lineage and survives a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
