"""Run a streaming plan over what is there now and give its result as a DataFrame."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.snapshot import chunk_bounds, chunk_of


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder that the driver and executors share: the session's checkpoint folder.  A local session without one gets a
    temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("streams need a folder that all executors share: set spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}"


#: Events of a micro-batch on average at most; a key's part of one is held and put in order by one Python worker.
BATCH_ROWS = 500_000


def stream_to_table(spark: SparkSession, events: DataFrame, plan: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``events`` written as files, read as a stream through ``plan`` (availableNow) into Parquet, and read back.

    Events come in stretches of ``seq``, each a run that goes on from the state of the one before, so what a worker holds does not
    grow with the table.  They are written once, parted by stretch; a stretch's files are then moved into the stream's folder.
    A second call with the same name adds its events to the files and goes on from the first one's state."""
    at = work_dir(spark, name)
    rows = events.count()
    bounds = chunk_bounds(events, chunks=-(-rows // BATCH_ROWS))
    if not bounds:
        events.write.mode("append").parquet(f"{at}/in")
        return _run(spark, events, plan, at)
    staged = f"{at}/staged-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        stretches = events.withColumn("_stretch", chunk_of(bounds))
        stretches.repartition(len(bounds) + 1, "_stretch").write.partitionBy("_stretch").parquet(staged)
        fs.mkdirs(path(f"{at}/in"))
        for i in range(len(bounds) + 1):
            folder = path(f"{staged}/_stretch={i}")
            if not fs.exists(folder):
                continue
            for f in fs.listStatus(folder):
                if f.getPath().getName().endswith(".parquet") and not fs.rename(f.getPath(), path(f"{at}/in/{i}-{f.getPath().getName()}")):
                    raise OSError(f"cannot move {f.getPath()}")
            out = _run(spark, events, plan, at)
        return out
    finally:
        fs.delete(path(staged), True)


def _run(spark: SparkSession, events: DataFrame, plan: Callable[[DataFrame], DataFrame], at: str) -> DataFrame:
    """What is new in the stream's folder goes through ``plan``; all results so far."""
    out = plan(spark.readStream.schema(events.schema).parquet(f"{at}/in"))
    query = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
