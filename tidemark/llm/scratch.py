"""Intermediate tables in the folder that all executors and the driver share.

``spark.checkpoint.dir`` names that folder, or else the folder that ``setCheckpointDir`` was
given.  A local session without one (tests, a laptop) gets a temporary folder; a session on a
cluster without one is an error, for executors would each write to their own disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextmanager
def _own_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside are deleted when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


#: Files of a table for each core of the cluster, at least.
FILES_PER_CORE = 3


def table(df: DataFrame, partition_by: list[str] | None = None, files: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends
    there, so a lost executor costs at most a re-read of the files.

    A table has ``files`` files at most, or else half as many as shuffles have partitions (and a few a core):
    a task works through some partitions of ``df`` one after the other in place of writing a small file for each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    least = FILES_PER_CORE * spark.sparkContext.defaultParallelism
    files = files or max(least, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    writer = df.coalesce(files).write.option("compression", "zstd")
    with _own_shuffles_go(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_counted(left: DataFrame, right: DataFrame, on: list[str], n: str, most: int = 1000) -> DataFrame:
    """Inner join with a table of unique keys that knows how many rows of ``left`` have each.

    Keys with more than 1/``most`` of all rows are fewer than ``most`` by arithmetic.  They are broadcast, and
    salted in proportion to their rows, so a key with a third of the rows never meets in one task; what is
    added to ``right`` is 2 x ``most`` rows at most.  ``n`` (long) is not returned."""
    edge = (right.agg(F.sum(n)).first()[0] or 0) // most
    salts = F.when(F.col(n) > edge, F.ceil(F.col(n) / max(edge, 1))).otherwise(F.lit(1)).cast("int")
    right = right.withColumn("_salts", F.least(salts, F.lit(most)))
    hot = right.filter("_salts > 1").select(*[F.col(c).alias(f"_j_{c}") for c in on], "_salts")
    same = F.lit(True)
    for c in on:
        same = same & (left[c] == F.col(f"_j_{c}"))
    rest = [c for c in left.columns if c not in on] or on
    salted = left.join(F.broadcast(hot), same, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_salts")), F.lit(0)).cast("int"))
    salted = salted.drop("_salts", *[f"_j_{c}" for c in on])
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", n)
    return salted.join(right, [*on, "_salt"]).drop("_salt")


def _delete(spark: SparkSession, gone: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in gone:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        _made[spark.sparkContext.applicationId].remove(p)


def _paths(spark: SparkSession, frames: list[DataFrame]) -> list[str]:
    """Tables made here that the frames read, by the roots of their scans (no file is listed)."""
    roots: set[str] = set()
    for df in frames:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for i in range(leaves.size()):
            if leaves.apply(i).nodeName().startswith("LogicalRelation"):
                roots |= {str(leaves.apply(i).relation().location().rootPaths().mkString("|"))}
    return [p for p in _made.get(spark.sparkContext.applicationId, []) if any(p.rsplit("/", 1)[-1] in r for r in roots)]


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the tables that ``frames`` are.  Frames that still read one fail, so a table
    goes only when nothing lazy hangs on it."""
    _delete(spark, _paths(spark, list(frames)))


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables made inside are deleted at the end, but for those that frames in the yielded list read."""
    before = set(_made.get(spark.sparkContext.applicationId, []))
    kept: list[DataFrame] = []
    yield kept
    stay = set(_paths(spark, kept))
    _delete(spark, [p for p in _made.get(spark.sparkContext.applicationId, []) if p not in before and p not in stay])


@atexit.register
def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        _delete(spark, list(_made.get(spark.sparkContext.applicationId, [])))
    except Exception:  # the JVM may be gone already; nothing is left to clean with
        pass
