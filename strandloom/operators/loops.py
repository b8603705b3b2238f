"""State of iterative operators: reliable checkpoints in the folder that the session names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did (a cluster ships it with --py-files)."""
    env = spark.sparkContext.environment
    path = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in path:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *path])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where there is none, a local session gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get() if java.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/strandloom-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: lineage ends there, and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_of(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: unlike a checkpoint it has no partitioning, so a join with it
    shuffles both sides and a hot partition of the other one can be split at run time."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame, *cols: str) -> tuple:
    """Count and order-free digests of rows, to see whether a round changed anything."""
    h = F.xxhash64(*cols)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum((h % 1_000_003).cast("bigint")).alias("s")).first()
    return r["n"], r["x"], r["s"]


#: Rows of narrow tables (keys and numbers) that may be broadcast: some 100 MB in memory at worst.
BROADCAST_ROWS = 1_000_000


class Scratch:
    """Intermediate tables of one operator: Parquet in the shared folder, deleted after their last use.  A table cuts
    the lineage, outlives executors, and keeps column pruning for what reads it."""

    def __init__(self, spark: SparkSession):
        importable(spark)
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written once and read again."""
        path = new_folder(self.spark, label)
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((read, path))
        return read

    def drop(self, *gone: DataFrame) -> None:
        """Deletes tables that nothing reads from now on."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        for _, path in [t for t in self.tables if any(t[0] is g for g in gone)]:
            where = fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.tables = [t for t in self.tables if all(t[0] is not g for g in gone)]

    def keep(self, *kept: DataFrame) -> None:
        """Deletes all tables but these."""
        self.drop(*(t for t, _ in self.tables if all(t is not k for k in kept)))


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` joined with the stored table ``right``, broadcast if it has ``limit`` rows at most (they are counted), met
    by a shuffle of both sides otherwise."""
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, on, how)
