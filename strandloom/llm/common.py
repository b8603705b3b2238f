"""What the text operators share: reading tables, shared intermediate tables, joins with small tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of keys (three 64-bit columns at most, or a digest) that may be broadcast: some 100 MB in memory at worst.
BROADCAST_ROWS = 1_000_000
#: Rows whose texts a task holds as Python strings at one time, and words or tokens that a worker remembers.
TEXTS, REMEMBERED = 256, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; ``sf_dir`` may be any path that Spark's readers open."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


class Scratch:
    """The intermediate tables of one operator: Parquet in the shared folder, deleted after their last use.

    A table cuts the lineage, keeps column pruning for later readers, and outlives executors.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written once and read again."""
        path = f"{shared_dir(self.spark).rstrip('/')}/strandloom-{label}-{uuid.uuid4().hex}"
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
    """``left`` joined with the stored table ``right``, which is broadcast if it has ``limit`` rows at most (they
    are counted) and met by a shuffle of both sides otherwise."""
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, on, how)


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a batch's column; only those of some rows are Python strings at one time."""
    for at in range(0, len(column), TEXTS):
        yield from column.slice(at, TEXTS).to_pylist()


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
