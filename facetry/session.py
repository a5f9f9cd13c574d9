"""Session helpers shared by all operators: the shared folder, lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors and ends the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read it back: a columnar, compressed lineage cut.

    The size that Spark then knows is that of the files. A checkpoint hands on the estimate of its plan instead, which
    joins multiply, so loops of many rounds are cut this way.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def removed(*frames: DataFrame) -> None:
    """Delete the folders of ``written`` relations whose readers have all been written themselves."""
    for df in frames:
        remove_folder(df.sparkSession, df.written_to)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Hint a broadcast only when the counted size allows it; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def tasks(rows: int, per: int = 100_000) -> int:
    """Tasks of about ``per`` rows. Spark's own tasks are of some compressed size, so of as many rows as compress to it."""
    return max(1, -(-rows // per))


def spread(df: DataFrame, per: int, *keys: str) -> DataFrame:
    """``df`` in tasks of about ``per`` rows, by ``keys`` where given. A small file may hold very many rows, so a step that
    makes many rows of one would else run in few tasks, whose time and memory grow with the input."""
    return df.repartition(tasks(df.count(), per), *keys)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, heavy: int = 100_000) -> DataFrame:
    """Inner join with ``right``, whose keys are unique and whose ``weight`` counts their rows in ``left``.

    Keys of more than ``heavy`` rows are few; they are joined by broadcast (behind the count of ``small``), so
    that no task receives all rows of such a key.
    """
    hot = cut(right.where(F.col(weight) > heavy))
    n = hot.count()
    if not n:
        return left.join(right, keys)
    usual = left.join(small(hot.select(*keys), n), keys, "left_anti").join(right.where(F.col(weight) <= heavy), keys)
    return left.join(small(hot, n), keys).unionByName(usual)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
