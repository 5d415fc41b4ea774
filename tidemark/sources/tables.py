"""Reading tables and cutting lineage through tables written to the shared folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast (the side is counted first).
BROADCAST_ROWS = 200_000

_OWN: list[str] = []


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of parquet tables (a file or a directory of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a session in one process (master ``local``: tests, a laptop) may name none; a temporary
    folder is then made and removed at exit. On a cluster executors would each write to a disk of
    their own, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one intermediate feeds several branches or rounds: the files survive the
    loss of any executor, unlike cached blocks, and the plan behind them is cut.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a materialised frame that nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a *materialised* frame for broadcast if its counted rows are at most ``limit``.

    Beyond the limit the frame is returned as it is and the join shuffles.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
