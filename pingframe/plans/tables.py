"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir.

    Where the session names none, a temporary folder serves a local master; on a cluster executors would not see it, so that is refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/pingframe-{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str, outlives: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and a lost executor costs a read and no more.

    Inside a scratch() block the table goes when the block ends; outlives: how many of the blocks around it stays longer than.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pingframe_path = path
    blocks = getattr(_open, "blocks", [])
    if len(blocks) > outlives:
        blocks[-1 - outlives].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that written() makes inside go at the end of the block, so nothing that reads them may leave it unwritten."""
    _open.blocks = [*getattr(_open, "blocks", []), []]
    try:
        yield
    finally:
        *_open.blocks, own = _open.blocks
        for table in own:
            dropped(table)


def _deleted(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete a table that written() made and that nothing reads any more."""
    _deleted(df.sparkSession, df._pingframe_path)


def cleared(spark: SparkSession) -> None:
    """Delete all tables that this application wrote. Results that still read them must have been stored before."""
    _deleted(spark, shared_dir(spark))
