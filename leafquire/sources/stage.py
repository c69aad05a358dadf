"""Stage tables: what a job writes between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all machines share.

    Only on one machine (a local master) a temporary folder takes its place if it is
    unset; on a cluster that would lose rows, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="leafquire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A step that several later ones read runs once, and a lost executor costs no more
    than the step at hand. ``release`` deletes what was written. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = kept(f"{shared_folder(spark)}/leafquire-stage-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(path: str) -> str:
    """``path``, to be deleted by ``release``."""
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the stage tables of this process, once no result that reads them is needed."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
