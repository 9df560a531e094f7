"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on one machine, where none is set, a folder of
    this process that goes with it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.conf.get("docloom.library.scratch", None)
    if not own:
        own = tempfile.mkdtemp(prefix="docloom-lib-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("docloom.library.scratch", own)
    return own


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/docloom-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written and read back: computed once, without lineage."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_rows(df: DataFrame) -> DataFrame:
    """``df``, which has rows for a query's own terms or its shown results, as literal rows."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
