"""Intermediate results written once, in the folder the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. One of our own is made only where that is unset and there is one machine; elsewhere its absence is an error."""
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context._jsc.sc().isLocal():
            raise EngineError("set spark.checkpoint.dir to a folder that all executors share", 500)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarryspark-"))
        found = context.getCheckpointDir()
    return found


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a result that several plans read: it survives lost executors.

    Its files go when the result is no longer referenced, unless the cluster says otherwise.
    """
    spark = df.sparkSession
    shared_folder(spark)
    conf = spark.sparkContext._jsc.sc().conf()
    if not conf.contains("spark.cleaner.referenceTracking.cleanCheckpoints"):
        conf.set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint()
