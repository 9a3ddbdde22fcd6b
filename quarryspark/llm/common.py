"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoints import settle as reliable

__all__ = ["bounded_sample", "reliable", "require", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so extra columns, whatever they are called, never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> list:
    """At most ``rows`` rows for fitting a model: those with the least hash of the keys, the same ones on every run.

    A share of the hash range is cut out first, so tasks send a fixed number of rows in all to the driver, however many tasks there are.
    """
    total = df.count()
    h = F.xxhash64(*keys)
    if total > 2 * rows:
        df = df.where(h < F.lit(int(-(2**63) + 2**64 * (1.3 * rows / total))))
    return df.orderBy(h, *keys).limit(rows).collect()
