"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, small, table

__all__ = ["cores", "materialize", "salted", "small", "spread", "table"]


def cores(spark: SparkSession) -> int:
    """Tasks that the cluster runs at once."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; a table of enough splits stays as it is read."""
    wide = cores(df.sparkSession)
    return df.repartition(2 * wide) if df.rdd.getNumPartitions() < wide else df


def salted(large: DataFrame, side: DataFrame, on: list[str], salts: int = 8) -> DataFrame:
    """large joined with side (few rows a key), each key of large spread over ``salts`` partitions."""
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", turn).join(copies, [*on, "_salt"]).drop("_salt")
