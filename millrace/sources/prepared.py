"""Prepared columns: what profiles and filters ask for, stored once as Parquet without the texts.

Filters on stored columns reach the scan, which reads the named columns alone and passes row groups by their least and greatest
values. Rows clustered by a column let whole files be passed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def prepare(docs: DataFrame, path: str, cluster_by: Sequence[str] = (), leave: Sequence[str] = ("text",)) -> DataFrame:
    """Write the columns of docs but those to leave, and give the stored table back."""
    rows = docs.drop(*leave)
    if cluster_by:
        rows = rows.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    rows.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
