"""Total orders of documents: keys with nulls last, then the identifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.fields import Ordering
from millrace.model import ranked
from millrace.scratch import Scratch


def order_columns(order_by: Sequence[Ordering]) -> list[Column]:
    return [*[o.sort() for o in order_by], F.col("doc_id").asc()]


def with_order(df: DataFrame, order_by: Sequence[Ordering], scratch: Scratch) -> DataFrame:
    """df with a column `_rank` that compares as the order does.

    Ascending keys and descending numbers make a struct that min() understands, without a sort; descending texts need ranks.
    """
    if any(o.descending and o.kind in ("text", "boolean") for o in order_by):
        return ranked(df, order_columns(order_by), scratch, "_rank")
    parts = []
    for k, o in enumerate(order_by):
        parts += [o.column.isNull().alias(f"n{k}"), (-o.column if o.descending else o.column).alias(f"k{k}")]
    return df.withColumn("_rank", F.struct(*parts, F.col("doc_id").alias("id")) if parts else F.col("doc_id"))
