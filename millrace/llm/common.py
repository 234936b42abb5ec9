"""What the operators of this folder share: scratch tables, Arrow limits and column picking."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.scratch import Scratch as Stored

#: Arrow batches end at this many rows or bytes, so a worker never holds much more than a batch of long texts.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches (unless the session already says less) and let workers import this package."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (paths, _ROOT) if x)
    return spark


class Scratch(Stored):
    """Intermediate tables as Parquet in the shared folder, for a session that is prepared for Arrow."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(prepare(spark), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under names of our own, so that further columns of any name are no matter."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Up to so many numbers are broadcast: a few tens of MB.
BROADCAST_IDS = 1 << 20


def by_ids(docs: DataFrame, ids: DataFrame, doc_id: str, how: str) -> DataFrame:
    """docs joined (left_anti or left_semi) with the one column of ids, a stored table; null ids meet null ids.

    Up to BROADCAST_IDS ids are broadcast. Of more, a filter of bounded size tells in the scan which rows may meet one, and only those are shuffled.
    """
    name = fresh(docs, "_id")
    ids, mine = ids.toDF(name), docs[f"`{doc_id}`"].cast("long")
    meets = (F.coalesce(mine, F.lit(0)) == F.coalesce(F.col(name), F.lit(0))) & (mine.isNull() == F.col(name).isNull())
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), meets, how)
    from millrace.llm.filters import passes

    may = passes(ids.select(F.col(name).cast("long")))(mine)
    joined = docs.where(may).join(ids.hint("merge"), meets, how)
    return joined if how == "left_semi" else docs.where(~may).unionByName(joined)
