"""Sharding by longest-processing-time scheduling: rows of equal texts stay together and shards are near equal in bytes.

Groups larger than 1/(shards * FINE) of all bytes are fewer than shards * FINE, so a driver-side heap can place them
one by one, largest first. The other groups are first packed, in each of several buckets of their digests, by the same heap into
as many bins as there are shards; those bins then go through the driver's heap in order of size. There is a bucket for every BUCKET_ROWS
rows, so a task packs about as many groups at most, and the driver sees `shards` sizes for as many rows: 20,000 for 10 ** 9 rows.

Defined results: a null text has no bytes and crc32 0; null texts are equal to each other, and not to the empty text.
Repeated rows are rows of one group and each gets a slot. An empty table gives an empty result. law is 'bytes', and
grown_shard is null. A null doc_id is allowed. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, pick, table
from millrace.model import ranked

SHARDS, FINE, BUCKET_ROWS = 40, 128, 2_000_000


def lpt(sizes: Iterable[tuple[int, object]], loads: list[int]) -> Iterator[tuple[object, int]]:
    """Largest first, ties by key, each to the least loaded shard, ties by number; loads is updated."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        loads[k] = load + size
        yield key, k


def _bins(shards: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("digest", ignore_index=True)
        bins = np.zeros(len(pdf), np.int32)
        for row, k in lpt(zip(pdf["bytes"].tolist(), range(len(pdf)), strict=True), [0] * shards):
            bins[row] = k
        return pdf.assign(bin=bins)

    return pack


def shard_lpt(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.coalesce(F.sha2("text", 256), F.lit("00"))).alias("digest"),
    )
    rows = scratch.keep(rows, "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    totals = rows.agg(F.sum("size"), F.count("*")).first()
    most = max(1, (totals[0] or 0) // (shards * FINE))
    loads = [0] * shards
    large = groups.where(F.col("bytes") > most)  # fewer than shards * FINE rows, as their sum is at most the total
    top = list(lpt(((r["bytes"], bytes(r["digest"])) for r in large.collect()), loads))
    buckets = -(-totals[1] // BUCKET_ROWS) or 1
    small = groups.where(F.col("bytes") <= most).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
    small = scratch.keep(small.groupBy("bucket").applyInPandas(_bins(shards), "digest binary, bytes long, bucket int, bin int"), "small")
    bins = small.groupBy("bucket", "bin").agg(F.sum("bytes").alias("bytes"))  # at most `shards` rows for each BUCKET_ROWS rows of docs
    low = list(lpt(((r["bytes"], (r["bucket"], r["bin"])) for r in bins.collect()), loads))
    of_bin = spark.createDataFrame([(b, i, s) for (b, i), s in low], "bucket int, bin int, shard int")
    of_top = spark.createDataFrame([(bytearray(d), s) for d, s in top], "digest binary, shard int")
    # Of the large groups any may hold a great part of all rows, so they are found by broadcast; the others hold 1 / (shards * FINE) of all bytes at most.
    named = of_top.select(F.col("digest").alias("_top"), F.col("shard").alias("_of_top"))
    dealt = rows.join(F.broadcast(named), F.col("digest") == F.col("_top"), "left")
    placed = small.join(F.broadcast(of_bin), ["bucket", "bin"]).select("digest", "shard")
    rest = dealt.where("_of_top is null").join(placed, "digest")
    placed = dealt.where("_of_top is not null").select("doc_id", "size", "text_crc32", F.col("_of_top").alias("shard")).unionByName(rest.select("doc_id", "size", "text_crc32", "shard"))
    placed = scratch.keep(placed, "placed").withColumn("tie", F.monotonically_increasing_id())

    # Slots: places in one order of all rows, in sorted ranges, less the place where the shard begins; equal rows fall into any range.
    order = [F.col(c) for c in ("shard", "doc_id", "text_crc32", "size", "tie")]
    placed = ranked(placed, order, scratch, "place")
    begins = placed.groupBy("shard").agg(F.min("place").alias("begin"))  # a row a shard
    return placed.join(F.broadcast(begins), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("begin")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_shard_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_lpt(table(spark, sf_dir, "documents"))
