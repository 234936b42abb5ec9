"""Results as files: selections, lineage, packed sequences, producers' outputs. All go through Spark's committers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from millrace.scratch import Scratch


#: Bytes of text in a shard of a selection; a single longer text is a shard of its own. Rows and characters of the preview index.
SHARD_BYTES, PREVIEW_ROWS, PREVIEW_CHARACTERS = 8 << 20, 1000, 1000
#: Bytes of text in a file of a selection, so that small shards don't make a file each.
FILE_BYTES = 32 << 20


def sharded(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """rows in order of document with `ordinal` from 0 and `shard`: rows that begin in the same stretch of shard_bytes of text.

    Texts are sorted into ranges and stored once, with what the rows before in their range come to; the ranges before are added as
    they are read.
    """
    scratch = Scratch(rows.sparkSession, "selection")
    order = [F.col("doc_id"), *([F.col("occurrence")] if "occurrence" in rows.columns else [])]
    size = rows.columns.index("n_bytes")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            ends = total + np.cumsum(b.column(size).to_numpy(zero_copy_only=False).astype(np.int64))
            own = [np.full(b.num_rows, part, np.int32), np.arange(n, n + b.num_rows), np.r_[total, ends[:-1]][: b.num_rows], ends]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, own)], names=[*b.schema.names, "_part", "_row", "_before", "_end"])
            n, total = n + b.num_rows, int(ends[-1]) if b.num_rows else total

    fields = [*rows.schema.fields, StructField("_part", IntegerType()), *(StructField(c, LongType()) for c in ("_row", "_before", "_end"))]
    kept = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, StructType(fields)), "sorted")
    ranges = sorted(kept.groupBy("_part").agg(F.max("_row"), F.max("_end")).collect())  # a row a partition
    offsets, count, total = [], 0, 0
    for part, last, end in ranges:
        offsets.append((part, count, total))
        count, total = count + last + 1, total + end
    both = kept.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part int, _rows long, _bytes long")), "_part")
    shard = F.floor((F.col("_bytes") + F.col("_before")) / shard_bytes)
    return both.select(*rows.columns, (F.col("_rows") + F.col("_row")).alias("ordinal"), shard.alias("shard"))


def write_selection(rows: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """path/rows: whole shards in order, at most 2^16 files of about FILE_BYTES of text or a shard; row groups of about shard_bytes let a reader pass other shards. path/preview: the first rows.

    A shard holds less than shard_bytes of text before its last row, so it exceeds them by one text at most.
    """
    placed = sharded(rows, shard_bytes)
    shards = placed.agg(F.max("shard")).first()[0]
    files = shards and min(shards * shard_bytes // max(shard_bytes, FILE_BYTES) + 1, 1 << 16)
    spread = placed if shards is None else placed.repartitionByRange(files or 1, "shard")
    spread.sortWithinPartitions("ordinal").write.option("parquet.block.size", shard_bytes).mode("errorifexists").parquet(f"{path}/rows")
    first = placed.where(F.col("ordinal") < PREVIEW_ROWS)
    first.select("ordinal", "doc_id", "shard", F.substring("text", 1, PREVIEW_CHARACTERS).alias("text"), (F.length("text") > PREVIEW_CHARACTERS).alias("truncated")).coalesce(1).write.mode("errorifexists").parquet(f"{path}/preview")


def read_preview(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/preview")


def read_selection(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """A stored selection; another number of rows than was committed is an error."""
    df = spark.read.parquet(f"{path}/rows")
    if expected is not None:
        n, last = df.agg(F.count("*"), F.max("ordinal")).first()
        if n != expected or n and last != n - 1:
            raise ValueError(f"the selection at {path} has {n} rows; {expected} were committed")
    return df


def write_lineage(lineage: DataFrame, path: str) -> None:
    lineage.write.mode("errorifexists").json(path)


def write_fields(fields: DataFrame, evidence: DataFrame, path: str) -> None:
    """Producers' fields as JSON lines and dedupe evidence as Parquet, side by side."""
    fields.write.mode("errorifexists").json(f"{path}/fields")
    evidence.write.mode("errorifexists").parquet(f"{path}/evidence")


def _bytes(lists: pa.ListArray, kind: str) -> pa.BinaryArray:
    """Each list of numbers as bytes, made of the column's own buffer."""
    data = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    ends = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))] * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def token_shards(packed: DataFrame) -> DataFrame:
    """sequence, data (little-endian 32-bit tokens), mask (a byte a token), digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _bytes(b.column(1), "<i4"), _bytes(b.column(2), "u1")], names=["sequence", "data", "mask"])

    kind = packed.schema["sequence"].dataType.simpleString()
    return packed.select("sequence", "tokens", "loss_mask").mapInArrow(run, f"sequence {kind}, data binary, mask binary").withColumn("digest", F.sha2(F.concat("data", "mask"), 256))


def write_shards(packed: DataFrame, path: str) -> None:
    token_shards(packed).write.mode("errorifexists").parquet(path)
