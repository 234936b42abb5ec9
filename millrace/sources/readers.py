"""Sources of documents as (source_key, text): rows in memory, files, JSON lines, pinned objects, other readers' rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import ranked
from millrace.scratch import Scratch

_KIND = "source_key string, text string"


def checked(docs: DataFrame) -> DataFrame:
    """Blank keys are an error where they are met, and so are null texts; keys that repeat fail at capture."""
    bad = F.raise_error(F.concat(F.lit("a source needs a key and a text; got key "), F.coalesce("source_key", F.lit("null"))))
    return docs.withColumn("text", F.when((F.trim("source_key") == "") | F.col("source_key").isNull() | F.col("text").isNull(), bad.cast("string")).otherwise(F.col("text")))


def from_rows(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    return checked(spark.createDataFrame(list(rows), _KIND))


def from_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """A document a file, however deep; the key is the path below the root."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    path = F.col("_metadata.file_path")
    cut = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    plain = root.removeprefix("file://").rstrip("/")
    key = F.when(cut(path) == plain, F.element_at(F.split(path, "/"), -1)).otherwise(F.substring(cut(path), len(plain) + 2, 1 << 30) if "://" not in root.removeprefix("file://") else F.replace(path, F.lit(root.rstrip("/") + "/"), F.lit("")))
    return reader.text(root, wholetext=True).select(F.url_decode(F.replace(key, F.lit("+"), F.lit("%2B"))).alias("source_key"), F.col("value").alias("text"))


def from_jsonl(spark: SparkSession, path: str, text_column: str = "text", key_column: str | None = None, prefix: str = "", limit: int | None = None) -> DataFrame:
    """JSON lines, plain or gzip. Without a key column, keys are the file's name and a row's eight-digit place in it.

    Lines beyond `limit` aren't parsed; an invalid line is an error that names it.
    """
    lines = spark.read.text(path).select(F.element_at(F.split("_metadata.file_name", "/"), -1).alias("file"), "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    scratch = Scratch(spark, "jsonl")
    order = [F.col("file"), F.col("file_block_start"), F.col("at")]
    numbered = ranked(lines, order, scratch, "nth")
    if limit is not None:
        numbered = numbered.where(F.col("nth") < limit)
    first = numbered.groupBy("file").agg(F.min("nth").alias("first"))  # a row a file
    numbered = numbered.join(first, "file").withColumn("place", F.col("nth") - F.col("first"))
    name = F.concat(F.col("file"), F.lit(" row "), F.col("place").cast("string"))
    value = lambda column: F.get_json_object("line", f"$.{column}")
    bad = lambda what: F.raise_error(F.concat(F.lit(f"{what} in "), name)).cast("string")
    text = F.coalesce(value(text_column), bad(f"no text {text_column!r}"))
    key = F.coalesce(value(key_column), bad(f"no key {key_column!r}")) if key_column else F.concat(F.col("file"), F.lit("/"), F.lpad(F.col("place").cast("string"), 8, "0"))
    return numbered.select(F.concat(F.lit(prefix), key).alias("source_key"), text.alias("text"))


def from_objects(spark: SparkSession, manifest: Mapping[str, str]) -> DataFrame:
    """uri -> SHA-256 of its bytes; another digest is an error."""
    want = spark.createDataFrame(sorted(manifest.items()), "source_key string, digest string")
    found = spark.read.format("binaryFile").load([u for u, _ in sorted(manifest.items())]).select(F.regexp_replace("path", r"^file:/+", "/").alias("source_key"), "content")
    both = want.withColumn("source_key", F.regexp_replace("source_key", r"^file:/+", "/")).join(found, "source_key", "left")
    ok = F.sha2("content", 256) == F.col("digest")
    text = F.when(ok, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("source_key"))).cast("string"))
    return both.select("source_key", text.alias("text"))


def from_table(df: DataFrame, key: str, text: str = "text", template: str = "{}") -> DataFrame:
    """Rows of any Spark source; template puts the key into a longer one, as 'hf://repo/config/split/{}' does."""
    before, _, after = template.partition("{}")
    return df.select(F.concat(F.lit(before), F.col(key).cast("string"), F.lit(after)).alias("source_key"), F.col(text).alias("text"))


def from_namespace(df: DataFrame, namespace: str, key: str = "id", text: str = "text") -> DataFrame:
    """Keys as length:namespace:id, so that no two namespaces meet."""
    return df.select(F.concat(F.lit(f"{len(namespace)}:{namespace}:"), F.col(key).cast("string")).alias("source_key"), F.col(text).alias("text"))


def first(docs: DataFrame, n: int) -> DataFrame:
    """The first n documents in order of key."""
    return docs.orderBy("source_key").limit(n)
