"""Intermediate tables in the folder all executors share; they cut lineage and outlive lost executors.

They are dropped when the process ends, or earlier: what is made within `with released():` goes at the end of the block.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_open: list[Scratch] = []


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; a folder of our own where none is set and executors share this machine's files."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; a cluster needs it to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
        _made.append(path)
    return path.rstrip("/")


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex[:12]}"
        _open.append(self)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Drop at the end what is stored within; results that are to outlive the block must have been written."""
    before = list(_open)
    try:
        yield
    finally:
        for s in [s for s in _open if s not in before]:
            s.drop()
            _open.remove(s)


@atexit.register
def _sweep() -> None:
    for s in _open:
        if s.spark._jsc is not None and not s.spark._jsc.sc().isStopped():
            s.drop()
        elif s.path.startswith("file:"):
            shutil.rmtree(s.path.removeprefix("file://"), ignore_errors=True)
    for path in _made:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
