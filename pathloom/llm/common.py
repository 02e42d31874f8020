"""Helpers that the training-data operators share: scratch tables in the shared folder, and word rules."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import folder, gone_at_exit

#: A word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


_collecting: ContextVar[list[Scratch] | None] = ContextVar("collecting", default=None)


@contextlib.contextmanager
def collected() -> Iterator[list[Scratch]]:
    """Gives the list of the Scratch folders that are made inside, in this thread alone, for a run that drops them once its result is written."""
    made: list[Scratch] = []
    token = _collecting.set(made)
    try:
        yield made
    finally:
        _collecting.reset(token)


class Scratch:
    """Tables of one run under a folder of its own in the shared folder; the run drops those that no later step reads, and the file system all that are left when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.names = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", []
        if (made := _collecting.get()) is not None:
            made.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the table once and gives it as a plain scan, which cuts the lineage."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        if not self.names:
            gone_at_exit(self.spark, self.path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Removes one table, or the whole folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self.names = [n for n in self.names if name and n != name]
        with contextlib.suppress(Exception):  # a folder that stays only costs disk
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Removes all tables but these."""
        for name in [*self.names]:
            if name not in names:
                self.drop(name)


def row_of(df: DataFrame):
    """Column: all columns of the frame as one struct, whatever their names."""
    return F.struct(*[own(c) for c in df.columns])


def own(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished steps, which else stay until the driver collects its garbage."""
    import gc
    import time

    for _ in range(2):  # what the first round frees may hold the rest
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def release() -> None:
    """Gives memory that a worker has freed back to the system; Spark keeps workers for other jobs."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def pack(values: np.ndarray) -> bytes:
    """An array of whole numbers as bytes: its bytes by place, all first ones, then all second ones, and so on, compressed."""
    import zstandard

    values = np.ascontiguousarray(values)
    planes = values.reshape(-1, 1).view(np.uint8).reshape(values.size, values.itemsize).T if values.size else values
    return values.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data) -> np.ndarray:
    import zstandard

    view = memoryview(data)
    kind = np.dtype(bytes(view[:4]).decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(view[4:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str = "text"):
    """Column: the array of words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
