"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that end a word: space and 0x09-0x0D. ``bytes.split()`` splits at exactly these.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only on one machine, where that may be unset, a temporary
    folder is set instead.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, folder: str) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read from there, and its path.

    Unlike a checkpoint's, the table's estimated size is its files' own, so estimates don't multiply in a loop.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release() -> None:
    """Gives a worker's freed memory back, so that what one task needed doesn't stay with those after it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets Arrow batches for tables of long texts: the default of 10 000 rows is some 30 MB in each of JVM and worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts of a column, nulls as none."""
    from pyspark.sql import functions as F

    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


#: Cells of the bitmap that maybe_listed() broadcasts: 1 MB, whatever the number of ids.
CELLS = 1 << 23


def maybe_listed(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` with ``__maybe``: false only where ``key`` is surely not among ``ids`` (one column), nulls included.

    The ids go into a bitmap by hash, 32768 bits a row, that is broadcast; so rows that need no join are told
    apart without a shuffle. With far more ids than cells, most rows are maybes.
    """
    from pyspark.sql import functions as F

    cell = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(CELLS))
    bits = ids.select(cell(ids.columns[0]).alias("c")).groupBy(F.bitmap_bucket_number("c").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("__bits"))
    marked = df.withColumn("__cell", cell(key)).withColumn("__bucket", F.bitmap_bucket_number("__cell")).join(F.broadcast(bits), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.bitmap_bit_position("__cell") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.getbit(byte, (F.bitmap_bit_position("__cell") % 8).cast("int")) == 1
    return marked.withColumn("__maybe", F.coalesce(set_, F.lit(False))).select(*[f"`{c}`" for c in df.columns], "__maybe")


def power_of_two(n: float, low: int, high: int) -> int:
    """The least power of two not under ``n``, held between ``low`` and ``high``."""
    return min(high, max(low, 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))))
