"""The folder that driver and executors share, and tables that are written there once."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of texts, or words, that a task takes of a batch at once.
PIECE_BYTES, PIECE_WORDS = 1 << 20, 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which a cluster names in ``spark.checkpoint.dir``; a temporary one only on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there, so plans that build on it stay short."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def pieces(batch: pa.RecordBatch, column: str):
    """Slices of a batch with at most PIECE_BYTES in a column of texts, or PIECE_WORDS in one of lists; a larger row is alone.

    What a task makes of a slice is then bounded, whatever a batch's rows come to.
    """
    values = batch.column(column)
    lists = pa.types.is_list(values.type)
    sizes = pc.list_value_length(values) if lists else pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    most, start = PIECE_WORDS if lists else PIECE_BYTES, 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
