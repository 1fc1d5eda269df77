"""XXH3 hashes, which Spark has no built-in for, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType


@F.pandas_udf(StringType())
def xxh3_hex(values: pd.Series) -> pd.Series:
    """The 16 hex digits of XXH3-64 of text or bytes; null stays null."""
    return values.map(lambda v: None if v is None else xxhash.xxh3_64_hexdigest(v))


def chunk_id(project: Column, path: Column, first: Column, last: Column) -> Column:
    return xxh3_hex(F.concat(project, F.lit(":"), path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string")))


@F.pandas_udf(BinaryType())
def pack_floats(values: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats end to end; null stays null."""
    return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def unpack_floats(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else np.frombuffer(v, "<f4"))
