"""Spans: named stretches of work that show in Spark's own job descriptions, and in the log as JSON without any content."""

from __future__ import annotations

import contextlib
import json
import logging
import time
import uuid
from collections.abc import Iterator

import xxhash
from pyspark.sql import SparkSession

LOG = logging.getLogger("tessera")


def hash_content(text: str) -> str:
    """What stands for a text in logs."""
    return xxhash.xxh3_64_hexdigest(text.encode())


@contextlib.contextmanager
def span(spark: SparkSession, name: str, **attributes) -> Iterator[str]:
    """Work under a name: its jobs are described by it, and one line says how long it took and how it ended.

    Strings among the attributes are logged as hashes.
    """
    key, began, status = uuid.uuid4().hex, time.monotonic(), "ok"
    before = spark.sparkContext.getLocalProperty("spark.job.description")
    spark.sparkContext.setJobDescription(f"{name} {key[:8]}")
    try:
        yield key
    except BaseException as e:
        status = type(e).__name__
        raise
    finally:
        spark.sparkContext.setLocalProperty("spark.job.description", before)
        told = {k: hash_content(v) if isinstance(v, str) else v for k, v in attributes.items()}
        LOG.info(json.dumps({"span": name, "trace_id": key, "status": status, "seconds": round(time.monotonic() - began, 3), **told}, default=str))
