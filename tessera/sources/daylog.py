"""Logs laid out by day, so that what is asked of a time reads the days that it is about.

Rows are only added. A state, the last row of each key, is kept as a snapshot up to a day and the rows of the days
after it; a state that forgets what is old needs just the days that it still knows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.coordination import latest


@dataclass(frozen=True)
class DayLog:
    """Rows of ``columns`` (DDL) below ``folder``, by the day of their column ``at``."""

    spark: SparkSession
    folder: str
    columns: str
    at: str

    def append(self, rows: DataFrame) -> None:
        """Adds rows; those without a time are of no day and always read."""
        dated = rows.withColumn("day", F.to_date(self.at))
        # A day is several files where it has many rows.
        dated.repartition("day", F.pmod(F.xxhash64(*rows.columns), F.lit(4))).write.mode("append").partitionBy("day").parquet(f"{self.folder}/days")

    def rows(self, since: Column | None = None) -> DataFrame:
        """All rows, or those from a time on; the scan is told the days, and then the time."""
        read = self._read("days", f"{self.columns}, day date")
        if since is None:
            return read
        return read.filter((F.col("day") >= F.to_date(since)) & (F.col(self.at) >= since))

    def _read(self, name: str, columns: str) -> DataFrame:
        try:
            return self.spark.read.schema(columns).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], columns)

    def newest(self, n: int, *order: Column) -> DataFrame:
        """The first ``n`` rows by time, newest first, then by ``order``; of the days, the last that have so many rows are read."""
        per = sorted(((r["day"], r["n"]) for r in self._read("days", f"{self.columns}, day date").groupBy("day").agg(F.count("*").alias("n")).collect() if r["day"]), reverse=True)
        got, first = 0, None
        for day, many in per:  # one row a day
            got, first = got + many, day
            if got >= n:
                break
        rows = self.rows().drop("day") if first is None or got < n else self.rows().filter(F.col("day") >= F.lit(first)).drop("day")
        return rows.orderBy(F.desc(self.at), *order).limit(n)

    def state(self, keys: list[str], order: list[str]) -> DataFrame:
        """The last row of each key: of the newest snapshot of these keys and the days after it."""
        last = self._snapshots(keys)
        if last is None:
            return latest(self.rows().drop("day"), keys, order)
        tail = self.rows().filter(F.col("day").isNull() | (F.col("day") > F.lit(last)))
        kept = self._read(f"state/{'-'.join(keys)}/upto={last.isoformat()}", self.columns)
        return latest(kept.unionByName(tail.drop("day")), keys, order)

    def _snapshots(self, keys: list[str]) -> dt.date | None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state/{'-'.join(keys)}")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath() for f in files.listStatus(place)] if files.exists(place) else []
        # A snapshot counts once it is whole.
        whole = [p.getName().split("=")[1] for p in found if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(map(dt.date.fromisoformat, whole), default=None)

    def snapshot(self, keys: list[str], order: list[str], upto: dt.date) -> None:
        """Writes the state of the days up to ``upto``, from the snapshot before and the days since; no later rows of those days may come."""
        last = self._snapshots(keys)
        if last is not None and last >= upto:
            return
        days = self.rows().filter(F.col("day") <= F.lit(upto))
        if last is not None:
            days = days.filter(F.col("day") > F.lit(last))
        rows = days.drop("day")
        if last is not None:
            rows = rows.unionByName(self._read(f"state/{'-'.join(keys)}/upto={last.isoformat()}", self.columns))
        latest(rows, keys, order).select(*rows.columns).write.mode("overwrite").parquet(f"{self.folder}/state/{'-'.join(keys)}/upto={upto.isoformat()}")


def locks_in_force(log: DayLog, now: Column, ttl_minutes: int = 60) -> DataFrame:
    """Of each agent and project the newest lock, unless it has expired; only days that a lock can still be of are read."""
    recent = log.rows(X.before(now, ttl_minutes)).drop("day")
    newest = latest(recent, ["agent_id", "project"], ["acquired_at", "seq"])
    return newest.withColumn("expires_at", F.col("acquired_at") + F.make_dt_interval(mins=F.lit(ttl_minutes)))
