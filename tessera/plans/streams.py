"""The driver's queries for streams with state, and for batches cut by time, each with SQL over the same events."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs
from .catalog import _GAP, _read, _save, _streamed, query

_MOVES = """v AS (SELECT event_id, event_type AS project, concat('f', CAST(user_id % 20 AS VARCHAR), '.py') AS path, CASE WHEN event_id % 5 = 0 THEN 'moved' WHEN event_id % 4 = 0 THEN 'deleted' ELSE 'modified' END AS kind, concat('g', CAST(user_id % 30 AS VARCHAR), '.py') AS to_path, ts FROM events),
w AS (SELECT event_id, project, path, CASE WHEN kind = 'moved' THEN 'deleted' ELSE kind END AS kind, ts FROM v UNION ALL SELECT event_id, project, to_path, 'created', ts FROM v WHERE kind = 'moved')"""


@query(f"WITH {_MOVES}" + f""", m AS (SELECT *, ts - lag(ts) OVER (PARTITION BY project ORDER BY ts, event_id) AS since FROM w),
g AS (SELECT *, sum(CASE WHEN since IS NULL OR since > INTERVAL {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM m),
l AS (SELECT project, burst, path, arg_max(kind, (ts, event_id)) AS kind FROM g GROUP BY ALL),
b AS (SELECT project, burst, min(ts) AS started_at, count(*) AS n_events FROM g GROUP BY ALL),
c AS (SELECT project, burst, coalesce(list(path ORDER BY path) FILTER (WHERE kind <> 'deleted'), []) AS changed, coalesce(list(path ORDER BY path) FILTER (WHERE kind = 'deleted'), []) AS removed FROM l GROUP BY ALL)
SELECT project, started_at, n_events, changed, removed FROM b JOIN c USING (project, burst)""")
def watch_moves(spark, sf_dir):
    """Bursts of events with moves, each a removal and an addition, over ranges of time."""
    e = _read(spark, sf_dir, "events")
    path = lambda letter, n: F.concat(F.lit(letter), F.col("user_id") % n, F.lit(".py"))
    kind = F.when(F.col("event_id") % 5 == 0, "moved").when(F.col("event_id") % 4 == 0, "deleted").otherwise("modified")
    return jobs.debounced(e.select("event_id", F.col("event_type").alias("project"), path("f", 20).alias("path"), kind.alias("kind"), path("g", 30).alias("to_path"), "ts"), _GAP)


LOCK_MINUTES = 600
_REQUESTS = """e AS (SELECT event_id AS seq, event_type AS project, concat('agent-', CAST(user_id % 12 AS VARCHAR)) AS agent_id, ts,
    CASE WHEN event_id % 10 = 0 THEN 'release' WHEN event_id % 10 < 3 THEN 'heartbeat' ELSE 'acquire' END AS kind,
    ['src/k' || CAST(event_id % 23 AS VARCHAR) || CASE WHEN event_id % 5 = 0 THEN '*' ELSE '.py' END, 'lib/[a-c]' || CAST(user_id % 31 AS VARCHAR)] AS patterns FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts, seq) AS n FROM e)"""
_HELD = "STRUCT(agent VARCHAR, patterns VARCHAR[], acquired TIMESTAMP, seq BIGINT, ends TIMESTAMP)[]"


@query(f"""WITH RECURSIVE {_REQUESTS},
m(project, n, held, agent_id, event, "at", seq, other, patterns, ended) AS (
  SELECT DISTINCT project, CAST(0 AS BIGINT), CAST([] AS {_HELD}), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR[]), CAST([] AS {_HELD}) FROM o
  UNION ALL
  SELECT project, n, CASE event WHEN 'granted' THEN list_append(list_filter(live, lambda h: h.agent <> agent_id), mine) WHEN 'released' THEN list_filter(live, lambda h: h.agent <> agent_id)
      WHEN 'extended' THEN list_append(list_filter(live, lambda h: h.agent <> agent_id), struct_pack(agent := agent_id, patterns := own[1].patterns, acquired := own[1].acquired, seq := own[1].seq, ends := ts + INTERVAL {LOCK_MINUTES} MINUTE)) ELSE live END,
    agent_id, event, ts, seq, CASE WHEN event = 'conflict' THEN way[1].agent END, CASE WHEN event IN ('granted', 'conflict') THEN patterns ELSE own[1].patterns END, ended
  FROM (SELECT *, CASE WHEN kind = 'acquire' AND len(way) = 0 THEN 'granted' WHEN kind = 'acquire' THEN 'conflict' WHEN len(own) > 0 AND kind = 'heartbeat' THEN 'extended' WHEN len(own) > 0 THEN 'released' END AS event FROM (
    SELECT *, list_filter(live, lambda h: h.agent = agent_id) AS own,
      list_sort(list_transform(list_filter(live, lambda h: h.agent <> agent_id AND len(list_filter(h.patterns, lambda x: len(list_filter(patterns, lambda y: x GLOB y OR y GLOB x)) > 0)) > 0), lambda h: struct_pack(acquired := h.acquired, seq := h.seq, agent := h.agent))) AS way,
      struct_pack(agent := agent_id, patterns := patterns, acquired := ts, seq := seq, ends := ts + INTERVAL {LOCK_MINUTES} MINUTE) AS mine FROM (
      SELECT o.*, list_filter(m.held, lambda h: h.ends >= o.ts) AS live, list_filter(m.held, lambda h: h.ends < o.ts) AS ended FROM m JOIN o ON o.project = m.project AND o.n = m.n + 1)))),
z AS (SELECT project, arg_max(held, n) AS held FROM m GROUP BY project), w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 MINUTE AS mark FROM events),
x AS (SELECT project, unnest(ended) AS h FROM m UNION ALL SELECT project, h FROM (SELECT project, unnest(held) AS h FROM z), w WHERE date_trunc('millisecond', h.ends) + INTERVAL 1 MILLISECOND <= mark)
SELECT project, agent_id, event, "at", seq, other, patterns FROM m WHERE event IS NOT NULL
UNION ALL SELECT project, h.agent, 'expired', h.ends, h.seq, NULL, h.patterns FROM x""")
def lock_stream(spark, sf_dir):
    """Grants, conflicts, extensions, releases and expiries of lock requests as they stream in."""

    def requests(e: DataFrame) -> DataFrame:
        kind = F.when(F.col("event_id") % 10 == 0, "release").when(F.col("event_id") % 10 < 3, "heartbeat").otherwise("acquire")
        own = F.concat(F.lit("src/k"), F.col("event_id") % 23, F.when(F.col("event_id") % 5 == 0, "*").otherwise(".py"))
        patterns = F.array(own, F.concat(F.lit("lib/[a-c]"), F.col("user_id") % 31))
        return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("project"), F.concat(F.lit("agent-"), F.col("user_id") % 12).alias("agent_id"), kind.alias("kind"), patterns.alias("patterns"), F.col("ts").cast("timestamp").alias("ts"))

    return _streamed(spark, sf_dir, lambda e: jobs.lock_changes(requests(e), LOCK_MINUTES)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT concat('n', CAST(event_id % 700 AS VARCHAR)) AS id, min(ts) AS at FROM events GROUP BY 1")
def consumed_marks_stream(spark, sf_dir):
    """The first delivery of each notification, however long after it comes again."""
    told = lambda e: e.select(F.concat(F.lit("n"), F.col("event_id") % 700).alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, sf_dir, lambda e: jobs.consumed_once(told(e))).withColumn("at", F.col("at").cast("timestamp_ntz"))


def updated(spark: SparkSession, sf_dir: str, make, keys: list[str]) -> DataFrame:
    """The newest rows of each key of a streaming query over the events that tells updates."""
    _save(spark.range(1))
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid4().hex}"
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = session.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    running = make(source).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    running.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"], "left_semi").drop("batch")


@query("SELECT event_type AS metric, event_id AS at, CAST(user_id AS DOUBLE) AS value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS INTEGER) AS age FROM events QUALIFY age <= 60")
def history_stream(spark, sf_dir):
    """The last 60 samples of each metric, kept as they stream in."""
    samples = lambda e: e.select(F.col("event_type").alias("metric"), F.col("event_id").alias("at"), F.col("user_id").alias("value"))
    return updated(spark, sf_dir, lambda e: jobs.rolling_history(samples(e)), ["metric"])
