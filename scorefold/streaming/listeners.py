"""Counts that come with the work: a listener that keeps what streams report, and observed metrics of batch jobs."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch bigint, at timestamp, rows bigint, metric string, value bigint"


class ProgressLog(StreamingQueryListener):
    """Rows (query, batch, at, rows, metric, value) of every micro-batch: one for each observed number, and one `batch_ms`.

    Streams say what to count by `count_by`; no second stream and no second pass reads the data. Rows are kept by the driver,
    a few per micro-batch, until `save` appends them to a table."""

    def __init__(self, names: set[str] | None = None):
        """names: of the queries to keep; all if left out."""
        self.names, self.rows, self.lock = names, [], threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.names is not None and p.name not in self.names:
            return
        found = {"batch_ms": p.batchDuration}
        for metrics in (p.observedMetrics or {}).values():
            found |= {k: v for k, v in metrics.asDict().items() if v is not None}
        with self.lock:
            self.rows += [(p.name, p.batchId, p.timestamp, p.numInputRows, k, int(v)) for k, v in found.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        """What is held, as a table of SCHEMA; a batch that was reported twice counts once."""
        with self.lock:
            rows = list(self.rows)
        frame = spark.createDataFrame([(*r[:2], str(r[2]), *r[3:]) for r in rows], SCHEMA.replace("at timestamp", "at string"))
        return frame.withColumn("at", F.col("at").cast("timestamp")).dropDuplicates(["query", "batch", "metric"])

    def save(self, spark: SparkSession, path: str) -> None:
        """Append what is held to a table and forget it."""
        with self.lock:
            rows, self.rows = self.rows, []
        log = ProgressLog()
        log.rows = rows
        if rows:
            log.table(spark).coalesce(1).write.mode("append").parquet(path)


def count_by(df: DataFrame, name: str, tests: dict[str, Column]) -> DataFrame:
    """df, batch or stream, that counts the rows of each test on the way through, and all rows as `seen`."""
    return df.observe(name, F.count("*").alias("seen"), *[F.count_if(t).alias(k) for k, t in tests.items()])


def run_counted(df: DataFrame, tests: dict[str, Column], run: Callable[[DataFrame], object]) -> tuple[object, dict[str, int]]:
    """What run (a write, say) makes of df, and the counts of the tests, from the same pass."""
    seen = Observation()
    out = run(df.observe(seen, F.count("*").alias("seen"), *[F.count_if(t).alias(k) for k, t in tests.items()]))
    return out, {k: int(v) for k, v in seen.get.items()}


def wait_for_events(spark: SparkSession, millis: int = 10_000) -> None:
    """Return once listeners have been told of all that has happened so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(millis)


def progress_against(log: DataFrame, metric: str, target: int) -> DataFrame:
    """(query, batch, at, done, total, pct) of one counted metric against a target, batch by batch."""
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.where(F.col("metric") == metric).select("query", "batch", "at", F.col("value").alias("done"), F.sum("value").over(order).alias("total"))
    return rows.withColumn("pct", F.coalesce(F.try_divide(F.col("total") * 100.0, F.lit(target)), F.lit(0.0)))

