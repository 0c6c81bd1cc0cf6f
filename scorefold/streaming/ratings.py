"""Ratings that arrive as files: keyed upserts per micro-batch, and a running composite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorefold.operators import rollup
from scorefold.sources import documents


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 4, **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).load(path)


def stream_ratings(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]):
    """Append every micro-batch, its latest row of each key, as a folder of its own under `table`; the running query comes back.

    A batch costs what it brings, not what is there. One that runs again replaces its own folder, whose files appear when
    the write commits, so readers never meet half of it. `latest_ratings` reads the table; `compact_ratings` keeps it short."""

    def append(batch: DataFrame, number: int) -> None:
        rollup.latest_rating(batch, keys, order).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_ratings(spark: SparkSession, table: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row of the largest order over all batches: one partial aggregation."""
    return rollup.latest_rating(spark.read.parquet(table).drop("batch"), keys, order)


def compact_ratings(spark: SparkSession, table: str, keys: Sequence[str], order: Sequence[str], into: str, remove: bool = False) -> str:
    """The table's latest rows as a new version of the table `into`, for readers that need no more batches.

    remove: the folders of the batches that went in are deleted then, and later compactions start from `into`, whose rows count
    as an older batch. Use it while no batch runs."""
    folders = sorted(s.getPath().toString() for s in _batches(spark, table))
    old = documents.current_version(spark, into) if remove else None
    rows = [spark.read.parquet(x) for x in (*folders, *([old] if old else []))]
    if not rows:
        return documents.write_table(documents.read_table(spark, into), into)
    both = rows[0]
    for part in rows[1:]:
        both = both.unionByName(part)
    version = documents.write_table(rollup.latest_rating(both, keys, order), into)
    if remove:
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return version


def _batches(spark: SparkSession, table: str):
    """Status of the whole batch folders of a table of stream_ratings."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{table}/batch=*/_SUCCESS")
    store = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return [store.getFileStatus(s.getPath().getParent()) for s in store.globStatus(pattern) or []]


def stream_progress(stream: DataFrame, table: str, checkpoint: str):
    """One row (batch, at, done) per micro-batch under `table`: when it came and how many rows it brought."""

    def note(batch: DataFrame, number: int) -> None:
        batch.agg(F.lit(number).cast("long").alias("batch"), F.current_timestamp().alias("at"), F.count("*").alias("done")).write.mode("overwrite").parquet(f"{table}/number={number}")

    return stream.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_over_time(notes: DataFrame, target: int | DataFrame) -> DataFrame:
    """(batch, at, done, total, pct): what was done after each micro-batch against a target; one row per batch."""
    total = F.sum("done").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    rows = notes.select("batch", "at", "done", total.alias("total"))
    goal = target.agg(F.count("*").alias("_target")) if isinstance(target, DataFrame) else notes.sparkSession.createDataFrame([(target,)], "_target long")
    return rows.crossJoin(F.broadcast(goal)).withColumn("pct", F.coalesce(F.try_divide(F.col("total") * 100.0, F.col("_target")), F.lit(0.0))).drop("_target")


def stream_composite(stream: DataFrame, entity: str, score: str = "score", buy: float = 60, hold: float = 40) -> DataFrame:
    """Running composite per entity for sources that deliver each (entity, rater) once; use stream_ratings for overwrites.
    State: one sum and count per entity."""
    out = stream.groupBy(entity).agg(F.sum(score).alias("composite_score"), F.count(score).alias("coverage"))
    return out.withColumn("consensus_recommendation", rollup.consensus(F.col("composite_score"), buy, hold))


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregating stream over what is there; every full result is a new version of the table, so readers
    (`documents.read_table`) see the old one until the new one is whole. The last two versions stay."""

    def put(batch: DataFrame, number: int) -> None:
        documents.write_table(batch, path)
        documents.vacuum_table(batch.sparkSession, path)

    df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
