"""Composite scores and ranks kept up to date: a batch of ratings costs what its keys touch.

`ViewStore` holds three tables of a BucketStore that change in one commit: `ratings` (the latest row of each entity and rater),
`scores` (sum and number of scores of each entity) and `counts` (how many entities have each composite score). A batch reads the
buckets of its entities, takes back the old score of every key it overwrites, adds the new one, and moves the touched entities in
`counts` from their old to their new value. The number of the batch is part of the commit, so one that runs again is skipped.

`counts` is an order-statistics index: the place of a score is one more than the number of entities above it. It is summed by
ranges of `width` first, then within a range, so ranks of any entities come without sorting all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorefold.operators import rollup
from scorefold.sources import stage
from scorefold.sources.buckets import BucketStore, Change, Manifest


class ViewStore:
    def __init__(self, spark: SparkSession, path: str, entity: str, rater: str, order: Sequence[str], score: str = "score", buckets: int = 64, width: float = 1.0):
        self.store = BucketStore(spark, path, buckets)
        self.entity, self.rater, self.order, self.score, self.width = entity, rater, list(order), score, width

    def apply(self, batch: DataFrame, number: int | None = None, stream: str = "stream") -> DataFrame:
        """Take a batch in; (entity, before, after) composite scores of the entities whose ratings it changed."""
        e, keys = self.entity, [self.entity, self.rater]
        spark = self.store.spark
        batch = stage.written(rollup.latest_rating(batch.where(F.col(e).isNotNull()), keys, self.order), "batch-ratings")
        buckets = self.store.touched(batch, e)
        kinds = dict(batch.dtypes)
        moved: list[DataFrame] = []

        def work(base: Manifest) -> dict[str, Change] | None:
            if not buckets or number is not None and base.done.get(stream, -1) >= number:
                return None
            old = self.store.read("ratings", base, buckets, schema=batch.schema)
            same = old.join(batch.select(*keys), keys, "left_semi").withColumn("_fresh", F.lit(False))
            both = same.unionByName(batch.withColumn("_fresh", F.lit(True)))  # of equal order the batch's counts
            pair = both.groupBy(*keys).agg(F.max_by(self.score, F.struct(*self.order, "_fresh")).alias("_new"), F.max(F.when(~F.col("_fresh"), F.col(self.score))).alias("_was"))
            delta = pair.groupBy(e).agg(
                (F.coalesce(F.sum("_new"), F.lit(0)) - F.coalesce(F.sum("_was"), F.lit(0))).alias("_sum"), (F.count("_new") - F.count("_was")).alias("_n")
            )
            delta = stage.written(delta, "score-deltas")
            scores = self.store.read("scores", base, buckets, schema=f"{e} {kinds[e]}, composite_score {dict(delta.dtypes)['_sum']}, coverage bigint")
            joined = scores.join(delta, e, "full").select(
                e, F.col("composite_score").alias("_before"), (F.coalesce("composite_score", F.lit(0)) + F.coalesce("_sum", F.lit(0))).alias("composite_score"),
                (F.coalesce("coverage", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("coverage"), F.col("_sum").isNotNull().alias("_touched"),
            )
            joined = stage.written(joined, "joined-scores")
            touched = joined.where("_touched").select(e, F.col("_before").alias("before"), F.when(F.col("coverage") > 0, F.col("composite_score")).alias("after"))
            moved[:] = [touched]
            steps = touched.select(F.explode(F.array(F.struct(F.col("before").alias("value"), F.lit(-1).alias("n")), F.struct(F.col("after").alias("value"), F.lit(1).alias("n")))).alias("s")).select("s.*").where("value IS NOT NULL")
            steps = stage.written(steps.groupBy("value").agg(F.sum("n").alias("n")).where("n <> 0"), "count-steps")
            ranges = self.store.touched(steps, "value")
            counts = self.store.read("counts", base, ranges, schema=steps.schema).unionByName(steps).groupBy("value").agg(F.sum("n").alias("n")).where("n > 0")
            rest = old.join(batch.select(*keys), keys, "left_anti")
            newest = rollup.latest_rating(both, keys, [*self.order, "_fresh"]).drop("_fresh")
            changes = {"ratings": Change(rest.unionByName(newest), e, buckets), "scores": Change(joined.where("coverage > 0").select(e, "composite_score", "coverage"), e, buckets)}
            if ranges:
                changes["counts"] = Change(counts, "value", ranges)
            return changes

        self.store.change(work, None if number is None else {stream: number})
        return moved[0] if moved else spark.createDataFrame([], f"{e} {kinds[e]}, before {kinds[self.score]}, after {kinds[self.score]}")

    def ratings(self) -> DataFrame:
        return self.store.read("ratings")

    def scores(self, buy: float = 60, hold: float = 40) -> DataFrame:
        return self.store.read("scores").withColumn("consensus_recommendation", rollup.consensus(F.col("composite_score"), buy, hold))

    def places(self) -> DataFrame:
        """(value, n, rank): equal scores share the place after all higher ones."""
        counts = self.store.read("counts").withColumn("_range", F.floor(F.col("value") / self.width))
        above = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per range that occurs
        ranges = counts.groupBy("_range").agg(F.sum("n").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
        within = Window.partitionBy("_range").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
        rows = counts.join(ranges, "_range").withColumn("rank", F.col("_above") + F.coalesce(F.sum("n").over(within), F.lit(0)) + 1)
        return rows.select("value", "n", "rank")

    def ranked(self, scores: DataFrame | None = None, value: str = "composite_score") -> DataFrame:
        """All scores, or those given (such as what apply() moved), with their place."""
        scores = self.store.read("scores") if scores is None else scores
        return scores.join(self.places().select(F.col("value").alias(value), "rank"), value)


def stream_view(stream: DataFrame, view: ViewStore, checkpoint: str, name: str = "stream"):
    """Keep the view up to date from a stream of ratings; the running query comes back."""

    def take(batch: DataFrame, number: int) -> None:
        view.apply(batch, number, name)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
