"""A running composite in keyed state: right under overwrites, with state of one score per entity and rater.

`running_composite` keeps each rater's last order and score of an entity in one value of `transformWithState`, read and written
once a batch, as every call of the state is a message to the JVM. A later rating replaces the rater's share, an earlier one is
ignored, and an entity's new row comes out in update mode, so a batch emits the entities it changed only. With `expiry` the
state of an entity that nobody rates for so long goes. `upsert_updates` writes the rows that come out into a member of a
BucketStore.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from scorefold.operators import rollup
from scorefold.sources.buckets import BucketStore, Change, Manifest


class Composite(StatefulProcessor):
    """State of an entity: rater to (order, score). Rows are entity, rater, order and score, in this order."""

    def __init__(self, entity: str, score: str, order: str, kinds: StructType, expiry_ms: int | None):
        self.entity, self.expiry_ms = entity, expiry_ms
        each = StructType([StructField("rater", StringType()), StructField("place", kinds[order].dataType), StructField("score", kinds[score].dataType)])
        self.value = StructType([StructField("ratings", ArrayType(each))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.value, self.expiry_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = {}  # of each rater the row that counts in this batch: the state is read and written once, whatever the rows
        for r in rows:
            rater, place, score = r[1], r[2], r[3]
            if place is None:
                continue
            rater = "" if rater is None else rater
            if rater not in best or place > best[rater][0]:
                best[rater] = (place, score)
        if not best:
            return
        old = self.last.get()
        last = {r[0]: (r[1], r[2]) for r in old[0]} if old else {}
        changed = {k: v for k, v in best.items() if k not in last or v[0] > last[k][0]}
        if changed:
            last |= changed
            self.last.update(([(k, *v) for k, v in last.items()],))
            scores = [v[1] for v in last.values() if v[1] is not None]
            yield Row(**{self.entity: key[0], "composite_score": sum(scores) if scores else None, "coverage": len(scores)})

    def close(self) -> None:
        pass


def running_composite(stream: DataFrame, entity: str, rater: str, order: str, score: str = "score", expiry_ms: int | None = None, buy: float = 60, hold: float = 40) -> DataFrame:
    """(entity, composite_score, coverage, consensus_recommendation) of the entities that a batch changes, in update mode.

    Of several ratings of a rater the one of the largest order counts, whatever the order of arrival; ratings without entity or
    order are ignored. coverage 0 (with a null score) means that no rater has a score any more."""
    kinds = dict(stream.dtypes)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.where(F.col(entity).isNotNull()).select(entity, F.col(rater).cast("string").alias(rater), order, score).groupBy(entity)
    out = rows.transformWithState(Composite(entity, score, order, stream.schema, expiry_ms), f"{entity} {kinds[entity]}, composite_score {kinds[score]}, coverage bigint", "Update", "ProcessingTime" if expiry_ms else "None")
    return out.withColumn("consensus_recommendation", rollup.consensus(F.col("composite_score"), buy, hold))


def upsert_updates(updates: DataFrame, store: BucketStore, entity: str, checkpoint: str, name: str = "composite"):
    """Write a stream of changed entities into member `name` of a store: touched buckets only, a batch that runs again once."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        buckets = store.touched(rows, entity)

        def work(base: Manifest) -> dict[str, Change] | None:
            if not buckets or base.done.get(name, -1) >= number:
                return None
            old = store.read(name, base, buckets, schema=rows.schema).join(rows.select(entity), entity, "left_anti")
            return {name: Change(old.unionByName(rows).where("coverage > 0"), entity, buckets)}

        store.change(work, {name: number})
        rows.unpersist()

    return updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
