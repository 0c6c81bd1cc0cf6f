import random

import pytest
from pyspark.sql import functions as F

from scorefold.operators import rollup
from scorefold.sources import documents
from scorefold.sources.buckets import BucketStore, Change, Conflict, ManifestLog
from scorefold.streaming import incremental, listeners, ratings, stateful

KIND = "symbol string, persona string, score bigint, at bigint"


def batches(seed, n=4, size=60):
    rng = random.Random(seed)
    return [[(f"S{rng.randrange(25)}", f"p{rng.randrange(4)}", rng.choice((None, *range(11))), 1000 * b + k) for k in range(size)] for b in range(n)]


def plain(rows):
    """composite and coverage of each entity from the latest rating of each rater."""
    last = {}
    for s, p, score, at in rows:
        if (s, p) not in last or at >= last[s, p][0]:
            last[s, p] = (at, score)
    out = {}
    for (s, _), (_, score) in last.items():
        if score is not None:
            total, n = out.get(s, (0, 0))
            out[s] = (total + score, n + 1)
    return out


def test_view_follows_overwrites(spark, tmp_path):
    view = incremental.ViewStore(spark, f"{tmp_path}/view", "symbol", "persona", ["at"], buckets=8, width=5)
    seen = []
    for number, rows in enumerate(batches(1)):
        before = plain(seen)
        seen += rows
        moved = {r.symbol: (r.before, r.after) for r in view.apply(spark.createDataFrame(rows, KIND), number).collect()}
        want = plain(seen)
        assert {r.symbol: (r.composite_score, r.coverage) for r in view.scores().collect()} == want
        assert moved == {s: (before.get(s, (None,))[0], want.get(s, (None,))[0]) for s in {r[0] for r in rows}}
        values = [v for v, _ in want.values()]
        assert {r.symbol: r["rank"] for r in view.ranked().collect()} == {s: 1 + sum(x > v for x in values) for s, (v, _) in want.items()}
    assert sum(r.n for r in view.places().collect()) == len(want)
    again = view.apply(spark.createDataFrame(batches(1)[-1], KIND), 3)  # a batch that runs again
    assert again.collect() == [] and {r.symbol: r.composite_score for r in view.scores().collect()} == {s: v for s, (v, _) in want.items()}
    late = view.apply(spark.createDataFrame([("S1", "p1", 10, -5)], KIND), 4).collect()  # an old rating changes nothing
    assert all(r.before == r.after for r in late)


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    view = incremental.ViewStore(spark, f"{tmp_path}/view", "symbol", "persona", ["at"], buckets=64)
    view.apply(spark.createDataFrame([(f"S{k}", "p", 3, 0) for k in range(300)], KIND))
    one = view.store.current()
    view.apply(spark.createDataFrame([("S7", "p", 9, 1)], KIND))
    two = view.store.current()
    changed = {b for b in one.folders["ratings"] if one.folders["ratings"][b] != two.folders["ratings"][b]}
    assert len(changed) == 1 and len(one.folders["ratings"]) > 50
    assert sum(one.folders["scores"][b] != two.folders["scores"][b] for b in one.folders["scores"]) == 1


def test_two_writers(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/t", buckets=4)
    store.upsert("t", spark.createDataFrame([(k, 0) for k in range(20)], "k long, v long"), ["k"])
    calls = []

    def slow(base):
        calls.append(base.version)
        if len(calls) == 1:  # another writer commits while this one works, on the same rows
            BucketStore(spark, f"{tmp_path}/t", buckets=4).upsert("t", spark.createDataFrame([(k, 1) for k in range(20)], "k long, v long"), ["k"])
        rows = store.read("t", base).withColumn("v", F.col("v") + 10)
        return {"t": Change(rows, "k", range(4))}

    store.change(slow)
    assert calls == [1, 2] and {r.v for r in store.read("t").collect()} == {11}
    with pytest.raises(Conflict):
        store.commit(store.manifest(1), {})
    calls.clear()

    def apart(base):  # the other writer works on other buckets: what was written counts
        calls.append(base.version)
        if len(calls) == 1:
            other = [k for k in range(20) if k not in own]
            store.upsert("t", spark.createDataFrame([(k, 5) for k in other], "k long, v long"), ["k"])
        return {"t": Change(spark.createDataFrame([(k, 7) for k in own], "k long, v long"), "k", [0])}

    own = [r.k for r in store.read("t").where(store.bucket("k") == 0).collect()]
    store.change(apart)
    assert len(calls) == 1 and {(r.k in own, r.v) for r in store.read("t").collect()} == {(True, 7), (False, 5)}


def test_upsert_adds_columns_and_vacuum_keeps_what_is_read(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/t", buckets=4)
    for v in range(4):
        store.upsert("t", spark.createDataFrame([(k, v) for k in range(0, 20, v + 1)], "k long, v long"), ["k"])
    store.upsert("t", spark.createDataFrame([(0, 9, "new")], "k long, v long, note string"), ["k"])
    want = {k: 9 if k == 0 else max(v for v in range(4) if k % (v + 1) == 0) for k in range(20)}
    assert {r.k: r.v for r in store.read("t").collect()} == want
    assert store.vacuum(keep=1) > 0 and store.versions() == [5]
    assert {r.k: (r.v, r.note) for r in store.read("t").collect()} == {k: (v, "new" if k == 0 else None) for k, v in want.items()}
    store.upsert("t", spark.createDataFrame([(0, 1, None)], "k long, v long, note string"), ["k"], order=["v"])
    assert store.read("t").where("k = 0").first().v == 9
    with pytest.raises(KeyError):
        store.read("other")


def parts(spark, tmp_path, rows):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return ratings.stream_files(spark, f"{tmp_path}/in", KIND, files_per_batch=1)


def test_stateful_composite_equals_the_batch_result(spark, tmp_path):
    rows = batches(2, 3)
    updates = stateful.running_composite(parts(spark, tmp_path, rows), "symbol", "persona", "at", buy=25, hold=10)
    store = BucketStore(spark, f"{tmp_path}/store", buckets=4)
    stateful.upsert_updates(updates, store, "symbol", f"{tmp_path}/check").awaitTermination()
    got = {r.symbol: (r.composite_score, r.coverage, r.consensus_recommendation) for r in store.read("composite").collect()}
    flat = spark.createDataFrame(sum(rows, []), KIND)
    want = rollup.composite_scores(rollup.latest_rating(flat, ["symbol", "persona"], ["at"]), "symbol", buy=25, hold=10)
    assert got == {r.symbol: (r.composite_score, r.coverage, r.consensus_recommendation) for r in want.collect()}
    assert store.current().done == {"composite": 2}


def test_listener_keeps_counts(spark, tmp_path):
    log = listeners.ProgressLog({"counted"})
    spark.streams.addListener(log)
    try:
        rows = batches(3, 3, 20)
        stream = listeners.count_by(parts(spark, tmp_path, rows), "status", {"done": F.col("score").isNotNull(), "skipped": F.col("score").isNull()})
        q = stream.writeStream.queryName("counted").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        listeners.wait_for_events(spark)
    finally:
        spark.streams.removeListener(log)
    log.save(spark, f"{tmp_path}/log")
    assert log.rows == []
    saved = spark.read.parquet(f"{tmp_path}/log")
    totals = {r.metric: r.n for r in saved.groupBy("metric").agg(F.sum("value").alias("n")).collect()}
    flat = sum(rows, [])
    assert totals["seen"] == 60 and totals["skipped"] == sum(r[2] is None for r in flat) and totals["done"] + totals["skipped"] == 60
    over = listeners.progress_against(saved, "done", 120).orderBy("batch").collect()
    assert [r.batch for r in over] == [0, 1, 2] and over[-1].total == totals["done"] and over[-1].pct == totals["done"] * 100.0 / 120


def test_counts_of_a_batch_job(spark, tmp_path):
    frame = spark.range(100).withColumn("done", F.col("id") % 4 == 0)
    _, counts = listeners.run_counted(frame, {"done": F.col("done")}, lambda df: df.where("NOT done").write.parquet(f"{tmp_path}/todo"))
    assert counts == {"seen": 100, "done": 25} and spark.read.parquet(f"{tmp_path}/todo").count() == 75


def test_versions_of_a_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        documents.read_table(spark, path)
    folders = [documents.write_table(spark.range(k), path) for k in (1, 2, 3)]
    old = spark.read.parquet(folders[1])
    assert documents.read_table(spark, path).count() == 3 and documents.current_version(spark, path) == folders[2]
    assert documents.vacuum_table(spark, path) == 1 and old.count() == 2  # the last two stay
    with pytest.raises(Conflict):
        ManifestLog(spark, path).create(3, {"folder": "x"})


def test_compaction_takes_batches_away(spark, tmp_path):
    rows = batches(5, 2)
    table, into = f"{tmp_path}/table", f"{tmp_path}/into"
    for number, part in enumerate(rows):
        spark.createDataFrame(part, KIND).write.parquet(f"{table}/batch={number}")
        ratings.compact_ratings(spark, table, ["symbol", "persona"], ["at"], into, remove=True)
    assert ratings._batches(spark, table) == []
    got = rollup.composite_scores(documents.read_table(spark, into), "symbol").collect()
    assert {r.symbol: (r.composite_score, r.coverage) for r in got} == plain(sum(rows, []))
    ratings.compact_ratings(spark, table, ["symbol", "persona"], ["at"], into, remove=True)
    assert documents.read_table(spark, into).count() == len({r[:2] for r in sum(rows, [])})
