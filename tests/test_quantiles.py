import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefold.operators import quantiles, rollup


def plain(values, p):
    values = sorted(values)
    k = (len(values) - 1) * p
    a, b = values[math.floor(k)], values[math.ceil(k)]
    return a if a == b or k == math.floor(k) else a + (b - a) * (k - math.floor(k))


@pytest.mark.parametrize("few", [3, 20_000])
def test_equals_sorting(spark, few):
    rng = random.Random(few)
    kinds = {"even": lambda: rng.random(), "ties": lambda: float(rng.randrange(4)), "far": lambda: math.exp(rng.gauss(0, 40)) * rng.choice((-1, 1)), "hot": lambda: 7.0 if rng.random() < 0.6 else rng.random() * 20}
    rows = [(g, f()) for g, f in kinds.items() for _ in range(700)] + [("one", 3.5), ("two", 1.0), ("two", 2.0), (None, 5.0), (None, 6.0), (None, 8.0), ("none", None)]
    rng.shuffle(rows)
    at = (0.0, 0.1, 0.5, 0.75, 0.99, 1.0)
    got = {r.g: tuple(r)[1:] for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", at, few=few, accuracy=200).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, found in got.items():
        assert found[0] == len(groups[g])
        for p, q in zip(at, found[1:]):
            assert q == pytest.approx(plain(groups[g], p), rel=1e-12), (g, p)


def test_without_groups_and_without_rows(spark):
    frame = spark.range(1001).withColumn("v", F.col("id") * 2.0)
    assert tuple(quantiles.quantiles(frame, [], "v", (0.5, 0.25), few=10).first()) == (1001, 1000.0, 500.0)
    assert tuple(quantiles.quantiles(frame.limit(0), [], "v").first()) == (0, None)
    assert quantiles.quantiles(frame.limit(0), ["id"], "v").collect() == []
    with pytest.raises(ValueError):
        quantiles.quantiles(frame, ["id"], "v", most_groups=100)


def test_joint_places_equal_windows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(a), int(b) if b else None, {"x": 1}) for k, a, b in zip(range(800), rng.integers(0, 300, 800) / 7, rng.integers(0, 4, 800))]
    frame = spark.createDataFrame(rows, "k long, a double, b long, m map<string,int>").repartition(5)
    got = rollup.place_all(frame, {"a": "a_rank", "b": "b_rank"})
    assert got.columns == ["k", "a", "b", "m", "a_rank", "b_rank"]
    con = duckdb.connect()
    t = [(k, a, b) for k, a, b, _ in rows]
    con.execute("CREATE TABLE t (k BIGINT, a DOUBLE, b BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", t)
    want = con.execute("SELECT k, rank() OVER (ORDER BY a DESC NULLS LAST), rank() OVER (ORDER BY b DESC NULLS LAST) FROM t").fetchall()
    assert sorted((r.k, r.a_rank, r.b_rank) for r in got.collect()) == sorted(want)
    one = rollup.place(frame, "a", "r")  # tables with maps
    assert sorted((r.k, r.r) for r in one.collect()) == sorted((k, a) for k, a, _ in want)
    assert rollup.place_all(frame.limit(0), {"a": "x"}).collect() == []
