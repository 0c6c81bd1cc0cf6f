import json
import random

from pyspark.sql import functions as F

from scorefold.operators import rules, screen
from scorefold.plans import raters
from scorefold.sources import documents, infer


def test_band_join_equals_a_range_join(spark):
    rng = random.Random(1)
    edges = [None, *[rng.choice((-3.5, 0.0, 1.0, 1.25, 2.0, 7.0, 1e6)) for _ in range(40)]]
    bands = [(rng.choice("ab"), rng.choice(edges), rng.choice(edges), rng.random() < 0.5, rng.random() < 0.5, f"n{k}") for k in range(60)]
    scores = [(k, rng.choice(("a", "b", "c", None)), rng.choice((None, -1e9, 1e9, -3.5, 0.0, 0.5, 1.0, 1.25, 1.9999, 2.0, 7.0, 1e6, rng.random() * 10))) for k in range(200)]
    kind = "g string, low double, high double, low_open boolean, high_open boolean, name string"
    df = spark.createDataFrame(scores, "k int, g string, s double")

    def holds(b, s):
        _, low, high, lo, ho, _ = b
        return (low is None or s > low or (s == low and not lo)) and (high is None or s < high or (s == high and not ho))

    for bins in (3, 256):
        got = sorted(((r.k, r.name) for r in rules.band_join(df, "s", spark.createDataFrame(bands, kind), ["g"], bins=bins, outer=False).collect()))
        assert got == sorted((k, b[5]) for k, g, s in scores for b in bands if s is not None and g == b[0] and holds(b, s))
    outer = rules.band_join(df, "s", spark.createDataFrame(bands, kind), ["g"]).where("name IS NULL").select("k").collect()
    assert {r.k for r in outer} == {k for k, g, s in scores if s is None or not any(g == b[0] and holds(b, s) for b in bands)}
    none = rules.band_join(df, "s", spark.createDataFrame([], kind), ["g"])
    assert none.count() == 200 and none.where("name IS NOT NULL").count() == 0
    open_only = rules.band_join(df, "s", spark.createDataFrame([(None, None, "all")], "low double, high double, name string"), outer=False)
    assert open_only.count() == sum(s is not None for _, _, s in scores)


def test_rubrics_cover_the_scores_of_all_raters(spark):
    rows = raters.rubrics(spark)
    assert rows.count() == 50 and {r.persona for r in rows.collect()} == set(raters.SLUGS)
    scores = spark.range(11).select(F.col("id").cast("double").alias("s")).crossJoin(rows.select("persona").distinct())
    found = rules.band_join(scores, "s", rows, ["persona"])
    assert found.count() == 110 and found.where("band IS NULL").count() == 0


def test_known_choice(spark):
    rows = [(["b", "a", "b", "x"],), (["x"],), ([],), (None,)]
    got = [r.k for r in spark.createDataFrame(rows, "c array<string>").select(screen.known_choice(F.col("c"), ["a", "b", "c"]).alias("k")).collect()]
    assert got == [["a", "b"], ["a", "b", "c"], ["a", "b", "c"], ["a", "b", "c"]]


def test_inferred_table(spark, tmp_path):
    docs = [{"a": 1, "b": {"c": "x", "d": [1, 2.5], "odd <name>": 1}, "m": {"2024": 1.5}}, {"a": 2, "b": None, "e": {}}, {"a": "text", "z": None, "m": {"2023": 2}}, [1], "t", None]
    frame = spark.createDataFrame([(k, None if x is None else json.dumps(x)) for k, x in enumerate(docs)], "k int, t string").select("k", F.try_parse_json("t").alias("doc"))
    schema = infer.document_schema(frame, types={"m": "map<string,double>", "new": "bigint"})
    assert {f.name: f.dataType.simpleString() for f in schema} == {"a": "variant", "b": "struct<c:string,d:array<double>,odd <name>:bigint>", "e": "variant", "m": "map<string,double>", "z": "variant", "new": "bigint"}
    table = infer.write_typed(frame, f"{tmp_path}/t", ["k"], types={"m": "map<string,double>"})
    rows = {r.k: r for r in table.select("k", "b.c", "m", F.try_variant_get("a", "$", "string").alias("a")).collect()}
    assert (rows[0].c, rows[0].m, rows[0].a, rows[2].a, rows[2].m) == ("x", {"2024": 1.5}, "1", "text", {"2023": 2.0}) and rows[3].a is None and len(rows) == 6
    plan = table.select("b.c")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:struct<c:string>>" in plan
    assert len(infer.document_schema(frame.limit(0))) == 0


def test_envelope_over_many_lines(spark, tmp_path):
    body = {"metadata": {"total_count": 2}, "stocks": [{"symbol": "A", "issue_price": 5.5}, {"symbol": "B", "issue_price": None}]}
    (tmp_path / "list.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "more.json").write_text(json.dumps({"metadata": None, "stocks": [{"symbol": "C"}]}, indent=2))
    rows = documents.read_envelope(spark, str(tmp_path)).collect()
    assert sorted((r.symbol, r.issue_price) for r in rows) == [("A", 5.5), ("B", None), ("C", None)]
