"""Queries against their SQL on small tables whose keys are those of large ones."""

import datetime
import re

import duckdb
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorefold import queries
from scorefold.sources import html, infer
from scorefold.streaming import stateful


def same_rows(spark, name, folder, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    want = sorted(repr(r) for r in rel.fetchall())
    got = sorted(repr(tuple(r)) for r in queries.queries()[name](spark, folder).select(*[x[0] for x in rel.description]).collect())
    assert got == want
    return got


def test_theses_shared_by_parts_far_apart(spark, tmp_path):
    day = datetime.datetime(1996, 1, 2)
    raters = [(f, s) for f in "ANR" for s in "FO"]
    rows = [(part, part, 1, 1, float(3 + part % 7 + k), 10.0, f, s, day) for part in (7, 5007, 10007, 31, 5031) for k, (f, s) in enumerate(raters)]
    columns = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = same_rows(spark, "audit_issues", str(tmp_path), "lineitem")
    assert "('thesis number 7 by af', 'duplicate_theses')" in got
    assert sum("duplicate_theses" in r for r in got) == 6


def test_open_keys_of_a_typed_field_are_not_merged(spark, monkeypatch):
    parsed, split = [], re.split
    monkeypatch.setattr(infer.re, "split", lambda pattern, text: parsed.append(len(text)) or split(pattern, text))
    k = F.col("id").cast("string")
    docs = spark.range(2000).select(F.parse_json(F.concat(F.lit('{"info": {"a": 1.5}, "facts": {"'), k, F.lit('": '), k, F.lit("}}"))).alias("doc"))
    schema = infer.document_schema(docs, types={"facts": "map<string,bigint>"})
    assert schema.simpleString() == "struct<facts:map<string,bigint>,info:struct<a:double>>"
    assert max(parsed) < 100  # the types that were merged do not grow with the documents


def test_pages_of_one_file_are_parsed_by_several_tasks(spark):
    pages = spark.range(200).coalesce(1).select("id", F.concat(F.lit("<a href='/p'>"), F.col("id").cast("string"), F.lit("</a>")).alias("html"))
    items = html.page_items(pages, ["id"]).select("id", "text", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.id, r.text) for r in items) == [(k, str(k)) for k in range(200)]
    assert len({r.task for r in items}) == 4


class Kept:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema, ttl=None):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_state_is_called_as_often_for_many_rows_as_for_one(spark):
    kinds = StructType.fromDDL("symbol long, persona string, at long, score long")
    state, each = Kept(), stateful.Composite("symbol", "score", "at", kinds, None)
    each.init(state)
    rows = [(1, "ab"[k % 2], k, k % 7) for k in range(1000)]
    assert [(r.composite_score, r.coverage) for r in each.handleInputRows((1,), iter(rows), None)] == [(998 % 7 + 999 % 7, 2)]
    assert state.calls == 2
    assert list(each.handleInputRows((1,), iter([(1, "a", 5, 9), (1, "b", None, 9)]), None)) == []
    assert [(r.composite_score, r.coverage) for r in each.handleInputRows((1,), iter([(1, None, 5, 9), (1, "a", 2000, None)]), None)] == [(999 % 7 + 9, 2)]
