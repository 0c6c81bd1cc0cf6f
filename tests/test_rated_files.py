import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from scorefold.operators import enrich, prompts
from scorefold.sources import documents, rated_files


@pytest.fixture
def folder(tmp_path):
    for symbol in ("ACE", "543920", "Ünïcode & co"):
        (tmp_path / symbol).mkdir()
        for persona in ("a", "b"):
            (tmp_path / symbol / f"{persona}.json").write_text(json.dumps({"analysis": {"score": len(symbol)}}))
    (tmp_path / "ACE" / "c.json").write_bytes(b'{"x": "\xff\xfe"}')
    (tmp_path / "ACE" / "d.json").write_text("{")
    (tmp_path / "ACE" / "notes.txt").write_text("x")
    (tmp_path / "stray.json").write_text("{}")
    return tmp_path


def test_rows_and_errors(spark, folder):
    rows = {(r.symbol, r.persona): r for r in rated_files.read_rated(spark, str(folder)).collect()}
    assert set(rows) == {(s, p) for s in ("ACE", "543920", "Ünïcode & co") for p in "ab"} | {("ACE", "c"), ("ACE", "d")}
    assert (rows["ACE", "c"].error, rows["ACE", "c"].text, rows["ACE", "d"].error, rows["ACE", "a"].error) == ("not valid UTF-8", None, "not valid JSON", None)
    plain = {(r.symbol, r.persona): (r.text, r.error) for r in documents.read_ratings(spark, str(folder / "ACE")).collect()}
    assert plain == {k: (r.text, r.error) for k, r in rows.items() if k[0] == "ACE"}


def test_filters_open_no_other_folder(spark, folder):
    os.symlink("/nonexistent", folder / "543920" / "gone.json")  # opening it would fail
    rows = rated_files.read_rated(spark, str(folder))
    one = rows.where("symbol = 'ACE' AND persona IN ('a', 'c', 'zz') AND length(path) > 0")
    assert [r.persona for r in one.orderBy("persona").collect()] == ["a", "c"]
    plan = one._jdf.queryExecution().explainString(one._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(symbol,ACE)" in plan and "In(persona" in plan
    assert rows.where("symbol = 'none'").collect() == [] and rows.where("symbol = 'ACE' AND symbol = '543920'").collect() == []
    reader = rated_files.Folder({"path": str(folder)})
    rest = GreaterThan(("path",), "a")
    assert list(reader.take([EqualTo(("symbol",), "ACE"), In(("symbol",), ("ACE", "x")), rest])) == [rest]
    assert {x.path.split("/")[-2] for x in reader.listed()} == {"ACE"} and len(reader.listed()) == 4


def test_tasks_hold_files_by_size(folder):
    reader = rated_files.Folder({"path": f"file://{folder}", "bytesPerTask": 140_000})
    files = reader.listed()
    tasks = reader.dealt(files)
    assert [p for t in tasks for p, _ in t.files] == [x.path for x in files] and len(tasks) == 3


def test_stream_brings_new_and_changed_files(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        rows = rated_files.stream_rated(spark, str(folder), settle=0.0).select("symbol", "persona", F.try_variant_get("doc", "$.analysis.score", "int").alias("score"))
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.symbol, r.persona, r.score) for r in spark.read.parquet(out).collect() if r.score is not None)

    first = run()
    assert len(first) == 6
    (folder / "ACE" / "a.json").write_text('{"analysis": {"score": 9}}')
    (folder / "NEW").mkdir()
    (folder / "NEW" / "a.json").write_text('{"analysis": {"score": 1}}')
    assert run() == sorted([*first, ("ACE", "a", 9), ("NEW", "a", 1)])
    assert len(run()) == 8


def test_prompt_fallbacks(spark):
    docs = [
        ("A", {"info": {"longName": "A Ltd", "currentPrice": 12.5, "regularMarketPrice": 1, "marketCap": "big", "sector": None, "trailingPE": 15.0, "forwardPE": 15}, "ipo_data": {"issue_price": 146.0}, "yf_symbol": "A.NS", "financials": {"EBITDA": {"2024": None}}}),
        ("B", {"info": {}, "ipo_data": {"company_name": None}}),
        ("C", {}),
    ]
    frame = spark.createDataFrame([(s, json.dumps(x)) for s, x in docs], "symbol string, text string").select("symbol", F.try_parse_json("text").alias("doc"))
    got = {r.symbol: r.prompt.split("\n") for r in prompts.document_prompts(frame, spark.createDataFrame([("p",)], "persona string"), "Go.").collect()}
    assert got["A"] == ["Company: A Ltd", "Symbol: A (listed on NSE)", "Sector: None | Industry: Unknown", "Listed: Unknown at INR 146.0", "Current Price: INR 12.5 | Market Cap: INR big", "IPO Return: N/A", "", "=== FINANCIAL DATA ===", "VALUATION:", "  P/E (TTM): 15.00", "  P/E (Forward): 15", "", "INCOME STATEMENT (available years):", "", "=== INSTRUCTIONS ===", "Go."]
    assert got["B"][0] == "Company: None" and got["C"][:5] == ["Company: C", "Symbol: C (listed on BSE)", "Sector: Unknown | Industry: Unknown", "Listed: Unknown at INR N/A", "Current Price: INR N/A | Market Cap: INR N/A"]
    assert got["C"][8].startswith("LIMITED DATA")


def test_statement_lines_leave_nulls_out(spark):
    rows = [("S", "EBITDA", "2024-03-31", 2.5e5), ("S", "EBITDA", "2023-03-31", None), ("T", "EBITDA", "2023", None)]
    got = enrich.statement_lines(spark.createDataFrame(rows, "symbol string, metric string, period string, value double"), ["symbol"]).collect()
    assert [(r.symbol, r.lines) for r in got] == [("S", ["  EBITDA: 2024-03-31: 2.5 L"])]


def test_records_come_back_as_files(spark, tmp_path):
    raw = [("S", "p", '{"structured_output": {"score": 4}, "is_error": "", "usage": {"input_tokens": 7}, "duration_ms": 5}', 0), ("T", "p", '{"is_error": 1, "result": null}', 0), ("U", "p", "[1]", 0), ("V", "p", None, 0), ("W", "p", "x", 3)]
    frame = spark.createDataFrame(raw, "symbol string, persona string, response string, code int")
    taken, rest = enrich.ingest_envelopes(frame, ["symbol", "persona"], "m", exit_code="code")
    assert {r.symbol: r.reason for r in rest.collect()} == {"T": "error: None", "U": "unparseable", "V": "empty output", "W": "exit code 3: "}
    files = enrich.rating_documents(taken.withColumn("shown", F.lit("P")), "symbol", "persona", "shown", F.lit("2024-01-01"))
    documents.write_documents(files, f"file://{tmp_path}", "name", "text").collect()
    typed = documents.typed_ratings(documents.read_ratings(spark, str(tmp_path))).first()
    assert (typed.symbol, typed.score, typed.metadata.usage.input_tokens, typed.metadata.duration_ms, typed.metadata.model_used) == ("S", 4, 7, 5, "m")
