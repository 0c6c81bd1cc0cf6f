import datetime

import pytest
from pyspark.sql import functions as F

from scorefold.functions import expr, parse


def values(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("v"))).collect()]


def test_prices_and_numbers(spark):
    assert values(spark, parse.parse_price, ["₹146", "₹1,352.50", "", None, " ₹7 ", "1_000", "nan", "1d", "1e3", "-.5"]) == [146, 1352.5, None, None, 7, None, None, None, 1000, -0.5]
    assert values(spark, parse.parse_mcap, ["2,195", "91,000", "₹5"]) == [2195, 91000, None]
    assert values(spark, parse.parse_number, ["1,35,942", "30.7", "-2", "-", "—", "", "12%", "inf"]) == [135942, 30.7, -2, None, None, None, 12, None]
    assert values(spark, parse.parse_pct_change, ["⇡ 49%", "⇣ 16%", "+11%", "10-20", "DOWN 3%", ""]) == [49, -16, 11, None, -3, None]


def test_dates(spark):
    assert values(spark, parse.parse_listing_date, ["02 Apr 2026", "2 apr 2026", " soon ", None, "31 Feb 2026"]) == ["2026-04-02", "2026-04-02", "soon", None, "31 Feb 2026"]


def test_identifiers(spark):
    got = values(spark, parse.extract_identifier, ["/company/SWIGGY/", "/company/NTPCGREEN/consolidated/", "/company/544291/", "/company/id/1285148/", None, "/x/company/A/", "/company/"])
    assert [tuple(r) for r in got] == [("SWIGGY", "symbol"), ("NTPCGREEN", "symbol"), ("544291", "bse_code"), ("1285148", "screener_id"), (None, "unknown"), (None, "unknown"), (None, "unknown")]
    ids = values(spark, parse.page_ids, ["NSE: ÀB BSE - SME: 544", "BSE:12", "none", None])
    assert [tuple(r) for r in ids] == [("ÀB", "544"), (None, "12"), (None, None), (None, None)]


def test_normalise(spark):
    assert values(spark, parse.normalise_text, ["  Ab c\t\n", "", None]) == ["ab c", "", None]


@pytest.mark.parametrize("places", [0, 1, 2])
def test_exact_round(spark, places):
    xs = [k / 8 for k in range(-80, 80)] + [2.675, 0.25, 0.35, 1.005, 1e6 + 0.5, -2.5, 1234567.125]
    assert values(spark, lambda c: expr.exact_round(c, places), xs, "double") == [round(x, places) for x in xs]


def test_fallbacks(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (None, 0.0), (3.0, 5.0)], "a double, b double")
    assert [r[0] for r in rows.select(expr.or_else(F.col("a"), F.col("b"))).collect()] == [5.0, 0.0, 3.0]
    text = spark.createDataFrame([("", "x"), (None, ""), ("y", "x")], "a string, b string")
    assert [r[0] for r in text.select(expr.or_else(F.col("a"), F.col("b"), text=True)).collect()] == ["x", "", "y"]
    pe = spark.createDataFrame([(0.0, 10.0, 4.0), (None, 10.0, 3.0), (None, 0.0, 3.0), (None, 10.0, -1.0)], "t double, p double, e double")
    assert [r[0] for r in pe.select(expr.pe_ratio(F.col("t"), F.col("p"), F.col("e"))).collect()] == [0.0, 3.33, None, None]
    ret = spark.createDataFrame([(150.0, 100.0, 1.0), (0.0, 100.0, 2.0), (1.0, None, None)], "p double, i double, l double")
    assert [r[0] for r in ret.select(expr.issue_return_pct(F.col("p"), F.col("i"), F.col("l"))).collect()] == [50.0, 2.0, None]


def test_formats(spark):
    assert values(spark, expr.format_currency, [1234567890.0, 23456789.0, 250000.0, 999.0, None, -5e9], "double") == ["123 Cr", "2.3 Cr", "2.5 L", "999", "N/A", "-5,000,000,000"]
    assert values(spark, expr.format_pct, [0.152, None, 12.3456], "double") == ["15.2%", "N/A", "1234.6%"]
    assert values(spark, expr.format_market_cap, [123456.0, 45678.0, 1234.0, float("nan"), None], "double") == ["1.23L Cr", "45.7K Cr", "1,234 Cr", "N/A", "N/A"]
    assert values(spark, expr.format_return, [1.25, -2.0, None, float("inf")], "double") == ["+1.2%", "-2.0%", "N/A", "N/A"]
    assert values(spark, lambda c: expr.truncate(c, 10), ["a" * 11, "b" * 10, None]) == ["a" * 7 + "...", "b" * 10, None]


def test_grades(spark):
    assert values(spark, expr.score_band, [9, 7, 4, 3], "int") == ["green", "green", "yellow", "red"]
    rows = spark.createDataFrame([(3, "BUY"), (4, "BUY"), (8, "AVOID"), (9, "HOLD"), (1, "HOLD"), (2, "HOLD"), (None, "BUY"), (3, None)], "s int, r string")
    assert [r[0] for r in rows.select(expr.extreme_mismatch(F.col("s"), F.col("r"))).collect()] == [True, False, True, True, True, False, False, False]
    grade = spark.createDataFrame([("full", False), ("none", True), ("partial", True), (None, False)], "q string, f boolean")
    f = F.col("f")
    assert [r[0] for r in grade.select(expr.quality_upgrade(F.col("q"), f, f, f)).collect()] == ["full", "full", "full", "minimal"]


def test_variants(spark):
    docs = ['{"a": {"s": 4.0}}', '{"a": {"s": 4.5}}', '{"a": {"s": "4"}}', '{"a": {"s": 11}}', '{"a": {"s": null}}', "{}", '{"a": {"s": true}}', "broken"]
    assert values(spark, lambda c: expr.integral_score(F.try_parse_json(c), "$.a.s"), docs) == [True, False, False, False, None, None, False, None]
    assert values(spark, lambda c: expr.get_or_unknown(F.try_parse_json(c), "$.x"), ['{"x": "v"}', '{"x": null}', "{}"]) == ["v", None, "Unknown"]
    assert values(spark, lambda c: expr.missing_keys(c, ["a", "b"]), ['{"a": null}', "{}", "broken"]) == [["b"], ["a", "b"], ["a", "b"]]


def test_typed_year(spark):
    from scorefold.operators import screen

    rows = spark.createDataFrame([(datetime.date(2025, 12, 31), "2025-12-31"), (datetime.date(2026, 1, 1), "2026-01-01"), (None, None)], "d date, t string")
    assert screen.filter_year(rows, "d", 2026).count() == screen.filter_year(rows, "t", 2026).count() == 1
