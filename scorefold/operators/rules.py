"""Rule screens: named threshold rules over numeric columns, pass, fail or unknown each. Not a copy of any rater's scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.operators.rollup import place_all

D = F.try_divide


def c(name: str) -> Column:
    return F.col(name)


#: Fixed thresholds of each screen: rule name to predicate.
SCREENS: dict[str, dict] = {
    "deep_value": {
        "price_below_fair": lambda: c("price") < F.sqrt(F.when((c("eps") > 0) & (c("book_value") > 0), 22.5 * c("eps") * c("book_value"))),
        "low_pe": lambda: c("pe") < 15,
        "low_pb": lambda: D(c("price"), c("book_value")) < 1.5,
        "liquid": lambda: c("current_ratio") > 2,
        "low_debt": lambda: c("debt_to_equity") < 0.5,
        "pays": lambda: c("dividend_yield") > 0.02,
    },
    "growth_at_price": {
        "peg": lambda: D(c("pe"), c("earnings_growth") * 100) < 1.0,
        "pe_below_twice_growth": lambda: c("pe") < 2 * c("earnings_growth") * 100,
        "low_debt": lambda: c("debt_to_equity") < 0.6,
        "returns": lambda: c("roe") > 0.12,
    },
    "quality_value": {"returns": lambda: c("roe") > 0.15, "low_debt": lambda: c("debt_to_equity") < 0.5, "free_cash": lambda: c("fcf") > 0},
    "earnings_quality": {"returns": lambda: c("roic") > 0.15, "cash_backed": lambda: D(c("fcf"), c("net_income")) > 0.8, "low_debt": lambda: D(c("debt"), c("ebitda")) < 2.5},
    "growth_quality": {"sales": lambda: c("revenue_growth") >= 0.2, "earnings": lambda: c("earnings_growth") >= 0.2, "returns": lambda: c("roe") > 0.2, "low_debt": lambda: c("debt_to_equity") < 0.5},
    "risk_first": {"cash_yield": lambda: D(c("fcf"), c("market_cap")) > 0.06, "low_debt": lambda: D(c("debt"), c("ebitda")) < 3},
    "owner_growth": {"pe": lambda: c("pe").between(12, 25), "sales": lambda: c("revenue_growth") >= 0.12, "returns": lambda: c("roe") > 0.15, "low_debt": lambda: c("debt_to_equity") < 0.6, "owners": lambda: c("promoter") > 0.5},
    "conservative": {"pe": lambda: c("pe").between(12, 20), "returns": lambda: c("roe") > 0.15, "low_debt": lambda: c("debt_to_equity") < 0.3, "liquid": lambda: c("current_ratio") > 1.5, "cash_yield": lambda: D(c("fcf"), c("market_cap")) > 0.05, "owners": lambda: c("promoter") > 0.55},
    "small_cap": {"size": lambda: c("market_cap_cr").between(100, 1000), "pe": lambda: c("pe").between(8, 15), "sales": lambda: c("revenue_growth") >= 0.15, "low_debt": lambda: c("debt_to_equity") < 0.4, "owners": lambda: c("promoter") > 0.5},
}
#: Fixed rubric bands: name, lowest and highest score, general meaning.
BANDS = (("9-10", 9, 10, "exceptional"), ("7-8", 7, 8, "good"), ("4-6", 4, 6, "average"), ("2-3", 2, 3, "weak"), ("0-1", 0, 1, "poor"))


def apply_screen(df: DataFrame, name: str, columns: dict[str, str] | None = None) -> DataFrame:
    """One column per rule (`pass`, `fail`, `unknown`), `passed` and `known`; columns maps the rules' names to df's."""
    view = df.withColumns({k: F.col(v) for k, v in (columns or {}).items()})
    tests = {f"{name}_{rule}": make() for rule, make in SCREENS[name].items()}
    out = view.withColumns({k: F.when(t, "pass").when(~t, "fail").otherwise("unknown") for k, t in tests.items()})
    return out.withColumns({f"{name}_passed": sum((F.col(k) == "pass").cast("int") for k in tests), f"{name}_known": sum((F.col(k) != "unknown").cast("int") for k in tests)})


def magic_formula(df: DataFrame, entity: str, ebit: str, ev: str, capital: str, sector: str, excluded: tuple[str, ...] = ("Financial Services", "Utilities")) -> DataFrame:
    """Earnings yield and return on capital, each ranked; the sum of ranks orders the entities. Excluded sectors, EBIT of
    zero or less and undefined ratios drop out."""
    rows = df.where((F.col(ebit) > 0) & ~F.coalesce(F.col(sector).isin(*excluded), F.lit(False)))
    rows = rows.select(entity, F.round(D(F.col(ebit), F.col(ev)), 9).alias("earnings_yield"), F.round(D(F.col(ebit), F.col(capital)), 9).alias("return_on_capital")).dropna()
    ranked = place_all(rows, {"earnings_yield": "yield_rank", "return_on_capital": "capital_rank"})
    return ranked.withColumn("magic_rank", F.col("yield_rank") + F.col("capital_rank"))


def rubric_band(df: DataFrame, score: str, rater: str | None = None, bands: DataFrame | None = None) -> DataFrame:
    """df with band and meaning of each score; scores outside all bands have none.

    bands: a table of (band, low, high, meaning), the general one if left out; with `rater`, a rubric for each rater with a
    column of that name too. Scores are looked up one by one, so bands join on equality."""
    if bands is None:
        bands = df.sparkSession.createDataFrame(list(BANDS), "band string, low int, high int, meaning string")
    keys = [rater] if rater else []
    each = bands.select(*keys, "band", "meaning", F.explode(F.sequence(F.col("low").cast("bigint"), F.col("high").cast("bigint"))).alias("_score"))
    rows = df.withColumn("_score", F.when(F.col(score) == F.floor(score), F.col(score).cast("bigint")))
    return rows.join(each, [*keys, "_score"], "left").drop("_score").select(*df.columns, "band", "meaning")


def band_join(df: DataFrame, score: str, bands: DataFrame, keys: Sequence[str] = (), bins: int = 256, outer: bool = True) -> DataFrame:
    """df with the columns of the band that each score falls in, one row for each band that holds it.

    bands: (keys, low, high, and what else it has). Bounds belong to the band unless a column low_open or high_open says true; a
    null bound is open to that side. Scores may be fractions. outer: scores in no band, null ones too, stay with nulls.

    An interval join on bins: the range of all finite bounds is cut into `bins` equal parts, with one part below and one above;
    a band stands under each part that it touches, a score under one, and the exact bounds are tested within equal parts and
    keys. So the join is one of equality, dealt or broadcast as Spark finds best, and no score meets bands of other parts."""
    extra = [c for c in bands.columns if c not in (*keys, "low", "high", "low_open", "high_open")]
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(f"_{c}") if c in bands.columns else F.lit(False).alias(f"_{c}") for c in ("low_open", "high_open")]
    edges = bands.agg(F.least(F.min("low"), F.min("high")).cast("double").alias("_from"), F.greatest(F.max("low"), F.max("high")).cast("double").alias("_to"))  # one row

    def part(c: Column) -> Column:
        width = F.greatest((F.col("_to") - F.col("_from")) / bins, F.lit(1e-300))
        return F.greatest(F.lit(-1), F.least(F.lit(bins + 1), F.floor((c - F.col("_from")) / width))).cast("int")

    held = bands.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("low").cast("double").alias("_low"), F.col("high").cast("double").alias("_high"), *flags, *extra).join(F.broadcast(edges))
    first, last = F.when(F.col("_low").isNull(), -1).otherwise(part(F.col("_low"))), F.when(F.col("_high").isNull(), bins + 1).otherwise(part(F.col("_high")))
    held = held.where(F.coalesce(F.col("_low") <= F.col("_high"), F.lit(True))).withColumn("_part", F.explode(F.sequence(first, last))).drop("_from", "_to")
    rows = df.join(F.broadcast(edges)).withColumns({"_score": F.col(score).cast("double")}).withColumn("_own", F.when(F.col("_from").isNull(), F.lit(-1)).otherwise(part(F.col("_score")))).drop("_from", "_to")
    low = F.col("_low").isNull() | (F.col("_score") > F.col("_low")) | (~F.col("_low_open") & (F.col("_score") == F.col("_low")))
    high = F.col("_high").isNull() | (F.col("_score") < F.col("_high")) | (~F.col("_high_open") & (F.col("_score") == F.col("_high")))
    test = (F.col("_own") == F.col("_part")) & F.col("_score").isNotNull() & low & high
    for k in keys:
        test = test & (F.col(k) == F.col(f"_key_{k}"))
    return rows.join(held, test, "left" if outer else "inner").select(*df.columns, *extra)
