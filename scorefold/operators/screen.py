"""Selections, re-weighting, ordering and display of a ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.functions.expr import map_or_zero, number_or_null, truthy

#: Display columns of a ranking and the fields they show.
DISPLAY = {"symbol": "Symbol", "company_name": "Company", "composite_score": "Score", "consensus_recommendation": "Rec", "sector": "Sector", "current_price": "Price", "market_cap_cr": "Market cap", "pe_ratio": "P/E", "ipo_return_pct": "Return"}


def filter_year(df: DataFrame, date: str, year: int) -> DataFrame:
    """On typed dates a range, which reaches the scan; on text a prefix."""
    kind = dict(df.dtypes)[date]
    if kind == "string":
        return df.where(F.col(date).startswith(str(year)))
    return df.where((F.col(date) >= F.lit(f"{year}-01-01").cast(kind)) & (F.col(date) < F.lit(f"{year + 1}-01-01").cast(kind)))


def drop_unresolved(df: DataFrame, symbol: str = "yf_symbol", observation=None) -> DataFrame:
    """Rows with a symbol; an Observation gets the number of those without."""
    found = truthy(F.col(symbol), text=True)
    if observation is not None:
        df = df.observe(observation, F.count_if(~found).alias("skipped"))
    return df.where(found)


def by_key(df: DataFrame, **keys) -> DataFrame:
    for name, value in keys.items():
        df = df.where(F.col(name) == value)
    return df


def only_incomplete(df: DataFrame, stocks: DataFrame, key: str = "symbol", grades: Sequence[str] = ("minimal", "partial")) -> DataFrame:
    return df.join(stocks.where(F.col("data_quality").isin(*grades)).select(key), key, "left_semi")


def analyzable(df: DataFrame) -> DataFrame:
    """Full quality and not failed; a null status is not a failure."""
    return df.where(F.coalesce(F.col("fetch_status") != "error", F.lit(True)) & (F.col("data_quality") == "full"))


def screen(df: DataFrame, score: tuple[float, float], sectors: Sequence[str], recommendations: Sequence[str], qualities: Sequence[str], cap: tuple[float, float], composite: str = "composite_score") -> DataFrame:
    """An empty list of sectors or recommendations selects nothing, an empty list of qualities everything; a null cap is 0."""

    def one_of(name: str, values: Sequence[str]) -> Column:
        return F.col(name).isin(*values) if values else F.lit(False)

    test = F.col(composite).between(*score) & one_of("sector", sectors) & one_of("consensus_recommendation", recommendations)
    test = test & F.coalesce(F.col("market_cap_cr"), F.lit(0)).between(*cap)
    return df.where(test & F.col("data_quality").isin(*qualities) if qualities else test)


def restrict_raters(df: DataFrame, chosen: Sequence[str], every: Sequence[str], scores: str = "persona_scores", composite: str = "composite_score", most: int = 10) -> DataFrame:
    """The composite of the chosen raters only, and its largest possible value; none or all chosen changes nothing."""
    if not chosen or set(chosen) >= set(every):
        return df.withColumn("max_score", F.lit(most * len(every)))
    total = F.aggregate(F.map_values(F.map_filter(scores, lambda k, _: k.isin(*chosen))), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return df.withColumns({composite: total, "max_score": F.lit(most * len(set(chosen)))})


def known_choice(chosen: Column, every: Sequence[str]) -> Column:
    """The raters of an array column that are known, each once, in the order of `every`; none chosen, or none known, is all."""
    all_of = F.array(*map(F.lit, every))
    known = F.array_intersect(all_of, F.coalesce(chosen, F.array().cast("array<string>")))
    return F.when(F.size(known) > 0, known).otherwise(all_of)


def restrict_by_choice(df: DataFrame, chosen: str, every: Sequence[str], scores: str = "persona_scores", composite: str = "composite_score", most: int = 10) -> DataFrame:
    """restrict_raters with a choice in each row, an array of raters: the row's composite over its known choice, and its
    largest possible value."""
    rows = df.withColumn("_known", known_choice(F.col(chosen), every))
    total = F.aggregate(F.transform("_known", lambda k: F.coalesce(F.col(scores)[k].cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumns({composite: total, "max_score": most * F.size("_known")}).drop("_known")


def table_view(df: DataFrame, display: dict[str, str] = DISPLAY) -> DataFrame:
    """The display columns; those that are absent are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(name) for c, name in display.items()])


def finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number_or_null(F.col(c)) for c in columns})


def order_by_rater(df: DataFrame, rater: str, entity: str = "symbol", scores: str = "persona_scores") -> DataFrame:
    """By one rater's score, missing as 0, ties by entity."""
    return df.orderBy(map_or_zero(F.col(scores), rater).desc(), entity)


def top_bottom(df: DataFrame, top: int = 10, bottom: int = 5, by: str = "composite_score", entity: str = "symbol") -> DataFrame:
    """The first and last of a ranking with `side`; two bounded top-k's, no full sort."""
    best = df.orderBy(F.col(by).desc(), entity).limit(top).withColumn("side", F.lit("top"))
    return best.unionByName(df.orderBy(F.col(by), F.col(entity).desc()).limit(bottom).withColumn("side", F.lit("bottom")))


def limit_items(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n work items; 0 keeps all."""
    return df.orderBy(*order).limit(n) if n else df


def options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
