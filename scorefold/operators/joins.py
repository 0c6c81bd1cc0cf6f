"""Lookups, enrichment, expected combinations and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.functions import parse


def lookup_first(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left rows with the first match of each; never more rows than left. Spark picks broadcast or shuffle by size."""
    rest = [c for c in right.columns if c not in keys]
    first = right.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    return left.join(first, list(keys), "left")


def left_enrich(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def work_items(entities: DataFrame, raters: DataFrame) -> DataFrame:
    """Every entity with every rater; the raters are a dimension table of a known few rows."""
    return entities.crossJoin(F.broadcast(raters))


def missing_combinations(found: DataFrame, raters: Sequence[str], entity: str, rater: str) -> DataFrame:
    """(entity, missing): expected raters that an entity lacks, sorted; one aggregation, no Cartesian product."""
    have = found.groupBy(entity).agg(F.collect_set(F.when(F.col(rater).isin(*raters), F.col(rater))).alias("_have"))
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, raters)), "_have"))
    return have.select(entity, lacking.alias("missing")).where(F.size("missing") > 0)


def compare_raters(ratings: DataFrame, a: str, b: str, gap: float, entity: str, rater: str, score: str = "score") -> DataFrame:
    """Entities that both have scored: (entity, score_a, score_b, a_higher, wide_gap), in one aggregation."""
    one = ratings.groupBy(entity).agg(*[F.max(F.when(F.col(rater) == r, F.col(score))).alias(n) for r, n in ((a, "score_a"), (b, "score_b"))])
    both = one.where("score_a IS NOT NULL AND score_b IS NOT NULL")
    return both.withColumns({"a_higher": F.col("score_a") > F.col("score_b"), "wide_gap": F.col("score_a") - F.col("score_b") >= gap})


def resolve_ids(listing: DataFrame, page_ids: DataFrame, key: str) -> DataFrame:
    """Rows whose identifier is not a symbol take the exchange symbol found on their page, else its numeric code."""
    joined = listing.join(page_ids.select(key, "nse", "bse"), key, "left")
    open_ = F.col("id_type") != "symbol"
    named = open_ & F.col("nse").isNotNull()
    coded = open_ & F.col("bse").isNotNull()
    return joined.withColumns(
        {
            "identifier": F.when(named, F.col("nse")).when(coded, F.col("bse")).otherwise(F.col("identifier")),
            "id_type": F.when(named, "symbol").when(coded, "bse_code").otherwise(F.col("id_type")),
        }
    ).drop("nse", "bse")


def with_final_symbols(listing: DataFrame, bse: Column | None = None) -> DataFrame:
    found = parse.final_symbols(F.col("identifier"), F.col("id_type"), F.lit(None).cast("string") if bse is None else bse)
    return listing.withColumn("_s", found).select("*", "_s.symbol", "_s.nse_symbol", "_s.yf_symbol").drop("_s")


def known_raters(ratings: DataFrame, raters: Sequence[str], rater: str) -> DataFrame:
    return ratings.where(F.col(rater).isin(*raters))


def union_pages(*pages: DataFrame) -> DataFrame:
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out
