"""Many raters' scores to one score per entity, and what describes raters and entities.

A ratings table is long: one row per (entity, rater) with score and recommendation. Column names are arguments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorefold.operators import quantiles
from scorefold.sources import stage

RECOMMENDATIONS = ("BUY", "HOLD", "AVOID")
BRACKETS = (("70-100", 70), ("50-69", 50), ("30-49", 30), ("10-29", 10), ("0-9", None))


def latest_rating(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the largest by the order columns. A partial aggregate, not a window: no sort, no hot partition."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def consensus(composite: Column, buy: float = 60, hold: float = 40) -> Column:
    return F.when(composite >= buy, "BUY").when(composite >= hold, "HOLD").otherwise("AVOID")


def composite_scores(ratings: DataFrame, entity: str, score: str = "score", buy: float = 60, hold: float = 40) -> DataFrame:
    """(entity, composite_score, coverage, consensus_recommendation); entities without any score are dropped."""
    out = ratings.groupBy(entity).agg(F.sum(score).alias("composite_score"), F.count(score).alias("coverage")).where("coverage > 0")
    return out.withColumn("consensus_recommendation", consensus(F.col("composite_score"), buy, hold))


def place(df: DataFrame, by: str, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with `out`: its place by descending value; equal values share one, unless ties gives an order among them.

    No task holds the whole order and no value meets in one task: rows are range-partitioned by value and ties (without ties
    by a hash of the row), written once, and numbered within their partition; what lies before a partition is a prefix sum
    over one row each. Equal values then share the least of their numbers. Null values come last."""
    order = [F.col(by).desc_nulls_last(), *(F.col(t) for t in ties)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = order if ties else [*order, F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]).asc()]
    rows = df.repartitionByRange(n, *spread).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = stage.written(rows.withColumns({"_part": F.shiftright(at, 33), "_in": at.bitwiseAND(F.lit((1 << 33) - 1)) + 1}), "placed")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    above = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"))
    numbered = rows.join(F.broadcast(above), "_part").withColumn(out, (F.col("_above") + F.col("_in")).cast("long"))
    if ties:
        return numbered.select(*[c for c in df.columns if c != out], out)
    first = numbered.groupBy(F.col(by).alias("_by")).agg(F.min(out).alias("_first"))
    shared = numbered.drop(out).join(first, F.col(by).eqNullSafe(F.col("_by")))
    return shared.select(*[c for c in df.columns if c != out], F.col("_first").alias(out))


def place_all(df: DataFrame, outs: dict[str, str], ranges: int = 200) -> DataFrame:
    """df with the place of each row by several columns, {column: out}: descending, equal values share a place, nulls come last.

    df is written once. All columns are ranked together: their values are counted by column and value, so that a frequent
    value is one row; the counts are dealt by column and range of values, summed before each range and within it; the places
    come back by value, and a row's places by its number. No task holds an order of all rows, and none a frequent value.
    Values are compared as doubles."""
    if not outs:
        return df
    rows = stage.written(df.withColumn("_row", F.monotonically_increasing_id()), "ranked-rows")
    cells = rows.select("_row", F.inline(F.array(*[F.struct(F.lit(k).alias("_column"), F.col(c).cast("double").alias("_value")) for k, c in enumerate(outs)])))
    counts = stage.written(cells.groupBy("_column", "_value").agg(F.count("*").alias("_n")), "value-counts")
    # bounds of about equal numbers of distinct values: at most `ranges` for a column
    bounds = counts.groupBy("_column").agg(F.percentile_approx("_value", F.array(*[F.lit(k / ranges) for k in range(ranges + 1)]), F.lit(10 * ranges)).alias("_bounds"))
    dealt = counts.join(F.broadcast(bounds), "_column")
    dealt = dealt.withColumn("_range", F.when(F.col("_value").isNull(), -1).otherwise(F.size(F.filter("_bounds", lambda b: b < F.col("_value"))))).drop("_bounds")
    dealt = stage.written(dealt, "value-ranges")
    sizes = dealt.groupBy("_column", "_range").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("_column").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = sizes.select("_column", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"))
    within = Window.partitionBy("_column", "_range").orderBy(F.col("_value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(above), ["_column", "_range"])
    placed = placed.select(F.col("_column").alias("_c"), F.col("_value").alias("_v"), (F.col("_above") + F.coalesce(F.sum("_n").over(within), F.lit(0)) + 1).alias("_place"))
    both = cells.join(placed, (F.col("_column") == F.col("_c")) & F.col("_value").eqNullSafe(F.col("_v")))
    places = both.groupBy("_row").agg(*[F.max(F.when(F.col("_column") == k, F.col("_place"))).cast("long").alias(out) for k, out in enumerate(outs.values())])
    return rows.drop(*outs.values()).join(places, "_row").select(*[c for c in df.columns if c not in outs.values()], *outs.values())


def rank_scores(scores: DataFrame, by: str = "composite_score", entity: str = "symbol") -> DataFrame:
    """rank by descending score, ties by entity."""
    return place(scores, by, "rank", [entity])


def persona_scores(ratings: DataFrame, entity: str, rater: str, score: str = "score") -> DataFrame:
    """(entity, persona_scores): map of each rater's score in rater order."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(rater), F.col(score))))
    return ratings.where(F.col(score).isNotNull()).groupBy(entity).agg(F.map_from_entries(entries).alias("persona_scores"))


def recommendation_counts(ratings: DataFrame, entity: str, recommendation: str = "recommendation") -> DataFrame:
    """(entity, recommendation_counts): a map; recommendations count even where the score is null."""
    rec = F.col(recommendation)
    n = ratings.where(rec.isNotNull() & (rec != "")).groupBy(entity, rec.alias("rec")).agg(F.count("*").alias("n"))
    return n.groupBy(entity).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rec", "n")))).alias("recommendation_counts"))


def entity_rollup(ratings: DataFrame, entity: str, rater: str, score: str = "score", recommendation: str = "recommendation", buy: float = 60, hold: float = 40) -> DataFrame:
    """composite_scores with persona_scores and recommendation_counts, from one aggregation of ratings that have each rater of an
    entity once; an entity's few ratings meet in its row. Without any recommendation the counts are null."""
    rec = F.col(recommendation)
    out = ratings.groupBy(entity).agg(
        F.sum(score).alias("composite_score"), F.count(score).alias("coverage"),
        F.collect_list(F.when(F.col(score).isNotNull(), F.struct(F.col(rater), F.col(score)))).alias("_scores"), F.sort_array(F.collect_list(F.when(rec != "", rec))).alias("_recs"),
    ).where("coverage > 0")
    counts = F.transform(F.array_distinct("_recs"), lambda r: F.struct(r, F.size(F.filter("_recs", lambda x: x == r)).cast("bigint")))
    return out.select(
        entity, "composite_score", "coverage", consensus(F.col("composite_score"), buy, hold).alias("consensus_recommendation"),
        F.map_from_entries(F.sort_array("_scores")).alias("persona_scores"), F.when(F.size("_recs") > 0, F.map_from_entries(counts)).alias("recommendation_counts"),
    )


def majority_vote(ratings: DataFrame, entity: str, recommendation: str = "recommendation", order: Sequence[str] = RECOMMENDATIONS) -> DataFrame:
    """(entity, majority, votes): the most frequent recommendation; ties by the given order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("rec"))
    n = ratings.where(F.col(recommendation).isin(*order)).groupBy(entity, F.col(recommendation).alias("rec")).agg(F.count("*").alias("n"))
    return n.groupBy(entity).agg(F.max_by("rec", F.struct(F.col("n"), -place)).alias("majority"), F.max("n").alias("votes"))


def with_median(stats: DataFrame, rows: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """stats, one row per group of rows, with the exact median of a value; groups without one have null."""
    found = quantiles.quantiles(rows, by, value).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("q0").alias(out))
    test = F.lit(True)
    for c in by:
        test = test & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return stats.join(found, test, "left").drop(*[f"_by_{c}" for c in by])


def rater_stats(ratings: DataFrame, rater: str, score: str = "score", places: int = 2) -> DataFrame:
    """(rater, mean, median, stdev, min, max, n); the median by distributed selection, whatever the number of scores."""
    s = F.col(score)
    rows = stage.written(ratings.where(s.isNotNull()).select(rater, score), "rater-scores")
    stats = rows.groupBy(rater).agg(F.round(F.avg(s), places).alias("mean"), F.coalesce(F.round(F.stddev_samp(s), places), F.lit(0.0)).alias("stdev"), F.min(s).alias("min"), F.max(s).alias("max"), F.count(s).alias("n"))
    return with_median(stats, rows, [rater], score, "median").select(rater, "mean", "median", "stdev", "min", "max", "n")


def score_distribution(ratings: DataFrame, rater: str, score: str = "score") -> DataFrame:
    return ratings.where(F.col(score).isNotNull()).groupBy(rater, score).agg(F.count("*").alias("n"))


def uniform_raters(ratings: DataFrame, rater: str, score: str = "score", threshold: float = 80.0) -> DataFrame:
    """Raters with one distinct score, or whose modal score (the smallest on ties) has over threshold percent."""
    n = score_distribution(ratings, rater, score)
    modal = n.groupBy(rater).agg(F.max_by(score, F.struct(F.col("n"), -F.col(score))).alias("modal_score"), F.max("n").alias("modal_n"), F.sum("n").alias("n"), F.count("*").alias("distinct_scores"))
    share = F.col("modal_n") * 100.0 / F.col("n")
    return modal.withColumn("modal_pct", share).where((F.col("distinct_scores") == 1) | (share > threshold))


def recommendation_crosstab(ratings: DataFrame, rater: str, recommendation: str = "recommendation") -> DataFrame:
    counts = [F.count_if(F.col(recommendation) == r).alias(r.lower()) for r in RECOMMENDATIONS]
    return ratings.groupBy(rater).agg(*counts).withColumn("total", F.col("buy") + F.col("hold") + F.col("avoid"))


def score_brackets(scores: DataFrame, composite: str = "composite_score") -> DataFrame:
    """(bracket, n); all brackets are there."""
    c, label = F.col(composite), None
    for name, least in BRACKETS:
        label = F.when(c >= least, name) if label is None else label.otherwise(name) if least is None else label.when(c >= least, name)
    counts = scores.groupBy(label.alias("bracket")).agg(F.count("*").alias("n"))
    names = scores.sparkSession.createDataFrame([(b,) for b, _ in BRACKETS], "bracket string")
    return names.join(counts, "bracket", "left").select("bracket", F.coalesce("n", F.lit(0)).alias("n"))


def headline(scores: DataFrame, composite: str = "composite_score", recommendation: str = "consensus_recommendation") -> DataFrame:
    counts = [F.count_if(F.col(recommendation) == r).alias(r.lower()) for r in RECOMMENDATIONS]
    return scores.agg(F.count("*").alias("entities"), F.avg(composite).alias("mean_composite"), *counts)


def group_average(scores: DataFrame, by: str, composite: str = "composite_score", least: int = 3) -> DataFrame:
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.avg(composite).alias("mean_composite")).where(F.col("n") >= least)


def composite_summary(scores: DataFrame, composite: str = "composite_score") -> DataFrame:
    """One row: mean, exact median (by distributed selection), sample deviation, extremes."""
    c = F.col(composite)
    rows = stage.written(scores.select(composite), "composite-scores")
    stats = rows.agg(F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("stdev"), F.min(c).alias("min"), F.max(c).alias("max"))
    return with_median(stats, rows, [], composite, "median").select("mean", "median", "stdev", "min", "max")


def rater_group_totals(ratings: DataFrame, groups: dict[str, Sequence[str]], entity: str, rater: str, score: str = "score") -> DataFrame:
    """One sub-sum column per group of raters."""
    return ratings.groupBy(entity).agg(*[F.coalesce(F.sum(F.when(F.col(rater).isin(*members), F.col(score))), F.lit(0)).alias(name) for name, members in groups.items()])


def disagreement(ratings: DataFrame, entity: str, score: str = "score") -> DataFrame:
    s = F.col(score)
    return ratings.where(s.isNotNull()).groupBy(entity).agg(F.count(s).alias("n"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("stdev"), (F.max(s) - F.min(s)).alias("spread"))


def buy_convergence(ratings: DataFrame, rater: str, recommendation: str = "recommendation") -> DataFrame:
    return ratings.where(F.col(recommendation) == "BUY").groupBy(rater).agg(F.count("*").alias("buys"))


def duplicate_members(df: DataFrame, text: Column, entity: str, least: int = 20, snippet: int = 100) -> DataFrame:
    """Normalised texts of more than `least` characters that several entities share, one row per text and entity: (text_key,
    n_entities, entity, snippet). No text's entities are gathered anywhere.

    Rows are grouped by a hash first, so only texts whose hash repeats are shuffled whole and confirmed."""
    from scorefold.functions.parse import normalise_text

    rows = df.select(F.col(entity).alias("_entity"), normalise_text(text).alias("_text")).where(F.length("_text") > least)
    shared = rows.groupBy(F.xxhash64("_text").alias("_hash")).agg((F.min("_entity") < F.max("_entity")).alias("_several")).where("_several").select("_hash")
    once = rows.withColumn("_hash", F.xxhash64("_text")).join(shared, "_hash", "left_semi").select("_entity", F.sha2("_text", 256).alias("text_key"), F.substring("_text", 1, snippet).alias("snippet"))
    once = once.groupBy("text_key", "_entity").agg(F.min("snippet").alias("snippet"))
    sizes = once.groupBy("text_key").agg(F.count("*").alias("n_entities")).where("n_entities > 1")
    return once.join(sizes, "text_key").select("text_key", "n_entities", F.col("_entity").alias("entity"), "snippet")


def duplicate_text(df: DataFrame, text: Column, entity: str, least: int = 20, snippet: int = 100) -> DataFrame:
    """duplicate_members with the entities of a text in one row, sorted: for texts that few entities share."""
    found = duplicate_members(df, text, entity, least, snippet).groupBy("text_key").agg(F.first("n_entities").alias("n_entities"), F.sort_array(F.collect_list("entity")).alias("entities"), F.first("snippet").alias("snippet"))
    return found.select("n_entities", "entities", "snippet")


def trailing(df: DataFrame, key: str, order: Sequence[Column]) -> Column:
    """Position of a row from the end of its key."""
    return F.row_number().over(Window.partitionBy(key).orderBy(*order))


def price_summary(prices: DataFrame, key: str, date: str, close: str, volume: str, tie: Sequence[str] = (), year: int = 252, month: int = 30) -> DataFrame:
    """First and last date and close, days, extremes of the last `year` closes and mean volume of the last `month` rows.

    The whole history goes through one aggregation; only the last `year` rows of a key per task are shuffled for the rest, as
    the rank filter below the window becomes Spark's group limit."""
    order = F.struct(date, *tie)
    whole = prices.groupBy(key).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("total_days"), F.min_by(close, order).alias("first_close"), F.max_by(close, order).alias("last_close")
    )
    last = prices.withColumn("_n", trailing(prices, key, [F.col(date).desc(), *[F.col(t).desc() for t in tie]])).where(F.col("_n") <= year)
    recent = last.groupBy(key).agg(F.max(close).alias("high_52w"), F.min(close).alias("low_52w"), F.avg(F.when(F.col("_n") <= month, F.col(volume))).alias("avg_volume_30d"))
    return whole.join(recent, key)


def listing_coverage(listing: DataFrame) -> DataFrame:
    return listing.agg(
        F.count("*").alias("total"), F.count_if(F.col("nse_symbol").isNotNull()).alias("nse"),
        F.count_if(F.col("nse_symbol").isNull() & F.col("yf_symbol").isNotNull()).alias("bse_only"), F.count_if(F.col("current_price").isNotNull()).alias("with_price"),
    )


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def usage_rollup(df: DataFrame, by: Sequence[str], cost: str, duration: str, tokens: Sequence[str] = ()) -> DataFrame:
    """Calls, cost, duration (mean and exact median) and the sums of any token columns (fields of a struct by their path)."""
    sums = [F.sum(t).alias(f"total_{t.rsplit('.', 1)[-1]}") for t in tokens]
    stats = df.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(cost).alias("total_cost"), F.avg(cost).alias("mean_cost"), F.avg(duration).alias("mean_duration"), *sums)
    rows = df.select(*by, F.col(duration).alias("_duration"))
    return with_median(stats, rows, by, "_duration", "median_duration")


def page_years(listing: DataFrame, page: str, date: str) -> DataFrame:
    """(page, years, last_year): the years of a page's rows; dates that do not start with a year do not count."""
    year = F.substring(F.col(date), 1, 4).try_cast("int")
    return listing.groupBy(page).agg(F.sort_array(F.collect_set(year)).alias("years"), F.max(year).alias("last_year"))


def progress(done: DataFrame, target: DataFrame) -> DataFrame:
    """(done, target, pct) as one row."""
    counts = done.agg(F.count("*").alias("done")).crossJoin(target.agg(F.count("*").alias("target")))
    return counts.withColumn("pct", F.coalesce(F.try_divide(F.col("done") * 100.0, F.col("target")), F.lit(0.0)))


def examples(df: DataFrame, category: str, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first n rows of each category, and how many more there are. Only n rows per task and category are shuffled:
    the rank filter below a window becomes Spark's group limit."""
    w = Window.partitionBy(category)
    first = df.withColumn("position", F.row_number().over(w.orderBy(*order))).where(F.col("position") <= n)
    counts = df.groupBy(category).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return first.join(counts, category)
