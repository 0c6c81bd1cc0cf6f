"""Graded data-quality audit of a ratings table. Each check yields issue rows (key, category, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.functions import expr, parse
from scorefold.operators import joins, rollup

#: Allowed metric values, required fields, categories with their severity in report order.
METRICS = {
    "moat_strength": ("strong", "moderate", "weak", "none", "insufficient_data"),
    "management_quality": ("excellent", "good", "adequate", "poor", "insufficient_data"),
    "financial_health": ("excellent", "good", "adequate", "poor", "insufficient_data"),
    "valuation": ("undervalued", "fair", "overvalued", "extremely_overvalued", "insufficient_data"),
    "growth_potential": ("exceptional", "good", "moderate", "low", "insufficient_data"),
}
REQUIRED = ("score", "recommendation", "investment_thesis", "key_strengths", "key_risks", "red_flags", "detailed_analysis", "metrics_evaluated")
CATEGORIES = (
    ("missing_fields", "critical"), ("score_out_of_range", "critical"), ("invalid_recommendation", "critical"),
    ("invalid_metric_values", "moderate"), ("empty_arrays", "moderate"), ("empty_strings", "moderate"), ("score_recommendation_mismatch", "moderate"),
    ("duplicate_theses", "minor"), ("rater_gap", "minor"), ("uniform_scores", "minor"),
    ("missing_rater_files", "critical"), ("parse_errors", "critical"),
)


def issue(df: DataFrame, test: Column, category: str, key: Column, detail: Column) -> DataFrame:
    return df.where(F.coalesce(test, F.lit(False))).select(key.cast("string").alias("key"), F.lit(category).alias("category"), detail.cast("string").alias("detail"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_issues(ratings: DataFrame, key: Column, allowed: Sequence[str] = rollup.RECOMMENDATIONS, low: int = 0, high: int = 10, short: int = 20, thesis: str | None = None) -> DataFrame:
    """Checks of single rows of a typed table (score, recommendation and, if given, a text): one scan, all at once.

    Every row's findings are collected in an array that is exploded, instead of one pass per check."""
    score, rec = F.col("score").cast("double"), F.col("recommendation")
    in_range = (score == F.floor(score)) & score.between(low, high)
    finds = [
        ("score_out_of_range", score.isNotNull() & ~in_range, F.col("score").cast("string")),
        ("invalid_recommendation", rec.isNotNull() & ~rec.isin(*allowed), rec),
        ("score_recommendation_mismatch", in_range & rec.isin(*allowed) & expr.extreme_mismatch(score, rec), F.concat_ws("/", F.col("score").cast("string"), rec)),
    ]
    if thesis:
        finds.append(("empty_strings", F.length(parse.strip(F.col(thesis))) < short, F.lit(thesis)))
    found = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(c).alias("category"), d.cast("string").alias("detail"))) for c, t, d in finds]), lambda x: x.isNotNull())
    return ratings.select(key.cast("string").alias("key"), F.explode(found).alias("f")).select("key", "f.category", "f.detail")


def with_findings(rows: DataFrame, analysis: Column, out: str = "findings") -> DataFrame:
    """rows with an array of (category, detail) of one rater's analysis, a VARIANT; presence and types are judged on the values.

    Every field is taken out of the VARIANT once, into a struct, and its type read once; the tests look at those. Absent fields
    are one finding together; a field that is there as null is not absent and passes the tests of its value. What is no object
    has no fields: one finding."""
    kind = F.schema_of_variant(analysis)
    rows = rows.withColumn("_fields", F.struct(*[F.try_variant_get(analysis, f"$.{f}", "variant").alias(f) for f in REQUIRED]))
    rows = rows.withColumn("_kinds", F.struct(*[F.schema_of_variant(F.col("_fields")[f]).alias(f) for f in REQUIRED], kind.alias("_whole")))
    metrics = F.col("_fields")["metrics_evaluated"]
    rows = rows.withColumn("_metrics", F.struct(*[F.try_variant_get(metrics, f"$.{m}", "variant").alias(m) for m in METRICS]))

    def has(name: str) -> Column:
        return (F.col("_kinds")[name] != "VOID") & F.col("_kinds")[name].isNotNull()

    def value(name: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col("_fields")[name], "$", kind)

    is_object = F.col("_kinds")["_whole"].startswith("OBJECT")
    missing = F.array_compact(F.array(*[F.when(F.col("_kinds")[f].isNull(), f) for f in REQUIRED]))
    integral = expr.integral_score(F.col("_fields")["score"], "$")
    score = F.when(integral, value("score", "double"))
    rec = F.when(F.col("_kinds")["recommendation"] == "STRING", value("recommendation"))
    finds: list[tuple[str, Column, Column]] = [
        ("missing_fields", ~is_object, F.lit("analysis is not an object")),
        ("missing_fields", is_object & (F.size(missing) > 0), F.array_join(missing, ",")),
        ("score_out_of_range", ~integral, value("score")),
        ("invalid_recommendation", has("recommendation") & ~F.coalesce(rec.isin(*rollup.RECOMMENDATIONS), F.lit(False)), F.to_json(F.col("_fields")["recommendation"])),
        ("score_recommendation_mismatch", score.isNotNull() & rec.isin(*rollup.RECOMMENDATIONS) & expr.extreme_mismatch(score, rec), F.concat_ws("/", value("score"), rec)),
    ]
    metrics_object = F.col("_kinds")["metrics_evaluated"].startswith("OBJECT")
    finds.append(("invalid_metric_values", has("metrics_evaluated") & ~metrics_object, F.lit("metrics_evaluated is not an object")))
    for name, allowed in METRICS.items():
        found = F.col("_metrics")[name]
        none = found.isNull() | F.is_variant_null(found)
        known = F.coalesce((F.schema_of_variant(found) == "STRING") & F.try_variant_get(found, "$", "string").isin(*allowed), F.lit(False))
        finds.append(("missing_fields", metrics_object & none, F.lit(f"metrics_evaluated.{name}")))
        finds.append(("invalid_metric_values", metrics_object & ~none & ~known, F.concat_ws("=", F.lit(name), F.to_json(found))))
    extra = F.when(metrics_object, expr.unexpected_keys(F.to_json(metrics), list(METRICS)))
    finds.append(("invalid_metric_values", F.size(extra) > 0, F.array_join(extra, ",")))
    finds += [("empty_arrays", F.col("_kinds")[f].startswith("ARRAY") & (F.to_json(F.col("_fields")[f]) == "[]"), F.lit(f)) for f in ("key_strengths", "key_risks")]
    for f in ("investment_thesis", "detailed_analysis"):
        short = F.when(F.col("_kinds")[f] == "STRING", F.length(parse.strip(value(f))) < 20).otherwise(has(f))
        finds.append(("empty_strings", short, F.lit(f)))
    whole = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(c).alias("category"), d.cast("string").alias("detail"))) for c, t, d in finds])
    return rows.withColumn(out, F.array_compact(whole)).drop("_fields", "_kinds", "_metrics")


def document_issues(files: DataFrame) -> DataFrame:
    """Checks of raw rater files (symbol, persona, doc, error): (key, category, detail), in one pass over the files."""
    files = files.withColumn("_analysis", F.try_variant_get("doc", "$.analysis", "variant"))
    rows = with_findings(files, F.col("_analysis"), "_found")
    none = F.col("_analysis").isNull() | F.is_variant_null("_analysis")
    one = F.when(F.col("parse_error"), F.struct(F.lit("parse_errors").alias("category"), F.col("error").alias("detail")))
    one = one.when(none, F.struct(F.lit("missing_fields").alias("category"), F.lit("analysis").alias("detail")))
    found = F.when(F.col("parse_error") | none, F.array(one)).otherwise(F.col("_found"))
    return rows.select(F.concat_ws("/", "symbol", "persona").alias("key"), F.explode(found).alias("f")).select("key", "f.category", "f.detail")


def table_issues(ratings: DataFrame, entity: str, rater: str, raters: Sequence[str], pair: tuple[str, str], gap: float = 3, threshold: float = 80.0) -> DataFrame:
    """Checks that look across rows: raters that an entity lacks, one rater far above another, uniform raters."""
    lacks = joins.missing_combinations(ratings, raters, entity, rater)
    wide = joins.compare_raters(ratings, *pair, gap, entity, rater)
    uniform = rollup.uniform_raters(ratings, rater, threshold=threshold)
    return union(
        [
            issue(lacks, F.lit(True), "missing_rater_files", F.col(entity), F.array_join("missing", ",")),
            issue(wide, F.col("wide_gap"), "rater_gap", F.col(entity), F.concat_ws(">", F.col("score_a").cast("string"), F.col("score_b").cast("string"))),
            issue(uniform, F.lit(True), "uniform_scores", F.col(rater), F.col("modal_score")),
        ]
    )


def duplicate_issues(df: DataFrame, text: Column, entity: str) -> DataFrame:
    """One issue per shared text; its detail names the number of entities and the least of them."""
    found = rollup.duplicate_members(df, text, entity).groupBy("text_key").agg(F.first("snippet").alias("snippet"), F.first("n_entities").alias("n"), F.min("entity").alias("least"))
    return issue(found, F.lit(True), "duplicate_theses", F.col("snippet"), F.concat_ws(" from ", F.col("n").cast("string"), F.col("least").cast("string")))


def audit_summary(issues: DataFrame) -> DataFrame:
    """(category, severity, n): every category, those without issues as 0."""
    names = issues.sparkSession.createDataFrame(list(CATEGORIES), "category string, severity string")
    counts = issues.groupBy("category").agg(F.count("*").alias("n"))
    return names.join(counts, "category", "left").select("category", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def audit_grade(issues: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, issues by severity, rates in percent of files, grade."""
    level = F.create_map(*[F.lit(x) for pair in CATEGORIES for x in pair])[F.col("category")]
    counts = issues.agg(F.count("*").alias("total"), *[F.count_if(level == s).alias(s) for s in ("critical", "moderate", "minor")])
    row = counts.crossJoin(files.agg(F.count("*").alias("files")))  # one row by one row
    per = F.greatest(F.col("files"), F.lit(1))
    row = row.withColumns({"issue_rate": F.col("total") * 100.0 / per, "critical_rate": F.col("critical") * 100.0 / per})
    c, i = F.col("critical_rate"), F.col("issue_rate")
    steps = (("A+", (c == 0) & (F.col("moderate") == 0)), ("A", (c == 0) & (i < 2)), ("B+", (c < 1) & (i < 5)), ("B", (c < 2) & (i < 10)), ("C", c < 5), ("D", c < 10))
    grade = F.lit("F")
    for name, test in reversed(steps):
        grade = F.when(test, name).otherwise(grade)
    return row.withColumn("grade", grade)
