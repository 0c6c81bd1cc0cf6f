"""The rater dimension and its groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The raters' keys, names and origin.
RATERS = (
    ("warren_buffett", "Warren Buffett", "international"),
    ("charlie_munger", "Charlie Munger", "international"),
    ("benjamin_graham", "Benjamin Graham", "international"),
    ("peter_lynch", "Peter Lynch", "international"),
    ("philip_fisher", "Philip Fisher", "international"),
    ("joel_greenblatt", "Joel Greenblatt", "international"),
    ("howard_marks", "Howard Marks", "international"),
    ("rakesh_jhunjhunwala", "Rakesh Jhunjhunwala", "indian"),
    ("radhakishan_damani", "Radhakishan Damani", "indian"),
    ("vijay_kedia", "Vijay Kedia", "indian"),
)
SLUGS = tuple(r[0] for r in RATERS)

#: What each rater means by a band of scores, from the highest band down.
BANDS = ("9-10", "7-8", "4-6", "2-3", "0-1")
RUBRICS = {
    "warren_buffett": (
        "Exceptional moat, great management, undervalued — extremely rare for IPOs",
        "Good business at reasonable price — would consider buying",
        "Average business or fair price — would not buy",
        "Mediocre or overvalued — avoid",
        "Terrible business or extreme overvaluation — strong avoid",
    ),
    "charlie_munger": (
        "Compounding machine with durable ROIC — extremely rare",
        "Quality business worth monitoring",
        "Mediocre returns or uncertain advantages",
        "Poor quality or overvalued",
        "Fails basic quality tests",
    ),
    "benjamin_graham": (
        "Deep value below liquidation value — almost impossible for IPOs",
        "Reasonable value with margin of safety",
        "Fair price but insufficient safety margin",
        "Overvalued — speculative",
        "Extreme overvaluation or financial weakness",
    ),
    "peter_lynch": (
        "Fast grower, PEG <0.8, huge addressable market",
        "Good growth story at reasonable price",
        "Moderate growth or stretched valuation",
        "Slow growth or overvalued",
        "No growth story or extreme overvaluation",
    ),
    "philip_fisher": (
        "Exceptional growth with innovation moat — very rare",
        "Strong grower with good management",
        "Average growth or uncertain management",
        "Limited growth potential",
        "Declining or poorly managed",
    ),
    "joel_greenblatt": (
        "Top-decile earnings yield AND ROIC — extremely rare",
        "Strong on one metric, decent on other",
        "Average on both",
        "Weak on one or both",
        "Cannot compute or extremely poor",
    ),
    "howard_marks": (
        "Clear mispricing, contrarian opportunity — rare",
        "Favorable risk/reward",
        "Fair value — balanced risk/reward",
        "Too much optimism priced in",
        "Extreme overvaluation or unacceptable risk",
    ),
    "rakesh_jhunjhunwala": (
        "India growth champion — dominant, expanding sector, great promoter",
        "Good India story with solid fundamentals",
        "Average business or uncertain thesis",
        "Poor fundamentals or governance concerns",
        "Red flags or sector headwinds",
    ),
    "radhakishan_damani": (
        "Steady compounder, fortress balance sheet, great promoter",
        "Quality business with conservative financials",
        "Decent but debt/margin/consistency concerns",
        "Volatile, leveraged, or governance issues",
        "Fails basic quality or integrity tests",
    ),
    "vijay_kedia": (
        "Perfect SMILE multibagger candidate — rare",
        "Strong small-cap with good growth potential",
        "Interesting but missing SMILE elements",
        "Too expensive, too large, or weak",
        "No transformation story or red flags",
    ),
}


def raters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATERS), "slug string, display_name string, nationality string")


def rubrics(spark: SparkSession) -> DataFrame:
    """(persona, band, low, high, meaning): a band of each rater a row, as `rules.band_join` takes them."""
    rows = [(slug, band, *map(float, band.split("-")), text) for slug, texts in RUBRICS.items() for band, text in zip(BANDS, texts, strict=True)]
    return spark.createDataFrame(rows, "persona string, band string, low double, high double, meaning string")
