"""Merging a second source into documents, score records, and prompts for raters with their answers taken in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.functions import expr, parse
from scorefold.operators import audit, rollup
from scorefold.sources import stage


@dataclass(frozen=True)
class Fill:
    """target is filled from the other source's text where it is falsy; keep: what does not parse leaves the old value;
    overwrite: whenever the other text is there, even if it does not parse."""

    target: str
    source: str
    factor: float = 1.0
    keep: bool = False
    overwrite: bool = False
    text: bool = False


#: Fixed rules of the second source.
FILLS = (
    Fill("current_price", "Current Price"),
    Fill("trailing_pe", "Stock P/E"),
    Fill("return_on_equity", "ROE", 0.01, keep=True),
    Fill("book_value", "Book Value"),
    Fill("market_cap", "Market Cap", expr.CRORE, keep=True),
    Fill("dividend_yield", "Dividend Yield", 0.01, keep=True),
    Fill("roce", "ROCE", overwrite=True),
)


def filled(base: Column, other: Column, rule: Fill) -> Column:
    there = expr.truthy(other, text=True)
    if rule.text:
        return F.when(~expr.truthy(base, text=True) & there, other).otherwise(base)
    number = parse.parse_number(other)
    value = number / (1 / rule.factor) if rule.factor < 1 else number * rule.factor
    if rule.overwrite:
        return F.when(there, value).otherwise(base)
    return F.when(~expr.truthy(base) & there & (number.isNotNull() if rule.keep else F.lit(True)), value).otherwise(base)


def fill_gaps(base: DataFrame, other: DataFrame, keys: Sequence[str], rules: Sequence[Fill] = FILLS, ratios: str = "ratios") -> DataFrame:
    """base with its gaps filled from the map of texts in other; rows without a match stay."""
    joined = base.join(other.select(*keys, F.col(ratios).alias("_ratios")), list(keys), "left")
    return joined.withColumns({r.target: filled(F.col(r.target) if r.target in base.columns else F.lit(None).cast("double"), F.col("_ratios")[r.source], r) for r in rules}).drop("_ratios")


def score_record(ratings: DataFrame, stocks: DataFrame, listing: DataFrame, buy: float = 60, hold: float = 40, raters: int = 10) -> DataFrame:
    """One wide row per rated symbol: roll-up, then the document's and the registry's fields through their fallbacks."""
    from scorefold.operators import joins

    scores = rollup.entity_rollup(ratings, "symbol", "persona", buy=buy, hold=hold)
    rows = joins.lookup_first(scores, listing.select("symbol", *[F.col(c).alias(f"l_{c}") for c in listing.columns if c != "symbol"]), ["symbol"], ["l_listing_date"])
    rows = joins.left_enrich(rows, stocks, ["symbol"])
    price = expr.or_else(F.col("current_price"), F.col("regular_price"), F.col("previous_close"), F.col("l_current_price"))
    issue = expr.or_else(F.col("issue_price"), F.col("l_issue_price"))
    return rows.select(
        "symbol", expr.or_else(F.col("company_name"), F.col("l_company_name"), F.col("symbol").cast("string"), text=True).alias("company_name"), "sector", "industry",
        expr.or_else(F.col("listing_date"), F.col("l_listing_date"), text=True).alias("listing_date"), price.alias("current_price"), "market_cap",
        expr.market_cap_cr(F.col("market_cap"), F.col("l_ipo_mcap_cr")).alias("market_cap_cr"), expr.pe_ratio(F.col("trailing_pe"), price, F.col("eps")).alias("pe_ratio"),
        "roe", "debt_to_equity", "revenue_growth", issue.alias("issue_price"), expr.issue_return_pct(price, issue, F.col("l_ipo_return_pct")).alias("ipo_return_pct"),
        "composite_score", "persona_scores", "consensus_recommendation", "recommendation_counts", F.col("coverage").alias("analysis_coverage"), F.lit(raters).alias("total_personas"), "data_quality",
    )


def number(places: int, mark: str = ""):
    """Fractional columns with that many decimals, whole-number columns as they are."""
    return lambda c, kind: F.concat(F.lit(mark), c.cast("string") if kind in ("tinyint", "smallint", "int", "bigint") else expr.plain_number(c, places))


def decimals(places: int, mark: str = ""):
    return lambda c, kind: F.concat(F.lit(mark), expr.plain_number(c.cast("double"), places))


def percent(c: Column, kind: str) -> Column:
    return expr.format_pct(c)


def money(c: Column, kind: str) -> Column:
    return expr.format_currency(c)


#: Headings of the financial summary, then field, label and format of each line, in this order.
SUMMARY = (
    ("VALUATION", (("pe", "P/E (TTM)", number(2)), ("forward_pe", "P/E (Forward)", number(2)), ("price_to_book", "Price/Book", number(2)), ("price_to_sales", "Price/Sales", number(2)), ("enterprise_value", "Enterprise Value", money), ("ev_to_ebitda", "EV/EBITDA", number(2)), ("ev_to_revenue", "EV/Revenue", number(2)))),
    ("PROFITABILITY", (("roe", "ROE", percent), ("operating_margin", "Operating Margin", percent), ("net_margin", "Net Margin", percent), ("gross_margin", "Gross Margin", percent), ("ebitda_margin", "EBITDA Margin", percent))),
    ("GROWTH", (("revenue_growth", "Revenue Growth (YoY)", percent), ("earnings_growth", "Earnings Growth (YoY)", percent))),
    ("BALANCE SHEET & CASH FLOW", (("debt_to_equity", "Debt/Equity", decimals(1)), ("current_ratio", "Current Ratio", decimals(2)), ("total_debt", "Total Debt", money), ("total_cash", "Total Cash", money), ("fcf", "Free Cash Flow", money), ("operating_cash_flow", "Operating Cash Flow", money), ("total_revenue", "Total Revenue", money), ("ebitda", "EBITDA", money), ("net_income", "Net Income", money), ("book_value", "Book Value/Share", decimals(2, "INR ")))),
    ("SHAREHOLDING", (("promoter", "Insider Holding", percent), ("institutions", "Institutional Holding", percent), ("dividend_yield", "Dividend Yield", percent))),
)


#: Heading of the statement lines, and the text where nothing is known.
STATEMENT_HEADING = "INCOME STATEMENT (available years):"
NOTHING = "LIMITED DATA AVAILABLE — This is a recent IPO with minimal public financial history."


def financial_summary(df: DataFrame, about: str | None = None, facts: str | None = None) -> Column:
    """Lines of the fields of df that are there, each section only if it has a line; then the statement lines (an array of
    text) and the shortened description."""
    sections, columns = [], dict(df.dtypes)
    for heading, fields in SUMMARY:
        lines = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"  {label}: "), shown(F.col(f), columns[f]))) for f, label, shown in fields if f in columns]
        if lines:
            body = F.concat_ws("\n", *lines)
            sections.append(F.when(body != "", F.concat(F.lit(f"{heading}:\n"), body)))
    if facts:
        sections.append(F.when(F.size(facts) > 0, F.concat(F.lit(STATEMENT_HEADING + "\n"), F.array_join(facts, "\n"))))
    if about:
        sections.append(F.when(expr.truthy(F.col(about), text=True), F.concat(F.lit("BUSINESS: "), expr.truncate(F.col(about)))))
    whole = F.concat_ws("\n\n", *sections)
    return F.when(whole != "", whole).otherwise(NOTHING)


def statement_lines(facts: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("Total Revenue", "Net Income", "EBITDA")) -> DataFrame:
    """(keys, lines): "metric: period: value | period: value" of the named metrics, newest period first; periods without a value are left out."""
    rows = facts.where(F.col("metric").isin(*metrics) & F.col("value").isNotNull()).groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("period", "value")), asc=False).alias("v"))
    text = F.array_join(F.transform("v", lambda x: F.concat(F.substring(x["period"], 1, 10), F.lit(": "), expr.format_currency(x["value"]))), " | ")
    place = F.array_position(F.array(*map(F.lit, metrics)), F.col("metric"))
    lines = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.concat(F.lit("  "), "metric", F.lit(": "), text).alias("t")))).alias("l"))
    return lines.select(*keys, F.transform("l", lambda x: x["t"]).alias("lines"))


def prompt_set(items: DataFrame, header: Sequence[tuple[str, str]], summary: Column, instructions: str) -> DataFrame:
    """items with `prompt`: header lines (label, column), the summary and the instructions."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(column).cast("string"), F.lit("N/A"))) for label, column in header]
    return items.withColumn("prompt", F.concat_ws("\n", *lines, F.lit(""), summary, F.lit(""), F.lit(instructions)))


def ingest_responses(raw: DataFrame, keys: Sequence[str], response: str = "response", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ratings, quarantine): answers that parse, with an integral score from 0 to 10 and a known recommendation, are taken.

    whole: an answer must also hold every required field, allowed metric values, non-empty lists and texts of some length, and
    its score may not contradict its recommendation; the quarantine's reason is the first finding. Answers are judged once and
    written with their reasons; both parts read that table."""
    doc = F.col("_doc")
    rows = raw.select(*keys, response).withColumn("_doc", F.try_parse_json(response))
    rows = audit.with_findings(rows, doc, "_found") if whole else rows
    score, rec = F.try_variant_get(doc, "$.score", "double"), F.try_variant_get(doc, "$.recommendation", "string")
    integral = F.coalesce(expr.integral_score(doc, "$.score"), F.lit(False))
    reason = F.when(doc.isNull(), "unparseable").when(~integral, "score").when(~F.coalesce(rec.isin(*rollup.RECOMMENDATIONS), F.lit(False)), "recommendation")
    if whole:
        reason = F.coalesce(reason, F.get("_found", 0)["category"])
    judged = stage.written(rows.select(*keys, response, score.alias("_score"), rec.alias("_rec"), reason.alias("_reason")), "judged-answers")
    taken = judged.where("_reason IS NULL").select(*keys, F.col("_score").cast("int").alias("score"), F.col("_rec").alias("recommendation"), response)
    return taken, judged.where("_reason IS NOT NULL").select(*keys, F.col("_reason").alias("reason"), response)


#: JSON texts that count as nothing.
NOTHING_JSON = ("null", "false", "0", '""', "[]", "{}")


def ingest_envelopes(raw: DataFrame, keys: Sequence[str], model: str, response: str = "response", exit_code: str | None = None, stderr: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of answers inside an envelope {is_error, result, structured_output, duration_ms, total_cost_usd, usage}.

    A record has keys, analysis (VARIANT) and metadata (duration_ms, model_used, total_cost_usd and usage, a VARIANT that is {}
    where the envelope has none). Refused with a reason, the first of: an exit code other than 0 (with the start of stderr), an
    empty output, one that is no JSON object, an error flag (with its result), no structured output."""
    doc = F.col("_doc")
    rows = raw.withColumn("_doc", F.try_parse_json(response))
    flag = F.to_json(F.try_variant_get(doc, "$.is_error", "variant"))
    output = F.try_variant_get(doc, "$.structured_output", "variant")
    result = F.try_variant_get(doc, "$.result", "variant")
    said = F.when(result.isNull(), "unknown").when(F.is_variant_null(result), "None").otherwise(F.coalesce(F.try_variant_get(doc, "$.result", "string"), F.to_json(result)))
    reason = F.when(F.coalesce(parse.strip(F.col(response)), F.lit("")) == "", "empty output")
    if exit_code:
        said_last = F.substring(F.coalesce(F.col(stderr), F.lit("")), 1, 200) if stderr else F.lit("")
        reason = F.when(F.col(exit_code) != 0, F.concat(F.lit("exit code "), F.col(exit_code).cast("string"), F.lit(": "), said_last)).when(F.coalesce(parse.strip(F.col(response)), F.lit("")) == "", "empty output")
    reason = reason.when(doc.isNull() | ~F.schema_of_variant(doc).startswith("OBJECT"), "unparseable")
    reason = reason.when(flag.isNotNull() & ~flag.isin(*NOTHING_JSON), F.concat(F.lit("error: "), said))
    reason = reason.when(output.isNull() | F.to_json(output).isin(*NOTHING_JSON), "no structured output")
    metadata = F.struct(
        F.try_variant_get(doc, "$.duration_ms", "bigint").alias("duration_ms"), F.lit(model).alias("model_used"), F.try_variant_get(doc, "$.total_cost_usd", "double").alias("total_cost_usd"),
        F.coalesce(F.try_variant_get(doc, "$.usage", "variant"), F.parse_json(F.lit("{}"))).alias("usage"),
    )
    judged = stage.written(rows.select(*keys, response, output.alias("analysis"), metadata.alias("metadata"), reason.alias("_reason")), "judged-envelopes")
    return judged.where("_reason IS NULL").select(*keys, "analysis", "metadata"), judged.where("_reason IS NOT NULL").select(*keys, F.col("_reason").alias("reason"), response)


def rating_documents(records: DataFrame, symbol: str, persona: str, display_name: str, analyzed_at: Column) -> DataFrame:
    """(name, text): records of ingest_envelopes as the files {symbol}/{persona}.json that `documents.write_documents` writes."""
    body = F.struct(F.col(symbol).alias("symbol"), F.col(persona).alias("persona"), F.col(display_name).alias("persona_display_name"), analyzed_at.cast("string").alias("analyzed_at"), "analysis", "metadata")
    return records.select(F.concat(F.col(symbol), F.lit("/"), F.col(persona), F.lit(".json")).alias("name"), F.to_json(body).alias("text"))


def list_rows(df: DataFrame, keys: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """(keys, list, position, text) of array columns such as strengths, risks and flags; an empty or null one has one row
    without position."""
    parts = [df.select(*keys, F.lit(name).alias("list"), F.posexplode_outer(name).alias("position", "text")) for name in lists]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metric_rows(df: DataFrame, keys: Sequence[str], metrics: str) -> DataFrame:
    """(keys, metric, value): one row per field of a struct column."""
    names = df.select(f"{metrics}.*").columns
    return df.select(*keys, f"{metrics}.*").unpivot(list(keys), names, "metric", "value")
