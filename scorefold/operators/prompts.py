"""Prompts from whole stock documents: every value with its own fallback, printed as it stands in the document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.functions import expr
from scorefold.operators import enrich, joins

#: The template's lines, and where the fields of the financial summary stand in a document's info.
HEADER = (
    "Company: {company_name}",
    "Symbol: {symbol} (listed on {exchange})",
    "Sector: {sector} | Industry: {industry}",
    "Listed: {listing_date} at INR {issue_price}",
    "Current Price: INR {current_price} | Market Cap: INR {market_cap_display}",
    "IPO Return: {ipo_return_pct}",
    "",
    "=== FINANCIAL DATA ===",
    "{financial_summary}",
    "",
    "=== INSTRUCTIONS ===",
    "{instructions}",
)
KEYS = {
    "pe": "trailingPE", "forward_pe": "forwardPE", "price_to_book": "priceToBook", "price_to_sales": "priceToSalesTrailing12Months", "enterprise_value": "enterpriseValue",
    "ev_to_ebitda": "enterpriseToEbitda", "ev_to_revenue": "enterpriseToRevenue", "roe": "returnOnEquity", "operating_margin": "operatingMargins", "net_margin": "profitMargins",
    "gross_margin": "grossMargins", "ebitda_margin": "ebitdaMargins", "revenue_growth": "revenueGrowth", "earnings_growth": "earningsGrowth", "debt_to_equity": "debtToEquity",
    "current_ratio": "currentRatio", "total_debt": "totalDebt", "total_cash": "totalCash", "fcf": "freeCashflow", "operating_cash_flow": "operatingCashflow", "total_revenue": "totalRevenue",
    "ebitda": "ebitda", "net_income": "netIncomeToCommon", "book_value": "bookValue", "promoter": "heldPercentInsiders", "institutions": "heldPercentInstitutions", "dividend_yield": "dividendYield",
}


def there(value: Column) -> Column:
    """Whether a VARIANT is present and not null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def fraction(value: Column) -> Column:
    """Whether a VARIANT is a number that was written with a decimal point or exponent; larger whole numbers than 64 bits hold
    count as such from 19 digits on only."""
    kind = F.schema_of_variant(value)
    return kind.isin("DOUBLE", "FLOAT") | kind.rlike(r"^DECIMAL\((1?\d),")


def printed(value: Column, absent: Column | str) -> Column:
    """A VARIANT as text: `absent` where the key is absent, None for null, numbers with the point they were written with."""
    text = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    shown = F.when(kind.rlike(r"^DECIMAL\(1?\d,0\)"), F.concat(text, F.lit(".0"))).when(kind == "BOOLEAN", F.initcap(text)).otherwise(F.coalesce(text, F.to_json(value)))
    return F.when(value.isNull(), F.lit(absent) if isinstance(absent, str) else absent).when(F.is_variant_null(value), "None").otherwise(shown)


def truthy(value: Column) -> Column:
    return there(value) & ~F.to_json(value).isin(*enrich.NOTHING_JSON) & ~F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False))


def amount(value: Column, shown: Column) -> Column:
    """shown for numbers; texts as they are, N/A for null and absent."""
    return F.when(~there(value) | value.isNull(), "N/A").when(is_text(value), F.try_variant_get(value, "$", "string")).otherwise(shown)


def line(value: Column, label: str, kind) -> Column:
    """One line of the summary; null where the value is absent or null. kind: one of the formats of enrich.SUMMARY."""
    number = F.try_variant_get(value, "$", "double")
    if kind in (enrich.money, enrich.percent):
        shown = amount(value, kind(number, "double"))
    else:
        whole = kind(F.try_variant_get(value, "$", "bigint"), "bigint")
        shown = F.when(is_text(value), F.try_variant_get(value, "$", "string")).when(fraction(value), kind(number, "double")).otherwise(whole)
    return F.when(there(value), F.concat(F.lit(f"  {label}: "), shown))


def summary(docs: DataFrame, doc: str, out: str = "financial_summary") -> DataFrame:
    """docs with the financial summary of a VARIANT document: the sections of enrich.SUMMARY that have a line, the statement
    lines of the last years in the document's order of periods, and the shortened description."""
    fields = [f for _, part in enrich.SUMMARY for f, _, _ in part]
    rows = docs.withColumn("_info", F.struct(*[F.try_variant_get(doc, f"$.info.{KEYS[f]}", "variant").alias(f) for f in fields]))
    sections = []
    for heading, part in enrich.SUMMARY:
        body = F.concat_ws("\n", *[line(F.col("_info")[f], label, kind) for f, label, kind in part])
        gap = "" if not sections else "\n"  # every section but the first begins with an empty line, also where none stands before it
        sections.append(F.when(body != "", F.concat(F.lit(f"{gap}{heading}:\n"), body)))
    facts = F.from_json(F.to_json(F.try_variant_get(doc, "$.financials", "variant")), "map<string,map<string,double>>")
    rows = rows.withColumn("_facts", facts)
    lines = []
    for metric in ("Total Revenue", "Net Income", "EBITDA"):
        # periods are keys of an object: VARIANT keeps them in name order, the newest is printed first
        known = F.filter(F.reverse(F.array_sort(F.map_entries(F.col("_facts")[metric]))), lambda e: e["value"].isNotNull())
        text = F.array_join(F.transform(known, lambda e: F.concat(F.substring(e["key"], 1, 10), F.lit(": "), expr.format_currency(e["value"]))), " | ")
        lines.append(F.when(F.size(known) > 0, F.concat(F.lit(f"  {metric}: "), text)))
    sections.append(F.when(F.size("_facts") > 0, F.concat_ws("\n", F.lit("\n" + enrich.STATEMENT_HEADING), *lines)))
    about = F.try_variant_get(doc, "$.info.longBusinessSummary", "string")
    sections.append(F.when(expr.truthy(about, text=True), F.concat(F.lit("\nBUSINESS: "), expr.truncate(about))))
    whole = F.concat_ws("\n", *sections)
    return rows.withColumn(out, F.when(whole != "", whole).otherwise(enrich.NOTHING)).drop("_info", "_facts")


def document_prompts(stocks: DataFrame, raters: DataFrame, instructions: str, symbol: str = "symbol", doc: str = "doc") -> DataFrame:
    """stocks x raters with prompt: HEADER filled from the documents.

    Company: info.longName, else the registry's name, else the symbol. Price: info.currentPrice if it is neither absent nor zero,
    else info.regularMarketPrice, else N/A. Exchange: NSE for a quotation ending in .NS, else BSE. Sector, industry and listing
    date are Unknown where the key is absent; issue price and return are N/A."""

    def get(path: str) -> Column:
        return F.try_variant_get(doc, f"$.{path}", "variant")

    rows = summary(stocks, doc, "_summary")
    price, name, back = get("info.currentPrice"), get("info.longName"), get("ipo_data.ipo_return_pct")
    cap = get("info.marketCap")
    filled = {
        "company_name": F.when(truthy(name), printed(name, "")).otherwise(printed(get("ipo_data.company_name"), F.col(symbol).cast("string"))),
        "symbol": F.col(symbol).cast("string"),
        "exchange": F.coalesce(expr.exchange(F.try_variant_get(doc, "$.yf_symbol", "string")), F.lit("BSE")),
        "sector": printed(get("info.sector"), "Unknown"),
        "industry": printed(get("info.industry"), "Unknown"),
        "listing_date": printed(get("ipo_data.listing_date"), "Unknown"),
        "issue_price": printed(get("ipo_data.issue_price"), "N/A"),
        "current_price": F.when(truthy(price), printed(price, "")).otherwise(printed(get("info.regularMarketPrice"), "N/A")),
        "market_cap_display": amount(cap, expr.format_currency(F.try_variant_get(cap, "$", "double"))),
        "ipo_return_pct": F.when(there(back), F.concat(printed(back, ""), F.lit("%"))).otherwise("N/A"),
        "financial_summary": F.col("_summary"),
        "instructions": F.lit(instructions),
    }
    rows = rows.withColumn("prompt", F.concat_ws("\n", *[fill(text, filled) for text in HEADER]))
    return joins.work_items(rows.drop("_summary"), raters)


def fill(text: str, filled: dict[str, Column]) -> Column:
    """text with its {names} replaced by columns."""
    parts: list[Column] = []
    for piece in text.split("{"):
        name, closed, rest = piece.partition("}")
        parts += [filled[name], F.lit(rest)] if closed else [F.lit(piece)]
    return F.concat(*parts)


def analysable(stocks: DataFrame, doc: str = "doc", qualities: Sequence[str] = ("full",)) -> DataFrame:
    """stocks whose document was fetched and has one of the qualities: the others get no prompt."""
    status, quality = F.try_variant_get(doc, "$.fetch_status", "string"), F.try_variant_get(doc, "$.data_quality", "string")
    return stocks.where((F.coalesce(status, F.lit("")) != "error") & F.coalesce(quality.isin(*qualities), F.lit(False)))
