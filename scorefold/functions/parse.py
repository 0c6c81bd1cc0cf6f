"""Parsers of messy text: Column in, Column out; what does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number; nan, inf, 1_000 and 1d do not.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def to_number(c: Column) -> Column:
    """The text as a double, null if it is not a plain decimal number."""
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_price(c: Column) -> Column:
    return to_number(F.translate(c, "₹,", ""))


def parse_mcap(c: Column) -> Column:
    return to_number(F.translate(c, ",", ""))


def parse_number(c: Column) -> Column:
    """Drops thousands separators and percent signs; empty text and dashes are null."""
    return to_number(F.translate(c, ",%", ""))


def parse_pct_change(c: Column) -> Column:
    """A signed change; an arrow down or the word makes it negative."""
    value = to_number(F.regexp_replace(c, r"[^0-9.\-]", ""))
    falls = c.contains("⇣") | F.lower(c).contains("down")
    return F.when(falls, -F.abs(value)).otherwise(value)


def parse_listing_date(c: Column) -> Column:
    """'2 Apr 2026' as ISO text; other text comes back trimmed."""
    text = strip(c)
    return F.coalesce(F.date_format(F.try_to_date(text, "d MMM yyyy"), "yyyy-MM-dd"), text)


def extract_identifier(href: Column) -> Column:
    """struct(identifier, id_type) of a company link."""
    by_id = F.regexp_extract(href, r"^/company/id/(\d+)", 1)
    name = F.regexp_extract(href, r"^/company/([^/]+)/?", 1)
    kind = F.when(F.coalesce(by_id, F.lit("")) != "", "screener_id").when(F.coalesce(name, F.lit("")) == "", "unknown").when(name.rlike(r"^\d+$"), "bse_code").otherwise("symbol")
    value = F.when(kind == "screener_id", by_id).when(kind != "unknown", name)
    return F.struct(value.alias("identifier"), kind.alias("id_type"))


def final_symbols(identifier: Column, id_type: Column, bse: Column) -> Column:
    """struct(symbol, nse_symbol, yf_symbol): exchange suffix .NS for symbols, .BO for numeric codes, null if unresolved."""
    code = F.when(id_type == "bse_code", identifier).otherwise(bse)
    nse = F.when(id_type == "symbol", identifier)
    quoted = F.when(nse.isNotNull(), F.concat(nse, F.lit(".NS"))).when(code.isNotNull(), F.concat(code, F.lit(".BO")))
    return F.struct(F.coalesce(nse, code, identifier).alias("symbol"), nse.alias("nse_symbol"), quoted.alias("yf_symbol"))


def page_ids(text: Column) -> Column:
    """struct(nse, bse): listing codes named in a page's text."""
    nse = F.regexp_extract(text, r"(?U)NSE:\s*(\w+)", 1)
    bse = F.regexp_extract(text, r"(?U)BSE(?:\s*-\s*\w+)?:\s*(\d+)", 1)
    return F.struct(F.nullif(nse, F.lit("")).alias("nse"), F.nullif(bse, F.lit("")).alias("bse"))


def normalise_text(c: Column) -> Column:
    return F.lower(strip(c))
