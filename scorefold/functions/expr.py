"""Column expressions for fallbacks, rounding, formats, grades and semi-structured access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CRORE, LAKH = 1e7, 1e5


def number_or_null(c: Column) -> Column:
    """A double without nan and infinities."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def truthy(c: Column, text: bool = False) -> Column:
    """Neither null nor zero nor empty."""
    return F.coalesce(c != ("" if text else 0), F.lit(False))


def or_else(*columns: Column, text: bool = False) -> Column:
    """The first truthy value; the last one is taken as it is."""
    empty = F.lit("") if text else F.lit(0)
    return F.coalesce(*[F.nullif(c, empty) for c in columns[:-1]], columns[-1])


def exact_round(c: Column, places: int) -> Column:
    """Half-even on the exact binary value."""
    return F.replace(F.format_number(c, places), F.lit(","), F.lit("")).cast("double")


def pe_ratio(trailing: Column, price: Column, eps: Column) -> Column:
    worked_out = F.when((eps > 0) & truthy(price), exact_round(F.try_divide(price, eps), 2))
    return F.coalesce(trailing, worked_out)


def market_cap_cr(market_cap: Column, listed_cr: Column) -> Column:
    return F.when(truthy(market_cap), exact_round(market_cap / CRORE, 0)).otherwise(listed_cr)


def issue_return_pct(price: Column, issue: Column, listed: Column) -> Column:
    """Percent gain since issue, worked out where both prices are there, else as listed."""
    gain = exact_round(F.try_divide(price - issue, issue) * 100, 1)
    return F.when(truthy(price) & truthy(issue), gain).otherwise(listed)


def format_currency(c: Column) -> Column:
    steps = [(1e9, CRORE, 0, " Cr"), (1e7, CRORE, 1, " Cr"), (1e5, LAKH, 1, " L")]
    out = F.format_number(c, 0)
    for least, unit, places, mark in reversed(steps):
        out = F.when(c >= least, F.concat(F.format_number(c / unit, places), F.lit(mark))).otherwise(out)
    return F.coalesce(out, F.lit("N/A"))


def plain_number(c: Column, places: int) -> Column:
    return F.replace(F.format_number(c, places), F.lit(","), F.lit(""))


def format_pct(c: Column) -> Column:
    """A fraction as percent with one decimal."""
    return F.coalesce(F.concat(plain_number(c * 100, 1), F.lit("%")), F.lit("N/A"))


def format_market_cap(crores: Column) -> Column:
    c = number_or_null(crores)
    big = F.when(c >= 100_000, F.concat(plain_number(c / 100_000, 2), F.lit("L Cr")))
    return F.coalesce(big.when(c >= 10_000, F.concat(plain_number(c / 1000, 1), F.lit("K Cr"))).otherwise(F.concat(F.format_number(c, 0), F.lit(" Cr"))), F.lit("N/A"))


def format_price(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("₹"), F.format_number(number_or_null(c), 2)), F.lit("N/A"))


def format_pe(c: Column) -> Column:
    return F.coalesce(plain_number(number_or_null(c), 1), F.lit("N/A"))


def format_return(c: Column) -> Column:
    c = number_or_null(c)
    return F.coalesce(F.concat(F.when(c >= 0, "+").otherwise(""), plain_number(c, 1), F.lit("%")), F.lit("N/A"))


def score_band(c: Column) -> Column:
    return F.when(c >= 7, "green").when(c >= 4, "yellow").otherwise("red")


def extreme_mismatch(score: Column, recommendation: Column) -> Column:
    """A recommendation that contradicts its score."""
    against = {"BUY": score <= 3, "AVOID": score >= 8, "HOLD": (score >= 9) | (score <= 1)}
    return F.coalesce(F.greatest(*[(recommendation == r) & test for r, test in against.items()]), F.lit(False))


def quality_from_sources(info_keys: Column, *present: Column) -> Column:
    """Grade by how many of the sources are there; more than 30 info keys count as one."""
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in present), (F.coalesce(info_keys, F.lit(0)) > 30).cast("int"))
    return F.when(n >= 4, "full").when(n >= 2, "partial").when(n >= 1, "limited").otherwise("minimal")


def quality_upgrade(old: Column, *present: Column) -> Column:
    """The better of the old grade and what the second source offers; never below the old one."""
    ranks = F.create_map(*[F.lit(x) for pair in (("full", 4), ("partial", 2), ("limited", 1)) for x in pair])
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in present), F.lit(0))
    best = F.greatest(F.coalesce(ranks[F.coalesce(old, F.lit("minimal"))], F.lit(0)), n)
    return F.when(best >= 3, "full").when(best >= 2, "partial").when(best >= 1, "limited").otherwise("minimal")


def exchange(yf_symbol: Column) -> Column:
    return F.when(yf_symbol.endswith(".NS"), "NSE").otherwise("BSE")


def truncate(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def title_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def detail_link(symbol: Column, name: Column | None = None) -> Column:
    link = F.concat(F.lit("?stock="), symbol)
    return link if name is None else F.concat(link, F.lit("#"), name)


def get(doc: Column, path: str, kind: str, default=None) -> Column:
    """A typed field of a VARIANT; absent, null and mistyped values give the default."""
    value = F.try_variant_get(doc, path, kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def get_or_unknown(doc: Column, path: str, default: str = "Unknown") -> Column:
    """The default only where the key is absent; an explicit null stays null."""
    found = F.try_variant_get(doc, path, "variant")
    return F.when(found.isNull(), F.lit(default)).when(~F.is_variant_null(found), F.try_variant_get(doc, path, "string"))


def keys_of(json: Column) -> Column:
    return F.json_object_keys(json)


def key_count(json: Column) -> Column:
    """Number of keys of a JSON object; 0 where there is none."""
    return F.coalesce(F.size(F.json_object_keys(json)), F.lit(0))


def missing_keys(json: Column, wanted: Sequence[str]) -> Column:
    """Wanted keys that a JSON object lacks; a key with a null value is present."""
    return F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))


def unexpected_keys(json: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))


def integral_score(doc: Column, path: str, low: int = 0, high: int = 10) -> Column:
    """Whether a VARIANT field is a number (not text or boolean) without fraction within the range; null if it is absent."""
    found = F.try_variant_get(doc, path, "variant")
    kind = F.schema_of_variant(found)
    value = F.try_variant_get(doc, path, "double")
    numeric = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)")
    good = numeric & (value == F.floor(value)) & value.between(low, high)
    return F.when(found.isNotNull() & ~F.is_variant_null(found), F.coalesce(good, F.lit(False)))


def drop_fields(fields: Column, names: Sequence[str]) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


def map_or_zero(scores: Column, key: str) -> Column:
    return F.coalesce(scores[key], F.lit(0))
