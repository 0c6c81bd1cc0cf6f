"""The registered queries over the given tables, each beside the SQL that must give the same rows.

Ratings come from lineitem: a part is the entity, return flag and line status name the rater, and the score is the quantity
modulo 11. Of several rows for an entity and rater the largest by date, order and further columns counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorefold.functions import expr, parse
from scorefold.operators import audit, enrich, joins, prompts, rollup, rules, screen
from scorefold.plans import raters as dimension
from scorefold.sources import documents, html, infer, rated_files, stage
from scorefold.sources.buckets import BucketStore
from scorefold.streaming import incremental, listeners, stateful
from scorefold.streaming import ratings as streams

RATERS = ("AF", "AO", "NF", "NO", "RF", "RO")
GROUPS = {"value_total": ("AF", "AO"), "growth_total": ("NF", "NO"), "quant_total": ("RF", "RO")}
#: 60 and 40 percent of what six raters can give.
BUY, HOLD = 36, 24
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def recommendation(score):
    return F.when(score >= 6, "BUY").when(score >= 4, "HOLD").otherwise("AVOID")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, persona, score, recommendation) and the row's other columns."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.concat("l_returnflag", "l_linestatus").alias("persona"), *ORDER)
    last = rollup.latest_rating(rows, ["symbol", "persona"], ORDER)
    score = F.col("l_quantity").cast("bigint") % 11
    return last.withColumns({"score": score, "recommendation": recommendation(score)})


def scores(spark: SparkSession, d: str) -> DataFrame:
    return rollup.composite_scores(ratings(spark, d), "symbol", buy=BUY, hold=HOLD)


VIEW = """
numbered AS (
  SELECT l_partkey AS symbol, l_returnflag || l_linestatus AS persona, *, row_number() OVER (PARTITION BY l_partkey, l_returnflag || l_linestatus
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS nth FROM lineitem
), scored AS (SELECT *, trunc(l_quantity)::BIGINT % 11 AS score FROM numbered WHERE nth = 1),
ratings AS (SELECT *, CASE WHEN score >= 6 THEN 'BUY' WHEN score >= 4 THEN 'HOLD' ELSE 'AVOID' END AS recommendation FROM scored),
scores AS (
  SELECT symbol, sum(score)::BIGINT AS composite_score, count(score) AS coverage,
    CASE WHEN sum(score) >= 36 THEN 'BUY' WHEN sum(score) >= 24 THEN 'HOLD' ELSE 'AVOID' END AS consensus_recommendation
  FROM ratings GROUP BY symbol
)
"""
W = "WITH " + VIEW


@query(W + "SELECT symbol, composite_score, coverage, CASE WHEN composite_score >= 60 THEN 'BUY' WHEN composite_score >= 40 THEN 'HOLD' ELSE 'AVOID' END AS consensus_recommendation, row_number() OVER (ORDER BY composite_score DESC, symbol) AS rank FROM scores")
def composite_scores(spark, d):
    return rollup.rank_scores(rollup.composite_scores(ratings(spark, d), "symbol"))


@query(W + "SELECT symbol, composite_score, coverage, consensus_recommendation FROM scores")
def composite_scaled(spark, d):
    return scores(spark, d)


@query(
    W + """, l AS (SELECT p_partkey AS symbol, p_name, p_retailprice, p_size, row_number() OVER (PARTITION BY p_partkey ORDER BY p_name) AS k FROM part),
s AS (SELECT p_partkey AS symbol, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice * 1e5 END AS cap, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size::DOUBLE END AS pe,
  CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_retailprice END AS price FROM part)
SELECT c.symbol, l.p_name AS company_name, s.p_brand AS sector, round(coalesce(nullif(s.price, 0), l.p_retailprice + 1), 6) AS current_price,
  round(CASE WHEN s.cap <> 0 THEN s.cap / 1e7 ELSE l.p_size::DOUBLE END, 0) AS market_cap_cr,
  round(coalesce(s.pe, coalesce(nullif(s.price, 0), l.p_retailprice + 1) / 7), 1) AS pe_ratio,
  round((coalesce(nullif(s.price, 0), l.p_retailprice + 1) - 500) / 500 * 100, 1) AS ipo_return_pct,
  composite_score, consensus_recommendation, coverage AS analysis_coverage,
  (SELECT string_agg(persona || '=' || score, ',' ORDER BY persona) FROM ratings r WHERE r.symbol = c.symbol) AS persona_scores
FROM scores c LEFT JOIN l ON l.symbol = c.symbol AND k = 1 LEFT JOIN s ON s.symbol = c.symbol"""
)
def score_record(spark, d):
    part = table(spark, d, "part")
    listing = part.select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("company_name"), F.lit(None).cast("string").alias("listing_date"), F.lit(500.0).alias("issue_price"), (F.col("p_retailprice") + 1).alias("current_price"), F.lit(None).cast("double").alias("ipo_return_pct"), F.col("p_size").cast("double").alias("ipo_mcap_cr"))
    k = F.col("p_partkey")
    stocks = part.select(
        k.alias("symbol"), F.lit(None).cast("string").alias("company_name"), F.col("p_brand").alias("sector"), F.col("p_type").alias("industry"), F.lit(None).cast("string").alias("listing_date"),
        F.when(k % 5 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("current_price"), F.lit(0.0).alias("regular_price"), F.lit(None).cast("double").alias("previous_close"),
        F.when(k % 3 == 0, 0.0).otherwise(F.col("p_retailprice") * 1e5).alias("market_cap"), F.when(k % 4 != 0, F.col("p_size").cast("double")).alias("trailing_pe"), F.lit(7.0).alias("eps"),
        F.lit(0.1).alias("roe"), F.lit(None).cast("double").alias("debt_to_equity"), F.lit(None).cast("double").alias("revenue_growth"), F.lit(0.0).alias("issue_price"), F.lit("full").alias("data_quality"),
    )
    out = enrich.score_record(ratings(spark, d).select("symbol", "persona", "score", "recommendation"), stocks, listing, BUY, HOLD, len(RATERS))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("persona_scores")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("symbol", "company_name", "sector", F.round("current_price", 6).alias("current_price"), F.round("market_cap_cr", 0).alias("market_cap_cr"), F.round("pe_ratio", 1).alias("pe_ratio"), F.round("ipo_return_pct", 1).alias("ipo_return_pct"), "composite_score", "consensus_recommendation", "analysis_coverage", text.alias("persona_scores"))


@query(W + "SELECT symbol, coalesce(sum(score) FILTER (persona IN ('AF', 'NO', 'RF')), 0)::BIGINT AS composite_score, 30 AS max_score FROM ratings GROUP BY symbol")
def restrict_raters(spark, d):
    wide = scores(spark, d).join(rollup.persona_scores(ratings(spark, d), "symbol", "persona"), "symbol")
    return screen.restrict_raters(wide, ["AF", "NO", "RF"], RATERS).select("symbol", "composite_score", "max_score")


def screened(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("sector"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("market_cap_cr"), F.when(F.col("p_size") % 2 == 0, "full").otherwise("partial").alias("data_quality"))
    return joins.left_enrich(scores(spark, d), part, ["symbol"])


@query(
    W + """, j AS (SELECT s.*, p_brand AS sector, CASE WHEN p_size > 10 THEN p_retailprice END AS market_cap_cr, CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'partial' END AS data_quality FROM scores s LEFT JOIN part ON p_partkey = symbol)
SELECT symbol, composite_score, sector, row_number() OVER (ORDER BY composite_score DESC, symbol) AS rank FROM j
WHERE composite_score BETWEEN 20 AND 45 AND sector IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') AND consensus_recommendation IN ('BUY', 'HOLD') AND data_quality IN ('full') AND coalesce(market_cap_cr, 0) BETWEEN 0 AND 1500"""
)
def screen_rank(spark, d):
    found = screen.screen(screened(spark, d), (20, 45), ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"], ["BUY", "HOLD"], ["full"], (0, 1500))
    return rollup.rank_scores(found).select("symbol", "composite_score", "sector", "rank")


@query(W + "SELECT symbol AS \"Symbol\", composite_score AS \"Score\", consensus_recommendation AS \"Rec\", p_brand AS \"Sector\", NULL::VARCHAR AS \"Company\", round(CASE WHEN p_size > 10 THEN p_retailprice END, 6) AS \"Market cap\" FROM scores LEFT JOIN part ON p_partkey = symbol")
def table_view(spark, d):
    shown = screen.table_view(screened(spark, d).drop("data_quality"))
    return shown.select("Symbol", "Score", "Rec", "Sector", "Company", F.round("Market cap", 6).alias("Market cap"))


@query(W + "SELECT s.symbol, coalesce(r.score, 0)::BIGINT AS rater_score, row_number() OVER (ORDER BY coalesce(r.score, 0) DESC, s.symbol) AS rank FROM scores s LEFT JOIN ratings r ON r.symbol = s.symbol AND r.persona = 'RF'")
def rank_by_rater(spark, d):
    wide = scores(spark, d).join(rollup.persona_scores(ratings(spark, d), "symbol", "persona"), "symbol")
    one = wide.select("symbol", expr.map_or_zero(F.col("persona_scores"), "RF").alias("rater_score"))
    return rollup.rank_scores(one, by="rater_score")


@query(W + "SELECT persona, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, coalesce(round(stddev_samp(score), 6), 0) AS stdev, min(score) AS min, max(score) AS max, count(*) AS n FROM ratings GROUP BY persona")
def rater_stats(spark, d):
    return rollup.rater_stats(ratings(spark, d), "persona", places=6)


@query(W + "SELECT persona, score, count(*) AS n FROM ratings GROUP BY ALL")
def score_distribution(spark, d):
    return rollup.score_distribution(ratings(spark, d), "persona")


@query(
    """WITH c AS (SELECT user_id, event_type, length(event_type) AS score, count(*) AS n FROM events GROUP BY ALL), n AS (SELECT user_id, score, sum(n) AS n FROM c GROUP BY ALL),
m AS (SELECT user_id, first(score ORDER BY n DESC, score) AS modal_score, max(n)::BIGINT AS modal_n, sum(n)::BIGINT AS n, count(*) AS distinct_scores FROM n GROUP BY user_id)
SELECT *, round(modal_n * 100.0 / n, 6) AS modal_pct FROM m WHERE distinct_scores = 1 OR modal_n * 100.0 / n > 35"""
)
def uniform_raters(spark, d):
    events = table(spark, d, "events").select("user_id", F.length("event_type").cast("bigint").alias("score"))
    return rollup.uniform_raters(events, "user_id", threshold=35.0).withColumn("modal_pct", F.round("modal_pct", 6))


@query(W + "SELECT persona, count(*) FILTER (recommendation = 'BUY') AS buy, count(*) FILTER (recommendation = 'HOLD') AS hold, count(*) FILTER (recommendation = 'AVOID') AS avoid, count(*) AS total FROM ratings GROUP BY persona")
def recommendation_crosstab(spark, d):
    return rollup.recommendation_crosstab(ratings(spark, d), "persona")


@query(W + ", n AS (SELECT symbol, recommendation, count(*) AS n FROM ratings GROUP BY ALL) SELECT symbol, string_agg(recommendation || '=' || n, ',' ORDER BY recommendation) AS counts FROM n GROUP BY symbol")
def rec_counts_map(spark, d):
    counts = rollup.recommendation_counts(ratings(spark, d), "symbol")
    entries = F.transform(F.array_sort(F.map_entries("recommendation_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return counts.select("symbol", F.array_join(entries, ",").alias("counts"))


@query(W + "SELECT b AS bracket, count(symbol) AS n FROM (VALUES ('70-100', 70, 1000), ('50-69', 50, 70), ('30-49', 30, 50), ('10-29', 10, 30), ('0-9', -1000, 10)) v(b, lo, hi) LEFT JOIN scores ON composite_score >= lo AND composite_score < hi GROUP BY b")
def score_brackets(spark, d):
    return rollup.score_brackets(scores(spark, d))


@query(W + "SELECT count(*) AS entities, round(avg(composite_score), 6) AS mean_composite, count(*) FILTER (consensus_recommendation = 'BUY') AS buy, count(*) FILTER (consensus_recommendation = 'HOLD') AS hold, count(*) FILTER (consensus_recommendation = 'AVOID') AS avoid FROM scores")
def headline(spark, d):
    return rollup.headline(scores(spark, d)).withColumn("mean_composite", F.round("mean_composite", 6))


@query(W + "SELECT round(avg(composite_score), 6) AS mean, quantile_cont(composite_score, 0.5) AS median, round(stddev_samp(composite_score), 6) AS stdev, min(composite_score) AS min, max(composite_score) AS max FROM scores")
def composite_summary(spark, d):
    return rollup.composite_summary(scores(spark, d)).withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query(W + "SELECT p_type AS sector, count(*) AS n, round(avg(composite_score), 6) AS mean_composite FROM scores JOIN part ON p_partkey = symbol GROUP BY p_type HAVING count(*) >= 3")
def group_average(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_type").alias("sector"))
    return rollup.group_average(scores(spark, d).join(part, "symbol"), "sector").withColumn("mean_composite", F.round("mean_composite", 6))


@query(W + "SELECT symbol, count(*) AS n, coalesce(round(stddev_samp(score), 6), 0) AS stdev, max(score) - min(score) AS spread FROM ratings GROUP BY symbol")
def disagreement(spark, d):
    return rollup.disagreement(ratings(spark, d), "symbol").withColumn("stdev", F.round("stdev", 6))


@query(W + "SELECT symbol, coalesce(sum(score) FILTER (persona IN ('AF', 'AO')), 0)::BIGINT AS value_total, coalesce(sum(score) FILTER (persona IN ('NF', 'NO')), 0)::BIGINT AS growth_total, coalesce(sum(score) FILTER (persona IN ('RF', 'RO')), 0)::BIGINT AS quant_total FROM ratings GROUP BY symbol")
def rater_group_totals(spark, d):
    return rollup.rater_group_totals(ratings(spark, d), GROUPS, "symbol", "persona")


@query(W + "SELECT persona, count(*) AS buys FROM ratings WHERE recommendation = 'BUY' GROUP BY persona")
def buy_convergence(spark, d):
    return rollup.buy_convergence(ratings(spark, d), "persona")


@query(W + ", n AS (SELECT symbol, recommendation, count(*) AS votes FROM ratings GROUP BY ALL) SELECT symbol, recommendation AS majority, votes FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY votes DESC, CASE recommendation WHEN 'BUY' THEN 1 WHEN 'HOLD' THEN 2 ELSE 3 END) = 1")
def majority_vote(spark, d):
    return rollup.majority_vote(ratings(spark, d), "symbol")


@query(W + ", e AS (SELECT DISTINCT symbol FROM ratings), x AS (SELECT e.symbol, p FROM e CROSS JOIN (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO'), ('XX')) v(p)) SELECT symbol, string_agg(p, ',' ORDER BY p) AS missing FROM x WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.symbol = x.symbol AND r.persona = p) GROUP BY symbol")
def missing_combinations(spark, d):
    return joins.missing_combinations(ratings(spark, d), [*RATERS, "XX"], "symbol", "persona").select("symbol", F.array_join("missing", ",").alias("missing"))


@query(W + "SELECT a.symbol, a.score AS score_a, b.score AS score_b, a.score > b.score AS a_higher, a.score - b.score >= 3 AS wide_gap FROM ratings a JOIN ratings b ON a.symbol = b.symbol AND a.persona = 'AF' AND b.persona = 'RF'")
def compare_raters(spark, d):
    return joins.compare_raters(ratings(spark, d), "AF", "RF", 3, "symbol", "persona")


@query(W + "SELECT p_partkey AS symbol, p AS persona FROM part CROSS JOIN (SELECT DISTINCT persona AS p FROM ratings)")
def work_items(spark, d):
    entities = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"))
    return joins.work_items(entities, table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("persona")).distinct())


@query(W + "SELECT p_partkey AS symbol, p AS persona FROM part CROSS JOIN (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO')) v(p) WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.symbol = p_partkey AND r.persona = p)")
def pending_items(spark, d):
    raters = spark.createDataFrame([(r,) for r in RATERS], "persona string")
    entities = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"))
    return documents.pending(joins.work_items(entities, raters), ratings(spark, d), ["symbol", "persona"])


@query(
    """WITH n AS (SELECT DISTINCT source, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM documents)
SELECT count(*) AS n_entities, string_agg(source, ',' ORDER BY source) AS entities, left(t, 100) AS snippet FROM n WHERE length(t) > 20 GROUP BY t HAVING count(*) > 1"""
)
def duplicate_text(spark, d):
    found = rollup.duplicate_text(table(spark, d, "documents"), F.col("text"), "source")
    return found.select("n_entities", F.array_join("entities", ",").alias("entities"), "snippet")


@query("SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS chars FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 20")
def text_length_check(spark, d):
    chars = F.length(parse.strip(F.col("text")))
    return table(spark, d, "documents").select("doc_id", chars.cast("bigint").alias("chars")).where("chars < 20")


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS k FROM lineitem)
SELECT l_suppkey, min(l_shipdate) AS first_date, max(l_shipdate) AS last_date, count(*) AS total_days, arg_max(l_extendedprice, k) AS first_close, arg_min(l_extendedprice, k) AS last_close,
  max(l_extendedprice) FILTER (k <= 252) AS high_52w, min(l_extendedprice) FILTER (k <= 252) AS low_52w, round(avg(l_quantity) FILTER (k <= 30), 6) AS avg_volume_30d FROM n GROUP BY l_suppkey"""
)
def price_summary(spark, d):
    out = rollup.price_summary(table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return out.withColumn("avg_volume_30d", F.round("avg_volume_30d", 6))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, round(o_totalprice, 1) AS mcap, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS junk FROM orders")
def parse_money(spark, d):
    o = table(spark, d, "orders")
    price = F.concat(F.lit(" ₹"), F.format_number("o_totalprice", 2), F.lit(" "))
    odd = F.element_at(F.array(*map(F.lit, ("", "₹", "n/a", "1_000", "nan"))), ((F.col("o_orderkey") / 5).cast("int") % 5 + 1).cast("int"))
    junk = F.when(F.col("o_orderkey") % 5 == 0, odd).otherwise(price)
    # format_number rounds half-even on the exact value, the oracle half-up: both agree on two-decimal prices
    return o.select("o_orderkey", parse.parse_price(price).alias("price"), F.round(parse.parse_mcap(F.format_number("o_totalprice", 2)), 1).alias("mcap"), parse.parse_price(junk).alias("junk"))


@query("SELECT c_custkey, (CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END) * abs(trunc(c_acctbal)) AS change, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE abs(trunc(c_acctbal)) END AS junk FROM customer")
def parse_pct(spark, d):
    c = table(spark, d, "customer")
    whole = F.abs(F.col("c_acctbal")).cast("bigint").cast("string")
    text = F.concat(F.when(F.col("c_acctbal") < 0, F.when(F.col("c_custkey") % 2 == 0, "⇣ ").otherwise("Down ")).otherwise("⇡ +"), whole, F.lit("%"))
    return c.select("c_custkey", parse.parse_pct_change(text).alias("change"), parse.parse_pct_change(F.when(F.col("c_custkey") % 2 == 0, F.concat(whole, F.lit("-"), whole)).otherwise(F.concat(F.lit("about "), whole))).alias("junk"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL ELSE round(c_acctbal, 2) END AS number FROM customer")
def parse_number(spark, d):
    text = F.when(F.col("c_custkey") % 4 == 0, F.when(F.col("c_custkey") % 8 == 0, "—").otherwise("-")).otherwise(F.concat(F.format_number("c_acctbal", 2), F.when(F.col("c_custkey") % 2 == 0, " %").otherwise("")))
    return table(spark, d, "customer").select("c_custkey", parse.parse_number(F.regexp_replace(text, " %$", "%")).alias("number"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS listing_date, 'soon ' || o_orderkey AS odd FROM orders")
def parse_dates(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", parse.parse_listing_date(F.date_format("o_orderdate", "d MMM yyyy")).alias("listing_date"), parse.parse_listing_date(F.concat(F.lit(" soon "), "o_orderkey", F.lit("\t"))).alias("odd"))


@query(
    """WITH h AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/company/id/' || p_partkey || '/' WHEN 1 THEN '/company/' || p_partkey || '/' WHEN 2 THEN '/company/P' || p_partkey || '/consolidated/' ELSE '/about/' END AS href FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN 'P' || p_partkey ELSE p_partkey::VARCHAR END AS identifier,
  CASE p_partkey % 4 WHEN 0 THEN 'screener_id' WHEN 1 THEN 'bse_code' WHEN 2 THEN 'symbol' ELSE 'unknown' END AS id_type,
  CASE p_partkey % 4 WHEN 1 THEN p_partkey || '.BO' WHEN 2 THEN 'P' || p_partkey || '.NS' END AS yf_symbol FROM h"""
)
def extract_identifier(spark, d):
    k = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 4
    href = F.when(kind == 0, F.concat(F.lit("/company/id/"), k, F.lit("/"))).when(kind == 1, F.concat(F.lit("/company/"), k, F.lit("/"))).when(kind == 2, F.concat(F.lit("/company/P"), k, F.lit("/consolidated/"))).otherwise("/about/")
    rows = table(spark, d, "part").select("p_partkey", parse.extract_identifier(href).alias("i")).select("p_partkey", "i.identifier", "i.id_type")
    return joins.with_final_symbols(rows).select("p_partkey", "identifier", "id_type", "yf_symbol")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, d):
    return html.html_links(html.page_items(table(spark, d, "pages"), ["page_id"]), ["page_id"]).select("page_id", "href")


@query(
    """SELECT l_suppkey, year(l_shipdate)::VARCHAR AS period, 'Sales' AS metric, sum(trunc(l_quantity))::DOUBLE AS value FROM lineitem GROUP BY ALL
UNION ALL SELECT l_suppkey, year(l_shipdate)::VARCHAR, 'Lines', count(*)::DOUBLE FROM lineitem GROUP BY ALL"""
)
def html_table_facts(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("string").alias("y")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.count("*").alias("n"))
    rows = sums.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("y", "q", "n"))).alias("r"))

    def line(name, what):
        return F.concat(F.lit(f"<tr><td>{name}+<td>"), F.array_join(F.transform("r", what), "<td>"), F.lit("</tr>"))

    page = F.concat(F.lit("<section id='cash-flow'><table><tr><th>"), F.lit("<th>"), F.array_join(F.transform("r", lambda x: x["y"]), "<th>"), F.lit("</tr><tr></tr>"), line("Sales", lambda x: F.format_number(x["q"], 0)), line("Lines", lambda x: x["n"].cast("string")), F.lit("<tr><td>Empty<td>-</tr></table></section>"))
    items = html.page_items(rows.select("l_suppkey", page.alias("html")), ["l_suppkey"])
    return html.company_facts_from_pages(items, ["l_suppkey"]).select("l_suppkey", "period", "metric", "value")


@query(
    """SELECT p_partkey, p_name AS company_name, 'P' || p_partkey AS identifier, round(p_retailprice, 2) AS issue_price, round(p_retailprice * 2, 2) AS current_price, (p_size - 25)::DOUBLE AS ipo_return_pct, (p_size * 1000)::DOUBLE AS ipo_mcap_cr, '2026-04-02' AS listing_date FROM part"""
)
def listing_pages(spark, d):
    part = table(spark, d, "part")
    change = F.concat(F.when(F.col("p_size") < 25, "⇣ ").otherwise("⇡ "), F.abs(F.col("p_size") - 25).cast("string"), F.lit("%"))
    cells = F.concat_ws("</td><td>", F.concat(F.lit("<a href='/company/P"), F.col("p_partkey").cast("string"), F.lit("/'>"), F.col("p_name"), F.lit("</a>")), F.lit("02 Apr 2026"), F.format_number(F.col("p_size") * 1000, 0), F.concat(F.lit("₹"), F.format_number("p_retailprice", 2)), F.concat(F.lit("₹"), F.format_number(F.col("p_retailprice") * 2, 2)), change)
    page = F.concat(F.lit("<table><tr><th>Name<th>Date<th>Cap<th>Issue<th>Now<th>Change</tr><tr><td>"), cells, F.lit("</td></tr><tr><td>short</tr></table><table><tr><td>other</table>"))
    items = html.page_items(part.select("p_partkey", page.alias("html")), ["p_partkey"])
    return html.listing_from_pages(items, ["p_partkey"]).select("p_partkey", "company_name", "id.identifier", "issue_price", "current_price", "ipo_return_pct", "ipo_mcap_cr", "listing_date")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, array_to_string(json_keys(props), ',') AS keys, 2 AS n_keys, CASE WHEN event_id % 3 = 0 THEN 'm' ELSE '' END AS missing, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS integral FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props[:-2] || ', \"x\": 1}' WHEN 1 THEN props[:-2] || ', \"m\": 4.0}' ELSE props[:-2] || ', \"m\": 4.5}' END AS props FROM events)")
def json_fields(spark, d):
    more = F.when(F.col("event_id") % 3 == 0, ', "x": 1}').when(F.col("event_id") % 3 == 1, ', "m": 4.0}').otherwise(', "m": 4.5}')
    e = table(spark, d, "events").select("event_id", F.concat(F.regexp_replace("props", r"\}\s*$", ""), more).alias("props"))
    v = F.try_parse_json("props")
    return e.select("event_id", expr.get(v, "$.k", "bigint").alias("k"), F.array_join(expr.keys_of(F.col("props")), ",").alias("keys"), expr.key_count(F.col("props")).alias("n_keys"), F.array_join(expr.missing_keys(F.col("props"), ["k", "m"]), ",").alias("missing"), expr.integral_score(v, "$.m").alias("integral"))


@query("SELECT event_id, unnest(json_keys(props)) AS key, (props::JSON ->> '$.k')::BIGINT AS value FROM events")
def json_keys(spark, d):
    rows = documents.open_fields(table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("doc")), ["event_id"])
    return rows.select("event_id", "key", F.try_variant_get("value", "$", "bigint").alias("value"))


@query(
    """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN NULL ELSE round(c_acctbal, 2) END AS pe, c_custkey % 2 = 0 AS has FROM customer)
SELECT c_custkey, CASE WHEN coalesce(pe, 0) = 0 AND has THEN (c_custkey % 50)::DOUBLE ELSE pe END AS trailing_pe, CASE WHEN has THEN (c_custkey % 50)::DOUBLE ELSE 7 END AS roce,
  CASE WHEN coalesce(pe, 0) = 0 AND has THEN round((c_custkey % 50) / 100.0, 6) ELSE pe END AS return_on_equity FROM b"""
)
def fill_gaps(spark, d):
    k = F.col("c_custkey")
    pe = F.when(k % 3 == 0, 0.0).when(k % 3 == 1, F.lit(None)).otherwise(F.round("c_acctbal", 2))
    base = table(spark, d, "customer").select("c_custkey", pe.alias("trailing_pe"), pe.alias("return_on_equity"), F.lit(7.0).alias("roce"))
    text = (k % 50).cast("string")
    other = table(spark, d, "customer").where(k % 2 == 0).select("c_custkey", F.create_map(F.lit("Stock P/E"), text, F.lit("ROE"), F.concat(text, F.lit(" %")), F.lit("ROCE"), text).alias("ratios"))
    other = other.withColumn("ratios", F.transform_values("ratios", lambda _, v: F.replace(v, F.lit(" "), F.lit(""))))
    out = enrich.fill_gaps(base, other, ["c_custkey"], [r for r in enrich.FILLS if r.target in base.columns])
    return out.select("c_custkey", "trailing_pe", "roce", F.round("return_on_equity", 6).alias("return_on_equity"))


@query(
    """WITH g AS (SELECT o_orderkey, o_orderkey % 5 AS o, (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + (o_orderkey % 4 = 0)::INT + (o_orderkey % 7 = 0)::INT AS n FROM orders),
b AS (SELECT *, greatest(n, CASE o WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS best FROM g)
SELECT o_orderkey, CASE WHEN best >= 3 THEN 'full' WHEN best >= 2 THEN 'partial' WHEN best >= 1 THEN 'limited' ELSE 'minimal' END AS upgraded,
  CASE WHEN n + (o_orderkey % 37 > 30)::INT >= 4 THEN 'full' WHEN n + (o_orderkey % 37 > 30)::INT >= 2 THEN 'partial' WHEN n + (o_orderkey % 37 > 30)::INT >= 1 THEN 'limited' ELSE 'minimal' END AS from_sources FROM b"""
)
def quality_upgrade(spark, d):
    k = F.col("o_orderkey")
    there = [k % m == 0 for m in (2, 3, 4, 7)]
    info = F.when(k % 37 > 0, F.to_json(F.map_from_arrays(F.transform(F.sequence(F.lit(1), (k % 37).cast("int")), lambda i: F.concat(F.lit("f"), i.cast("string"))), F.sequence(F.lit(1), (k % 37).cast("int")))))
    old = F.element_at(F.array(*map(F.lit, ("full", "partial", "limited", "minimal", "none"))), (k % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", expr.quality_upgrade(old, *there).alias("upgraded"), expr.quality_from_sources(expr.key_count(info), *there).alias("from_sources"))


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice * 1000 >= 1e9 THEN format('{:,}', round_even(o_totalprice * 1000 / 1e7, 0)::BIGINT) || ' Cr' WHEN o_totalprice * 1000 >= 1e7 THEN printf('%.1f', o_totalprice * 1000 / 1e7) || ' Cr'
  WHEN o_totalprice * 1000 >= 1e5 THEN printf('%.1f', o_totalprice * 1000 / 1e5) || ' L' ELSE format('{:,}', round_even(o_totalprice * 1000, 0)::BIGINT) END AS shown,
  printf('%.1f', o_totalprice / 1e6 * 100) || '%' AS pct FROM orders"""
)
def format_currency(spark, d):
    return table(spark, d, "orders").select("o_orderkey", expr.format_currency(F.col("o_totalprice") * 1000).alias("shown"), expr.format_pct(F.col("o_totalprice") / 1e6).alias("pct"))


@query(
    """SELECT c_custkey, '?stock=' || c_custkey || '#' || c_name AS link, CASE WHEN c_acctbal >= 7 THEN 'green' WHEN c_acctbal >= 4 THEN 'yellow' ELSE 'red' END AS band, CASE WHEN c_acctbal >= 0 THEN '+' ELSE '' END || printf('%.1f', c_acctbal) || '%' AS change,
  CASE WHEN c_nationkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Potential' AS label, CASE WHEN length(c_name) > 10 THEN left(c_name, 7) || '...' ELSE c_name END AS short FROM customer"""
)
def format_labels(spark, d):
    c = table(spark, d, "customer")
    suffix = F.concat("c_name", F.when(F.col("c_nationkey") % 2 == 0, ".NS").otherwise(".BO"))
    return c.select("c_custkey", expr.detail_link(F.col("c_custkey").cast("string"), F.col("c_name")).alias("link"), expr.score_band(F.col("c_acctbal")).alias("band"), expr.format_return(F.col("c_acctbal")).alias("change"), expr.exchange(suffix).alias("exchange"), expr.title_label(F.concat(F.lower("c_mktsegment"), F.lit("_potential"))).alias("label"), expr.truncate(F.col("c_name"), 10).alias("short"))


@query("WITH s AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), e AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM s) SELECT conv_id, count(*) AS words, max(length(word))::BIGINT AS longest, sum(pos)::BIGINT AS positions FROM e GROUP BY conv_id")
def array_explode(spark, d):
    words = enrich.list_rows(table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("words")), ["conv_id", "turn"], ["words"])
    return words.groupBy("conv_id").agg(F.count("*").alias("words"), F.max(F.length("text")).cast("bigint").alias("longest"), F.sum("position").alias("positions"))


@query("SELECT p_partkey, 'brand' AS metric, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part")
def metrics_unpivot(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_name").alias("name")).alias("m"))
    return enrich.metric_rows(part, ["p_partkey"], "m")


@query("SELECT c_custkey, l AS list, CASE WHEN n > 0 THEN pos::INT END AS position, CASE WHEN n > 0 THEN l || pos END AS text FROM customer, (VALUES ('key_strengths', 4), ('key_risks', 3)) v(l, m), LATERAL (SELECT c_custkey % m AS n), LATERAL (SELECT unnest(range(greatest(n, 1))) AS pos)")
def detail_lists(spark, d):
    def some(name, most):
        n = (F.col("c_custkey") % most).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit(name), i.cast("string")))).otherwise(F.when(F.col("c_custkey") % 2 == 0, F.array().cast("array<string>"))).alias(name)

    c = table(spark, d, "customer")
    return enrich.list_rows(c.select("c_custkey", some("key_strengths", 4), some("key_risks", 3)), ["c_custkey"], ["key_strengths", "key_risks"])


def faulty(spark, d):
    """The ratings with faults planted by the entity's number."""
    s = F.col("symbol")
    rows = ratings(spark, d).select("symbol", "persona", F.col("score").cast("double").alias("score"), "recommendation")
    score = F.when(s % 41 == 0, 12.0).when(s % 43 == 0, 4.5).when(s % 47 == 0, F.lit(None)).otherwise(F.col("score"))
    rec = F.when(s % 53 == 0, "MAYBE").when(s % 59 == 0, F.lit(None)).when(s % 37 == 0, "BUY").otherwise(F.col("recommendation"))
    thesis = F.when(s % 31 == 0, "  short ").otherwise(F.concat(F.lit("thesis number "), (s % 5000).cast("string"), F.lit(" by "), "persona"))
    return rows.withColumns({"score": score, "recommendation": rec, "thesis": thesis})


def all_issues(spark, d, rows=None):
    rows = stage.written(faulty(spark, d), "faulty-ratings") if rows is None else rows  # one scan and aggregation for all checks
    return audit.union([audit.row_issues(rows, F.concat_ws("/", F.col("symbol").cast("string"), "persona"), thesis="thesis"), audit.table_issues(rows, "symbol", "persona", RATERS, ("AF", "RF"), 3, 11.0), audit.duplicate_issues(rows, F.col("thesis"), "symbol")])


FAULTY = VIEW + """, f AS (SELECT symbol, persona, CASE WHEN symbol % 41 = 0 THEN 12.0 WHEN symbol % 43 = 0 THEN 4.5 WHEN symbol % 47 = 0 THEN NULL ELSE score::DOUBLE END::DOUBLE AS score,
  CASE WHEN symbol % 53 = 0 THEN 'MAYBE' WHEN symbol % 59 = 0 THEN NULL WHEN symbol % 37 = 0 THEN 'BUY' ELSE recommendation END AS recommendation,
  CASE WHEN symbol % 31 = 0 THEN '  short ' ELSE 'thesis number ' || (symbol % 5000) || ' by ' || persona END AS thesis FROM ratings),
texts AS (SELECT symbol, lower(regexp_replace(thesis, '^\\s+|\\s+$', '', 'g')) AS t FROM f),
pairs AS (SELECT a.symbol FROM f a JOIN f b ON a.symbol = b.symbol AND a.persona = 'AF' AND b.persona = 'RF' WHERE a.score - b.score >= 3),
modal AS (SELECT persona, max(n) AS m, sum(n) AS n, count(*) AS k FROM (SELECT persona, score, count(*) AS n FROM f WHERE score IS NOT NULL GROUP BY ALL) GROUP BY persona),
i AS (
  SELECT symbol || '/' || persona AS key, 'score_out_of_range' AS category FROM f WHERE score IS NOT NULL AND NOT (score = floor(score) AND score BETWEEN 0 AND 10)
  UNION ALL SELECT symbol || '/' || persona, 'invalid_recommendation' FROM f WHERE recommendation NOT IN ('BUY', 'HOLD', 'AVOID')
  UNION ALL SELECT symbol || '/' || persona, 'score_recommendation_mismatch' FROM f WHERE score = floor(score) AND score BETWEEN 0 AND 10 AND ((recommendation = 'BUY' AND score <= 3) OR (recommendation = 'AVOID' AND score >= 8) OR (recommendation = 'HOLD' AND (score >= 9 OR score <= 1)))
  UNION ALL SELECT symbol || '/' || persona, 'empty_strings' FROM f WHERE length(regexp_replace(thesis, '^\\s+|\\s+$', '', 'g')) < 20
  UNION ALL SELECT symbol::VARCHAR, 'missing_rater_files' FROM f GROUP BY symbol HAVING count(DISTINCT persona) < 6
  UNION ALL SELECT symbol::VARCHAR, 'rater_gap' FROM pairs
  UNION ALL SELECT persona, 'uniform_scores' FROM modal WHERE k = 1 OR m * 100.0 / n > 11
  UNION ALL SELECT left(t, 100), 'duplicate_theses' FROM texts WHERE length(t) > 20 GROUP BY t HAVING count(DISTINCT symbol) > 1
)"""
SEVERITY = "(VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in audit.CATEGORIES) + ") v(category, severity)"


@query("WITH " + FAULTY + " SELECT key, category FROM i")
def audit_issues(spark, d):
    return all_issues(spark, d).select("key", "category")


@query("WITH " + FAULTY + f" SELECT v.category, severity, count(key) AS n FROM {SEVERITY} LEFT JOIN i ON i.category = v.category GROUP BY ALL")
def audit_summary(spark, d):
    return audit.audit_summary(all_issues(spark, d))


@query(
    "WITH " + FAULTY + f""", t AS (SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'moderate') AS moderate, count(*) FILTER (severity = 'minor') AS minor, (SELECT count(*) FROM f) AS files FROM i JOIN {SEVERITY} ON i.category = v.category)
SELECT *, round(total * 100.0 / files, 6) AS issue_rate, round(critical * 100.0 / files, 6) AS critical_rate,
  CASE WHEN critical = 0 AND moderate = 0 THEN 'A+' WHEN critical = 0 AND total * 100.0 / files < 2 THEN 'A' WHEN critical * 100.0 / files < 1 AND total * 100.0 / files < 5 THEN 'B+' WHEN critical * 100.0 / files < 2 AND total * 100.0 / files < 10 THEN 'B'
  WHEN critical * 100.0 / files < 5 THEN 'C' WHEN critical * 100.0 / files < 10 THEN 'D' ELSE 'F' END AS grade FROM t"""
)
def audit_grade(spark, d):
    rows = stage.written(faulty(spark, d), "faulty-ratings")
    return audit.audit_grade(all_issues(spark, d, rows), rows).withColumns({c: F.round(c, 6) for c in ("issue_rate", "critical_rate")})


@query(
    """WITH f AS (SELECT l_partkey AS symbol, year(l_shipdate)::VARCHAR AS period, count(*) * 100000 AS v FROM lineitem GROUP BY ALL),
i AS (SELECT symbol, '  Net Income: ' || string_agg(period || ': ' || printf('%.1f', v / 1e5) || ' L', ' | ' ORDER BY period DESC) AS line FROM f GROUP BY symbol)
SELECT p_partkey AS symbol, r_name AS persona, 'Company: ' || p_name || chr(10) || 'Sector: ' || p_brand || chr(10) || 'Issue: N/A' || chr(10) || chr(10) ||
  CASE WHEN p_size % 10 = 0 AND line IS NULL THEN 'LIMITED DATA AVAILABLE — This is a recent IPO with minimal public financial history.' ELSE
  array_to_string(list_filter([
    CASE WHEN p_size % 10 <> 0 THEN 'VALUATION:' || chr(10) || '  P/E (TTM): ' || printf('%.2f', p_size::DOUBLE) || chr(10) || '  Price/Sales: ' || p_size || CASE WHEN p_size % 2 = 1 THEN chr(10) || '  EV/EBITDA: ' || printf('%.2f', p_size / 4.0) ELSE '' END END,
    CASE WHEN p_size % 10 <> 0 AND p_size > 25 THEN 'PROFITABILITY:' || chr(10) || '  ROE: ' || printf('%.1f', p_size / 100.0 * 100) || '%' || chr(10) || '  Gross Margin: ' || printf('%.1f', p_size / 200.0 * 100) || '%' END,
    CASE WHEN p_size % 10 <> 0 THEN 'BALANCE SHEET & CASH FLOW:' || chr(10) || '  Total Cash: ' || printf('%.1f', p_size * 1e5 / 1e5) || ' L' || chr(10) || '  Book Value/Share: INR ' || printf('%.2f', p_size / 5.0) END,
    CASE WHEN p_size % 10 <> 0 AND p_size > 40 THEN 'SHAREHOLDING:' || chr(10) || '  Institutional Holding: ' || printf('%.1f', p_size / 100.0 * 100) || '%' END,
    CASE WHEN line IS NOT NULL THEN 'INCOME STATEMENT (available years):' || chr(10) || line END,
    CASE WHEN p_size % 10 <> 0 THEN 'BUSINESS: ' || p_type END], lambda x: x IS NOT NULL), chr(10) || chr(10)) END || chr(10) || chr(10) || 'Score 0-10.' AS prompt
FROM part CROSS JOIN region LEFT JOIN i ON symbol = p_partkey"""
)
def prompt_set(spark, d):
    size = F.col("p_size")
    some = size % 10 != 0

    def where(test, value):
        return F.when(test, value)

    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("symbol"), "p_name", "p_brand", where(some, F.col("p_type")).alias("about"), F.lit(None).cast("double").alias("issue"), where(some, size.cast("double")).alias("pe"), where(some, size).alias("price_to_sales"),
        where(some & (size % 2 == 1), size / 4).alias("ev_to_ebitda"), where(some & (size > 25), size / 100).alias("roe"), where(some & (size > 25), size / 200).alias("gross_margin"), where(some, size * 1e5).alias("total_cash"),
        where(some, size / 5).alias("book_value"), where(some & (size > 40), size / 100).alias("institutions"),
    )
    facts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("symbol"), F.year("l_shipdate").cast("string").alias("period")).agg((F.count("*") * 100000).cast("double").alias("value"))
    lines = enrich.statement_lines(facts.withColumn("metric", F.lit("Net Income")), ["symbol"])
    items = joins.work_items(joins.left_enrich(part, lines, ["symbol"]), table(spark, d, "region").select(F.col("r_name").alias("persona")))
    summary = enrich.financial_summary(items, about="about", facts="lines")
    return enrich.prompt_set(items, [("Company", "p_name"), ("Sector", "p_brand"), ("Issue", "issue")], summary, "Score 0-10.").select("symbol", "persona", "prompt")


@query("SELECT event_id, (length(event_type) % 11)::INT AS score, CASE WHEN event_id % 3 = 0 THEN 'BUY' ELSE 'HOLD' END AS recommendation, NULL AS reason FROM events WHERE event_id % 3 <> 2 AND event_id % 5 <> 0 UNION ALL SELECT event_id, NULL, NULL, CASE WHEN event_id % 5 = 0 THEN 'unparseable' ELSE 'recommendation' END FROM events WHERE event_id % 3 = 2 OR event_id % 5 = 0")
def ingest_responses(spark, d):
    k = F.col("event_id")
    body = F.concat(F.lit('{"score": '), (F.length("event_type") % 11).cast("string"), F.lit(', "recommendation": "'), F.when(k % 3 == 0, "BUY").when(k % 3 == 1, "HOLD").otherwise("SELL"), F.when(k % 5 == 0, "").otherwise('"}'))
    taken, rest = enrich.ingest_responses(table(spark, d, "events").select("event_id", body.alias("response")), ["event_id"])
    return taken.drop("response").withColumn("reason", F.lit(None).cast("string")).unionByName(rest.select("event_id", F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("recommendation"), "reason"))


@query(
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'exit code 1: ' || left(props, 200) WHEN event_id % 7 = 0 THEN 'empty output' WHEN event_id % 13 = 0 THEN 'unparseable' WHEN event_id % 5 = 0 THEN 'error: ' || CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE event_type END
    WHEN event_id % 3 = 0 THEN 'no structured output' END AS reason, CASE WHEN reason IS NULL THEN length(event_type) END::BIGINT AS score, CASE WHEN reason IS NULL THEN user_id END::BIGINT AS duration_ms, CASE WHEN reason IS NULL AND event_id % 2 = 0 THEN user_id * 2 END::BIGINT AS input_tokens FROM events"""
)
def ingest_envelopes(spark, d):
    """Answers in their envelopes: errors by exit code, output, flag and content; what is taken keeps duration and usage."""
    k = F.col("event_id")
    output = F.when(k % 3 == 0, F.when(k % 2 == 0, "{}").otherwise("null")).otherwise(F.concat(F.lit('{"score": '), F.length("event_type").cast("string"), F.lit("}")))
    error = F.when(k % 5 == 0, F.concat(F.lit('"is_error": true, '), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit('"result": "'), "event_type", F.lit('", '))))).otherwise('"is_error": false, ')
    usage = F.when(k % 2 == 0, F.concat(F.lit(', "usage": {"input_tokens": '), (F.col("user_id") * 2).cast("string"), F.lit("}"))).otherwise("")
    body = F.concat(F.lit("{"), error, F.lit('"structured_output": '), output, F.lit(', "duration_ms": '), F.col("user_id").cast("string"), F.lit(', "total_cost_usd": 0.5'), usage, F.when(k % 13 == 0, "").otherwise("}"))
    raw = table(spark, d, "events").select("event_id", F.when(k % 7 == 0, " \n").otherwise(body).alias("response"), (k % 11 == 0).cast("int").alias("code"), F.col("props").alias("said"))
    taken, rest = enrich.ingest_envelopes(raw, ["event_id"], "m", exit_code="code", stderr="said")
    got = taken.select("event_id", F.lit(None).cast("string").alias("reason"), F.try_variant_get("analysis", "$.score", "bigint").alias("score"), F.col("metadata.duration_ms").alias("duration_ms"), F.try_variant_get("metadata.usage", "$.input_tokens", "bigint").alias("input_tokens"))
    none = F.lit(None).cast("bigint")
    return got.unionByName(rest.select("event_id", "reason", none.alias("score"), none.alias("duration_ms"), none.alias("input_tokens")))


@query(
    """WITH x AS (SELECT *, chr(10) AS nl, 'S' || s_suppkey AS symbol FROM supplier),
f AS (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'registry ' || s_suppkey ELSE symbol END AS name,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Unknown' WHEN s_suppkey % 4 = 1 THEN 'None' ELSE 'Steel' END AS sector, CASE WHEN s_suppkey % 5 = 0 THEN 'N/A' WHEN s_suppkey % 5 = 1 THEN 'None' ELSE (100 + s_suppkey) || '.0' END AS issue,
  CASE WHEN s_suppkey % 7 = 0 THEN '250.5' WHEN s_suppkey % 7 = 1 THEN 'N/A' ELSE s_suppkey::VARCHAR END AS price,
  concat_ws(nl, CASE WHEN s_suppkey % 2 = 0 THEN 'VALUATION:' || nl || '  P/E (TTM): ' || CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey || '.50' ELSE s_suppkey::VARCHAR END END,
    CASE WHEN s_suppkey % 3 <> 1 THEN nl || 'PROFITABILITY:' || nl || '  ROE: ' || CASE WHEN s_suppkey % 9 = 0 THEN 'high' ELSE '15.2%' END END,
    CASE WHEN s_suppkey % 5 <> 2 THEN nl || 'INCOME STATEMENT (available years):' || nl || '  Total Revenue: 2024-03-31: 2.5 L | 2022-03-31: 999' END,
    CASE WHEN s_suppkey % 8 = 0 THEN nl || 'BUSINESS: Makes ' || s_name || '.' END) AS body FROM x)
SELECT symbol, r_name AS persona, concat_ws(nl, 'Company: ' || name, 'Symbol: ' || symbol || ' (listed on ' || CASE WHEN s_suppkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END || ')', 'Sector: ' || sector || ' | Industry: Unknown', 'Listed: 2024-01-05 at INR ' || issue,
  'Current Price: INR ' || price || ' | Market Cap: INR ' || CASE WHEN s_suppkey % 2 = 0 THEN '123 Cr' ELSE 'N/A' END, 'IPO Return: ' || CASE WHEN s_suppkey % 3 = 0 THEN '12.5%' ELSE 'N/A' END, '', '=== FINANCIAL DATA ===',
  CASE WHEN body = '' THEN 'LIMITED DATA AVAILABLE — This is a recent IPO with minimal public financial history.' ELSE body END, '', '=== INSTRUCTIONS ===', 'Score 0-10.') AS prompt
FROM f, region WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0"""
)
def document_prompts(spark, d):
    """Prompts from stock documents: every fallback of the header, sections that are there, null periods left out."""
    k = F.col("s_suppkey")
    n = k.cast("string")

    def pick(mod, cases, other):
        out = None
        for r, text in cases.items():
            out = F.when(k % mod == r, text) if out is None else out.when(k % mod == r, text)
        return out.otherwise(other)

    info = F.concat(
        F.lit("{"), pick(3, {0: F.concat(F.lit('"longName": "'), "s_name", F.lit('", "returnOnEquity": '), F.when(k % 9 == 0, '"high"').otherwise("0.152"), F.lit(", ")), 2: F.lit('"longName": "", "returnOnEquity": 0.152, ')}, F.lit('"longName": null, ')),
        pick(4, {0: F.lit(""), 1: F.lit('"sector": null, ')}, F.lit('"sector": "Steel", ')), pick(7, {0: F.lit('"currentPrice": 250.5, '), 1: F.lit('"currentPrice": 0, ')}, F.concat(F.lit('"currentPrice": null, "regularMarketPrice": '), n, F.lit(", "))),
        F.when(k % 2 == 0, F.concat(F.lit('"marketCap": 1234567890, "trailingPE": '), n, F.when(k % 6 == 0, ".5").otherwise(""), F.lit(", "))).otherwise(""),
        F.when(k % 8 == 0, F.concat(F.lit('"longBusinessSummary": "Makes '), "s_name", F.lit('.", '))).otherwise(""), F.lit('"x": 1}'),
    )
    ipo = F.concat(
        F.lit('{"listing_date": "2024-01-05"'), F.when(k % 3 == 1, F.concat(F.lit(', "company_name": "registry '), n, F.lit('"'))).otherwise(""), pick(5, {0: F.lit(""), 1: F.lit(', "issue_price": null')}, F.concat(F.lit(', "issue_price": '), (k + 100).cast("string"), F.lit(".0"))),
        F.when(k % 3 == 0, ', "ipo_return_pct": 12.5').otherwise(', "ipo_return_pct": null'), F.lit("}"),
    )
    facts = F.when(k % 5 == 2, "{}").otherwise('{"Total Revenue": {"2024-03-31 00:00": 250000, "2023-03-31": null, "2022-03-31": 999}, "Net Income": {"2024-03-31": null}, "Other": {"2024": 5}}')
    text = F.concat(F.lit('{"fetch_status": "'), F.when(k % 11 == 0, "error").otherwise("success"), F.lit('", "data_quality": "'), F.when(k % 13 == 0, "partial").otherwise("full"), F.lit('", "yf_symbol": "S'), n, F.when(k % 2 == 0, ".NS").otherwise(".BO"), F.lit('", "info": '), info, F.lit(', "ipo_data": '), ipo, F.lit(', "financials": '), facts, F.lit("}"))
    stocks = table(spark, d, "supplier").select(F.concat(F.lit("S"), n).alias("symbol"), F.try_parse_json(text).alias("doc"))
    return prompts.document_prompts(prompts.analysable(stocks), table(spark, d, "region").select(F.col("r_name").alias("persona")), "Score 0-10.").select("symbol", "persona", "prompt")


RATIOS = """x AS (SELECT l_partkey AS symbol, sum(l_extendedprice * (1 - l_discount)) AS sales, sum(l_extendedprice * l_discount) AS debt, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_partkey)"""


@query(
    "WITH " + RATIOS + """, m AS (SELECT symbol, p_brand AS sector, round(sales, 4) AS ebit, round(sales + debt * 10, 4) AS ev, q * 100 AS capital FROM x JOIN part ON p_partkey = symbol),
y AS (SELECT symbol, round(ebit / nullif(ev, 0), 9) AS earnings_yield, round(ebit / nullif(capital, 0), 9) AS return_on_capital FROM m WHERE ebit > 0 AND sector NOT IN ('Brand#11', 'Brand#12'))
SELECT symbol, earnings_yield, return_on_capital, rank() OVER (ORDER BY earnings_yield DESC) AS yield_rank, rank() OVER (ORDER BY return_on_capital DESC) AS capital_rank,
  rank() OVER (ORDER BY earnings_yield DESC) + rank() OVER (ORDER BY return_on_capital DESC) AS magic_rank FROM y WHERE earnings_yield IS NOT NULL AND return_on_capital IS NOT NULL"""
)
def magic_formula(spark, d):
    sales = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    debt = F.sum(F.col("l_extendedprice") * F.col("l_discount"))
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("symbol")).agg(F.round(sales, 4).alias("ebit"), F.round(sales + debt * 10, 4).alias("ev"), (F.sum("l_quantity") * 100).alias("capital"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("sector"))
    return rules.magic_formula(x.join(part, "symbol"), "symbol", "ebit", "ev", "capital", "sector", ("Brand#11", "Brand#12"))


@query(
    """WITH v AS (SELECT p_partkey AS symbol, p_size::DOUBLE AS pe, p_size / 100.0 AS roe, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size / 50.0 END AS dte, CASE WHEN p_size % 3 = 0 THEN 0 ELSE (p_size - 20) / 100.0 END AS growth, round(p_retailprice - 950, 2) AS fcf FROM part)
SELECT symbol, CASE WHEN roe > 0.15 THEN 1 ELSE 0 END + CASE WHEN dte < 0.5 THEN 1 ELSE 0 END + CASE WHEN fcf > 0 THEN 1 ELSE 0 END AS quality_value_passed, 2 + CASE WHEN dte IS NULL THEN 0 ELSE 1 END AS quality_value_known,
  CASE WHEN growth = 0 THEN 'unknown' WHEN pe / (growth * 100) < 1 THEN 'pass' ELSE 'fail' END AS growth_at_price_peg, CASE WHEN dte IS NULL THEN 'unknown' WHEN dte < 0.6 THEN 'pass' ELSE 'fail' END AS growth_at_price_low_debt,
  CASE WHEN pe < 2 * growth * 100 THEN 'pass' ELSE 'fail' END AS growth_at_price_pe_below_twice_growth FROM v"""
)
def rule_screens(spark, d):
    size = F.col("p_size")
    v = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), size.cast("double").alias("pe"), (size / 100).alias("roe"), F.when(size % 4 != 0, size / 50).alias("debt_to_equity"), F.when(size % 3 == 0, 0.0).otherwise((size - 20) / 100).alias("earnings_growth"), F.round(F.col("p_retailprice") - 950, 2).alias("fcf"))
    out = rules.apply_screen(rules.apply_screen(v, "quality_value"), "growth_at_price")
    return out.select("symbol", "quality_value_passed", "quality_value_known", "growth_at_price_peg", "growth_at_price_low_debt", "growth_at_price_pe_below_twice_growth")


@query(W + "SELECT symbol, persona, score, CASE WHEN score >= 9 AND score <= 10 THEN '9-10' WHEN score >= 7 THEN '7-8' WHEN score >= 4 THEN '4-6' WHEN score >= 2 THEN '2-3' ELSE '0-1' END AS band FROM ratings")
def rubric_band(spark, d):
    return rules.rubric_band(ratings(spark, d), "score").select("symbol", "persona", "score", "band")


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total_cost, round(avg(value), 6) AS mean_cost, round(avg(user_id), 6) AS mean_duration, quantile_cont(user_id, 0.5) AS median_duration FROM events GROUP BY event_type")
def usage_rollup(spark, d):
    out = rollup.usage_rollup(table(spark, d, "events"), ["event_type"], "value", "user_id")
    return out.withColumns({"total_cost": F.round("total_cost", 4), "mean_cost": F.round("mean_cost", 6), "mean_duration": F.round("mean_duration", 6)})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, d):
    return rollup.status_counts(table(spark, d, "events"), "event_type")


@query(W + "SELECT (SELECT count(*) FROM ratings) AS done, (SELECT count(*) * 6 FROM part) AS target, round((SELECT count(*) FROM ratings) * 100.0 / (SELECT count(*) * 6 FROM part), 6) AS pct")
def progress(spark, d):
    raters = spark.createDataFrame([(r,) for r in RATERS], "persona string")
    return rollup.progress(ratings(spark, d), joins.work_items(table(spark, d, "part").select("p_partkey"), raters)).withColumn("pct", F.round("pct", 6))


@query("SELECT user_id AS page, array_to_string(list_sort(list_distinct(list(year(ts)))), ',') AS years, max(year(ts))::INT AS last_year FROM events GROUP BY user_id")
def page_years(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("page"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return rollup.page_years(rows, "page", "date").select("page", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "last_year")


@query("SELECT count(*) AS total, count(*) FILTER (p_size % 3 = 0) AS nse, count(*) FILTER (p_size % 3 = 1) AS bse_only, count(*) FILTER (p_size > 5) AS with_price FROM part")
def listing_coverage(spark, d):
    size = F.col("p_size")
    return rollup.listing_coverage(table(spark, d, "part").select(F.when(size % 3 == 0, "x").alias("nse_symbol"), F.when(size % 3 != 2, "y").alias("yf_symbol"), F.when(size > 5, 1.0).alias("current_price")))


@query(W + "(SELECT symbol, composite_score, 'top' AS side FROM scores ORDER BY composite_score DESC, symbol LIMIT 10) UNION ALL (SELECT symbol, composite_score, 'bottom' FROM scores ORDER BY composite_score, symbol DESC LIMIT 5)")
def top_bottom(spark, d):
    return screen.top_bottom(scores(spark, d)).select("symbol", "composite_score", "side")


@query("WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT event_type, event_id, position::INT AS position, greatest(c - 10, 0) AS more FROM n WHERE position <= 10")
def examples_per_category(spark, d):
    return rollup.examples(table(spark, d, "events").select("event_type", "event_id"), "event_type", ["event_id"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1995")
def filter_year(spark, d):
    return screen.filter_year(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 1995)


@query("SELECT l_suppkey, l_returnflag AS statement, string_agg(m || ':' || p || '=' || v, ';' ORDER BY m, p) AS facts FROM (SELECT l_suppkey, l_returnflag, l_linestatus AS m, year(l_shipdate)::VARCHAR AS p, count(*) AS v FROM lineitem GROUP BY ALL) GROUP BY ALL")
def facts_to_maps(spark, d):
    facts = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("statement"), F.col("l_linestatus").alias("metric"), F.year("l_shipdate").cast("string").alias("period")).agg(F.count("*").alias("value"))
    maps = documents.facts_to_maps(facts, ["l_suppkey"])
    back = documents.maps_to_facts(maps.select("l_suppkey", F.col("statement").alias("kind"), F.col("facts").alias("all")), ["l_suppkey", "kind"], ["all"])
    text = F.concat("metric", F.lit(":"), "period", F.lit("="), F.col("value").cast("string"))
    return back.groupBy("l_suppkey", F.col("kind").alias("statement")).agg(F.array_join(F.sort_array(F.collect_list(text)), ";").alias("facts"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -c_custkey, 0 FROM customer WHERE c_custkey % 10 = 0")
def upsert_documents(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where("c_custkey % 10 = 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")))
    return documents.upsert_documents(c, new, ["c_custkey"])


def event_parts(spark, d):
    """The events as ratings, split over files that a stream reads one after the other."""
    path = stage.new_path(spark, "event-parts")
    rows = table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.col("event_type").alias("persona"), (F.col("event_id") % 11).alias("score"), "event_id")
    rows.repartition(4).write.parquet(path)
    return streams.stream_files(spark, path, "symbol long, persona string, score long, event_id long", files_per_batch=2)


@query("WITH l AS (SELECT user_id AS symbol, event_type, event_id % 11 AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1) SELECT symbol, sum(score)::BIGINT AS composite_score, count(*) AS coverage, CASE WHEN sum(score) >= 36 THEN 'BUY' WHEN sum(score) >= 24 THEN 'HOLD' ELSE 'AVOID' END AS consensus_recommendation FROM l GROUP BY symbol")
def stream_ratings(spark, d):
    path = stage.new_path(spark, "stream-ratings")
    streams.stream_ratings(event_parts(spark, d), f"{path}/table", f"{path}/checkpoint", ["symbol", "persona"], ["event_id"]).awaitTermination()
    streams.compact_ratings(spark, f"{path}/table", ["symbol", "persona"], ["event_id"], f"{path}/compact")
    return rollup.composite_scores(documents.read_table(spark, f"{path}/compact"), "symbol", buy=BUY, hold=HOLD)


@query("SELECT user_id AS symbol, sum(event_id % 11)::BIGINT AS composite_score, count(*) AS coverage, CASE WHEN sum(event_id % 11) >= 36 THEN 'BUY' WHEN sum(event_id % 11) >= 24 THEN 'HOLD' ELSE 'AVOID' END AS consensus_recommendation FROM events GROUP BY user_id")
def stream_composite(spark, d):
    path = stage.new_path(spark, "stream-composite")
    streams.run_to_table(streams.stream_composite(event_parts(spark, d), "symbol", buy=BUY, hold=HOLD), f"{path}/table", f"{path}/checkpoint")
    return documents.read_table(spark, f"{path}/table")


@query("SELECT s_suppkey % 3 AS kind, count(*) AS n, count(*) FILTER (s_suppkey % 3 <> 1) AS priced, round(sum(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 0.5 WHEN s_suppkey % 3 = 2 THEN s_suppkey END::DOUBLE), 6) AS total, count(*) FILTER (s_suppkey % 4 = 0) AS texts, sum(s_nationkey)::BIGINT AS first_period, max(s_name) AS name FROM supplier GROUP BY ALL")
def typed_documents(spark, d):
    """Documents of no known schema to one typed table; a field of two types stays open, periods become a map."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    price = F.when(k % 3 == 0, F.concat(F.lit(', "price": '), n, F.lit(".5"))).when(k % 3 == 1, ', "price": null').otherwise(F.concat(F.lit(', "price": '), n))
    text = F.concat(F.lit('{"info": {"name": "'), "s_name", F.lit('"'), price, F.lit(', "mixed": '), F.when(k % 4 == 0, '"text"').otherwise(n), F.lit('}, "facts": {"'), n, F.lit('": '), F.col("s_nationkey").cast("string"), F.lit("}}"))
    docs = table(spark, d, "supplier").select("s_suppkey", F.parse_json(text).alias("doc"))
    rows = infer.write_typed(docs, stage.new_path(spark, "typed-documents"), ["s_suppkey"], types={"facts": "map<string,bigint>"})
    texts = F.count_if(F.schema_of_variant("info.mixed") == "STRING")
    return rows.groupBy((k % 3).alias("kind")).agg(F.count("*").alias("n"), F.count("info.price").alias("priced"), F.round(F.sum("info.price"), 6).alias("total"), texts.alias("texts"), F.sum(F.col("facts")[n]).alias("first_period"), F.max("info.name").alias("name"))


RUBRIC_ROWS = ", ".join(f"('{slug}', '{band}', {band.split('-')[0]}, {band.split('-')[1]}, '{text}')" for slug, texts in dimension.RUBRICS.items() for band, text in zip(dimension.BANDS, texts, strict=True))


@query(
    f"""WITH b AS (SELECT * FROM (VALUES {RUBRIC_ROWS}) b(persona, band, low, high, meaning)), g AS (SELECT i, persona FROM (SELECT row_number() OVER (ORDER BY p) - 1 AS i, p AS persona FROM (SELECT unnest({list(dimension.SLUGS)}) AS p))),
e AS (SELECT event_id, g.persona, (event_id % 23) / 2.0 AS score FROM events JOIN g ON g.i = event_id % 11)
SELECT e.event_id, e.persona, e.score, b.band, b.meaning FROM e LEFT JOIN b ON b.persona = e.persona AND e.score >= b.low AND e.score <= b.high"""
)
def rubric_bands(spark, d):
    """Scores, halves too, with what their rater means by them: an interval join with the bands of all raters."""
    order = F.array(*[F.lit(s) for s in sorted(dimension.SLUGS)])
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.get(order, (k % 11).cast("int")).alias("persona"), ((k % 23) / 2.0).alias("score")).where("persona IS NOT NULL")
    return rules.band_join(rows, "score", dimension.rubrics(spark), ["persona"]).select("event_id", "persona", "score", "band", "meaning")


@query("WITH c AS (SELECT event_type, round(min(value), 2) AS low FROM events GROUP BY event_type, user_id), b AS (SELECT event_type, low, lead(low) OVER (PARTITION BY event_type ORDER BY low) AS high FROM (SELECT DISTINCT event_type, low FROM c)) SELECT e.event_type, b.low, b.high, count(*) AS n FROM events e JOIN b ON e.event_type = b.event_type AND e.value >= b.low AND (b.high IS NULL OR e.value < b.high) GROUP BY ALL")
def value_bands(spark, d):
    """Many bands cut from the data itself, at the least value of each user: closed below, open above, the last without an end."""
    e = table(spark, d, "events").select("event_type", "value", "user_id")
    cuts = e.groupBy("event_type", "user_id").agg(F.round(F.min("value"), 2).alias("low")).select("event_type", "low").distinct()
    above = F.lead("low").over(Window.partitionBy("event_type").orderBy("low"))
    bands = cuts.select("event_type", "low", above.alias("high"), F.lit(True).alias("high_open"), F.col("low").alias("band_low"), above.alias("band_high"))
    found = rules.band_join(e, "value", bands, ["event_type"], outer=False)
    return found.groupBy("event_type", F.col("band_low").alias("low"), F.col("band_high").alias("high")).agg(F.count("*").alias("n"))


@query(W + """, c AS (SELECT symbol, CASE symbol % 4 WHEN 0 THEN NULL WHEN 1 THEN ['RO', 'AF', 'RO', 'XX'] WHEN 2 THEN ['XX'] ELSE ['NF'] END AS chosen FROM scores),
k AS (SELECT symbol, CASE symbol % 4 WHEN 1 THEN ['AF', 'RO'] WHEN 3 THEN ['NF'] ELSE ['AF', 'AO', 'NF', 'NO', 'RF', 'RO'] END AS known FROM c)
SELECT k.symbol, coalesce(sum(score) FILTER (list_contains(known, persona)), 0)::BIGINT AS composite_score, (10 * len(any_value(known)))::INT AS max_score FROM k JOIN ratings r ON r.symbol = k.symbol GROUP BY k.symbol""")
def chosen_raters(spark, d):
    """Composites over a choice of raters of each row; unknown and repeated ones do not count."""
    rows = rollup.persona_scores(ratings(spark, d), "symbol", "persona")
    k = F.col("symbol") % 4
    chosen = F.when(k == 1, F.array(*map(F.lit, ("RO", "AF", "RO", "XX")))).when(k == 2, F.array(F.lit("XX"))).when(k == 3, F.array(F.lit("NF")))
    return screen.restrict_by_choice(rows.withColumn("chosen", chosen), "chosen", RATERS).select("symbol", "composite_score", "max_score")


LATEST_EVENTS = "l AS (SELECT user_id AS symbol, event_type, event_id % 11 AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)"


@query(f"WITH {LATEST_EVENTS}, s AS (SELECT symbol, sum(score)::BIGINT AS composite_score, count(*) AS coverage FROM l GROUP BY symbol) SELECT *, rank() OVER (ORDER BY composite_score DESC) AS rank FROM s")
def stream_view(spark, d):
    """Ratings that overwrite each other, batch by batch: scores and ranks kept up to date by what each batch touches."""
    path = stage.new_path(spark, "stream-view")
    view = incremental.ViewStore(spark, f"{path}/store", "symbol", "persona", ["event_id"], buckets=8, width=10)
    incremental.stream_view(event_parts(spark, d), view, f"{path}/checkpoint").awaitTermination()
    return view.ranked().select("symbol", "composite_score", "coverage", "rank")


@query(f"WITH {LATEST_EVENTS} SELECT symbol, sum(score)::BIGINT AS composite_score, count(*) AS coverage, CASE WHEN sum(score) >= 36 THEN 'BUY' WHEN sum(score) >= 24 THEN 'HOLD' ELSE 'AVOID' END AS consensus_recommendation FROM l GROUP BY symbol")
def stream_stateful(spark, d):
    """The running composite from keyed state, its changes merged into a bucketed table."""
    path = stage.new_path(spark, "stream-stateful")
    store = BucketStore(spark, f"{path}/store", buckets=8)
    updates = stateful.running_composite(event_parts(spark, d), "symbol", "persona", "event_id", buy=BUY, hold=HOLD)
    stateful.upsert_updates(updates, store, "symbol", f"{path}/checkpoint").awaitTermination()
    return store.read("composite")


@query("SELECT 'seen' AS metric, count(*) AS value FROM events UNION ALL SELECT 'high', count(*) FILTER (event_id % 11 >= 6) FROM events UNION ALL SELECT 'clicks', count(*) FILTER (event_type = 'click') FROM events")
def stream_counts(spark, d):
    """What a stream's listener has counted while the stream was written."""
    path = stage.new_path(spark, "stream-counts")
    name = path.rsplit("/", 1)[-1]
    log = listeners.ProgressLog({name})
    spark.streams.addListener(log)
    try:
        stream = listeners.count_by(event_parts(spark, d), "scores", {"high": F.col("score") >= 6, "clicks": F.col("persona") == "click"})
        stream.writeStream.queryName(name).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        listeners.wait_for_events(spark)
    finally:
        spark.streams.removeListener(log)
    log.save(spark, f"{path}/log")
    return spark.read.parquet(f"{path}/log").where("metric <> 'batch_ms'").groupBy("metric").agg(F.sum("value").alias("value"))


@query("SELECT count(*) AS seen, count(*) FILTER (o_orderstatus = 'F') AS skipped, count(*) FILTER (o_orderstatus <> 'F') AS pending, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS written FROM orders")
def selection_counts(spark, d):
    """Work still to do, written, with the numbers of what was skipped counted in the same pass."""
    path = stage.new_path(spark, "pending-orders")
    tests = {"skipped": F.col("o_orderstatus") == "F", "pending": F.col("o_orderstatus") != "F"}
    _, counts = listeners.run_counted(table(spark, d, "orders"), tests, lambda df: df.where("o_orderstatus <> 'F'").write.parquet(path))
    return spark.read.parquet(path).agg(*[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()], F.count("*").alias("written"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey <> 0 UNION ALL SELECT -c_custkey, 0.0 FROM customer WHERE c_custkey % 10 = 0")
def bucket_upsert(spark, d):
    """The upsert of upsert_documents into a bucketed table with a manifest; only touched buckets are written again."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    store = BucketStore(spark, stage.new_path(spark, "bucket-store"), buckets=16)
    store.upsert("customers", c, ["c_custkey"])
    store.upsert("customers", c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])
    store.upsert("customers", c.where("c_custkey % 10 = 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")), ["c_custkey"])
    store.vacuum(keep=1)
    return store.read("customers")


SCREEN_SQL = {
    "deep_value": ["price < sqrt(CASE WHEN eps > 0 AND book_value > 0 THEN 22.5 * eps * book_value END)", "pe < 15", "price / nullif(book_value, 0) < 1.5", "current_ratio > 2", "debt_to_equity < 0.5", "dividend_yield > 0.02"],
    "earnings_quality": ["roic > 0.15", "fcf / nullif(net_income, 0) > 0.8", "debt / nullif(ebitda, 0) < 2.5"],
    "growth_quality": ["revenue_growth >= 0.2", "earnings_growth >= 0.2", "roe > 0.2", "debt_to_equity < 0.5"],
    "risk_first": ["fcf / nullif(market_cap, 0) > 0.06", "debt / nullif(ebitda, 0) < 3"],
    "owner_growth": ["pe BETWEEN 12 AND 25", "revenue_growth >= 0.12", "roe > 0.15", "debt_to_equity < 0.6", "promoter > 0.5"],
    "conservative": ["pe BETWEEN 12 AND 20", "roe > 0.15", "debt_to_equity < 0.3", "current_ratio > 1.5", "fcf / nullif(market_cap, 0) > 0.05", "promoter > 0.55"],
    "small_cap": ["market_cap_cr BETWEEN 100 AND 1000", "pe BETWEEN 8 AND 15", "revenue_growth >= 0.15", "debt_to_equity < 0.4", "promoter > 0.5"],
}
#: Ratios of the screens as whole-number remainders of the part's key, null where a remainder is 0; the same text on both sides.
MEASURES = {
    "price": "nullif(p_partkey % 7, 0) * 20.0", "eps": "(p_partkey % 5 - 1) * 2.0", "book_value": "(p_partkey % 9 - 1) * 10.0", "pe": "nullif(p_partkey % 31, 0) * 1.0", "current_ratio": "nullif(p_partkey % 6, 0) / 2.0", "debt_to_equity": "nullif(p_partkey % 11, 0) / 16.0",
    "dividend_yield": "nullif(p_partkey % 8, 0) / 128.0", "roic": "nullif(p_partkey % 13, 0) / 64.0", "fcf": "(p_partkey % 10 - 3) * 1.0", "net_income": "(p_partkey % 12) * 1.0", "debt": "(p_partkey % 17) * 1.0", "ebitda": "(p_partkey % 4) * 2.0",
    "revenue_growth": "nullif(p_partkey % 19, 0) / 64.0", "earnings_growth": "nullif(p_partkey % 23, 0) / 64.0", "roe": "nullif(p_partkey % 29, 0) / 128.0", "market_cap": "(p_partkey % 3) * 32.0", "promoter": "nullif(p_partkey % 37, 0) / 64.0", "market_cap_cr": "nullif(p_partkey % 14, 0) * 90.0",
}


@query(
    "WITH v AS (SELECT p_partkey, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in MEASURES.items()) + " FROM part), r AS ("
    + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS screen, [{', '.join(rules_)}] AS t FROM v" for n, rules_ in SCREEN_SQL.items())
    + ") SELECT p_partkey AS symbol, screen, len(list_filter(t, lambda x: x))::INT AS passed, len(list_filter(t, lambda x: x IS NOT NULL))::INT AS known, array_to_string(list_transform(t, lambda x: CASE WHEN x THEN 'pass' WHEN NOT x THEN 'fail' ELSE 'unknown' END), ',') AS outcome FROM r"
)
def threshold_screens(spark, d):
    v = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), *[F.expr(f"cast({e} AS double)").alias(n) for n, e in MEASURES.items()])
    out = v
    for name in SCREEN_SQL:
        out = rules.apply_screen(out, name)
    each = [F.struct(F.lit(n).alias("screen"), F.col(f"{n}_passed").alias("passed"), F.col(f"{n}_known").alias("known"), F.concat_ws(",", *[f"{n}_{rule}" for rule in rules.SCREENS[n]]).alias("outcome")) for n in SCREEN_SQL]
    return out.select("symbol", F.explode(F.array(*each)).alias("s")).select("symbol", "s.*")


@query(W + "SELECT symbol, persona, score, band, persona || ' ' || meaning AS meaning FROM ratings, (VALUES ('9-10', 9, 10, 'exceptional'), ('7-8', 7, 8, 'good'), ('4-6', 4, 6, 'average'), ('2-3', 2, 3, 'weak'), ('0-1', 0, 1, 'poor')) v(band, low, high, meaning) WHERE score BETWEEN low AND high")
def rubric_by_rater(spark, d):
    view = ratings(spark, d)
    general = spark.createDataFrame(list(rules.BANDS), "band string, low int, high int, meaning string")
    own = general.crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in RATERS], "persona string")))
    own = own.withColumn("meaning", F.concat_ws(" ", "persona", "meaning"))
    return rules.rubric_band(view, "score", "persona", own).select("symbol", "persona", "score", "band", "meaning")


def analysis_text(spark, d):
    """One rater's answer as JSON for each supplier and return flag, with faults planted by the supplier's number."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("persona")).agg((F.sum(F.col("l_quantity").cast("bigint")) % 11).alias("score"))
    k = F.col("k")

    def quoted(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    score = F.when(k % 13 == 0, "4.5").when(k % 13 == 1, '"4"').when(k % 13 == 2, "12").when(k % 13 == 3, "3.0").when(k % 13 == 4, "null").otherwise(F.col("score").cast("string"))
    rec = F.when(k % 11 == 0, quoted(F.lit("MAYBE"))).when(k % 11 == 1, "5").when(k % 11 == 2, "null").when(k % 11 == 3, "5.5").when(k % 11 == 4, '["BUY"]').otherwise(quoted(recommendation(F.col("score"))))
    risks = F.when(k % 7 == 0, "[]").otherwise('["debt"]')
    thesis = F.when(k % 41 == 0, "5").when(k % 5 == 0, quoted(F.lit(" too short "))).otherwise(quoted(F.concat(F.lit("thesis of supplier number "), k.cast("string"))))
    metrics = F.when(k % 17 == 0, "[]").when(k % 17 == 3, "null").when(k % 17 == 1, '{"moat_strength": "huge", "management_quality": "good", "financial_health": "good", "valuation": "fair"}').otherwise('{"moat_strength": "weak", "management_quality": "good", "financial_health": "good", "valuation": "fair", "growth_potential": "low"}')
    metrics = F.when(k % 17 == 2, F.replace(metrics, F.lit("}"), F.lit(', "luck": "good"}'))).otherwise(metrics)
    flags = F.when(k % 19 == 0, "").otherwise('"red_flags": [], "detailed_analysis": "a text of more than twenty characters", ')
    body = F.concat(F.lit('{"score": '), score, F.lit(', "recommendation": '), rec, F.lit(', "investment_thesis": '), thesis, F.lit(', "key_strengths": ["name"], "key_risks": '), risks, F.lit(", "), flags, F.lit('"metrics_evaluated": '), metrics, F.when(k % 23 == 0, "").otherwise("}"))
    return rows.select("k", "persona", F.col("score").alias("true_score"), body.alias("response"))


ANSWERS = """a AS (SELECT l_suppkey AS k, l_returnflag AS persona, sum(trunc(l_quantity))::BIGINT % 11 AS s FROM lineitem GROUP BY ALL),
b AS (SELECT *, k % 23 = 0 AS broken, CASE WHEN k % 13 IN (0, 1, 2, 4) THEN NULL WHEN k % 13 = 3 THEN 3 ELSE s END AS score, CASE WHEN k % 11 IN (0, 1, 2, 3, 4) THEN NULL WHEN s >= 6 THEN 'BUY' WHEN s >= 4 THEN 'HOLD' ELSE 'AVOID' END AS rec FROM a),
c AS (SELECT *, broken OR k % 31 = 0 AS unread, k % 29 = 0 OR k % 37 = 0 AS bare, score IS NOT NULL AND rec IS NOT NULL AND ((rec = 'BUY' AND score <= 3) OR (rec = 'AVOID' AND score >= 8) OR (rec = 'HOLD' AND (score >= 9 OR score <= 1))) AS clash FROM b)"""


@query(
    "WITH " + ANSWERS + """, i AS (
  SELECT k, persona, 'parse_errors' AS category FROM c WHERE unread
  UNION ALL SELECT k, persona, 'missing_fields' FROM c WHERE NOT unread AND bare
  UNION ALL SELECT k, persona, 'missing_fields' FROM c WHERE NOT unread AND NOT bare AND k % 19 = 0
  UNION ALL SELECT k, persona, 'missing_fields' FROM c WHERE NOT unread AND NOT bare AND k % 17 = 1
  UNION ALL SELECT k, persona, 'score_out_of_range' FROM c WHERE NOT unread AND NOT bare AND k % 13 IN (0, 1, 2)
  UNION ALL SELECT k, persona, 'invalid_recommendation' FROM c WHERE NOT unread AND NOT bare AND k % 11 IN (0, 1, 3, 4)
  UNION ALL SELECT k, persona, 'score_recommendation_mismatch' FROM c WHERE NOT unread AND NOT bare AND clash
  UNION ALL SELECT k, persona, 'empty_arrays' FROM c WHERE NOT unread AND NOT bare AND k % 7 = 0
  UNION ALL SELECT k, persona, 'empty_strings' FROM c WHERE NOT unread AND NOT bare AND (k % 5 = 0 OR k % 41 = 0)
  UNION ALL SELECT k, persona, 'invalid_metric_values' FROM c WHERE NOT unread AND NOT bare AND k % 17 IN (0, 1, 2))
SELECT 'S' || k || '/' || persona AS key, category, count(*) AS n FROM i GROUP BY ALL"""
)
def file_issues(spark, d):
    """Answers as files {symbol}/{persona}.json, read back by their bytes and checked."""
    found = audit.document_issues(documents.read_ratings(spark, answer_files(spark, d)))
    return found.groupBy("key", "category").agg(F.count("*").alias("n"))


def answer_files(spark, d) -> str:
    """The folder of answers as files; some have no analysis or a text in its place, some end early, some are no UTF-8."""
    rows = analysis_text(spark, d)
    k = F.col("k")
    body = F.when(k % 29 == 0, F.replace("response", F.lit('{"score"'), F.lit('{"analysis": null, "other": {"score"')))
    body = body.when((k % 37 == 0) & (k % 23 != 0), '{"analysis": "only a text"').otherwise(F.concat(F.lit('{"analysis": '), "response"))
    text = F.concat(body, F.when(k % 23 == 0, "").otherwise("}"))
    files = rows.select(F.concat(F.lit("S"), k.cast("string"), F.lit("/"), "persona", F.lit(".json")).alias("name"), F.when(k % 31 == 0, F.unhex(F.lit("7BFFFE7D"))).otherwise(F.encode(text, "UTF-8")).alias("text"))
    folder = stage.new_path(spark, "rater-files")
    documents.write_documents(files, folder, "name", "text").write.format("noop").mode("overwrite").save()
    return folder


@query(
    "WITH " + ANSWERS + """ SELECT persona, count(*) AS files, count(*) FILTER (unread) AS unread, count(*) FILTER (NOT unread AND NOT bare AND score IS NOT NULL) AS scored, (sum(score) FILTER (NOT unread AND NOT bare))::BIGINT AS total
FROM c WHERE persona IN ('A', 'R') GROUP BY persona"""
)
def rated_selection(spark, d):
    """Files of two raters by the source that opens no others."""
    rows = rated_files.read_rated(spark, answer_files(spark, d)).where(F.col("persona").isin("A", "R"))
    score = F.when(expr.integral_score(F.col("doc"), "$.analysis.score"), F.try_variant_get("doc", "$.analysis.score", "bigint"))
    return rows.groupBy("persona").agg(F.count("*").alias("files"), F.count_if("parse_error").alias("unread"), F.count(score).alias("scored"), F.sum(score).alias("total"))


@query(
    "WITH " + ANSWERS + """ SELECT k, persona, CASE WHEN broken THEN 'unparseable' WHEN score IS NULL THEN 'score' WHEN rec IS NULL THEN 'recommendation' WHEN k % 19 = 0 THEN 'missing_fields' WHEN clash THEN 'score_recommendation_mismatch'
  WHEN k % 17 = 1 THEN 'invalid_metric_values' WHEN k % 17 IN (0, 2) THEN 'invalid_metric_values' WHEN k % 7 = 0 THEN 'empty_arrays' WHEN k % 5 = 0 OR k % 41 = 0 THEN 'empty_strings' END AS reason, CASE WHEN reason IS NULL THEN score END::INT AS score FROM c"""
)
def accepted_answers(spark, d):
    taken, rest = enrich.ingest_responses(analysis_text(spark, d), ["k", "persona"], whole=True)
    return taken.select("k", "persona", F.lit(None).cast("string").alias("reason"), "score").unionByName(rest.select("k", "persona", "reason", F.lit(None).cast("int").alias("score")))


@query("SELECT 'S' || s_suppkey AS symbol, s_name AS name, round(s_acctbal, 2) AS price, CASE WHEN s_suppkey % 3 = 0 THEN 'Unknown' WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'x' END AS sector, 2 + (s_suppkey % 3 <> 0)::INT AS n_keys FROM supplier WHERE s_suppkey % 5 <> 0")
def stock_documents(spark, d):
    """Documents as files {symbol}.json, read back; broken ones have no document. Bulky keys are left out of the info."""
    k = F.col("s_suppkey")
    sector = F.when(k % 3 == 0, "").when(k % 3 == 1, ', "sector": null').otherwise(', "sector": "x"')
    info = F.concat(F.lit('{"name": "'), "s_name", F.lit('", "price": '), F.round("s_acctbal", 2).cast("string"), sector, F.lit("}"))
    files = table(spark, d, "supplier").select(F.concat(F.lit("S"), k.cast("string"), F.lit(".json")).alias("name"), F.concat(F.lit('{"info": '), info, F.when(k % 5 == 0, "").otherwise("}")).alias("text"))
    folder = stage.new_path(spark, "stock-files")
    documents.write_documents(files, folder, "name", "text").write.format("noop").mode("overwrite").save()
    docs = documents.read_documents(spark, folder).where("doc IS NOT NULL")
    keys = F.to_json(F.try_variant_get("doc", "$.info", "variant"))
    return docs.select("symbol", expr.get(F.col("doc"), "$.info.name", "string").alias("name"), expr.get(F.col("doc"), "$.info.price", "double").alias("price"), expr.get_or_unknown(F.col("doc"), "$.info.sector").alias("sector"), expr.key_count(keys).alias("n_keys"))


@query("SELECT 'P' || p_partkey AS symbol, p_name AS company_name, p_size::DOUBLE AS issue_price FROM part")
def listing_envelope(spark, d):
    """A registry written as one document per brand, {metadata, stocks}, and read back as rows."""
    part = table(spark, d, "part")
    stock = F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_name").alias("company_name"), F.col("p_size").cast("double").alias("issue_price"))
    bodies = part.groupBy("p_brand", F.pmod(F.xxhash64("p_partkey"), F.lit(64)).alias("salt")).agg(F.to_json(F.struct(F.struct(F.count("*").cast("int").alias("total_count")).alias("metadata"), F.collect_list(stock).alias("stocks"))).alias("text"))
    folder = stage.new_path(spark, "registry")
    bodies.select("text").write.text(folder)
    return documents.read_envelope_lines(spark, folder).select("symbol", "company_name", "issue_price")


@query(W + "SELECT (SELECT count(*) FROM scores) AS total, 'sum' AS method, row_number() OVER (ORDER BY composite_score DESC, symbol) AS rank, symbol, composite_score FROM scores")
def export_envelope(spark, d):
    ranked = rollup.rank_scores(scores(spark, d))
    text = documents.export_scores_json(ranked.select("rank", "symbol", "composite_score"), RATERS)
    body = F.from_json("json", "total bigint, method string, stocks array<struct<symbol:bigint,composite_score:bigint>>")
    rows = text.select(body.alias("e")).select("e.total", "e.method", F.posexplode("e.stocks").alias("pos", "s"))
    return rows.select("total", "method", (F.col("pos") + 1).cast("bigint").alias("rank"), "s.symbol", "s.composite_score")


@query("SELECT c_custkey, round(c_acctbal * 2, 2) AS c_acctbal FROM customer")
def table_versions(spark, d):
    """A table refreshed twice; readers see the last whole version."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    path = stage.new_path(spark, "versions")
    documents.write_table(c, path)
    documents.write_table(documents.read_table(spark, path).withColumn("c_acctbal", F.round(F.col("c_acctbal") * 2, 2)), path)
    return documents.read_table(spark, path)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'error' ELSE 'success' END AS fetch_status, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE 'full' END AS data_quality, false AS pending FROM customer WHERE c_custkey % 6 <> 0 UNION ALL SELECT c_custkey, NULL, NULL, true FROM customer WHERE c_custkey % 6 = 0")
def quarantined(spark, d):
    """Failed fetches leave error rows, which count as done."""
    c = table(spark, d, "customer").select("c_custkey")
    fetched = c.where("c_custkey % 6 <> 0").withColumns({"fetch_status": F.lit("success"), "data_quality": F.lit("full")})
    good, bad = documents.quarantine(fetched, F.col("c_custkey") % 4 != 0)
    done = good.unionByName(bad)
    left = documents.pending(c, done, ["c_custkey"]).withColumns({"fetch_status": F.lit(None).cast("string"), "data_quality": F.lit(None).cast("string"), "pending": F.lit(True)})
    return done.withColumn("pending", F.lit(False)).unionByName(left)


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS q FROM customer)
SELECT 'unresolved' AS test, k FROM c WHERE k % 3 <> 0 AND k % 5 <> 0 UNION ALL SELECT 'incomplete', k FROM c WHERE q IN (1, 2) UNION ALL SELECT 'analyzable', k FROM c WHERE q = 0 AND k % 7 <> 0
UNION ALL SELECT 'by_key', k FROM c WHERE q = 3 AND k % 7 = 1 UNION ALL (SELECT 'limited', k FROM c ORDER BY k DESC LIMIT 25) UNION ALL SELECT 'all', k FROM c UNION ALL SELECT DISTINCT 'options', q FROM c UNION ALL SELECT 'pages', k FROM c WHERE q = 0 UNION ALL SELECT 'pages', k FROM c WHERE q < 2"""
)
def selections(spark, d):
    k = F.col("k")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).withColumns({
        "q": k % 4, "yf_symbol": F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, "").otherwise("x"), "data_quality": F.element_at(F.array(*map(F.lit, ("full", "partial", "minimal", "limited"))), (k % 4 + 1).cast("int")),
        "fetch_status": F.when(k % 7 == 0, "error").when(k % 7 != 1, "success"),
    })
    parts = {
        "unresolved": screen.drop_unresolved(c), "incomplete": screen.only_incomplete(c, c, "k"), "analyzable": screen.analyzable(c), "by_key": screen.by_key(c.withColumn("r", k % 7), q=3, r=1), "limited": screen.limit_items(c.withColumn("o", -k), 25, ["o"]),
        "all": screen.limit_items(c, 0, ["k"]), "options": screen.options(c, "q").select(F.col("q").alias("k")), "pages": joins.union_pages(c.where("q = 0"), c.where("q < 2")),
    }
    return joins.union_pages(*[df.select(F.lit(name).alias("test"), "k") for name, df in parts.items()])


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 = 0 THEN 'N' || c_custkey WHEN c_custkey % 3 <> 0 AND c_custkey % 4 = 1 THEN c_custkey::VARCHAR ELSE 'id' || c_custkey END AS identifier,
  CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 'symbol' WHEN c_custkey % 4 = 1 THEN 'bse_code' ELSE 'screener_id' END AS id_type FROM customer"""
)
def resolved_ids(spark, d):
    """Identifiers resolved by the codes named on each company's page."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey")
    listing = c.withColumns({"identifier": F.concat(F.lit("id"), k.cast("string")), "id_type": F.when(k % 3 == 0, "symbol").otherwise("screener_id")})
    text = F.when(k % 4 == 0, F.concat(F.lit("BSE: 77 NSE: N"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("BSE - SME: "), k.cast("string"))).when(k % 4 == 2, "no codes")
    pages = c.where(k % 8 != 7).select("c_custkey", parse.page_ids(text).alias("p")).select("c_custkey", "p.nse", "p.bse")
    return joins.resolve_ids(listing, pages, "c_custkey")


@query(
    """WITH c AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN -'inf'::DOUBLE ELSE round(o_totalprice, 2) END AS v FROM orders), f AS (SELECT o_orderkey, CASE WHEN isfinite(v) THEN v END AS v FROM c)
SELECT o_orderkey, v AS finite, coalesce(CASE WHEN v * 10 >= 100000 THEN printf('%.2f', v * 10 / 100000) || 'L Cr' WHEN v * 10 >= 10000 THEN printf('%.1f', v * 10 / 1000) || 'K Cr' ELSE format('{:,}', round_even(v * 10, 0)::BIGINT) || ' Cr' END, 'N/A') AS cap,
  coalesce('₹' || format('{:,}', trunc(v)::BIGINT) || right(printf('%.2f', v), 3), 'N/A') AS price, coalesce(printf('%.1f', v / 1000), 'N/A') AS pe FROM f"""
)
def format_figures(spark, d):
    k = F.col("o_orderkey")
    v = F.when(k % 9 == 0, F.lit(None).cast("double")).when(k % 9 == 1, float("nan")).when(k % 9 == 2, float("-inf")).otherwise(F.round("o_totalprice", 2))
    rows = screen.finite(table(spark, d, "orders").select("o_orderkey", v.alias("v"), v.alias("finite")), ["finite"])
    return rows.select("o_orderkey", "finite", expr.format_market_cap(F.col("v") * 10).alias("cap"), expr.format_price(F.col("v")).alias("price"), expr.format_pe(F.col("v") / 1000).alias("pe"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'b,d' ELSE 'd' END AS kept FROM orders")
def dropped_fields(spark, d):
    k = F.col("o_orderkey")
    fields = F.when(k % 2 == 0, F.create_map(*[F.lit(x) for x in "a1b2c3d4"])).otherwise(F.create_map(*[F.lit(x) for x in "c3d4"]))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(F.map_keys(expr.drop_fields(fields, ["a", "c"]))), ",").alias("kept"))


@query("SELECT s_suppkey, s_name || '=' || round(s_acctbal, 1) || ';P/E=' || s_suppkey AS ratios, 'first of ' || s_suppkey AS about, CASE WHEN s_suppkey % 2 = 0 THEN 'X' || s_suppkey END AS nse, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR END AS bse, 5 AS facts, 'balance_sheet,cash_flow,profit_loss,quarterly_results,shareholding' AS statements FROM supplier")
def company_pages(spark, d):
    """A company page's ratios, description, codes and all five statements."""
    k = F.col("s_suppkey").cast("string")

    def block(head, tail, name):
        return F.concat(F.lit(f"{head}<table><tr><th><th>2024</tr><tr><td>{name}<td>"), k, F.lit(f"</tr></table>{tail}"))

    ratios = F.concat(F.lit("<ul><li><span class='name'>P/E</span><span class='number'>0</span><li><span class='name'>P/E</span> <span class='value'>"), k, F.lit("</span><li><span class='name'>"), "s_name", F.lit("</span><span class='number'>"), F.round("s_acctbal", 1).cast("string"), F.lit("</span></ul>"))
    codes = F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("<p>NSE: X"), k)).otherwise(""), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" BSE: "), k)).otherwise(""))
    about = F.concat(F.lit("<div class='about'><p>first of "), k, F.lit("<p>second</div>"))
    page = F.concat(ratios, about, block("", "", "Sales"), block("", "", "Profit"), block("<section id='balance-sheet'>", "</section>", "Assets"), block("<section id='cash-flow'>", "</section>", "Cash"), block("<section id='shareholding'>", "</section>", "Owners"))
    rows = table(spark, d, "supplier").select("s_suppkey", page.alias("html"), parse.page_ids(codes).alias("ids"))
    key = ["s_suppkey"]
    items = stage.written(html.page_items(rows, key), "page-items")
    pairs = html.html_name_value(items, key).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.when(F.col("name") == "P/E", 1).otherwise(0).alias("o"), "name", "value"))), lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";").alias("ratios"))
    facts = html.company_facts_from_pages(items, key).groupBy(*key).agg(F.count("*").cast("int").alias("facts"), F.array_join(F.sort_array(F.collect_set("statement")), ",").alias("statements"))
    return rows.select("s_suppkey", "ids.nse", "ids.bse").join(pairs, key).join(html.html_section_text(items, key), key).join(facts, key)


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total_cost, sum(event_id % 1000)::BIGINT AS total_input_tokens, sum(user_id)::BIGINT AS total_output_tokens FROM events GROUP BY event_type")
def usage_tokens(spark, d):
    usage = F.struct(F.struct((F.col("event_id") % 1000).alias("input_tokens"), F.col("user_id").alias("output_tokens")).alias("usage"), F.col("value").alias("total_cost_usd"), F.col("user_id").alias("duration_ms")).alias("metadata")
    out = rollup.usage_rollup(table(spark, d, "events").select("event_type", usage), ["event_type"], "metadata.total_cost_usd", "metadata.duration_ms", ["metadata.usage.input_tokens", "metadata.usage.output_tokens"])
    return out.select("event_type", "calls", F.round("total_cost", 4).alias("total_cost"), "total_input_tokens", "total_output_tokens")


@query("SELECT 2 AS batches, count(*)::BIGINT AS total, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS pct FROM events")
def stream_progress(spark, d):
    path = stage.new_path(spark, "stream-progress")
    streams.stream_progress(event_parts(spark, d), f"{path}/notes", f"{path}/checkpoint").awaitTermination()
    over_time = streams.progress_over_time(spark.read.parquet(f"{path}/notes"), table(spark, d, "orders"))
    return over_time.agg(F.count("*").cast("int").alias("batches"), F.max("total").alias("total"), F.round(F.max("pct"), 6).alias("pct"))


@query(W + "SELECT s.symbol, coalesce(r.score, 0)::BIGINT AS score, k.n AS known FROM scores s LEFT JOIN ratings r ON r.symbol = s.symbol AND r.persona = 'RO' LEFT JOIN (SELECT symbol, count(*) FILTER (persona IN ('RO', 'AF')) AS n FROM ratings GROUP BY symbol) k ON k.symbol = s.symbol")
def rater_order(spark, d):
    view = ratings(spark, d)
    known = view.groupBy("symbol").agg(F.lit(0).alias("zero")).join(joins.known_raters(view, ["RO", "AF", "ZZ"], "persona").groupBy("symbol").agg(F.count("*").alias("n")), "symbol", "left")
    wide = scores(spark, d).join(rollup.persona_scores(view, "symbol", "persona"), "symbol").join(known.select("symbol", F.coalesce("n", F.lit(0)).alias("known")), "symbol")
    return screen.order_by_rater(wide, "RO").select("symbol", expr.map_or_zero(F.col("persona_scores"), "RO").alias("score"), "known")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in REGISTRY.items() if s}
