"""HTML pages to tables: cells, name-value lists, sections and links in one pass over each page, everything else in Spark."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scorefold.functions import parse

ITEM = "kind string, table_idx int, section_id string, row_idx int, col_idx int, is_header boolean, text string, href string"


class Page(HTMLParser):
    """Collects items of four kinds: cell, pair (li with name and number), about (paragraph of a section), link."""

    def __init__(self, about: str = "about"):
        super().__init__(convert_charrefs=True)
        self.about, self.items, self.sections, self.tables = about, [], [], []
        self.seen_tables, self.li, self.span, self.link, self.div, self.paragraph = 0, None, None, None, [], None
        self.pairs = self.links = self.paragraphs = 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        names = (attrs.get("class") or "").split()
        if tag == "section":
            self.sections.append(attrs.get("id"))
        elif tag == "table":
            self.tables.append({"idx": self.seen_tables, "row": -1, "col": -1, "cell": None, "section": next((s for s in reversed(self.sections) if s), None)})
            self.seen_tables += 1
        elif tag == "tr" and self.tables:
            self.close_cell()
            t = self.tables[-1]
            t["pending"], t["col"] = True, -1
        elif tag in ("td", "th") and self.tables:
            self.close_cell()
            t = self.tables[-1]
            if t.pop("pending", False) or t["row"] < 0:
                t["row"] += 1
                t["col"] = -1
            t["col"] += 1
            t["cell"] = {"header": tag == "th", "text": [], "href": None}
        elif tag == "a":
            self.link = {"href": attrs.get("href"), "text": []}
            if self.tables and self.tables[-1]["cell"] and self.tables[-1]["cell"]["href"] is None:
                self.tables[-1]["cell"]["href"] = attrs.get("href")
        elif tag == "li":
            self.close_li()
            self.li = {}
        elif tag == "span" and self.li is not None:
            self.span = next((n for n in ("name", "number", "value") if n in names), self.span)
            if self.span:
                self.li.setdefault(self.span, [])
        elif tag == "div":
            self.div.append(self.about in names)
        elif tag == "p":
            self.close_paragraph()
            if any(self.div):
                self.paragraph = []

    def handle_endtag(self, tag):
        if tag == "section" and self.sections:
            self.sections.pop()
        elif tag in ("td", "th", "tr") and self.tables:
            self.close_cell()
        elif tag == "table" and self.tables:
            self.close_cell()
            self.tables.pop()
        elif tag == "a" and self.link:
            self.add("link", self.links, 0, "".join(self.link["text"]), self.link["href"])
            self.links += 1
            self.link = None
        elif tag == "li":
            self.close_li()
        elif tag == "span":
            self.span = None
        elif tag == "div" and self.div:
            self.close_paragraph()
            self.div.pop()
        elif tag == "p":
            self.close_paragraph()

    def handle_data(self, data):
        if self.tables and self.tables[-1]["cell"]:
            self.tables[-1]["cell"]["text"].append(data)
        if self.link:
            self.link["text"].append(data)
        if self.span and self.li is not None:
            self.li[self.span].append(data)
        if self.paragraph is not None:
            self.paragraph.append(data)

    def add(self, kind, row, col, text, href=None, table=None, section=None, header=None):
        self.items.append((kind, table, section, row, col, header, text.strip(), href))

    def close_cell(self):
        t = self.tables[-1]
        if t["cell"]:
            self.add("cell", t["row"], t["col"], "".join(t["cell"]["text"]), t["cell"]["href"], t["idx"], t["section"], t["cell"]["header"])
            t["cell"] = None

    def close_li(self):
        if self.li and "name" in self.li and ("number" in self.li or "value" in self.li):
            self.add("pair", self.pairs, 0, "".join(self.li["name"]), " ".join("".join(self.li.get("number", self.li.get("value"))).split()))
            self.pairs += 1
        self.li = self.span = None

    def close_paragraph(self):
        if self.paragraph is not None:
            self.add("about", self.paragraphs, 0, "".join(self.paragraph))
            self.paragraphs += 1
        self.paragraph = None

    def done(self):
        self.close()
        while self.tables:
            self.close_cell()
            self.tables.pop()
        self.close_li()
        self.close_paragraph()
        return self.items


def page_items(pages: DataFrame, keys: Sequence[str], html: str = "html", about: str = "about") -> DataFrame:
    """(keys, items...) of every page; null pages have none. The only Python job of the library: Arrow batches, one parser a page.

    Parsing a page takes longer than sending its text, so pages are dealt over all tasks first, also where one file holds them."""
    import pyarrow as pa

    keys = list(keys)
    extra = StructType.fromDDL(ITEM)
    schema = StructType([StructField(k, pages.schema[k].dataType) for k in keys] + extra.fields)

    def run(batches):
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            found, rows = [], []
            for k, text in enumerate(batch.column(html)):
                if text.is_valid:
                    page = Page(about)
                    page.feed(text.as_py())
                    items = page.done()
                    found += items
                    rows += [k] * len(items)
            take = pa.array(rows, pa.int64())
            columns = [batch.column(k).take(take) for k in keys]
            columns += [pa.array([x[c] for x in found], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *extra.names])

    spark = pages.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return pages.select(*keys, html).repartition(tasks, F.xxhash64(*keys, html)).mapInArrow(run, schema)


def html_cells(items: DataFrame) -> DataFrame:
    return items.where("kind = 'cell'").drop("kind")


def html_name_value(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, name, value): the last value of a repeated name."""
    return items.where("kind = 'pair' AND text <> ''").groupBy(*keys, F.col("text").alias("name")).agg(F.max_by("href", "row_idx").alias("value"))


def html_section_text(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, about): the first paragraph of the about section."""
    return items.where("kind = 'about'").groupBy(*keys).agg(F.min_by("text", "row_idx").alias("about"))


def html_links(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    return items.where("kind = 'link'").select(*keys, F.col("row_idx").alias("link_idx"), "text", "href")


def cells_to_facts(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, period, value) of tables whose first row holds the periods and first column the metrics.

    A repeated metric replaces the earlier one as a whole, a repeated period the earlier cell."""
    keys = [*keys, "table_idx"]
    header = cells.where("row_idx = 0 AND col_idx > 0").select(*keys, "col_idx", F.col("text").alias("period"))
    metric = cells.where("row_idx > 0 AND col_idx = 0").select(*keys, "row_idx", parse.strip(F.regexp_replace("text", r"[+\s]+$", "")).alias("metric")).where("metric <> ''")
    values = cells.where("row_idx > 0 AND col_idx > 0").select(*keys, "row_idx", "col_idx", parse.parse_number(F.col("text")).alias("value")).where("value IS NOT NULL")
    rows = values.join(metric, [*keys, "row_idx"]).join(header, [*keys, "col_idx"])
    last = rows.withColumn("last", F.max("row_idx").over(Window.partitionBy(*keys, "metric"))).where("row_idx = last")
    return last.groupBy(*keys, "metric", "period").agg(F.max_by("value", "col_idx").alias("value"))


def listing_from_pages(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each page's first table with at least six cells: company, link, listing date, prices and change."""
    cells = html_cells(items).where("table_idx = 0 AND row_idx > 0 AND NOT is_header")

    def col(n, what="text"):
        return F.max(F.when(F.col("col_idx") == n, F.col(what)))

    rows = cells.groupBy(*keys, "row_idx").agg(F.max("col_idx").alias("last"), col(0).alias("company_name"), col(0, "href").alias("href"), *[col(n).alias(f"c{n}") for n in range(1, 6)])
    c = {n: F.col(f"c{n}") for n in range(1, 6)}
    return rows.where("last >= 5").select(
        *keys, "row_idx", "company_name", "href", parse.extract_identifier(F.col("href")).alias("id"),
        parse.parse_listing_date(c[1]).alias("listing_date"), parse.parse_mcap(c[2]).alias("ipo_mcap_cr"),
        parse.parse_price(c[3]).alias("issue_price"), parse.parse_price(c[4]).alias("current_price"), parse.parse_pct_change(c[5]).alias("ipo_return_pct"),
    )


#: Statements by table position, and those found by their section.
BY_TABLE = {0: "quarterly_results", 1: "profit_loss"}
BY_SECTION = {"balance-sheet": "balance_sheet", "cash-flow": "cash_flow", "shareholding": "shareholding"}


def company_facts_from_pages(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, statement, metric, period, value) of a company page's tables."""
    cells = html_cells(items)
    place = F.create_map(*[F.lit(x) for pair in BY_TABLE.items() for x in pair])[F.col("table_idx")]
    section = F.create_map(*[F.lit(x) for pair in BY_SECTION.items() for x in pair])[F.col("section_id")]
    named = cells.withColumn("statement", F.coalesce(section, place)).where("statement IS NOT NULL")
    facts = cells_to_facts(named, [*keys, "statement"])
    return facts.drop("table_idx")
