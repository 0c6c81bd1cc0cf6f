"""Reading JSON documents into typed tables, and writing, merging and quarantining them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefold.sources import rated_files
from scorefold.sources.buckets import Conflict, ManifestLog

#: The contract of a rater's output.
ANALYSIS = (
    "struct<score:double,recommendation:string,investment_thesis:string,key_strengths:array<string>,key_risks:array<string>,red_flags:array<string>,"
    "detailed_analysis:string,metrics_evaluated:struct<moat_strength:string,management_quality:string,financial_health:string,valuation:string,growth_potential:string>>"
)
RATING = f"symbol string, persona string, persona_display_name string, analyzed_at string, analysis {ANALYSIS}, metadata struct<duration_ms:bigint,model_used:string,total_cost_usd:double,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>"
LISTING = "symbol string, company_name string, nse_symbol string, yf_symbol string, listing_date string, issue_price double, current_price double, ipo_return_pct double, ipo_mcap_cr double, screener_url string"
REGISTRY = f"metadata struct<generated_at:string,source:string,year:int,pages_scraped:int,total_count:int>, stocks array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in LISTING.split(','))}>>"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): one row per .json file with its bytes. Many tiny files are packed into few tasks by their open cost.

    Folders are listed by a job of a few tasks for each core, in place of one for every folder."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.json").load(path)
    finally:
        spark.conf.set(setting, before)
    return files.select("path", "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, doc, text): each JSON file as VARIANT, its name as symbol; a file that does not parse has a null doc, one that is
    no UTF-8 has no text either."""
    return rated_files.decode(read_raw(spark, path)).select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("symbol"), "doc", "text")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, persona, text, doc, parse_error, error): keys from the path {symbol}/{persona}.json; files that are no UTF-8 or
    no JSON stay as rows. For a few keys of many, `rated_files.read_rated` opens their folders only."""
    keys = r"([^/]+)/([^/]+)\.json$"
    raw = read_raw(spark, path).select(F.regexp_extract("path", keys, 1).alias("symbol"), F.regexp_extract("path", keys, 2).alias("persona"), "content")
    return rated_files.decode(raw)


def typed_ratings(raw: DataFrame) -> DataFrame:
    """(symbol, persona, score, recommendation, analyzed_at, analysis, metadata) of the readable files; keys come from the path."""
    parsed = F.from_json("text", "struct<" + ", ".join(x.strip().replace(" ", ":", 1) for x in _fields(RATING)) + ">")
    rows = raw.where(~F.col("parse_error")).select("symbol", "persona", parsed.alias("r"))
    return rows.where("r.analysis IS NOT NULL").select("symbol", "persona", F.col("r.analysis.score").cast("int").alias("score"), F.col("r.analysis.recommendation").alias("recommendation"), F.col("r.analyzed_at").alias("analyzed_at"), "r.analysis", "r.metadata")


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[last:k])
            last = k + 1
    return [*out, ddl[last:]]


def open_fields(df: DataFrame, keys: Sequence[str], doc: str = "doc", path: str = "$") -> DataFrame:
    """(keys, key, value): the fields of an object of unknown keys inside a VARIANT, one row each; values stay VARIANT."""
    part = df.select(*keys, F.try_variant_get(doc, path, "variant").alias("_part")).where("schema_of_variant(_part) LIKE 'OBJECT%'")
    return part.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_part").outer())).select(*keys, "key", "value")


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """The rows inside {metadata, stocks: [...]}."""
    return spark.read.schema(REGISTRY).json(path, multiLine=True).select(F.inline("stocks"))


def read_envelope_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows inside envelopes that stand one per line."""
    return spark.read.schema(REGISTRY).json(path).select(F.inline("stocks"))


def maps_to_facts(df: DataFrame, keys: Sequence[str], statements: Sequence[str]) -> DataFrame:
    """Columns of {metric: {period: value}} as long facts (keys, statement, metric, period, value); null values go."""
    parts = None
    for name in statements:
        part = df.select(*keys, F.lit(name).alias("statement"), F.explode(name).alias("metric", "periods")).select(*keys, "statement", "metric", F.explode("periods").alias("period", "value"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.where("value IS NOT NULL")


def facts_to_maps(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long facts back to {metric: {period: value}}, one map per key and statement; entries in name order."""
    inner = facts.groupBy(*keys, "statement", "metric").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("period", "value")))).alias("periods"))
    rows = inner.withColumn("text", F.struct("metric", F.sort_array(F.map_entries("periods")).alias("entries")))
    return rows.groupBy(*keys, "statement").agg(F.sort_array(F.collect_list("text")).alias("rows")).select(
        *keys, "statement", F.map_from_entries(F.transform("rows", lambda r: F.struct(r["metric"], F.map_from_entries(r["entries"])))).alias("facts")
    )


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write a full refresh beside the old version; the new folder comes back once it is the table's version: a manifest of the
    next number names it, which read_table shows from then on. Of two refreshes the one that commits last counts.

    With partition_by, only the partitions present in df are replaced, in place."""
    if partition_by:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
        return path
    log, folder = ManifestLog(df.sparkSession, path), f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{log.path}/{folder}")
    while True:
        try:
            log.create((log.versions() or [0])[-1] + 1, {"folder": folder})
            return f"{log.path}/{folder}"
        except Conflict:  # another refresh came first; this one follows it
            continue


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that the newest manifest of a table written by write_table names."""
    log = ManifestLog(spark, path)
    found = log.versions()
    return f"{log.path}/{log.read(found[-1])['folder']}" if found else None


def vacuum_table(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all versions but the last `keep`, while no refresh is between its data and its commit; how many folders went."""
    return ManifestLog(spark, path).keep_last(keep, lambda m: {m["folder"]})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table's current version; one that nothing was written to is an error."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(version)


def write_documents(df: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """One file per row, `folder/<name>` with the text (or bytes); the names written come back once the job has run. A task that runs
    again writes the same files. Making a file takes longer than sending its text, so rows are dealt over all shuffle
    partitions first, also where few would hold them."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{inner}/{file}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{inner}/{file}") as out:
                    out.write(body if isinstance(body, bytes) else (body or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["file"])

    return df.select(name, text).repartition(tasks, name).mapInArrow(run, "file string")


def pending(left: DataFrame, done: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Rows whose key is not done yet; force keeps all."""
    return left if force else left.join(done.select(*keys), list(keys), "left_anti")


def quarantine(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, error rows): error rows carry status 'error' and quality 'none', and count as done."""
    flag = F.coalesce(good, F.lit(False))
    errors = df.where(~flag).withColumns({"fetch_status": F.lit("error"), "data_quality": F.lit("none")})
    return df.where(flag), errors


def upsert_documents(existing: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of updates replace those of the same key; new keys are added."""
    return existing.join(updates.select(*keys).distinct(), list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)


def export_scores_json(scores: DataFrame, raters: Sequence[str], method: str = "sum") -> DataFrame:
    """One JSON envelope with the scores in rank order. All scores meet in one row: for result sets of a dashboard's size."""
    stocks = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.struct(*[c for c in scores.columns if c != "rank"]).alias("stock"))))
    one = scores.agg(F.count("*").alias("total"), stocks.alias("rows"))
    envelope = F.struct(F.current_timestamp().alias("computed_at"), "total", F.lit(method).alias("method"), F.array(*map(F.lit, raters)).alias("raters"), F.transform("rows", lambda r: r["stock"]).alias("stocks"))
    return one.select(F.to_json(envelope).alias("json"))
