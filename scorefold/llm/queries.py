"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefold.llm import chat, common, decontaminate, embeddings, language, lm, packing, periodic, quality, quality_rules, search, simhash, subwords, token_files, toxicity

ROOM = 4096


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.cut_pieces(subwords.encode(docs, tokenizer_path(), end_id=1), ROOM)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), ROOM)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    shards = token_files.write_shards(docs, tokenizer_path(), end_id=2, folder=common.new_path(spark, "token-files"))
    read = token_files.read_shards(shards)
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """doc_id, text, n_bytes and label of the labelled documents that may be learned from; of several labels the largest counts."""
    labels = common.table(spark, sf_dir, "labels").where(~common.held_out("doc_id") & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    return common.table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").alias("n_bytes")).join(labels, "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = quality.fit(labelled(spark, sf_dir, "quality"), n_bytes="n_bytes")
    scored = quality.score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), net)
    return scored.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(labelled(spark, sf_dir, "toxic"))
    scored = toxicity.score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "matched_clauses")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(common.table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~common.held_out("doc_id")))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.sql("SELECT -7L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    turns = turns.unionByName(probe).withColumn("parts", chat.text_parts(F.coalesce("text", F.lit(""))))
    read = chat.read_chats(chat.format_chats(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark")).drop("text")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", (common.crc_mod("doc_id", 10) != 0).alias("train"))
    scored = lm.score(docs, tokenizer_path(), "train")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.filter_quality(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), F.round("quality", 6).alias("quality"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_index(common.table(spark, sf_dir, "documents"))
    return search.search(index, common.table(spark, sf_dir, "benchmark"))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """docs with texts of op13: where h = crc32(doc_id) ends in 0, the words from g % n on repeat with period p, g = h div 10."""
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumns({"_h": h}).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    rows = rows.withColumns({"_n": F.size("_words"), "_g": F.expr("_h div 10")})
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.expr("(_n - _a) div (3 + _g % 8)"))
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1), lambda i: F.element_at("_words", (F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")) + 1).cast("int")))
    return rows.withColumn("text", F.when(F.col("_n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))).select(*docs.columns)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(repeat_tails(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _escaped_sql(text: str) -> str:
    """chat.escape in plain replacements: each control string gets a backslash behind its first character."""
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP5_SQL = f"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(chat.HEAD + chat.BODY + chat.END)} AS n, {_escaped_sql("text")} AS body FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + {len(chat.BOS)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


#: Exact: equality joins on the label, cosine in double precision, reachability by a recursive query.
OP6_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.m, e.vec_id))::BIGINT AS component_id,
  e.vec_id = least(e.vec_id, coalesce(r.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = e.vec_id
"""


#: Every score in full, in 64-bit integers.
OP12_SQL = rf"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, '{search.UPPER}', '{search.LOWER}'), '{search.TERM}')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
b AS (SELECT i, item_id, unnest(regexp_extract_all(translate(text, '{search.UPPER}', '{search.LOWER}'), '{search.TERM}')) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
asked AS (SELECT i, item_id, term, count(*) AS times FROM b GROUP BY i, item_id, term),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scores AS (
  SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (r), totals GROUP BY i, item_id, r, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def _vote_sql(value: str, good: tuple, bad: tuple) -> str:
    a, b = value.split(" / ")
    v = f"({a}::DOUBLE / nullif({b}, 0))"
    below = f" WHEN {v} < {bad[0]} THEN -1" if bad[0] is not None else ""
    above = f" WHEN {v} > {bad[1]} THEN -1" if bad[1] is not None else ""
    return f"CASE WHEN {v} BETWEEN {good[0]} AND {good[1]} THEN 1{below}{above} ELSE 0 END"


def _op11_sql() -> str:
    """Counts by words and lines, votes, and EM as a recursive query over the combinations of votes."""
    r = quality_rules
    k = range(len(r.RULES))
    low, high = 1 - r.MOST, r.MOST
    odd = r.ODD_PATTERN.replace("'", "''")
    votes = ", ".join(f"{_vote_sql(*rule[1:])} AS v{j}" for j, rule in enumerate(r.RULES))
    weights = "".join(f" + CASE v{j} WHEN 1 THEN ln(g{j} / (1 - b{j})) WHEN -1 THEN ln((1 - g{j}) / b{j}) ELSE 0 END" for j in k)
    posterior = f"1 / (1 + exp(-(ln(prior / (1 - prior)){weights})))"
    start = ", ".join(f"{r.START_GOOD}::DOUBLE AS g{j}, {r.START_BAD}::DOUBLE AS b{j}" for j in k)
    sums = ", ".join(
        f"(coalesce(sum(n * p) FILTER (v{j} = 1), 0) + {r.START_GOOD}) / (sum(n * p * abs(v{j})) + 1) AS g{j}, "
        f"(coalesce(sum(n * (1 - p)) FILTER (v{j} = -1), 0) + {r.START_BAD}) / (sum(n * (1 - p) * abs(v{j})) + 1) AS b{j}" for j in k
    )
    bounded = {j: f"least(greatest(g{j}, {low}), {high})" for j in k}
    bounds = ", ".join(f"{bounded[j]}, least(greatest(b{j}, 1 - {bounded[j]}, {low}), {high})" for j in k)
    zero = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in "n_words word_chars n_letter_words n_capital_words n_ended_words n_odd_words n_top_word n_lines n_dup_lines n_repeat_words".split())
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM s),
x AS (SELECT *, lead(word, 1) OVER o AS word1, lead(word, 2) OVER o AS word2 FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)),
twice AS (SELECT unnest([pos, pos + 1, pos + 2]) AS pos, r FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, word, word1, word2) AS n FROM x WHERE word2 IS NOT NULL) WHERE n > 1),
again AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM twice GROUP BY r),
kinds AS (SELECT r, word, count(*) AS n FROM w GROUP BY r, word),
words AS (
  SELECT r, sum(n) AS n_words, sum(n * length(word)) AS word_chars, sum(n) FILTER (regexp_matches(word, '\p{{L}}')) AS n_letter_words,
    sum(n) FILTER (length(word) > 1 AND regexp_matches(word, '\p{{Lu}}') AND NOT regexp_matches(word, '\p{{Ll}}')) AS n_capital_words,
    sum(n) FILTER (regexp_matches(word, '[.!?]$')) AS n_ended_words, sum(n) FILTER (regexp_matches(word, '{odd}')) AS n_odd_words, max(n) AS n_top_word
  FROM kinds GROUP BY r
), ls AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ls WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT doc_id, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, {zero}
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN again USING (r)
), voted AS (SELECT *, {votes} FROM measured),
patterns AS (SELECT {", ".join(f"v{j}" for j in k)}, count(*) AS n FROM voted WHERE n_words > 0 GROUP BY ALL),
em AS (
  SELECT 0 AS i, {r.START_PRIOR}::DOUBLE AS prior, {start}
  UNION ALL
  SELECT i, least(greatest(prior, {low}), {high}), {bounds}
  FROM (SELECT i + 1 AS i, sum(n * p) / sum(n) AS prior, {sums} FROM (SELECT *, {posterior} AS p FROM em, patterns WHERE i < {r.ROUNDS}) GROUP BY i)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {posterior} AS quality FROM voted, em WHERE i = {r.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept, round(quality, 6) AS quality FROM judged
"""


def queries() -> dict:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_quality": op2_quality,
        "op3_token_files": op3_token_files,
        "op4_toxicity": op4_toxicity,
        "op5_chat_format": op5_chat_format,
        "op6_near_vectors": op6_near_vectors,
        "op7_language_id": op7_language_id,
        "op8_simhash": op8_simhash,
        "op9_decontaminate": op9_decontaminate,
        "op10_language_model": op10_language_model,
        "op11_quality_rules": op11_quality_rules,
        "op12_ranked_search": op12_ranked_search,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": OP5_SQL, "op6_near_vectors": OP6_SQL, "op11_quality_rules": _op11_sql(), "op12_ranked_search": OP12_SQL}
