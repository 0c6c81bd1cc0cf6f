"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams of its letters, TF-IDF weighted and normalised. Document frequencies come from all
training documents. Each language has several centroids, found by spherical k-means on a bounded number of its training
documents (`per_language`, and `most` over all languages). The prediction is the language of the centroid with the highest
cosine. A text whose cosine lies far under what training texts of about its length reach is marked `rejected`: it is near no
known language. Texts of a few words are never rejected for their distance.

Null texts and texts without a letter get `und`, score 0 and are rejected. With nothing to learn from, every text gets `und`.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import common

DIMS = 4096
OTHER = re.compile(r"[\W\d_]+")
PART = "kind string, lang string, n long, bins binary, counts binary"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of the byte 2- and 3-grams of the lower-cased letters; other characters count as one blank."""
    raw = np.frombuffer((" " + OTHER.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    codes = np.concatenate([(two + np.uint32(1 << 24)) * np.uint32(2654435761), three * np.uint32(2654435761)]) >> np.uint32(20)
    counts = np.bincount(codes, minlength=DIMS)
    bins = np.flatnonzero(counts)
    return bins, counts[bins]


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L stands in the text; numerals such as ½ or Ⅷ are none."""
    return any(map(str.isalpha, text))


def bucket(n: np.ndarray | int) -> np.ndarray:
    """Length class of a text by its number of n-grams."""
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), 15)


def fit(train: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = 800, most: int = 8000, centroids: int = 4) -> dict:
    """train: labelled rows. Reads all of them for document frequencies; centroids come from about per_language a language, `most` in all."""
    train = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    sizes = {r["_lang"]: r["count"] for r in train.groupBy("_lang").count().collect()}
    if not sizes:
        return {"langs": []}
    per_language = min(per_language, max(1, most // len(sizes)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int((1 << 30) * min(1.0, per_language / n)))])
    picked = F.pmod(F.xxhash64("_key", "_text", F.lit(23)), F.lit(1 << 30)) < share[F.col("_lang")]

    def run(batches):
        import pyarrow as pa

        df, n, rows = np.zeros(DIMS, np.int64), 0, []
        for batch in batches:
            for text, name, take in zip(batch.column("_text"), batch.column("_lang"), batch.column("_take"), strict=True):
                bins, counts = grams(text.as_py())
                df[bins] += 1
                n += 1
                if take.as_py():
                    rows.append({"kind": "doc", "lang": name.as_py(), "n": int(counts.sum()), "bins": bins.astype("<u2").tobytes(), "counts": counts.astype("<u4").tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        yield pa.RecordBatch.from_pylist([{"kind": "df", "lang": None, "n": n, "bins": None, "counts": df.astype("<i8").tobytes()}], schema=arrow)

    import pyarrow as pa

    arrow = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("n", pa.int64()), ("bins", pa.binary()), ("counts", pa.binary())])
    parts = common.written(train.select("_lang", "_text", picked.alias("_take")).mapInArrow(run, PART), "language-fit")
    # document frequencies add up in Spark: DIMS sums come to the driver, whatever the number of tasks

    def add(batches):
        for batch in batches:
            both = np.stack([np.frombuffer(x.as_py(), "<i8") for x in batch.column("counts")] or [np.zeros(DIMS, np.int64)])
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.arange(DIMS, dtype=np.int64)), "df": pa.array(both.sum(0))})

    sums = parts.where("kind = 'df'").select("counts").mapInArrow(add, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).collect()
    total = parts.where("kind = 'df'").agg(F.sum("n")).first()[0] or 0
    df = np.zeros(DIMS)
    for r in sums:
        df[r["bin"]] = r["df"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    found = parts.where("kind = 'doc'").dropDuplicates(["lang", "n", "bins", "counts"]).orderBy("lang", "n", "bins", "counts").collect()  # equal texts count once
    vectors = np.zeros((len(found), DIMS), np.float32)
    for k, r in enumerate(found):
        vectors[k, np.frombuffer(r["bins"], "<u2")] = np.log1p(np.frombuffer(r["counts"], "<u4"))
    vectors *= idf
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    names = np.array([r["lang"] for r in found])
    langs, centres = sorted(set(names.tolist())), []
    for name in langs:
        centres += [(name, c) for c in spherical_k_means(vectors[names == name], centroids)]
    matrix = np.stack([c for _, c in centres])
    owner = np.array([langs.index(name) for name, _ in centres])
    best = np.where(owner[np.argmax(vectors @ matrix.T, 1)] >= 0, np.max(vectors @ matrix.T, 1), 0)
    sizes_of = bucket(np.array([r["n"] for r in found]))
    floor = np.full(16, 0.5 * np.quantile(best, 0.001))
    for b in range(16):
        if b < 6:  # under 64 n-grams a text says too little to be called foreign
            floor[b] = 0.0
        elif (sizes_of == b).sum() >= 20:
            floor[b] = 0.5 * np.quantile(best[sizes_of == b], 0.001)
    return {"langs": langs, "owner": owner, "centres": matrix, "idf": idf, "floor": floor}


def spherical_k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; the start is the row farthest from those taken before."""
    k = min(k, len(rows))
    mean = rows.mean(0)
    centres = [mean / max(np.linalg.norm(mean), 1e-9)]
    near = rows @ centres[0]
    while len(centres) < k:
        pick = int(np.argsort(near, kind="stable")[len(near) // 10])
        centres.append(rows[pick])
        near = np.maximum(near, rows @ rows[pick])
    matrix = np.stack(centres)
    for _ in range(rounds):
        side = np.argmax(rows @ matrix.T, 1)
        for c in range(k):
            if (side == c).any():
                mean = rows[side == c].mean(0)
                matrix[c] = mean / max(np.linalg.norm(mean), 1e-9)
    return matrix


def identify(docs: DataFrame, model: dict, text: str = "text", sharp: float = 30.0) -> DataFrame:
    """docs with lang_pred, score (share of the best language in a softmax of the cosines), cosine and rejected."""

    def make():
        langs, weights = model["langs"], None
        if langs:
            weights = np.ascontiguousarray((model["centres"] * model["idf"]).T)

        def work(texts):
            out = [], [], [], []
            for text in texts:
                row = ("und", 0.0, 0.0, True)
                if langs and text and has_letter(text):
                    bins, counts = grams(text)
                    tf = np.log1p(counts).astype(np.float32)
                    norm = float(np.linalg.norm(tf * model["idf"][bins])) or 1.0
                    cosines = tf @ weights[bins] / norm
                    each = np.array([cosines[model["owner"] == k].max() for k in range(len(langs))])
                    best = int(np.argmax(each))
                    score = float(1 / np.exp(sharp * (each.astype(float) - each[best])).sum())
                    row = (langs[best], score, float(each[best]), bool(each[best] < model["floor"][bucket(counts.sum())]))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    return common.with_columns_from_text(docs, text, "lang_pred string, score double, cosine double, rejected boolean", make)
