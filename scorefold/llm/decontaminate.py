"""Benchmark decontamination by greedy string tiling.

Documents and test items are joined on shared seeds: rolling hashes of `least` words (of all its words, for a shorter item).
For each document and item with a common seed, running Karp-Rabin repeatedly marks the longest matches that do not overlap
what is marked, down to `least` words, so that passages in another order are found too. An item's coverage is the share of
its words in such tiles; a document is contaminated where the coverage of some item reaches `threshold`.

Words are parted by white space, A-Z lowered, ASCII punctuation left out. Null texts and items without words match nothing.
An item table of at most `broadcast_words` words is sent to every task; a larger one is joined by shuffles, with the same
result. Repeated rows get the same result each. Rows of one item_id with different texts are tiled on their own, and the best
of them counts for the id; rows without an item_id are items too, under a null id.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import common

PUNCTUATION = string.punctuation.encode()
#: Matches that are sorted at once; a matter of speed.
AT_ONCE = 1 << 18
RESULT = "contaminated boolean, item_id long, coverage double, n_items long"


def token_hashes(text: str | None) -> np.ndarray:
    if text is None:
        return np.zeros(0, np.uint64)
    return common.word_hashes(text.encode("utf-8", "surrogatepass").lower().translate(None, PUNCTUATION).split())


def free_runs(marked: np.ndarray, n: int) -> np.ndarray:
    """For every run of n words, whether none of them is marked."""
    ends = np.concatenate([[0], np.cumsum(marked)])
    return ends[n:] == ends[:-n]


def scan(doc: np.ndarray, item: np.ndarray, doc_marked: np.ndarray, item_marked: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least n unmarked words as (length, item position, document position).

    Runs of n words that match stand on a diagonal (document less item position); those of following item positions on one
    diagonal are one longer run. Up to AT_ONCE matches are sorted by diagonal; where a repeated word makes more, the diagonals
    that go on are carried from item position to position as arrays, in memory in proportion to the document."""
    if len(doc) < n or len(item) < n:
        return []
    of_item, of_doc = common.rolling(item, n), common.rolling(doc, n)
    item_free = free_runs(item_marked, n)
    wanted = np.unique(of_item[item_free])
    if not len(wanted):
        return []
    places = np.flatnonzero(free_runs(doc_marked, n) & (wanted[np.minimum(np.searchsorted(wanted, of_doc), len(wanted) - 1)] == of_doc))
    order = np.argsort(of_doc[places], kind="stable")
    places = places[order]
    keys = of_doc[places]
    low, high = np.searchsorted(keys, of_item, "left"), np.searchsorted(keys, of_item, "right")
    high[~item_free] = 0
    found, none = [], np.zeros(0, np.int64)
    size = np.maximum(high - low, 0)
    if size.sum() <= AT_ONCE:
        i = np.repeat(np.arange(len(size)), size)
        diagonal = places[np.repeat(low - np.cumsum(size) + size, size) + np.arange(len(i))] - i
        order = np.lexsort((i, diagonal))
        i, diagonal = i[order], diagonal[order]
        first = np.flatnonzero(np.r_[True, (diagonal[1:] != diagonal[:-1]) | (i[1:] != i[:-1] + 1)]) if len(i) else none
        last = np.r_[first[1:], len(i)] - 1 if len(i) else none
        found = list(zip((i[last] - i[first] + n).tolist(), i[first].tolist(), (i[first] + diagonal[first]).tolist(), strict=True))
        return [(m, a, d) for m, a, d in found if np.array_equal(item[a : a + m], doc[d : d + m])]
    open_at, since = none, none  # diagonals of runs that go on, and where in the item they began
    for i in [*np.flatnonzero((high > low) | np.r_[False, (high > low)[:-1]]).tolist(), len(of_item)]:
        here = places[low[i] : high[i]] - i if i < len(of_item) and high[i] > low[i] else none
        stays = np.isin(open_at, here, assume_unique=True)
        for diagonal, start in zip(open_at[~stays].tolist(), since[~stays].tolist(), strict=True):
            found.append((i - start + n - 1, start, start + diagonal))
        new = here[~np.isin(here, open_at, assume_unique=True)]
        open_at, since = np.r_[open_at[stays], new], np.r_[since[stays], np.full(len(new), i, np.int64)]
    return [(m, i, d) for m, i, d in found if np.array_equal(item[i : i + m], doc[d : d + m])]


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item position, document position, length) of the tiles, longest first in each round."""
    least = max(1, min(least, len(item)))
    doc_marked, item_marked = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out, n = [], len(item)
    while n >= least and len(item):
        while found := scan(doc, item, doc_marked, item_marked, n):
            for length, i, d in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
                if not item_marked[i : i + length].any() and not doc_marked[d : d + length].any():
                    item_marked[i : i + length] = True
                    doc_marked[d : d + length] = True
                    out.append((i, d, length))
        if n == least:
            break
        n = max(least, n // 2)
    return out


def coverage(doc: np.ndarray, item: np.ndarray, least: int) -> float:
    return sum(t[2] for t in tiles(doc, item, least)) / len(item) if len(item) else 0.0


def seeds_of(item: np.ndarray, least: int) -> np.ndarray:
    return common.rolling(item, min(least, len(item))) if len(item) else np.zeros(0, np.uint64)


class Items:
    """The test items of one broadcast: seed hashes in order, the items of each, and a bitmap that most words fail."""

    def __init__(self, rows: list[tuple[int | None, bytes]], least: int):
        self.least, self.ids = least, [k for k, _ in rows]
        self.words = dict(enumerate(np.frombuffer(w, np.uint64) for _, w in rows))
        pairs = [(s, k) for k, w in self.words.items() for s in np.unique(seeds_of(w, least)).tolist()]
        self.widths = sorted({min(least, len(w)) for w in self.words.values() if len(w)})
        self.items: dict[int, list[int]] = {}
        for s, k in pairs:
            self.items.setdefault(s, []).append(k)
        self.sorted = np.array(sorted(self.items), np.uint64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.sorted >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, doc: np.ndarray) -> set[int]:
        out: set[int] = set()
        for width in self.widths:
            runs = common.rolling(doc, width)
            runs = np.unique(runs[self.bitmap[(runs >> np.uint64(44)).astype(np.int64)]])
            if len(runs):
                at = np.minimum(np.searchsorted(self.sorted, runs), len(self.sorted) - 1)
                for s in runs[self.sorted[at] == runs].tolist():
                    out.update(self.items[s])
        return out


def verdict(found: list[tuple[int | None, float]], threshold: float) -> tuple[bool, int | None, float, int]:
    """From (item_id, coverage) of a document: the best item, the smallest id on ties, a null id last."""
    best: dict[int | None, float] = {}
    for k, c in found:
        best[k] = max(c, best.get(k, 0.0))
    if not best:
        return False, None, 0.0, 0
    k, c = min(best.items(), key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    return c >= threshold, k, float(c), sum(x >= threshold for x in best.values())


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words): the word hashes of every distinct item row with a text."""

    def make():
        return lambda texts: ([token_hashes(t).tobytes() for t in texts],)

    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("_text")).distinct()
    return common.with_columns_from_text(rows, "_text", "words binary", make).select("item_id", "words")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 5, threshold: float = 0.5, broadcast_words: int = 1_000_000) -> DataFrame:
    """docs with contaminated, item_id (of the best covered item), coverage and n_items (items that reach the threshold)."""
    words = common.written(item_words(items, item_id, item_text), "items")
    size = words.agg(F.sum(F.expr("octet_length(words) div 8"))).first()[0] or 0
    if size > broadcast_words:
        return by_shuffle(docs, words, text, least, threshold)
    rows = [(r["item_id"], bytes(r["words"])) for r in words.collect()]

    def make():
        known = Items(rows, least)

        def work(texts):
            out = [], [], [], []
            for text in texts:
                doc = token_hashes(text)
                found = [(known.ids[k], coverage(doc, known.words[k], least)) for k in known.candidates(doc)]
                for column, value in zip(out, verdict(found, threshold), strict=True):
                    column.append(value)
            return out

        return work

    return common.with_columns_from_text(docs, text, RESULT, make)


def by_shuffle(docs: DataFrame, words: DataFrame, text: str, least: int, threshold: float) -> DataFrame:
    """For item tables of any size: seeds of both sides meet in a shuffle join, then each pair is tiled on its own."""
    docs = docs.drop("contaminated", "item_id", "coverage", "n_items")
    words = words.withColumn("_item", F.sha2(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("")).cast("binary"), F.lit(b"/"), "words"), 256))
    texts = docs.select(F.col(text).alias("_text")).where("_text is not null").distinct().select("_text", F.sha2("_text", 256).alias("_key"))
    widths = [r[0] for r in words.selectExpr(f"least({least}, octet_length(words) div 8) AS w").where("w > 0").distinct().collect()]

    def doc_seeds():
        return lambda rows: ([np.unique(np.concatenate([common.rolling(token_hashes(t), w) for w in widths] or [np.zeros(0, np.uint64)])).view(np.int64).tolist() for t in rows],)

    def of_items(batches):
        import pyarrow as pa

        for batch in batches:
            for key, w in zip(batch.column("_item"), batch.column("words"), strict=True):
                seeds = np.unique(seeds_of(np.frombuffer(w.as_py(), np.uint64), least)).view(np.int64)
                yield pa.RecordBatch.from_pydict({"_item": pa.array([key.as_py()] * len(seeds), pa.string()), "seed": pa.array(seeds, pa.int64())})

    left = common.with_columns_from_text(texts, "_text", "seeds array<long>", doc_seeds).select("_key", F.explode("seeds").alias("seed"))
    pairs = left.join(words.select("_item", "words").mapInArrow(of_items, "_item string, seed long"), "seed").select("_key", "_item").distinct()

    def tile(batches):
        import pyarrow as pa

        for batch in batches:
            found = [coverage(token_hashes(t.as_py()), np.frombuffer(w.as_py(), np.uint64), least) for t, w in zip(batch.column("_text"), batch.column("words"), strict=True)]
            yield pa.RecordBatch.from_pydict({"_key": batch.column("_key"), "item_id": batch.column("item_id"), "coverage": pa.array(found, pa.float64())})

    tiled = pairs.join(texts, "_key").join(words, "_item").select("_key", "item_id", "_text", "words").mapInArrow(tile, "_key string, item_id long, coverage double")
    tiled = tiled.groupBy("_key", "item_id").agg(F.max("coverage").alias("coverage"))
    best = F.min_by("item_id", F.struct(-F.col("coverage"), F.col("item_id").isNull(), "item_id"))
    each = tiled.groupBy("_key").agg(best.alias("item_id"), F.max("coverage").alias("coverage"), F.count_if(F.col("coverage") >= threshold).alias("n_items"))
    out = docs.withColumn("_key", F.sha2(text, 256)).join(each, "_key", "left").drop("_key")
    return out.select(*docs.columns, (F.coalesce("coverage", F.lit(0.0)) >= threshold).alias("contaminated"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))
