"""Ranked lexical search: an inverted index of blocks, and Block-Max MaxScore over its segments.

`build_index` cuts the documents of each partition into segments of about `segment_terms` terms, sorts a segment's documents by
id and writes one row for each term of a segment: the postings (places of documents and term frequencies) as variable-length
bytes in blocks of BLOCK, and for each block its last document, where its bytes begin, and its impacts: the pairs of term
frequency and document length of which no other pair of the block has both the higher frequency and the smaller length. The
largest score of a block follows from its impacts exactly, whatever the corpus statistics are, so the texts are read once. One
more row of a segment has its document ids and lengths. Nothing but that table is kept; it stands in the shared folder.

`search` takes all rows of a query table, in blocks of about `block_items`. The lists of all terms that any query has come
together by segment and block of queries, so a group holds at most a segment's postings, however frequent a word is. Within a
segment, documents are worked on in windows of rising ids. A query's lists are ordered by their largest possible share of a
score; those whose shares together stay below the tenth best score so far are non-essential: a document that has only them
can't enter. The others are added up over the window. Then each non-essential list in turn, the largest first: the maximum of
the block that would hold a candidate and the shares of the lists still to come tell whether it can still enter, and only the
blocks of those that can are decoded. The `k` best of every segment are merged by rank.

Terms are the maximal matches of TERM with A-Z lowered. Documents without a term (null texts too) are not counted and never
found. Equal scores go by ascending id, null ids last; rows count on their own, whatever their ids, in both tables. A query
without terms, or whose terms no document holds, has no result. An empty index or query table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorefold.llm import common

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes: what is no part of a term becomes a space, A-Z become small; bytes of characters beyond ASCII stay.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
BLOCK, WINDOW = 64, 1024
INDEX = (
    "segment long, term string, df int, last binary, at binary, impact_at binary, impacts binary, postings binary, n_terms long, doc_ids array<bigint>, lengths binary"
)
#: Rows of terms of queries up to which they are sent to every task; with more, both sides are dealt by term and a salt.
FEW_TERMS, SALTS = 200_000, 32


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative numbers, seven bits each, the last byte of a number without its top bit; and where each begins."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    begin = np.r_[0, np.cumsum(size)]
    out = np.zeros(begin[-1], np.uint8)
    for k in range(5):
        there = size > k
        out[begin[:-1][there] + k] = (values[there] >> 7 * k & 127) | np.where(size[there] > k + 1, 128, 0)
    return out, begin


def from_varints(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    begin = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(begin, ends + 1 - begin)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, begin)


def binaries(data: np.ndarray, begin: np.ndarray):
    """Arrow binary array of the slices of data between the places in begin."""
    import pyarrow as pa

    offsets = (begin * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Builder:
    """Collects documents and gives the rows of a segment."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
        if words:
            known = self.vocabulary
            self.found.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
            self.ids.append(doc_id)
            self.size += len(words)

    def rows(self, segment: int):
        """Arrow batch of INDEX."""
        import pyarrow as pa

        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        lengths = np.array([len(self.found[k]) for k in order], np.int64)
        terms = sorted(self.vocabulary)
        place = np.empty(len(terms), np.int64)
        place[np.fromiter((self.vocabulary[t] for t in terms), np.int64, len(terms))] = np.arange(len(terms))
        key = place[np.concatenate([self.found[k] for k in order])] * len(order) + np.repeat(np.arange(len(order)), lengths)
        key, tf = np.unique(key, return_counts=True)
        term, doc = key // len(order), key % len(order)
        df = np.bincount(term, minlength=len(terms))
        list_at = np.r_[0, np.cumsum(df)]
        nth = np.arange(len(key)) - np.repeat(list_at[:-1], df)
        opens = nth % BLOCK == 0
        block_at = np.flatnonzero(opens)
        n_blocks = -(-df // BLOCK)
        blocks_at = np.r_[0, np.cumsum(n_blocks)]
        gap = np.where(opens, doc, doc - np.r_[0, doc[:-1]])
        raw, begin = varints(np.stack([gap, tf - 1], 1).ravel())
        byte_at = begin[2 * np.r_[block_at, len(key)]]
        # impacts: by block, frequencies falling; a pair counts if its length is below all before
        n, block = lengths[doc], np.cumsum(opens) - 1
        by = np.lexsort((n, -tf, block))
        far = n[by] - block[by] * (int(lengths.max()) + 1)
        best = np.minimum.accumulate(far)
        pick = by[np.r_[True, far[1:] < best[:-1]]]
        per_block = np.bincount(block[pick], minlength=len(block_at))
        impact_at = np.r_[0, np.cumsum(per_block)]
        first = np.repeat(blocks_at[:-1], n_blocks)
        last = doc[np.r_[block_at[1:], len(key)] - 1].astype(np.int32)
        pairs = np.stack([tf[pick], n[pick]], 1).astype(np.int32).ravel()
        m = len(terms)
        columns = [
            pa.array(np.full(m, segment)), pa.array([t.decode("utf-8", "surrogatepass") for t in terms], pa.string()), pa.array(df.astype(np.int32)),
            binaries(last, blocks_at), binaries((byte_at[:-1] - byte_at[first]).astype(np.int32), blocks_at), binaries((impact_at[:-1] - impact_at[first]).astype(np.int32), blocks_at),
            binaries(pairs, 2 * impact_at[blocks_at]), binaries(raw, byte_at[blocks_at]),
            pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary()),
        ]
        head = [[segment], [None], [len(order)], [None], [None], [None], [None], [None], [int(lengths.sum())], [[self.ids[k] for k in order]], [lengths.astype(np.int32).tobytes()]]
        names = [f.split()[0] for f in INDEX.split(", ")]
        return [pa.RecordBatch.from_arrays([pa.array(x, c.type) for x, c in zip(head, columns, strict=True)], names=names), pa.RecordBatch.from_arrays(columns, names=names)]


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_terms: int = 3 << 20, segment_docs: int = 1 << 16) -> DataFrame:
    """The index as a written table of INDEX; doc_id: whole numbers."""
    common.text_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        segment, held = TaskContext.get().partitionId() << 24, Builder()
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.add(key, body.as_py())
                if held.size >= segment_terms or len(held.ids) >= segment_docs:
                    done, held = held, Builder()
                    yield from done.rows(segment)
                    segment += 1
        if held.ids:
            yield from held.rows(segment)

    return common.written(docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, INDEX), "search-index")


@dataclass
class Statistics:
    """Documents with a term, and all their terms."""

    documents: int
    terms: int


class Postings:
    """One term's list in a segment; blocks are decoded when asked for."""

    def __init__(self, row: dict, lengths: np.ndarray, stats: Statistics):
        self.raw = np.frombuffer(row["postings"], np.uint8)
        self.last, self.at, impact_at = (np.frombuffer(row[c], np.int32) for c in ("last", "at", "impact_at"))
        self.df, self.lengths, self.stats = row["df"], lengths, stats
        tf, n = np.frombuffer(row["impacts"], np.int32).reshape(-1, 2).T.astype(np.int64)
        self.most = np.maximum.reduceat(share(tf, n, stats), impact_at)
        self.bound = int(self.most.max())
        self.sizes = np.minimum(BLOCK, self.df - BLOCK * np.arange(len(self.last)))
        #: Documents in order; a block that isn't decoded shows its last one, which keeps the order.
        self.docs = np.repeat(self.last, self.sizes).astype(np.int64)
        self.shares = np.zeros(self.df, np.int64)
        self.decoded = np.zeros(len(self.last), bool)

    def decode(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.decoded[blocks]]
        if not len(blocks):
            return
        ends = np.r_[self.at[1:], len(self.raw)]
        size = self.sizes[blocks]
        if blocks[-1] - blocks[0] + 1 == len(blocks):
            raw = self.raw[self.at[blocks[0]] : ends[blocks[-1]]]
        else:
            raw = np.concatenate([self.raw[self.at[b] : ends[b]] for b in blocks])
        pairs = from_varints(raw).reshape(-1, 2)
        run = np.cumsum(pairs[:, 0])
        begin = np.cumsum(size) - size
        docs = run - np.repeat(run[begin] - pairs[begin, 0], size)
        at = np.repeat(blocks * BLOCK - begin, size) + np.arange(len(docs))
        self.docs[at] = docs
        self.shares[at] = share(pairs[:, 1] + 1, self.lengths[docs], self.stats)
        self.decoded[blocks] = True

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from low up to below high, and their shares."""
        a, b = np.searchsorted(self.last, (low, high - 1))
        self.decode(np.arange(a, min(b + 1, len(self.last))))
        a, b = np.searchsorted(self.docs, (low, high))
        return self.docs[a:b], self.shares[a:b]


def share(tf: np.ndarray, n: np.ndarray, stats: Statistics) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms adds to its score, but for the term's weight."""
    m = 25 + 75 * n * stats.documents // stats.terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def best_of_segment(lists: list[tuple[Postings, int]], n_docs: int, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents of a segment for one query; lists with the weight that a share counts."""
    lists = sorted(((p, w) for p, w in lists if w > 0), key=lambda x: x[0].bound * x[1])
    upto = np.cumsum([p.bound * w for p, w in lists])
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in range(0, n_docs if lists else 0, window):
        high = min(low + window, n_docs)
        need = int(scores[-1]) + 1 if len(scores) == k else 1
        split = int(np.searchsorted(upto, need))
        if split == len(lists):
            break
        total = np.zeros(high - low, np.int64)
        for postings, weight in lists[split:]:
            found, shares = postings.between(low, high)
            total[found - low] += weight * shares
        at = np.flatnonzero(total)
        sums = total[at]
        at += low
        for j in range(split - 1, -1, -1):
            postings, weight = lists[j]
            rest = upto[j - 1] if j else 0
            block = np.searchsorted(postings.last, at)
            inside = block < len(postings.last)
            most = np.where(inside, postings.most[np.minimum(block, len(postings.last) - 1)], 0)
            can = sums + weight * most + rest >= need
            at, sums, block, inside = at[can], sums[can], block[can], inside[can]
            if not len(at):
                break
            postings.decode(np.unique(block[inside]))
            place = np.minimum(np.searchsorted(postings.docs, at), postings.df - 1)
            sums = sums + np.where(postings.docs[place] == at, weight * postings.shares[place], 0)
        good = sums >= need
        docs, scores = np.r_[docs, at[good]], np.r_[scores, sums[good]]
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
    return docs, scores


def terms_of(text: Column | str) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def with_terms(left: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """Inner join on term. The terms go to every task while they are few; else both sides are dealt by term and a salt, so that
    no frequent word's lists meet in one task."""
    if n <= FEW_TERMS:
        return left.join(F.broadcast(terms), "term")
    salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"]).drop("_salt")


def search(index: DataFrame, queries: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 10, block_items: int = 64) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of queries, best first."""
    items = common.written(queries.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("item")), "search-items")
    n_blocks = max(1, -(-items.count() // block_items))
    heads = index.where("term IS NULL")
    n, size = heads.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    stats = Statistics(int(n), max(int(size), 1))
    asked = items.select("item", F.explode(terms_of("text")).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int"))
    asked = common.written(asked.groupBy("term", "block").agg(F.collect_list(F.struct("item", "times")).alias("askers")), "search-terms")
    terms = asked.select("term").distinct()
    lists = common.written(with_terms(index.where("term IS NOT NULL").select("segment", "term", "df", "last", "at", "impact_at", "impacts", "postings"), terms, asked.count()), "search-lists")
    df = lists.groupBy("term").agg(F.sum("df").alias("_df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * stats.documents + 2) / (2 * F.col("_df") + 1))).cast("long")
    weighted = common.written(asked.join(df.select("term", weight.alias("weight")), "term"), "search-weights")
    part = with_terms(lists, weighted, asked.count())
    # the documents of a segment go to each block of queries
    blocks = heads.select("segment", "doc_ids", "lengths").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    rows = part.unionByName(blocks, allowMissingColumns=True)

    def run(table):
        import pyarrow as pa

        found = table.to_pylist()
        head = next(r for r in found if r["lengths"] is not None)
        lengths = np.frombuffer(head["lengths"], np.int32).astype(np.int64)
        by_item: dict[int, list] = {}
        for r in found:
            if r["postings"] is not None:
                postings = Postings(r, lengths, stats)
                for a in r["askers"]:
                    by_item.setdefault(a["item"], []).append((postings, r["weight"] * a["times"]))
        out = [(item, head["doc_ids"][d], s) for item, own in sorted(by_item.items()) for d, s in zip(*(x.tolist() for x in best_of_segment(own, len(lengths), k)), strict=True)]
        return pa.table({name: pa.array([r[c] for r in out], pa.int64()) for c, name in enumerate(("item", "doc_id", "score"))})

    heaps = rows.groupBy("segment", "block").applyInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
