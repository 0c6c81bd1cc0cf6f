import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorefold.llm import queries, search

DOCS = "doc_id long, text string, rank int, term string"


def terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain_search(docs, items, k=10):
    """Every score of every row, as the contract has it."""
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n, size = len(found), sum(x[2] for x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, long in found:
            s = 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1)))
                    s += times * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * long * n // size)))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "Ké", "zo", "日本", "x9") for b in range(30)]
    weights = [1 / (1 + k) for k in range(len(words))]
    docs = [(k * 3, " ,.\n"[rng.randrange(4)].join(rng.choices(words, weights, k=int(rng.paretovariate(0.7)) % 900 + 1))) for k in range(n)]
    docs += [(None, "ba1 ba2"), (7, None), (8, ""), (9, "--- !!"), docs[0], (docs[1][0], docs[2][1]), (11, "common " * 20000), *[(1000000 + k, "ba1 zo2 zo2") for k in range(60)]]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for k in range(30)] + [(90, None), (91, "!"), (92, "unheard of"), (None, "ba1 ba1 zo2"), (3, "ba0 ké2"), (3, "zo5"), (95, "BA1 common日本0")]
    return docs, items


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**31 - 1)), max_size=200))
def test_varints_come_back(values):
    raw, begin = search.varints(np.array(values, np.int64))
    assert search.from_varints(raw).tolist() == values and begin[-1] == len(raw)


@pytest.mark.parametrize("segment_terms, few", [(1 << 20, 10**6), (2000, 10**6), (2000, 0)])
def test_search_equals_plain_scores(spark, monkeypatch, segment_terms, few):
    monkeypatch.setattr(search, "FEW_TERMS", few)
    docs, items = corpus(segment_terms)
    frame = spark.createDataFrame([(*d, 1, "clash") for d in docs], DOCS).repartition(3)
    index = search.build_index(frame, segment_terms=segment_terms)
    got = search.search(index, spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, score int"), block_items=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == plain_search(docs, items)


def segment(docs):
    held = search.Builder()
    for d in docs:
        held.add(*d)
    head, body = (b.to_pylist() for b in held.rows(0))
    lengths = np.frombuffer(head[0]["lengths"], np.int32).astype(np.int64)
    stats = search.Statistics(len(lengths), int(lengths.sum()))
    return lengths, stats, {r["term"]: r for r in body}


def test_block_maxima_are_exact_and_blocks_stay_closed():
    rng = random.Random(3)
    docs = [(k, " ".join(["the"] * rng.randint(1, 4) + ["pad"] * rng.randint(5, 60) + (["rare"] * 3 if k in (40, 41, 42, 900) else []))) for k in range(2000)]
    lengths, stats, rows = segment(docs)
    for row in rows.values():
        postings = search.Postings(row, lengths, stats)
        most = postings.most.copy()
        postings.decode(np.arange(len(postings.last)))
        assert np.array_equal(most, np.maximum.reduceat(postings.shares, np.arange(0, postings.df, search.BLOCK)))
        assert np.array_equal(postings.last, postings.docs[np.r_[np.arange(search.BLOCK, postings.df, search.BLOCK), postings.df] - 1])
    the, rare = (search.Postings(rows[t], lengths, stats) for t in ("the", "rare"))
    found, scores = search.best_of_segment([(the, 1), (rare, 5000)], len(lengths), 3, window=100)
    assert set(found.tolist()) < {40, 41, 42, 900} and sorted(scores.tolist(), reverse=True) == scores.tolist()
    # once three documents have the rare word, lists of the common one are read for candidates only
    assert the.decoded.sum() < len(the.decoded) / 4 and rare.decoded.all()


def test_windows_and_ties_do_not_matter():
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choices("abcdefgh", k=rng.choice((3, 3, 12))))) for k in range(500)]
    lengths, stats, rows = segment(docs)
    for _ in range(60):
        picked = [(t, rng.randint(1, 900)) for t in rng.sample("abcdefgh", rng.randint(1, 6))]
        want = None
        for window in (1 << 20, 64, 7):
            found = search.best_of_segment([(search.Postings(rows[t], lengths, stats), w) for t, w in picked], len(lengths), 10, window)
            shown = [x.tolist() for x in found]
            want = want or shown
            assert shown == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(search.build_index(docs.limit(0)), items).collect() == []
    assert search.search(search.build_index(docs), items.limit(0)).collect() == []


def test_query_equals_its_sql(spark, tmp_path):
    docs, items = corpus(9, 150)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op12_ranked_search"]).fetchall()
    assert sorted(map(repr, map(tuple, queries.op12_ranked_search(spark, f"file://{tmp_path}").collect()))) == sorted(map(repr, want))
