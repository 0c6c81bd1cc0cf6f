import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scorefold.llm import decontaminate as dc


def brute_tiles(doc, item, least):
    """Greedy string tiling by looking at every pair of positions, longest match first."""
    least = max(1, min(least, len(item)))
    dm, im = [False] * len(doc), [False] * len(item)
    covered = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not im[i + n] and not dm[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least or not n:
            return covered
        for k in range(n):
            im[i + k] = dm[d + k] = True
        covered += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 4))
def test_tiles_are_disjoint_common_runs_and_cover_as_much(doc, item, least):
    doc, item = np.array(doc, np.uint64), np.array(item, np.uint64)
    found = dc.tiles(doc, item, least)
    used_i, used_d = set(), set()
    for i, d, n in found:
        assert n >= min(least, len(item)) and (item[i : i + n] == doc[d : d + n]).all()
        assert not used_i & set(range(i, i + n)) and not used_d & set(range(d, d + n))
        used_i |= set(range(i, i + n))
        used_d |= set(range(d, d + n))
    # ties may be broken either way, so coverage may differ a little, but nothing tileable is left
    left = dc.scan(doc, item, np.isin(np.arange(len(doc)), list(used_d)), np.isin(np.arange(len(item)), list(used_i)), max(1, min(least, len(item))))
    assert not left
    assert bool(found) == bool(brute_tiles(doc.tolist(), item.tolist(), least))


def test_without_ties_coverage_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item = rng.integers(0, 10**6, 30).astype(np.uint64)
        cut = sorted(rng.integers(0, 31, 3).tolist())
        parts = [item[a:b] for a, b in zip([0, *cut], [*cut, 30], strict=True)]
        doc = np.concatenate([x for k in rng.permutation(4) for x in (rng.integers(10**7, 10**8, 4).astype(np.uint64), parts[k])])
        assert sum(t[2] for t in dc.tiles(doc, item, 4)) == brute_tiles(doc.tolist(), item.tolist(), 4)


def rows(rng):
    words = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choice(words, 40))) for k in range(12)] + [(50, "two words"), (51, None), (52, "!!"), (None, "no id"), (3, "second row of three"), (None, "a text without an id that is an item too")]
    docs = []
    for k in range(60):
        body = list(rng.choice(words, 120))
        if k % 3 == 0:
            of = items[k % 12][1].split()
            body[20:20] = of[:20]
            body[90:90] = [w.upper() + "." for w in of[20:]]
        docs.append((k, " ".join(body), "x", "clash"))
    docs += [(100, "here are Two, WORDS again", None, None), (101, None, None, None), (102, "", None, None), (None, items[0][1], None, None), docs[0], (103, "w1 " * 30000, None, None), (104, "x y second row of three z", None, None), (105, "see a text without an id that is an item too", None, None)]
    return docs, items


def test_both_ways_find_reordered_passages_and_leave_clean_ones(spark):
    docs, items = rows(np.random.default_rng(8))
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, coverage string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    by_broadcast = dc.decontaminate(frame, bench)
    by_shuffle = dc.decontaminate(frame, bench, broadcast_words=0)
    assert by_broadcast.columns == by_shuffle.columns
    keep = ["doc_id", "contaminated", "item_id", "coverage", "n_items"]
    one, two = (sorted(map(repr, f.select(*keep).collect())) for f in (by_broadcast, by_shuffle))
    assert one == two and len(one) == len(docs)
    for r in by_broadcast.collect():
        if r.doc_id is None or r.doc_id in (100, 104, 105) or (r.doc_id < 100 and r.doc_id % 3 == 0):
            assert r.contaminated and (r.item_id is None) == (r.doc_id == 105), r
        else:
            assert not r.contaminated, r
    assert dc.decontaminate(frame.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in dc.decontaminate(frame, bench.limit(0)).collect())
