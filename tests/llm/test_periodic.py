import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scorefold.llm import periodic, queries


def plain_runs(words, least=24, times=3):
    """Every maximal stretch that equals itself q words on, for every q; a stretch has been seen if a smaller period has it."""
    words, seen, out = np.asarray(words), set(), []
    for q in range(1, len(words) // times + 1):
        same = np.r_[False, words[q:] == words[:-q], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            n = b - a + q
            if n >= max(least, times * q) and (a, n) not in seen:
                seen.add((a, n))
                out.append((a, n, q))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9).flatmap(lambda x: st.integers(1, 9).map(lambda k: x * k)), max_size=8).map(lambda x: sum(x, [])))
def test_runs_equal_plain_ones(words):
    for least, times in ((24, 3), (6, 3), (4, 2)):
        assert periodic.runs_of(np.array(words, np.int64), least, times) == plain_runs(words, least, times)


def test_special_words():
    fib, tm = "0", "0"
    a, b = "0", "01"
    while len(b) < 700:
        a, b = b, b + a
    fib = [int(c) for c in b]
    tm = [bin(i).count("1") % 2 for i in range(512)]
    for words in (fib, tm, [0] * 500, [0, 1] * 300 + [0, 1, 1] * 200, list(range(100)) * 4):
        for least, times in ((24, 3), (2, 2)):
            assert periodic.runs_of(np.array(words), least, times) == plain_runs(words, least, times)


def test_automaton_has_every_suffix_once():
    rng = random.Random(1)
    for _ in range(100):
        words = [rng.randrange(3) for _ in range(rng.randint(0, 30))]
        link, length, ends = periodic.automaton(words)
        distinct = {tuple(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
        assert sum(length[s] - length[link[s]] for s in range(1, len(link))) == len(distinct)
        assert [length[s] for s in ends] == list(range(1, len(words) + 1))


def test_stretches_hold_every_run_whole():
    rng = random.Random(2)
    for _ in range(100):
        words = [rng.randrange(2) for _ in range(rng.randint(0, 200))]
        found = periodic.stretches(np.array(words, np.int64), 16)
        for start, n, _ in plain_runs(words):
            assert any(a <= start and start + n <= b for a, b in found)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = plain_runs([ids[w] for w in words])
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    one = hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
    two = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, one, two)


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        words = [rng.choice("ab cé d e f\x1cg".split(" ")) + str(rng.randrange(40)) for _ in range(rng.randint(0, 150))]
        if k % 3 == 0:
            words += words[-5:] * rng.randint(0, 9) + words[:3]
        rows.append((k * 7, rng.choice((" ", "\n", " \t")).join(words), "x"))
    rows += [(None, "a b " * 40, None), (5, None, "x"), (6, "", "x"), (-4, "z " * 3000, "x"), rows[0], (rows[0][0], "other text", None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, f"file://{tmp_path}")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain_row(k, t)) for k, t, _ in rows)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, _, _ in rows)


def test_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "q " * 30, "old")], "doc_id long, text string, period string")
    row = periodic.find_runs(frame).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli, row.collapsed) == (1, 0, 30, 1, 30000, "q")
    assert periodic.find_runs(frame.limit(0)).collect() == []
