import numpy as np
import pytest
import xxhash

from scorefold.llm import common, simhash
from scorefold.llm.components import connected_components


def brute_components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)]
    edges = spark.createDataFrame([*pairs, (7, 7), pairs[0]], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    want = brute_components({n for p in pairs for n in p}, pairs)
    assert got == want
    assert connected_components(edges.limit(0)).collect() == []


def reference(text, width):
    found = [] if text is None else [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not found:
        return 0
    runs = [" ".join(found[k : k + width]) for k in range(max(1, len(found) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, "One", "one two", "One two THREE", "É é É four five", "a\tb\nc a b c a b c", "  x  y  z w v  ", "long " * 40000]


def test_fingerprints():
    for text in TEXTS:
        for width in (3, 5):
            assert simhash.fingerprint(common.words(text), width) == reference(text, width), text


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 30).tolist()
    values = set(base)
    for v in base:
        for _ in range(12):
            flipped = v
            for b in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                flipped ^= 1 << b
            values.add(flipped - (1 << 64) if flipped >= 1 << 63 else flipped)
    values = sorted(values)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "simhash long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & mask).bit_count() <= 2}


def test_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(5 + k, t, "x", None) for k, t in enumerate(TEXTS)]
    for k in range(120):
        words = [f"w{x}" for x in rng.integers(0, 4000, 400)]
        rows.append((100 + 3 * k, " ".join(words), None, "clash"))
        words[int(rng.integers(0, 400))] = "changed"
        rows.append((101 + 3 * k, " ".join(words), None, "clash"))
    rows += [rows[-1], (3, rows[-1][1], None, None), (None, "no id", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, simhash string, component_id string")
    got = simhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    prints = {r[0]: reference(r[1], 3) for r in rows if r[0] is not None}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = brute_components(ids, pairs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.simhash & ((1 << 64) - 1), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert simhash.near_duplicates(frame.limit(0)).collect() == []


def test_pipeline_drops_what_fingerprints_link(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(40)]
    # repeats outweigh the shingles that differ: equal fingerprints, but of different sets of shingles
    rows = [(k, " ".join(["the same few words again and again"] * 400 + [f"{x}{w}" for w in words])) for k, x in enumerate("ab")] + [(2, " ".join(words))]
    links = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in links} == {0: 0, 1: 0, 2: 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [0, 2]
    assert sorted(r.doc_id for r in simhash.near_copies(docs).where("kept").collect()) == [0, 1, 2]
