import math

import numpy as np
import pytest

from scorefold.llm import embeddings
from scorefold.llm.components import connected_components
from tests.llm.test_simhash import brute_components


def table(seed, dims=24):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(160):
        v = rng.standard_normal(dims)
        rows.append((10 * k, v, k % 3))
        for j in range(3):
            rows.append((10 * k + j + 1, v + rng.standard_normal(dims) * [0.02, 0.19, 0.22][j], k % 3))
    rows = [(i, [float(x) for x in v.astype(np.float32)], n) for i, v, n in rows]
    hot = rows[0][1]
    rows += [(5000 + k, hot, 0) for k in range(50)] + [(6000, [2 * x for x in hot], 0), (6001, hot, 1), (6002, hot, None)]
    odd = [(7000, None, 0), (7001, [], 0), (7002, [0.0] * dims, 0), (7003, [float("nan")] * dims, 0), (7004, [1.0] * (dims - 1) + [None], 0), (7005, [float("inf")] + [1.0] * (dims - 1), 0), (7006, [1.0] * 3, 0), (7007, [1.0] * 3, 0)]
    return rows + odd


@pytest.mark.parametrize(("seed", "chunk", "crowd"), [(1, 2048, 128), (2, 16, 1)])
def test_against_brute_force(spark, seed, chunk, crowd):
    rows = table(seed)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, component_id string")
    got = {r.vec_id: r for r in embeddings.near_vectors(frame, chunk=chunk, crowd=crowd).collect()}
    good = {i: (np.array(v), n) for i, v, n in rows if n is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    pairs = []
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, m), (y, n) = good[a], good[b]
            if m == n and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                pairs.append((a, b))
    want = brute_components([r[0] for r in rows], pairs)
    assert len(pairs) > 1300 and len(got) == len(rows)
    for i in want:
        assert got[i].n_links == sum(i in p for p in pairs), i
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    if seed == 1:
        assert embeddings.near_vectors(frame.limit(0)).collect() == []


def test_every_pair_shares_a_cell():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 64))
    w = v + rng.standard_normal((400, 64)) * 0.19
    cos = (v * w).sum(1) / np.linalg.norm(v, axis=1) / np.linalg.norm(w, axis=1)
    near = cos >= 0.98
    assert near.sum() > 100
    ids = np.arange(400)
    for grid in (2, 4):
        index = {(int(i), b, tuple(c)) for rows, b, cell, _ in embeddings.cells(ids, v, 0.98, 8, grid, False) for i, c in zip(rows, cell.tolist(), strict=True)}
        probe = {(int(i), b, tuple(c)) for rows, b, cell, _ in embeddings.cells(ids, w, 0.98, 8, grid, True) for i, c in zip(rows, cell.tolist(), strict=True)}
        shared = {i for i, _, _ in index & probe}
        assert set(np.flatnonzero(near).tolist()) <= shared


def test_repeated_ids_are_vectors_of_their_own(spark):
    a, b, near_b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 1.0, 0.05, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, a, 0), (3, near_b, 0), (4, b, 1), (4, b, 1), (None, a, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame).collect() if r.vec_id is not None)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


def test_a_crowd_of_near_copies_makes_few_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    near = [centre + rng.standard_normal(64) * 0.03 for _ in range(600)]
    rows = [(k, [float(x) for x in v.astype(np.float32)], 0) for k, v in enumerate([*near, *(centre + rng.standard_normal(64) * 0.17 for _ in range(40))])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    seen = []
    monkeypatch.setattr(embeddings, "connected_components", lambda ties: seen.append(ties.count()) or connected_components(ties))
    got = {r.vec_id: r for r in embeddings.near_vectors(frame).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert [got[k].n_links for k in range(len(rows))] == want.tolist() and want[:600].min() >= 599
    assert seen[0] < 30_000 and all(got[k].component_id == 0 for k in range(600))
