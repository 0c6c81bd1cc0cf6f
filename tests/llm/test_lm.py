import collections
import math

import numpy as np
import pytest

from scorefold.llm import common, lm

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def small_model(texts, seed=0, size=3000):
    """A model with the counts of `texts` and random weights, made without Spark."""
    counts = np.bincount(np.concatenate(texts), minlength=size)
    codes = lm.codes_of(counts)
    column, share, plain = lm.columns_of(counts)
    behind = np.zeros((len(plain), lm.CELLS), np.float32)
    for ids in texts:
        code = codes[ids]
        np.add.at(behind, (column[ids], np.concatenate([[lm.START], code[:-1]])), 1)
        np.add.at(behind, (column[ids[2:]], lm.CODES + lm.coarse(code[:-2])), 1)
    rng = np.random.default_rng(seed)
    net = {k: (0.3 * rng.standard_normal(s)).astype(np.float32) for k, s in lm.SHAPES.items()}
    copying = np.r_[0, rng.random(lm.RUNS - 1) * 0.9].astype(np.float32)
    return {"dtype": "<u2", "codes": codes, "column": column, "share": share, "plain": plain, "values": lm.values_of(behind, plain), "copying": copying, "net": net}


def some_texts(seed=7):
    rng = np.random.default_rng(seed)
    texts = [(rng.zipf(1.3, n) % 3000).astype("<u2") for n in (1, 2, 15, 16, 17, 33, 400)]
    return [*texts, np.tile(texts[5], 3)]


def slow_distribution(ids, t, model):
    """P of every id at place t of a text, attention over its own window in plain loops."""
    net, inputs = model["net"], [lm.START, *model["codes"][ids[:-1]].tolist()]
    rough = [min(c, lm.COARSE - 1) for c in inputs]
    total, hit = np.exp(float(net["sink"][rough[t]])), np.exp(float(net["sink"][rough[t]])) * model["plain"].astype(float)
    for j in range(max(0, t // lm.STEP * lm.STEP - lm.CONTEXT), t + 1):
        w = np.exp(float(net["query"][rough[t]].astype(float) @ net["key"][rough[j]] + net["weight"][rough[j]] + net["far"][t - j]))
        total += w
        hit = hit + w * model["values"][:, inputs[j] if j == t else lm.CODES + rough[j]].astype(float)
    p = (hit / total)[model["column"]] * model["share"]
    pair = tuple(ids[t - 2 : t])
    at = max((j for j in range(1, t - 1) if (ids[j - 1], ids[j]) == pair), default=None) if t >= 2 else None
    if at is None:
        return p
    run, k = 0, t
    while k > 2:  # how often in a row the guess was right before
        k -= 1
        pair = tuple(ids[k - 2 : k])
        before = max((j for j in range(1, k - 1) if (ids[j - 1], ids[j]) == pair), default=None)
        if before is None or ids[before + 1] != ids[k]:
            break
        run += 1
    w = float(model["copying"][1 + min(run, lm.RUNS - 2)])
    p = (1 - w) * p
    p[ids[at + 1]] += w
    return p


def test_texts_score_as_in_plain_loops():
    texts = some_texts()
    model = small_model(texts)
    attention = lm.Attention(model["values"], model["plain"])
    attention.set(model["net"])
    got = lm.text_scores(texts, model, attention)
    want = [sum(math.log10(slow_distribution(ids, t, model)[ids[t]]) for t in range(len(ids))) for ids in texts]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)
    assert abs(slow_distribution(texts[-1], 40, model).sum() - 1) < 1e-3 and abs(slow_distribution(texts[3], 0, model).sum() - 1) < 1e-3


def test_gradients_match_differences():
    texts = some_texts(8)
    model = small_model(texts)
    x = np.concatenate([lm.windows_of(model["codes"][i]) for i in texts]).astype(np.intp)
    y = np.concatenate([lm.targets_of(model["column"][i].astype(np.int32)) for i in texts]).astype(np.intp)
    real = (y >= 0).astype(np.float32)
    attention = lm.Attention(model["values"], model["plain"])

    def loss(net):
        attention.set(net)
        return float(-(np.log(attention.probabilities(x, np.maximum(y, 0)).astype(float)) * real).sum() / real.sum())

    attention.set(model["net"])
    for name, g in attention.gradients(x, np.maximum(y, 0), real).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        more, less = ({k: v.copy() for k, v in model["net"].items()} for _ in range(2))
        more[name][at] += 0.01
        less[name][at] -= 0.01
        assert abs((loss(more) - loss(less)) / 0.02 - g[at]) < 0.02 * abs(g[at]) + 1e-5, name


def test_pointer_looks_back_only():
    def slow(ids):
        out, run = [], 0
        for t in range(len(ids)):
            pair = tuple(ids[t - 2 : t])
            at = max((j for j in range(1, t - 1) if (ids[j - 1], ids[j]) == pair), default=None) if t >= 2 else None
            right = at is not None and ids[at + 1] == ids[t]
            out.append((0 if at is None else 1 + min(run, lm.RUNS - 2), right))
            run = run + 1 if right else 0
        return out

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 50, 200):
        ids = rng.integers(0, 4, n).astype("<u2")
        bucket, right = lm.pointer(ids)
        assert list(zip(bucket.tolist(), right.tolist(), strict=True)) == slow(ids.tolist())


def test_base_counts_and_scores(spark):
    rng = np.random.default_rng(5)
    vocab = [f"Word{k}" for k in range(200)]
    rows = [(k, " ".join(vocab[int(x)] for x in rng.zipf(1.5, 60) % 200), k % 10 != 0, 1.0) for k in range(120)]
    rows += [(500, None, True, None), (501, "", False, None), (502, "unseen\tUNSEEN É x", False, None), (None, "word1 word2", True, None), (503, "word1 " * 20000, False, None), rows[3], rows[3]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean, score double")
    got = lm.score(frame, PATH, "train").collect()
    c = collections.Counter()
    for _, t, train, _ in rows:
        if train:
            c.update([*common.words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), 6)) for i, t, _, _ in rows for w in [common.words(t)])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    untrained = lm.score(frame.where("NOT train"), PATH, "train").collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 for r in untrained)
    assert lm.score(frame.limit(0), PATH, "train").collect() == []


def test_cold_words_and_training_beat_the_base(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 3)
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(rng.choice(["the cat sat on the mat", "der Hund lag auf der Matte", "a b c d"][k % 3].split(), 80)), k % 5 != 0) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    counts = lm.word_counts(frame.where("train"))
    assert len(lm.hot_words(counts, 3)[0]) <= 3
    got = [r for r in lm.score(frame, PATH, "train").collect() if not r.train]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_training_sees_every_window_of_every_document():
    texts = some_texts(9)
    model = small_model(texts)
    for ids in texts:
        parts = [lm.windows_for(ids, model, number, 3) for number in range(3)]
        want = zip(lm.windows_of(model["codes"][ids]), lm.targets_of(model["column"][ids].astype(np.int32)), strict=True)
        assert sorted((x.tobytes(), y.tobytes()) for xs, ys in parts for x, y in zip(xs, ys, strict=True)) == sorted((x.tobytes(), y.tobytes()) for x, y in want)


def test_wide_vocabularies_keep_their_ids(spark):
    ids = np.array([70_000, 5, 70_000, 69_999, 70_000], "<u4")
    counts = lm.id_counts(spark.createDataFrame([(bytearray(ids.tobytes()),)], "ids binary"), 70_001)
    assert counts[70_000] == 3 and counts[69_999] == 1 and counts.sum() == 5


def test_hash_table_finds_what_is_there():
    rng = np.random.default_rng(11)
    words = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.arange(50, dtype=np.uint64), [np.uint64(2**64 - 1)]]))
    asked = np.concatenate([words, rng.integers(0, 1 << 63, 5000, dtype=np.uint64)])
    want = [int(np.searchsorted(words, h)) if h in set(words.tolist()) else -1 for h in asked[-100:].tolist()]
    assert (lm.HashTable(words).find(asked)[: len(words)] == np.arange(len(words))).all()
    assert lm.HashTable(words).find(asked)[-100:].tolist() == want
    assert (lm.HashTable(np.zeros(0, np.uint64)).find(asked) == -1).all()


def test_hashed_words_tell_words_apart_as_words_does():
    rng = np.random.default_rng(12)
    letters = ["a", "B", "b", " ", "\t", "\x0b", "\x1c", "é", "É", "\u2003", "漢"]
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 60, 300)] + [None, "", " ", "x " * 3000, "Y" * 5000, "\ud800 q"]
    for block in (16, 1 << 20):
        hashes, sizes = common.hashed_words(texts, block)
        found = [common.words(t) for t in texts]
        assert sizes.tolist() == [len(w) for w in found]
        pairs = set(zip([w for ws in found for w in ws], hashes.tolist(), strict=True))
        assert len({w for w, _ in pairs}) == len({h for _, h in pairs}) == len(pairs)


def test_attention_works_on_no_pair_that_lies_ahead():
    texts = some_texts(13)
    model = small_model(texts)
    attention = lm.Attention(model["values"], model["plain"])
    attention.set(model["net"])
    x = np.concatenate([lm.windows_of(model["codes"][i]) for i in texts]).astype(np.intp)
    y = np.maximum(np.concatenate([lm.targets_of(model["column"][i]) for i in texts]), 0)
    cells, *_ = attention.attend(x, y, True)
    rough = lm.coarse(x)
    want = [rough[:, lm.CONTEXT + k] * lm.COARSE + rough[:, j] for k in range(lm.STEP) for j in range(lm.CONTEXT + k + 1)]
    assert sorted(cells.ravel().tolist()) == sorted(np.concatenate(want).tolist())


def test_merged_totals_are_those_of_both_sides():
    rng = np.random.default_rng(14)
    keys, total, want = np.zeros(0, np.int32), np.zeros(0, np.int64), collections.Counter()
    for n in (0, 5, 300, 0, 300, 1):
        drawn = rng.integers(0, 200, n).astype(np.int32)
        keys, total = lm.merged(keys, total, *np.unique(drawn, return_counts=True))
        want.update(drawn.tolist())
        assert list(zip(keys.tolist(), total.tolist(), strict=True)) == sorted(want.items())
