import numpy as np

from scorefold.llm import quality


def test_chunks_cover_every_byte():
    rng = np.random.default_rng(1)
    for n in (0, 1, 509, 510, 511, 512, 513, 955, 956, 960, 961, 5000):
        text = "".join(map(chr, rng.integers(97, 123, n)))
        x = quality.chunks_of(text)
        step = quality.CHUNK - quality.OVERLAP
        joined = b"".join(c[:step].tobytes() for c in x) + x[-1][step:].tobytes()
        assert joined[:n] == text.encode() and not any(joined[n:])


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = {k: v.astype(np.float64) for k, v in quality.new_network(3).items()}
    x = rng.integers(0, 256, (5, quality.CHUNK)).astype(np.uint8)
    owner, y = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss(n):
        total, top, count = quality.pooled(x, owner, 3, quality.tables(n), n["bias"])
        z = quality.head(n, total.astype(float) / count[:, None], top.astype(float))[2]
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    grads = quality.gradients(net, x, owner, y)
    for name in ("bias", "hidden", "out", "kernel"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        more, less = ({k: v.copy() for k, v in net.items()} for _ in range(2))
        more[name][at] += 1e-2
        less[name][at] -= 1e-2
        assert abs((loss(more) - loss(less)) / 2e-2 - grads[name][at]) < 0.1 * abs(grads[name][at]) + 2e-3, name


def test_learns_and_scores_odd_texts(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    rows = []
    for k in range(240):
        text = " ".join(rng.choice(words, 150))
        rows.append((k, text if k % 2 else text.replace(" ", "### "), k % 2, "clash"))
    rows += [(900, None, None, None), (901, "", 1, None), (None, "dal bon", 0, None), (902, "dal bon " * 40000, 1, None), rows[0]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, score string")
    net = quality.fit(frame.where("doc_id < 200"))
    got = quality.score(frame, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 240]
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in held) >= 38
    assert quality.score(frame.limit(0), quality.fit(frame.limit(0))).collect() == []


def test_a_text_scores_the_same_alone_and_in_company(spark):
    texts = [(k, "ab c" * n) for k, n in enumerate((1, 500, 3, 9000, 0))]
    net = quality.new_network(5)
    schema = "doc_id long, text string"
    together = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(texts, schema), net).collect()}
    for row in texts:
        assert abs(quality.score(spark.createDataFrame([row], schema), net).first().score - together[row[0]]) < 1e-5


def slow_score(text, net):
    """Every filter at every position of every chunk in plain loops."""
    maxima = []
    for chunk in quality.chunks_of(text):
        vectors = [net["embed"][int(b)].astype(float) for b in chunk]
        values = [[sum(float(vectors[p + k] @ net["kernel"][k][:, f]) for k in range(quality.KERNEL)) + float(net["bias"][f]) for f in range(quality.FILTERS)] for p in range(0, quality.CHUNK - quality.KERNEL + 1, quality.STRIDE)]
        assert len(values) == quality.WINDOWS * quality.SPAN
        for w in range(quality.WINDOWS):
            part = values[w * quality.SPAN : (w + 1) * quality.SPAN]
            maxima.append([max(0.0, max(v[f] for v in part)) for f in range(quality.FILTERS)])
    both = [sum(m[f] for m in maxima) / len(maxima) for f in range(quality.FILTERS)] + [max(m[f] for m in maxima) for f in range(quality.FILTERS)]
    inner = [max(0.0, sum(both[k] * float(net["hidden"][k, h]) for k in range(len(both))) + float(net["hidden_bias"][h])) for h in range(quality.HIDDEN)]
    logit = sum(inner[h] * float(net["out"][h]) for h in range(quality.HIDDEN)) + float(net["out_bias"][0])
    return 1 / (1 + np.exp(-logit))


def test_scores_as_in_plain_loops(spark):
    rng = np.random.default_rng(9)
    texts = ["", None, "abc", "".join(map(chr, rng.integers(32, 400, 700))), "x" * 510]
    net = quality.new_network(6)
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    assert all(abs(got[k] - slow_score(t, net)) < 1e-4 for k, t in enumerate(texts))


def test_the_last_byte_of_a_full_chunk_counts(spark):
    net = quality.new_network(6)
    for n in (509, 510, 956):
        rows = [(k, "a" * (n - 1) + c) for k, c in enumerate("ab")]
        one, two = (r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), net).orderBy("doc_id").collect())
        assert one != two


def test_tied_labels_and_long_samples(spark):
    rows = [(k, "bad " * (20 + k % 7) if k % 2 else "fine " * 30, k % 2) for k in range(60)] + [(61, "bad bad", 0), (61, "bad bad", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.score(frame, quality.fit(frame)).where("doc_id < 60").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) >= 55
    assert quality.score(frame, quality.fit(frame, most_bytes=4000)).count() == len(rows)


def test_lengths_taken_before_a_join_give_the_same_network(spark):
    frame = spark.createDataFrame([(k, None if k == 5 else "bad " * (k % 9), k % 2) for k in range(40)], "doc_id long, text string, quality int")
    known = frame.selectExpr("*", "octet_length(text) AS n")
    for most in (64 << 20, 4000):
        one, two = quality.fit(frame, most_bytes=most), quality.fit(known, most_bytes=most, n_bytes="n")
        assert all(np.array_equal(one[k], two[k]) for k in one)
