import random
import re

import duckdb
import numpy as np

from scorefold.llm import queries, quality_rules

SCHEMA = "doc_id long, text string, lang string, n_words string"


def plain_counts(text):
    """The contract's five counts by plain loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def corpus():
    rng = random.Random(5)
    words = [a + b + c for a in ("lor", "mé", "tan", "ßi", "of", "ked") for b in ("em", "us", "ra", "o", "il") for c in ("", "ta", "ren", "ly", "do.")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 120))).replace("do. ", "do.\n") for _ in range(80)]
    texts += [" ".join(w + "$$$" for w in rng.choices(words, k=80)) for _ in range(8)]
    texts += [" | ".join(rng.choices(words, k=80)) for _ in range(8)]
    texts += [" ".join(w.upper() + "!!" for w in rng.choices(words, k=40) * 2) for _ in range(8)]
    texts += [None, "", "   \n\t", "a a a a", "\n\nab\nab\nab \n", "x " * 5000, "##", texts[0], texts[0]]
    return [(k, t, "xx", "clash") for k, t in enumerate(texts)] + [(None, texts[1], None, None), (3, "ab cd ab cd ab cd", None, None)]


def test_counts_equal_plain_loops():
    rng = random.Random(6)
    texts = [t for _, t, _, _ in corpus() if not t or len(t) < 3000]
    texts += ["".join(rng.choice("ab \n\t#\x0b\x1c ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        found = quality_rules.counts(t)
        assert (*found[:3], found[4], found[5]) == plain_counts(t), repr(t)


def test_em_finds_accuracies_and_keeps_the_names_of_the_classes():
    rng = np.random.default_rng(7)
    good = rng.random(40000) < 0.85
    on_good, on_bad = np.array([0.98, 0.9, 0.95, 0.97]), np.array([0.7, 0.4, 0.6, 0.5])
    right = rng.random((40000, 4)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((40000, 4)) < 0.9)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.expect_maximise(patterns, n.astype(float), 300)
    assert abs(model.prior - 0.85) < 0.03 and np.abs(model.on_good - on_good).max() < 0.03 and np.abs(model.on_bad - on_bad).max() < 0.08
    one = quality_rules.expect_maximise(votes, np.ones(len(votes)), 300)
    assert abs(one.prior - model.prior) < 1e-9
    assert quality_rules.expect_maximise(np.zeros((0, 4), int), np.zeros(0)).prior == quality_rules.START_PRIOR
    clean = quality_rules.expect_maximise(np.ones((1, 4), int), np.array([1000.0]))
    assert quality_rules.posterior(np.ones((1, 4), int), clean)[0] > 0.99


def test_junk_goes_and_prose_stays(spark):
    rows = corpus()
    got = quality_rules.filter_quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and "lang" in got[0].asDict()
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id != 3}
    assert all(kept[k] for k in range(80) if k != 3) and not any(kept[k] for k in range(80, 104))
    model = quality_rules.fit(spark.createDataFrame(rows, SCHEMA).transform(quality_rules.measure).transform(quality_rules.with_votes))
    for r in got:
        assert abs(r.quality - quality_rules.posterior(np.array([r.votes]), model)[0]) < 1e-9
    assert quality_rules.filter_quality(spark.createDataFrame(rows[:0], SCHEMA)).collect() == []


def test_query_equals_its_sql(spark, tmp_path):
    frame = spark.createDataFrame(corpus(), SCHEMA).drop("n_words")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_quality_rules(spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op11_quality_rules"])
    names = [d[0] for d in want.description]
    assert names == got.columns

    def shown(rows):
        return sorted(repr([round(x, 5) if isinstance(x, float) else x for x in r]) for r in rows)

    assert shown(map(tuple, got.collect())) == shown(want.fetchall())
