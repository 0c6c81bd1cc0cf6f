"""Quality rules by weak supervision: rules vote or abstain, EM estimates how often each is right, a posterior decides.

`measure` counts what the rules look at over every whole text. Each rule turns its count into a vote: 1 (good), -1 (bad) or 0
(it abstains). Nobody says which rule is right: texts have a hidden quality, a rule that votes is right with a probability of
its own on good and on bad texts, and expectation-maximisation finds these accuracies and the share of good texts from the
votes of all rows. Each count carries one start value's weight, so rules that seldom vote stay near it. What EM needs of the corpus is how often each combination of votes occurs: at most 3 ** len(RULES) counts,
whatever the number of texts, so they are worked out by one aggregation and EM runs on them exactly. `judge` is plain columns:
the log odds of the prior plus those of the accuracies of the votes cast.

Words are `[^\\x20\\x09-\\x0D]+`; windows of WINDOW words count as repeated where the same words in the same order stand at two
places of the text, overlapping or not. Null and empty texts have no words: all counts are 0, all rules abstain and the
posterior is the prior. Rows count on their own, whatever their ids; other columns pass, those named like a count are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorefold.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: What no ordinary word holds, in the words of the regex module and of RE2.
ODD_PATTERN = r"[^\p{L}\p{N}\p{M}.,;:!?()'\"-]"
ODD = regex.compile(ODD_PATTERN)
WINDOW = 3
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_letter_words long, n_capital_words long, n_ended_words long, n_odd_words long, n_top_word long"

#: name, value, and where it votes: good between the first two bounds, bad below the third or above the fourth, else it abstains.
RULES = (
    ("word_length", "word_chars / n_words", (3.0, 10.0), (2.0, 14.0)),
    ("symbols", "n_symbols / n_words", (0.0, 0.02), (None, 0.1)),
    ("letters", "n_letter_words / n_words", (0.9, 1.0), (0.75, None)),
    ("odd_words", "n_odd_words / n_words", (0.0, 0.1), (None, 0.4)),
    ("capitals", "n_capital_words / n_words", (0.0, 0.1), (None, 0.4)),
    ("sentence_ends", "n_ended_words / n_words", (0.01, 0.35), (None, 0.5)),
    ("repeated_words", "n_repeat_words / n_words", (0.0, 0.2), (None, 0.5)),
    ("repeated_lines", "n_dup_lines / n_lines", (0.0, 0.1), (None, 0.3)),
    ("top_word", "n_top_word / n_words", (0.0, 0.2), (None, 0.3)),
)


def repeated(words: list[str], window: int = WINDOW) -> int:
    """How many words stand in a window whose words occur in the same order at another place too."""
    if len(words) <= window:
        return 0
    ids: dict[str, int] = {}
    found = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    m = len(words) - window + 1
    key = found[:m]
    for k in range(1, window):  # numbers of prefixes below the number of words: the products stay far from 2 ** 63
        key = np.unique(key * len(ids) + found[k : k + m], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + m] |= twice
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    letters = capitals = ended = odd = top = 0
    for word, n in Counter(words).items():
        top = max(top, n)
        if word.isalpha() or any(map(str.isalpha, word)):
            letters += n
            capitals += n * (len(word) > 1 and word.isupper())
        ended += n * (word[-1] in ".!?")
        odd += n * (ODD.search(word) is not None)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated(words), letters, capitals, ended, odd, top


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS of the whole text."""

    def make():
        return lambda texts: list(zip(*map(counts, texts), strict=True))

    return common.with_columns_from_text(docs, text, COUNTS, make)


def vote(value: Column, good: tuple[float, float], bad: tuple[float | None, float | None]) -> Column:
    """1, -1 or 0; a null value abstains."""
    out = F.when(value.between(*good), 1)
    for test in ([value < bad[0]] if bad[0] is not None else []) + ([value > bad[1]] if bad[1] is not None else []):
        out = out.when(test, -1)
    return out.otherwise(0)


def with_votes(measured: DataFrame) -> DataFrame:
    """measured with votes: one small number for each of RULES, in their order."""
    values = [F.try_divide(*(F.col(x).cast("double") for x in value.split(" / "))) for _, value, _, _ in RULES]
    return measured.withColumn("votes", F.array(*[vote(v, good, bad) for v, (_, _, good, bad) in zip(values, RULES, strict=True)]))


@dataclass
class Model:
    """Share of good texts, and for each rule how often its vote is right on good and on bad texts where it votes."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Log odds that a vote for good and a vote for bad add, rule by rule."""
        return np.log(self.on_good / (1 - self.on_bad)), np.log((1 - self.on_good) / self.on_bad)


#: What EM starts from: good texts are many, rules seldom blame them, and each rule sees half of what is bad.
START_PRIOR, START_GOOD, START_BAD, MOST, ROUNDS = 0.8, 0.95, 0.5, 0.999, 50


def posterior(votes: np.ndarray, model: Model) -> np.ndarray:
    """Probability of good quality for each row of votes."""
    good, bad = model.weights()
    odds = np.log(model.prior / (1 - model.prior)) + (votes == 1) @ good + (votes == -1) @ bad
    return 1 / (1 + np.exp(-odds))


def expect_maximise(votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> Model:
    """EM over combinations of votes that occur n times.

    A rule that never votes keeps its start. A vote for bad is never taken as a sign of good, nor the other way round, so the
    hidden classes keep their names."""
    k = votes.shape[1]
    model = Model(START_PRIOR, np.full(k, START_GOOD), np.full(k, START_BAD))
    for _ in range(rounds if len(votes) else 0):
        good = posterior(votes, model)
        many, few = n * good, n * (1 - good)
        on_good = (many @ (votes == 1) + START_GOOD) / (many @ np.abs(votes) + 1)
        on_bad = (few @ (votes == -1) + START_BAD) / (few @ np.abs(votes) + 1)
        on_good = np.clip(on_good, 1 - MOST, MOST)
        model = Model(float(np.clip(many.sum() / n.sum(), 1 - MOST, MOST)), on_good, np.clip(np.maximum(on_bad, 1 - on_good), 1 - MOST, MOST))
    return model


def fit(voted: DataFrame) -> Model:
    """EM over all rows with a word; only the counts of vote combinations reach the driver."""
    found = sorted((tuple(r["votes"]), r["n"]) for r in voted.where("n_words > 0").groupBy("votes").agg(F.count("*").alias("n")).collect())
    return expect_maximise(np.array([v for v, _ in found], int).reshape(-1, len(RULES)), np.array([n for _, n in found], float))


def judge(voted: DataFrame, model: Model) -> DataFrame:
    """voted with quality, the posterior probability that the text is good."""
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for k, (good, bad) in enumerate(zip(*model.weights(), strict=True)):
        odds = odds + F.when(F.col("votes")[k] == 1, float(good)).when(F.col("votes")[k] == -1, float(bad)).otherwise(0.0)
    return voted.withColumn("quality", 1 / (1 + F.exp(-odds)))


def filter_quality(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs without their texts, with COUNTS, votes, quality and kept: whether the posterior is `least` or more.

    The counts are written once, so the texts are read once for fitting and judging."""
    voted = common.written(with_votes(measure(docs, text).drop(text)), "quality-votes")
    return judge(voted, fit(voted)).withColumn("kept", F.col("quality") >= least)
