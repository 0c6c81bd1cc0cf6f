"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, pivot, end of clause, other). Small transducers, each with
one concern, rewrite the symbols: negation marks what stands in its scope, reported speech marks what stands behind it in
its clause, target lets a threat count only towards someone and strengthens an insult near one. They are composed into one
table, which is run over every clause with a matched word; a clause's weight is the sum over its arcs. The clause weights of
a text, not its single words, give the score by a logistic fit.

Threats, targets, negations and reports are fixed lists. Insults are learned from labelled texts: words and word beginnings
that stand in many different surroundings in toxic texts and hardly in others (surroundings, so that copies of one text
count once). At most about `labelled` rows are read for that.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import common

#: Fixed word lists.
THREAT = "kill hurt shoot stab beat destroy murder töten schlagen umbringen tuer frapper matar golpear".split()
TARGET = "you your yourself he she they them people du dich dir ihr euch tu toi vous te tú usted vosotros ellos".split()
NEGATION = "not never no isn aren wasn don doesn nicht kein keine nie pas jamais no nunca".split()
REPORT = "said says wrote claimed called quoted sagte schrieb dit écrit dijo escribió".split()
PIVOT = "but however aber mais pero".split()
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
OTHER, INSULT, THREATEN, SOMEONE, NOT, SAID, BUT, END = range(8)
#: Marks that transducers add to a symbol of OTHER..END.
NEGATED, REPORTED, AIMED = 8, 16, 32


class Transducer:
    """Deterministic, letter to letter: arcs[state](symbol) gives the next state and the symbol handed on."""

    def __init__(self, states: int, arc):
        self.states, self.arc = states, arc


def base(symbol: int) -> int:
    return symbol & 7


def negation(reach: int = 3) -> Transducer:
    """Insults and threats within `reach` words behind a negation are marked; a pivot or the clause's end lifts it."""

    def arc(state, symbol):
        kind = base(symbol)
        if kind == NOT:
            return reach, symbol
        if kind in (BUT, END):
            return 0, symbol
        return max(state - 1, 0), symbol | NEGATED if state and kind in (INSULT, THREATEN) else symbol

    return Transducer(reach + 1, arc)


def reported() -> Transducer:
    def arc(state, symbol):
        kind = base(symbol)
        if kind == SAID:
            return 1, symbol
        if kind == END:
            return 0, symbol
        return state, symbol | REPORTED if state and kind in (INSULT, THREATEN) else symbol

    return Transducer(2, arc)


def aimed() -> Transducer:
    """State: bit 0 someone was named in the clause, bit 1 a threat waits for a target."""

    def arc(state, symbol):
        kind = base(symbol)
        if kind == END:
            return 0, symbol
        if kind == SOMEONE:
            return 1, symbol | AIMED if state & 2 else symbol
        if kind == THREATEN:
            return (state, symbol | AIMED) if state & 1 else (state | 2, symbol)
        return state, symbol | AIMED if kind == INSULT and state & 1 else symbol

    return Transducer(4, arc)


#: Weight of a marked symbol: (kind, negated, reported, aimed); a threat without a target weighs nothing.
def arc_weight(symbol: int) -> float:
    kind, weight = base(symbol), 0.0
    if kind == INSULT:
        weight = 1.5 if symbol & AIMED else 1.0
    elif kind == THREATEN and symbol & AIMED or kind == SOMEONE and symbol & AIMED:
        weight = 1.5
    if symbol & NEGATED:
        weight *= 0.3
    if symbol & REPORTED:
        weight *= 0.6
    return weight


def compose(*parts: Transducer) -> tuple[list[list[int]], list[list[float]]]:
    """The product machine over symbols OTHER..END: next state and arc weight; state 0 is the start of a clause."""
    sizes = [p.states for p in parts]
    number = {s: k for k, s in enumerate(itertools.product(*map(range, sizes)))}
    goes, weighs = [], []
    for states in number:
        goes.append([])
        weighs.append([])
        for symbol in range(8):
            now, after = symbol, []
            for part, state in zip(parts, states, strict=True):
                state, now = part.arc(state, now)
                after.append(state)
            goes[-1].append(number[tuple(after)])
            weighs[-1].append(arc_weight(now))
    return goes, weighs


#: Lengths of the word beginnings that are looked at beside whole words; a beginning is written with a final "*".
STEMS = (5, 6, 7, 8)
FIXED = {w: k for k, group in ((THREATEN, THREAT), (SOMEONE, TARGET), (NOT, NEGATION), (SAID, REPORT), (BUT, PIVOT)) for w in group}


def patterns_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if n < len(word))]


class Lexicon(dict):
    """The first transducer: token to (symbol, weight). Tokens met before cost one lookup; it starts anew when full."""

    def __init__(self, insults: dict[str, float], most: int = 100_000):
        super().__init__()
        self.insults, self.most = insults, most

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        if token in ".!?;:\n":
            found = (END, 1.0)
        elif token in FIXED:
            found = (FIXED[token], 1.0)
        else:
            weights = [self.insults[p] for p in patterns_of(token) if p in self.insults]
            found = (INSULT, max(weights)) if weights else (OTHER, 1.0)
        self[token] = found
        return found


class Grammar:
    def __init__(self, insults: dict[str, float]):
        self.lexicon = Lexicon(insults)
        self.goes, self.weighs = compose(negation(), reported(), aimed())

    def clauses(self, text: str | None) -> list[float]:
        """Weights of the matched clauses of a whole text."""
        low = (text or "").lower()
        if not any(1 <= symbol <= 2 for symbol, _ in map(self.lexicon.__getitem__, WORD.findall(low))):
            return []
        found, state, weight = [], 0, 0.0
        for token in itertools.chain(TOKEN.findall(low), "."):
            symbol, strength = self.lexicon[token]
            weight += self.weighs[state][symbol] * strength
            state = self.goes[state][symbol]
            if symbol == END and weight:
                found.append(weight)
                weight = 0.0
        return found


def features(clauses: list[float]) -> tuple[float, float, float]:
    return (1.0, math.log1p(sum(clauses)), max(clauses, default=0.0))


def score_of(clauses: list[float], weights: np.ndarray) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(features(clauses), weights))))))


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", labelled: int = 12_000, share: float = 0.9, flush: int = 50_000) -> dict:
    """train: labelled rows (at most about `labelled` of them are read). Null texts and labels teach nothing.

    A task holds at most about `flush` surroundings at a time."""
    rows = train.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), (F.col(label) == 1).alias("_toxic"))
    common.text_batches(rows.sparkSession)
    rows = common.written(common.bounded_sample(rows, labelled), "toxicity-sample")
    toxic = rows.where("_toxic").count()
    least = max(4, toxic // 60)

    def surroundings(only: dict | None):
        def run(batches):
            import pyarrow as pa

            def out():
                at = np.array([x for x, _, _ in seen], np.intp)
                return pa.RecordBatch.from_pydict({"word": pa.array(names).take(pa.array(at)), "side": pa.array([x for _, x, _ in seen], pa.int64()), "doc": pa.array([x for _, _, x in seen], pa.int64())})

            # repeated entries of the last few texts are left out here, all others by the aggregation
            seen, names, number = set(), [], {}
            for batch in batches:
                for key, text in zip(batch.column("_key"), batch.column("_text"), strict=True):
                    found, doc = WORD.findall(text.as_py().lower()), key.as_py() or 0
                    for before, word, after in zip([""] + found, found, found[1:] + [""], strict=False):
                        patterns = patterns_of(word) if only is None else [p for p in patterns_of(word) if p in only]
                        if patterns:
                            side = xxhash.xxh64_intdigest(f"{before} {after}") >> 1
                            for p in patterns:
                                k = number.get(p)
                                if k is None:
                                    k = number[p] = len(names)
                                    names.append(p)
                                seen.add((k, side, doc))
                            if len(seen) >= flush:
                                yield out()
                                seen, names, number = set(), [], {}
            if seen:
                yield out()

        return run

    def counted(bad: bool, only: dict | None = None) -> DataFrame:
        side = rows.where(F.col("_toxic") == bad).select(F.col("_key").cast("long").alias("_key"), "_text")
        each = side.mapInArrow(surroundings(only), "word string, side long, doc long").groupBy("word", "side").agg(F.min("doc").alias("doc"))
        return each.groupBy("word").agg(F.count("*").alias("n"), F.approx_count_distinct("doc").alias("docs"))

    # a candidate stands in `least` toxic texts of the sample at least: no more than its (patterns / least) can be
    bad = {r["word"]: r["n"] for r in counted(True).where((F.col("n") >= least) & (F.col("docs") >= least)).collect()}
    bad = {w: n for w, n in sorted(bad.items()) if w not in FIXED}
    good = {r["word"]: r["n"] for r in counted(False, bad).collect()} if bad else {}
    insults = {w: 1.0 + 0.1 * math.log((n + 0.5) / (good.get(w, 0) + 0.5)) for w, n in bad.items() if n >= share * (n + good.get(w, 0))}
    insults = {w: x for w, x in insults.items() if not any(p in insults for p in patterns_of(w.rstrip("*")) if p.endswith("*"))}

    def make():
        grammar = Grammar(insults)

        def work(texts):
            found = [features(grammar.clauses(t)) for t in texts]
            return [f[1] for f in found], [f[2] for f in found]

        return work

    table = common.with_columns_from_text(rows, "_text", "_sum double, _max double", make).select("_sum", "_max", "_toxic").collect()
    x = np.array([(1.0, r["_sum"], r["_max"]) for r in table]).reshape(-1, 3)
    y = np.array([float(r["_toxic"]) for r in table])
    return {"insults": insults, "weights": logistic(x, y)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton's method with a small ridge, so that separable rows stay finite."""
    w = np.zeros(x.shape[1])
    if not len(y):
        return np.array([-4.0, 2.0, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
    return w


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and matched_clauses; null and empty texts match nothing."""

    def make():
        grammar, weights = Grammar(model["insults"]), model["weights"]

        def work(texts):
            found = [grammar.clauses(t) for t in texts]
            return [score_of(f, weights) for f in found], [len(f) for f in found]

        return work

    return common.with_columns_from_text(docs, text, "score double, matched_clauses long", make)
