"""Periodic runs of words in whole texts: every maximal stretch that repeats with a smallest period, and the text without them.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, TIMES * q) words that neither neighbour
extends keeping that period. Runs come out of a suffix automaton of the words with link-cut access: a state's suffix links lead
through all suffixes of a prefix, longest first, so the links form a tree, and appending word i recolours the path from the
prefix's state to the root with i. Each piece of the path that had one colour p before holds the suffixes, of a range of
lengths, that last ended at p. Where the distance i - p lies in that range, the suffix of that length stands twice in a row
and is not itself a repetition: a square ends at i. Squares of one period that end at consecutive words make up a run. Path
pieces are splay trees, so a text of n words costs O(n log n).

Only words that a repeated sequence of LEAST - LEAST // TIMES words covers can be in a run, as a run repeats at least so much of
itself. Rolling hashes find them; the automaton is built for each stretch of such words, which holds every run that meets it
whole. A collision of hashes makes a stretch longer, never a run wrong.

Words are `[^\\x20\\x09-\\x0D]+` and count from 0. Null and empty texts have no words and no runs. Rows count on their own; other
columns pass, those named like a result are replaced.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame

from scorefold.llm import common

LEAST, TIMES = 24, 3
FIELDS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def automaton(words: list[int]) -> tuple[array, array, array]:
    """Suffix links and longest lengths of the states of the suffix automaton, and the state of each prefix.

    Most states have one transition, which stands in two arrays; dictionaries hold the others."""
    link, length, word, to = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [-1])
    more: dict[int, dict[int, int]] = {}
    ends, last = array("i"), 0
    for i, w in enumerate(words):
        state, p = len(link), last
        link.append(0)
        length.append(i + 1)
        word.append(-1)
        to.append(-1)
        target = -1
        while p >= 0:
            if word[p] < 0:
                word[p], to[p] = w, state
            elif word[p] == w:
                target = to[p]
                break
            elif p not in more:
                more[p] = {w: state}
            elif w in more[p]:
                target = more[p][w]
                break
            else:
                more[p][w] = state
            p = link[p]
        if p >= 0:
            if length[target] == length[p] + 1:
                link[state] = target
            else:
                copy = len(link)
                link.append(link[target])
                length.append(length[p] + 1)
                word.append(word[target])
                to.append(to[target])
                if target in more:
                    more[copy] = dict(more[target])
                link[state] = link[target] = copy
                while p >= 0:
                    if word[p] == w:
                        if to[p] != target:
                            break
                        to[p] = copy
                    elif more[p][w] == target:
                        more[p][w] = copy
                    else:
                        break
                    p = link[p]
        ends.append(state)
        last = state
    return link, length, ends


class Paths:
    """A tree whose root paths are recoloured; pieces of one colour are splay trees, ordered by depth."""

    def __init__(self, parent: array):
        self.up = parent[:]
        self.left = array("i", [-1]) * len(parent)
        self.right = array("i", [-1]) * len(parent)
        self.colour = array("i", [-1]) * len(parent)

    def splay(self, x: int) -> None:
        """Make x the root of its splay tree; the root knows the piece's colour and what the piece hangs from."""
        up, left, right = self.up, self.left, self.right
        top = p = up[x]
        if p < 0 or (left[p] != x and right[p] != x):
            return
        while True:
            g = up[p]
            if g < 0 or (left[g] != p and right[g] != p):
                top = p
                self.turn(x)
                break
            top = g
            self.turn(p if (left[p] == x) == (left[g] == p) else x)
            self.turn(x)
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                break
        self.colour[x] = self.colour[top]

    def turn(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = right[x]
            left[p], right[x] = b, p
        else:
            b = left[x]
            right[p], left[x] = b, p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from x to the root; (deepest node, old colour) of its pieces, from x up."""
        up, right, colours, below, found = self.up, self.right, self.colour, -1, []
        while x >= 0:
            self.splay(x)
            found.append((x, colours[x]))
            if right[x] >= 0:
                colours[right[x]] = colours[x]
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return found


def squares_to_runs(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, in order of start and period."""
    link, length, ends = automaton(words)
    paths = Paths(link)
    begun: dict[int, int] = {}
    last: dict[int, int] = {}
    runs = []

    def end(d: int) -> None:
        if last[d] - begun[d] + 1 >= max(least, times * d):
            runs.append((begun[d], last[d] - begun[d] + 1, d))

    for i, state in enumerate(ends):
        pieces = paths.access(state, i)
        for k, (x, p) in enumerate(pieces):
            d = i - p
            if p < 0 or d > length[x]:
                continue
            if k + 1 < len(pieces) and d <= length[pieces[k + 1][0]]:
                continue
            if last.get(d, -2) != i - 1:
                if d in last:
                    end(d)
                begun[d] = i - 2 * d + 1
            last[d] = i
    for d in last:
        end(d)
    return sorted(runs)


def stretches(words: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal [from, to) covered by sequences of `width` words that occur more than once."""
    keys = common.rolling((words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), width)
    if len(keys) < 2:
        return []
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return []
    edge = np.zeros(len(words) + 1, np.int64)
    at = order[np.r_[False, same] | np.r_[same, False]]
    edge[at] += 1
    edge[at + width] -= 1
    covered = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    bounds = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True))


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's word numbers, in order of start and period."""
    if len(words) < least:
        return []
    found = []
    for a, b in stretches(words, least - least // times):
        found += [(a + start, n, period) for start, n, period in squares_to_runs(words[a:b].tolist(), least, times)]
    return found


def periodic(text: str | None, least: int = LEAST, times: int = TIMES) -> tuple:
    """FIELDS of one text."""
    words = common.exact_words(text)
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    runs = runs_of(numbers, least, times)
    best = (None,) * 4
    if runs:
        top = runs[0]
        for r in runs[1:]:
            if r[1] * top[2] > top[1] * r[2]:
                top = r
        best = (*top, 1000 * top[1] // top[2])
        dropped = np.zeros(len(words), bool)
        for start, n, period in runs:
            dropped[start + period : start + n] = True
        words = [w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone]
    shown = [{"start": a, "length": n, "period": q} for a, n, q in runs]
    return len(numbers), len(runs), *best, shown, b" ".join(words).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with n_words, n_runs, the run of the greatest length / period (ties: smallest start, then period; nulls where there
    is none), all runs, and collapsed: the words that no run holds after its first period, joined by one space."""

    def make():
        return lambda texts: list(zip(*(periodic(t, least, times) for t in texts), strict=True)) if texts else [[]] * 8

    return common.with_columns_from_text(docs, text, FIELDS, make)
