"""Quality score of whole texts by a byte-level convolutional network in numpy.

The text's UTF-8 bytes are cut into overlapping chunks that cover it to the last byte. Learned filters slide over each chunk
(byte embedding times kernel, kept as one table per kernel position), are max-pooled over windows of the chunk and pass a
rectifier. The mean and the largest pooled value of each filter over all windows of the text go through a small hidden layer
to one probability. Training and scoring both pool all chunks of a text, so every byte is read in both. The network is trained
by Adam on a bounded sample of labelled texts: about `labelled` of them, fewer where they are so long that they would hold
more than `most_bytes`. Null and empty texts are one chunk of zeros and get its score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import common

OVERLAP, KERNEL, STRIDE, FILTERS, EMBED, HIDDEN, WINDOWS, SPAN = 64, 8, 2, 24, 8, 12, 7, 36
POSITIONS = WINDOWS * SPAN
#: Bytes of a chunk: what the positions of all windows read, to the last byte.
CHUNK = (POSITIONS - 1) * STRIDE + KERNEL


def chunks_of(text: str | None) -> np.ndarray:
    """All chunks, [n, CHUNK] bytes; neighbours share OVERLAP bytes, the last one is filled up with zeros."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-max(len(raw) - OVERLAP, 1) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def new_network(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "embed": (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32),
        "kernel": (rng.standard_normal((KERNEL, EMBED, FILTERS)) * 2 / np.sqrt(KERNEL * EMBED)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": (rng.standard_normal((2 * FILTERS, HIDDEN)) * 0.3).astype(np.float32),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": (rng.standard_normal(HIDDEN) * 0.3).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }


def tables(net: dict) -> np.ndarray:
    """[KERNEL, 256, FILTERS]: what a byte at a kernel position adds to each filter."""
    return np.einsum("be,kef->kbf", net["embed"], net["kernel"])


def convolve(x: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter values [n, WINDOWS, SPAN, FILTERS] of chunks x."""
    z = np.take(table[0], x[:, 0 : STRIDE * (POSITIONS - 1) + 1 : STRIDE], axis=0)
    for k in range(1, KERNEL):
        z += np.take(table[k], x[:, k : k + STRIDE * (POSITIONS - 1) + 1 : STRIDE], axis=0)
    z += bias
    return z.reshape(len(x), WINDOWS, SPAN, FILTERS)


def head(net: dict, mean: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.concatenate([mean, top], 1)
    inner = both @ net["hidden"] + net["hidden_bias"]
    return both, inner, np.maximum(inner, 0) @ net["out"] + net["out_bias"][0]


def pooled(x: np.ndarray, owner: np.ndarray, n: int, table: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, largest value and number of pooled windows of each of n texts; owner: the text of each chunk, ascending."""
    total, top, count = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32), np.bincount(owner, minlength=n) * WINDOWS
    for at in range(0, len(x), 64):
        part = np.maximum(convolve(x[at : at + 64], table, bias).max(2), 0)
        own = owner[at : at + 64]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        total[own[first]] += np.add.reduceat(part.sum(1), first, axis=0)
        top[own[first]] = np.maximum(top[own[first]], np.maximum.reduceat(part.max(1), first, axis=0))
    return total, top, count


def gradients(net: dict, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    table = tables(net)
    where, best = np.empty((len(x), WINDOWS, FILTERS), np.int64), np.empty((len(x), WINDOWS, FILTERS), table.dtype)
    for at in range(0, len(x), 256):
        z = convolve(x[at : at + 256], table, net["bias"])
        where[at : at + 256] = z.argmax(2)
        best[at : at + 256] = z.max(2)
    a = np.maximum(best, 0).reshape(-1, FILTERS)
    text = np.repeat(owner, WINDOWS)
    count = np.bincount(text, minlength=len(y))[:, None]
    first = np.searchsorted(text, np.arange(len(y)))
    mean, top = np.add.reduceat(a, first, axis=0) / count, np.maximum.reduceat(a, first, axis=0)
    both, inner, logit = head(net, mean, top)
    d = (1 / (1 + np.exp(-logit)) - y) / len(y)
    d_inner = np.outer(d, net["out"]) * (inner > 0)
    d_both = d_inner @ net["hidden"].T
    d_a = (d_both[:, :FILTERS] / count)[text] + d_both[:, FILTERS:][text] * (a == top[text])
    d_best = (d_a * (a > 0)).reshape(best.shape)
    out = {"out": np.maximum(inner, 0).T @ d, "out_bias": np.array([d.sum()]), "hidden": both.T @ d_inner, "hidden_bias": d_inner.sum(0), "bias": d_best.sum((0, 1))}
    start = (where + np.arange(WINDOWS)[None, :, None] * SPAN) * STRIDE
    row = np.arange(len(x))[:, None, None]
    filters = np.arange(FILTERS)[None, None, :]
    out["embed"], out["kernel"] = np.zeros_like(net["embed"]), np.zeros_like(net["kernel"])
    for k in range(KERNEL):
        cell = x[row, start + k].astype(np.int64) * FILTERS + filters
        d_table = np.bincount(cell.ravel(), d_best.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
        out["kernel"][k] = net["embed"].T @ d_table
        out["embed"] += d_table @ net["kernel"][k].T
    return out


def train(samples: list[tuple[np.ndarray, float]], epochs: int = 5, batch: int = 32, rate: float = 0.01) -> dict[str, np.ndarray]:
    """samples: chunks and label of each text."""
    net, rng, step = new_network(), np.random.default_rng(1), 0
    one, two = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), batch):
            picked = [samples[k] for k in order[at : at + batch]]
            owner = np.repeat(np.arange(len(picked)), [len(c) for c, _ in picked])
            grads = gradients(net, np.concatenate([c for c, _ in picked]), owner, np.array([q for _, q in picked], np.float32))
            step += 1
            for k, g in grads.items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                net[k] = (net[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        rate *= 0.7
    return net


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = 4000, most_bytes: int = 64 << 20, n_bytes: str | None = None) -> dict[str, np.ndarray]:
    """A network from whole labelled texts; null labels are left out. Without rows it is the untrained one.

    n_bytes: a column with the texts' lengths in bytes. Where rows come out of a join, lengths taken before it spare the pass
    that measures the texts from carrying them through the join.
    """
    length = F.octet_length(text) if n_bytes is None else F.col(n_bytes)
    rows = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), length.alias("_bytes"), (F.col(label) == 1).cast("double").alias("_y"))
    n, size = rows.agg(F.count("*"), F.sum(F.coalesce("_bytes", F.lit(0)).cast("long") + CHUNK)).first()
    if not n:
        return new_network()
    most = labelled if size * labelled <= most_bytes * n else most_bytes * n // size
    picked = common.bounded_sample(rows, max(1, most), total=n)
    found = sorted((r["_text"] or "", r["_y"]) for r in picked.select("_text", "_y").collect())
    return train([(chunks_of(t), y) for t, y in found]) if found else new_network()


def score(docs: DataFrame, net: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1."""

    def make():
        table = tables(net)

        def work(texts):
            scores = []
            for at in range(0, len(texts), 64):
                found = [chunks_of(t) for t in texts[at : at + 64]]
                total, top = np.zeros((len(found), FILTERS), np.float32), np.zeros((len(found), FILTERS), np.float32)
                owner = np.repeat(np.arange(len(found)), [len(c) for c in found])
                count = np.bincount(owner, minlength=len(found)) * WINDOWS
                if len(owner) <= 4096:
                    total, top, _ = pooled(np.concatenate(found), owner, len(found), table, net["bias"])
                else:  # long texts one by one, without a second copy
                    for k, c in enumerate(found):
                        one, most, _ = pooled(c, np.zeros(len(c), int), 1, table, net["bias"])
                        total[k], top[k] = one[0], most[0]
                logit = head(net, total / count[:, None], top)[2].astype(float)
                scores += (1 / (1 + np.exp(-np.clip(logit, -30, 30)))).tolist()
            return (scores,)

        return work

    return common.with_columns_from_text(docs, text, "score double", make)
