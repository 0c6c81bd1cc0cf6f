"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily, longest piece first. While room is left, the bin's smallest piece may give way to two unpacked
pieces that together fill the expanded gap more tightly. Only pieces longer than a sequence are cut.

Only row numbers and lengths are packed; the other columns meet their places in a join. Pieces are dealt into groups of about
`group_ids` ids by a hash of the row number, so copies, sources or lengths that fill the table cannot meet in one task, and
neither a task's memory nor the share of sequences that are not full depends on the size of the table or on a session
setting: each group wastes part of its last sequence, one in some thousand. Small tables are one group.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import common


def pack_lengths(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; every length is from 1 to room."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(room + 2))
    left = (ends[1:] - ends[:-1]).tolist()  # pieces of each length not packed yet
    there = sum(1 << n for n in np.flatnonzero(left).tolist())  # bit n: some piece of length n is left
    masks = [(2 << n) - 1 for n in range(room + 1)]
    present = np.array(left, np.int64) > 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> None:
        nonlocal there
        left[n] -= 1
        if not left[n]:
            there &= ~(1 << n)
            present[n] = False

    def give(n: int) -> None:
        nonlocal there
        left[n] += 1
        there |= 1 << n
        present[n] = True

    def best_pair(gap: int, more_than: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum in (more_than, gap]."""
        a = np.flatnonzero(present[: gap + 1])
        if not len(a):
            return None
        fit = np.maximum.accumulate(np.where(present[: gap + 1], np.arange(gap + 1), 0))
        b = fit[gap - a]
        single = (b == a) & (np.array([left[n] for n in a.tolist()]) < 2) if (b == a).any() else np.zeros(len(a), bool)
        if single.any():
            b = np.where(single, fit[np.maximum(a - 1, 0)], b)
        total = np.where(b > 0, a + b, 0)
        k = int(np.argmax(total))
        return (int(a[k]), int(b[k])) if total[k] > more_than else None

    number, next_of = 0, ends[:-1].tolist()
    while there:
        gap, bin_ = room, []
        while fit := there & masks[gap]:
            n = fit.bit_length() - 1
            k = min(left[n], gap // n)
            for _ in range(k):
                take(n)
            bin_ += [n] * k
            gap -= n * k
            if not gap:
                break
        while gap and there:
            smallest = bin_[-1]
            pair = best_pair(gap + smallest, smallest)
            if pair is None:
                break
            bin_.pop()
            give(smallest)
            for n in pair:
                take(n)
            gap += smallest - sum(pair)
            bin_ = sorted([*bin_, *pair], reverse=True)
        at = 0
        for n in bin_:
            piece = order[next_of[n]]
            next_of[n] += 1
            bins[piece], offsets[piece] = number, at
            at += n
        number += 1
    return bins, offsets


def cut_pieces(encoded: DataFrame, room: int) -> DataFrame:
    """Each document's ids cut into pieces of at most room: the input columns with piece, start, length and the piece's ids."""
    size = F.expr("octet_length(ids) div 4")
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / room).cast("int") - 1))
    rows = encoded.withColumns({"_size": size, "piece": F.explode(cuts)}).where("_size > 0")
    start = F.col("piece").cast("long") * room
    length = F.least(F.lit(room).cast("long"), F.col("_size") - start)
    ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
    return rows.select(*[c for c in encoded.columns if c not in ("ids", "piece", "start", "length")], "piece", start.alias("start"), length.alias("length"), ids.alias("ids"))


def pack(pieces: DataFrame, room: int, group_ids: int = 1 << 22) -> DataFrame:
    """pieces with sequence_id and offset: within a sequence the pieces are gapless from 0 and hold at most room ids.

    pieces: a `length` from 1 to room, and any other columns; columns named sequence_id or offset are replaced. Repeated rows
    are packed once each. An empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    # a row's number is fixed once the table is written
    rows = common.written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil((rows.agg(F.sum("length")).first()[0] or 0) / group_ids))
    dealt = rows.select("_row", F.col("length").cast("long").alias("length")).repartition(groups, "_row")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held = [(b.column("_row").to_numpy(), b.column("length").to_numpy()) for b in batches]
        if not held:
            return
        numbers, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(numbers)  # a task that runs again packs alike
        numbers, lengths = numbers[order], lengths[order]
        bins, offsets = pack_lengths(lengths, room)
        bins += np.int64(TaskContext.get().partitionId()) << 40
        for at in range(0, len(numbers), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_pydict({"_row": pa.array(numbers[part]), "sequence_id": pa.array(bins[part]), "offset": pa.array(offsets[part])})

    return rows.join(dealt.mapInArrow(run, "_row long, sequence_id long, offset long"), "_row").select(*pieces.columns, "sequence_id", "offset")
