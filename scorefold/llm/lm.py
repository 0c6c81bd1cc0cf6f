"""Language-model scores of whole texts: a causal self-attention model in numpy on subword ids, beside a word unigram base.

Base. Words (A-Z lowered, parted by ASCII white space) are counted over all training documents. The most frequent ones (at
most HOT) go to every task; all others meet their counts in a shuffle join on the word's hash, so the vocabulary is never
gathered. Two words share a 64-bit hash with odds of about n**2 / 2**65.

Model. The next id's probability is what attention says: sum over the places seen of (attention weight) * (probability that
the place's value gives the id). The most frequent ids have codes of their own, the others share one. Queries and keys are
learned vectors of codes, with learned relative positions, a learned weight of each key and a learned sink for "none of
these", whose value is the plain frequency. Values are distributions over the ids, one for the place just before and one for
places further back, counted over all training documents; ids too rare for that share a column, dealt by frequency. A second
head attends to one place alone: the one behind the last occurrence of the same two ids in the same text; its weight depends
on how often in a row it was right. All parts are distributions over the vocabulary, so the scores are log-probabilities.

A text is cut into overlapping windows: each window scores its last STEP ids and uses the CONTEXT before them as context only,
so every id, the end id included, is scored once. Windows are scored in batches with masked attention.

Training. Every window of every training document is trained on, dealt over `rounds` rounds. Tasks run Adam over what they
read; their weights are averaged in Spark. So what is learned from grows with the corpus and with the length of its texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import common
from scorefold.llm.subwords import subwords
from scorefold.llm.token_files import smallest_dtype

CODES, COARSE, CONTEXT, STEP, DIM, HOT = 1024, 256, 16, 16, 16, 200_000
SPAN = CONTEXT + STEP  # CONTEXT is a multiple of STEP
#: Codes of the start of a text and of filling; then ids go by frequency, and the last code stands for all others. Only the
#: values of the place just before tell all codes apart; everything else takes those from COARSE - 1 on for one.
START, FILL = 0, 1
CELLS = CODES + COARSE
#: Ids seen less often share a column of values; ids that a value distribution is worth beside the plain frequencies.
LEAST, PRIOR = 5, 20.0
#: Runs of right guesses of the copying head that are told apart; bucket 0 is "nothing to copy".
RUNS = 9
#: Windows whose attention is worked out at once: their arrays stay in a core's cache, and numpy's calls are few.
PART = 512


# --- base: word counts --------------------------------------------------------------------------------------------------


def word_counts(train: DataFrame, text: str = "text", block: int = 1 << 20) -> DataFrame:
    """(word, c): hash and count of every word of the training documents, summed per block of words before the shuffle."""
    import pyarrow as pa

    def run(batches):
        held, size = [], 0

        def out():
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"word": pa.array(words.view(np.int64)), "c": pa.array(counts.astype(np.int64))})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(common.hashed_words(batch.column(0).slice(at, 256).to_pylist())[0])
                size += len(held[-1])
                if size >= block:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return train.select(text).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def hot_words(counts: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (ascending) and counts of the most frequent words, at most `most`, and the count from which a word is one."""
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for at, n in sizes:
        total += n
        if total > most:
            break
        least = at
    found = counts.where(level >= least).select("word", "c").toArrow()
    words, c = found.column("word").to_numpy().astype(np.int64).view(np.uint64), found.column("c").to_numpy().astype(np.int64)
    order = np.argsort(words)
    return words[order], c[order], least


class HashTable:
    """Places of hashes in an ascending array of them, by their leading bits."""

    def __init__(self, words: np.ndarray, bits: int = 20):
        self.words, self.shift = words, np.uint64(64 - bits)
        self.first = np.searchsorted(words >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is not there."""
        out = np.full(len(hashes), -1)
        bucket = (hashes >> self.shift).astype(np.intp)
        at, stop = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            place = at[left]
            hit = self.words[place] == hashes[left]
            out[left[hit]] = place[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


# --- counts of subword ids ----------------------------------------------------------------------------------------------


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each subword id stands in rows(ids); at most one row per id comes to the driver."""
    import pyarrow as pa

    kind = smallest_dtype(size)

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(at, 256)
                total += np.bincount(np.frombuffer(b"".join(part.to_pylist()), kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at), "n": pa.array(total[at])})

    out = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def pointer(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every id of a text: the bucket of the copying head's guess for it, and whether the guess is right."""
    n = len(ids)
    bucket, right = np.zeros(n, np.int64), np.zeros(n, bool)
    if n < 3:
        return bucket, right
    # two stable sorts order the pairs, places ascending among equal ones
    first, second = ids[:-1], ids[1:]
    order = np.argsort(second, kind="stable")
    order = order[np.argsort(first[order], kind="stable")]
    before = np.full(n - 1, -1)
    a, b = first[order], second[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    before[order[1:][same]] = order[:-1][same]
    # pair k ends at id k + 1 and guesses id k + 2 by what followed the same pair before
    before = before[:-1]
    right[2:] = (before >= 0) & (ids[np.maximum(before, 0) + 2] == ids[2:])
    at = np.arange(n)
    run = at - np.maximum.accumulate(np.where(right, -1, at))
    bucket[2:] = np.where(before >= 0, 1 + np.minimum(run[1:-1], RUNS - 2), 0)
    return bucket, right


def coarse(codes: np.ndarray) -> np.ndarray:
    return np.minimum(codes, COARSE - 1)


def codes_of(counts: np.ndarray) -> np.ndarray:
    """Code of every id: its own for the most frequent ones."""
    codes = np.full(len(counts), CODES - 1, np.int16)
    often = np.argsort(-counts, kind="stable")[: CODES - 3]
    often = often[counts[often] > 0]
    codes[often] = FILL + 1 + np.arange(len(often))
    return codes


def columns_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of every id in the values, its share of that column, and the plain frequency of each column; the last is shared."""
    known = np.flatnonzero(counts >= LEAST)
    column = np.full(len(counts), len(known), np.intp)
    column[known] = np.arange(len(known))
    smooth = counts + 0.1
    total = np.bincount(column, smooth, len(known) + 1)
    return column, (smooth / total[column]).astype(np.float32), (total / total.sum()).astype(np.float32)


def merged(keys: np.ndarray, total: np.ndarray, found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals of the keys of both sides, each ascending and without repeats."""
    at = np.searchsorted(keys, found)
    old = np.zeros(len(found), bool)
    inside = at < len(keys)
    old[inside] = keys[at[inside]] == found[inside]
    total[at[old]] += n[old]
    return np.insert(keys, at[~old], found[~old]), np.insert(total, at[~old], n[~old])


def followers(rows: DataFrame, codes: np.ndarray, column: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts [columns, CELLS] of ids one place behind each code and two places behind each coarse one, and [RUNS, 2] of the
    copying head's guesses.

    At most CELLS cells per id come to the driver, whatever the corpus."""
    import pyarrow as pa

    kind = smallest_dtype(size)
    columns = int(column.max()) + 1
    first = (column * CELLS).astype(np.int32 if columns * CELLS < 1 << 31 else np.int64)
    near, back = codes.astype(first.dtype), (CODES + coarse(codes)).astype(first.dtype)

    def run(batches):
        held, count, right = [], 0, np.zeros((RUNS, 2), np.int64)
        cells, total = np.zeros(0, first.dtype), np.zeros(0, np.int64)

        for batch in batches:
            for x in batch.column(0):
                ids = np.frombuffer(x.as_buffer(), kind)
                cell = first[ids]
                held += [cell[:1] + START, cell[1:] + near[ids[:-1]], cell[2:] + back[ids[:-2]]]
                bucket, good = pointer(ids)
                right += np.bincount(bucket * 2 + good, minlength=2 * RUNS).reshape(RUNS, 2)
                count += len(ids)
                if count > 1 << 20:
                    cells, total = merged(cells, total, *np.unique(np.concatenate(held), return_counts=True))
                    held, count = [], 0
        if held:
            cells, total = merged(cells, total, *np.unique(np.concatenate(held), return_counts=True))
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.concatenate([cells.astype(np.int64), -1 - np.arange(2 * RUNS)])), "n": pa.array(np.concatenate([total, right.ravel()]))})

    found = rows.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, n = found.column("cell").to_numpy(), found.column("n").to_numpy()
    right = np.zeros(2 * RUNS)
    right[-1 - cells[cells < 0]] = n[cells < 0]
    counts = np.zeros(columns * CELLS, np.float32)
    counts[cells[cells >= 0]] = n[cells >= 0]
    return counts.reshape(columns, CELLS), right.reshape(RUNS, 2)


def values_of(counts: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """[columns, CELLS]: probability of each column given a code just before, or a coarse code further back."""
    total = counts.sum(0, dtype=np.float64)
    return ((counts + PRIOR * plain[:, None]) / (total + PRIOR)).astype(np.float32)


# --- the attention model ------------------------------------------------------------------------------------------------

SHAPES = {"query": (COARSE, DIM), "key": (COARSE, DIM), "weight": (COARSE,), "sink": (COARSE,), "far": (SPAN,)}
#: For each distance of a key from a query of a window, the first query that has a key so far back, and where the distance's
#: pairs of query and key begin among all pairs. What lies ahead of a query is in no pair.
FIRST = [max(0, d - CONTEXT) for d in range(SPAN)]
BEGIN = [sum(STEP - f for f in FIRST[:d]) for d in range(SPAN + 1)]


def new_net() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(0)
    net = {k: (rng.standard_normal(s) * (0.1 if len(s) == 2 else 0)).astype(np.float32) for k, s in SHAPES.items()}
    net["far"] = (-0.3 * np.arange(SPAN) - 2 * (np.arange(SPAN) > 0)).astype(np.float32)
    net["sink"] -= 1
    return net


def flat(net: dict) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


class Attention:
    """Batched masked attention over windows. Queries and keys are functions of codes, so exp(q . k) is read from a table of
    code pairs: exp(q . k + far) = exp(q . k) * exp(far). Pairs of places are worked on distance by distance, for all windows
    of a batch at once: a distance's queries and keys are slices of the windows, and what lies ahead costs nothing."""

    def __init__(self, values: np.ndarray, plain: np.ndarray):
        self.values, self.plain = values.ravel(), plain

    def set(self, net: dict) -> None:
        self.net = net
        self.pairs = np.exp(np.clip(net["query"] @ net["key"].T + net["weight"], -40, 40))
        self.pairs[:, FILL] = 0
        self.far = np.exp(np.clip(net["far"], -20, 20))
        self.none = np.exp(np.clip(net["sink"], -40, 40))

    def attend(self, x: np.ndarray, column: np.ndarray, kept: bool) -> tuple:
        """x: codes [n, SPAN]; column: of the ids to predict [n, STEP]. Cells of the pair table, weights, weights times values
        of all pairs, by distance [BEGIN[-1], n] (the last distance's alone, unless kept); the rough codes [SPAN, n]; the sink's
        weight, its value, and sums of weights and of weights times values [STEP, n]."""
        x, column, n = np.ascontiguousarray(x.T), np.ascontiguousarray(column.T), len(x)
        rough = coarse(x)
        query, near = rough[CONTEXT:] * COARSE, column * CELLS
        back = near + CODES
        pairs = BEGIN[-1] if kept else STEP
        cells, places = np.empty((pairs, n), np.intp), np.empty((STEP, n), np.intp)
        weights, given = np.empty((2, pairs, n), np.float32)
        none, plain = self.none.take(rough[CONTEXT:]), self.plain.take(column)
        total, hit = none.copy(), none * plain
        for d, f in enumerate(FIRST):
            at = slice(BEGIN[d], BEGIN[d + 1]) if kept else slice(0, STEP - f)
            cell, weight, value, place = cells[at], weights[at], given[at], places[f:]
            keys = rough[CONTEXT + f - d : SPAN - d]
            np.add(query[f:], keys, out=cell)
            self.pairs.take(cell, mode="clip", out=weight)
            weight *= self.far[d]
            if d:
                np.add(back[f:], keys, out=place)
            else:
                np.add(near, x[CONTEXT:], out=place)
            self.values.take(place, mode="clip", out=value)
            value *= weight
            total[f:] += weight
            hit[f:] += value
        return cells, weights, given, rough, none, plain, total, hit

    def probabilities(self, x: np.ndarray, column: np.ndarray) -> np.ndarray:
        *_, total, hit = self.attend(x, column, False)
        return (hit / total).T

    def gradients(self, x: np.ndarray, column: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean of -log p over the real targets."""
        cells, weights, given, rough, none, plain, total, hit = self.attend(x, column, True)
        share = real.T / np.float32(max(real.sum(), 1))
        one, two = share / total, share / hit
        for d, f in enumerate(FIRST):
            at = slice(BEGIN[d], BEGIN[d + 1])
            weights[at] *= one[f:]
            given[at] *= two[f:]
        weights -= given
        pairs = np.bincount(cells.ravel(), weights.ravel(), COARSE * COARSE).reshape(COARSE, COARSE).astype(np.float32)
        sink = none * (one - two * plain)
        return {
            "query": pairs @ self.net["key"],
            "key": pairs.T @ self.net["query"],
            "weight": pairs.sum(0),
            "sink": np.bincount(rough[CONTEXT:].ravel(), sink.ravel(), COARSE).astype(np.float32),
            "far": np.add.reduceat(weights.sum(1), BEGIN[:-1]),
        }


def windows_of(codes: np.ndarray, first: int = 0, every: int = 1) -> np.ndarray:
    """Codes of a text's windows, from the codes of its ids (the end id last): [n, SPAN]. Place k holds what stands before id k.
    Of all windows the one numbered `first` and each `every`-th after it."""
    n = -(-len(codes) // STEP)
    padded = np.full(CONTEXT + n * STEP, FILL, codes.dtype)
    padded[CONTEXT] = START
    padded[CONTEXT + 1 : CONTEXT + len(codes)] = codes[:-1]
    blocks = padded.reshape(-1, STEP)
    return np.concatenate([blocks[k + first : k + n : every] for k in range(SPAN // STEP)], axis=1)


def targets_of(columns: np.ndarray) -> np.ndarray:
    """The columns to predict, filled up with -1: [n, STEP]."""
    n = -(-len(columns) // STEP)
    padded = np.full(n * STEP, -1, columns.dtype)
    padded[: len(columns)] = columns
    return padded.reshape(n, STEP)


def windows_for(ids: np.ndarray, model: dict, number: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and targets of a text that round `number` trains on; each window belongs to one of the rounds."""
    first = (number - len(ids)) % rounds
    return windows_of(model["codes"].take(ids), first, rounds), targets_of(model["column"].take(ids))[first::rounds].astype(np.int32)


def train_round(rows: DataFrame, model: dict, number: int, rounds: int, rate: float, held: int = 1 << 16, steps: int = 150) -> dict[str, np.ndarray]:
    """One round over the windows of rows(ids) dealt to it: each task runs Adam from the model's weights, `held` windows at a
    time; the weights, averaged by windows, come back."""
    import pyarrow as pa

    start, kind = flat(model["net"]), model["dtype"]

    def run(batches):
        net, attention, rng = unflat(start.copy()), Attention(model["values"], model["plain"]), np.random.default_rng(number)
        one, two = ({k: np.zeros(s, np.float32) for k, s in SHAPES.items()} for _ in range(2))
        step = seen = 0

        def learn(x, y):
            nonlocal net, step
            batch = min(1024, max(32, len(x) // steps))
            for _ in range(max(1, min(6, -(-steps * batch // len(x)) if len(x) < steps * 32 else 1))):
                order = rng.permutation(len(x))
                for at in range(0, len(x), batch):
                    attention.set(net)
                    picked = order[at : at + batch]
                    grads, parts = None, -(-len(picked) // PART)
                    for part in np.array_split(picked, parts):
                        wide, column = x[part].astype(np.intp), y[part].astype(np.intp)
                        found = attention.gradients(wide, np.maximum(column, 0), (column >= 0).astype(np.float32))
                        grads = found if grads is None else {k: grads[k] + g for k, g in found.items()}
                    step += 1
                    for k, g in grads.items():
                        g /= parts
                        one[k] = 0.9 * one[k] + 0.1 * g
                        two[k] = 0.99 * two[k] + 0.01 * g * g
                        net[k] = net[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)

        xs, ys, size = [], [], 0
        for batch in batches:
            for ids in batch.column(0):
                x, y = windows_for(np.frombuffer(ids.as_buffer(), kind), model, number, rounds)
                if len(x):
                    xs.append(x)
                    ys.append(y)
                    size += len(x)
                    if size >= held:
                        learn(np.concatenate(xs), np.concatenate(ys))
                        xs, ys, seen, size = [], [], seen + size, 0
        if size:
            learn(np.concatenate(xs), np.concatenate(ys))
            seen += size
        if seen:
            values = flat(net).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(values))), "value": pa.array(values * seen), "n": pa.array(np.full(len(values), seen, np.int64))})

    found = rows.select("ids").mapInArrow(run, "at long, value double, n long").groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value")).collect()
    if not found:
        return model["net"]
    values = np.zeros(len(start))
    for r in found:
        values[r["at"]] = r["value"]
    return unflat(values)


def fit(rows: DataFrame, size: int, rounds: int = 3, rate: float = 0.03) -> dict:
    """Codes, values, copying head and weights from rows(ids) of all training documents."""
    counts = id_counts(rows, size)
    codes = codes_of(counts)
    column, share, plain = columns_of(counts)
    behind, right = followers(rows, codes, column, size)
    copying = (right[:, 1] + 0.5) / (right.sum(1) + 2)
    copying[0] = 0
    model = {"dtype": smallest_dtype(size), "codes": codes, "column": column, "share": share, "plain": plain, "values": values_of(behind, plain), "copying": copying.astype(np.float32), "net": new_net()}
    for number in range(rounds):
        model["net"] = train_round(rows, model, number, rounds, rate / (1 + number))
    return model


def text_scores(rows: list[np.ndarray], model: dict, attention: Attention) -> list[float]:
    """log10 probability of each text's ids, of which the end id is one."""
    found, xs, ys, size = [], [], [], 0

    def flush():
        nonlocal xs, ys, size
        x, y = np.concatenate(xs), np.concatenate(ys)
        for at in range(0, len(x), PART):
            column = y[at : at + PART].astype(np.intp)
            p = attention.probabilities(x[at : at + PART].astype(np.intp), np.maximum(column, 0))
            found.append(p[column >= 0])
        xs, ys, size = [], [], 0

    for ids in rows:
        x, y = windows_of(model["codes"].take(ids)), targets_of(model["column"].take(ids))
        for at in range(0, len(x), 2048):
            xs.append(x[at : at + 2048])
            ys.append(y[at : at + 2048])
            size += len(xs[-1])
            if size >= 2048:
                flush()
    if size:
        flush()
    of_head = np.concatenate(found) if found else np.zeros(0, np.float32)
    out, at = [], 0
    for ids in rows:
        p = of_head[at : at + len(ids)] * model["share"][ids]
        bucket, right = pointer(ids)
        weight = model["copying"][bucket]
        p *= 1 - weight
        p += weight * right
        out.append(float(np.log10(p).sum(dtype=np.float64)))
        at += len(ids)
    return out


# --- all together -------------------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, tokenizer: str, hot: tuple, ends: int, n_train: int, distinct: int, doc_id: str, text: str, train: str) -> DataFrame:
    """Per document: ids (in the smallest type that holds them, the end id last), the base score of end and hot words, and its other words."""
    import pyarrow as pa

    words, counts, _ = hot
    scale = np.log10(n_train + 0.1 * (distinct + 1))
    hot_scores = np.log10(np.append(counts, 0) + 0.1) - scale
    end_score = float(np.log10(ends + 0.1) - scale)

    def run(batches):
        coder, table = subwords(tokenizer), HashTable(words)
        kind = smallest_dtype(coder.vocabulary + 1)
        end = np.array([coder.vocabulary], kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(text).to_pylist()
                ids = [np.frombuffer(coder.ids(t), "<u4").astype(kind).tobytes() + end for t in texts]
                found, sizes = common.hashed_words(texts)
                owner = np.repeat(np.arange(len(texts)), sizes)
                place = table.find(found)
                cold = place < 0
                base = end_score + np.bincount(owner, np.where(cold, 0, hot_scores[place]), len(texts))
                known = np.bincount(owner, ~cold, len(texts)).astype(np.int64) + (ends > 0)
                of, rest = owner[cold], found[cold]
                order = np.lexsort((rest, of))
                of, rest = of[order], rest[order]
                first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (rest[1:] != rest[:-1])]) if len(of) else np.zeros(0, np.intp)
                offsets = pa.array(np.searchsorted(of[first], np.arange(len(texts) + 1)).astype(np.int32))
                cold_words = pa.ListArray.from_arrays(offsets, pa.array(rest[first].view(np.int64)))
                cold_counts = pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(first, len(of))).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id), part.column(train), pa.array(ids, pa.binary()), pa.array(base), pa.array(known), pa.array(sizes + 1, pa.int64()), cold_words, cold_counts],
                    names=["doc_id", "train", "ids", "base", "n_known", "n_tokens", "words", "counts"],
                )
        coder.forget()

    rows = docs.select(doc_id, train, text).mapInArrow(run, "doc_id long, train boolean, ids binary, base double, n_known long, n_tokens long, words array<long>, counts array<int>")
    # the row's number is fixed once the table is written
    return common.written(rows.withColumn("row", F.monotonically_increasing_id()), "lm-documents")


def score(docs: DataFrame, tokenizer: str, train: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, train, n_tokens, n_known, train_tokens, base_score and score.

    train: a boolean column, the documents to learn from. Null and empty texts hold the end token alone. Repeated rows are
    counted and scored once each. Without training documents every base probability is 1 and the model is the untrained one.
    """
    import pyarrow as pa

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(train), F.lit(False)).alias("train"), F.col(text).alias("text"))
    learned = docs.where("train")
    common.text_batches(docs.sparkSession)
    counts = common.written(word_counts(learned), "lm-words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = learned.count()
    n_train, distinct = tokens + ends, distinct + (ends > 0)
    hot = hot_words(counts)
    rows = encoded(docs, tokenizer, hot, ends, n_train, distinct, "doc_id", "text", "train")
    scale = float(np.log10(n_train + 0.1 * (distinct + 1)))
    cold = rows.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("k"))
    rare = counts.where(F.floor(F.log2("c") * 8).cast("long") < hot[2])
    met = cold.join(rare, "word", "left").select("row", (F.col("k") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - scale)).alias("s"), F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0).alias("known"))
    rest = met.groupBy("row").agg(F.sum("s").alias("s"), F.sum("known").alias("known"))
    size = subwords(tokenizer).vocabulary + 1  # the end id comes behind the vocabulary
    model = fit(rows.where("train"), size)

    def run(batches):
        attention = Attention(model["values"], model["plain"])
        attention.set(model["net"])
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), model["dtype"]) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["ids"]).columns, pa.array(text_scores(ids, model, attention), pa.float64())], names=["row", "doc_id", "train", "base", "n_known", "n_tokens", "score"])

    scored = rows.select("row", "doc_id", "train", "base", "n_known", "n_tokens", "ids").mapInArrow(run, "row long, doc_id long, train boolean, base double, n_known long, n_tokens long, score double")
    out = scored.join(rest, "row", "left")
    return out.select(
        "doc_id", "train", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("base_score"),
        "score",
    )
