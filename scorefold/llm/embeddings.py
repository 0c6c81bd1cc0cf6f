"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are compared within their label. Equal vectors are one class. Unit vectors of cosine c lie sqrt(2 - 2c) apart; a
random rotation, cut into low-dimensional blocks, keeps that distance, so in some block the squared distance of a pair is at
most its share of the whole budget. In each block a range join finds the pairs within that share: cells over the block's
first coordinates, twice the block radius wide, so a vector looks into two cells a coordinate; the block's distance is then
compared in batches. The union of the blocks' pairs is verified by the cosine in double precision.

A cell of many vectors is dealt over several tasks by chunks of both sides, so no cell is gathered whole. The number of
coordinates that make up a cell grows with the largest label, which changes cost only.

Crowds of near copies would give the square of their number of pairs. So the mean directions of the most crowded cells, HEARTS
of them at most, are held against all vectors of their label first. Angles obey the triangle inequality: two vectors whose angles
to one centre add up to no more than the angle of the limit are linked for certain. Angles are rounded up to ANGLES steps, so
how many such partners a vector has follows from counts by step; it is tied to the member next to the centre, and pairs of this
kind are left out of the join. All other pairs go through it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import common
from scorefold.llm.components import connected_components

#: Added to budgets against rounding of the rotated coordinates.
SLACK = 1e-5
#: Crowded cells whose centres are tried, and what makes a cell crowded.
HEARTS, CROWD = 64, 128
#: Steps of angles from a centre up to the angle of the limit; a heart's number and a step stand in one number.
ANGLES = 256
#: Steps from a heart within which a vector looks for no nearer one.
NEAR = 160


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int, width: int) -> list[tuple[int, int]]:
    count = max(1, dims // width)
    edges = np.linspace(0, dims, count + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def radius(cosine: float, blocks: int) -> float:
    return math.sqrt((2 - 2 * cosine) / blocks + SLACK)


def cells(rep: np.ndarray, vectors: np.ndarray, cosine: float, width: int, grid: int, probe: bool):
    """For every vector, block and cell: (rows, block, cell coordinates, block coordinates); probe: all cells within reach."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = units @ rotation(vectors.shape[1])
    edges = block_edges(vectors.shape[1], width)
    reach = radius(cosine, len(edges))
    for b, (lo, hi) in enumerate(edges):
        own = turned[:, lo:hi]
        g = min(grid, hi - lo)
        if not probe:
            yield np.arange(len(rep)), b, np.floor(own[:, :g] / (2 * reach)).astype(np.int64), own
            continue
        low, high = np.floor((own[:, :g] - reach) / (2 * reach)).astype(np.int64), np.floor((own[:, :g] + reach) / (2 * reach)).astype(np.int64)
        for corner in range(1 << g):
            up = np.array([corner >> k & 1 for k in range(g)], bool)
            rows = np.flatnonzero(((high > low) | ~up).all(1))
            yield rows, b, np.where(up, high, low)[rows], own[rows]


def numbered(label: np.ndarray, block: int, cell: np.ndarray) -> np.ndarray:
    """A 64-bit number of each label, block and cell; two cells of one number cost comparisons, no links."""
    out = label.astype(np.int64).view(np.uint64) + np.uint64(block + 1) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(cell.shape[1]):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + cell[:, k].astype(np.int64).view(np.uint64)
    return ((out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def stacked(column, dims: int) -> np.ndarray:
    """A binary Arrow column of doubles as rows of `dims` numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def by_dims(batch, name: str = "v"):
    """Places of a batch's rows and their vectors, for each number of dimensions."""
    import pyarrow.compute as pc

    size = pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False) // 8
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, stacked(batch.column(name).take(at), d)


def pack(batches):
    """(vec_id, label, v): usable vectors as the bytes of their doubles, null for the others."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        found = batch.column("v")
        offsets = found.offsets.to_numpy()
        values = found.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] + 0.0  # nulls are not finite, -0 is 0
        offsets = offsets - offsets[0]
        full = np.diff(offsets) > 0
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.zeros(len(full))
            size[full] = np.add.reduceat(values * values, offsets[:-1][full]) if full.any() else 0
        good = full & np.isfinite(size) & (size > 0)
        raw = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
        keep = pc.and_(pc.and_(pa.array(good), found.is_valid()), batch.column("label").is_valid())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pc.if_else(keep, raw, pa.scalar(None, pa.binary()))], names=["vec_id", "label", "v"])


def near_vectors(rows: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", width: int = 8, chunk: int = 2048, crowd: int = CROWD) -> DataFrame:
    """One row per row of the table: vec_id, n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing;
    so do vectors of different lengths, and rows without a vec_id. Rows of one vec_id count as that many vectors: classes of
    equal vectors have numbers of their own, and the least vec_id is taken of whole components.
    """
    import pyarrow as pa

    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    base = common.written(base.mapInArrow(pack, "vec_id long, label string, v binary"), "vectors")
    usable = base.where("v is not null and vec_id is not null")
    reps = usable.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumns({"rep": F.monotonically_increasing_id(), "name": F.xxhash64("label")})
    reps = common.written(reps, "vector-classes")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    grid = min(6, max(2, math.ceil(math.log(largest / 4000) / math.log(2.2)))) if largest > 4000 else 2

    def spread(probe: bool):
        def run(batches):
            for batch in batches:
                ids, names, hearts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "name", "heart"))
                for d, at, vectors in by_dims(batch):
                    share = radius(cosine, len(block_edges(d, width))) ** 2
                    for found, b, cell, own in cells(ids[at], vectors, cosine, width, grid, probe):
                        if len(found):
                            data, m = np.ascontiguousarray(own.astype("<f4")), len(found)
                            x = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((np.arange(m + 1) * data.shape[1] * 4).astype(np.int32)), pa.py_buffer(data)])
                            one = [pa.array(np.full(m, v, t)) for v, t in ((d, np.int32), (b, np.int32))]
                            yield pa.RecordBatch.from_arrays([*one, pa.array(numbered(names[at[found]], b, cell)), pa.array(ids[at[found]]), pa.array(hearts[at[found]]), x, pa.array(np.full(m, share))], names=["dims", "block", "cell", "rep", "heart", "x", "share"])

        return run

    schema = "dims int, block int, cell long, rep long, heart int, x binary, share double"
    cell = ["dims", "block", "cell"]
    plain = reps.withColumn("heart", F.lit(-1))
    crowded = plain.mapInArrow(spread(False), schema).groupBy(*cell).agg(F.count("*").alias("size")).where(F.col("size") > crowd).orderBy(F.col("size").desc(), *cell).limit(HEARTS).collect()
    places = {(r["dims"], r["block"], r["cell"]): k for k, r in enumerate(crowded)}

    def totals(batches):
        for batch in batches:
            names = batch.column("name").to_numpy()
            for d, at, vectors in by_dims(batch):
                units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                for found, b, own, _ in cells(at, vectors, cosine, width, grid, False):
                    number = numbered(names[at[found]], b, own)
                    for x in set(number.tolist()):
                        if (k := places.get((d, b, x))) is not None:
                            inside = found[number == x]
                            yield pa.RecordBatch.from_pydict({"heart": pa.array(np.full(d, k, np.int32)), "name": pa.array(np.full(d, names[at[inside[0]]])), "axis": pa.array(np.arange(d, dtype=np.int32)), "total": pa.array(units[inside].sum(0))})

    hearts: list[tuple[int, np.ndarray]] = []
    if places:  # the mean direction of each crowded cell: sums over all tasks meet in Spark, HEARTS times the dimensions reach the driver
        sums = plain.mapInArrow(totals, "heart int, name long, axis int, total double").groupBy("heart", "name", "axis").agg(F.sum("total").alias("total"))
        found = {}
        for r in sums.collect():
            found.setdefault((r["heart"], r["name"]), {})[r["axis"]] = r["total"]
        hearts = [(name, np.array([axes[k] for k in sorted(axes)])) for (_, name), axes in sorted(found.items())]
    limit = math.acos(min(1.0, cosine))

    def assign(batches):
        for batch in batches:
            names, out, best = batch.column("name").to_numpy(), np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, ANGLES + 1)
            for d, at, vectors in by_dims(batch):
                units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                for k, (name, v) in enumerate(hearts):
                    if len(v) == d:
                        centre = v / np.linalg.norm(v)
                        # the angle from the half chord is exact for small angles; what rounding may add is added
                        angle = 2 * np.arcsin(np.minimum(np.linalg.norm(units - centre, axis=1) / 2, 1)) + 1e-9
                        step = np.where(names[at] == name, np.ceil(np.minimum(angle / max(limit, 1e-12), 4.0) * ANGLES), ANGLES + 1).astype(np.int64)
                        nearer = (step < best[at]) & (best[at] > NEAR)  # the first heart that is near keeps a crowd together
                        best[at[nearer]] = step[nearer]
                        out[at[nearer]] = k * 1024 + step[nearer]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "heart"])

    if hearts:
        reps = common.written(reps.mapInArrow(assign, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in reps.schema)}, heart int"), "vector-hearts")
    else:
        reps = plain
    crowd_of, step_of = F.shiftright("heart", 10), F.col("heart").bitwiseAND(F.lit(1023))
    held = reps.where("heart >= 0").select("label", "rep", "n", crowd_of.alias("crowd"), step_of.alias("step"))
    # by label, crowd and step: HEARTS times ANGLES rows at most
    steps = held.groupBy("label", "crowd", "step").agg(F.sum("n").alias("sum"), F.min("rep").alias("least_rep"))
    grid_of_steps = steps.groupBy("label", "crowd").agg(F.collect_list(F.struct("step", "sum")).alias("steps"), F.min_by("least_rep", "step").alias("first"), F.min("step").alias("first_step"))
    certain = held.join(grid_of_steps, ["label", "crowd"]).withColumn("_all", F.aggregate(F.filter("steps", lambda x: x["step"] <= ANGLES - F.col("step")), F.lit(0).cast("long"), lambda acc, x: acc + x["sum"]))
    certain = certain.select("rep", "first", (F.col("_all") - F.when(2 * F.col("step") <= ANGLES, F.col("n")).otherwise(0)).alias("certain"), (F.col("step") + F.col("first_step") <= ANGLES).alias("tied"))
    certain = common.written(certain, "vector-crowds")

    index, probe = reps.mapInArrow(spread(False), schema), reps.mapInArrow(spread(True), schema)
    sizes = index.groupBy(*cell).count().join(probe.groupBy(*cell).agg(F.count("*").alias("probes")), cell)
    chunks = common.written(sizes.select(*cell, F.ceil(F.col("count") / chunk).cast("int").alias("ni"), F.ceil(F.col("probes") / chunk).cast("int").alias("np")), "vector-cells")

    def dealt(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        part = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int")
        return side.join(chunks, cell).select(*cell, "rep", "heart", "x", "share", part.alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))

    left, right = dealt(index, "ni", "np", "ci", "cp"), dealt(probe, "np", "ni", "cp", "ci")
    keys = [*cell, "ci", "cp"]

    def compare(mine, theirs):
        a, b = mine.column("rep").to_numpy(), theirs.column("rep").to_numpy()
        out_a, out_b = [], []
        if len(a) and len(b):
            share = mine.column("share")[0].as_py()
            ha, hb = mine.column("heart").to_numpy(), theirs.column("heart").to_numpy()
            x, y = (np.frombuffer(b"".join(t.column("x").to_pylist()), "<f4").reshape(t.num_rows, -1).astype(np.float64) for t in (mine, theirs))
            yy = (y * y).sum(1)
            for k in range(0, len(a), 1024):
                part = x[k : k + 1024]
                near = (part * part).sum(1)[:, None] + yy - 2 * part @ y.T <= share
                own = ha[k : k + 1024, None]
                near &= (hb < 0) | (own >> 10 != hb >> 10) | ((own & 1023) + (hb & 1023) > ANGLES)
                i, j = np.nonzero(near & (a[k : k + 1024, None] < b))
                out_a.append(a[k + i])
                out_b.append(b[j])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long").distinct()

    def verify(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for _, at, p in by_dims(batch, "va"):
                q = stacked(batch.column("vb").take(at), p.shape[1])
                keep[at] = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1)) >= cosine
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    one = reps.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("n").alias("na"), F.col("label").alias("la"))
    two = reps.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    met = pairs.join(one, "a").join(two, "b").where("la = lb AND octet_length(va) = octet_length(vb)")
    linked = common.written(met.select("a", "b", "na", "nb", "va", "vb").mapInArrow(verify, "a long, b long, na long, nb long"), "vector-links")
    counts = linked.select(F.col("a").alias("rep"), F.col("nb").alias("more")).unionByName(linked.select(F.col("b").alias("rep"), F.col("na").alias("more"))).groupBy("rep").agg(F.sum("more").alias("more"))
    ties = linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(certain.where("tied AND rep <> first").select(F.col("rep").alias("u"), F.col("first").alias("v")))
    groups = connected_components(ties)
    known = reps.join(counts, "rep", "left").join(certain.select("rep", "certain"), "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    links = F.col("n") - 1 + F.coalesce("certain", F.lit(0)) + F.coalesce("more", F.lit(0))
    known = known.select("label", "v", "least", links.alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = common.written(known, "known-vectors")
    leasts = known.groupBy("component").agg(F.min("least").alias("component_id"))
    out = usable.join(known.join(leasts, "component"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = base.where("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
