"""Token-id files: flat unsigned integers plus 64-bit document offsets, written by many tasks and read back memory-mapped.

A folder holds, for each shard, `ids-NNNNN-<unique>.bin` (the ids of its documents, one after the other, in the smallest
unsigned type that holds the vocabulary) and `docs-NNNNN-<unique>.bin` (n + 1 offsets within the shard, then n document ids,
all 64-bit, then one byte per document: 1 where the document id is null). Shards follow each other in ascending document
order. A shard's base, the number of ids before it, is the prefix sum of the shards' sizes; only one row per shard, not per
document, meets in that sum.

A task that runs twice writes two differently named pairs; the shard table names the pair of the attempt that counted, so a
lost executor leaves at worst a file that nobody reads. Paths may be of any store that pyarrow or the local system opens.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorefold.llm import common
from scorefold.llm.subwords import subwords

SHARD = "shard int, n_docs long, n_ids long, dtype string, ids_file string, docs_file string"


def open_out(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(inner)


class Stored:
    """A file of numbers, read by ranges: mapped where it is local, else by range requests."""

    def __init__(self, path: str, dtype: str):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        self.dtype = np.dtype(dtype)
        self.size = store.get_file_info(inner).size // self.dtype.itemsize
        self.data = self.file = None
        if isinstance(store, fs.LocalFileSystem):
            self.data = np.memmap(inner, self.dtype, "r") if self.size else np.zeros(0, self.dtype)
        else:
            self.file = store.open_input_file(inner)

    def read(self, first: int, last: int) -> np.ndarray:
        if self.data is not None:
            return self.data[first:last]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((last - first) * width, first * width), self.dtype)


def smallest_dtype(vocabulary: int) -> str:
    return "<u1" if vocabulary <= 1 << 8 else "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 32 << 20) -> DataFrame:
    """Write all documents in ascending doc_id order (nulls first; repeated ids by text); the shard table with `base`.

    A shard holds about shard_bytes of text, so their number follows the input: its bytes are counted first."""
    spark = docs.sparkSession
    common.text_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), subwords(tokenizer)
        dtype, end = smallest_dtype(max(coder.vocabulary, end_id + 1)), np.array([end_id], "<u4").tobytes()
        name = f"{shard:05d}-{uuid.uuid4().hex}.bin"
        ids_file, docs_file = f"{folder}/ids-{name}", f"{folder}/docs-{name}"
        sizes, keys, nulls, buffer, held = [], [], [], [], 0
        with open_out(ids_file) as out:
            for batch in batches:
                found = batch.column("doc_id")
                keys.append(found.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(found.is_null().to_numpy(zero_copy_only=False).astype("u1"))
                for text in batch.column("text"):
                    ids = coder.ids(text.as_py()) + end
                    sizes.append(len(ids) // 4)
                    buffer.append(ids)
                    held += len(ids)
                    if held > 4 << 20:
                        out.write(np.frombuffer(b"".join(buffer), "<u4").astype(dtype).tobytes())
                        buffer, held = [], 0
            out.write(np.frombuffer(b"".join(buffer), "<u4").astype(dtype).tobytes())
        coder.forget()
        if not sizes:
            return
        with open_out(docs_file) as out:
            out.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes())
            out.write(np.concatenate(keys).tobytes())
            out.write(np.concatenate(nulls).tobytes())
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "n_docs": [len(sizes)], "n_ids": [int(sum(sizes))], "dtype": [dtype], "ids_file": [ids_file], "docs_file": [docs_file]}
        )

    shards = common.written(dealt.mapInArrow(run, SHARD), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(shards: DataFrame, block: int = 4096) -> DataFrame:
    """One row per document, read from the files: doc_id, start (ids of all documents before it), ids (unsigned 32-bit).

    Each shard is one row to read; a task gets few of them and reads blocks of documents by their offsets, mapped or by range
    requests, so only a block is in memory.
    """
    n = common.partitions(shards.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in batch.to_pylist():
                docs, ids, count = Stored(s["docs_file"], "u1"), Stored(s["ids_file"], s["dtype"]), s["n_docs"]
                first = 0
                while first < count:
                    here = min(block, count - first)
                    offsets = docs.read(8 * first, 8 * (first + here + 1)).view("<u8").astype(np.int64)
                    # about 8 MB of ids, or one document
                    here = min(here, max(1, int(np.searchsorted(offsets, offsets[0] + (1 << 21)))))
                    last, offsets = first + here, offsets[: here + 1]
                    keys = docs.read(8 * (count + 1 + first), 8 * (count + 1 + last)).view("<i8")
                    nulls = docs.read(8 * (2 * count + 1) + first, 8 * (2 * count + 1) + last)
                    flat = ids.read(int(offsets[0]), int(offsets[-1])).astype("<u4").tobytes()
                    values = pa.Array.from_buffers(pa.large_binary(), here, [None, pa.py_buffer(((offsets - offsets[0]) * 4).tobytes()), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(keys), pa.int64(), mask=np.array(nulls).astype(bool)), pa.array(offsets[:-1] + s["base"]), values.cast(pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )
                    first = last

    return shards.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, ids binary")
