"""What the operators of this subpackage share: tables, written stages, splits and word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scorefold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more; no other folder is touched."""
    spark = df.sparkSession
    home = shared_dir(spark).rsplit("/", 1)[-1]
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(rf"/{re.escape(home)}/[\w-]+-[0-9a-f]{{32}}$", name):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that nothing refers to any more; it looks when the driver collects garbage."""
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(key: Column | str, mod: int) -> Column:
    """crc32 of the key's decimal text modulo mod; a null key counts as remainder of the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def held_out(key: Column | str) -> Column:
    """The two-in-three split of the labelled operators: remainder 1 is held out."""
    return crc_mod(key, 3) == 1


def words(text: str | None) -> list[bytes]:
    """Words of the UTF-8 text with A-Z lowered; they are parted by ASCII space and 0x09-0x0D only."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def exact_words(text: str | None) -> list[bytes]:
    """Words of the UTF-8 text as they stand; they are parted by ASCII space and 0x09-0x0D only."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


#: Bytes that part words, and the odd multiplier of the polynomial hash of a word's bytes with its inverse modulo 2**64.
GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
GAP = re.compile(rb"[\t-\r ]")
BASE = 0xD6E8FEB86659FD93
UNBASE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of BASE and of its inverse, as many as were asked for so far."""

    up = down = np.ones(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (BASE, UNBASE))
        return cls.up[:n], cls.down[:n]


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the words of lower-cased bytes, by differences of one running sum over all bytes."""
    found = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(GAPS.take(found), prepend=True, append=True))
    starts, stops = edges[::2], edges[1::2]
    up, down = Powers.get(max(len(found), 1))
    total = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(up[: len(found)] * (found.astype(np.uint64) + np.uint64(1)), out=total[1:])
    out = (total[stops] - total[starts]) * down[starts]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(29)), starts


def hashed_words(texts: list[str | None], block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, as words() parts them, text after text, and the number of words of each text.

    About a fifth of the time of word_hashes(words(text)); the hashes are other ones. Long texts are worked on in parts of
    about `block` bytes that end between words.
    """
    hashes, sizes, held, size = [np.zeros(0, np.uint64)], [], [], 0

    def flush():
        nonlocal held, size
        found, starts = _hashed(b"\n".join(held))
        hashes.append(found)
        sizes.extend(np.diff(np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in held)]))).tolist())
        held, size = [], 0

    for text in texts:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
        if len(raw) > block:
            if held:
                flush()
            at = n = 0
            while at < len(raw):
                stop = GAP.search(raw, at + block)
                stop = stop.start() if stop else len(raw)
                hashes.append(_hashed(raw[at:stop])[0])
                at, n = stop, n + len(hashes[-1])
            sizes.append(n)
            continue
        held.append(raw)
        size += len(raw)
        if size >= block:
            flush()
    if held:
        flush()
    return np.concatenate(hashes), np.array(sizes, np.int64)


#: Odd multiplier of the rolling hash of word sequences.
ROLL = np.uint64(0x9E3779B97F4A7C15)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every run of n words, modulo 2**64."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out = out * ROLL + hashes[k : k + m]
    return out ^ (out >> np.uint64(29))


def bounded_sample(rows: DataFrame, most: int, seed: int = 17, total: int | None = None) -> DataFrame:
    """All rows where they are `most` at most; else about `most` of the different ones, picked by a hash of the whole row.

    The same ones in every run, spread over the table. Equal rows count once, so no key that holds many rows, and no row that
    stands there many times, is taken or left as a whole."""
    total = rows.count() if total is None else total
    if total <= most:
        return rows
    picked = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns], F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / total)
    return rows.where(picked).dropDuplicates()


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are wide rows: where Spark's default of 10,000 rows to an Arrow batch stands, batches get `rows` instead."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def with_columns_from_text(docs: DataFrame, text: str, fields: str, make) -> DataFrame:
    """docs with new columns computed from the whole text in Arrow batches; columns of those names are replaced.

    make() runs once per task and gives a function from a list of texts (None for null) to one list per field.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in added]
    docs = docs.drop(*[c for c in docs.columns if c in added.names])
    text_batches(docs.sparkSession)
    keep = docs.columns
    schema = StructType([*docs.schema.fields, *added.fields])

    def run(batches):
        work = make()
        for batch in batches:
            found = batch.column(text)
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                new = work(found.slice(at, 1024).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, kind) for x, kind in zip(new, kinds, strict=True))], names=[*keep, *added.names])

    return docs.mapInArrow(run, schema)
