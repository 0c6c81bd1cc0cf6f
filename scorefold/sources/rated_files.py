"""Files {symbol}/{persona}.json as a data source whose keys are its folders.

    rated_files.register(spark)
    spark.read.format("rated_files").load("file:///ratings").where("symbol = 'ACE'")

The columns symbol, persona, path, modified and content (the bytes as they stand) come from the path and the file. Equality and
IN filters on the two keys are taken over by the source: with a symbol only its folders are listed, with a symbol and a persona
the file is asked for directly, and no other file is opened. As a stream the source delivers files by their time of change, so
a file that is written again comes again; files younger than `settle` seconds wait, so none can still appear behind the
offset. Any file system that pyarrow opens by URI will do; tasks hold files of about `bytesPerTask` together.

`read_ratings` and `decode` work on bytes: a file that is no UTF-8 is a row with an error, not a text with replaced characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "symbol string, persona string, path string, modified timestamp, content binary"
SUFFIX = ".json"


class Files(InputPartition):
    """Paths with their times of change (microseconds) that one task reads."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class Folder:
    """The listing below a root: {symbol}/{persona}.json, cut down to the keys asked for."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.per_task = int(options.get("bytesPerTask", 32 << 20))
        self.keys: dict[str, set[str]] = {}

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        """Keep equality filters on the keys; the others come back."""
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            if column not in ("symbol", "persona") or not isinstance(f, (EqualTo, In)):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.keys[column] = self.keys.get(column, values) & values

    def listed(self) -> list:
        """File records of the keys asked for, in order of path."""
        from pyarrow import fs

        store, inner = self.store()
        symbols, personas = (self.keys.get(k) for k in ("symbol", "persona"))
        if symbols is None:
            found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True))
        elif personas is None:
            found = [x for s in sorted(symbols) for x in store.get_file_info(fs.FileSelector(f"{inner}/{s}", allow_not_found=True))]
        else:
            found = store.get_file_info([f"{inner}/{s}/{p}{SUFFIX}" for s in sorted(symbols) for p in sorted(personas)])
        depth = inner.count("/") + 2
        rows = [x for x in found if x.type == fs.FileType.File and x.path.endswith(SUFFIX) and x.path.count("/") == depth]
        return sorted((x for x in rows if personas is None or x.base_name[: -len(SUFFIX)] in personas), key=lambda x: x.path)

    def store(self):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")
        return store, inner.rstrip("/")

    def dealt(self, files: list) -> list[Files]:
        """Tasks of about per_task bytes; a file counts 64 kB more for being opened."""
        tasks, size = [], self.per_task
        for x in files:
            if size >= self.per_task:
                tasks.append(Files([]))
                size = 0
            tasks[-1].files.append((x.path, x.mtime_ns // 1000))
            size += x.size + (64 << 10)
        return tasks

    def rows(self, task: Files):
        """Arrow batches of SCHEMA, a few megabytes each."""
        import pyarrow as pa

        store, _ = self.store()
        held, size = [], 0

        def batch():
            parts = [x[0].rsplit("/", 2) for x in held]
            columns = [
                pa.array([p[1] for p in parts], pa.string()), pa.array([p[2][: -len(SUFFIX)] for p in parts], pa.string()), pa.array([x[0] for x in held], pa.string()),
                pa.array([x[1] for x in held], pa.timestamp("us", "UTC")), pa.array([x[2] for x in held], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["symbol", "persona", "path", "modified", "content"])

        for path, modified in task.files:
            with store.open_input_stream(path) as file:
                held.append((path, modified, file.read()))
            size += len(held[-1][2])
            if size >= 4 << 20 or len(held) == 1000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = Folder(options)

    def pushFilters(self, filters):
        return self.folder.take(filters)

    def partitions(self):
        return self.folder.dealt(self.folder.listed()) or [Files([])]

    def read(self, partition):
        return self.folder.rows(partition)


class Stream(DataSourceStreamReader):
    """Offsets are times of change in nanoseconds: a batch holds the files changed after the start and up to the end."""

    def __init__(self, options: dict):
        self.folder = Folder(options)
        self.settle = float(options.get("settle", 1.0))

    def initialOffset(self):
        return {"changed": 0}

    def latestOffset(self):
        import time

        ripe = time.time_ns() - int(self.settle * 1e9)
        return {"changed": max((x.mtime_ns for x in self.folder.listed() if x.mtime_ns <= ripe), default=0)}

    def partitions(self, start, end):
        return self.folder.dealt([x for x in self.folder.listed() if start["changed"] < x.mtime_ns <= end["changed"]])

    def read(self, partition):
        return self.folder.rows(partition)


class RatedFiles(DataSource):
    @classmethod
    def name(cls):
        return "rated_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))

    def streamReader(self, schema):
        return Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and have Spark offer it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RatedFiles)


def decode(files: DataFrame) -> DataFrame:
    """files with text, doc (VARIANT), parse_error and error: bytes that are no UTF-8 and texts that are no JSON have no doc."""
    rows = files.withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    rows = rows.withColumn("doc", F.try_parse_json("text"))
    error = F.when(F.col("text").isNull(), "not valid UTF-8").when(F.col("doc").isNull(), "not valid JSON")
    return rows.withColumns({"parse_error": F.col("doc").isNull(), "error": error}).drop("content")


def read_rated(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, persona, path, modified, text, doc, parse_error, error) by the source; a filter on the keys prunes folders."""
    register(spark)
    return decode(spark.read.format("rated_files").load(path))


def stream_rated(spark: SparkSession, path: str, settle: float = 1.0) -> DataFrame:
    """read_rated as a stream: every file once for each time that it was written."""
    register(spark)
    return decode(spark.readStream.format("rated_files").option("settle", settle).load(path))
