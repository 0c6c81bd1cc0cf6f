"""Open JSON documents to typed columns: the schema is worked out over all documents, then one typed table is written.

`schema_of_variant_agg` merges the types of every document, field by field, in one aggregation. A field whose documents disagree,
or that is an empty object or null everywhere, stays VARIANT, so nothing is lost; numbers with a fraction become DOUBLE. Objects
with open keys (such as periods) would become as many fields as there are keys: `types` gives them a type of their own, a map
say, and their keys are left out of the aggregation, whose state would grow with them. Once written, scans read only the nested
fields that a query asks for.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from scorefold.sources import documents

#: What types of VARIANT values become in a table; names in backticks are left as they are.
TYPES = ((r"OBJECT<>", "VARIANT"), (r"OBJECT<", "STRUCT<"), (r"\bVOID\b", "VARIANT"), (r"DECIMAL\(\d+,\d+\)|\bFLOAT\b", "DOUBLE"))


def document_schema(docs: DataFrame, doc: str = "doc", types: dict[str, str] | None = None) -> StructType:
    """The fields of all documents (VARIANT objects; other values do not count); types: DDL types of top-level fields."""
    wanted = {k: StructType.fromDDL(f"x {v}")["x"].dataType for k, v in (types or {}).items()}
    # one type a field, worked out by its name: the open keys of a field whose type is given are never merged
    value = F.when(~F.col("key").isin(*wanted), F.col("value")) if wanted else F.col("value")
    found = documents.open_fields(docs, [], doc).groupBy("key").agg(F.schema_of_variant_agg(value).alias("kind")).collect()
    fields = [StructField(r.key, wanted.get(r.key) or column_type(r.kind)) for r in sorted(found, key=lambda r: r.key)]
    known = {f.name for f in fields}
    return StructType(fields + [StructField(k, v) for k, v in wanted.items() if k not in known])


def column_type(kind: str) -> DataType:
    """The type of a table's column for a type of VARIANT values."""
    parts = re.split(r"(`(?:[^`]|``)*`)", kind)
    for pattern, to in TYPES:
        parts[::2] = [re.sub(pattern, to, p) for p in parts[::2]]
    return StructType.fromDDL(f"d {''.join(parts)}")["d"].dataType


def type_text(kind: DataType) -> str:
    """A type as DDL, names in backticks."""
    if isinstance(kind, StructType):
        return "struct<" + ", ".join("`" + f.name.replace("`", "``") + "`: " + type_text(f.dataType) for f in kind) + ">"
    if isinstance(kind, ArrayType):
        return f"array<{type_text(kind.elementType)}>"
    return kind.simpleString()


def typed(docs: DataFrame, schema: StructType, keys: Sequence[str] = (), doc: str = "doc") -> DataFrame:
    """(keys, fields of schema) of VARIANT documents; values of another type than the schema's are null."""
    paths = {f.name: "$['" + f.name.replace("'", "\\'") + "']" for f in schema}
    return docs.select(*keys, *[F.try_variant_get(doc, paths[f.name], type_text(f.dataType)).alias(f.name) for f in schema if f.name not in keys])


def write_typed(docs: DataFrame, path: str, keys: Sequence[str] = (), doc: str = "doc", types: dict[str, str] | None = None) -> DataFrame:
    """Infer, write once, read: the typed table."""
    schema = document_schema(docs, doc, types)
    rows = typed(docs, schema, keys, doc)
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
