"""Schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def struct_of(columns: str) -> T.StructType:
    """Schema from 'name type, ...'. Works without a session, so that executors can import this module too."""
    pairs = (c.split() for c in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FILES = struct_of(
    "repo_id string, project_name string, file_path string, language string, size bigint, lines int,"
    " mtime timestamp, content string"
)
SYMBOLS = struct_of(
    "repo_id string, file_path string, symbol_id string, parent_id string, ancestor_ids array<string>, depth int,"
    " name string, kind string, parent_name string, start_line int, end_line int"
)
CHUNKS = struct_of(
    "chunk_id string, repo_id string, project_name string, file_path string, language string, start_line int,"
    " end_line int, content string, content_hash string, chunk_tokens int, model_id string, indexed_at timestamp,"
    " symbol_name string, symbol_kind string, parent_name string, method string, is_split boolean, split_index int,"
    " status string, deleted_at timestamp, deleted_in_commit string, embedding array<float>"
)
MANIFEST_FILES = struct_of(
    "repo_id string, file_path string, language string, line_count int, chunk_count bigint, mtime timestamp,"
    " content_hash string"
)
PROJECTS = struct_of(
    "repo_id string, project_name string, repo_path string, last_indexed_commit string, indexed_at timestamp"
)
AUDIT = struct_of("ts timestamp, op string, kv map<string,string>, raw string")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in order; missing ones become typed nulls, extra ones are dropped."""
    have = set(df.columns)
    # parsed as one list of SQL expressions, which is cheaper to build than a cast and an alias per column
    return df.selectExpr(
        *[
            f"CAST({f'`{f.name}`' if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
            for f in schema.fields
        ]
    )
