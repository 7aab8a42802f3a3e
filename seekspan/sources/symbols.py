"""Symbol dumps."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspan.functions import fixed, paths

# One line per file: `{repo_id, file_path, symbols: [{name, kind, range, children: [...]}]}`; the symbols stay JSON text,
# so they may be nested to any depth.
DUMPS = "repo_id string, file_path string, symbols string"
SYMBOLS = (
    "repo_id string, file_path string, symbol_id string, parent_id string, ancestor_ids array<string>, depth int, "
    "name string, kind string, parent_name string, start_line int, end_line int"
)


def walk_symbols(nodes: list[dict]) -> Iterator[tuple]:
    """(symbol_id, parent_id, ancestor_ids, depth, name, kind, parent_name, start_line, end_line) of a symbol forest, with
    1-based lines; the flat form with `location` is accepted."""
    stack = [(node, str(i), (), None) for i, node in enumerate(nodes)][::-1]
    while stack:
        node, symbol_id, ancestors, parent_name = stack.pop()
        span = node.get("range") or (node.get("location") or {}).get("range") or {}
        first, last = ((span.get(end) or {}).get("line") for end in ("start", "end"))
        number = node.get("kind")
        known = isinstance(number, int) and 0 < number <= len(fixed.SYMBOL_KINDS)
        yield (
            symbol_id,
            ancestors[-1] if ancestors else None,
            ancestors,
            len(ancestors),
            node.get("name"),
            fixed.SYMBOL_KINDS[number - 1] if known else paths.UNKNOWN,
            parent_name,
            None if first is None else first + 1,
            None if last is None else last + 1,
        )
        below = (*ancestors, symbol_id)
        children = node.get("children") or []
        stack.extend((c, f"{symbol_id}.{i}", below, node.get("name")) for i, c in reversed(list(enumerate(children))))


def flatten_symbols(dumps: DataFrame) -> DataFrame:
    """Nested symbols, as JSON text or as arrays of structs, as one row per symbol, whatever the depth."""
    nested = not isinstance(dumps.schema["symbols"].dataType, T.StringType)
    dumps = dumps.select("repo_id", "file_path", (F.to_json("symbols") if nested else F.col("symbols")).alias("symbols"))
    names = [f.split(" ")[0] for f in SYMBOLS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), *[pa.string()] * 3, pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, path, text in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "file_path", "symbols"))):
                rows = [(repo, path, *row) for row in walk_symbols(json.loads(text) or [])] if text else []
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return dumps.mapInArrow(run, SYMBOLS)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbol rows of a directory of dump files."""
    return flatten_symbols(spark.read.schema(DUMPS).json(path))
