"""Shared pieces of the operators: table readers, word rules and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return. ``bytes.split()``
#: without an argument splits on just these six.
WORD_SQL = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Arrow map: ``fn`` gets a record batch and returns a dict of columns named as in ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def fresh(name: str, taken) -> str:
    """``name``, with underscores behind it until no column has it (Spark's names don't tell upper from lower case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def crc_mod(column: str, by: int):
    """``crc32`` of the id as text, modulo ``by``; the learn / hold-out split of the classifiers."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column (one aggregate); used to size blocks."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)
