"""Helpers shared by the training-data operators: table access, scratch tables (see scratch), Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, scratch_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_scan(df: DataFrame) -> bool:
    """Whether df is nothing but projections and filters of one table of Parquet files."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString().split("\n")[0]


def with_place(df: DataFrame, name: str) -> DataFrame:
    """df with the place of each record: file and row in it. It is the same in each evaluation, however the files are split.

    What isn't a plain scan of Parquet files is written to the shared folder first.
    """
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return (df if is_scan(df) else materialise(df)).withColumn(name, place)


def unused(taken: Iterable[str], name: str) -> str:
    """name, or with underscores behind it, such that no column of `taken` is called so in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as one identifier, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1, ...: PySpark's batch functions resolve names, which fails for some of them."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def each(column: pa.Array) -> Iterator:
    """The values one by one: a batch may hold thousands of texts, which needn't all exist as objects at once."""
    return (x.as_py() for x in column)


def batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Memory that this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after whose last batch the memory it freed is released: a worker lives on and serves other stages."""

    def then_release(batches: Batches) -> Batches:
        yield from run(batches)
        release()

    return then_release
