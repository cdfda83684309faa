"""Shared helpers of the operators: reading tables, cutting batches, durable intermediate tables."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from citegrain.session import shared_dir

# Words are runs without ASCII white space in every operator that counts words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Text bytes handled at once inside a task; bounds the numpy arrays of a block.
BLOCK_BYTES = 4_000_000


def read_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder; the table goes when the session's JVM ends.

    Lost executors cost nothing that is already written, and readers see only the columns they ask for.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/citegrain-llm/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(folder)
    out.stored_at = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that only tables stored since were made from, and the shuffle files behind them."""
    spark = tables[0].sparkSession
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    let_go(spark)


def let_go(spark: SparkSession) -> None:
    """Remove the shuffle files and broadcasts of plans that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


def is_one_scan(df: DataFrame) -> bool:
    """Whether a plan only projects and filters one table of files, so that each of its rows is one row of a file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def identified(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns with a stable identity of each row: file and row of the file, or a number in a stored table.

    Rows that were exploded, joined or united share files and rows, so they are numbered.
    """
    if is_one_scan(docs):
        with contextlib.suppress(AnalysisException):  # a table without files
            return docs.select(*columns, F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    numbered = docs.select(*columns, F.lit(0).cast("long").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    return stored(numbered, "numbered")


def byte_values(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def blocks(sizes: list[int], budget: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``budget`` summed size, each of one element at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > budget:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def text_blocks(column: pa.Array, budget: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """The ranges of a string column's blocks with their UTF-8 texts; texts of one block at a time leave the column."""
    data = column.cast(pa.binary())
    for start, stop in blocks(pc.fill_null(pc.binary_length(data), 0).to_pylist(), budget):
        yield start, stop, data.slice(start, stop - start).to_pylist()


def per_text(
    docs: DataFrame, id_col: str, text_col: str, schema: str, compute: Callable[[list[bytes | None]], dict[str, object]],
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One result row per document from whole texts: ``compute`` maps a block of UTF-8 texts (None for null) to columns.

    ``schema`` is the DDL of the computed columns. The id keeps its type, other input columns are not read, so their
    names cannot clash. No shuffle: every split is worked on where it is read.
    """
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    fields = T.StructType([narrow.schema[id_col], *T.StructType.fromDDL(schema).fields])
    target = to_arrow(fields)

    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            for start, stop, texts in text_blocks(batch.column(1), block_bytes):
                found = compute(texts)
                arrays = [ids.slice(start, stop - start).cast(target.field(0).type)]
                arrays += [pa.array(found[f.name], type=f.type) for f in list(target)[1:]]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return narrow.mapInArrow(work, fields)


def to_arrow(schema: T.StructType) -> pa.Schema:
    """The Arrow schema of a Spark schema of plain columns, with nothing declared as required."""
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType), True) for f in schema.fields])


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads the bits of unsigned integers (wrapping arithmetic)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbers(dict):
    """Numbers keys in the order in which they are first met."""

    def __missing__(self, key: object) -> int:
        self[key] = number = len(self)
        return number


def gather(flat: np.ndarray, counts: np.ndarray, numbers: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The runs of ``flat`` with these numbers, one after the other."""
    starts = np.cumsum(counts) - counts if starts is None else starts
    n = counts[numbers]
    shift = np.repeat(starts[numbers] - (np.cumsum(n) - n), n)
    return flat[np.arange(len(shift)) + shift]
