"""Helpers shared by the training-text operators: materialised tables, guarded broadcasts, word rules."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes outside space and U+0009-U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only when its counted rows times its row bound stay below this.
BROADCAST_BYTES = 16 << 20

_written: dict[str, SparkSession] = {}
_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset and all runs on this machine (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="phonoscope-"))
    return _own_root[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The table is removed by `release` or, since lazily returned results still read it, when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/phonoscope/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more; frames that were not written as they are stay."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path in _written:
            _remove(_written.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_tables() -> None:
    for path, spark in _written.items():
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: the cluster's own clean-up takes the folder
            break
    for root in _own_root:
        shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def small(table: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a materialised table for broadcast if its counted size is proven small; else leave the join to shuffle."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def with_rid(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (struct of all input columns), text (null as empty) and rid, a long that names the row and orders as the id does.

    That is the id itself where ids are whole numbers, present and distinct; else rows are put in order of id (null
    first) and text, numbered, and written.
    """
    plain = docs.select(row_of(docs).alias("row"), F.col(f"`{id_col}`").alias("rid"), text_of(text_col).alias("text"))
    if plain.schema["rid"].dataType.typeName() in ("byte", "short", "integer", "long"):
        n, ids, distinct = plain.agg(F.count("*"), F.count("rid"), F.count_distinct("rid")).first()
        if n == ids == distinct:
            return plain.withColumn("rid", F.col("rid").cast("long"))
    ordered = plain.repartitionByRange(F.col("rid").asc_nulls_first(), "text").sortWithinPartitions(F.col("rid").asc_nulls_first(), "text")
    return materialize(ordered.withColumn("rid", F.monotonically_increasing_id()))


def text_of(column: str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


#: Rows that a vectorized function sees at once if not told otherwise, which bounds what it holds.
ROWS = 256


def vectorized(function: Callable, schema: str, rows: int = ROWS) -> Callable[..., Column]:
    """A function of pandas series as a function of columns, called for so many rows at a time.

    It is made when called, so modules load without a session, and marked as not deterministic, so that a filter on its
    result doesn't have it run twice.
    """

    def pieces(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            for at in range(0, len(columns[0]), rows):
                yield function(*[c.iloc[at : at + rows].reset_index(drop=True) for c in columns])

    def of(*columns: Column | str) -> Column:
        given = Iterator[pd.Series] if len(columns) == 1 else Iterator[tuple[pd.Series, ...]]
        pieces.__annotations__ = {"batches": given, "return": Iterator[pd.DataFrame if schema.startswith("struct") else pd.Series]}
        return F.pandas_udf(pieces, schema).asNondeterministic()(*columns)

    return of


def row_of(docs: DataFrame) -> Column:
    """All columns of docs in one struct, so that no column added beside it can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
