"""Helpers the corpus operators share: stored tables, Arrow mapping, byte-balanced batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.session import shared_folder

#: Rows of a batch that goes to Python, at most: texts can be long, and a batch must fit in memory.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
WHITE = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet to the shared checkpoint folder and read from there.

    Later reads depend on those files alone, so a lost executor costs no earlier work.
    """
    spark = df.sparkSession
    path = shared_folder(spark, f"corpus/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: str | Column) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: What a Python worker remembers from task to task, by name: tables of words, encoders. All have a bound of their own.
MEMOS: dict[str, dict] = {}


def release_memos(but: str | None = None) -> None:
    """Forget all memos of this worker but one, and give the memory back: a worker serves the stages of many operators."""
    full = [memo for name, memo in MEMOS.items() if memo and name != but]
    for memo in full:
        memo.clear()
    if full:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, Iterable]]], schema: T.StructType | str, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` for a function that yields plain columns by name; ``keeps`` names the one memo its tasks find again."""
    spark_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos(keeps)
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def utf8_size(text: bytes | str) -> int:
    return len(text) if isinstance(text, bytes) or text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def balanced(texts: Iterable[bytes | str], limit: int) -> Iterator[list]:
    """Lists of consecutive texts of about ``limit`` bytes (UTF-8) each; a longer text stands alone."""
    batch, size = [], 0
    for text in texts:
        own = utf8_size(text)
        if batch and size + own > limit:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += own
    if batch:
        yield batch
