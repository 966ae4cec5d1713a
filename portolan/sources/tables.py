"""Files in and tables out."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.sources.schemas import SCHEMAS, conform

UTF8_MARK = "﻿"


def load_binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with name, size and content hash; the content itself is dropped.

    Names are matched without regard to case by the pattern of the reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return describe_files(files)


def describe_files(files: DataFrame) -> DataFrame:
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("modified_at"), F.col("path").alias("source_path"),
    )


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """The PDF files of a folder, described."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return describe_files(files)


_VERSION_ROW = "version string, written_at timestamp, job string, batch bigint"


def write_tables(
    tables: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None, commit: tuple[str, int] | None = None
) -> str:
    """Write a new version of the given tables and point to it.

    Every version is a folder of its own, so readers of the previous one and
    jobs that derive the new version from it are not disturbed.  The pointer is
    a one-row table, written last; it may name the (job, batch) that the version
    completes, see ``committed``.
    """
    version = f"v{int(time.time() * 1000)}"
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        keys = (partition_by or {}).get(name)
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{root}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    job, batch = commit or (None, None)
    row = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("written_at"), F.lit(job).cast("string").alias("job"), F.lit(batch).cast("bigint").alias("batch")
    )
    row.coalesce(1).write.mode("append").json(f"{root}/_versions")
    return version


def _versions(spark: SparkSession, root: str) -> DataFrame:
    """One short row per version, none where nothing was written yet."""
    try:
        return spark.read.schema(_VERSION_ROW).json(f"{root}/_versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _VERSION_ROW)


def committed(spark: SparkSession, root: str, job: str, batch: int) -> bool:
    """Whether a version completes this batch of the job."""
    return not _versions(spark, root).filter((F.col("job") == job) & (F.col("batch") == batch)).isEmpty()


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version written last, None where there is none."""
    return _versions(spark, root).agg(F.max("version")).first()[0]


def read_tables(spark: SparkSession, root: str, names: list[str], version: str | None = None) -> dict[str, DataFrame]:
    """The named tables of a version, the last by default; those with a schema have its columns and types."""
    chosen = version or current_version(spark, root)
    found = {name: spark.read.parquet(f"{root}/{chosen}/{name}") for name in names}
    return {name: conform(df, name) if name in SCHEMAS else df for name, df in found.items()}


def append_processing_log(log: DataFrame, path: str) -> None:
    log.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and a UTF-8 mark in front of the first title.

    Spark writes one file per partition, each with the mark; spreadsheet programs
    read it as such.
    """
    first = df.columns[0]
    marked = df.withColumnRenamed(first, UTF8_MARK + first)
    marked.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")
