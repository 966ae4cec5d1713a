"""First-of-group, numbering and forward fill that survive one very large group.

Numbering and filling by a row index work in two phases: inside chunks of the
index, and over one summary row per chunk.  No task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], descending: bool = False) -> DataFrame:
    """One row per key, the first in the given order, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if descending else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def _chunk(order: str, chunk_rows: int) -> Column:
    return F.floor(F.col(order) / chunk_rows)


def number_rows(df: DataFrame, keys: list[str], order: str, out: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """1-based position inside each key, in the order of a whole-numbered index."""
    chunked = df.withColumn("_chunk", _chunk(order, chunk_rows))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_chunk").alias("_c"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order))
    ranked = chunked.withColumn("_inside", inside)
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(offsets, same).withColumn(out, (F.col("_inside") + F.col("_offset")).cast("int")).select(*df.columns, out)


def forward_fill(df: DataFrame, columns: list[str], group: str, order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Replace missing values by the last present one before them in the same group."""
    chunked = df.withColumn("_chunk", _chunk(order, chunk_rows))
    lasts = chunked.groupBy(group, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(group, "_chunk", *[F.last(c, ignorenulls=True).over(before).alias(f"_carried_{c}") for c in columns])
    inside = Window.partitionBy(group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = chunked.join(carried, [group, "_chunk"])
    for c in columns:
        filled = filled.withColumn(f"_filled_{c}", F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carried_{c}")))
    return filled.select(*[F.col(f"_filled_{c}").alias(c) if c in columns else c for c in df.columns])


def exact_duplicates(dispatches: DataFrame) -> DataFrame:
    """Headers that repeat an earlier one with the same number and file content.

    The kept header is the one with the lowest id; it is found by aggregation,
    and the others by a join that may be split on a frequent key.
    """
    keyed = dispatches.withColumn("_number", F.trim("number")).withColumn("_hash", F.trim("file_hash"))
    keyed = keyed.filter((F.col("_number") != "") & (F.col("_hash") != ""))
    kept = keyed.groupBy("_number", "_hash").agg(F.min("id").alias("kept_id"), F.count("*").alias("copies"))
    repeated = kept.filter(F.col("copies") > 1)
    return keyed.join(repeated, ["_number", "_hash"]).filter(F.col("id") > F.col("kept_id")).select(*dispatches.columns, "kept_id")
