"""Joins between declarations, goods lines, files and worksheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.text import number_from_filename


def items_of(items: DataFrame, dispatches: DataFrame) -> DataFrame:
    """The goods lines of a set of declarations, with number and owner of the parent."""
    parents = dispatches.select(
        F.col("id").alias("dispatch_id"),
        F.coalesce("number", F.lit("")).alias("number"),
        F.coalesce("owner", F.lit("")).alias("owner"),
    )
    return items.join(parents, "dispatch_id")


def dispatch_children(dispatches: DataFrame, items: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """Declarations with what hangs below them: line count and value, change count and time.

    Children are summed before the join, so a declaration with very many lines
    is never collected into one row.
    """
    lines = items.groupBy(F.col("dispatch_id").alias("id")).agg(
        F.count("*").alias("items"), F.sum(F.coalesce("total_value", F.lit(0.0))).alias("items_value")
    )
    joined = dispatches.join(lines, "id", "left").fillna({"items": 0, "items_value": 0.0})
    if audits is None:
        return joined
    changes = audits.groupBy(F.col("dispatch_id").alias("id")).agg(
        F.count("*").alias("changes"), F.max("changed_at").alias("last_change")
    )
    return joined.join(changes, "id", "left").fillna({"changes": 0})


def dispatch_detail(items: DataFrame, audits: DataFrame, dispatch_id) -> tuple[DataFrame, DataFrame]:
    """Lines of one declaration in order, and its changes, newest first."""
    lines = items.filter(F.col("dispatch_id") == dispatch_id)
    changes = audits.filter(F.col("dispatch_id") == dispatch_id)
    return (
        lines.orderBy(F.asc_nulls_first("item_no"), F.asc_nulls_first("subitem_no")),
        changes.orderBy(F.desc("changed_at")),
    )


def items_used_in_sheets(items: DataFrame, sheet_items: DataFrame) -> DataFrame:
    """Goods lines that some worksheet line refers to."""
    used = sheet_items.select(F.col("catalog_item_id").alias("id"))
    return items.join(used, "id", "left_semi")


def new_groups(groups: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Groups whose (number, date) is not registered; missing parts count as equal."""
    known = dispatches.select(F.col("number").alias("_n"), F.col("date").alias("_d"))
    same = groups["number"].eqNullSafe(known["_n"]) & groups["date"].eqNullSafe(known["_d"])
    return groups.join(known, same, "left_anti")


def match_file_to_dispatch(files: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Which registered declaration a file belongs to, and how that was found.

    ``files`` has file_name and file_hash.  The tests run in this order: original
    name, last part of the stored path, declaration number inside the name,
    content hash.  All keys are one index (kind, key, smallest id), joined once.  A stored file
    name ends with the original name behind "{time}_{hash}_", so the stored name
    without that prefix is compared for equality.
    """
    stored = F.regexp_replace(F.element_at(F.split("stored_path", "/"), -1), r"^[0-9]+_[0-9a-f]{8}_", "")

    def stacked(df: DataFrame, *keys) -> DataFrame:
        entries = F.array(*(F.struct(F.lit(rank).alias("_kind"), key.alias("_key")) for rank, key in enumerate(keys)))
        return df.select("*", F.inline(entries)).filter("_key IS NOT NULL AND _key <> ''")

    headers = dispatches.select("id", "file_name", "stored_path", "number", "file_hash")
    index = stacked(headers, F.col("file_name"), stored, F.col("number"), F.col("file_hash")).groupBy("_kind", "_key").agg(F.min("id").alias("_id"))
    named = files.withColumn("file_name", F.trim("file_name"))
    name = F.col("file_name")
    listed = stacked(named.select("file_name", "file_hash").distinct(), name, name, number_from_filename("file_name"), F.col("file_hash"))
    best = F.min(F.struct("_kind", "_id")).alias("_best")
    found = listed.join(index, ["_kind", "_key"]).groupBy("file_name", "file_hash").agg(best)
    found = found.select(F.coalesce("file_name", F.lit("")).alias("_name"), F.coalesce("file_hash", F.lit("")).alias("_hash"), "_best")
    joined = named.join(found, (F.coalesce(named["file_name"], F.lit("")) == F.col("_name")) & (F.coalesce(named["file_hash"], F.lit("")) == F.col("_hash")), "left")
    reason = F.element_at(F.array(F.lit("name"), F.lit("path"), F.lit("number"), F.lit("hash")), F.col("_best._kind") + 1)
    return joined.select(*(named[c] for c in files.columns), F.col("_best._id").alias("dispatch_id"), F.when(F.col("_best").isNotNull(), reason).alias("matched_by"))


def list_new_files(files: DataFrame, dispatches: DataFrame, failed: DataFrame) -> DataFrame:
    """Listed files that are neither registered nor known to fail."""
    fresh = files.withColumn("file_name", F.trim("file_name")).join(failed.select("file_name"), "file_name", "left_anti")
    listed = fresh.withColumn("file_hash", F.lit(None).cast("string"))
    return match_file_to_dispatch(listed, dispatches).filter(F.col("dispatch_id").isNull()).select("file_name")


def check_duplicates(new: DataFrame, registered: DataFrame, business_key: bool = False) -> DataFrame:
    """Mark documents that are registered already, by content hash and optionally by
    (number, date, importer document)."""
    by_hash = registered.groupBy("file_hash").agg(F.min_by(F.struct("id", "number"), F.col("id")).alias("same_file"))
    marked = new.join(by_hash, "file_hash", "left")
    reason = F.when(
        F.col("same_file").isNotNull(),
        F.format_string(
            "Archivo idéntico ya registrado previamente (ID: %s, Despacho: %s)",
            F.col("same_file.id").cast("string"), F.col("same_file.number"),
        ),
    )
    existing = F.col("same_file.id")
    if business_key:
        keys = ["number", "date", "importer_doc"]
        by_key = registered.groupBy(*keys).agg(F.min("id").alias("same_key_id"))
        marked = marked.join(by_key, keys, "left")
        reason = F.coalesce(
            reason,
            F.when(
                F.col("same_key_id").isNotNull(),
                F.format_string(
                    "Posible despacho ya registrado con mismo Nº %s, fecha y RUC (ID: %s)",
                    F.col("number"), F.col("same_key_id").cast("string"),
                ),
            ),
        )
        existing = F.coalesce(existing, F.col("same_key_id"))
    return marked.withColumn("duplicate_reason", reason).withColumn("existing_id", existing).select(
        *new.columns, "duplicate_reason", "existing_id"
    )
