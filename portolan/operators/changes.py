"""Field-level review changes, owner changes, deletions and duplicate removal.

Tables are immutable: every operator returns the new version of the tables it
touches, together with what changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.functions.dates import parse_date
from portolan.functions.numbers import parse_currency, plain_text
from portolan.functions.text import blank_to_null, clean_text, strip
from portolan.operators.windows import exact_duplicates

USER = "Operador Aduanero"


def _typed(value: Column, kind: str) -> Column:
    if kind == "date":
        return parse_date(value)
    if kind == "number":
        return parse_currency(value)
    return clean_text(value)


def _shown(value: Column, kind: str) -> Column:
    """The text of a value in the change log."""
    return plain_text(value) if kind == "number" else value.cast("string")


def _comparable(value: Column, kind: str) -> Column:
    """Missing, blank and zero values count as the same."""
    if kind == "number":
        return F.coalesce(value, F.lit(0.0))
    return F.coalesce(value.cast("string"), F.lit(""))


def edit_order(edits: DataFrame) -> Column:
    """The place of an edit among those of its key; all share one where the edits have none."""
    return F.col("edit_no").cast("bigint") if "edit_no" in edits.columns else F.lit(0).cast("bigint")


def review_changes(dispatches: DataFrame, edits: DataFrame, changed_at: str, user: str = USER) -> tuple[DataFrame, DataFrame]:
    """Apply reviewed values and log every field that really changed.

    ``edits`` has dispatch_id, field and raw_value; of repeated edits of a field the last by ``edit_no`` counts, if there
    is such a column, and else the greatest value.
    Edits are laid side by side per declaration before the join, so headers are
    joined once whatever the number of edited fields.  Reviewed declarations are
    confirmed even if nothing changed.
    """
    fields = {f: k for f, k in fv.EDITABLE_FIELDS.items() if f in dispatches.columns}
    stamp = F.lit(changed_at).cast("timestamp")
    given = F.struct(edit_order(edits).alias("no"), F.col("raw_value").alias("raw"))
    wide = edits.filter(F.col("field").isin(list(fields))).groupBy(F.col("dispatch_id").alias("id")).agg(
        *[F.max(F.when(F.col("field") == f, given)).alias(f"_new_{f}") for f in fields]
    ).withColumn("_edited", F.lit(True))
    joined = dispatches.join(wide, "id", "left")

    def new_value(f: str) -> Column:
        return _typed(F.col(f"_new_{f}")["raw"], fields[f])

    def differs(f: str) -> Column:
        kind = fields[f]
        return F.col(f"_new_{f}").isNotNull() & (_comparable(F.col(f), kind) != _comparable(new_value(f), kind))

    entries = [
        F.when(
            differs(f),
            F.struct(
                F.lit(f).alias("field"), _shown(F.col(f), k).alias("old_value"), _shown(new_value(f), k).alias("new_value")
            ),
        )
        for f, k in fields.items()
    ]
    audits = joined.filter("_edited").select(
        F.col("id").alias("dispatch_id"), F.explode(F.array_compact(F.array(*entries))).alias("change")
    ).select("dispatch_id", "change.*", F.lit(user).alias("user"), stamp.alias("changed_at"))
    edited = F.col("_edited").isNotNull()
    values = {f: F.when(differs(f), new_value(f)).otherwise(F.col(f)).alias(f) for f in fields}
    values["status"] = F.when(edited, F.lit("CONFIRMADO")).otherwise(F.col("status")).alias("status")
    values["updated_at"] = F.when(edited, stamp).otherwise(F.col("updated_at")).alias("updated_at")
    updated = joined.select(*[values.get(c, F.col(c)) for c in dispatches.columns])
    return updated, audits


def set_owner(dispatches: DataFrame, edits: DataFrame, changed_at: str, user: str = USER) -> tuple[DataFrame, DataFrame]:
    """Set owners (dispatch_id, owner); every request is logged.

    Of repeated requests the last by ``edit_no`` counts, if there is such a column, and else the greatest owner.
    """
    stamp = F.lit(changed_at).cast("timestamp")
    asked = edits.select(
        F.col("dispatch_id").alias("id"), F.coalesce(blank_to_null(strip("owner")), F.lit(fv.NO_OWNER_LABEL)).alias("_owner"),
        edit_order(edits).alias("_no"),
    )
    wanted = asked.groupBy("id").agg(F.max(F.struct("_no", "_owner"))["_owner"].alias("_owner"))
    joined = dispatches.join(wanted, "id", "left")
    hit = F.col("_owner").isNotNull()
    audits = dispatches.select("id", "owner").join(asked, "id").select(
        F.col("id").alias("dispatch_id"), F.lit("owner").alias("field"),
        F.coalesce(blank_to_null("owner"), F.lit(fv.NO_OWNER_LABEL)).alias("old_value"), F.col("_owner").alias("new_value"),
        F.lit(user).alias("user"), stamp.alias("changed_at"),
    )
    updated = joined.withColumn("owner", F.coalesce("_owner", "owner")).withColumn(
        "updated_at", F.when(hit, stamp).otherwise(F.col("updated_at"))
    )
    return updated.select(*dispatches.columns), audits


def delete_dispatches(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete headers (``ids`` has id) with lines and changes; worksheet lines lose their reference."""
    by_dispatch = ids.select(F.col("id").alias("dispatch_id"))
    gone = tables["items"].join(by_dispatch, "dispatch_id", "left_semi").select(F.col("id").alias("catalog_item_id"), F.lit(True).alias("_gone"))
    result = dict(tables)
    result["dispatches"] = tables["dispatches"].join(ids, "id", "left_anti")
    result["items"] = tables["items"].join(by_dispatch, "dispatch_id", "left_anti")
    if "audit_log" in tables:
        result["audit_log"] = tables["audit_log"].join(by_dispatch, "dispatch_id", "left_anti")
    if "sheet_items" in tables:
        lines = tables["sheet_items"]
        kept = F.when(F.col("_gone").isNull(), F.col("catalog_item_id")).alias("catalog_item_id")
        result["sheet_items"] = lines.join(gone, "catalog_item_id", "left").select(
            *[kept if c == "catalog_item_id" else F.col(c) for c in lines.columns]
        )
    return result


def remove_exact_duplicates(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Delete repeated headers unless a worksheet uses one of their lines.

    Adds ``deleted`` and ``skipped`` to the returned tables.
    """
    repeated = exact_duplicates(tables["dispatches"]).select("id", "number", "kept_id")
    used = tables["items"].join(
        tables["sheet_items"].select(F.col("catalog_item_id").alias("id")), "id", "left_semi"
    ).select(F.col("dispatch_id").alias("id"))
    skipped = repeated.join(used, "id", "left_semi")
    deleted = repeated.join(used, "id", "left_anti")
    result = delete_dispatches(tables, deleted.select("id"))
    result["deleted"], result["skipped"] = deleted, skipped
    return result

