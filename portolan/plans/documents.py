"""From uploaded files and their page texts to headers, goods lines and a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.functions import numbers
from portolan.functions.dates import check_date
from portolan.functions.text import blank_to_null
from portolan.operators import extraction as ex
from portolan.operators.aggregates import items_value_sum
from portolan.operators.brands import apply_brand_rules
from portolan.operators.joins import check_duplicates
from portolan.session import cut_lineage


def validate_upload(files: DataFrame, max_mb: int = fv.MAX_UPLOAD_MB) -> DataFrame:
    """Mark files that are refused: wrong type, or larger than the limit."""
    wrong_type = ~F.lower("file_name").endswith(".pdf")
    too_large = F.col("bytes") > max_mb * 1024 * 1024
    reason = F.when(wrong_type, "Solo se permiten archivos PDF").when(too_large, f"El archivo supera el límite de {max_mb} MB")
    return files.withColumn("refused", reason)


def storage_path(file_name, file_hash, stored_at) -> Column:
    """uploads/yyyy/MM/{epoch}_{first 8 of the hash}_{name}."""
    stamp = F.col(stored_at) if isinstance(stored_at, str) else stored_at
    prefix = F.concat_ws("_", F.unix_timestamp(stamp).cast("string"), F.substring(file_hash, 1, 8), F.col(file_name))
    return F.concat(F.lit("uploads/"), F.date_format(stamp, "yyyy/MM/"), prefix)


def reconcile_values(headers: DataFrame, item_sums: DataFrame) -> DataFrame:
    """FOB and CIF made consistent with the goods lines of each document."""
    joined = headers.join(item_sums, "doc_id", "left")
    with_fob = joined.withColumn("fob", numbers.reconcile_fob("fob", F.coalesce("items_value", F.lit(0.0))))
    return with_fob.withColumn("cif", numbers.reconcile_cif("cif", "fob", "freight", "insurance")).drop("items_value")


def assign_status(headers: DataFrame, today: str, review_below: float = fv.REVIEW_CONFIDENCE) -> DataFrame:
    """Validation errors and the processing status they lead to.

    ``is_duplicate`` marks documents that were let through although registered.
    """
    errors = F.array_compact(
        F.array(numbers.check_financials("fob", "freight", "insurance", "cif"), check_date("date", today))
    )
    missing = blank_to_null("number").isNull() | F.col("date").isNull() | blank_to_null("importer").isNull()
    doubtful = missing | (F.col("confidence") < review_below) | (F.size("errors") > 0)
    return headers.withColumn("errors", errors).withColumn(
        "status", F.when(F.col("is_duplicate"), "DUPLICADO").when(doubtful, "REVISAR").otherwise("PROCESADO")
    )


def process_documents(
    files: DataFrame, pages: DataFrame, registered: DataFrame, rules: DataFrame, today: str,
    owner: str | None = None, allow_duplicate: bool = False,
) -> dict[str, DataFrame]:
    """The whole document job.

    ``files`` has doc_id, file_name, file_hash and bytes.  Returns ``headers``,
    ``items``, ``log`` and ``results`` (one row per file, whatever became of it).
    A file that cannot be read only changes its own rows.
    """
    checked = check_duplicates(validate_upload(files), registered)
    duplicate = F.col("duplicate_reason").isNotNull()
    wanted = F.col("refused").isNull() & (~duplicate | F.lit(allow_duplicate))
    accepted = checked.filter(wanted)
    # The pages are read and brought together once; header fields and goods lines are both found in what is kept here.
    own_pages = cut_lineage(pages.join(accepted.select("doc_id"), "doc_id", "left_semi"))

    # Accepted files are within the size limit.  The texts are searched once each; what was found is small and used by all outputs.
    fields = cut_lineage(ex.fields_to_header(ex.extract_fields(own_pages)))
    found = cut_lineage(ex.extract_items(own_pages))
    items = found.unionByName(ex.representative_items(fields, found))

    facts = accepted.select("doc_id", "file_name", "file_hash", "duplicate_reason", duplicate.alias("is_duplicate"))
    headers = reconcile_values(fields, items_value_sum(items)).join(facts, "doc_id")
    headers = assign_status(headers, today).withColumn("owner", F.lit(owner).cast("string"))
    remarks = F.when(F.size("errors") > 0, F.concat(F.lit("Validaciones: "), F.array_join("errors", "; ")))
    headers = headers.withColumn("currency", F.coalesce("currency", F.lit("USD"))).withColumn("remarks", remarks)
    items = apply_brand_rules(items, rules)

    done = headers.select("doc_id", "number", "importer", "fob", "cif", "status", "errors", "extraction_method",
                          "page_count", "confidence", "fields_found", "fields_missing")
    joined = checked.join(done, "doc_id", "left")
    unreadable = wanted & F.col("status").isNull()
    message = F.coalesce("refused", F.when(~wanted, F.col("duplicate_reason")), F.when(unreadable, "Error leyendo PDF: sin páginas"))
    results = joined.select(
        "doc_id", "file_name",
        F.when(F.col("refused").isNotNull() | unreadable, "ERROR").when(~wanted, "DUPLICADO").otherwise(F.col("status")).alias("status"),
        message.alias("message"), "number", "importer", "fob", "cif",
    )
    log = joined.filter(F.col("refused").isNull()).select(
        "file_name", "file_hash",
        F.when(~wanted, "DUPLICATE_CHECK").when(unreadable, "ERROR").otherwise(F.col("extraction_method")).alias("method"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce("fields_found", F.lit(0)).alias("fields_found"),
        F.coalesce("fields_missing", F.lit(0)).alias("fields_missing"),
        F.when(~wanted, 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.coalesce(message, blank_to_null(F.array_join("errors", "; "))).alias("errors"),
    )
    return {"headers": headers, "items": items, "log": log, "results": results}
