"""Review changes, deletions, duplicates and the replica."""

from pyspark.sql import functions as F

from portolan.operators import changes, joins, replica, windows
from portolan.queries.imports import sample_sheet_items
from portolan.queries.oracle_tables import with_tables
from portolan.queries.registry import query
from portolan.sources import sample_tables as st

AT = "2024-05-06 07:08:09"
_HEADS = ["id", "number", "owner", "date", "channel", "fob", "cif", "file_name", "file_hash", "status", "updated_at"]
_LINES = ["id", "dispatch_id", "item_no", "brand"]


def _heads(spark, sf):
    return st.dispatches(spark, sf).select(*_HEADS)


def _lines(spark, sf):
    return st.items(spark, sf).select(*_LINES)


def _edit(field, value):
    return F.struct(F.lit(field).alias("field"), value.alias("raw_value"))


def _review(spark, sf):
    heads = _heads(spark, sf)
    values = F.array(
        _edit("channel", F.lit(" ROJO ")), _edit("owner", F.lit(" ")), _edit("fob", F.lit("1.234,50")), _edit("date", F.lit("10/08/2001")),
        _edit("cif", F.when(F.col("cif") == 0, "").otherwise("0")), _edit("unknown", F.lit("x")))
    edits = heads.filter("id % 4 = 1").select(F.col("id").alias("dispatch_id"), F.inline(values))
    return changes.review_changes(heads, edits, AT)


@query("review_changes", with_tables("""
, e AS (SELECT * FROM dispatches WHERE id % 4 = 1)
SELECT id AS dispatch_id, 'channel' AS field, channel AS old_value, 'ROJO' AS new_value FROM e WHERE channel <> 'ROJO'
UNION ALL SELECT id, 'owner', owner, NULL FROM e WHERE owner <> ''
UNION ALL SELECT id, 'fob', regexp_replace(regexp_replace(printf('%.6f', fob), '0+$', ''), '\\.$', '.0'), '1234.5' FROM e
UNION ALL SELECT id, 'date', CAST(date AS VARCHAR), '2001-08-10' FROM e WHERE date IS NULL OR date <> DATE '2001-08-10'
UNION ALL SELECT id, 'cif', regexp_replace(regexp_replace(printf('%.6f', cif), '0+$', ''), '\\.$', '.0'), '0.0' FROM e WHERE cif <> 0"""))
def review_changes(spark, sf):
    return _review(spark, sf)[1].select("dispatch_id", "field", "old_value", "new_value")


@query("review_applied", with_tables(f"""
SELECT id, CASE WHEN id % 4 = 1 THEN 'ROJO' ELSE channel END AS channel,
  CASE WHEN id % 4 = 1 AND owner <> '' THEN NULL ELSE owner END AS owner, CASE WHEN id % 4 = 1 THEN 1234.5 ELSE fob END AS fob,
  CASE WHEN id % 4 = 1 THEN DATE '2001-08-10' ELSE date END AS date, CASE WHEN id % 4 = 1 THEN 'CONFIRMADO' ELSE status END AS status,
  CASE WHEN id % 4 = 1 THEN TIMESTAMP '{AT}' ELSE updated_at END AS updated_at FROM dispatches"""))
def review_applied(spark, sf):
    return _review(spark, sf)[0].select("id", "channel", "owner", "fob", "date", "status", "updated_at")


def _owner_edits(spark, sf):
    return _heads(spark, sf).filter("id % 6 = 2").select(
        F.col("id").alias("dispatch_id"), F.when(F.col("id") % 4 == 0, F.lit("  ")).otherwise(F.lit(" ACME ")).alias("owner"))


@query("set_owner", with_tables("""
SELECT id, CASE WHEN id % 6 <> 2 THEN owner WHEN id % 4 = 0 THEN 'Sin Asignar' ELSE 'ACME' END AS owner FROM dispatches"""))
def set_owner(spark, sf):
    return changes.set_owner(_heads(spark, sf), _owner_edits(spark, sf), AT)[0].select("id", "owner")


@query("set_owner_log", with_tables("""
SELECT id AS dispatch_id, coalesce(nullif(owner, ''), 'Sin Asignar') AS old_value, CASE WHEN id % 4 = 0 THEN 'Sin Asignar' ELSE 'ACME' END AS new_value
FROM dispatches WHERE id % 6 = 2"""))
def set_owner_log(spark, sf):
    return changes.set_owner(_heads(spark, sf), _owner_edits(spark, sf), AT)[1].select("dispatch_id", "old_value", "new_value")


def _with_copies(spark, sf):
    """Every fifth header is registered a second time, every tenth a third time."""
    heads = _heads(spark, sf)
    twice = heads.filter("id % 5 = 0").withColumn("id", F.col("id") + 1000000000).withColumn("number", F.concat(F.lit(" "), "number"))
    thrice = heads.filter("id % 10 = 0").withColumn("id", F.col("id") + 2000000000)
    items = _lines(spark, sf)
    copies = items.filter("dispatch_id % 5 = 0").withColumn("dispatch_id", F.col("dispatch_id") + 1000000000).withColumn("id", F.concat(F.lit("c"), "id"))
    used = copies.filter("dispatch_id % 3 = 0").select(F.col("id").alias("catalog_item_id"), F.lit(1).alias("sheet_id"))
    return {"dispatches": heads.unionByName(twice).unionByName(thrice), "items": items.unionByName(copies),
            "sheet_items": used.unionByName(items.filter("item_no = 1").select(F.col("id").alias("catalog_item_id"), F.lit(2).alias("sheet_id")))}


@query("exact_duplicates", with_tables("""
SELECT id + 1000000000 AS id, id AS kept_id FROM dispatches WHERE id % 5 = 0
UNION ALL SELECT id + 2000000000, id FROM dispatches WHERE id % 10 = 0"""))
def exact_duplicates(spark, sf):
    return windows.exact_duplicates(_with_copies(spark, sf)["dispatches"]).select("id", "kept_id")


_USED = """
, used AS (SELECT DISTINCT dispatch_id + 1000000000 AS id FROM items WHERE dispatch_id % 5 = 0 AND (dispatch_id + 1000000000) % 3 = 0)
"""


@query("remove_exact_duplicates", with_tables(_USED + """
SELECT id FROM dispatches UNION ALL SELECT id FROM used"""))
def remove_exact_duplicates(spark, sf):
    return changes.remove_exact_duplicates(_with_copies(spark, sf))["dispatches"].select("id")


@query("remove_duplicates_skipped", with_tables(_USED + "SELECT id, id - 1000000000 AS kept_id FROM used"))
def remove_duplicates_skipped(spark, sf):
    return changes.remove_exact_duplicates(_with_copies(spark, sf))["skipped"].select("id", "kept_id")


def _deleted(spark, sf):
    lines = sample_sheet_items(spark, sf).select("sheet_id", "catalog_item_id", "quantity")
    tables = {"dispatches": _heads(spark, sf), "items": _lines(spark, sf), "sheet_items": lines}
    return changes.delete_dispatches(tables, _heads(spark, sf).filter("id % 7 = 3").select("id"))


@query("delete_dispatches", with_tables("SELECT id, dispatch_id FROM items WHERE dispatch_id % 7 <> 3"))
def delete_dispatches(spark, sf):
    return _deleted(spark, sf)["items"].select("id", "dispatch_id")


@query("delete_dispatches_references", with_tables("""
SELECT dispatch_id AS sheet_id, CASE WHEN dispatch_id % 7 <> 3 THEN id END AS catalog_item_id, quantity FROM items"""))
def delete_dispatches_references(spark, sf):
    return _deleted(spark, sf)["sheet_items"]


@query("new_groups", with_tables("SELECT number, date FROM dispatches WHERE id % 3 <> 0"))
def new_groups(spark, sf):
    heads = _heads(spark, sf)
    return joins.new_groups(heads.select("number", "date"), heads.filter("id % 3 = 0"))


# Replica: ids are shifted; by key a header is unknown, known by number, by hash or by file name.

_REMOTE_ID = "id * 2 + 7"


def _remote(spark, sf):
    """A replica: two thirds of the headers, some only recognisable by hash or file name, some twice."""
    heads = _heads(spark, sf).filter("id % 3 < 2")
    key = F.col("id")
    shifted = heads.select(
        (key * 2 + 7).alias("id"),
        F.when(key % 5 == 1, F.lit("S/N")).when(key % 5 == 2, F.lit("")).otherwise(F.col("number")).alias("number"),
        F.lit("REMOTE").alias("owner"), "date", F.lit("NARANJA").alias("channel"), "fob", "cif", "file_name",
        F.when(key % 5 == 2, F.sha2(F.col("number"), 224)).otherwise(F.col("file_hash")).alias("file_hash"), "status", "updated_at")
    # The older copies are written from the same row, so the headers are read and hashed once.
    own = F.struct("id", "owner")
    older = F.struct((F.col("id") + 500000000).alias("id"), F.lit("OLDER").alias("owner"))
    copies = F.when(F.col("id") % 4 == 1, F.array(own, older)).otherwise(F.array(own))
    rest = [c for c in shifted.columns if c not in ("id", "owner")]
    return shifted.select(F.inline(copies), *rest).select(*shifted.columns)


def _remote_items(spark, sf):
    return _lines(spark, sf).filter("dispatch_id % 3 < 2").withColumn("dispatch_id", F.col("dispatch_id") * 2 + 7).withColumn(
        "id", F.concat(F.lit("r"), "id"))


@query("replica_delta", with_tables("""
SELECT id FROM dispatches WHERE id % 3 = 2 OR (id % 5 = 2)"""))
def replica_delta(spark, sf):
    return replica.replica_delta(_heads(spark, sf), _remote(spark, sf)).select("id")


@query("match_replica", with_tables("""
SELECT id * 2 + 7 AS id, id AS local_id FROM dispatches WHERE id % 3 < 2
UNION ALL SELECT id * 2 + 500000007, id FROM dispatches WHERE id % 3 < 2 AND (id * 2 + 7) % 4 = 1"""))
def match_replica(spark, sf):
    return replica.match_replica(_remote(spark, sf), _heads(spark, sf)).select("id", "local_id")


def _pull(spark, sf, full):
    """Locally every second header is missing."""
    heads, lines = _heads(spark, sf).filter("id % 2 = 0"), _lines(spark, sf).filter("dispatch_id % 2 = 0")
    return replica.pull(_remote(spark, sf), _remote_items(spark, sf), heads, lines, full)


_PULL = """
, known AS (SELECT *, id % 2 = 0 AS here, id % 3 < 2 AS there FROM dispatches),
fresh AS (SELECT id, row_number() OVER (ORDER BY id) + (SELECT max(id) FROM dispatches WHERE id % 2 = 0) AS local_id FROM known WHERE there AND NOT here)
"""


@query("replica_merge", with_tables(_PULL + """
SELECT id, CASE WHEN there AND id % 5 = 1 THEN 'S/N' WHEN there AND id % 5 = 2 THEN NULL ELSE number END AS number,
  CASE WHEN there THEN 'REMOTE' ELSE owner END AS owner, CASE WHEN there THEN 'NARANJA' ELSE channel END AS channel, fob FROM known WHERE here
UNION ALL SELECT local_id, CASE WHEN id % 5 = 1 THEN 'S/N' WHEN id % 5 = 2 THEN NULL ELSE number END, 'REMOTE', 'NARANJA', fob
  FROM fresh JOIN known USING (id)"""))
def replica_merge(spark, sf):
    return _pull(spark, sf, False)[0].select("id", "number", "owner", "channel", "fob")


@query("pull_quick_items", with_tables(_PULL + """
SELECT id, dispatch_id FROM items WHERE dispatch_id % 2 = 0
UNION ALL SELECT 'r' || i.id, local_id FROM items i JOIN fresh ON fresh.id = i.dispatch_id"""))
def pull_quick_items(spark, sf):
    return _pull(spark, sf, False)[1].select("id", "dispatch_id")


@query("pull_full_items", with_tables(_PULL + """
SELECT CASE WHEN dispatch_id % 3 < 2 THEN 'r' || id ELSE id END AS id, dispatch_id FROM items WHERE dispatch_id % 2 = 0
UNION ALL SELECT 'r' || i.id, local_id FROM items i JOIN fresh ON fresh.id = i.dispatch_id"""))
def pull_full_items(spark, sf):
    return _pull(spark, sf, True)[1].select("id", "dispatch_id")


def _push(spark, sf):
    heads = _heads(spark, sf)
    remote = heads.filter("id % 3 = 0").withColumn("id", F.col("id") * 2 + 7).withColumn(
        "number", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("number")))
    lines = _lines(spark, sf)
    old = lines.filter("dispatch_id % 3 = 0").withColumn("dispatch_id", F.col("dispatch_id") * 2 + 7).withColumn("id", F.concat(F.lit("old"), "id"))
    return heads, lines, remote, old


_PUSH = """
, fresh AS (SELECT id, row_number() OVER (ORDER BY id) + (SELECT max(id) * 2 + 7 FROM dispatches WHERE id % 3 = 0) AS remote_id
  FROM dispatches WHERE id % 3 <> 0),
pushed AS (SELECT id, id * 2 + 7 AS remote_id FROM dispatches WHERE id % 3 = 0 UNION ALL SELECT * FROM fresh)
"""


@query("push_dispatches", with_tables(_PUSH + """
SELECT remote_id AS id, number, owner, file_hash FROM pushed JOIN dispatches USING (id)"""))
def push_dispatches(spark, sf):
    return replica.push_dispatches(*_push(spark, sf))[0].select("id", "number", "owner", "file_hash")


@query("push_dispatches_items", with_tables(_PUSH + """
SELECT items.id, remote_id AS dispatch_id FROM items JOIN pushed ON pushed.id = dispatch_id"""))
def push_dispatches_items(spark, sf):
    return replica.push_dispatches(*_push(spark, sf))[1].select("id", "dispatch_id")


@query("push_delta", with_tables(_PUSH + """
SELECT remote_id, id AS local_id FROM fresh"""))
def push_delta(spark, sf):
    return replica.push_delta(*_push(spark, sf))[2]


@query("delete_from_replica", with_tables("""
SELECT id, dispatch_id FROM items WHERE dispatch_id % 12 NOT IN (1, 5, 9)"""))
def delete_from_replica(spark, sf):
    heads = _heads(spark, sf)
    keys = heads.filter("id % 12 IN (1, 5, 9)").select(
        F.when(F.col("id") % 12 == 9, F.col("id")).alias("id"), F.when(F.col("id") % 12 == 1, F.col("number")).alias("number"),
        F.when(F.col("id") % 12 == 5, F.col("file_hash")).alias("file_hash"))
    return replica.delete_from_replica(heads, _lines(spark, sf), keys)[1].select("id", "dispatch_id")


@query("replica_types", with_tables("""
SELECT id, CAST(date AS VARCHAR) AS date, fob, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_at FROM dispatches"""))
def replica_types(spark, sf):
    return replica.to_replica_types(_heads(spark, sf).select("id", "date", "fob", "updated_at"))


@query("replica_types_back", with_tables("SELECT id, date, fob, updated_at FROM dispatches"))
def replica_types_back(spark, sf):
    heads = _heads(spark, sf).select("id", "date", "fob", "updated_at")
    return replica.from_replica_types(replica.to_replica_types(heads), heads.schema)
