"""Operator 2: exact duplicates by composable polynomial fingerprints.

The fingerprint of a text is the value of its UTF-8 bytes, each plus one, as the digits of a
number to two bases modulo two primes. With the length it composes: the fingerprint of two
parts is that of the first, shifted by the length of the second, plus that of the second.
Documents are therefore hashed in chunks, in one task or, beyond ``spread_bytes``, in many.
Texts with equal fingerprints are then compared chunk by chunk with the row that stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.shared import WHITE, filled, mapped, stored

CHUNK_BYTES = 1 << 16
SPREAD_BYTES = 8 << 20
MEMBERS_PER_SALT = 500
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_001)


def _powers(base: int, prime: int) -> np.ndarray:
    """base**(CHUNK_BYTES-1), ..., base, 1 modulo the prime."""
    out, one = np.empty(CHUNK_BYTES, dtype=np.uint64), 1
    for k in range(CHUNK_BYTES - 1, -1, -1):
        out[k] = one
        one = one * base % prime
    return out


def chunk_value(data, powers: np.ndarray, prime: int) -> int:
    """Fingerprint of at most CHUNK_BYTES bytes; the sum stays below 2**56."""
    digits = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return int(np.dot(digits, powers[CHUNK_BYTES - len(digits) :])) % prime if len(digits) else 0


def joined(first: int, second: int, second_length: int, which: int) -> int:
    """Fingerprint of two parts from those of the parts and the length of the second."""
    return (first * pow(BASES[which], second_length, PRIMES[which]) + second) % PRIMES[which]


def _chunks(data: Column, n: Column) -> Column:
    size = F.lit(CHUNK_BYTES)
    count = F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * size + 1, size))


def _bytes(text_col: str) -> Column:
    return F.regexp_replace(filled(text_col), WHITE, " ").cast("binary")


def text_sha256(text_col: str) -> Column:
    """Hash of the normalised text, as in the result of ``exact_duplicates``."""
    return F.sha2(_bytes(text_col), 256)


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), _bytes(text_col).alias("data"))
    return rows.select("doc_id", "data", F.sha2("data", 256).alias("text_sha256"), F.octet_length("data").cast("long").alias("n"))


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, spread_bytes: int) -> DataFrame:
    """doc_id, text_sha256, n, fp_a, fp_b: one row per row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, text_sha256 string, n bigint, fp_a bigint, fp_b bigint"
    long_text = F.octet_length(filled(text_col)) > spread_bytes

    def along(batches):  # the chunks of a document follow each other: carry its fingerprint on
        powers = [_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
        at = [0, 0]
        for batch in batches:
            out = {"doc_id": [], "text_sha256": [], "n": [], "fp_a": [], "fp_b": []}
            for doc_id, sha, n, pos, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_sha256", "n", "pos", "data")), strict=True):
                at = [joined(at[k] if pos else 0, chunk_value(data, powers[k], PRIMES[k]), len(data), k) for k in (0, 1)]
                if (pos + 1) * CHUNK_BYTES >= n:
                    for name, value in zip(out, (doc_id, sha, n, *at), strict=True):
                        out[name].append(value)
            yield out

    def alone(batches):  # a chunk by itself, shifted by the length of what follows it in its document
        powers = [_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
        for batch in batches:
            out = {"doc_id": batch.column("doc_id"), "text_sha256": batch.column("text_sha256"), "n": batch.column("n"), "pos": batch.column("pos"), "fp_a": [], "fp_b": []}
            for n, pos, data in zip(*(batch.column(c).to_pylist() for c in ("n", "pos", "data")), strict=True):
                rest = n - pos * CHUNK_BYTES - len(data)
                for k, name in enumerate(("fp_a", "fp_b")):
                    out[name].append(joined(chunk_value(data, powers[k], PRIMES[k]), 0, rest, k))
            yield out

    def chunk_rows(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "text_sha256", "n", F.posexplode(_chunks(F.col("data"), F.col("n"))).alias("pos", "data"))

    usual = mapped(chunk_rows(_normalised(docs.filter(~long_text), id_col, text_col)), along, schema)
    spread = chunk_rows(_normalised(docs.filter(long_text), id_col, text_col)).repartition("doc_id", "text_sha256", "pos")
    spread = mapped(spread, alone, f"doc_id {kind}, text_sha256 string, n bigint, pos int, fp_a bigint, fp_b bigint")
    key = ["doc_id", "text_sha256", "n"]
    spread = spread.groupBy(*key, "pos").agg(F.max("fp_a").alias("fp_a"), F.max("fp_b").alias("fp_b"), F.count("*").alias("copies"))
    spread = spread.groupBy(*key).agg((F.sum("fp_a") % PRIMES[0]).alias("fp_a"), (F.sum("fp_b") % PRIMES[1]).alias("fp_b"), F.max("copies").alias("copies"))
    spread = spread.select(*key, "fp_a", "fp_b", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    return usual.unionByName(spread)


def _differing(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_sha256) of members whose text is not that of the row that stays, by streaming comparison.

    ``members``: doc_id, text_sha256, fp_a, fp_b, n, group_size, role (0 for the row that stays).
    The chunks of a large group are dealt over several tasks; the row that stays goes to each.
    """
    salts = F.ceil(F.col("group_size") / MEMBERS_PER_SALT).cast("int")
    dealt = F.when(F.col("role") == 0, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), salts).cast("int")))
    members = members.select("doc_id", "text_sha256", "fp_a", "fp_b", "role", F.explode(dealt).alias("salt")).distinct()
    members = members.withColumnsRenamed({"doc_id": "member_id", "text_sha256": "member_sha"})
    texts = _normalised(docs, id_col, text_col)
    texts = texts.join(members, F.col("doc_id").eqNullSafe(F.col("member_id")) & (F.col("text_sha256") == F.col("member_sha")))
    rows = texts.select("doc_id", "text_sha256", "fp_a", "fp_b", "role", "salt", F.posexplode(_chunks(F.col("data"), F.col("n"))).alias("pos", "data"))
    group = ["fp_a", "fp_b", "pos", "salt"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, "role")
    kind = docs.schema[id_col].dataType.simpleString()

    def compare(batches):
        at, stays = None, None
        for batch in batches:
            out = {"doc_id": [], "text_sha256": []}
            columns = (batch.column(c).to_pylist() for c in (*group, "role", "doc_id", "text_sha256", "data"))
            for a, b, pos, salt, role, doc_id, sha, data in zip(*columns, strict=True):
                if role == 0:
                    at, stays = (a, b, pos, salt), data
                elif at != (a, b, pos, salt) or data != stays:
                    out["doc_id"].append(doc_id)
                    out["text_sha256"].append(sha)
            yield out

    return mapped(rows, compare, f"doc_id {kind}, text_sha256 string").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space is one space; null
    counts as empty. The row with the smallest id stays. Null ids come last: a group of null ids only
    has a null ``keep_id``, and all its rows stay, since nothing tells them apart. Rows that repeat
    id and text count in ``group_size`` and stay together. Other columns are ignored; an empty table
    gives an empty table.
    """
    prints = stored(_fingerprints(docs, id_col, text_col, spread_bytes), "fingerprints")
    key = ["fp_a", "fp_b", "n"]
    left, done = prints, []
    while True:
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256")
        groups = left.groupBy(*key).agg(F.min(order).alias("stays"), F.count("*").alias("group_size"))
        joined_rows = left.join(groups, key).withColumn("role", F.when((F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))) & (F.col("text_sha256") == F.col("stays.text_sha256")), 0).otherwise(1))
        odd = stored(_differing(docs, joined_rows.filter("group_size > 1"), id_col, text_col), "collisions")
        if odd.isEmpty():
            done.append(joined_rows.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", "text_sha256"))
            break
        # Different texts met under one fingerprint: settle the equal ones, then group the others among themselves.
        match = [left["doc_id"].eqNullSafe(odd["doc_id"]), left["text_sha256"] == odd["text_sha256"]]
        same = left.join(odd, match, "left_anti")
        groups = same.groupBy(*key).agg(F.min(order).alias("stays"), F.count("*").alias("group_size"))
        done.append(same.join(groups, key).select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", "text_sha256"))
        left = stored(left.join(odd, match, "left_semi"), "collided")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
