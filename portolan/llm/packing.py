"""Operator 4: packing along a space-filling curve.

Each document is encoded once. Its hashed token counts, projected to a few dimensions, give a
point and the point a Hilbert key. The documents are range-sorted by that key and laid end to
end; every ``length`` tokens along this line are one sequence, so neighbours on the curve share
sequences and only the last few tokens remain, which become sequences of powers of two.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.shared import filled, mapped, stored
from portolan.llm.tokens import id_encoder, id_type, load

BUCKETS = 512
DIMENSIONS = 3
BITS = 10


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``points`` (whole numbers below 2**bits)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> bit) & 1
    return key


def _projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each id, from BUCKETS on with a negative sign, and the directions the buckets are projected on; the same everywhere."""
    draw = np.random.default_rng(20_240_611)
    return draw.integers(0, 2 * BUCKETS, vocabulary), draw.standard_normal((BUCKETS, DIMENSIONS))


def tail_sizes(rest: int) -> list[int]:
    """Powers of two, falling, that add up to ``rest``."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def cut(start: int, n: int, length: int, full: int, tail: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(begin in the document, size, sequence, offset) of the pieces of ``n`` tokens from ``start`` on.

    ``full`` sequences of ``length`` come first, then those of the sizes in ``tail``.
    """
    out, at, end = [], start, start + n
    while at < end:
        if at < full * length:
            sequence, begin, size = at // length, at // length * length, length
        else:
            sequence, begin = full, full * length
            for size in tail:
                if at < begin + size:
                    break
                sequence, begin = sequence + 1, begin + size
        stop = min(end, begin + size)
        out.append((at - start, stop - at, sequence, at - begin))
        at = stop
    return out


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Every id is in exactly
    one piece. Sequences are gapless from 0; all hold ``length`` tokens but the last ones, which hold powers of
    two. Rows that repeat an id are packed each; documents with equal keys lie in the order they were read.
    Other columns are ignored; an empty table gives no pieces. ``length`` must be a power of two.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    vocabulary = load(tokenizer_path).get_vocab_size()
    width = id_type(max(vocabulary, end_id + 1))

    item = np.dtype(width).itemsize

    def encode(batches):
        encoder, (bucket, directions) = id_encoder(tokenizer_path, width), _projection(vocabulary)
        end = np.asarray([end_id], dtype=width).tobytes()
        for batch in batches:
            ids = list(encoder.texts(batch.column("text").to_pylist(), b"".join))
            vectors = np.zeros((len(ids), BUCKETS))
            for row, data in enumerate(ids):
                if data:
                    counts = np.bincount(bucket[np.frombuffer(data, dtype=width)], minlength=2 * BUCKETS)
                    vectors[row] = counts[:BUCKETS] - counts[BUCKETS:]
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            points = 1 / (1 + np.exp(-1.702 * (vectors @ directions)))
            ids = [data + end for data in ids]
            yield {
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "key": hilbert_keys(np.minimum(points * 2**BITS, 2**BITS - 1)),
                "n": [len(data) // item for data in ids], "ids": ids,
            }

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), filled(text_col).alias("text"))
    encoded = stored(mapped(rows, encode, f"row bigint, doc_id {kind}, key bigint, n bigint, ids binary", "word pieces"), "encoded")

    def lay(batches):
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column("n").to_numpy()
            yield {"row": batch.column("row"), "part": np.full(len(n), part), "at": at + np.cumsum(n) - n, "n": n}
            at += int(n.sum())

    line = encoded.select("key", "row", "n").repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    line = stored(mapped(line, lay, "row bigint, part bigint, at bigint, n bigint"), "line")
    base, bases = 0, []
    for part, total in line.groupBy("part").agg(F.sum("n")).orderBy("part").collect():  # a row per partition
        bases.append((part, base))
        base += total
    full, tail = base // length, tail_sizes(base % length)
    spark = docs.sparkSession
    starts = line.join(spark.createDataFrame(bases, "part bigint, base bigint"), "part").select("row", (F.col("at") + F.col("base")).alias("begin"))

    def slices(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for doc_id, n, data, begin in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "begin")), strict=True):
                ids = np.frombuffer(data, dtype=width).astype("<u4")
                for at, size, sequence, offset in cut(begin, n, length, full, tail):
                    for name, value in zip(out, (doc_id, at, size, ids[at : at + size].tobytes(), n, sequence, offset), strict=True):
                        out[name].append(value)
            yield out

    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return mapped(encoded.join(starts, "row").select("doc_id", "n", "ids", "begin"), slices, schema)
