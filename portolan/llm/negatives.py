"""Operator 12: hard negatives by an inverted multi-index.

Vectors become whole numbers. Their first and second halves are quantised by a codebook each; a pair of
codes is a cell. For an anchor a, a half x of a row with code c scores at most a.c + |a| r, where r is the
largest distance of a half to its code c. Two lists of these bounds, sorted, give the cells in the order of
their summed bounds by a heap that never holds more than one step per code (multi-sequence order). Cells are
visited in rounds of growing size until the next bound lies below every window that is still open: below the
last kept score of a full window, else below its lower end. So the result is exact, whatever the codebooks are.

A round is a join of wanted cells with blocks of the index; a cell with very many rows is many blocks, and a
block that very many anchors want is dealt over several tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.shared import mapped, stored

SCALE = 256
POSITIVES = NEGATIVES = 5
LEAST_PERCENT = 80
#: Codebooks: fitted on at most so many vectors and components, with so many codes for each half; rows of a cell aimed at.
SAMPLE_ROWS, SAMPLE_COMPONENTS, LLOYD_ROUNDS, MOST_CODES, CELL_ROWS = 20_000, 4_000_000, 8, 256, 512
BLOCK_BYTES = 131_072
FIRST_CELLS, GROWTH = 8, 4
#: Anchors whose scores with a block are computed at once, and those of one block in one task.
ANCHORS_AT_ONCE, ANCHORS_PER_TASK = 256, 8_192
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def whole_vectors(column: pa.Array, scale: float) -> list[bytes | None]:
    """floor(scale * x) of each row as little-endian 32-bit numbers; None for rows that take no part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: list[bytes | None] = [None] * len(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become nan
    begin = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        vectors = np.floor(scale * values[begin[rows][:, None] + np.arange(dim)])
        good = np.isfinite(vectors).all(axis=1)
        good[good] = (vectors[good] * vectors[good]).sum(axis=1) < 2.0**62  # scores then fit into a long
        for row, vector in zip(rows[good], vectors[good].astype("<i4"), strict=True):
            out[row] = vector.tobytes()
    return out


def matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<i4").reshape(-1, dim)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``."""
    most = a.shape[1] * float(np.abs(a.astype(np.int64)).max(initial=0)) * float(np.abs(b.astype(np.int64)).max(initial=0))
    kind = np.float64 if most < 2.0**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _lloyd(points: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` codes for ``points``; the first distinct ones are the start."""
    _, first = np.unique(points, axis=0, return_index=True)
    codes = points[np.sort(first)[:k]].copy()
    for _ in range(LLOYD_ROUNDS):
        near = _nearest(points, codes)[0]
        for c in np.unique(near):
            codes[c] = points[near == c].mean(axis=0)
    return codes


def _nearest(points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each point and the distance to it."""
    near = ((codes * codes).sum(axis=1) - 2 * points @ codes.T).argmin(axis=1)
    return near, np.sqrt(((points - codes[near]) ** 2).sum(axis=1))


def _halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = vectors.shape[1] // 2
    return vectors[:, :at].astype(float), vectors[:, at:].astype(float)


def upper_bounds(anchors: np.ndarray, codes: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Most that a half near each code can score with each half of an anchor; a code without rows has no bound."""
    sizes = np.sqrt((anchors * anchors).sum(axis=1))[:, None]
    slack = 1e-9 * sizes * (np.sqrt((codes * codes).sum(axis=1)) + np.maximum(radii, 0))
    return np.where(radii < 0, -np.inf, anchors @ codes.T + sizes * radii + slack + 1e-3)


def visited(first: np.ndarray, second: np.ndarray, start: int, count: int, least: float) -> Iterator[int]:
    """Cells number ``start`` to ``start + count`` by falling sums of both halves' bounds, while these reach ``least``."""
    one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    heap, seen = [(-(a[0] + b[0]), 0, 0)], 0
    while heap and seen < start + count:
        bound, i, j = heapq.heappop(heap)
        if -bound < least or bound == np.inf:
            return
        if seen >= start:
            yield int(one[i]) * len(second) + int(two[j])
        seen += 1
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


class _Index:
    """The rows of one vector length: codebooks, radii, blocks of cells and a directory of them."""

    def __init__(self, rows: DataFrame, dim: int):
        self.dim, at_most = dim, max(1, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // dim))
        sample = matrix([r.vec for r in rows.select("vec").orderBy(F.xxhash64("row"), "row").limit(at_most).collect()], dim)
        k = int(min(MOST_CODES, max(1, (rows.count() / CELL_ROWS) ** 0.5)))
        self.codes = tuple(_lloyd(half, k) for half in _halves(sample))
        codes = self.codes

        def assign(batches):
            for batch in batches:
                near = [_nearest(*x) for x in zip(_halves(matrix(batch.column("vec").to_pylist(), dim)), codes, strict=True)]
                own = {c: batch.column(c) for c in ("row", "id", "label", "vec")}
                yield own | {"one": near[0][0], "two": near[1][0], "cell": near[0][0] * len(codes[1]) + near[1][0], "r_one": near[0][1], "r_two": near[1][1]}

        placed = mapped(rows.select("row", "id", "label", "vec"), assign, "row bigint, id bigint, label bigint, vec binary, one int, two int, cell int, r_one double, r_two double")
        placed = stored(placed, "cells")
        self.radii = []
        for half, own in zip(("one", "two"), codes, strict=True):
            radii = np.full(len(own), -1.0)
            for r in placed.groupBy(half).agg(F.max(f"r_{half}").alias("r")).collect():  # at most MOST_CODES rows
                radii[r[half]] = r.r * (1 + 1e-9) + 1e-6
            self.radii.append(radii)
        self.blocks = stored(self._blocks(placed), "blocks")
        self.directory = self.blocks.select("cell", "block")

    def _blocks(self, placed: DataFrame) -> DataFrame:
        """block, cell and its rows: rows, ids, labels, vecs."""
        most = max(16, BLOCK_BYTES // (4 * self.dim))

        def pack(batches):
            part, count, at, held = TaskContext.get().partitionId(), 0, None, []

            def block():
                rows, ids, labels, vecs = zip(*held, strict=True)
                longs = {n: [np.asarray(x, dtype="<i8").tobytes()] for n, x in (("rows", rows), ("ids", ids), ("labels", labels))}
                return {"block": [part << 32 | count], "cell": [at], "vecs": [b"".join(vecs)]} | longs

            for batch in batches:
                for cell, *member in zip(*(batch.column(c).to_pylist() for c in ("cell", "row", "id", "label", "vec")), strict=True):
                    if held and (at != cell or len(held) == most):
                        yield block()
                        count, held = count + 1, []
                    at = cell
                    held.append(member)
            if held:
                yield block()

        line = placed.select("cell", "row", "id", "label", "vec").repartitionByRange("cell", "row").sortWithinPartitions("cell", "row")
        return mapped(line, pack, "block bigint, cell int, rows binary, ids binary, labels binary, vecs binary")

    def requests(self, anchors: DataFrame, start: int, count: int) -> DataFrame:
        """(row, cell): the next cells of each anchor (row, vec, lows), none for those whose windows are certified."""
        dim, codes, radii = self.dim, self.codes, self.radii

        def run(batches):
            for batch in batches:
                one, two = (upper_bounds(*x) for x in zip(_halves(matrix(batch.column("vec").to_pylist(), dim)), codes, radii, strict=True))
                out: dict[str, list] = {"row": [], "cell": []}
                for row, lows, a, b in zip(batch.column("row").to_pylist(), batch.column("lows").to_pylist(), one, two, strict=True):
                    cells = list(visited(a, b, start, count, float(min(lows))))
                    out["cell"] += cells
                    out["row"] += [row] * len(cells)
                yield out

        return mapped(anchors.select("row", "vec", "lows"), run, "row bigint, cell int")

    def scanned(self, wanted: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """row, slot, score, id, other: the best ``k`` of each wanted cell's blocks in each window of the anchors."""
        asked = wanted.join(self.directory, "cell").select("block", "row")
        shares = F.ceil(F.count("*") / ANCHORS_PER_TASK).cast("int")
        asked = stored(asked, "asked")
        sizes = asked.groupBy("block").agg(shares.alias("shares"))
        none = F.lit(None)
        blocks = self.blocks.join(sizes, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        blocks = blocks.select("block", "share", F.lit(0).alias("role"), "vecs", "rows", "ids", "labels", none.cast("bigint").alias("row"), none.cast("bigint").alias("label"), *(none.cast("array<bigint>").alias(c) for c in ("slots", "lows", "highs")))
        asked = asked.join(sizes, "block").withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int")).join(anchors, "row")
        asked = asked.select("block", "share", F.lit(1).alias("role"), F.col("vec").alias("vecs"), *(none.cast("binary").alias(c) for c in ("rows", "ids", "labels")), "row", "label", "slots", "lows", "highs")
        rows = blocks.unionByName(asked).repartition("block", "share").sortWithinPartitions("block", "share", "role")
        dim = self.dim

        def best(block, held):
            vecs, others, ids, labels = block
            own, row, label, slots, lows, highs = zip(*held, strict=True)
            found = scores(matrix(own, dim), vecs)
            near = (labels[None, :] == np.asarray(label)[:, None]) == same
            near &= others[None, :] != np.asarray(row)[:, None]
            anchor = np.repeat(np.arange(len(held)), [len(s) for s in slots])
            slot, low, high = (np.concatenate([np.asarray(x, dtype=np.int64) for x in y]) for y in (slots, lows, highs))
            window, at = np.nonzero(near[anchor] & (found[anchor] >= low[:, None]) & (found[anchor] <= high[:, None]))
            score = found[anchor[window], at]
            order = np.lexsort((others[at], ids[at], -score, window))
            window, at, score = window[order], at[order], score[order]
            rank = np.arange(len(window)) - np.searchsorted(window, window)
            window, at, score = window[rank < k], at[rank < k], score[rank < k]
            return {"row": np.asarray(row)[anchor[window]], "slot": slot[window], "score": score, "id": ids[at], "other": others[at]}

        def run(batches):
            block, held = None, []
            for batch in batches:
                for role, vecs, *rest in zip(*(batch.column(c).to_pylist() for c in ("role", "vecs", "rows", "ids", "labels", "row", "label", "slots", "lows", "highs")), strict=True):
                    if held and (role == 0 or len(held) == ANCHORS_AT_ONCE):
                        yield best(block, held)
                        held = []
                    if role == 0:
                        block = (matrix([vecs], dim), *(np.frombuffer(x, "<i8") for x in rest[:3]))
                    else:
                        held.append((vecs, *rest[3:]))
            if held:
                yield best(block, held)

        return mapped(rows, run, "row bigint, slot bigint, score bigint, id bigint, other bigint")

    def search(self, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """The first ``k`` rows of each window (row, slot, low, high) of the anchors (row, label, vec): row, slot, rank, score, id, other.

        Rows have the label of the anchor (``same``) or another one; higher scores come first, then smaller ids.
        """
        best, start, count = None, 0, FIRST_CELLS
        order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id", "other")
        while start < len(self.codes[0]) * len(self.codes[1]):
            listed = windows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))
            listed = listed.select("row", F.col("w.slot").alias("slots"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
            anchors = stored(anchors.select("row", "label", "vec").join(listed, "row"), "anchors")
            wanted = stored(self.requests(anchors, start, count), "wanted")
            if wanted.isEmpty():
                break
            found = self.scanned(wanted, anchors, same, k)
            found = (best.drop("rank").unionByName(found) if best is not None else found).withColumn("rank", F.row_number().over(order).cast("long"))
            best = stored(found.filter(F.col("rank") <= k), "best")
            full = best.filter(F.col("rank") == k).select("row", "slot", F.col("score").alias("last"))
            windows = windows.join(wanted.select("row").distinct(), "row").join(full, ["row", "slot"], "left").select("row", "slot", F.greatest("low", "last").alias("low"), "high")
            windows = stored(windows, "windows")
            start, count = start + count, count * GROWTH
        if best is None:
            best = anchors.sparkSession.createDataFrame([], "row bigint, slot bigint, score bigint, id bigint, other bigint, rank bigint")
        return best


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: exact, one row per negative found.

    Components become floor(``scale`` * x); the score of two rows is their inner product. Higher scores come first, ties by smaller
    id (a whole number; null ids come last). For each anchor (a row where ``is_anchor`` is true) its positives are the first ``positives``
    other rows of its label. For each of them the first ``negatives`` rows of another label that score at most as much as the positive and at
    least ``least_percent`` of it; a positive with a score below 0 has none. Rows with a null label, a null or empty vector, a null or non-finite
    component, or components so large that scores would not fit into a long take no part. Only vectors of equal length are compared. Rows
    that repeat an id, or a vector, are rows of their own; other columns are ignored; an empty table gives an empty table.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(HIGHEST)).alias("id"), F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col))).alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"))

    def whole(batches):
        for batch in batches:
            vecs = whole_vectors(batch.column("vector"), scale)
            yield {c: batch.column(c) for c in ("row", "id", "label", "anchor")} | {"dim": [len(v) // 4 if v else None for v in vecs], "vec": vecs}

    rows = mapped(rows, whole, "row bigint, id bigint, label bigint, anchor boolean, dim int, vec binary").filter("label is not null and vec is not null")
    rows = stored(rows, "vectors")
    parts = []
    for (dim,) in rows.select("dim").distinct().collect():  # the lengths of vectors that occur
        own = rows.filter(F.col("dim") == dim)
        index, anchors = _Index(own, dim), own.filter("anchor").select("row", "id", "label", "vec")
        every = anchors.select("row", F.lit(0).cast("long").alias("slot"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
        near = index.search(anchors, every, True, positives)
        near = stored(near.select("row", F.col("rank").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("high")), "positives")
        gap = 100 - least_percent
        lowest = F.expr(f"high - (high div 100) * {gap} - ((high % 100) * {gap}) div 100")  # the least whole number that is not below the share
        windows = near.filter("high >= 0").select("row", "slot", lowest.alias("low"), "high")
        far = index.search(anchors, windows, False, negatives)
        named = near.join(anchors.select("row", F.col("id").alias("anchor")), "row")
        parts.append(far.select("row", "slot", "rank", "id", "score").join(named, ["row", "slot"]))
    original = lambda c, name: F.when(F.col(c) < HIGHEST, F.col(c)).cast(kind).alias(name)
    columns = [original("anchor", "anchor_id"), original("positive", "positive_id"), F.col("rank").cast("int").alias("rank"), original("id", "negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score")]
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
