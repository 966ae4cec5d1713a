"""Operator 7: embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least c are at most e = sqrt(2 - 2c) apart, also after projection
to a few principal dimensions. The vectors of a label are sorted by their grid cells of width e
on these dimensions and cut into blocks. Consecutive blocks form intervals, intervals form larger
ones, each with its bounding box. Starting from whole labels, pairs of intervals are split
into pairs of their parts, and pairs whose boxes are more than e apart are dropped. The blocks
that are left are compared in double precision inside tasks, which return counts and a
spanning set of links, never all pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.components import components
from portolan.llm.shared import mapped, stored

COSINE = 0.93
BLOCK = 1024
FAN_OUT = 8
DIMENSIONS = 8
SUMMERS = 16


def _unit_rows(column: pa.Array) -> list[bytes | None]:
    """The unit vector of each row as little-endian doubles; None for null, zero, empty, or non-finite ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: list[bytes | None] = [None] * len(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become nan
    begin = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        vectors = values[begin[rows][:, None] + np.arange(dim)]
        finite = np.isfinite(vectors).all(axis=1)
        scale = np.abs(np.where(finite[:, None], vectors, 0)).max(axis=1)
        good = finite & (scale > 0)
        vectors = vectors[good] / scale[good][:, None]
        vectors = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)) + 0.0
        for row, vector in zip(rows[good], vectors, strict=True):
            out[row] = vector.tobytes()
    return out


def _directions(classes: DataFrame, dim: int) -> np.ndarray:
    """Leading principal directions of the vectors of one dimension, from sums over all of them."""

    def second_moments(batches):
        total = np.zeros((dim + 1, dim))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), dtype="<f8").reshape(-1, dim)
            total[:dim] += x.T @ x
            total[dim] += x.sum(axis=0)
        yield {"part": [TaskContext.get().partitionId()], "total": [total.tobytes()]}

    def add(batches):
        blobs = [np.frombuffer(b, dtype="<f8") for batch in batches for b in batch.column("total").to_pylist()]
        yield {"part": [0] if blobs else [], "total": [sum(blobs).tobytes()] if blobs else []}

    parts = mapped(classes.filter(F.col("dim") == dim).select("unit"), second_moments, "part bigint, total binary")
    sums = mapped(parts.repartition(SUMMERS, "part"), add, "part bigint, total binary").collect()  # at most SUMMERS matrices
    n = classes.filter(F.col("dim") == dim).count()
    total = sum(np.frombuffer(r.total, dtype="<f8") for r in sums).reshape(dim + 1, dim)
    mean = total[dim] / n
    _, vectors = np.linalg.eigh(total[:dim] / n - np.outer(mean, mean))
    return vectors[:, ::-1][:, :DIMENSIONS]


def _blocks(classes: DataFrame, directions: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """Blocks of the epsilon grid order: block, label, dim, low*, high*, cids, sizes, units."""
    axes = range(DIMENSIONS)
    label = classes.schema["label"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            points = np.zeros((batch.num_rows, DIMENSIONS))
            for row, (dim, unit) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("unit").to_pylist(), strict=True)):
                at = np.frombuffer(unit, dtype="<f8") @ directions[dim]
                points[row, : len(at)] = at
            columns = {c: batch.column(c) for c in ("cid", "label", "dim", "size", "unit")}
            yield columns | {f"x{k}": points[:, k] for k in axes}

    points = ", ".join(f"x{k} double" for k in axes)
    placed = mapped(classes.select("cid", "label", "dim", "size", "unit"), project, f"cid bigint, label {label}, dim int, size bigint, unit binary, {points}")
    order = ["label", "dim", *(F.floor(F.col(f"x{k}") / epsilon) for k in axes), "x0", "cid"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches):
        part, count, group, held = TaskContext.get().partitionId(), 0, None, []

        def block():
            x = np.asarray([h[3:] for h in held])
            return {
                "block": [part << 32 | count], "label": [group[0]], "dim": [group[1]], "cids": [np.asarray([h[0] for h in held], "<i8").tobytes()],
                "sizes": [np.asarray([h[1] for h in held], "<i8").tobytes()], "units": [b"".join(h[2] for h in held)],
            } | {f"low{k}": [x[:, k].min()] for k in axes} | {f"high{k}": [x[:, k].max()] for k in axes}

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("label", "dim", "cid", "size", "unit", *(f"x{k}" for k in axes)))
            for name, dim, *member in zip(*columns, strict=True):
                if held and (group != (name, dim) or len(held) == BLOCK):
                    yield block()
                    count, held = count + 1, []
                group = (name, dim)
                held.append(member)
        if held:
            yield block()

    boxes = ", ".join(f"low{k} double, high{k} double" for k in axes)
    return mapped(placed, pack, f"block bigint, label {label}, dim int, {boxes}, cids binary, sizes binary, units binary")


def _near_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b) of blocks of one label whose boxes are at most epsilon apart, by joining intervals recursively."""
    axes, group = range(DIMENSIONS), ["label", "dim"]
    boxes = [f"{side}{k}" for k in axes for side in ("low", "high")]
    at = F.row_number().over(Window.partitionBy(*group).orderBy("block")) - 1  # a light row per block
    leaves = stored(blocks.select("block", *group, *boxes).withColumn("node", at.cast("long")), "leaves")
    levels, most = [leaves], leaves.agg(F.max("node")).first()[0] or 0
    while most > 0:
        merged = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in boxes]
        up = levels[-1].withColumn("node", F.floor(F.col("node") / FAN_OUT).cast("long")).groupBy(*group, "node").agg(*merged)
        levels.append(stored(up, "intervals"))
        most //= FAN_OUT
    pairs = levels[-1].select(*group, F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        part = level.withColumn("parent", F.floor(F.col("node") / FAN_OUT).cast("long"))
        side = lambda x: part.select(*group, F.col("parent").alias(f"{x}_parent"), F.col("node").alias(f"{x}_node"), *(F.col(c).alias(f"{x}_{c}") for c in boxes))  # noqa: B023, E731
        pairs = pairs.withColumnsRenamed({"a": "a_parent", "b": "b_parent"}).join(side("a"), [*group, "a_parent"]).join(side("b"), [*group, "b_parent"])
        gaps = [F.greatest(F.lit(0.0), F.col(f"a_low{k}") - F.col(f"b_high{k}"), F.col(f"b_low{k}") - F.col(f"a_high{k}")) for k in axes]
        apart = reduce(lambda x, y: x + y, (g * g for g in gaps))
        pairs = pairs.filter((F.col("a_node") <= F.col("b_node")) & (apart <= epsilon * epsilon + 1e-9))
        pairs = stored(pairs.select(*group, F.col("a_node").alias("a"), F.col("b_node").alias("b")), "intervals")
    named = leaves.select(*group, "node", "block")
    pairs = pairs.join(named.withColumnsRenamed({"node": "a", "block": "block_a"}), [*group, "a"]).join(named.withColumnsRenamed({"node": "b", "block": "block_b"}), [*group, "b"])
    return pairs.select("block_a", "block_b", "dim")


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 with links a-b: the smallest node reachable."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """cid, links (vectors linked directly, found in one pair of blocks), root (a cid it is connected with)."""
    side = lambda x: blocks.select(F.col("block").alias(f"block_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("cids", "sizes", "units")))
    rows = pairs.join(side("a"), "block_a").join(side("b"), "block_b")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, sizes, units = ([np.frombuffer(r[f"{c}_{x}"], t) for x in "ab"] for c, t in (("cids", "<i8"), ("sizes", "<i8"), ("units", "<f8")))
                links = units[0].reshape(-1, r["dim"]) @ units[1].reshape(-1, r["dim"]).T >= cosine
                same = r["block_a"] == r["block_b"]
                if same:
                    np.fill_diagonal(links, False)
                counts = [links @ sizes[1], np.zeros(len(ids[1]), int) if same else links.T @ sizes[0]]
                a, b = np.nonzero(links)
                root = local_roots(a, b if same else b + len(ids[0]), len(ids[0]) + (0 if same else len(ids[1])))
                all_ids, all_counts = (ids[0], counts[0]) if same else (np.concatenate(ids), np.concatenate(counts))
                linked = all_counts > 0
                yield {"cid": all_ids[linked], "links": all_counts[linked], "root": all_ids[root[linked]]}

    return mapped(rows, run, "cid bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal, their vectors equally long and the cosine in double precision is at
    least ``cosine`` (above 0). A null label and a vector that is null, empty, zero or has a null or non-finite
    component link with nothing: 0 links, its own component. Equal vectors are compared once and counted with their
    number; rows that repeat an id count as rows. Null ids link, but name no component. Other columns are ignored;
    an empty table gives an empty table.
    """
    id_type, label = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    epsilon = math.sqrt(2 - 2 * cosine)

    def unit(batches):
        for batch in batches:
            units = _unit_rows(batch.column("vector"))
            yield {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "dim": [len(u) // 8 if u else None for u in units], "unit": units}

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = mapped(rows, unit, f"vec_id {id_type}, label {label}, dim int, unit binary")
    rows = stored(rows.withColumn("sha", F.when(F.col("label").isNotNull(), F.sha2("unit", 256))), "vectors")
    usable = rows.filter("sha is not null")
    key = ["label", "dim", "sha"]
    classes = usable.groupBy(*key).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"), F.first("unit").alias("unit"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    dims = [r.dim for r in classes.select("dim").distinct().collect()]  # the lengths of vectors that occur
    blocks = stored(_blocks(classes, {d: _directions(classes, d) for d in dims}, epsilon), "blocks")
    found = stored(_compare(_near_blocks(blocks, epsilon), blocks, cosine), "found")
    groups = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", *key, "first_id", "size").join(groups.withColumnRenamed("id", "cid"), "cid", "left").join(links, "cid", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "cid")), "named")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "component").select(*key, "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = usable.select("vec_id", *key).join(named, key).select("vec_id", "n_links", "component_id")
    alone = rows.filter("sha is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
