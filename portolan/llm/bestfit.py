"""Operator 13: packing into as few sequences as possible, by the configuration linear program.

Only lengths matter, so the program is over their histogram: a configuration is a multiset of lengths that fits
into a sequence, and as few configurations as possible shall cover the counts. Weights of the lengths are its
dual prices. Each round a knapsack by dynamic programming finds, for every length that is left, the most valuable
configuration with it; each is used for a share of what is left, and the weights of lengths that lag behind rise,
those of the others fall, by a factor (multiplicative weights). The shares are rounded up as long as the counts
last, in the order of their size; what remains is put best-fit, the longest first, on the histogram too.

The histogram has as many entries as a sequence has tokens, whatever the number of documents. In Spark remain the
encoding, the numbering of pieces of equal length, and finding the place of each number in the plan.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.byte_tokens import byte_encoder
from portolan.llm.shared import filled, mapped, stored
from portolan.llm.tokens import id_type, load

LENGTH = 2048
#: Rounds of the multiplicative weights; how strongly a length that lags behind gains in a round; the exponent of the first prices, by which longer pieces count for a little more.
ROUNDS, STEP, EXPONENT = 40, 0.02, 1.02
#: Configurations whose value is less than the best one's by more than this share are not used.
TOLERANCE = 0.002
#: Of what a round should use of a length as a filler, at most this many times as much.
SURPLUS = 1.5


def priced(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Per capacity up to ``capacity``: the value of the best multiset of lengths and the length added last (0: none); ties go to the longest."""
    lengths = np.flatnonzero(prices > 0)
    falling, best, last = lengths[::-1], np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    values = prices[falling]
    for c in range(int(lengths.min(initial=capacity + 1)), capacity + 1):
        fit = len(lengths) - np.searchsorted(lengths, c, side="right")
        sums = values[fit:] + best[c - falling[fit:]]
        k = int(sums.argmax())
        best[c] = best[c - 1]
        if sums[k] > best[c]:
            best[c], last[c] = sums[k], falling[fit + k]
    return best, last


def _best_with_each(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Of the most valuable configuration with each of ``lengths``, those near the best: a row of lengths each, filled up with 0."""
    best, last = priced(prices, capacity)
    filled_to = np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0))
    value = prices[lengths] + best[capacity - lengths]
    own = lengths[value >= (1 - TOLERANCE) * value.max()]
    rest, columns = filled_to[capacity - own], [own]
    while last[rest].any():
        columns.append(last[rest])
        rest = filled_to[rest - last[rest]]
    return np.stack(columns, axis=1)


def fractional(counts: np.ndarray, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Configurations (lengths, falling) and how often each is used; together they use no more than ``counts`` (by length)."""
    capacity, left, used = len(counts) - 1, counts.astype(float), defaultdict(float)
    lengths = np.flatnonzero(counts)
    prices = np.zeros(capacity + 1)
    prices[lengths] = (lengths / capacity) ** EXPONENT
    for round_ in range(rounds):
        configs = _best_with_each(lengths, prices, capacity)
        share = left / (rounds - round_)
        amount = share[configs[:, 0]]

        def thinned(amount: np.ndarray, limit: np.ndarray) -> np.ndarray:
            use = np.zeros(capacity + 1)
            np.add.at(use, configs, amount[:, None])  # noqa: B023
            factor = np.where(use > limit, limit / np.maximum(use, 1e-300), 1.0)
            factor[0] = 1.0
            return amount * factor[configs].min(axis=1)  # noqa: B023

        for _ in range(3):
            amount = thinned(amount, SURPLUS * share)
        amount = thinned(amount, left)
        np.subtract.at(left, configs, amount[:, None])
        left[0] = 0
        left = np.maximum(left, 0)
        for config, a in zip(configs.tolist(), amount.tolist(), strict=True):
            if a > 0:
                used[tuple(sorted((x for x in config if x), reverse=True))] += a
        behind = left[lengths] / counts[lengths]
        prices[lengths] *= np.exp(STEP * (behind - behind.mean()))
    return used


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Configurations of a best-fit packing of ``counts`` (by length), the longest first, equal bins together."""
    by_free: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        m = counts[length]
        while m:
            free = min((f for f, bins in by_free.items() if f >= length and bins), default=None)
            if free is None:
                times = capacity // length
                whole, some = divmod(m, times)
                for k, n in ((times, whole), (some, 1 if some else 0)):
                    if n:
                        by_free[capacity - k * length][(length,) * k] += n
                break
            config, n = next(iter(by_free[free].items()))
            times = min(free // length, m)
            n = min(n, m // times)
            by_free[free][config] -= n
            if not by_free[free][config]:
                del by_free[free][config]
            by_free[free - times * length][config + (length,) * times] += n
            m -= n * times
    out = Counter()
    for bins in by_free.values():
        out.update({c: n for c, n in bins.items() if n})
    return out


def plan(counts: np.ndarray) -> Counter:
    """How often each configuration is used so that ``counts`` (by length from 0 to the capacity) are packed exactly."""
    capacity, left, out = len(counts) - 1, counts.astype(np.int64).copy(), Counter()
    if left[capacity]:  # these fill a sequence alone
        out[(capacity,)] += int(left[capacity])
        left[capacity] = 0
    if left.any():
        for config, share in sorted(fractional(left).items(), key=lambda x: (-x[1], x[0])):
            need = Counter(config)
            times = min(int(np.ceil(share)), *(int(left[x]) // k for x, k in need.items()))
            if times > 0:
                out[config] += times
                for x, k in need.items():
                    left[x] -= k * times
    out.update(best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, capacity))
    return out


def places(configs: Counter, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: key (length and first number), first sequence, pieces in a sequence, first offset."""
    rows, sequence, numbered = [], 0, Counter()
    for config, times in sorted(configs.items(), reverse=True):
        offset = 0
        for length, k in sorted(Counter(config).items(), reverse=True):
            rows.append((length, numbered[length], sequence, k, offset))
            numbered[length] += times * k
            offset += length * k
        sequence += times
    rows.sort()
    length, first, sequences, k, offsets = (np.asarray(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, dtype=np.int64),) * 5
    return {"length": length, "first": first, "sequence": sequences, "k": k, "offset": offsets}


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Documents of over ``length`` ids are cut into pieces of
    that length, the first one may be shorter; others stay whole. Sequences hold at most ``length`` ids, gapless from 0. Rows that repeat an
    id are packed each. Other columns are ignored; an empty table gives no pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    width = id_type(max(load(tokenizer_path).get_vocab_size(), end_id + 1))

    def encode(batches):
        encoder, numbered, part = byte_encoder(tokenizer_path), Counter(), TaskContext.get().partitionId()
        end = np.asarray([end_id], dtype=width).tobytes()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("part", "number", "doc_id", "piece", "start", "length", "ids")}
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text").to_pylist()), strict=True):
                ids = np.append(np.frombuffer(data, dtype=encoder.kind).astype(width), np.frombuffer(end, dtype=width))
                edges = [0, *range(len(ids) % length or length, len(ids), length), len(ids)]
                for piece, (start, stop) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    for name, value in zip(out, (part, numbered[stop - start], doc_id, piece, start, stop - start, ids[start:stop].tobytes()), strict=True):
                        out[name].append(value)
                    numbered[stop - start] += 1
            yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), filled(text_col).alias("text"))
    pieces = stored(mapped(rows, encode, f"part int, number bigint, doc_id {kind}, piece int, start bigint, length bigint, ids binary", "byte pieces"), "pieces")
    sizes = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "sizes")
    counts = np.zeros(length + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most a row per length
        counts[r.length] = r.n
    where = docs.sparkSession.sparkContext.broadcast(places(plan(counts), length))  # at most ROUNDS configurations per length, besides those of best fit
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    bases = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        table = where.value
        keys = table["length"] << 48 | table["first"]
        for batch in batches:
            own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number", "base")}
            number = own["number"] + own["base"]
            at = np.searchsorted(keys, own["length"] << 48 | number, side="right") - 1
            nth = number - table["first"][at]
            ids = [np.frombuffer(x, dtype=width).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
            yield {c: batch.column(c) for c in ("doc_id", "piece", "start", "length")} | {"ids": ids, "sequence_id": table["sequence"][at] + nth // table["k"][at], "offset": table["offset"][at] + nth % table["k"][at] * own["length"]}

    numbered = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids", "number", "base")
    return mapped(numbered, place, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint")
