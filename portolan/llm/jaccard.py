"""Operator 9: documents whose sets of word n-grams are similar, by a prefix join in blocks of n-grams.

It stands in for a blocked sparse product: the incidence of documents and n-grams is never multiplied out, and no overlap counts are added up. Two sets can only reach the
wanted similarity if they share one of the first few n-grams of each, in any fixed order; how
many follows from the size, and where it stands in both bounds what else they share. These entries are dealt into blocks of n-grams. The documents of
one n-gram are first compared with one of them only, which joins large groups of near copies
in a linear number of comparisons. Then only n-grams whose documents are still in different
groups are multiplied out, inside a task, and a pair leaves the task only when its sizes and
bit signatures leave the similarity possible. Every pair that is left is counted exactly.

Frequent n-grams come last in the order. Which ones are frequent is measured over all texts;
the table kept for it is bounded, and what it holds changes the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.components import components
from portolan.llm.shared import MEMOS, filled, mapped, stored

WORDS = 5
PERCENT = 75
#: n-grams counted as frequent: at least this often in one run of buffered n-grams, and at most so many kept.
FREQUENT_COUNT, FREQUENT_KEPT, COUNT_BUFFER = 4, 100_000, 1_000_000
ENTRIES_PER_BLOCK, LEAST_BLOCKS, ENTRIES_PER_FLUSH = 200_000, 64, 250_000
LIST_SALT = 50_000
LIST_BLOCK = 2_048
#: Rounds of comparisons with one set per list before what is still apart is multiplied out.
STAR_ROUNDS = 2
MEMBERS_PER_SALT = 500
#: Words whose hashes a task remembers, and sets it knows to have seen.
WORD_MEMO = 150_000
#: Pairs a task holds before it hands them on.
PAIRS_PER_FLUSH = 50_000
LEAST_BITS = 2_048
#: n-gram, set, size of the set, and how many of its n-grams come from here on in the order, this one with them.
ENTRY = np.dtype([("gram", "<u8"), ("set", "<u8"), ("n", "<u4"), ("rest", "<u4")])
_MULTIPLIERS = np.random.default_rng(75).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word):
        value = xxhash.xxh64_intdigest(word)
        if len(self) < WORD_MEMO:
            self[word] = value
        return value


_HASHES = MEMOS.setdefault("word hashes", _WordHashes())


def gram_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of a text; of all its words when they are fewer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not parts:
        return np.empty(0, dtype=np.uint64)
    if len(parts) < words:
        return np.asarray([xxhash.xxh64_intdigest(b"\n".join(parts), seed=len(parts))], dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = len(parts) - words + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        out += hashes[k : k + n] * _MULTIPLIERS[k]
    out ^= out >> np.uint64(29)
    out *= _MULTIPLIERS[-1]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    """Bits set by the low bits of the n-grams: a power of two of bits, four or more per n-gram, as 64-bit words.

    Small sets, which often share a passage and little else, have the most bits per n-gram; these compress well.
    """
    bits = max(LEAST_BITS, 1 << int(4 * len(grams) - 1).bit_length())
    flags = np.zeros(bits, dtype=np.uint8)
    flags[grams & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures (last axis) of a smaller width; a bit is set if one of those laid over it is."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def possible(n_a, bits_a: np.ndarray, n_b, bits_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the similarity can reach ``percent``: a bit set on one side only is an n-gram the other lacks."""
    words = min(bits_a.shape[-1], bits_b.shape[-1])
    a, b = folded(bits_a, words), folded(bits_b, words)
    most = np.minimum(n_a - np.bitwise_count(a & ~b).sum(-1).astype(np.int64), n_b - np.bitwise_count(b & ~a).sum(-1).astype(np.int64))
    return 100 * most >= percent * (n_a + n_b - most)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signed(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, row_key, n, fp_a, fp_b, bits per document; frequent n-grams as rows with n = -1, fp_a the n-gram, fp_b its count."""
    kind = docs.schema[id_col].dataType.simpleString()

    def frequent(buffer):
        grams, counts = np.unique(np.concatenate(buffer), return_counts=True)
        grams, counts = grams[counts >= FREQUENT_COUNT], counts[counts >= FREQUENT_COUNT]
        none = [None] * len(grams)
        return {"doc_id": none, "row_key": none, "n": np.full(len(grams), -1), "fp_a": _signed(grams), "fp_b": counts, "bits": none}

    def run(batches):
        buffer, size = [], 0
        for batch in batches:
            out = {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "n": [], "fp_a": [], "fp_b": [], "bits": []}
            for text in batch.column("text").to_pylist():
                grams = gram_set(text, words)
                whole = xxhash.xxh3_128_intdigest(grams.tobytes())
                out["n"].append(len(grams))
                out["fp_a"].append(np.uint64(whole >> 64).view(np.int64))
                out["fp_b"].append(np.uint64(whole & (1 << 64) - 1).view(np.int64))
                out["bits"].append(signature(grams).tobytes() if len(grams) else b"")
                buffer.append(grams)
                size += len(grams)
                if size > COUNT_BUFFER:
                    yield frequent(buffer)
                    buffer, size = [], 0
            yield out
        if buffer:
            yield frequent(buffer)

    return mapped(_texts(docs, id_col, text_col), run, f"doc_id {kind}, row_key bigint, n bigint, fp_a bigint, fp_b bigint, bits binary", "word hashes")


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), filled(text_col))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), filled(text_col).alias("text"))


def _salts(grams: np.ndarray, grams_f: np.ndarray, counts_f: np.ndarray) -> np.ndarray:
    """Over how many blocks the sets of each n-gram are dealt; counts are of rows, copies with them."""
    if not len(grams_f):
        return np.ones(len(grams), dtype=np.uint64)
    at = np.minimum(np.searchsorted(grams_f, grams), len(grams_f) - 1)
    return np.where(grams_f[at] == grams, 1 + counts_f[at] // LIST_SALT, 1).astype(np.uint64)


def _blocks(texts: DataFrame, words: int, percent: int, blocks: int, frequent) -> DataFrame:
    """(block, entries): the prefix entries of all documents, packed by block of n-grams.

    ``frequent`` is a broadcast pair: frequent n-grams, rising, and their counts.
    """

    def prefix(grams: np.ndarray) -> np.ndarray:
        grams_f, counts_f = frequent.value
        size = prefix_size(len(grams), percent)
        if not len(grams_f):
            return grams[:size]
        at = np.minimum(np.searchsorted(grams_f, grams), len(grams_f) - 1)
        known = grams_f[at] == grams
        rare = grams[~known]
        if len(rare) >= size:
            return rare[:size]
        common = grams[known][np.argsort(counts_f[at[known]], kind="stable")]
        return np.concatenate([rare, common[: size - len(rare)]])

    def packed(rows):
        grams_f, counts_f = frequent.value
        entries = np.concatenate(rows)
        block = entries["gram"] >> np.uint64(20)
        if len(grams_f):  # the documents of a very frequent n-gram are dealt over several blocks
            block = block + entries["set"] % _salts(entries["gram"], grams_f, counts_f)
        block = (block % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        block, entries = block[order], entries[order]
        ends = np.flatnonzero(np.diff(block, append=-1)) + 1
        return {"block": block[ends - 1], "entries": [entries[s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends, strict=True)]}

    def run(batches):
        rows, size, seen = [], 0, set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                grams = gram_set(text, words)
                if not len(grams):
                    continue
                whole = xxhash.xxh3_128_intdigest(grams.tobytes()) >> 64
                if whole in seen:  # an equal set has the same entries
                    continue
                if len(seen) > WORD_MEMO:
                    seen.clear()
                seen.add(whole)
                chosen = prefix(grams)
                entry = np.empty(len(chosen), dtype=ENTRY)
                entry["gram"], entry["set"], entry["n"] = chosen, whole, len(grams)
                entry["rest"] = len(grams) - np.arange(len(chosen))
                rows.append(entry)
                size += len(entry)
                if size > ENTRIES_PER_FLUSH:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    return mapped(texts.select("text"), run, "block bigint, entries binary", "word hashes")


def _lists(blocks: DataFrame, frequent) -> DataFrame:
    """Per n-gram of a block with two or more sets: its first set ``a`` with each set ``b``: sizes n_a, n; rest_a, rest as in ENTRY; more (over two sets).

    A set that is alone in its block stays too if the n-gram is dealt over several: its others are in those.
    """

    def multiply(parts: list[bytes]):
        entries = np.unique(np.frombuffer(b"".join(parts), dtype=ENTRY))
        gram = entries["gram"]
        first = np.flatnonzero(np.diff(gram, prepend=gram[0] ^ np.uint64(1)))
        sizes = np.diff(first, append=len(gram))
        wanted = (sizes > 1) | (_salts(gram[first], *frequent.value) > 1)
        entries, sizes = entries[np.repeat(wanted, sizes)], sizes[wanted]
        if not len(entries):
            return None
        order = np.lexsort((entries["set"] * _MULTIPLIERS[0], entries["gram"]))  # the first set of a list: as if by lot, yet the same in all lists
        entries = entries[order]
        leader = np.repeat(np.cumsum(sizes) - sizes, sizes)
        return {"gram": _signed(entries["gram"]), "a": _signed(entries["set"][leader]), "b": _signed(entries["set"]), "n_a": entries["n"][leader].astype(np.int64), "n": entries["n"].astype(np.int64), "rest_a": entries["rest"][leader].astype(np.int64), "rest": entries["rest"].astype(np.int64), "more": np.repeat(sizes > 2, sizes)}

    def run(batches):
        block, parts = None, []
        for batch in batches:
            for at, data in zip(batch.column("block").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if at != block and parts:
                    if (out := multiply(parts)) is not None:
                        yield out
                    parts = []
                block = at
                parts.append(data)
        if parts and (out := multiply(parts)) is not None:
            yield out

    ordered = blocks.repartition("block").sortWithinPartitions("block")
    return mapped(ordered, run, "gram bigint, a bigint, b bigint, n_a bigint, n bigint, rest_a bigint, rest bigint, more boolean")


def _possible_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and signatures leave possible."""
    side = lambda x: sets.select(F.col("fp_a").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def run(batches):
        for batch in batches:
            out = {"a": [], "b": []}
            for a, b, n_a, n_b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "bits_a", "bits_b")), strict=True):
                if possible(n_a, np.frombuffer(x, "<u8"), n_b, np.frombuffer(y, "<u8"), percent):
                    out["a"].append(a)
                    out["b"].append(b)
            yield out

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    joined = joined.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return mapped(joined.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), run, "a bigint, b bigint")


def _links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose n-gram sets reach the similarity, counted on the texts.

    The texts of all ``b`` of one ``a`` follow the text of ``a``; where they are many they are dealt over several tasks.
    """
    salts = F.ceil(F.col("size") / MEMBERS_PER_SALT).cast("int")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size"))
    leaders = sizes.select("a", F.col("a").alias("set"), F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    others = pairs.join(sizes, "a").select("a", F.col("b").alias("set"), F.lit(1).alias("role"), F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    wanted = leaders.unionByName(others).join(sets.select(F.col("fp_a").alias("set"), "row_key"), "set")
    rows = texts.select("row_key", "text").join(wanted, "row_key").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def count(batches):
        at, first = None, None
        for batch in batches:
            out = {"a": [], "b": []}
            for a, member, role, salt, text in zip(*(batch.column(c).to_pylist() for c in ("a", "set", "role", "salt", "text")), strict=True):
                grams = gram_set(text, words)
                if role == 0:
                    at, first = (a, salt), grams
                elif at == (a, salt):
                    both = len(np.intersect1d(first, grams, assume_unique=True))
                    if 100 * both >= percent * (len(first) + len(grams) - both):
                        out["a"].append(a)
                        out["b"].append(member)
            yield out

    return mapped(rows.select("a", "set", "role", "salt", "text"), count, "a bigint, b bigint", "word hashes").distinct()


def _other_stars(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of one set of each list with those of its other sets that are in another component.

    The set is drawn anew in each list and turn: near copies of which few resemble one of them soon meet another.
    ``lists``: gram, set, n, rest, component.
    """
    drawn = lists.groupBy("gram").agg(F.min(F.struct(F.xxhash64("gram", "set", F.lit(turn)), "set", "n", "rest", "component")).alias("star"))
    pairs = lists.join(drawn, "gram").filter("component <> star.component")
    shared = F.least("rest", "star.rest")
    pairs = pairs.filter(shared * 100 >= (F.col("n") + F.col("star.n") - shared) * percent)
    return pairs.select(F.least("set", "star.set").alias("a"), F.greatest("set", "star.set").alias("b")).distinct()


def _across(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Possible pairs (a, b) of sets of one n-gram that are in different components, each pair once.

    ``lists``: gram, set, rest, component. A list is multiplied out in square blocks of at most LIST_BLOCK by
    LIST_BLOCK sets, so that no task holds more of it.
    """
    sizes = lists.groupBy("gram").agg(F.count("*").alias("size"))
    salts = F.ceil(F.col("size") / LIST_BLOCK).cast("int")
    rows = lists.join(sizes, "gram").withColumn("salts", salts).withColumn("own", F.pmod(F.xxhash64("set"), F.col("salts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    rows = rows.join(sets.select(F.col("fp_a").alias("set"), "n", "bits"), "set")
    key = ["gram", "low", "high"]
    rows = rows.select(*key, "set", "own", "component", "n", "rest", "bits").repartition(*key).sortWithinPartitions(*key, "n")

    def multiply(group: list[tuple], high_only: bool) -> Iterator[tuple[int, int]]:
        members, own, component, n, rest, bits = zip(*group, strict=True)
        n, rest, component, own = np.asarray(n), np.asarray(rest), np.asarray(component), np.asarray(own)
        widths = np.asarray([len(b) // 8 for b in bits])
        stacks = {w: (np.flatnonzero(widths == w), np.frombuffer(b"".join(b for b in bits if len(b) == 8 * w), "<u8").reshape(-1, w)) for w in set(widths.tolist())}
        for i in range(len(group) - 1):
            mine = np.frombuffer(bits[i], "<u8")
            for w in sorted({widths[i], 2 * widths[i]}):  # a partner is at most a third larger, so its signature is as wide or twice as wide
                where, stack = stacks.get(int(w), (np.empty(0, int), None))
                lo, hi = np.searchsorted(where, i + 1), np.searchsorted(where, np.searchsorted(n, n[i] * 100 // percent, "right"))
                if lo >= hi:
                    continue
                near = where[lo:hi]
                shared = np.minimum(rest[near], rest[i])
                good = (component[near] != component[i]) & (100 * shared >= percent * (n[near] + n[i] - shared))
                if high_only:
                    good &= own[near] != own[i]
                if good.any():
                    good[good] = possible(n[i], mine, n[near][good], stack[lo:hi][good], percent)
                    for j in near[good]:
                        yield min(members[i], members[j]), max(members[i], members[j])

    def run(batches):
        at, group, out = None, [], set()

        def flushed():
            if out:
                yield {"a": [p[0] for p in out], "b": [p[1] for p in out]}
                out.clear()

        def blocks():
            nonlocal at, group
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in (*key, "set", "own", "component", "n", "rest", "bits"))
                for gram, low, high, *member in zip(*columns, strict=True):
                    if at != (gram, low, high):
                        if len(group) > 1:
                            yield at, group
                        at, group = (gram, low, high), []
                    group.append(tuple(member))
            if len(group) > 1:
                yield at, group

        for (_, low, high), members in blocks():
            for pair in multiply(members, low != high):
                out.add(pair)
                if len(out) >= PAIRS_PER_FLUSH:
                    yield from flushed()
        yield from flushed()

    return mapped(rows, run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, row_key (a hash of id and text).

    Words are runs of anything but ASCII white space, A-Z in lower case. A document with fewer than
    ``words`` words has its whole sequence as its only n-gram; one without words, or with a null text, has
    none and is linked with nothing. Documents link when 100 * shared >= ``percent`` * union; ``component_id``
    is the smallest id reachable. Null ids are linked like others but never name a component unless it holds
    no other id. Rows that repeat an id or a text are in one component. Other columns are ignored; an empty
    table gives an empty table. n-grams are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    found = stored(_sets(docs, id_col, text_col, words), "sets")
    rows = found.filter("n >= 0")
    top = found.filter("n = -1").groupBy("fp_a").agg(F.sum("fp_b").alias("count")).orderBy(F.desc("count"), "fp_a").limit(FREQUENT_KEPT).toPandas()
    grams = top["fp_a"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(grams)
    frequent = spark.sparkContext.broadcast((grams[order], top["count"].to_numpy(dtype=np.int64)[order]))

    stays = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("stays")
    sets = rows.filter("n > 0").groupBy("fp_a", "fp_b", "n").agg(stays, F.max("bits").alias("bits"))
    sets = stored(sets.select("fp_a", "n", F.col("stays.doc_id").alias("doc_id"), F.col("stays.row_key").alias("row_key"), "bits"), "classes")
    entries = sets.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    blocks = max(LEAST_BLOCKS, int(entries) // ENTRIES_PER_BLOCK)

    texts = _texts(docs, id_col, text_col)
    lists = stored(_lists(_blocks(texts, words, percent, blocks, frequent), frequent), "lists")
    # If this is the first n-gram of both in the order, they share no more than what comes from here on; else an earlier list has the pair.
    shared = F.least("rest_a", "rest")
    fits = shared * 100 >= (F.col("n_a") + F.col("n") - shared) * percent
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    stars = lists.filter(fits & (F.col("a") != F.col("b"))).select(low, high)
    # a very frequent n-gram has a first set in each of its blocks: compare these too
    heads = lists.groupBy("gram").agg(F.min("a").alias("head"), F.max("a").alias("last")).filter("head <> last")
    heads = lists.filter("a = b").join(heads, "gram").filter("a <> head").select(F.least("head", "a").alias("a"), F.greatest("head", "a").alias("b"))
    tested = stored(_possible_pairs(stars.union(heads).distinct(), sets, percent), "pairs")
    links = stored(_links(tested, sets, texts, words, percent), "links")
    groups = components(links)

    whole = lists.groupBy("gram").agg(F.max("more").alias("more"), F.min("a").alias("head"), F.max("a").alias("last")).filter("more or head <> last").select("gram")
    whole = stored(lists.select("gram", F.col("b").alias("set"), "n", "rest").join(whole, "gram", "left_semi"), "long-lists")
    for turn in range(STAR_ROUNDS + 1):
        members = whole.join(groups, whole["set"] == groups["id"], "left").select("gram", "set", "n", "rest", F.coalesce("component", "set").alias("component"))
        members = stored(members, "members")
        mixed = members.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("gram")
        members = members.join(mixed, "gram", "left_semi")
        if turn < STAR_ROUNDS:
            more = _possible_pairs(_other_stars(members, turn, percent).join(tested, ["a", "b"], "left_anti"), sets, percent)
        else:
            more = _across(members.drop("n"), sets, percent).join(tested, ["a", "b"], "left_anti")
        more = stored(more, "pairs")
        if not more.isEmpty():
            tested = tested.unionByName(more)
            links = links.unionByName(stored(_links(more, sets, texts, words, percent), "links"))
            groups = components(links)

    named = sets.join(groups, sets["fp_a"] == groups["id"], "left").select("fp_a", "n", "doc_id", F.coalesce("component", "fp_a").alias("component"))
    named = stored(named, "named")
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(lowest, "component").select(F.col("fp_a"), "component_id")
    return rows.join(named, "fp_a", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_key")
