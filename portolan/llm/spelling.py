"""Operator 11: spelling variants of a corpus by a bit-sliced position index.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Let m be
the length of the shorter one: either their first m // 2 code points agree or their last m - m // 2.
Each word is therefore entered under four keys (first or last part, as the shorter and as the longer
word), and near words meet under exactly one key at which they are compared.

The words of some keys form a block. Its index has, per position and letter, one bitset over the words
of the block that have this letter there. All words of the block are looked up at once: letter by letter,
a set of words without an error so far and sets with one error (replaced, or positions shifted up or down
by one) are carried on by bitwise operations. The bits that are left in the end are the near words; since
the words lie in the order of their counts, the first bit is the most frequent one. No pairs are listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.shared import filled, mapped, stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10
#: Words of a block: keys are put together up to TARGET; a key with more than TILE is dealt over square tiles. Long words count for more: a block has at most about LETTERS.
TARGET, TILE, LETTERS = 768, 8_192, 2_000_000
#: Words looked up at once in a block.
LOOKUPS = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, spelled: Callable[[Column, Column], Column] | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and its number of occurrences ``n``, of the maximal runs of Latin letters (to U+00FF) of all texts.

    A-Z count as lower case. ``spelled(doc_id, run)`` may give each occurrence another spelling, not a longer one. Words of
    fewer than ``least_length`` code points or ``least_count`` occurrences are left out. Null texts have no words;
    repeated rows count each; an empty table gives an empty table.
    """
    runs = F.expr(rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\u00C0-\\u00FF]+', 0)")
    rows = docs.select(F.col(id_col).alias("doc_id"), filled(text_col).alias("text"))
    rows = rows.select("doc_id", F.explode(runs).alias("run")).filter(F.length("run") >= least_length)
    word = spelled(F.col("doc_id"), F.col("run")) if spelled else F.col("run")
    rows = rows.select(word.alias("word")).filter(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def part(word: str, m: int, last: int) -> str:
    """The part of a word that it shares with near words under its key for the shorter length ``m``."""
    return word[len(word) - (m - m // 2) :] if last else word[: m // 2]


def _entries(words: DataFrame, tile: int) -> DataFrame:
    """The four entries of each word: m, key, low, high (tile of a key with many words), own (its share), last, word, n."""
    length = F.length("word")
    kinds = F.array(*(F.struct((length - k).alias("m"), F.lit(last).alias("last")) for k in (0, 1) for last in (0, 1)))
    rows = words.select("word", "n", F.explode(kinds).alias("kind")).select("word", "n", "kind.m", "kind.last").filter("m > 0")
    shared = F.expr("if(last = 1, substr(word, length(word) - (m - m div 2) + 1), substr(word, 1, m div 2))")
    rows = rows.withColumn("key", F.xxhash64("m", "last", shared))
    most = F.greatest(F.lit(2), F.least(F.lit(tile), F.floor(LETTERS / F.col("m"))))
    shares = F.ceil(F.col("size") / most).cast("int")
    large = rows.groupBy("key").agg(F.count("*").alias("size"), F.max("m").alias("m")).select("key", shares.alias("shares")).filter("shares > 1")
    rows = rows.join(large, "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("shares")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return rows.select("m", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "last", "word", "n")


def _bitsets(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    width = -flags.shape[1] % 64
    return np.packbits(np.pad(flags, ((0, 0), (0, width))), axis=1, bitorder="little").view("<u8")


def near_sets(words: list[str], last: np.ndarray, masks: np.ndarray, mask_of: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, bitsets) of the words of a block: for each word the bitset of its near words.

    All words have m or m + 1 code points; those of m + 1 are only compared with those of m. ``masks`` are the
    bitsets of words that may be compared, ``mask_of`` the one of each word. Words entered by their ``last`` part
    leave out those whose first part agrees too: these meet there.
    """
    lengths = np.asarray([len(w) for w in words])
    codes = np.zeros((len(words), m + 2), dtype=np.uint32)  # 0 stands behind the end and fits no letter
    codes[:, : m + 1] = np.frombuffer("".join(w.ljust(m + 1, "\0") for w in words).encode("utf-32-le"), dtype="<u4").reshape(-1, m + 1)
    short, long = _bitsets(lengths[None, :] == m), _bitsets(lengths[None, :] == m + 1)
    index, at = [], np.empty((len(words), m + 2), dtype=np.int64)
    for p in range(m + 2):
        letters, at[:, p] = np.unique(codes[:, p], return_inverse=True)
        index.append((letters, _bitsets((codes[:, p][None, :] == letters[:, None]) & (letters[:, None] > 0))))

    def having(p: int, letter: np.ndarray) -> np.ndarray:
        """Per word looked up: the words that have its ``letter`` at position ``p``."""
        letters, bits = index[p]
        row = np.minimum(np.searchsorted(letters, letter), len(letters) - 1)
        return np.where((letters[row] == letter)[:, None], bits[row], np.uint64(0))

    for wanted in (m, m + 1):
        rows = np.flatnonzero(lengths == wanted)
        for rows in np.array_split(rows, -(-len(rows) // LOOKUPS)) if len(rows) else ():
            clean = masks[mask_of[rows]] & (short | long if wanted == m else short)
            replaced, shifted = np.zeros_like(clean), np.zeros_like(clean)
            tail = last[rows][:, None]
            for i in range(wanted):
                if i == m // 2:
                    shifted = np.where(tail, shifted & ~clean, shifted)
                    clean = np.where(tail, clean & short if wanted == m else np.uint64(0), clean)
                letter = codes[rows, i]
                here = index[i][1][at[rows, i]]
                if wanted == m:  # the other word may be as long, or have one letter more
                    shifted = (shifted | clean) & having(i + 1, letter)
                    replaced = replaced & here | clean & ~here
                else:  # the other word may have one letter less
                    shifted = (shifted & having(i - 1, letter) if i else shifted) | clean
                clean = clean & here
            yield rows, (replaced & short | (shifted | clean) & long) if wanted == m else shifted & short


def _block(entries: list[tuple], m: int) -> dict:
    """For the entries (unit, own, across, last, word, n) of a block: word, near (how many), best (the first by count) and its count.

    A unit is a key or a tile of one; ``across`` says that only words of different shares are compared there.
    """
    entries.sort(key=lambda e: (-e[5], e[4]))
    words, n = [e[4] for e in entries], np.asarray([e[5] for e in entries])
    member = [(unit, last, part(word, m, last), own if across else 0) for unit, own, across, last, word, _ in entries]
    sides: dict[tuple, int] = {}
    side = np.asarray([sides.setdefault(x, len(sides)) for x in member])
    masks = _bitsets(side[None, :] == np.arange(len(sides))[:, None])
    if any(e[2] for e in entries):  # tiles: compared with the other share of the same key
        across = {x for x, e in zip(member, entries, strict=True) if e[2]}
        others = {x: [sides[y] for y in across if y[:3] == x[:3] and y != x] if x in across else [sides[x]] for x in sides}
        masks = np.stack([np.bitwise_or.reduce(masks[others[x]], axis=0) if others[x] else np.zeros_like(masks[0]) for x in sides])
    out: dict[str, list] = {"word": [], "near": [], "best": [], "best_n": []}
    for rows, bits in near_sets(words, np.asarray([bool(e[3]) for e in entries]), masks, side, m):
        near = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        found = np.flatnonzero(near)
        if len(found):
            bits = bits[found]
            lane = (bits != 0).argmax(axis=1)
            lowest = bits[np.arange(len(found)), lane]
            best = lane * 64 + np.bitwise_count((lowest & (~lowest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            out["word"] += [words[r] for r in rows[found]]
            out["near"] += near[found].tolist()
            out["best"] += [words[b] for b in best]
            out["best_n"] += n[best].tolist()
    return out


def _near(entries: DataFrame, target: int) -> DataFrame:
    """word, near, best, best_n: what the blocks found; the near words of a word add up over its rows."""
    key = ["m", "key", "low", "high"]
    rows = entries.repartition("key", "low", "high").sortWithinPartitions(*key)

    def run(batches):
        at, unit, held = None, 0, []
        for batch in batches:
            for m, group, low, high, own, last, word, n in zip(*(batch.column(c).to_pylist() for c in (*key, "own", "last", "word", "n")), strict=True):
                if at != (m, group, low, high):
                    if held and (at[0] != m or len(held) >= target or len(held) * m >= LETTERS // 4):
                        yield _block(held, at[0])
                        held = []
                    at, unit = (m, group, low, high), unit + 1
                held.append((unit, own, low != high, last, word, n))
        if held:
            yield _block(held, at[0])

    return mapped(rows.select(*key, "own", "last", "word", "n"), run, "word string, near bigint, best string, best_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word that forms lead to. Counts rise along forms, so paths are short and end; each round doubles the step."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, ratio: int = FORM_RATIO, target: int = TARGET, tile: int = TILE) -> DataFrame:
    """One row per row of ``words`` (distinct ``word``, count ``n``): word, form, root, n, n_near, form_n.

    ``n_near`` words differ by exactly one inserted, deleted or replaced code point. ``form`` is the one with the largest
    count (ties: smallest in code-point order) if that is at least ``ratio`` (over 1) times the word's; ``root`` is where forms lead to in
    the end, the word itself if it has none. Words of any length are compared to their last letter; rows with a null word or count, and
    empty words, are left out; an empty table gives an empty table. Other columns are ignored.
    """
    words = stored(words.filter("word <> '' and n is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    found = _near(_entries(words, tile), target)
    none = F.lit(None)
    both = words.select("word", "n", none.cast("long").alias("near"), none.cast("string").alias("best"), none.cast("long").alias("best_n"))
    both = both.unionByName(found.select("word", none.cast("long").alias("n"), "near", "best", "best_n"))
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), "best")))
    merged = both.groupBy("word").agg(F.max("n").alias("n"), F.coalesce(F.sum("near"), F.lit(0)).alias("n_near"), first.alias("first"))
    frequent = -F.col("first.n") >= ratio * F.col("n")
    merged = merged.select("word", "n", "n_near", F.when(frequent, F.col("first.best")).alias("form"), F.when(frequent, -F.col("first.n")).alias("form_n"))
    merged = stored(merged, "variants")
    roots = _roots(merged.filter("form is not null"))
    return merged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
