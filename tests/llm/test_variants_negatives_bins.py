"""Spelling variants, hard negatives and packing by the configuration program against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from portolan.llm import bestfit, byte_tokens, negatives, queries, spelling

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _near(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(words: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    near = {w: [(-k, v) for v, k in words.items() if v != w and _near(w, v)] for w in words}
    form = {w: min(x) if x and -min(x)[0] >= ratio * words[w] else (None, None) for w, x in near.items()}

    def root(w):
        while form[w][1]:
            w = form[w][1]
        return w

    return {w: (form[w][1], root(w), n, len(near[w]), -form[w][0] if form[w][1] else None) for w, n in words.items()}


def _words() -> dict[str, int]:
    draw = random.Random(1)
    words = {"".join(draw.choice("abéÿ") for _ in range(draw.randrange(1, 9))): draw.choice([1, 2, 3, 5, 20, 30, 200, 3000]) for _ in range(700)}
    return words | {"x" * 3000: 3, "x" * 3001: 100, "x" * 1500 + "y" + "x" * 1499: 2, "\U0001f600ab": 4, "\U0001f600a": 40}


@pytest.mark.parametrize(("target", "tile"), [(spelling.TARGET, spelling.TILE), (16, spelling.TILE), (64, 40)])
def test_spelling_variants(spark, target, tile):
    words = _words()
    rows = spark.createDataFrame([*words.items(), (None, 3), ("", 5), ("nocount", None)], "word string, n bigint").withColumn("m", F.lit("clash"))
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(rows, target=target, tile=tile).collect()}
    assert got == _variants(words)


def test_spelling_follows_forms_to_the_last(spark):
    chain = {"abcdefg": 2, "abcdefh": 20, "abcdeih": 200, "abcjeih": 2000}
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(spark.createDataFrame(list(chain.items()), "word string, n bigint")).collect()}
    assert got == {"abcdefg": ("abcdefh", "abcjeih"), "abcdefh": ("abcdeih", "abcjeih"), "abcdeih": ("abcjeih", "abcjeih"), "abcjeih": (None, "abcjeih")}
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_word_counts(spark, edge, nothing):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = Counter()
    for r in edge.collect():
        run = ""
        for c in (r.text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.translate(lower)
                continue
            if len(run) >= 4:
                h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
                spelled = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                counts[spelled] += 1
            run = ""
    expected = {w: n for w, n in counts.items() if len(w) >= 4 and n >= 2}
    got = {r.word: r.n for r in spelling.word_counts(edge, queries.one_in_31_short, 4, 2).collect()}
    assert got == expected and got
    assert spelling.word_counts(nothing).count() == 0


def _mined(rows, scale=256):
    whole = [(i, label, np.floor(scale * np.asarray(v, dtype=float)).astype(np.int64)) for i, label, v in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (anchor, label, v) in enumerate(whole):
        if anchor is None or anchor % 10:
            continue
        ranked = sorted(((-int(v @ w), other if other is not None else 1 << 62, j, mine == label) for j, (other, mine, w) in enumerate(whole) if j != k and len(w) == len(v)), key=lambda x: x[:3])
        for minus, positive, *_ in [x for x in ranked if x[3]][:5]:
            fit = [x for x in ranked if not x[3] and 80 * -minus <= 100 * -x[0] <= 100 * -minus][:5]
            out += [(anchor, positive, rank, x[1], -minus, -x[0]) for rank, x in enumerate(fit, 1)]
    return Counter(out)


def _vectors(n: int, dim: int, spread: float) -> list:
    draw = np.random.default_rng(dim)
    centers = draw.standard_normal((5, dim))
    rows = []
    for i in range(n):
        v = centers[i % 5] + spread * draw.standard_normal(dim)
        rows.append((i, int(draw.integers(0, 3)), (v / np.linalg.norm(v)).tolist()))
    return rows


@pytest.mark.parametrize(("n", "dim", "spread", "cell"), [(300, 8, 0.3, 4), (200, 16, 1.0, 2), (60, 1, 0.5, 512)])
def test_hard_negatives(spark, monkeypatch, n, dim, spread, cell):
    monkeypatch.setattr(negatives, "CELL_ROWS", cell)
    monkeypatch.setattr(negatives, "FIRST_CELLS", 2)
    monkeypatch.setattr(negatives, "ANCHORS_PER_TASK", 3)
    rows = _vectors(n, dim, spread)
    rows += [(20, 1, rows[0][2]), (20, 2, rows[0][2]), (1000, None, rows[0][2]), (1001, 1, None), (1002, 1, [float("nan")] * dim), (1003, 1, [None] + [0.0] * (dim - 1)), (1004, 2, []), (1005, 0, rows[1][2] * 2), (1010, 1, [0.0] * dim), (1011, 1, [1e30] * dim)]
    rows += [(5000 + i, i % 3, rows[3][2]) for i in range(40)]  # equal vectors: ties
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(4)
    for name in ("row", "id", "cell", "slot", "score"):
        df = df.withColumn(name, F.lit("clash"))
    got = Counter(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == _mined([r for r in rows if r[0] != 1011])
    assert negatives.hard_negatives(df.filter("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_cells_come_in_the_order_of_their_bounds():
    draw = np.random.default_rng(4)
    one, two = draw.standard_normal(7), draw.standard_normal(9)
    one[2] = -np.inf
    every = list(negatives.visited(one, two, 0, 1000, -np.inf))
    sums = [one[c // 9] + two[c % 9] for c in every]
    assert sorted(every) == [c for c in range(63) if c // 9 != 2] and sums == sorted(sums, reverse=True)
    assert [*negatives.visited(one, two, 0, 20, -np.inf), *negatives.visited(one, two, 20, 100, 0.5)] == [c for k, c in enumerate(every) if k < 20 or sums[k] >= 0.5]


@pytest.mark.parametrize("draw", [lambda r: r.integers(1, 2048, 4000), lambda r: r.integers(600, 760, 20_000), lambda r: np.clip(r.lognormal(6, 1, 9000), 1, 2048).astype(int), lambda r: np.repeat([1024, 1025, 1, 2048], [5, 7, 3, 2])])
def test_plan_packs_every_piece_and_no_worse_than_best_fit(draw):
    counts = np.bincount(draw(np.random.default_rng(0)), minlength=2049)
    configs, plain = bestfit.plan(counts), bestfit.best_fit({int(x): int(counts[x]) for x in np.flatnonzero(counts)}, 2048)
    for packed in (configs, plain):
        back = np.zeros(2049, dtype=int)
        for config, n in packed.items():
            assert 0 < sum(config) <= 2048
            np.add.at(back, list(config), n)
        assert (back == counts).all()
    assert sum(configs.values()) <= 1.001 * sum(plain.values()) + 1


def test_best_fit_on_a_histogram_is_best_fit_piece_by_piece():
    draw = np.random.default_rng(2)
    for _ in range(20):
        lengths = draw.integers(1, 40, 200)
        bins = []
        for x in sorted(lengths, reverse=True):
            fit = [b for b in range(len(bins)) if bins[b] >= x]
            if fit:
                bins[min(fit, key=lambda b: bins[b])] -= x
            else:
                bins.append(64 - x)
        counts = Counter(lengths.tolist())
        assert sum(bestfit.best_fit(counts, 64).values()) == len(bins)


def test_priced_is_the_best_multiset():
    prices = np.zeros(21)
    prices[[3, 5, 7]] = [2.0, 3.7, 5.1]
    best, last = bestfit.priced(prices, 20)
    exact = [max(2.0 * a + 3.7 * b + 5.1 * c for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= room) for room in range(21)]
    assert np.allclose(best, exact) and not last[:3].any()


TEXTS = ["a  b", " a", "a ", "a\n b", "a \n b", "a\n\nb \n", "x  y z", "<|endoftext|> a <|endoftext|>b c<|endoftext|>", "", " ", "  ", "can't won't I'll 12 3.4,5", "é ñ ß \U0001f600 漢字 かな", "\ta\t\tb \tc", "a\x1c b", "a b c", "w" * 500 + " " + "w" * 500]


def test_byte_encoder_gives_the_ids_of_whole_texts():
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choice("ab 'é\n\t.<|>1 ") for _ in range(draw.randrange(60))) for _ in range(800)] + [" ".join(draw.choice(TEXTS[11:14]) for _ in range(4000))]
    whole, encoder = Tokenizer.from_file(BYTE_BPE), byte_tokens.ByteEncoder(BYTE_BPE)
    for _ in range(2):  # the second time from the memo
        got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.texts(texts)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_configuration_packing_round_trip(spark, edge, nothing):
    docs = edge.unionByName(spark.createDataFrame([(100 + i, "wo rd " * (i % 50)) for i in range(300)], "doc_id bigint, text string"), allowMissingColumns=True).repartition(5)
    rows = bestfit.pack(docs, BYTE_BPE, 512).collect()
    whole = Tokenizer.from_file(BYTE_BPE)
    expected = Counter((r.doc_id, tuple(whole.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in docs.collect())
    sequences, starts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= 512 and (r.piece == 0 or r.length == 512)
        sequences[r.sequence_id].append((r.offset, r.length))
        starts[r.doc_id, r.piece, r.start].append(r)
    for laid in sequences.values():
        at = 0
        for offset, size in sorted(laid):
            assert offset == at
            at += size
        assert at <= 512
    ids = {}
    for doc_id in {d for d, _ in expected}:
        same = [x for x in expected if x[0] == doc_id]
        if len(same) == 1 and expected[same[0]] == 1:
            own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
            assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
            ids[doc_id] = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
            assert ids[doc_id] == list(same[0][1])
    assert len(ids) > 300 and sum(r.length for r in rows) == sum(len(x[1]) * n for x, n in expected.items())
    assert len(sequences) <= 1.05 * sum(r.length for r in rows) / 512 + 1
    assert bestfit.pack(nothing, BYTE_BPE).count() == 0
