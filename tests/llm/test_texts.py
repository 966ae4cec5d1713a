"""Token counts, packing, fingerprints and n-gram sets on edge cases and against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.llm import fingerprints, jaccard, packing, queries, tokens

STRANGE = [
    "Don't we'll I'D x's.", "abc... def,, 'tis rock'n'roll!", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "é. x̂. Été, 你好。 İstanbul ΣΣ",
    "a|b | c|", "tab\tand\x0bvertical space end", "3.14 , . 1,000.", "\U0001f600\U0001f600 x" * 3, "x" * 5_000, "###a### !!! b&&&", "\r\n a\r\nb ", "́abc ́", "",
]


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load(queries.word_bpe())


def test_pieces_have_the_tokens_of_the_text(tokenizer):
    ids = tokens.id_encoder(queries.word_bpe(), "<u2")
    random.seed(4)
    texts = STRANGE + [" ".join(random.choice(STRANGE) for _ in range(6)) for _ in range(200)]
    for text, got, n in zip(texts, ids.texts(texts, b"".join), tokens.counter(queries.word_bpe()).texts(texts, sum), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, dtype="<u2").tolist() == want
        assert n == len(want)


def test_memo_keeps_results_when_it_is_full(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 20)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 200)
    texts = [f"w{i % 50} x{i} y{i % 7}." for i in range(300)]
    found = list(tokens.PieceEncoder(queries.word_bpe()).texts(texts, sum))
    assert found == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_tokenizers_that_keep_white_space_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_edges(edge, nothing, tokenizer):
    rows = tokens.count_tokens(edge, queries.word_bpe()).collect()
    texts = [r.text or "" for r in edge.select("text").collect()]
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert tokens.count_tokens(nothing, queries.word_bpe()).count() == 0


def test_packing_round_trip(edge, nothing, tokenizer):
    docs = edge.filter("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.pack(docs, queries.word_bpe(), length=256).collect()
    own = defaultdict(dict)
    sequences = defaultdict(dict)
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert len(ids) == p.length
        own[p.doc_id][p.start] = ids
        sequences[p.sequence_id][p.offset] = ids
    for r in docs.select("doc_id", "text").collect():
        assert sum((own[r.doc_id][k] for k in sorted(own[r.doc_id])), []) == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset in sorted(parts):
            assert offset == at
            at += len(parts[offset])
        sizes.append(at)
    assert all(s == 256 or s & (s - 1) == 0 for s in sizes) and sum(s != 256 for s in sizes) < 8
    assert packing.pack(nothing, queries.word_bpe()).count() == 0
    assert packing.pack(edge, queries.word_bpe()).agg(F.countDistinct("doc_id"), F.sum(F.when(F.col("doc_id") == 2, F.col("length")))).first()[1] == 2 * (3 + 1)


def test_hilbert_keys_visit_each_cell_by_steps_of_one():
    for dims in (2, 3):
        cells = np.stack(np.meshgrid(*[np.arange(8)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, 3)
        assert sorted(keys) == list(range(8**dims))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_fingerprints_compose():
    data = bytes(random.Random(1).randbytes(3_000))
    for k, prime in enumerate(fingerprints.PRIMES):
        powers = fingerprints._powers(fingerprints.BASES[k], prime)
        whole = fingerprints.chunk_value(data, powers, prime)
        parts = [data[:7], data[7:1_000], data[1_000:]]
        at = 0
        for p in parts:
            at = fingerprints.joined(at, fingerprints.chunk_value(p, powers, prime), len(p), k)
        assert at == whole


def _exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids), i == (min(known) if known else None)) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [fingerprints.SPREAD_BYTES, 20_000])
def test_exact_duplicates(edge, nothing, spread):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = fingerprints.exact_duplicates(edge, spread_bytes=spread).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == _exact(rows)
    assert fingerprints.exact_duplicates(nothing).count() == 0


def test_exact_duplicates_settle_collisions(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PRIMES", (3, 3))  # nearly all texts of one length collide
    rows = [(i, f"t{i % 10}{i % 3}") for i in range(120)]
    got = fingerprints.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == _exact(rows)


def _near(rows, words=5, percent=75):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] = min((x for x in (low.get(find(i)), doc_id) if x is not None), default=None)
    return sorted(((d, len(s), low[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def _families(seed):
    """Groups of near copies, texts that share a passage, chains of small edits, and repeated short texts."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(3_000)}"
    passage, rows = [word() for _ in range(40)], []
    for _ in range(12):
        base = [word() for _ in range(draw.randrange(5, 120))]
        for _ in range(draw.randrange(1, 9)):
            text = list(base)
            for _ in range(draw.randrange(0, 5)):
                text[draw.randrange(len(text))] = word()
            rows.append(text)
    for _ in range(40):
        rows.append(passage + [word() for _ in range(draw.randrange(0, 40))])
    chain = [word() for _ in range(100)]
    for k in range(12):
        chain = list(chain)
        chain[k * 8] = word()
        rows.append(chain)
    rows += [["only", "three", "words"], ["Only", "THREE", "words"], ["one"], []] * 2
    draw.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("settings", [{}, {"LIST_BLOCK": 4, "LIST_SALT": 6, "MEMBERS_PER_SALT": 3, "COUNT_BUFFER": 500, "ENTRIES_PER_FLUSH": 100}])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = _families(len(settings))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _near(rows)


def test_sets_alone_in_their_block_meet_the_others_of_their_n_gram(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_SALT", 4)
    draw, rows = random.Random(11), []
    for _ in range(6):  # many exact copies give an n-gram many blocks, a few near copies leave most of them empty
        base = [f"w{draw.randrange(3_000)}" for _ in range(60)]
        near = [base[:k] + ["other"] + base[k + 1 :] for k in (10, 50)]
        rows += [" ".join(base)] * 60 + [" ".join(t) for t in near]
    rows = list(enumerate(rows))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _near(rows)
    assert len({r.component_id for r in got}) == 6


def test_near_duplicates_edges(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = jaccard.near_duplicates(edge).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _near(rows)
    assert jaccard.near_duplicates(nothing).count() == 0


def test_signatures_never_rule_out_a_similar_pair():
    draw = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(draw.integers(0, 1 << 63, draw.integers(1, 90), dtype=np.uint64))
        keep = a[draw.random(len(a)) < 0.9]
        b = np.unique(np.concatenate([keep, draw.integers(0, 1 << 63, draw.integers(0, 12), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            assert jaccard.possible(len(a), jaccard.signature(a), len(b), jaccard.signature(b), 75)
