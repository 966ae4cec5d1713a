"""Learned operators: held-out accuracy, edge cases, and mixing against its targets."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.llm import mixing, quality, toxicity
from portolan.llm.shared import read

SF = "/root/testdata/sf0.01"
INSULTS = "gralk morblen tisk vornax quiddle".split()


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(7)
    texts, labels = [], []
    for i in range(600):
        words = [f"{draw.choice('bcdfg')}{draw.choice('aeiou')}{draw.choice('lmnr')}{draw.choice(['ing', 'ed', 'ly', ''])}" for _ in range(draw.randrange(20, 200))]
        if i % 4 == 0:
            for _ in range(max(2, len(words) // 30)):
                words[draw.randrange(len(words))] = draw.choice(INSULTS)
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_toxicity_finds_held_out_texts(labelled):
    texts, labels = labelled
    scorer = toxicity.Scorer(toxicity.train(texts[:450], labels[:450]))
    found = [scorer.score(t) >= 0.5 for t in texts[450:]]
    assert np.mean([a == b for a, b in zip(found, labels[450:], strict=True)]) > 0.95
    assert all(0 <= scorer.score(t) <= 1 for t in ("", " ", "x", texts[0] * 50))


def test_common_passages_are_of_both_kinds_however_many_windows(labelled, monkeypatch):
    monkeypatch.setattr(toxicity, "COMMON_WINDOWS", 400, raising=False)
    seen = []
    train = toxicity.zstandard.train_dictionary
    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", lambda size, samples, **how: seen.append(samples) or train(size, samples, **how))
    texts = [["ordinary"] * 80 + [t] for t in labelled[0][:300]] + [["vile"] * 80 + [t] for t in labelled[0][300:360]]
    toxicity._common([[w.encode() for w in t] for t in texts])
    kinds = [sum(word in w for w in seen[0]) for word in (b" ordinary ", b" vile ")]
    assert sum(kinds) <= 400 and 4 < kinds[0] / kinds[1] < 6


def test_training_texts_are_held_about_as_long_as_they_are(labelled):
    held = toxicity.distinct_texts(labelled[0])
    size = lambda x: sys.getsizeof(x) + (sum(map(sys.getsizeof, x)) if isinstance(x, list) else 0)
    assert held and sum(map(size, held)) < 1.5 * sum(map(len, labelled[0]))


@pytest.mark.parametrize("labels", [[], [0] * 40, [1] * 40, [0, 1]])
def test_models_without_both_kinds(labelled, labels):
    texts = labelled[0][: len(labels)]
    scorer = toxicity.Scorer(toxicity.train(texts, labels))
    model = quality.train(texts, labels)
    for t in ("", "some text", labelled[0][0]):
        assert 0 <= scorer.score(t) <= 1 and 0 <= quality.score(model, t) <= 1


def test_scores_on_edge_rows(spark, edge, nothing, labelled):
    tox, good = toxicity.train(*labelled), quality.train(*labelled)
    for scored in (toxicity.toxicity(edge, tox), quality.quality(edge, good)):
        rows = scored.collect()
        assert len(rows) == edge.count() and scored.columns == ["doc_id", "score"]
        assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1  # null, empty and blank texts
        assert len({r.score for r in rows if r.doc_id in (2,)}) == 1
    assert toxicity.toxicity(nothing, tox).count() == quality.quality(nothing, good).count() == 0
    kept = toxicity.ordinary(edge, tox, 0.5)
    assert kept.schema == edge.schema and kept.count() == edge.count()
    assert toxicity.ordinary(edge, tox, 0.0).count() == 0


def test_passages_are_weighed_within_their_text(labelled):
    model = quality.train(*labelled)
    bags = [quality.bag(t) for t in labelled[0][:5]]
    x, starts = quality._counts(bags)
    weight, *_ = quality._attend(model, np.tanh(x @ model.words + model.bias), starts)
    assert np.allclose(np.add.reduceat(weight, starts), 1)
    whole = [quality.score(model, t) for t in labelled[0][450:]]
    assert np.mean([(s >= 0.5) == y for s, y in zip(whole, labelled[1][450:], strict=True)]) > 0.9


def test_long_words_are_encoded_to_their_end():
    word = "".join(random.Random(9).choices("abcXYZ019+/", k=20_000))
    assert len(quality.bag(word)) == 4  # 100 pieces, 32 to a passage
    pieces = [word[i : i + 200] for i in range(0, len(word), 200)]
    assert (quality.bag(word) == quality.bag(" ".join(pieces))).all()
    assert (quality.bag("short words") == quality.bag(" short  words")).all() and len(quality.bag("short words")) == 1


def test_labelled_sample_is_bounded_and_obeys_the_split(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    texts, values = toxicity.labelled_sample(docs, labels, "toxic", toxicity.learnt_rows(5, 0), 50, 10**9)
    assert len(texts) == len(values) == 50
    short, _ = toxicity.labelled_sample(docs, labels, "toxic", toxicity.learnt_rows(5, 0), 50, sum(map(len, texts)) // 4)
    assert 0 < len(short) < 50
    learnt = docs.filter(toxicity.learnt_rows(5, 0)(F.col("doc_id"))).select("text").collect()
    assert set(texts) <= {r.text for r in learnt}


def test_quality_on_held_out_rows(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    learn = toxicity.learnt_rows(4, 2)
    scores = quality.quality(docs, quality.trained(docs, labels, learn)).join(labels, "doc_id").filter(~learn(F.col("doc_id")))
    assert scores.filter((F.col("score") >= 0.7) != (F.col("quality") == 1)).count() < 0.1 * scores.count()


@pytest.fixture(scope="module")
def sources(spark):
    draw = random.Random(2)
    rows = []
    for i in range(300):
        kind = i % 3 % 2
        rows.append((i, " ".join(draw.choice(["red", "green", "blue"] if kind else ["one", "two", "three"]) for _ in range(draw.randrange(1, 60)))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.filter("doc_id < 150").select("doc_id", F.when(F.col("doc_id") % 3 % 2 == 1, "b").otherwise("a").alias("domain"))
    return docs, labels


@pytest.mark.parametrize("total", ["same", "enough", 9_000.0])
def test_rates_meet_the_targets(sources, total):
    got = mixing.mixing_rates(*sources, {"a": 0.3, "b": 0.7}, total).toPandas()
    p = np.asarray([[r["a"], r["b"]] for r in got.posteriors])
    assert np.allclose(p.sum(1), 1) and (got.rate >= 0).all()
    taken = (got.rate.to_numpy() * got.tokens.to_numpy()) @ p
    curve = p.T @ (got.tokens.to_numpy()[:, None] * p)
    want = {"same": got.tokens.sum(), "enough": max(1 / (np.linalg.inv(curve) @ [0.3, 0.7]))}.get(total, total)
    assert total != "enough" or got.rate.min() > 1 - 1e-6
    assert np.allclose(taken, want * np.asarray([0.3, 0.7]), rtol=2e-3)
    # the rates are those nearest to 1 that do: the same shift for equal posteriors
    solved = np.maximum(0, 1 + p @ np.linalg.lstsq(p, got.rate.to_numpy() - 1, rcond=None)[0])
    assert np.allclose(solved, got.rate, atol=1e-6)


@pytest.mark.parametrize("wanted", [{"a": 0.125, "b": 0.875}, {"a": 0.01, "b": 0.99}, {"a": 0.2, "b": 0.7, "c": 0.1}])
def test_enough_thins_no_document_whose_domain_is_doubtful(spark, wanted):
    draw = random.Random(4)
    colours = {"a": "one", "b": "red", "c": "sea"}
    kinds = [draw.choice(sorted(wanted)) for _ in range(600)]
    docs = spark.createDataFrame([(i, colours[k]) for i, k in enumerate(kinds)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, k if draw.random() < 0.85 else draw.choice(sorted(wanted))) for i, k in enumerate(kinds)], "doc_id bigint, domain string")
    got = mixing.mixing_rates(docs, labels, wanted, "enough").toPandas()
    assert got.rate.min() >= 1 and got.rate.max() > 1
    shares = (got.rate.to_numpy() * got.tokens.to_numpy()) @ np.asarray([[r[d] for d in wanted] for r in got.posteriors])
    if wanted["a"] > 0.05:  # else beyond what the probabilities have
        assert np.allclose(shares / shares.sum(), list(wanted.values()), atol=2e-3)
    assert {r.doc_id for r in mixing.mixed(docs, labels, wanted, "enough").collect()} == set(range(600))


def test_targets_out_of_reach_are_met_as_nearly_as_possible(sources):
    got = mixing.mixing_rates(*sources, {"a": 1.0, "b": 0.0}).toPandas()
    p = np.asarray([[r["a"], r["b"]] for r in got.posteriors])
    shares = (got.rate.to_numpy() * got.tokens.to_numpy()) @ p
    assert (got.rate >= 0).all() and shares[0] / shares.sum() > 0.97


def test_mixing_edges(spark, edge, nothing, sources):
    labels = sources[1]
    none = labels.filter("false")
    for table in (edge, nothing):
        for known in (labels, none):
            out = mixing.mixed(table, known, {"a": 0.5, "b": 0.5})
            assert out.columns == table.columns
            rates = mixing.mixing_rates(table, known, {"a": 0.5, "b": 0.5}).collect()
            assert len(rates) == table.count() and all(r.rate >= 0 for r in rates)
    assert mixing.mixed(edge, none, {"a": 1.0}).count() == edge.count()
    docs, labels = sources
    first, again = (sorted(r.doc_id for r in mixing.mixed(docs, labels, {"a": 0.3, "b": 0.7}).collect()) for _ in range(2))
    assert first == again and set(first) == set(range(300)) and len(first) > 300
