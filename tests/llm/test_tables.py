"""Personal data, url verdicts, embeddings and the pipeline on edge cases and against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from portolan.llm import ego, hosts, pii, queries, registry
from portolan.llm.components import components

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PERSONAL = [
    "a@b.c_d@e.f x@y @z a..b@c-d.e.f., ü@ü.de é a@b", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1.2.3", "4111 1111-1111 1111 4111111111111112 79927398713 12 3 4",
    "+1 (212) 555-0100 +123 +49 30 1234567-8 + 1 +1 (269) 555-3296 4524132264652876", "iban DE89 3704 0044 0532 0130 00. XDE89370400440532013000 GB82WEST12345698765432",
    "call me: 0301 2345678 now; 0301 2345678", "\U0001f600 x@y.zz \U0001f600 10.0.0.1", "1.0.0.0.1.0.0.0 " * 700, "1" * 3_000 + " " + "a" * 3_000 + "@", "",
]


def _base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            luhn = sum(d[::-1][0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
            good = {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn % 10 == 0, "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base_spans(spark, edge, nothing, monkeypatch):
    draw = random.Random(5)
    texts = PERSONAL + ["".join(draw.choice("0123456789.@+ -()aZ") for _ in range(draw.randrange(200))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(edge.select("doc_id", "text"))
    got = pii.personal_data(rows).collect()
    for r, text in zip(got, [x.text or "" for x in rows.collect()], strict=True):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base] == _base(text)
        assert all(s.value == text[s.start : s.end] and 0 < s.score <= 1 for s in r.spans)
    assert pii.personal_data(nothing).count() == 0 and pii.personal_data(edge).count() == edge.count()


def test_personal_data_further_spans(spark):
    rows = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id bigint, text string")
    further = {r.doc_id: [(s.kind, s.value) for s in r.spans if not s.base] for r in pii.personal_data(rows).collect()}
    assert further[3] == [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]
    assert further[4] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert further[5] == [("phone", "0301 2345678"), ("phone", "0301 2345678")]
    digest = queries.op3  # the query's columns follow from these spans
    assert callable(digest)


def test_rules_and_host_trust(spark):
    pages = [
        (1, "http://A.Good.org/x?y", '<a href="http://mid.net/p">'), (2, "https://mid.net", '<a href=//far.net/x> <a href="/own">'), (3, "http://far.net/", ""),
        (4, "http://bad.com/de/1", ""), (5, "http://points.net/", "<a HREF='https://bad.com/q'><a href='http://bad.com/r'>"), (6, "ftp://x.example.org/es/1#z", None),
        (7, "x.example.org/es/", ""), (8, None, ""), (9, "http://example.org/en/12", ""), (10, "http://notexample.org/en/12", ""), (10, "http://notexample.org/en/12", ""), (11, "http://", ""),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in hosts.judge_urls(df, queries.URL_RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.good.org", "/x", "org/", "allow")
    assert got[2].rule is None and got[2].trust > 0 and got[3].trust > 0 and got[2].verdict == got[3].verdict == "allow"
    assert (got[4].rule, got[4].verdict) == ("com/de/", "block")
    assert got[5].rule is None and got[5].distrust > got[5].trust and got[5].verdict == "block"
    assert (got[6].rule, got[6].verdict) == ("example.org/es/", "block")
    assert all((got[k].host, got[k].path, got[k].rule, got[k].verdict) == ("", "", None, "allow") for k in (7, 8, 11))
    assert got[9].rule == "example.org/en/1" and got[10].rule == "org/"
    assert hosts.judge_urls(df, queries.URL_RULES).count() == len(pages) and hosts.judge_urls(df.filter("false"), queries.URL_RULES).count() == 0


def test_spread_is_personalised_pagerank(spark):
    draw = np.random.default_rng(1)
    n = 12
    links = draw.integers(0, 4, (n, n)) * (draw.random((n, n)) < 0.3) * (1 - np.eye(n, dtype=int))
    seeds = draw.integers(0, 3, (2, n)).astype(float)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(links[i, j])) for i in range(n) for j in range(n) if links[i, j]], "src string, dst string, n bigint")
    start = spark.createDataFrame([(f"h{i}", float(seeds[0, i]), float(seeds[1, i])) for i in range(n)], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in hosts.spread(start, edges, tolerance=1e-9).collect()}
    for k, flow in ((0, links), (1, links.T)):
        step = flow / np.maximum(1, flow.sum(1, keepdims=True))
        tele = seeds[k] / seeds[k].sum() * (1 - hosts.DAMPING)
        rank = np.linalg.solve(np.eye(n) - hosts.DAMPING * step.T, tele)
        assert np.allclose([got[f"h{i}"][k] for i in range(n)], rank, atol=1e-7)


def test_distrust_reaches_far_hosts_whatever_share_of_the_seeds_has_links(spark):
    chain = [f"h{i}" for i in range(20)] + ["seed"]
    edges = spark.createDataFrame([(a, b, 1) for a, b in zip(chain, chain[1:], strict=False)], "src string, dst string, n bigint")
    for alone in (0, 2_000):
        seeds = [("seed", 0.0, 1.0)] + [(f"alone{i}", 1.0, 1.0) for i in range(alone)]
        got = {r.host: r for r in hosts.spread(spark.createDataFrame(seeds, "host string, trust double, distrust double"), edges).collect()}
        assert all(got[h].distrust > got[h].trust == 0 for h in chain)
        assert np.isclose(got["h0"].distrust * (1 + alone), (1 - hosts.DAMPING) * hosts.DAMPING**20, rtol=1e-4)


def _links(rows, cosine):
    out = {}
    for i, (_, a, la) in enumerate(rows):
        out[i] = set()
        for j, (_, b, lb) in enumerate(rows):
            if i == j or la is None or la != lb or not a or not b or len(a) != len(b) or None in a or None in b:
                continue
            x, y = np.asarray(a, dtype=np.float32).astype(float), np.asarray(b, dtype=np.float32).astype(float)
            if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                out[i].add(j)
    return out


@pytest.mark.parametrize("block", [1024, 5])
def test_near_vectors_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ego, "BLOCK", block)
    monkeypatch.setattr(ego, "FAN_OUT", 2)
    draw = np.random.default_rng(block)
    centres = draw.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + draw.standard_normal(16) * draw.choice([0.1, 0.3])).tolist(), int(i % 3)) for i in range(240)]
    rows += [(500 + i, rows[0][1], 0) for i in range(6)] + [(500, rows[0][1], 0)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [1.0, None], 1), (603, [float("nan")] * 16, 1), (604, rows[0][1], None), (605, [1.0, 2.0], 1), (606, [2.0, 4.0], 1), (607, [], 1), (608, [float("inf")] * 16, 1), (None, rows[3][1], 0), (609, [1e-30] * 16, 2), (610, [1e30] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("unit", F.lit("clash")).repartition(4)
    links = _links(rows, 0.93)
    want = []
    for i, (vec_id, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        want.append((vec_id, len(links[i]), low, vec_id == low))
    got = ego.near_vectors(df).collect()
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in got))) == sorted(map(str, want))
    assert sum(n for _, n, *_ in want) > 500
    assert ego.near_vectors(df.filter("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 7), (5, 5), (200, 199), (200, 199)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 3 for i in [3, 7, *range(8, 60)]}, 199: 199, 200: 199}


def test_pipeline_targets_are_not_fitted_to_a_table():
    assert corpus_pipeline.MIXTURE == {"good": 0.88, "poor": 0.12}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("extra"))
    columns = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] <= sizes[4] and sizes[1] > 0.8 * sizes[0]
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in docs.dropDuplicates(["doc_id"]).collect()]
    assert len(texts) == len(set(texts))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.filter("start = 0").count() == sizes[4]


def test_pipeline_stages_on_edge_rows(spark, edge, nothing):
    sf = "/root/testdata/sf0.001"
    for table in (edge, nothing):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == table.columns
        ids = sorted((r.doc_id for r in docs.select("doc_id").distinct().collect()), key=str)
        assert ids == ([] if table is nothing else sorted([1, 3, 5, 6, 8, 10], key=str))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_their_sql(spark, name):
    from tests.oracle import compare, connect

    sf = "/root/testdata/sf0.001"
    assert compare(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLES[name]) == []


def test_sha_of_no_spans_is_that_of_the_empty_text(spark, edge):
    rows = edge.filter("doc_id = 4")
    base = pii.personal_data(rows).select(F.sha2(pii.printed(F.col("spans")).cast("binary"), 256).alias("s")).first()
    assert base.s == hashlib.sha256(b"").hexdigest()
