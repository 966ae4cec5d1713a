"""The registered query of each corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.llm import bestfit, ego, fingerprints, hosts, jaccard, mixing, negatives, packing, pii, quality, spelling, tokens, toxicity
from portolan.llm.registry import query
from portolan.llm.shared import read


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


@query("op2_exact_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.exact_duplicates(read(spark, sf_dir, "documents"))


@query("op4_hilbert_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), word_bpe())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(read(spark, sf_dir, "documents"), word_bpe())
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


OP9_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id FROM s JOIN r USING (doc_id) GROUP BY ALL
"""


@query("op9_ngram_jaccard", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents")).drop("row_key")


OP7_SQL = """
WITH RECURSIVE
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND list_aggregate(list_transform(v, lambda x: abs(x)), 'max') > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u AS x JOIN u AS y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
      WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


@query("op7_epsilon_grid_join", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op1_compression_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = read(spark, sf_dir, "documents"), toxicity.learnt_rows(5, 0)
    model = toxicity.trained(docs, read(spark, sf_dir, "labels"), learn)
    scores = toxicity.toxicity(docs, model)
    return scores.select("doc_id", (~learn(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _op3_sql() -> str:
    """The operator again in DuckDB: the same spans from the plain patterns, whose engine needs no guards against long searches."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": pii.PHONE, "run": "[0-9]+", "full": pii.FULL_PHONE, "local": pii.LOCAL_PHONE, "iban": pii.IBAN,
    }
    digits = "regexp_replace(x.v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(0, len({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digits}[len({digits}) - i]::INT WHEN {digits}[len({digits}) - i]::INT > 4 THEN {digits}[len({digits}) - i]::INT * 2 - 9 ELSE {digits}[len({digits}) - i]::INT * 2 END)) % 10 = 0"
    turned = "(replace(x.v, ' ', '')[5:] || replace(x.v, ' ', '')[:4])"
    mod_97 = f"list_reduce(list_prepend(0, list_transform(range(1, len({turned}) + 1), lambda i: ascii({turned}[i]))), lambda p, c: (CASE WHEN c < 65 THEN p * 10 + c - 48 ELSE p * 100 + c - 55 END) % 97) = 1"
    apart = lambda chars: f"NOT regexp_matches(CASE WHEN x.s > 0 THEN substr(text, x.s::BIGINT, 1) ELSE '' END, '{chars}') AND NOT regexp_matches(substr(text, x.e::BIGINT + 1, 1), '{chars}')"
    few = lambda low, high: f"len({digits}) BETWEEN {low} AND {high}"
    checks = {
        "email": "true", "ip": "len(list_filter(string_split(x.v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INT), 999) > 255)) = 0", "card": f"{few(13, 19)} AND {luhn}", "phone": few(9, 15),
        "run": f"{few(13, 19)} AND {luhn}", "full": f"{few(9, 15)} AND {apart('[0-9]')}", "local": f"{few(9, 15)} AND {apart('[0-9+]')}", "iban": f"{apart('[A-Za-z0-9]')} AND {mod_97}",
    }
    kinds = {"email": ("email", "email"), "ip": ("ip", "ip"), "card": ("card", "card"), "phone": ("phone", "phone"), "run": ("card", "card"), "full": ("phone", "phone"), "local": ("phone", "local"), "iban": ("iban", "iban")}
    steps, unions = [], []
    for name, pattern in plain.items():
        kind, prior = kinds[name]
        near = f"regexp_matches(substr(text, greatest(s - {pii.CONTEXT_CHARS}, 0) + 1, s - greatest(s - {pii.CONTEXT_CHARS}, 0)), '{pii.CONTEXT[kind]}')"
        steps.append(f"m_{name} AS (SELECT k, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d WHERE regexp_matches(text, '{pattern}'))")
        steps.append(f"p_{name} AS (SELECT k, text, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(g[1:i], lambda y: len(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0), 'v': m[i]}})) AS y FROM m_{name})")
        steps.append(f"x_{name} AS (SELECT k, text, {{'s': y.s, 'e': y.s + len(y.v), 'v': y.v}} AS x FROM p_{name})")
        steps.append(f"f_{name} AS (SELECT k, text, x.s::BIGINT AS s, x.e::BIGINT AS e FROM x_{name} WHERE {checks[name]})")
        if name in pii.KINDS[:4]:
            unions.append(f"SELECT k, '{kind}' AS kind, {pii.KINDS.index(kind)} AS o, s, e, true AS base FROM f_{name}")
        else:
            over = f" AND NOT EXISTS (SELECT 1 FROM f_{kind} AS b WHERE b.k = f_{name}.k AND b.s < f_{name}.e AND f_{name}.s < b.e)" if kind in pii.KINDS[:4] else ""
            unions.append(f"SELECT k, '{kind}', {pii.KINDS.index(kind)}, s, e, false FROM f_{name} WHERE {pii.PRIOR[prior]} + CASE WHEN {near} THEN {pii.CONTEXT_GAIN} ELSE 0 END >= {pii.THRESHOLD}{over}")
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s, e)"
    return (
        "WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents), " + ", ".join(steps)
        + ", a AS (" + " UNION ALL ".join(unions) + f"), r AS (SELECT k, {', '.join(f'count(*) FILTER (base AND o = {i}) AS n_{n}' for i, n in enumerate(pii.KINDS[:4]))}, {listed} FILTER (base) AS b, {listed} AS s FROM a GROUP BY k) "
        + f"SELECT doc_id, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}' for n in pii.KINDS[:4])}, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans FROM d LEFT JOIN r USING (k)"
    )


@query("op3_personal_data", _op3_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS[:4]]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(pii.printed(base).cast("binary"), 256).alias("base_sha256"), pii.printed(F.col("spans")).alias("spans"))


@query("op10_attention_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = read(spark, sf_dir, "documents"), toxicity.learnt_rows(4, 2)
    model = quality.trained(docs, read(spark, sf_dir, "labels"), learn)
    scores = quality.quality(docs, model)
    return scores.select("doc_id", (~learn(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Host, path and verdict of the url rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op5_link_trust")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge_urls(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: Wanted shares of tokens: most from good texts, few from poor and toxic ones.
MIXTURE = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


@query("op8_soft_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mixing_rates(read(spark, sf_dir, "documents"), mixing.domains_of(read(spark, sf_dir, "labels")), MIXTURE)
    parts = [F.coalesce(F.col("posteriors")[d], F.lit(0.0)).alias(f"p_{d}") for d in MIXTURE]
    return rates.select("doc_id", "tokens", "rate", *parts)


#: DuckDB's levenshtein compares bytes, so the letters beyond ASCII are given one byte each.
_ONE_BYTE = ("".join(map(chr, range(0xC0, 0x100))), "".join(c for c in map(chr, range(0x20, 0x7F)) if not c.islower() and c != "'")[:64])

OP11_SQL = f"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k FROM r WHERE len(run) >= 7 GROUP BY ALL),
b AS (SELECT run, k, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END) AS b FROM c),
h AS (SELECT run, k, xor(list_reduce(flatten(b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, crc),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM o WHERE len(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
x AS (SELECT word, n, unnest([len(word), len(word) - 1]) AS m FROM w),
y AS (SELECT word, n, m, unnest([substr(word, 1, m // 2), '-' || substr(word, len(word) - (m - m // 2) + 1)]) AS part FROM x),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM y AS a JOIN y AS b ON a.m = b.m AND a.part = b.part AND a.word <> b.word AND abs(len(a.word) - len(b.word)) < 2 WHERE levenshtein(translate(a.word, '{_ONE_BYTE[0]}', '{_ONE_BYTE[1]}'), translate(b.word, '{_ONE_BYTE[0]}', '{_ONE_BYTE[1]}')) = 1),
q AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'w': near}}) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 10 * w.n THEN best.w END AS form, CASE WHEN -best.n >= 10 * w.n THEN -best.n END AS form_n FROM w LEFT JOIN q USING (word)),
s(word, root) AS (SELECT word, word FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, s.root, n, n_near, form_n FROM f JOIN s USING (word) WHERE s.root IN (SELECT word FROM f WHERE form IS NULL)
"""


def one_in_31_short(doc_id: Column, run: Column) -> Column:
    """A run as it is spelled in a document: where 31 divides the crc32 of both, one code point is missing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


@query("op11_spelling_variants", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(read(spark, sf_dir, "documents"), one_in_31_short))


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5
"""


@query("op12_multi_index_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query("op13_configuration_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = bestfit.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
