"""Operator 1: toxicity by compression distance.

Two zstandard dictionaries of one size are trained, one on ordinary and one on toxic text. Both end
with the same common passages; before these lie the words that set one kind apart from the other.
A window of words is compressed with each. The bytes that the toxic dictionary saves, summed over
the windows of a text and divided by their number, are the text's distance. Thresholds on it are
calibrated on labelled texts that the dictionaries were not trained on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.shared import filled, mapped

WINDOW_WORDS = 8
LEVEL, LEAST_MATCH = 6, 5
COMMON_BYTES, OWN_BYTES = 30_000, 16_000
#: Labelled texts fetched for training, at most, and how long they may be together: the bound of what the driver holds.
SAMPLE_TEXTS, SAMPLE_CHARS = 8_000, 40_000_000
#: Windows of these texts that train the passages common to both kinds, at most: of more, every k-th of either kind.
COMMON_WINDOWS = 100_000
#: Texts with a word times the log of its ratio between the kinds, at least: below it chance finds too many words.
LEAST_GAIN = 18
_STOPS = b".,;:!?|*#%&$"


@dataclass
class Model:
    """Trained dictionaries, the passage both know, and the calibration of distances to probabilities."""

    toxic: bytes
    ordinary: bytes
    primer: bytes
    bias: float
    scale: float
    few: float


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def windows(words: list[bytes], primer: bytes) -> list[bytes]:
    """Windows of words with a passage behind them that both dictionaries hold.

    The passage makes sure that even a short window is worth compressing, so lengths stay comparable.
    """
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " + primer for i in range(0, len(words), WINDOW_WORDS)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=LEAST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.toxic, self.ordinary = model, _compressor(model.toxic), _compressor(model.ordinary)

    def distance(self, text: str) -> tuple[float, int]:
        """Bytes saved per window by the toxic dictionary, and the number of windows."""
        toxic, ordinary = self.toxic.compress, self.ordinary.compress
        parts = windows(words_of(text), self.model.primer)
        return sum(len(ordinary(w)) - len(toxic(w)) for w in parts) / max(1, len(parts)), len(parts)

    def score(self, text: str) -> float:
        m = self.model
        mean, n = self.distance(text)
        # one saved match weighs less in a text of few windows
        logit = m.bias + (m.scale * mean * n / (n + m.few) if n else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def distinct_texts(texts: Iterable[str]) -> list[bytes]:
    """Words of each text, one blank between them, without those that share passages with one before: copies would count as evidence.

    Words are kept in one piece per text; apart they would take several times the memory of the texts.
    """
    seen, out = set(), []
    for text in texts:
        words = words_of(text)
        if not words:
            continue
        grams = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        marks = [(seed, min(xxhash.xxh64_intdigest(g, seed=seed) for g in grams)) for seed in (1, 2, 3)]
        if not seen.intersection(marks):
            out.append(b" ".join(words))
        seen.update(marks)
    return out


def _openings(words: list[bytes]) -> set[bytes]:
    """The words of a text without stops, and their openings: a stem may have many endings."""
    plain = {w.strip(_STOPS) for w in words}
    return {w[:n] for w in plain for n in (4, 5, 6, 7, len(w)) if 2 < len(w) >= n}


def _telling(own: list[bytes], other: list[bytes]) -> bytes:
    """The words and openings that are far more frequent in ``own``, the most telling last."""
    a, b = (Counter(w for text in texts for w in _openings(text.split())) for texts in (own, other))
    gain = {}
    for word, n in a.items():
        ratio = (n / len(own)) / ((b[word] + 0.5) / max(1, len(other)))
        if ratio >= 8 and n * math.log(ratio) >= LEAST_GAIN:
            gain[word] = n * math.log(ratio)
    return b" ".join(sorted(gain, key=lambda w: (gain[w], w)))[-OWN_BYTES:]


def _split(text: bytes | list[bytes]) -> list[bytes]:
    return text.split() if isinstance(text, bytes) else text


def _common(texts: list[bytes] | list[list[bytes]]) -> bytes:
    """Passages common to texts, each given in one piece or as words; only the windows that are kept are held together."""
    total = sum(-(-len(_split(text)) // WINDOW_WORDS) for text in texts)
    step = max(1, -(-total // COMMON_WINDOWS))
    samples = list(islice((w for text in texts for w in windows(_split(text), b"")), 0, None, step))
    size = COMMON_BYTES
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, level=3).as_bytes()
        except zstandard.ZstdError:  # too few samples for this size
            size //= 2
    return b" ".join(samples)[:COMMON_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and scale of the logistic curve that fits best, by damped Newton steps with a weak prior on the scale."""
    w = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        design = np.stack([np.ones_like(x), x], axis=1)
        gradient = design.T @ (p - y) + np.array([0, 1e-3]) * w
        curvature = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(curvature, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def train(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries from two thirds of the texts, calibration on the others.

    Without texts of both kinds there is nothing to tell apart: the score is then the share of toxic labels.
    """
    halves = [[i for i in range(len(texts)) if (i % 3 == 0) == bool(k)] for k in (0, 1)]  # two thirds and one third
    kinds = [distinct_texts(texts[i] for i in halves[0] if labels[i] == k) for k in (0, 1)]
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    flat = math.log(share / (1 - share))
    common = _common(kinds[0] + kinds[1])[-COMMON_BYTES:]
    primer = common[-64:-24]
    model = Model(b" " + _telling(kinds[1], kinds[0]) + b" " + common, b" " + _telling(kinds[0], kinds[1]) + b" " + common, primer, flat, 0.0, 0.0)
    if not all(kinds) or len({labels[i] for i in halves[1]}) < 2:
        model.toxic = model.ordinary = common or b" "
        return model
    scorer = Scorer(model)
    found = [scorer.distance(texts[i]) for i in halves[1]]
    y = np.asarray([labels[i] for i in halves[1]], dtype=float)
    best = None
    for few in (0.0, 0.5, 1.0, 2.0, 4.0):
        x = np.asarray([mean * n / (n + few) if n else 0.0 for mean, n in found])
        bias, scale = _logistic(x, y)
        if scale <= 0:  # chance: nothing tells these texts apart
            bias, scale = flat, 0.0
        p = 1 / (1 + np.exp(-np.clip(bias + scale * x, -30, 30)))
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        if best is None or loss < best[0]:
            best = (loss, bias, scale, few)
    _, model.bias, model.scale, model.few = best
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int, chars: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """At most ``limit`` labelled texts with at most ``chars`` characters, drawn by a hash of the id.

    ``learn`` is the condition on doc_id that a row may be learnt from. Rows without id or label are not used.
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("label_id")).agg(F.max(label).cast("int").alias("label"))
    rows = known.filter(learn(F.col("label_id"))).withColumn("lot", F.xxhash64("label_id")).orderBy("lot", "label_id").limit(limit)
    texts = docs.select(F.col(id_col).alias("doc_id"), filled(text_col).alias("text"))
    rows = texts.join(F.broadcast(rows), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "lot", "label").agg(F.min("text").alias("text"))
    size = F.char_length("text")
    share = rows.agg(F.sum(size)).first()[0] or 0
    if share > chars:  # take the same part of every length
        rows = rows.filter(F.pmod("lot", F.lit(1_000_003)) < int(1_000_003 * chars / share))
    found = sorted(rows.select("lot", "label", "text").collect())
    return [r.text for r in found], [r.label for r in found]


def learnt_rows(modulus: int, held: int):
    """Rows to learn from: crc32 of the id as text leaves another remainder than ``held``."""
    return lambda doc_id: F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) != held, F.lit(True))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and score, 0 to 1, higher for texts more likely toxic.

    The whole text is scored; null and empty texts get the score of a text without toxic matches. Nothing but the
    text enters a score, so equal texts score alike. Other columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "score": [scorer.score(t) for t in batch.column("text").to_pylist()]}

    return mapped(docs.select(F.col(id_col).alias("doc_id"), filled(text_col).alias("text")), run, f"doc_id {kind}, score double")


def ordinary(docs: DataFrame, model: Model, toxic_from: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``toxic_from``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            yield batch.filter(pa.array([scorer.score(t or "") < toxic_from for t in texts], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def trained(docs: DataFrame, labels: DataFrame, learn, limit: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> Model:
    return train(*labelled_sample(docs, labels, "toxic", learn, limit, chars))
