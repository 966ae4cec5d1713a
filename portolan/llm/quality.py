"""Operator 10: quality by attention-based multiple-instance learning.

A text is a bag of passages. Each passage is encoded by the mean of the learned vectors of its
words' features; a gated attention network, learned from the labels of whole texts alone, weighs
the passages, and the weighted representation is scored. Features are the shape of a word, its
hash, and whether it repeats the word before, so unseen words still carry their shape.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.shared import MEMOS, filled, mapped
from portolan.llm.toxicity import labelled_sample

PASSAGE_WORDS = 32
#: Longer words are cut into pieces of so many characters, each a word of its own: text without white space has passages too.
WORD_CHARS = 200
SHAPES, HASHES = 512, 1024
REPEATED, EMPTY = SHAPES + HASHES, SHAPES + HASHES + 1
FEATURES = SHAPES + HASHES + 2
HIDDEN, ATTENTION = 24, 12
#: Labelled texts fetched for training, at most, and how long they may be together: the bound of what the driver holds.
SAMPLE_TEXTS, SAMPLE_CHARS = 4_000, 15_000_000
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.01, 1e-4
WORD_MEMO = 200_000
_RUNS = re.compile(r"(.)\1+")


@dataclass
class Model:
    """Vectors of the features, the attention's two gates and weights, and the last layer."""

    words: np.ndarray  # FEATURES x HIDDEN
    bias: np.ndarray
    values: np.ndarray  # HIDDEN x ATTENTION
    gates: np.ndarray
    weights: np.ndarray  # ATTENTION
    last: np.ndarray  # HIDDEN
    offset: np.ndarray  # 1


def shape(word: str) -> str:
    """A word with letters as a or A, digits as 0 and other characters kept, each run once."""
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c for c in word)
    return _RUNS.sub(r"\1", kinds)


class _Codes(dict):
    """Shape and hash feature of each word, packed in one number."""

    def __missing__(self, word):
        plain = word.lower().encode("utf-8", "surrogatepass")
        code = (xxhash.xxh64_intdigest(shape(word).encode("utf-8", "surrogatepass")) % SHAPES) << 40 | xxhash.xxh64_intdigest(plain) & (1 << 40) - 1
        if len(self) < WORD_MEMO:
            self[word] = code
        return code


_CODES = MEMOS.setdefault("word codes", _Codes())


def bag(text: str) -> np.ndarray:
    """Feature ids of the passages of a text, one row per passage, three per word: shape, hash, repetition; -1 where there is none."""
    words = [w[i : i + WORD_CHARS] for w in text.split() for i in range(0, len(w), WORD_CHARS)]
    if not words:
        return np.full((1, 1), EMPTY)
    codes = np.fromiter(map(_CODES.__getitem__, words), dtype=np.int64, count=len(words))
    again = np.where(np.diff(codes, prepend=codes[0] + 1) == 0, REPEATED, -1)
    passages = -(-len(words) // PASSAGE_WORDS)
    out = np.full((passages * PASSAGE_WORDS, 3), -1)
    out[: len(words)] = np.stack([codes >> 40, SHAPES + codes % HASHES, again], axis=1)
    return out.reshape(passages, 3 * PASSAGE_WORDS)


def _counts(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature shares of all passages of some texts, and the first passage of each text."""
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    out = np.zeros((sum(map(len, bags)), FEATURES), dtype=np.float32)
    row = 0
    for b in bags:
        for passage in b:
            ids = passage[passage >= 0]
            out[row] = np.bincount(ids, minlength=FEATURES) / max(1, len(ids)) * 3
            row += 1
    return out, starts


def _attend(m: Model, hidden: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Attention weights of passages within each text, and what their gradient needs."""
    value, gate = np.tanh(hidden @ m.values), 1 / (1 + np.exp(-hidden @ m.gates))
    logit = (value * gate) @ m.weights
    own = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(hidden)))
    weight = np.exp(logit - np.maximum.reduceat(logit, starts)[own])
    weight /= np.add.reduceat(weight, starts)[own]
    return weight, value, gate, own


def train(texts: list[str], labels: list[int], seed: int = 10) -> Model:
    """Weights by stochastic gradient steps with adaptive rates; the same texts give the same model.

    The prior of the classes is that of the labels. With labels of one kind only, every score is near it.
    """
    draw = np.random.default_rng(seed)
    start = lambda *size: (draw.standard_normal(size) / np.sqrt(size[0])).astype(np.float32)
    m = Model(draw.standard_normal((FEATURES, HIDDEN)).astype(np.float32) * 0.3, np.zeros(HIDDEN, np.float32), start(HIDDEN, ATTENTION), start(HIDDEN, ATTENTION), start(ATTENTION), start(HIDDEN), np.zeros(1, np.float32))
    share = (sum(labels) + 1) / (len(labels) + 2)
    m.offset += np.log(share / (1 - share))
    bags, y = [bag(t) for t in texts], np.asarray(labels, dtype=np.float32)
    names = list(vars(m))
    first, second = ({n: np.zeros_like(getattr(m, n)) for n in names} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS if bags else 0):
        order = draw.permutation(len(bags))
        for begin in range(0, len(order), BATCH):
            rows = order[begin : begin + BATCH]
            x, starts = _counts([bags[r] for r in rows])
            hidden = np.tanh(x @ m.words + m.bias)
            weight, value, gate, own = _attend(m, hidden, starts)
            whole = np.add.reduceat(hidden * weight[:, None], starts)
            error = (1 / (1 + np.exp(-(whole @ m.last + m.offset))) - y[rows]) / len(rows)
            to_whole = error[:, None] * m.last
            to_weight = (hidden * to_whole[own]).sum(1)
            to_logit = weight * (to_weight - np.add.reduceat(weight * to_weight, starts)[own])
            to_value = to_logit[:, None] * m.weights * gate * (1 - value * value)
            to_gate = to_logit[:, None] * m.weights * value * gate * (1 - gate)
            to_hidden = (to_whole[own] * weight[:, None] + to_value @ m.values.T + to_gate @ m.gates.T) * (1 - hidden * hidden)
            gradient = {
                "words": x.T @ to_hidden, "bias": to_hidden.sum(0), "values": hidden.T @ to_value, "gates": hidden.T @ to_gate,
                "weights": (value * gate).T @ to_logit, "last": whole.T @ error, "offset": error.sum(keepdims=True),
            }
            step += 1
            for n in names:
                p, g = getattr(m, n), gradient[n] + DECAY * getattr(m, n) * (n != "offset")
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                rate = RATE * (1 - epoch / EPOCHS)
                p -= (rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return m


def _summed(m: Model, ids: np.ndarray) -> np.ndarray:
    """Sums of the feature vectors of each passage, some passages of a long text at a time."""
    parts = (ids[i : i + 64] for i in range(0, len(ids), 64))
    return np.concatenate([(m.words[part] * (part >= 0)[..., None]).sum(axis=1) for part in parts])


def score(m: Model, text: str) -> float:
    """Probability of label 1 of one text, and the same value for equal texts: all its passages, weighted."""
    ids = bag(text)
    known = ids >= 0
    hidden = np.tanh(_summed(m, ids) * (3 / np.maximum(1, known.sum(1)))[:, None] + m.bias)
    weight, *_ = _attend(m, hidden, np.zeros(1, dtype=int))
    logit = float((hidden * weight[:, None]).sum(0) @ m.last + m.offset[0])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and score, 0 to 1, higher for texts more likely good.

    The whole text is scored; null and empty texts are one empty passage. Nothing but the text enters a score, so
    equal texts score alike. Other columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "score": [float(score(m, t)) for t in batch.column("text").to_pylist()]}

    return mapped(docs.select(F.col(id_col).alias("doc_id"), filled(text_col).alias("text")), run, f"doc_id {kind}, score double", "word codes")


def trained(docs: DataFrame, labels: DataFrame, learn, limit: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> Model:
    return train(*labelled_sample(docs, labels, "quality", learn, limit, chars))
