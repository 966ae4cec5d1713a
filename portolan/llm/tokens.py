"""Operator 6: token counts by batch encoding, and the piece encoder that packing shares.

A text is split at spaces, tabs and line ends. The tokenizer drops white space, never joins
characters across it and normalises each side alone, so the tokens of a text are those of its
pieces in order. Pieces repeat far more often than texts, so each batch encodes only the
distinct pieces it does not know yet, and a bounded memo keeps those for later batches.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.shared import MEMOS, balanced, filled, mapped

BATCH_BYTES = 1 << 20
MEMO_PIECES = 180_000
MEMO_PIECE_CHARS = 200
JOINED_BYTES, JOINED_PIECES = 100_000, 10_000
#: Stands alone between pieces, where it is one token; pieces that hold it are encoded by themselves.
MARK = "|"
#: Lines of Latin letters, without and with stops behind them, by (ASCII only, number of words): stops begin a token of their own.
_STOPS, _MORE = r"[.,;:!?*#%&$]+", r"\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = {
    (ascii_only, words): re.compile(rf"(?m)^{'' if ascii_only else f'(?=[A-Za-z]*[{_MORE}])'}[A-Za-z{'' if ascii_only else _MORE}]+{_STOPS if words == 2 else ''}$")
    for ascii_only in (True, False) for words in (1, 2)
}
STOPS_BEHIND = re.compile(rf"({_STOPS})")


def load(path: str):
    """The tokenizer in a file of the ``tokenizers`` library; threads are left to Spark."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(text: str) -> list[str]:
    """Pieces whose tokens, one after the other, are the tokens of ``text``.

    Python takes the separators U+001C to U+001F for white space, the tokenizer does not: with them, only blanks and line ends split.
    """
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    return text.split()


class PieceEncoder:
    """Encodes byte-balanced batches of texts; of a piece's ids it keeps their number, or their bytes as ``kind``. Values of pieces add up."""

    def __init__(self, path: str, kind: str | None = None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.kind = load(path), kind
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.mark = ids(MARK)[-1]
        if ids(MARK) != [self.mark] or ids(f" aB {MARK}  c") != [*ids("ab"), self.mark, *ids("c")]:
            raise ValueError(f"{path}: only tokenizers that drop case and white space are split at white space")
        # Words of small Latin letters need no normalizing and no pattern: the same model behind a plain split gives their ids.
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.asarray([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self.lean = {}
        for ascii_only, splits in ((True, WhitespaceSplit()), (False, Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)]))):
            lean = Tokenizer(self.tokenizer.model)
            lean.pre_tokenizer = splits
            sample = "the quick zebra unbelievably xqzjw a of" + ("" if ascii_only else " \u00e9t\u00e9 stra\u00dfe \u00f1o\u00f1o \u00fc na\u00efvet\u00e9")
            got = np.asarray(lean.encode(sample, add_special_tokens=False).ids)
            if got.tolist() == ids(sample) and int(self.ends_word[got].sum()) == len(sample.split()):
                self.lean[ascii_only] = lean
        self.memo, self.before = {}, {}

    def _remember(self, words: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Keep the values of ``words``, whose ids lie in a row, ``gap`` further ones between them."""
        starts = np.append(0, ends[:-1] + gap)
        if self.kind is None:
            self.memo.update(zip(words, (ends - starts).tolist(), strict=True))
            return
        data, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        self.memo.update((word, data[a:b]) for word, a, b in zip(words, (starts * width).tolist(), (ends * width).tolist(), strict=True))

    def _learn(self, new: list[str]) -> None:
        """Put ``new`` pieces into the memo: words of Latin letters through the plain split, others as one text with marks between them."""
        rest, lines = set(new), "\n".join(new)
        for (ascii_only, words), pattern in PLAIN.items():
            lean = self.lean.get(ascii_only)
            own = pattern.findall(lines) if lean else []
            rest.difference_update(own)
            for at in range(0, len(own), JOINED_PIECES):
                part = own[at : at + JOINED_PIECES]
                joined = " ".join(part).lower()
                joined = STOPS_BEHIND.sub(r" \1", joined) if words == 2 else joined
                ids = np.asarray(lean.encode_batch_fast([joined], add_special_tokens=False)[0].ids)
                self._remember(part, ids, np.flatnonzero(self.ends_word[ids])[words - 1 :: words] + 1, 0)
        marked = [p for p in rest if MARK not in p]
        for part in balanced(marked, JOINED_BYTES):
            ids = np.asarray(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids)
            self._remember(part, ids, np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)
        for piece in rest.difference(marked):
            ids = np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=np.int64)
            self._remember([piece], ids, np.asarray([len(ids)]), 0)

    def _recall(self, wanted: set[str]) -> set[str]:
        """Those of ``wanted`` that are not in the older memo either; what it has is taken over."""
        old = wanted.intersection(self.before)
        self.memo.update(zip(old, map(self.before.__getitem__, old), strict=True))
        return wanted.difference(old)

    def texts(self, texts: list[str], joined) -> Iterator:
        """``joined`` of the values of the pieces of each text, in order."""
        for batch in balanced(texts, BATCH_BYTES):
            if len(self.memo) > MEMO_PIECES:  # a full memo is kept once more, for what is still in use
                self.memo, self.before = {}, self.memo
            split = [pieces(t) for t in batch]
            found = [list(map(self.memo.get, own)) for own in split]
            new = self._recall({p for own, values in zip(split, found, strict=True) if None in values for p in compress(own, [v is None for v in values])})
            self._learn(list(new))
            for own, values in zip(split, found, strict=True):
                yield joined([self.memo[p] if v is None else v for p, v in zip(own, values, strict=True)] if None in values else values)
            for piece in [p for p in new if len(p) > MEMO_PIECE_CHARS]:
                self.memo.pop(piece, None)


_ENCODERS: dict[tuple[str, str | None], PieceEncoder] = MEMOS.setdefault("word pieces", {})


def _encoder(path: str, kind: str | None) -> PieceEncoder:
    """The one encoder this Python worker holds; another one takes its place."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, kind] = PieceEncoder(path, kind)
    return _ENCODERS[path, kind]


def counter(path: str) -> PieceEncoder:
    """The encoder of this Python worker that keeps lengths only."""
    return _encoder(path, None)


def id_encoder(path: str, kind: str) -> PieceEncoder:
    """The encoder of this Python worker that keeps ids as little-endian bytes of ``kind``."""
    return _encoder(path, kind)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` of its UTF-8 text and ``n_tokens``.

    Null and empty texts have 0 of both. Special strings inside a text count as the library
    counts them by default; none are added. Repeated rows are counted each, other columns are
    ignored, an empty table gives an empty table. ``tokenizer_path`` must exist on the workers.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), filled(text_col).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def count(batches):
        encoder = counter(tokenizer_path)
        for batch in batches:
            lengths = list(encoder.texts(batch.column("text").to_pylist(), sum))
            yield {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": lengths}

    kind = dict(rows.dtypes)["doc_id"]
    return mapped(rows, count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint", "word pieces")
