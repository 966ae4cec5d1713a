"""Ids of whole texts by a byte-level tokenizer, encoded piece by piece with a bounded memo.

A byte-level tokenizer first cuts a text where white space begins and gives a word the one space before
it; nothing is joined across such a cut. Cutting there beforehand therefore leaves the ids as they are, and
as words repeat, most pieces are known already. Texts in which white space is not single spaces and line
ends between words take other, safe paths.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np

from portolan.llm.shared import MEMOS, balanced
from portolan.llm.tokens import PLAIN, STOPS_BEHIND, id_type, load

BATCH_BYTES, JOINED_BYTES, JOINED_PIECES = 1 << 20, 200_000, 10_000
MEMO_PIECES, MEMO_PIECE_CHARS = 500_000, 100
#: White space beyond that which is cut at, and pairs in which a space is not the only white space between words.
_ODD = re.compile(r"[^\S \t\n\r]")
_PAIRS = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")
_PIECES = re.compile(r"\s*\S+|\s+")


class ByteEncoder:
    """Ids of texts as little-endian bytes of ``kind``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = load(path)
        layout = json.loads(self.tokenizer.to_str())
        pre = layout["pre_tokenizer"] or {}
        if layout["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level tokenizers without a normalizer are cut at white space")
        # Words of Latin letters, and stops behind them, are written in the tokenizer's byte alphabet here: the same model behind a plain split gives their ids.
        letters, spell = "".join(map(chr, range(0xC0, 0x100))), ByteLevel(add_prefix_space=False, use_regex=False)
        self.beyond_ascii = str.maketrans({c: spell.pre_tokenize_str(c)[0][0] for c in letters + " "})
        self.space = self.beyond_ascii.pop(ord(" "))
        self.lean = Tokenizer(self.tokenizer.model)
        self.lean.pre_tokenizer = WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        self.kind = id_type(size)
        self.sizes = np.asarray([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])  # one character stands for a byte
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, part: list[str], ids: list[int], ascii_only: bool) -> None:
        """Keep the ids of pieces that lie in a row: each ends where its bytes do."""
        ids, width = np.asarray(ids, dtype=np.int64), np.dtype(self.kind).itemsize
        sizes = [len(p) + 1 for p in part] if ascii_only else [len(p.encode()) + 1 for p in part]
        ends = ((np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 1) * width).tolist()
        data = ids.astype(self.kind).tobytes()
        self.memo.update((p, data[a:b]) for p, a, b in zip(part, [0, *ends], ends, strict=False))

    def _learn(self, new: list[str]) -> None:
        """Put the ids of pieces (each with one space before it) into the memo: many are one text."""
        inner = [p for p in new if not p or "\n" in p or "\t" in p or "\r" in p or "<|" in p]
        rest = set(new).difference(inner)
        lines = "\n".join(rest)
        for (ascii_only, words), pattern in PLAIN.items():
            own = pattern.findall(lines)
            rest.difference_update(own)
            for at in range(0, len(own), JOINED_PIECES):
                part = own[at : at + JOINED_PIECES]
                joined = self.space + f" {self.space}".join(part)
                joined = STOPS_BEHIND.sub(r" \1", joined) if words == 2 else joined
                joined = joined if ascii_only else joined.translate(self.beyond_ascii)
                self._remember(part, self.lean.encode_batch_fast([joined], add_special_tokens=False)[0].ids, ascii_only)
        others = list(rest)
        for at in range(0, len(others), JOINED_PIECES):
            part = others[at : at + JOINED_PIECES]
            self._remember(part, self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, False)
        for piece, ids in zip(inner, self._whole([f" {p}" for p in inner]) if inner else (), strict=True):
            self.memo[piece] = ids

    def _cut(self, text: str) -> list[str] | None:
        """Pieces of a text, all but the first without the space before them; None if it isn't cut so."""
        return None if _ODD.search(text) or any(p in text for p in _PAIRS) else text.split(" ")

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        for batch in balanced(texts, BATCH_BYTES):
            if len(self.memo) > MEMO_PIECES:  # a full memo is kept once more, for what is still in use
                self.memo, self.before = {}, self.memo
            cut = [self._cut(t) for t in batch]
            found = [list(map(self.memo.get, own)) if own else [] for own in cut]
            wanted = {p for own, values in zip(cut, found, strict=True) if None in values for p in compress(own, [v is None for v in values])}
            known = wanted.intersection(self.before)
            self.memo.update(zip(known, map(self.before.__getitem__, known), strict=True))
            new = list(wanted.difference(known))
            self._learn(new)
            firsts = iter(self._whole([own[0] for own in cut if own]))
            for text, own, values in zip(batch, cut, found, strict=True):
                if own:
                    if None in values:
                        values = [self.memo[p] if v is None else v for p, v in zip(own, values, strict=True)]
                    values[0] = next(firsts)  # no space before it
                    yield b"".join(values)
                elif _ODD.search(text):
                    yield self._whole([text])[0]
                else:
                    yield b"".join(b"".join(self._whole(part)) for part in balanced(_PIECES.findall(text), JOINED_BYTES))
            for piece in [p for p in new if len(p) > MEMO_PIECE_CHARS]:
                self.memo.pop(piece, None)


_HELD: dict[str, ByteEncoder] = MEMOS.setdefault("byte pieces", {})


def byte_encoder(path: str) -> ByteEncoder:
    """The one encoder of this kind that this Python worker holds, with its memo."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = ByteEncoder(path)
    return _HELD[path]
