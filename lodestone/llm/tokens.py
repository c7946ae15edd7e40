"""Fast, exact encoding with the ``tokenizers`` library.

A text is cut at single spaces, where the tokenizer would cut as well; what a piece becomes is
kept in a bounded memo, so that the library only sees pieces that are new to a worker.
Results equal ``Tokenizer.encode(text, add_special_tokens=False)``, special tokens' strings included.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import Memo

WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the word vocabulary's own pattern

_CUT = re.compile(r"(?<=\S) (?=\S)").split
_PLAIN = re.compile(r"[\n -~¡-ÿ]*").fullmatch
_ENDS = frozenset(".,;:!?")
_SIGNS = ".,;:!?#$%&*"  # behind a word they are one more
_made: dict[tuple, object] = {}


class _Odd(Exception):
    """White space beside white space: the quick cut isn't where the tokenizer cuts."""


def _visible_bytes() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a visible character: printable ones as themselves, the rest from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: b if b in shown else next(rest) for b in range(256)}


class Encoder:
    """encode(text) -> ids as little-endian unsigned 32-bit integers. kind: 'byte' or 'word'; pieces, words: the memos' limits."""

    def __init__(self, path: str, kind: str, pieces: int = 400_000, words: int = 200_000):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # the same merges without the library's own cache, which the memos stand in for
        suffix = {"end_of_word_suffix": model["end_of_word_suffix"]} if model.get("end_of_word_suffix") else {}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.model = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **suffix)
        self.table, self.kind = _visible_bytes(), kind
        self.space = chr(self.table[ord(" ")])
        self.words = regex.compile(PATTERN if kind == "byte" else WORD_PATTERN).findall
        self.memo = Memo(self._after_space if kind == "byte" else self._piece, pieces)
        self.word = Memo(self._word, words)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalnum():
            shown = word
        else:
            shown = self._shown(word)
        return self._ids(shown)

    def _shown(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table)

    def _ids(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str, before: str = "") -> bytes:
        """Ids of ``before`` (a space or nothing) and a piece."""
        if "<|" in piece or not _PLAIN(piece):
            return array("I", self.whole.encode(before + piece, add_special_tokens=False).ids).tobytes()
        if self.kind == "word":
            piece = piece.lower()
        if piece.isalpha():
            return self.word[before + piece]
        if piece[-1:] in _ENDS and piece[:-1].isalpha():
            return self.word[before + piece[:-1]] + self.word[piece[-1]]
        return b"".join(map(self.word.__getitem__, self.words(before + piece)))

    def _after_space(self, piece: str) -> bytes:
        stem = piece.rstrip(_SIGNS)
        if stem.isalpha() and _PLAIN(stem):  # most pieces: a word, with signs behind it or not; such words need no memo of their own
            if len(stem) < len(piece):
                return self.memo[stem] + self.word[piece[len(stem) :]]
            return self._ids(self.space + (piece if piece.isascii() else self._shown(piece)))
        if not piece or piece[-1].isspace():
            raise _Odd
        if piece[0] == "\n":  # the text has no space here
            if piece[1].isspace():
                raise _Odd
            return self.word["\n"] + self._piece(piece[1:])
        if piece[0].isspace():
            raise _Odd
        return self._piece(piece, " ")

    def encode(self, text: str) -> bytes:
        if self.kind == "word":  # white space only separates
            return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))
        try:
            first, *rest = text.replace("\n", " \n").split(" ")
            return self._piece(first) + b"".join(map(self.memo.__getitem__, rest))
        except _Odd:
            first, *rest = _CUT(text)
            return self._piece(first) + b"".join([self._piece(p, " ") for p in rest])


def encoder(path: str, kind: str, *limits: int) -> Encoder:
    """One per worker, vocabulary and limits of its memos."""
    if (path, kind, *limits) not in _made:
        _made[path, kind, *limits] = Encoder(path, kind, *limits)
    return _made[path, kind, *limits]
