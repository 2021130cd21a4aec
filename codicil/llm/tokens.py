"""Token ids of the public tokenizers, with a bounded memo of word pieces.

A text is cut at places where the tokenizer's own pre-tokenizer always cuts, so the ids
of the pieces, one after the other, are the ids of the text.  Words repeat, so most pieces
come from the memo and the library encodes each different piece about once per worker.
Texts with control characters on which Python and the tokenizer may disagree are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

from codicil.llm.common import Memo, kept

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2

_CONTROL = re.compile("[\x1c-\x1f]")
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_WORD_AND_MARKS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,:;!?|]+)")
_RUNS = re.compile(r"\s*\S+|\s+")


def tokenizer_path(name_or_path: str) -> str:
    """The file of a public tokenizer by name, or the path itself."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers use for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes, without an end id."""

    def __init__(self, name_or_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path(name_or_path))
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        #: Whether white space vanishes between pieces, or goes with the piece that follows.
        self._drops_space = self._direct("a b") == self._direct("a") + self._direct("b")
        self._lowers = self._direct("A") == self._direct("a")
        self._whole = Memo(lambda x: self._piece("", x))
        self._spaced = self._whole if self._drops_space else Memo(lambda x: self._piece(" ", x))

    def _direct(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, before: str, piece: str) -> bytes:
        if piece[:1] == "\n":
            before = ""
        if m := _WORD.fullmatch(piece):  # one pre-token, for which the model alone does
            word = (before + (piece.lower() if self._lowers else piece)).encode().decode("latin-1").translate(self._letters)
            return array("I", [x.id for x in self._model.tokenize(word)]).tobytes()
        if m := _WORD_AND_MARKS.fullmatch(piece):
            return (self._spaced if before else self._whole)[m[1]] + self._whole[m[2]]
        return self._direct(before + piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _CONTROL.search(text) or "<|" in text:
            return self._direct(text)
        if self._drops_space:
            return b"".join(map(self._whole.__getitem__, text.split()))
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
            return b"".join(map(self._whole.__getitem__, _RUNS.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self._whole[first] if first else b"") + b"".join(map(self._spaced.__getitem__, rest))


def encoder(name_or_path: str) -> Encoder:
    """One encoder per Python worker, as long as that goes on with the same tokenizer."""
    return kept(("encoder", name_or_path), lambda: Encoder(name_or_path))
