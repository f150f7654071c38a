"""Cached encoding of whole texts with the tokenizers library (byte-level BPE).

A text is cut at single spaces whose two neighbours are not white space: byte-level pre-tokenisation never joins
characters over such a cut (the space goes to the following piece), so the ids of the text are the ids of its
units in a row.  Each worker keeps the ids of units it has seen; the library runs once per unit, not per occurrence.
Layouts outside this form (other pre-tokenisers, special-token strings in the text) go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import regex

_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_PUNCT = frozenset('.,;:!?)("')
# fixed value: the pre-split of byte-level BPE
_BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Made(dict):
    """A dictionary that makes what it lacks."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        got = self[key] = self.make(key)
        return got


class TextEncoder:
    """encode(text) -> little-endian unsigned 32-bit ids; ``limit`` bounds the units kept per worker."""

    def __init__(self, path: str, limit: int = 700_000, special_as_text: bool = False):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = special_as_text
        conf = json.loads(self.tok.to_str())
        pre = conf.get("pre_tokenizer") or {}
        self.by_unit = (conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
                        and not pre.get("add_prefix_space") and conf["model"]["type"] == "BPE")
        self.special = [] if special_as_text else [t["content"] for t in conf.get("added_tokens", [])]
        self.limit, self.units, self.pieces = limit, Made(self._unit), {}
        table = self._byte_letters()
        self.letters = {i: table[i] for i in range(256)}

    @staticmethod
    def _byte_letters() -> list[str]:
        """The printable letter of each byte in byte-level BPE: visible Latin-1 bytes stay, the rest follow from U+0100."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if piece.isascii() and piece.isprintable():  # of these bytes only the blank has another letter
                mapped = piece.replace(" ", self.letters[32])
            else:
                mapped = piece.encode().decode("latin-1").translate(self.letters)
            got = self.pieces[piece] = array("I", [t.id for t in self.tok.model.tokenize(mapped)]).tobytes()
        return got

    def _pieces(self, text: str) -> bytes:
        if max(text) < "\u0250":  # letters that no Unicode version sorts otherwise: pre-split here
            return b"".join(map(self._piece, _BYTE_SPLIT.findall(text)))
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        """A unit that follows a blank."""
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise _Unsafe
        if unit.isalpha():  # one run of letters is one piece
            return self._piece(" " + unit)
        if len(unit) > 1 and unit[-1] in _PUNCT and unit[:-1].isalpha():
            return self._piece(" " + unit[:-1]) + self._piece(unit[-1])
        return self._pieces(" " + unit)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_unit or any(s in text for s in self.special):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.units) > self.limit or len(self.pieces) > self.limit:  # a bound on memory; what is needed again is encoded again
            self.units.clear()
            self.pieces.clear()
        cuts = text.split(" ")
        first = cuts.pop(0)
        try:
            if first[-1:].isspace() or not first:
                raise _Unsafe
            return self._pieces(first) + b"".join(map(self.units.__getitem__, cuts))
        except _Unsafe:  # blanks beside white space: only some of them are cuts
            first, *rest = _SAFE_CUT.split(text)
            return self._pieces(first) + b"".join(self._pieces(" " + u) for u in rest)


class _Unsafe(Exception):
    """A blank beside other white space."""


@lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = False) -> TextEncoder:
    """One encoder per worker process and tokenizer file."""
    return TextEncoder(path, special_as_text=special_as_text)
