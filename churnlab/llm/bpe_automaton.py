"""BPE as a deterministic automaton over tokens.

Start: one state that loops on every base symbol.  Merges are applied in rank order, each by a merge gadget.  For
the merge (u, v) -> w:

* the state behind arc u loses its arc v (u directly followed by v would have been merged);
* every state that has arc u (and, behind it, arc v) gets an arc w, which leads to a copy of the state behind v;
* for u = v the state behind u gets no arc w: a run of u is paired from the left.

So there is one state per token (the state entered by its arc) plus the start.  The gadgets are kept as they were
applied: arc w of a state is an arc u of that state at that time, a copied state has its model's arcs at the time of
copying, a removed arc is gone from that time on.  Looking an arc up follows these records back and enters the answer
in the transition table, so the table holds the part of the automaton that the texts reach.

Exactly one path of the automaton spells a given word: its BPE tokenisation.  Encoding walks the word once; every
prefix is reached by one path, so one state per place is enough.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .encode import Made, TextEncoder

START = -1


class TokenAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list, end: str = "", table_limit: int = 2_000_000):
        self.label = {i: t for t, i in vocab.items()}
        self.rank: dict[int, int] = {}  # token -> gadget that made it
        self.parts: dict[int, tuple[int, int]] = {}
        self.removed: dict[tuple[int, int], int] = {}  # (token whose state, arc) -> gadget that took the arc away
        for k, merge in enumerate(merges):
            u, v = merge if isinstance(merge, (list, tuple)) else merge.split(" ")
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            self.removed.setdefault((a, b), k)
            if w not in self.rank:
                self.rank[w], self.parts[w] = k, (a, b)
        self.end = end
        self.tails: dict = {}  # tokens spelt backwards
        self.word_tails: dict = {}  # those with the word-end mark
        for t, i in vocab.items():
            last = end and t.endswith(end) and len(t) > len(end)
            node = self.word_tails if last else self.tails
            for ch in reversed(t.removesuffix(end) if last else t):
                node = node.setdefault(ch, {})
            node[""] = i
        self.word, self.state, self.back = "", [START], [0]  # the last word's walk
        self.table: dict[tuple[int, int], bool] = {}
        self.table_limit = table_limit

    def has_arc(self, state: int, arc: int, time: float) -> bool:
        """Whether the state had the arc before gadget ``time``."""
        while True:
            made = self.rank.get(arc, -1)
            if made >= time or self.removed.get((state, arc), time) < time:
                return False
            born = -1 if state == START else self.rank.get(state, -1)
            if born < 0 or made >= born:  # the arc is a base symbol's, or was added to this state by its own gadget
                if made < 0:
                    return True
                u, v = self.parts[arc]
                if u == v == state:
                    return False
                return self.has_arc(u, v, made) and self.has_arc(state, u, made)
            state, time = self.parts[state][1], born  # the state was copied with this arc in it, or without

    def step(self, state: int, arc: int) -> bool:
        got = self.table.get((state, arc))
        if got is None:
            if len(self.table) > self.table_limit:
                self.table.clear()
            got = self.table[state, arc] = self.has_arc(state, arc, float("inf"))
        return got

    def encode(self, word: str) -> list[int]:
        """The tokens of a word of base symbols; its last symbol carries the word-end mark, if there is one.

        state[j] is the state after the first j symbols.  Only one arc can lead there, so the search over arcs that
        end at j stops at the first that the state before it has.  What the last word had in common stays.
        """
        n, state, back, keep = len(word), self.state, self.back, 0
        for a, b in zip(word[:-1], self.word[:-1], strict=False):
            if a != b:
                break
            keep += 1
        del state[keep + 1:], back[keep + 1:]
        self.word, table = word, self.table
        for j in range(keep + 1, n + 1):
            node = self.word_tails if j == n and self.end else self.tails
            for i in range(j - 1, -1, -1):
                node = node.get(word[i])
                if node is None:
                    break
                arc = node.get("")
                if arc is not None:
                    ok = table.get((state[i], arc))
                    if self.step(state[i], arc) if ok is None else ok:
                        state.append(arc)
                        back.append(i)
                        break
            if len(state) <= j:
                self.word, self.state, self.back = "", [START], [0]
                raise ValueError(f"no path for {word!r}")
        out, j = [], n
        while j:
            out.append(state[j])
            j = back[j]
        return out[::-1]


class WordBpe:
    """Texts to ids and back for a tokenizer file of the word-end kind (normalise, pre-split, byte letters, end mark).

    Units between spaces or line ends are encoded once per worker (``limit`` bounds how many are kept); characters
    never join over them in normalisation or pre-splitting.  Strings of added tokens are cut out first and get their
    own ids, as the library does.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        conf = json.loads(open(path, encoding="utf-8").read())
        model = conf["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.automaton = TokenAutomaton(model["vocab"], model["merges"], self.end)
        self.added = {t["content"]: t["id"] for t in conf.get("added_tokens", [])}
        labels = self.automaton.label | {i: t for t, i in self.added.items()}
        self.label = [labels.get(i, "") for i in range(max(labels) + 1)]
        self.vocab = model["vocab"]
        self.tok = Tokenizer.from_file(path)  # its normaliser and pre-splitter only
        pre = (conf.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        keeps = pre.get("type") == "Split" and pre.get("behavior") == "Removed" and pre.get("invert")
        self.split = regex.compile(pre["pattern"]["Regex"]) if keeps else None
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        table = TextEncoder._byte_letters()
        self.letters = {i: table[i] for i in range(256)}
        self.limit, self.units, self.pieces = limit, Made(self._unit), {}

    def _word(self, piece: str) -> bytes:
        """``piece``: byte letters."""
        got = self.pieces.get(piece)
        if got is None:
            got = self.pieces[piece] = array("I", self.automaton.encode(piece)).tobytes()
        return got

    def _normal(self, unit: str) -> str:
        if unit.isascii() and len(unit.split()) == 1 and unit.isprintable():
            return unit.lower()
        if unit.isalpha() and max(unit) < "\u0250":  # Latin letters: composed, then lower-cased
            return unicodedata.normalize("NFC", unit).lower()
        return self.tok.normalizer.normalize_str(unit) if self.tok.normalizer else unit

    def _segment(self, unit: str) -> bytes:
        s = self._normal(unit)
        if s.isalpha():  # one run of letters is one word
            return self._word(s.encode().decode("latin-1").translate(self.letters))
        if len(s) > 1 and s[-1] in ".,;:!?" and s[:-1].isalpha():
            return self._word(s[:-1].encode().decode("latin-1").translate(self.letters)) + self._word(s[-1])
        if self.split and s and max(s) < "\u0250":
            return b"".join(self._word(p.encode().decode("latin-1").translate(self.letters)) for p in self.split.findall(s))
        return b"".join(self._word(p) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(s) if p)

    def _unit(self, unit: str) -> bytes:
        if not unit:
            return b""
        if self.cut and "<" in unit:
            return b"".join(np.array([self.added[s]], dtype="<u4").tobytes() if s in self.added else self._segment(s)
                            for s in self.cut.split(unit) if s)
        return self._segment(unit)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.units) > self.limit or len(self.pieces) > self.limit:  # a bound on memory; what is needed again is encoded again
            self.units.clear()
            self.pieces.clear()
        return b"".join(map(self.units.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, ids: list[int]) -> str:
        """Arc labels, joined as the library joins them when a tokenizer has no decoder."""
        return " ".join(itemgetter(*ids)(self.label)) if len(ids) > 1 else "".join(self.label[i] for i in ids)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<long>) per row, no shuffle.  Null text: no ids."""
    texts = texts_of(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for b in batches:
            ids = [np.frombuffer(bpe.encode(t), dtype="<u4").astype(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<bigint>")


def decode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the labels of each row's ids.  Null ids: empty text."""
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<bigint>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row, encoded and decoded in one pass over the texts.

    Every row is one document; null text is empty (no ids, digest of nothing); repeated rows repeat their result."""
    texts = texts_of(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                raw = bpe.encode(text)
                ids = np.frombuffer(raw, dtype="<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
