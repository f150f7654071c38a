"""Conversation structure repair: the cheapest edits that give each conversation the role pattern ``(s?(ua)+)?``.

Letters of the edits: D delete, I insert an empty user or assistant turn, K keep, R give another role.  Keep costs 0, R
and I 3, D 4; a blank or repeated turn must go; a truncated turn that stays adds 3.  Of equally cheap edits the letters
that come first in ASCII order win.

The edits are paths of a graph: nodes are (turns read, state of the pattern), edges append a letter.  A path's weight is one
whole number: its high part is the cost, below it the letters follow as fixed-width digits from the left, zero where
there is none yet, so an edge adds cost and digit at its own place and the least integer decides cost and letters
together.  (Two paths to one node of equal cost never are one the beginning of the other: the same letters cost the same,
and each further letter is an insertion that costs.)  Conversations are streamed in order; digits that all live paths share are
written out and shifted away, so the numbers stay short and memory is that of the turns still undecided.

Roles are known by their first character (s, u, a; others are changed or deleted).  Null role and text are one blank; a null turn
sorts first; rows with one turn number are ordered by role and text; equal rows are repeated rows.  A null conv_id is a
conversation of its own.  A conversation whose rows are all dropped has zeros and empty texts.  An empty table gives an
empty result.  The digest of a conversation is one SHA-256 over its text: a very long conversation is one task's stream, of
constant memory, by definition of that digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, hash128

_BLANKS = " \t\n\x0b\f\r"
# states of the pattern: start, after s, after u, after a; the moves each allows
_START, _S, _U, _A = range(4)
_NEXT = {_START: {"s": _S, "u": _U}, _S: {"u": _U}, _U: {"a": _A}, _A: {"u": _U}}
_INSERT = {_START: _U, _S: _U, _U: _A, _A: _U}
_LETTERS = "\0DIKR"
_D, _I, _K, _R = range(1, 5)
COSTS = {"rerole": 3, "delete": 4, "insert": 3, "truncated": 3}
#: turns after which the shared digits are written out
_BLOCK = 32
_REPAIRED = ("conv_id string, at long, role string, text string, edits string, gaps long, blank long, duplicate long, "
             "truncated long, illegal long, cost long")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: one of five kinds of damage by crc32(``conv_id:turn``) % 20, rows repeated in place.

    ``gone`` rows are dropped ones, kept without content so that their conversation is still known."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind, role, text = F.col("kind"), F.coalesce("role", blank), F.coalesce("text", blank)
    r = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("kind"))
    r = r.select("conv_id", "turn", F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                 F.when(kind <= 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                 (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return r.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def _faults(rows: DataFrame) -> DataFrame:
    """rows with ``blank``, ``open_end`` (not closed by a mark) and ``first_turn`` of their (role, text), null where unique."""
    h1, h2 = hash128(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    r = rows.withColumns({"h1": h1, "h2": h2, "conv": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))})
    often = (r.filter(~F.col("gone")).groupBy("conv", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"),
                                                                      F.max(F.col("turn").isNull()).alias("first_null"))
             .filter("n > 1").drop("n"))
    often = cut_lineage(often)  # a written table: rows of a hot (role, text) can be split over tasks
    last = F.substring(F.rtrim(F.col("text"), F.lit(_BLANKS)), -1, 1)
    return (r.join(often, ["conv", "h1", "h2"], "left")
            .withColumn("later", F.col("turn").isNotNull() & F.coalesce(F.col("first_null") | (F.col("turn") > F.col("first_turn")), F.lit(False)))
            .withColumns({"blank": last == "", "open_end": ~last.isin(".", "!", "?")}))


class _Conversation:
    """Streams one conversation: ``turn`` per row, then ``end``; both return what is decided so far."""

    def __init__(self, name):
        self.name, self.at = name, 0
        self.live = {_START: (0, 0)}  # state -> (weight, letters written)
        self.base = 0  # cost taken off the weights
        self.width = 3 * _BLOCK + 2
        self.rows: list[tuple[str, str]] = []  # undecided turns
        self.letters = ""  # decided deletions in front of the next output row
        self.number = 0  # output rows so far
        self.first_initial = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.last_turn = None
        self.last = None
        self.pending: list[tuple[str, str, str]] = []
        self.letters_out: list[int] = []  # decided letters not yet matched with output rows

    def _step(self, weight: tuple[int, int], letter: int, cost: int) -> tuple[int, int]:
        value, n = weight
        return value + (cost << 3 * self.width) + (letter << 3 * (self.width - 1 - n)), n + 1

    def _inserted(self) -> None:
        """Up to two insertions reach every state that a further one could."""
        reach = self.live
        for _ in range(2):
            came = {}
            for q, w in reach.items():
                to, x = _INSERT[q], self._step(w, _I, COSTS["insert"])
                if to not in came or x < came[to]:
                    came[to] = x
            for q, x in came.items():
                if q not in self.live or x < self.live[q]:
                    self.live[q] = x
            reach = came

    def turn(self, turn, role: str, text: str, blank: bool, open_end: bool, later: bool) -> None:
        if turn is not None:
            if self.low is None:
                self.low, self.distinct = turn, 1
            elif turn != self.high:
                self.distinct += 1
            self.high = turn
        initial = role[:1]
        if self.last is not None and self.last[1][:1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        repeated = later or self.last == (turn, role, text)
        self.last = (turn, role, text)
        truncated = False
        if blank:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif open_end:
            self.truncated += 1
            truncated = True
        self._inserted()
        came = {}

        def offer(q, x):
            if q not in came or x < came[q]:
                came[q] = x

        more = COSTS["truncated"] if truncated else 0
        for q, w in self.live.items():
            offer(q, self._step(w, _D, COSTS["delete"]))
            if blank or repeated:
                continue
            for letter, to in _NEXT[q].items():
                if letter == initial:
                    offer(to, self._step(w, _K, more))
                elif letter != "s":
                    offer(to, self._step(w, _R, COSTS["rerole"] + more))
        # a path that has read nothing can do better than one after an assistant turn by one system turn (a deletion) at most
        if _A in came:
            cost = {q: v >> 3 * self.width for q, (v, _) in came.items()}
            if _START in came and cost[_START] > cost[_A] + COSTS["delete"]:
                del came[_START]
            if _S in came and cost[_S] > cost[_A]:
                del came[_S]
        self.live = came
        self.rows.append((role, text))
        self.n_turns += 1
        if self.n_turns % _BLOCK == 0:
            self._settle()

    def _digits(self, value: int, n: int) -> list[int]:
        return [value >> 3 * (self.width - 1 - k) & 7 for k in range(n)]

    def _settle(self) -> None:
        """Writes out the digits that all live paths share; the weights go on with the rest."""
        mask = (1 << 3 * self.width) - 1
        low = [v & mask for v, _ in self.live.values()]
        shortest = min(n for _, n in self.live.values())
        differ = 0
        for v in low:
            differ |= v ^ low[0]
        same = shortest if not differ else min(shortest, (3 * self.width - differ.bit_length()) // 3)
        self.letters_out += self._digits(low[0], same)
        least = min(v >> 3 * self.width for v, _ in self.live.values())
        self.base += least
        longest = max(n for _, n in self.live.values()) - same
        width = longest + 3 * _BLOCK + 2
        live = {}
        for q, (v, n) in self.live.items():
            rest = (v & mask) & ((1 << 3 * (self.width - same)) - 1)  # digits after the shared ones
            shift = 3 * (width - (self.width - same))
            rest = rest << shift if shift >= 0 else rest >> -shift
            live[q] = (((v >> 3 * self.width) - least) << 3 * width | rest, n - same)
        self.live, self.width = live, width
        self._emit()

    def _emit(self) -> None:
        """Decided letters become rows; a row's role follows from its place in the pattern."""
        done = 0
        for letter in self.letters_out:
            self.letters += _LETTERS[letter]
            if letter == _I:
                role, text = ("user" if self._place() == "u" else "assistant"), ""
            else:
                role, text = self.rows[done]
                done += 1
                if letter == _D:
                    continue
                if letter == _R:
                    role = "user" if self._place() == "u" else "assistant"
            if self.number == 0:
                self.first_initial = role[:1]
            self.pending.append((role, text, self.letters))
            self.letters = ""
            self.number += 1
        self.letters_out = []
        del self.rows[:done]

    def _place(self) -> str:
        """Letter of the next output row, if it is not a kept one: user and assistant in turns."""
        if self.number == 0:
            return "u"
        k = self.number - (1 if self.first_initial == "s" else 0)
        return "u" if k % 2 == 0 else "a"

    def end(self) -> tuple:
        self._inserted()
        ends = [w for q, w in self.live.items() if q in (_START, _A)]
        best = min(ends)
        mask = (1 << 3 * self.width) - 1
        cost = self.base + (best[0] >> 3 * self.width)
        self.letters_out += self._digits(best[0] & mask, best[1])
        self._emit()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.letters, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost


def _repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _REPAIRED.split(", ")]
    conv, out = None, []

    def rows_of(c):
        got = [(c.name, c.at + k, role, text, letters, *[None] * 6) for k, (role, text, letters) in enumerate(c.pending)]
        c.at += len(got)
        c.pending = []
        return got

    def closing(c):
        letters, *counts = c.end()
        return [*rows_of(c), (c.name, c.at, None, None, letters, *counts)]

    def frame(rows):
        f = pd.DataFrame(rows, columns=columns)
        for c in columns[5:]:
            f[c] = f[c].astype("Int64")
        return f

    for pdf in frames:
        turns = [None if pd.isna(t) else int(t) for t in pdf["turn"]]
        for key, turn, role, text, gone, blank, open_end, later in zip(pdf["conv"], turns, pdf["role"], pdf["text"], pdf["gone"], pdf["blank"], pdf["open_end"], pdf["later"]):
            key = key[1:] if key else None
            if conv is None or key != conv.name:
                if conv is not None:
                    out += closing(conv)
                conv = _Conversation(key)
            if not gone:
                conv.turn(turn, role, text, blank, open_end, later)
                if conv.pending:
                    out += rows_of(conv)
            if len(out) >= 5000:
                yield frame(out)
                out = []
    if conv is not None:
        out += closing(conv)
    if out:
        yield frame(out)


def repair_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id (text), at (place from 0), role, text, edits (letters up to and with this row).

    A closing row per conversation (null role) has the letters after its last row, the counts of faults and the cost.
    ``rows`` as :func:`damage` gives them.  Rows of one conversation lie together in order, so the result can be streamed on."""
    r = _faults(rows).repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    return r.select("conv", F.col("turn").cast("string").alias("turn"), "role", "text", "gone", "blank", "open_end", "later").mapInPandas(_repair, _REPAIRED)


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    sha, audit, first, done = hashlib.sha256(), [], True, []
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def frame():
        f = pd.DataFrame(done, columns=columns)
        for c in columns[1:7]:
            f[c] = f[c].astype("Int64")
        return f

    for pdf in frames:
        for key, role, text, letters, *counts in zip(pdf["conv_id"], pdf["role"], pdf["text"], pdf["edits"], *[pdf[c] for c in columns[1:7]]):
            audit.append(letters)
            if not pd.isna(role):
                sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
                continue
            done.append((None if pd.isna(key) else key, *counts, "".join(audit), sha.hexdigest()))
            sha, audit, first = hashlib.sha256(), [], True
        if done:
            yield frame()
            done = []


def repair_digests(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the damaged ``rows``."""
    got = repair_rows(damage(rows)).mapInPandas(
        _digest, "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return got.withColumn("conv_id", F.col("conv_id").cast("long"))
