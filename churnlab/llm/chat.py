r"""Chat formatting in token-budgeted windows, with DataFrame functions only.

Turns are numbered per conversation and their tokens prefix-summed (within buckets of turns, then over bucket totals,
so that one endless conversation is not one task's running sum).  The sum is laid over cells of ``capacity`` tokens
(the budget without the retained system turn and the repeated history): turns that lie inside one cell are a window,
a turn across a border is a window of its own.  So windows are spans of whole turns, no window has more new tokens
than the capacity unless one turn alone is longer (it is kept whole, ``over_budget`` says so), and every window is
found from the sums alone.  A window shows the leading system turn, then up to ``history`` tokens of whole turns before
it, then its own turns; repeated turns are masked, so each assistant text is a target once.

Format of a turn: ``<|im_start|>role\ntext<|im_end|>\n``.  Inside role and text ``\``, ``<`` and ``[`` (the first
characters of every control string of the common templates) are written ``\0``, ``\1``, ``\2``, a line end in a role
``\3``; the first characters of control strings then never stand in content and the writing can be undone exactly.

Rows: null text or role is empty; turns that tie are ordered by role, then text, and all stay; a null conv_id is a
conversation.  An empty table gives no windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BUCKET = 4096  # turns per running sum


def _swap(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape(c: Column) -> Column:
    return _swap(c, ESCAPES)


def unescape(c: Column) -> Column:
    """Escapes other than that of the escape character first; its own last."""
    return _swap(c, [(b, a) for a, b in reversed(ESCAPES)])


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\3"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\3"), F.lit("\n")))


def word_tokens(text: Column) -> Column:
    """Default token count of a turn: pieces between blanks, plus its marks."""
    return F.size(F.split(text, r"\s+")) + 4


def _numbered(df: DataFrame, tokens) -> DataFrame:
    """conv, no (from 0), role, text, before (tokens of all turns ahead), tokens."""
    t = df.select(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                  F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", tokens(F.col("text")).cast("long")).withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    inside = Window.partitionBy("conv", "bucket").orderBy("turn", "role", "text")
    t = (t.withColumn("no_in", F.row_number().over(inside) - 1)
         .withColumn("sum_in", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")))
    ahead = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (t.groupBy("conv", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("s"))
              .select(F.col("conv").alias("c"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"),
                      F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("s0")))
    return (t.join(totals, F.col("conv").eqNullSafe(F.col("c")) & F.col("bucket").eqNullSafe(F.col("b")))
            .select("conv", (F.col("no_in") + F.col("n0")).cast("long").alias("no"), "role", "text",
                    (F.col("sum_in") + F.col("s0")).cast("long").alias("before"), "tokens"))


def format_windows(df: DataFrame, budget: int = 2048, history: int = 512, target_role: str = "assistant", tokens=word_tokens) -> DataFrame:
    """conv_id, window, has_system, n_context (system and repeated turns at its start), n_turns, formatted, loss
    (spans (start, length) in code points: the targets), n_tokens, over_budget."""
    turns = cut_lineage(_numbered(df, tokens))
    leads = (F.col("no") == 0) & (F.col("role") == "system")
    system = turns.filter(leads).select(F.col("conv").alias("sc"), F.struct("role", "text", "tokens").alias("sys"))
    history = min(history, budget // 2)
    body = turns.filter(~leads).join(system.select("sc", F.col("sys.tokens").alias("st")), F.col("conv").eqNullSafe(F.col("sc")), "left")
    body = (body.withColumn("cap", F.greatest(F.lit(budget - history) - F.coalesce("st", F.lit(0)), F.lit(max(1, history))))
            .withColumn("at", F.col("before") - F.coalesce("st", F.lit(0)))
            .withColumn("cell", F.floor(F.col("at") / F.col("cap"))))
    last = F.floor((F.col("at") + F.greatest(F.col("tokens"), F.lit(1)) - 1) / F.col("cap"))
    body = body.withColumn("window", 2 * F.col("cell") + F.when(F.col("cell") == last, 0).otherwise(1))
    turn = ["conv", "window", "no", "role", "text", "tokens"]
    own = body.select(*turn, F.lit(False).alias("seen"))

    # a turn is repeated in the windows that start at most ``history`` tokens after its own start: this cell or the next
    starts = body.groupBy("conv", "window", "cap").agg(F.min("at").alias("start"))
    starts = starts.select(F.col("conv").alias("wc"), F.col("window").alias("ww"), "start", F.floor(F.col("start") / F.col("cap")).alias("wcell"))
    near = body.select(*turn, "at", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    again = (near.join(starts, F.col("conv").eqNullSafe(F.col("wc")) & (F.col("cell") == F.col("wcell")) & (F.col("window") < F.col("ww"))
                       & (F.col("at") + history >= F.col("start")))
             .select("conv", F.col("ww").alias("window"), *turn[2:], F.lit(True).alias("seen")))

    # every window shows the system turn; a conversation of nothing else is one window
    shown = [F.lit(-1).cast("long").alias("no"), F.col("sys.role").alias("role"), F.col("sys.text").alias("text"), F.col("sys.tokens").alias("tokens"),
             F.lit(True).alias("seen")]
    kept = starts.join(system, F.col("wc").eqNullSafe(F.col("sc"))).select(F.col("wc").alias("conv"), F.col("ww").alias("window"), *shown)
    alone = (system.join(body.select(F.col("conv").alias("bc")).distinct(), F.col("sc").eqNullSafe(F.col("bc")), "left_anti")
             .select(F.col("sc").alias("conv"), F.lit(0).cast("long").alias("window"), *shown))
    return _assembled(own.union(again).union(kept).union(alone), target_role).withColumn("over_budget", F.col("n_tokens") > budget)


def _assembled(turns: DataFrame, target_role: str) -> DataFrame:
    """One row per window; a window holds a budget's worth of turns, so its list is short."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    t = F.struct("no", F.concat(head, escape(F.col("text")), F.lit(CLOSE)).alias("piece"), F.length(head).alias("head"),
                 ((F.col("role") == target_role) & ~F.col("seen")).alias("target"), "seen", "tokens")
    w = turns.groupBy("conv", "window").agg(F.sort_array(F.collect_list(t)).alias("t"))
    w = w.withColumn("at", F.aggregate("t", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["piece"])))))
    spans = F.transform("t", lambda x, i: F.struct((F.get("at", i) + x["head"]).alias("start"),
                                                   (F.length(x["piece"]) - x["head"] - len(CLOSE)).alias("length"), x["target"].alias("target")))
    return w.select(F.col("conv").alias("conv_id"), "window", (F.get("t", F.lit(0))["no"] == -1).alias("has_system"),
                    F.size(F.filter("t", lambda x: x["seen"])).alias("n_context"), F.size("t").alias("n_turns"),
                    F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
                    F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
                    F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"))


def _turn(piece: Column) -> Column:
    """(role, text) of a formatted turn without its closing mark."""
    rest = F.substr(piece, F.lit(len(OPEN) + 1))
    role = F.substring_index(rest, "\n", 1)
    return F.struct(unescape_role(role).alias("role"), unescape(F.substr(rest, F.length(role) + 2)).alias("text"))


def read_windows(windows: DataFrame) -> DataFrame:
    """windows with ``turns``: the (role, text) that each window brings new, the system turn in a conversation's first."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    w = windows.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1)).join(
        windows.groupBy(F.col("conv_id").alias("fc")).agg(F.min("window").alias("fw")), F.col("conv_id").eqNullSafe(F.col("fc")))
    lead = F.when(F.col("has_system") & (F.col("window") == F.col("fw")), F.slice("pieces", 1, 1)).otherwise(F.array().cast("array<string>"))
    own = F.slice("pieces", F.col("n_context") + 1, F.greatest(F.size("pieces") - F.col("n_context"), F.lit(0)))
    return w.withColumn("turns", F.transform(F.concat(lead, own), _turn)).drop("pieces", "fc", "fw")


def conversation_digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from formatted windows.

    A digest covers a whole conversation, so its text is one string here (and only here)."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    w = read_windows(windows).select("conv_id", F.struct("window", said.alias("said"), loss.alias("loss")).alias("w"), F.size("turns").alias("n"),
                                     F.length("formatted").alias("chars"))
    per = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("w"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return per.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"),
                      F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.col("formatted_chars").cast("long").alias("formatted_chars"))
