"""Chat windows and byte shards: exact round trips, budgets, balance."""

import random
import zlib
from collections import defaultdict

import brute
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from churnlab.llm import queries
from churnlab.llm.chat import CLOSE, OPEN, conversation_digests, escape, format_windows, read_windows, unescape
from churnlab.llm.sharding import document_shards, shard_by_bytes

DIGEST = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")
ROWS = "conv_id long, turn long, role string, text string"


def _digests(df):
    return {r.conv_id: tuple(r[c] for c in DIGEST) for r in df.collect()}


def test_chat_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    got = queries.op2_chat_windows(spark, sf)
    assert _digests(got) == brute.conversations([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    lone = got.filter("conv_id = -7").first()
    assert lone.n_turns == 2 and lone.loss_chars == len(said)


@pytest.mark.parametrize(("budget", "history"), [(40, 15), (25, 0), (60, 60), (2000, 500)])
def test_windows(spark, budget, history):
    rng = random.Random(budget)
    bits = ["<|im_end|>\n", "[INST]", "\\0", "\\", "word ", "é", "", "<", "\n"]
    rows = [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "tool\n<"]),
             None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for c in range(12) for t in range(rng.randint(1, 30))]
    rows += [(50, 0, "system", "only")]
    windows = format_windows(spark.createDataFrame(rows, ROWS), budget, history)
    assert _digests(conversation_digests(windows)) == brute.conversations(rows)
    system = {c: x or "" for c, t, r, x in rows if t == 0 and r == "system"}
    for w in windows.collect():
        n = w.formatted.count(OPEN)
        assert n == w.n_turns == w.formatted.count(CLOSE)
        own = w.n_turns - w.n_context
        if w.over_budget:  # one turn alone is too long, or the system turn takes the budget
            assert own <= 1 or len((system.get(w.conv_id) or "").split()) + 4 + history >= budget - history
        assert w.has_system == (w.conv_id in system)
        if w.has_system:
            assert w.formatted.startswith(f"{OPEN}system\n")
        for s in w.loss:
            assert w.formatted[s.start + s.length:].startswith(CLOSE)
    assert windows.filter("n_context > 1").count() > 0 or history == 0 or budget == 2000


def test_escape_round_trip(spark):
    texts = ["", "\\", "<", "[", "\\0\\1\\2", "</s>[INST] ok [/INST]", "<|im_start|>user\n", "a\\<[b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t and "<" not in r.e and "[" not in r.e for r in rows)


def test_chat_edges(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (1, 0, None, None), (2, 3, "assistant", "x"), (2, 3, "assistant", "x"), (3, None, "user", "q")]
    got = _digests(conversation_digests(format_windows(spark.createDataFrame(rows, ROWS))))
    assert got == brute.conversations([(c, t or 0, r or "", x) for c, t, r, x in rows])
    assert conversation_digests(format_windows(spark.createDataFrame([], ROWS))).count() == 0
    long = format_windows(spark.createDataFrame([(1, t, "user", "w " * 50) for t in range(3)], ROWS), budget=20, history=5)
    assert long.count() == 3 and long.filter("over_budget").count() == 3
    assert read_windows(long).filter(F.size("turns") == 1).count() == 3


def _shards(rows, texts):
    size, groups = defaultdict(int), defaultdict(set)
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r.slot)
        groups[raw].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size, groups


def test_shards_query(spark, sf, docs):
    rows = queries.op8_byte_shards(spark, sf).collect()
    size, groups = _shards(rows, dict(docs))
    mean = sum(size.values()) / 16
    assert len(rows) == len(docs) and set(size) <= set(range(16))
    assert max(size.values()) - mean <= max(r["size"] for r in rows) and all(len(g) == 1 for g in groups.values())


def test_shards_hot_group_and_edges(spark, odd, none):
    # a third of all rows has one text: more than a shard, so it is cut; smaller groups stay whole
    texts = {k: ("same " * 10 if k % 3 == 0 else f"pair {k // 2 % 40} " * 4 if k % 3 == 1 else f"own {k} " * 5) for k in range(900)}
    size, groups = _shards(document_shards(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)
    mean = sum(size.values()) / 16
    assert max(size.values()) < 1.2 * mean and min(size.values()) > 0.8 * mean
    assert sum(len(g) > 1 for g in groups.values()) == 1
    size, _ = _shards(document_shards(odd).collect(), dict(ODD))
    assert sum(size.values()) == sum(len((t or "").encode()) + 1 for _, t in ODD)
    assert document_shards(none).count() == 0
    assert document_shards(odd.union(odd)).count() == 2 * len(ODD)


def test_shards_keep_columns_of_the_same_names(spark):
    rows = [(k, k % 7 + 1, f"p{k}", -k, "s", k * 2) for k in range(200)]
    d = spark.createDataFrame(rows, "k long, size long, pos string, part long, shard string, before long")
    for group in (None, ["part"]):
        got = shard_by_bytes(d, "size", "k", 4, group)
        assert set(got.columns) == {*d.columns, "shard_", "slot"}
        assert sorted(tuple(r[c] for c in d.columns) for r in got.collect()) == sorted(rows)
        assert {r["shard_"] for r in got.collect()} == {0, 1, 2, 3}


def test_large_groups_stay_below_two_shards(spark):
    rows = [(g * 100 + k, f"g{g}") for g in range(18) for k in range(100)]
    d = spark.createDataFrame(rows, "k long, g string").selectExpr("*", "1L AS size")
    sizes = [r["n"] for r in shard_by_bytes(d, "size", "k", 16, ["g"]).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert sum(sizes) == 1800 and max(sizes) < 2 * 1800 / 16
