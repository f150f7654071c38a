"""Source mixing, token alignment and conversation repair against brute force, exact laws and edge cases."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import ODD, by

import public_tokenizers
from churnlab.llm.alignment import align, alignment_digests, links
from churnlab.llm.mixing import mix_digests, mix_sources, mixed_documents
from churnlab.llm.repair import damage, repair_digests, repair_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BLANKS = " \t\n\x0b\f\r"


def n_words(t):
    for c in BLANKS[1:]:
        t = t.replace(c, " ")
    return sum(1 for w in t.split(" ") if w)


# ---------------------------------------------------------------- mixing
def targets(sizes):
    """{source: target}; sizes {source: words}"""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, got = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            got.update(share)
            break
        for s in over:
            got[s] = 2.0 * sizes[s]
            left -= got[s]
            free.remove(s)
    return got


def check_mix(rows, got):
    """rows [(id, text, source)]; got: rows of mix_digests"""
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = n_words(t or "")
        sizes[s] += n
        longest[s] = max(longest[s], n)
    want, taken = targets(sizes), defaultdict(int)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, n_words(t or "")) for d, t, _ in rows)
    source = {(d, n_words(t or "")): s for d, t, s in rows}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    return taken


def test_mix_follows_targets(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r[0], r[1], r[2]) for r in d.select("doc_id", "text", "source").collect()]
    first = mix_digests(d).collect()
    check_mix(rows, first)
    again = mix_digests(d.repartition(3, "lang")).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))  # reruns and other partitionings agree


def test_mix_tree_and_expectation(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(1, 30), rnd.choice("aaaaaabc")) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mean = Counter()
    for seed in range(6):  # many buckets, a tree of several levels
        got = mix_sources(d, seed=seed, bucket=8, fan=3).collect()
        per = defaultdict(float)
        for r in got:
            per[r["source"]] += r["copies"] * r["size"]
            mean[r["source"]] += r["copies"] / 6
        for r in got:
            assert abs(per[r["source"]] - r["target"]) <= 30
    rate = {r["source"]: r["target"] / r["source_size"] for r in got}
    n = Counter(s for _, _, s in rows)
    for s in n:  # expectations are kept: copies per document average the source's rate
        assert abs(mean[s] / n[s] - rate[s]) < 0.06


def test_mix_edges(spark, odd, none):
    assert mix_digests(none.withColumn("source", none.lang)).count() == 0
    rows = [(d, t, None if d % 3 == 0 else f"s{d % 2}") for d, t in ODD] + [(1, ODD[0][1], "s1")] * 3 + [(None, "a b", "s0"), (2**62 + 1, "c", "s0")]
    d = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, size int, bucket string")
    check_mix(rows, mix_digests(d).collect())
    mix = mix_sources(d)
    texts = Counter((r["doc_id"], r["text"]) for r in mixed_documents(d, mix).collect())
    assert sum(texts.values()) == sum(r["copies"] for r in mix.collect()) and set(texts) <= {(a, b) for a, b, _ in rows}
    assert set(mixed_documents(d, mix).columns) == {*d.columns, "copy"}


# ---------------------------------------------------------------- alignment
def tokens(text):
    """(ids, ends) of both tokenizers over " " + text, or None"""
    import sentencepiece
    from tokenizers import Tokenizer

    global _TOK
    if "_TOK" not in globals():
        t = Tokenizer.from_file(A)
        t.encode_special_tokens = True
        from churnlab.llm.encode import TextEncoder
        letters = {c: b for b, c in enumerate(TextEncoder._byte_letters())}
        _TOK = (t, sentencepiece.SentencePieceProcessor(model_file=B), letters)
    t, sp, letters = _TOK
    if not text:
        return None
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    pa = [bytes(letters[c] for c in t.id_to_token(i)) if i != 50256 else b"" for i in a]
    pb = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
    raw = (" " + text).encode()
    if b"".join(pa) != raw or b"".join(pb) != raw:
        return None
    ends = []
    for parts in (pa, pb):
        n, e = 0, []
        for p in parts:
            n += len(p)
            e.append(n)
        ends.append(e)
    return a, b, ends[0], ends[1]


def brute_alignment(rows):
    docs, counts = [], Counter()
    for d, text in rows:
        got = tokens(text)
        if got is None:
            docs.append((d, None, None, None))
            continue
        a, b, ea, eb = got
        cuts = set(ea) & set(eb)
        parts, met = [], Counter()
        for ids, ends in ((a, ea), (b, eb)):
            texts = [[]]
            for x, e in zip(ids, ends):
                texts[-1].append(str(x))
                if e in cuts:
                    texts.append([])
            parts.append([",".join(t) for t in texts[:-1]])
        groups = ["|".join(p) for p in zip(*parts, strict=True)]
        sa, sb = [0, *ea], [0, *eb]
        j0 = 0
        for i in range(len(a)):
            while eb[j0] <= sa[i]:
                j0 += 1
            j = j0
            while j < len(b) and sb[j] < ea[i]:
                met[a[i], b[j]] += 1
                j += 1
        counts.update(met.keys())
        docs.append((d, (len(a), len(b), len(groups)), met, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for d, n, met, sha in docs:
        if n is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((d, *n, sum(met.values()), sum(k for p, k in met.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in met.items()), sha))
    return Counter(out)


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = ["▁ x", "a▁b", "<0x41><s> </s><unk>", "tab\tand\rreturn\r\n  two  blanks \n", "\n\nlead", " ", "  ", "\n", "　wide　blank", "nul\0byte", "é é ﬁ",
        "it's we'll 'S \x85   \x1c x\x1f y", ";\r\n}\r\n", "x" * 500, " nb  sp", "\U0001f600\U0001f600 ok", "a\t b \tc", "\t\n \n\t"]


def test_alignment_equals_brute_force(spark, docs):
    rows = [*docs, *ODD, *enumerate(HARD, 10_000), (10_000, "again under one id"), (None, "no id")]
    rnd = random.Random(5)
    rows += [(20_000 + i, "".join(rnd.choice(" \n\t\r ab.,'éあx1 ") for _ in range(rnd.randint(1, 60)))) for i in range(300)]
    d = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, uid int, pairs string")
    want = brute_alignment(rows)
    assert Counter(tuple(r[c] for c in COLS) for r in alignment_digests(d, A, B).collect()) == want
    assert Counter(tuple(r[c] for c in COLS) for r in alignment_digests(d, A, B, broadcast_bytes=0).collect()) == want


def test_align_by_cuts():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 60)
        a, b = (sorted({*rnd.sample(range(1, n + 1), rnd.randint(1, n)), n}) for _ in range(2))
        assert [a[i - 1] for i, _ in align(a, b)] == sorted(set(a) & set(b)) == [b[j - 1] for _, j in align(a, b)]
        sa, sb = [0, *a], [0, *b]
        assert links(a, b) == [(i, j) for i in range(len(a)) for j in range(len(b)) if sa[i] < b[j] and sb[j] < a[i]]


def test_alignment_of_nothing(none):
    assert alignment_digests(none, A, B).count() == 0


# ---------------------------------------------------------------- repair
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, repaired) of [(role, text, must go, truncated)] by a search over (rows read, state) with whole strings."""
    todo, seen = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, state, made = heapq.heappop(todo)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(made)
        for letter, role in (("u", "user"), ("a", "assistant")):
            to = MOVES.get((state, letter))
            if to:
                heapq.heappush(todo, (cost + 3, audit + "I", i, to, (*made, f"{role}:")))
        if i == len(rows):
            continue
        role, text, go, cut = rows[i]
        heapq.heappush(todo, (cost + 4, audit + "D", i + 1, state, made))
        if go:
            continue
        to = MOVES.get((state, role[:1]))
        if to:
            heapq.heappush(todo, (cost + 3 * cut, audit + "K", i + 1, to, (*made, f"{role}:{text}")))
        for letter, new in (("u", "user"), ("a", "assistant")):
            to = MOVES.get((state, letter))
            if to and role[:1] != letter:
                heapq.heappush(todo, (cost + 3 + 3 * cut, audit + "R", i + 1, to, (*made, f"{new}:{text}")))
    raise AssertionError


def brute_repair(rows):
    """{conv_id: ...} for [(conv_id, turn, role, text)]"""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if kind == 4:
            role = "user"
        convs[c] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, marked, n, illegal = set(), [], Counter(), 0
        for k, (_, role, text) in enumerate(turns):
            body = text.strip(BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
            if k and turns[k - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
                illegal += 1
        nums = [t[0] for t in turns if t[0] is not None]
        cost, audit, made = cheapest(marked)
        out[c] = (max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                  hashlib.sha256(made.encode()).hexdigest())
    return out


REPAIR = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_equals_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()]
    assert by(repair_digests(d), *REPAIR, key="conv_id") == brute_repair(rows)


def test_repair_of_random_conversations(spark):
    rnd = random.Random(11)
    rows = []
    for c in range(400):
        for k in range(rnd.randint(1, 14)):
            turn = rnd.choice([k, k, k, k + 1, None, rnd.randint(0, 3)])
            rows.append((c, turn, rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "agent"]),
                         rnd.choice(["a.", "b!", "cut", None, "", " \n", "d? \t", f"{c}{k}.", " ", "e. "])))
    rows += [(None, 0, "user", "x."), (None, None, "user", "x."), (-5, None, None, None)]
    rows += [(1000, k, rnd.choice(["user", "assistant"]), rnd.choice([f"{k}.", f"{k}", ""])) for k in range(300)]  # several blocks
    rows += [(1001, k, "system", f"{k}.") for k in range(120)] + [(1002, k, "user", "same.") for k in range(120)]
    want = brute_repair(rows)
    d = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA + ", gone int, conv string").repartition(5)
    assert by(repair_digests(d), *REPAIR, key="conv_id") == want


def test_dropped_and_empty(spark):
    turns = [t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0]
    d = spark.createDataFrame([(7, turns[0], "user", "a."), (7, turns[1], "assistant", "b.")], SCHEMA)
    assert by(repair_digests(d), *REPAIR, key="conv_id") == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_rows_follow_the_pattern(spark, sf):
    d = damage(spark.read.parquet(f"{sf}/conversations.parquet"))
    convs = defaultdict(list)
    for r in repair_rows(d).collect():
        if r["role"] is not None:
            convs[r["conv_id"]].append((r["at"], r["role"][0]))
    import re
    for turns in convs.values():
        assert re.fullmatch("s?(ua)+", "".join(x for _, x in sorted(turns)))


def test_long_conversation_keeps_short_numbers(spark):
    """A conversation of 30,000 turns is streamed: undecided letters never pile up."""
    from churnlab.llm import repair
    c = repair._Conversation("1")
    rnd, widest = random.Random(2), 0
    for k in range(30_000):
        c.turn(k, rnd.choice(["user", "assistant", "system"]), f"{k}.", rnd.random() < 0.05, rnd.random() < 0.2, rnd.random() < 0.05)
        widest = max(widest, c.width)
        c.pending.clear()
    c.end()
    assert widest < 400
