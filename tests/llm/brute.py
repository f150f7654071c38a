"""Brute-force versions of the training-data queries over plain Python rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def token_files(docs, encode):
    """{doc_id: (start, n_tokens, crc32)}; docs: [(doc_id, text)]"""
    out, at = {}, 0
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        out[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def contamination(docs, items, n=10):
    """{doc_id: (n_words, n_hit, n_items, sha of items, contaminated)}"""
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[p:p + k])].add(str(i))
    lengths, out = {len(g) for g in grams}, {}
    for d, t in docs:
        w, hit, its = words(t), set(), set()
        for k in lengths:
            for p in range(len(w) - k + 1):
                got = grams.get(tuple(w[p:p + k]))
                if got:
                    hit.update(range(p, p + k))
                    its |= got
        out[d] = (len(w), len(hit), len(its), sha(",".join(sorted(its))), bool(hit))
    return out


def line_dedup(docs, least=10):
    """{doc_id: (n_lines, n_dropped, kept text)}"""
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    seen = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not key(x) or seen[key(x)] < least]
        out[d] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def simhash(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, bits=4):
    """{doc_id: (fingerprint, smallest doc_id reachable)}"""
    fp = {d: simhash(t) for d, t in docs}
    up = {d: d for d in fp}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(fp)
    v = np.array([fp[d] for d in ids], dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= bits) + i + 1:
            a, b = root(ids[i]), root(ids[int(j)])
            up[max(a, b)] = min(a, b)
    return {d: (f"{fp[d]:016x}", root(d)) for d in ids}


def conversations(rows):
    """{conv_id: (n_turns, turns sha, loss chars, loss sha)}; rows: (conv_id, turn, role, text)"""
    per = defaultdict(list)
    for c, turn, role, text in rows:
        per[c].append((turn, role, text or ""))
    out = {}
    for c, turns in per.items():
        turns.sort(key=lambda x: x[0])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def edited(docs):
    """{doc_id: (n_chars, sha of the edited text)}"""
    order = sorted(docs, key=lambda x: -x[0])
    out = {}
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[d] = (len(t), sha(t[:len(t) - cut] + nxt[:cut]))
    return out
