"""Decontamination, line dedup, SimHash: against brute force, plus edge tables."""

import random

import brute
import numpy as np
import pytest
import xxhash
from conftest import ODD, by
from pyspark.sql import functions as F

from churnlab.llm import decontaminate as dc
from churnlab.llm import queries
from churnlab.llm.components import connected_components
from churnlab.llm.line_dedup import drop_lines, line_digests
from churnlab.llm.simhash import (grid_point, keep_one_per_component, near_links, simhash_components, text_fingerprint,
                                  unary_point)

CONT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontaminate_query(spark, sf, docs):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert by(queries.op4_decontaminate(spark, sf), *CONT) == brute.contamination(docs, items)


def _random_docs(seed, n=60):
    rng = random.Random(seed)
    return [(k, None if rng.random() < 0.05 else "".join(rng.choice(["a", "b", "C ", "\n", " é", "9", ".", "ab "]) for _ in range(rng.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_decontaminate_random(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", limit)  # 0: the windows are joined by a shuffle
    docs, items = _random_docs(1), [(100 + k, t) for k, t in _random_docs(2, 12)] + [(300, "ab  AB"), (301, "ab ab"), (302, None), (303, "...")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, items, 4)
    assert by(dc.contamination_digests(d, i, 4), *CONT) == want
    assert sorted(r.doc_id for r in dc.drop_contaminated(d, i, 4).collect()) == sorted(k for k, v in want.items() if not v[4])
    for doc_id, text in by(dc.remove_spans(d, i, 4), "text").items():
        original = dict(docs)[doc_id]
        assert (text[0] == original) == (not want[doc_id][4])
        assert len(brute.words(text[0])) >= want[doc_id][0] - want[doc_id][1] - 1 or want[doc_id][4]


def test_remove_spans_text(spark):
    d = spark.createDataFrame([(1, "Keep, this. ONE two-three! and this")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "one TWO three")], "item_id long, text string")
    assert dc.remove_spans(d, i).first().text == "Keep, this. and this"


def test_decontaminate_edges(spark, odd, none):
    items = spark.createDataFrame([(1, "hello world hello world")], "item_id long, text string")
    got = by(dc.contamination_digests(odd.union(odd), items), *CONT)
    assert got == brute.contamination(ODD, [(1, "hello world hello world")]) and got[1][4] and got[9][4]
    kept = dc.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    assert dc.contamination_digests(none, items).count() == 0
    assert not any(v[4] for v in by(dc.contamination_digests(odd, items.limit(0)), *CONT).values())


LINES = ("n_lines", "n_dropped", "kept_sha256")


def _lines(docs, least):
    return {k: (a, b, brute.sha(t)) for k, (a, b, t) in brute.line_dedup(docs, least).items()}


def test_line_dedup_query(spark, sf, docs):
    assert by(queries.op7_line_dedup(spark, sf), *LINES) == _lines(docs, 10)


def test_line_dedup_random_and_edges(spark, odd, none):
    docs = _random_docs(3, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert by(line_digests(df, 3), *LINES) == _lines(docs, 3)
    assert by(drop_lines(df, 3), "text") == {k: (None if dict(docs)[k] is None else t,) for k, (_, _, t) in brute.line_dedup(docs, 3).items()}
    assert by(line_digests(odd.union(odd), 2), *LINES) == _lines(ODD, 2)
    assert drop_lines(odd, 2).columns == odd.columns
    assert line_digests(none).count() == 0 and drop_lines(none).count() == 0


def test_line_dedup_first_occurrence(spark):
    df = spark.createDataFrame([(1, "a\nb\nA "), (2, "b\nc"), (3, "c\n\n")], "doc_id long, text string")
    assert by(drop_lines(df, 1, keep_first=True), "text") == {1: ("a\nb",), 2: ("c",), 3: ("\n",)}


def test_simhash_query(spark, sf, docs):
    assert by(queries.op9_simhash(spark, sf), "fingerprint", "component_id") == brute.components(docs)


def test_fingerprint_hash_is_spark_xxhash64(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c é"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b c é".encode(), 42)
    for _, t in ODD:
        assert text_fingerprint((t or "")[:2000]) == brute.simhash((t or "")[:2000])


def test_popcounts_bound_bits():
    a, b = np.random.default_rng(1).integers(0, 2**64, size=(2, 4000), dtype=np.uint64)
    l1 = sum(abs(((grid_point(a) >> np.uint64(2 * s)) & np.uint64(3)).astype(int) - ((grid_point(b) >> np.uint64(2 * s)) & np.uint64(3)).astype(int)) for s in range(32))
    assert (l1 == np.bitwise_count(unary_point(a) ^ unary_point(b))).all() and (l1 <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize(("bits", "block"), [(4, 4096), (4, 64), (3, 16), (6, 64), (0, 4096)])
def test_links_connect_as_brute_force(spark, bits, block):
    """Chains and a dense ball of fingerprints; small blocks deal hot cells out in pairs."""
    rng = np.random.default_rng(bits + block)
    centre = rng.integers(0, 2**64, size=40, dtype=np.uint64)
    ball = centre[0] ^ (np.uint64(1) << rng.integers(0, 14, size=150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 14, size=150, dtype=np.uint64))
    near = centre[rng.integers(0, 40, 200)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, size=200, dtype=np.uint64))
    fp = np.unique(np.concatenate([centre, ball, near]))
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {r.node: r.root for r in connected_components(near_links(nodes, bits, block)).collect()}
    up = list(range(len(fp)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= bits) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            up[b] = a
    classes, ours = {}, {}
    for i, x in enumerate(fp.view(np.int64).tolist()):
        classes.setdefault(root(i), set()).add(x)
        ours.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, ours.values()))


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def test_simhash_edges(spark, odd, none):
    got = by(simhash_components(odd.union(odd), block=2), "fingerprint", "component_id")
    assert got == brute.components(ODD)
    assert got[2] == got[3] == ("0" * 16, 2)
    kept = keep_one_per_component(odd.union(odd))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})
    assert simhash_components(none).count() == 0 and keep_one_per_component(none).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = "one two three four five six seven eight nine ten", "red green blue black white brown grey pink gold teal"
    d = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (None, a), (9, None), (9, "")], "doc_id long, text string")
    assert sorted((r[0], r[1] or "") for r in keep_one_per_component(d).collect()) == [(1, a), (5, b), (9, "")]
