"""Edit embedding and toxicity chain: brute force, likeness, held-out accuracy, edge tables."""

import random

import brute
import numpy as np
from conftest import ODD, by

from churnlab.llm import queries
from churnlab.llm.edit_embedding import EditEmbedding, edited_fingerprints, edits_within, fingerprints, likeness, near_pairs
from churnlab.llm.toxicity import drop_toxic, fit_linear, predict_linear, score_chain, shape, train_chain


def test_edit_query(spark, sf, docs):
    rows = queries.op6_edit_embedding(spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == brute.edited(docs)
    texts, e = dict(docs), EditEmbedding()
    prints = {r.doc_id: r.fingerprint for r in rows}
    by_text = {}
    for d, t in docs:
        assert by_text.setdefault(t, prints[d]) == prints[d]
    order = sorted(texts, reverse=True)
    for r in rows[::9]:
        t, nxt = texts[r.doc_id] or "", texts[order[(order.index(r.doc_id) + 1) % len(order)]] or ""
        cut = len(t) // 3
        want = e.fingerprint(t[:len(t) - cut] + nxt[:cut])
        assert r.fingerprint == e.fingerprint(t).hex() and r.edited_fingerprint == want.hex()
        assert r.near_edited == likeness(e.fingerprint(t), want) and r.near_next == likeness(e.fingerprint(t), e.fingerprint(nxt))
    near, far = [r.near_edited for r in rows], [r.near_next for r in rows]
    assert np.mean(near) > 0.6 and np.median(far) < 0.2


def test_walk_is_one_rule():
    """The table walk equals the step-by-step embedding; samples read it at their places."""
    e = EditEmbedding(seed=3, samples=16)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef é\n") for _ in range(3000))
    classes = e.classes(text)
    places, length = e.walk(classes)
    written = [c for c, a, b in zip(classes, places, [*places[1:], length], strict=True) for _ in range(b - a)]
    sample = e.sample(classes, places, length)
    assert len(written) == length
    pr = e.best
    for k in range(16):
        at = max(p for p in pr[k] if 0 <= p < length)
        assert sample[k] == written[at]
    assert e.fingerprint("") == bytes(16) and e.fingerprint(text * 40) == EditEmbedding(seed=3, samples=16).fingerprint(text * 40)


def test_near_pairs_recall(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(400)) for _ in range(40)]
    docs = []
    for k, t in enumerate(base):
        docs += [(2 * k, t), (2 * k + 1, t[:200] + "zz" + t[202:397])]
    docs += [(200, base[0]), (201, None), (202, "")]
    pairs, members = near_pairs(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(r.a, r.b) for r in pairs.collect()}
    want = {(2 * k, 2 * k + 1) for k in range(40)}
    assert got <= want and len(got) >= 0.9 * len(want)
    cls = by(members, "class")
    assert cls[200] == (0,) and cls[201] == cls[202] == (201,)


def test_edits_within_equals_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé😀") for _ in range(rng.randint(0, 90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert edits_within(a, b, 200) == row[-1] and edits_within(a, b, row[-1]) == row[-1]
        assert edits_within(a, b, row[-1] - 1) == -1


def test_near_pairs_scattered_edits(spark):
    """Edits all over the text, up to the accepted rate: every copy is linked, a large group by few links."""
    rng = random.Random(8)

    def edited(t, rate):
        t = list(t)
        for at in rng.sample(range(len(t)), int(rate * len(t))):
            t[at] = rng.choice(["", "#", t[at] + "#"])
        return "".join(t)

    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(300)) for _ in range(8)]
    docs = [(100 * k + n, edited(t, r)) for k, t in enumerate(base) for n, r in enumerate([0, 0.01, 0.03, 0.05, 0.1, 0.25])]
    docs += [(900 + n, edited(base[0], 0.02)) for n in range(80)]
    pairs, members = near_pairs(spark.createDataFrame(docs, "doc_id long, text string"), block=32)
    near = by(members, "near")
    assert all(near[d] == (0 if d >= 900 else d // 100 * 100,) for d, _ in docs)
    rows, texts = pairs.collect(), dict(docs)
    assert len(rows) < 24 * len(docs) / 2 and all(r.edits <= 0.3 * max(len(texts[r.a]), len(texts[r.b])) for r in rows)


def test_edit_edges(spark, odd, none):
    got = by(edited_fingerprints(odd), "n_chars", "edited_sha256")
    assert got == brute.edited(ODD)
    assert edited_fingerprints(none).count() == 0 and fingerprints(none).count() == 0
    one = edited_fingerprints(odd.filter("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.n_chars == len(ODD[0][1])
    some = edited_fingerprints(spark.createDataFrame([(None, "abcdef"), (3, "xyzxyz"), (3, "xyzxyz")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.near_next > 0.9) for r in some) == [(False, False), (False, True), (True, False)]


def test_upper_case_share_of_a_long_regular_text():
    text = "Ab" * 10_000  # every second character is upper case
    assert "s:upper2" in shape(text, 1, 1) and "s:upper2" in shape(text[1:] + text[0], 1, 1)
    assert "s:upper0" in shape("", 0, 0)


def test_linear_model_against_closed_form():
    rng = np.random.default_rng(0)
    x = rng.random((400, 6)) < 0.4
    y = (rng.random(400) < 1 / (1 + np.exp(1 - 3 * x[:, 0] + 2 * x[:, 3]))).astype(float)
    rows, cols = np.nonzero(x)
    w, v, b = fit_linear(rows, cols, np.zeros((400, 0)), y, 6)
    p = predict_linear((w, v, b), rows, cols, np.zeros((400, 0)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-2 and abs((p - y).sum()) < 1e-2  # the gradient vanishes


def test_toxicity_held_out(spark):
    """Planted insults, also as word starts; trained on half, tested on the rest."""
    rng = random.Random(2)
    plain = ["".join(rng.choice(["ba", "de", "ki", "lo", "mu"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for k in range(1600):
        toxic = k % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["zonk", "fleeb" + rng.choice(plain)]))
        rows.append((k, " ".join(w)))
        if k % 2:
            labels.append((k, int(toxic), 1 if len(w) < 30 else 0))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, short int")
    chain = train_chain(docs, lab, ["short", "toxic"])
    got = by(score_chain(docs, chain), "rejected")
    wrong = [k for k, _ in rows if k % 2 == 0 and got[k][0] != (k % 5 == 0)]
    assert len(wrong) <= 8
    assert len(chain["models"][1][1]) == 1  # the later model sees the earlier probability


def test_toxicity_query_and_edges(spark, sf, docs, odd, none):
    out = queries.op10_toxicity(spark, sf)
    got, labels = by(out, "p_toxic", "rejected"), {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(got) == {d for d, _ in docs} and all(0 <= p <= 1 for p, _ in got.values())
    assert sum(got[d][1] for d, t in labels.items() if t == 0 and d in got) <= 2
    schema = "doc_id long, quality int, toxic int"
    for lab in ([], [(1, 1, 0), (1, None, None), (None, 0, 1)], [(1, 1, 0), (5, 0, 1), (77, 1, 1)]):
        kept = drop_toxic(odd, spark.createDataFrame(lab, schema))
        assert kept.columns == odd.columns and (lab and len(lab) > 2 or kept.count() == len(ODD))
    assert drop_toxic(none, spark.createDataFrame([], schema)).count() == 0


def test_long_words_are_features():
    from churnlab.llm.toxicity import features

    a, b = features("z" * 45 + " bad"), features("z" * 44 + "y bad")
    assert {f for f in a if f.startswith("w:")} != {f for f in b if f.startswith("w:")} and len([f for f in a if f.startswith("w:")]) == 2


def test_features_are_taken_in_small_pieces():
    """No more than a few texts' features are held as Python strings at once, however large the batch."""
    import pyarrow as pa

    from churnlab.llm import toxicity as TX

    batch = pa.RecordBatch.from_arrays([pa.array(range(1001)), pa.array([f"t{i}" for i in range(1001)])], ["doc_id", "text"])
    got = list(TX.pieces(iter([batch, batch.slice(0, 0), batch.slice(3, 5)])))
    assert max(b.num_rows for b in got) <= 100
    assert [t for b in got for t in b.column(1).to_pylist()] == batch.column(1).to_pylist() + batch.slice(3, 5).column(1).to_pylist()
