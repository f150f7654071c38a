"""Token files, BPE automaton, separator scan: against the tokenizers library and exact round trips."""

import hashlib
import random

import brute
import numpy as np
import pytest
from conftest import ODD, by
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnlab.llm import queries
from churnlab.llm.bpe_automaton import TokenAutomaton, WordBpe, bpe_digests, decode_documents, encode_documents
from churnlab.llm.common import open_fs, tokenizer_path
from churnlab.llm.encode import TextEncoder
from churnlab.llm.token_counts import count_flat_tokens, document_token_counts
from churnlab.llm.token_store import TokenFile, dac_file, read_tokens, with_bases, write_tokens

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXT = st.text(alphabet=st.sampled_from("abcdethin .,'\n\t<|>0Σé가́   日A!-"), max_size=60)


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD), TextEncoder(BYTE), WordBpe(WORD)


@given(text=TEXT)
@settings(max_examples=300, deadline=None)
def test_encoders_equal_library(lib, text):
    byte, word, enc, bpe = lib
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == byte.encode(text, add_special_tokens=False).ids
    ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
    assert ids == word.encode(text, add_special_tokens=False).ids
    assert bpe.decode(ids) == word.decode(ids, skip_special_tokens=False)


def test_encoders_equal_library_on_documents(lib, docs):
    byte, word, enc, bpe = lib
    for _, t in docs + ODD:
        t = (t or "")[:20_000]
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == byte.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == word.encode(t, add_special_tokens=False).ids


def _merge_words(word, merges):
    """Plain BPE: the best-ranked pair first, from the left."""
    rank, parts = {m: i for i, m in reversed(list(enumerate(merges)))}, list(word)
    while True:
        best = min((p for p in zip(parts, parts[1:], strict=False) if p in rank), key=rank.get, default=None)
        if best is None:
            return parts
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i:i + 2]) == best:
                out.append("".join(best))
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_automaton_on_random_merges():
    rng = random.Random(5)
    for _ in range(60):
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(1, 25)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) <= 6:
                merges.append((u, v))
                tokens.append(u + v)
        vocab = {t: i for i, t in enumerate(tokens)}
        reachable = [m for m in merges if _merge_words(m[0] + m[1], merges) == [m[0] + m[1]]]
        if len(reachable) < len(merges):
            continue  # a trained vocabulary reaches every token
        automaton = TokenAutomaton(vocab, merges)
        for _ in range(200):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [tokens[i] for i in automaton.encode(w)] == _merge_words(w, merges), (merges, w)


@given(ids=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), width=st.sampled_from([4, 8, 16]))
@settings(max_examples=60, deadline=None)
def test_dac_random_access(ids, width):
    f = TokenFile(dac_file(np.array(ids, dtype=np.uint32), [], np.zeros(0), width))
    assert f.ids(0, len(ids)).tolist() == ids
    for i in range(0, len(ids), 7):
        assert f[i] == ids[i]
    a, b = len(ids) // 3, 2 * len(ids) // 3
    assert f.ids(a, b).tolist() == ids[a:b]


def test_token_files_against_library(spark, sf, docs):
    byte = Tokenizer.from_file(BYTE)
    got = by(queries.op1_token_store(spark, sf), "start", "n_tokens", "ids_crc32")
    assert got == brute.token_files(docs, lambda t: byte.encode(t, add_special_tokens=False).ids)


def test_token_files_edges(spark, odd, none):
    byte = Tokenizer.from_file(BYTE)
    folder, manifest = write_tokens(odd.union(odd.limit(1)), BYTE, file_tokens=50, partitions=3)
    rows = read_tokens(folder, manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([d for d, _ in ODD] + [ODD[0][0]])
    assert rows[-1].start + rows[-1].n_tokens == manifest.agg({"n_tokens": "sum"}).first()[0]
    assert manifest.count() > 3  # files close at their size
    fs, root = open_fs(folder)
    first = with_bases(manifest).orderBy("base").first()
    with fs.open_input_file(f"{root}/{first.path}") as f:
        file = TokenFile(f.read())
    want = byte.encode(ODD[0][1], add_special_tokens=False).ids + [0]
    assert file.document(0).tolist() == want and [file[i] for i in range(len(want))] == want
    folder, manifest = write_tokens(none, BYTE)
    assert read_tokens(folder, manifest).count() == 0
    folder, manifest = write_tokens(spark.createDataFrame([(None, "a"), (5, "b")], "doc_id long, text string"), BYTE)
    assert [(r.doc_id, r.start) for r in read_tokens(folder, manifest).orderBy("start").collect()] == [(None, 0), (5, 2)]


def test_bpe_query_and_edges(spark, sf, docs, odd, none):
    word = Tokenizer.from_file(WORD)

    def want(t):
        ids = word.encode(t or "", add_special_tokens=False).ids
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(word.decode(ids, skip_special_tokens=False)))

    cols = ("n_tokens", "ids_sha256", "decoded_sha256")
    assert by(queries.op3_bpe_automaton(spark, sf), *cols) == {d: want(t) for d, t in docs}
    assert by(bpe_digests(odd, WORD), *cols) == {d: want(t) for d, t in ODD}
    assert bpe_digests(none, WORD).count() == 0
    texts = by(decode_documents(encode_documents(odd, WORD), WORD), "text")
    assert texts[1] == ("hello</w> world</w> ,</w> hello</w> world</w>",) and texts[2] == ("",)


def test_token_counts(spark, sf, docs, odd, none):
    byte = Tokenizer.from_file(BYTE)
    assert by(queries.op5_token_counts(spark, sf), "n_tokens") == {d: (len(byte.encode(t or "", add_special_tokens=False).ids),) for d, t in docs}
    byte.encode_special_tokens = True  # the separator's string in a text is ordinary text
    want = sorted((d, len(byte.encode(t or "", add_special_tokens=False).ids)) for d, t in [*ODD, *ODD])
    got = document_token_counts(odd.union(odd), BYTE, 50256, block_bytes=64)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert document_token_counts(none, BYTE, 50256).count() == 0


@pytest.mark.parametrize("block", [2, 6, 1 << 20])
def test_flat_files_any_block(spark, tmp_path, block):
    files = {0: [5, 9, 9, 5, 5, 7, 9], 1: [9], 2: [1, 2, 3], 3: []}
    rows = []
    for k, ids in files.items():
        p = tmp_path / f"{k}.bin"
        p.write_bytes(np.array(ids, "<u2").tobytes())
        rows.append((k, f"file://{p}", p.stat().st_size))
    got = count_flat_tokens(spark.createDataFrame(rows, "file long, uri string, n_bytes long"), 9, block_bytes=block)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 1, True), (0, 1, 0, True), (0, 2, 3, True), (1, 0, 0, True), (2, 0, 3, False)]
