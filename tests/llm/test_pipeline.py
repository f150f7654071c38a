"""The corpus pipeline: every stage against brute force on its own input, edge tables, the registry."""

import brute
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from churnlab.llm.common import tokenizer_path


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = _rows(docs)
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "bpe":
            assert out.columns == columns
            after = dict(_rows(out))
        if name == "toxicity":
            assert set(after.items()) <= set(before) and len(after) > 0.8 * len(before)
        elif name == "line_dedup":
            assert after == {d: t for d, (_, _, t) in brute.line_dedup(before, 10).items()}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_dedup":
            component = brute.components(before)
            assert after == {d: t for d, t in before if component[d][1] == d}
        elif name == "decontamination":
            hit = brute.contamination(before, items)
            assert after == {d: t for d, t in before if not hit[d][4]}
        else:
            word = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
            assert {r.doc_id: r.n_tokens for r in out.collect()} == {d: len(word.encode(t, add_special_tokens=False).ids) for d, t in before}
        docs = out


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_edges(spark, odd, none, tmp_path, empty):
    docs = none if empty else odd.union(odd)
    docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(r.doc_id for r in cp.run(spark, str(tmp_path)).collect())
    assert got == ([] if empty else sorted(set(got))) and (empty or 1 in got)


def test_registered(spark):
    names = set(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and {"op4_decontaminate", "op7_line_dedup"} <= set(entry.oracle_sql())
