"""Registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_store")
def op1_token_store(spark, sf_dir):
    from .common import tokenizer_path
    from .token_store import read_tokens, write_tokens

    folder, manifest = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_bpe_automaton")
def op3_bpe_automaton(spark, sf_dir):
    from .bpe_automaton import bpe_digests
    from .common import tokenizer_path

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    from .common import tokenizer_path
    from .token_counts import document_token_counts

    return document_token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=50256)


@query("op9_simhash")
def op9_simhash(spark, sf_dir):
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


_OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
ks AS (SELECT DISTINCT k FROM grams),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, dw.k, i, item FROM dw JOIN grams ON dw.k = grams.k AND dw.g = grams.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op4_decontaminate", _OP4_SQL)
def op4_decontaminate(spark, sf_dir):
    from .decontaminate import contamination_digests

    return contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


_OP7_SQL = r"""
WITH l AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, CAST(count(f.k) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""


@query("op7_line_dedup", _OP7_SQL)
def op7_line_dedup(spark, sf_dir):
    from .line_dedup import line_digests

    return line_digests(table(spark, sf_dir, "documents"), min_docs=10).drop("dropped_runs")


@query("op8_byte_shards")
def op8_byte_shards(spark, sf_dir):
    from .sharding import document_shards

    return document_shards(table(spark, sf_dir, "documents"), n_shards=16)


@query("op2_chat_windows")
def op2_chat_windows(spark, sf_dir):
    from .chat import conversation_digests, format_windows
    from .common import cut_lineage

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    windows = cut_lineage(format_windows(rows.unionByName(more), budget=2048, history=512))  # the formatted output
    return conversation_digests(windows)


@query("op6_edit_embedding")
def op6_edit_embedding(spark, sf_dir):
    from .edit_embedding import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    from .toxicity import score_chain, toxicity_labels, train_chain

    docs = table(spark, sf_dir, "documents")
    chain = train_chain(docs, toxicity_labels(table(spark, sf_dir, "labels")), ["low_quality", "toxic"])
    return score_chain(docs, chain)


@query("op11_source_mix")
def op11_source_mix(spark, sf_dir):
    from .mixing import mix_digests

    return mix_digests(table(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    from .alignment import alignment_digests
    from .common import tokenizer_path

    return alignment_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    from .repair import repair_digests

    return repair_digests(table(spark, sf_dir, "conversations"))
