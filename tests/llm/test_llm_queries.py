"""The numbered queries against their SQL, and the pipeline against plain Python."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

import brute
import corpus_pipeline
from quern.llm import language_id
from quern.llm.queries import QUERIES, SQL
from sql_compare import compare, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    compare(spark, connect(sf_dir), sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op13_packing"}))  # that one gives pieces
def test_one_row_for_each_row(spark, sf_dir, name):
    table = "pages" if name.startswith("op3") else "documents"
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_contract_columns(spark, sf_dir):
    want = {
        "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op3_html_extraction": ["page_id", "url", "text", "n_chars"],
        "op4_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
        "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op6_ngram_join": ["doc_id", "n_shingles", "component_id"],
        "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op8_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op9_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op10_sentencepiece_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op11_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op12_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        "op13_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    }
    for name, cols in want.items():
        assert set(cols) <= set(QUERIES[name](spark, sf_dir).columns), name


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rejected = {r.doc_id for r in language_id.predict(docs, language_id.fit(docs)).where("rejected").collect()}
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] not in rejected]
    part = brute.components(rows)
    rows = [(i, t) for i, t in rows if part[i][1] == i]
    rows = [(i, " ".join(k)) if len(k) < len(w) else (i, dict(rows)[i]) for i, w, k in brute.kept_words(rows)]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    clean = {i for i, t in rows if not brute.contamination(t, items)[1]}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in rows:
        if i in clean:
            want[i] = t
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(want)
    untouched = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    same = 0
    for i, t in want.items():
        if t == untouched[i]:  # texts that were cut keep their own white space
            ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
            assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            same += 1
    assert same > 0.5 * len(want)


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language identification", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "SentencePiece encoding"]
