"""Every stage of the pipeline against a plain version, and odd rows through all of them."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_decontaminate import plain_align
from test_pii import plain_spans
from test_simhash import plain_classes, plain_fingerprint
from test_tokens import check_packing, plain_ids

import corpus_pipeline
from feedbackmill.llm import toxicity
from feedbackmill.llm.decontaminate import _WORD
from feedbackmill.llm.queries import word_tokenizer
from feedbackmill.llm.word_tokens import WordTokens

SF = "/root/testdata/sf0.001"


def plain_redacted(text):
    out, at = [], 0
    for start, k, end in plain_spans(text):
        if start >= at:
            out += [text[at:start], f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[k]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_run_against_plain_stages(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    items = [_WORD.findall(r["text"].lower()) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {k: t for k, t in docs.items() if model.score(t) < 0.7}
    label = plain_classes({k: plain_fingerprint(t) for k, t in docs.items()})
    docs = {k: t for k, t in docs.items() if label[k] == k}

    def copied(text):
        words = _WORD.findall(text.lower())
        return any(len(set(i) & set(words)) * 2 >= len(set(i)) and plain_align(i, words) >= len(i) for i in items)

    docs = {k: plain_redacted(t) for k, t in docs.items() if not copied(t)}
    tokens = WordTokens(word_tokenizer())
    used = check_packing(corpus_pipeline.run(spark, SF).collect(), {k: plain_ids(tokens, t) for k, t in docs.items()})
    assert used >= sum(len(plain_ids(tokens, t)) + 1 for t in docs.values()) / 2048


@pytest.fixture
def odd_dir(tmp_path):
    pq.write_table(pa.table({
        "doc_id": pa.array([1, 1, 2, 3, None, 5, 6, 7], pa.int64()),
        "text": [None, None, "", "call +1 212 555 0100 now", "no id here", "the quick brown fox jumps over it", "word " * 90_000, "call +1 212 555 0100 now"],
        "lang": ["en", None] * 4, "source": [None] * 7 + ["s"], "n_chars": pa.array([0, None] * 4, pa.int64()),
    }), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, None], pa.int64()), "text": ["quick brown fox jumps over", None]}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, None], pa.int64()), "quality": pa.array([1, 1], pa.int32()), "toxic": pa.array([0, 1], pa.int32())}), tmp_path / "labels.parquet")
    return str(tmp_path)


def test_odd_rows(spark, odd_dir):
    rows = corpus_pipeline.run(spark, odd_dir).collect()
    assert {r["doc_id"] for r in rows} == {1, 3, None, 6}
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), odd_dir).count() == 0, name
    marked = {r["doc_id"]: r for r in corpus_pipeline.redact_personal_data(spark, docs, odd_dir).collect()}
    assert marked[3]["text"] == "call [PHONE] now" and marked[3]["n_chars"] == 16
    assert marked[1]["text"] is None and marked[2]["text"] == "" and marked[5]["n_chars"] is None


def test_stages_pass_odd_columns_on(spark, odd_dir):
    from feedbackmill.llm import pii, simhash

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").selectExpr("*", "'b' as base", "1 as pool", "2 as fp", "3 as component_id", "4 as redacted")
    assert simhash.keep_first(docs).columns == docs.columns
    assert pii.redact_documents(docs).columns == docs.columns
    kept = simhash.keep_first(docs)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 5, 6]
    assert np.all([r["pool"] == 1 for r in kept.collect()])
