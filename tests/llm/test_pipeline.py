"""The pipeline on the smallest tables, against the operators' plain versions."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from tablewright.llm import bpe


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "tokens"]


def test_run(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert out
    for r in out:
        text = known.decode(r["ids"])
        assert r["ids"] == known.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert text == docs[r["doc_id"]]["text"] or "[SECRET]" in text
        assert r["source"] == docs[r["doc_id"]]["source"]
    assert len({r["doc_id"] for r in out}) < len(docs)
