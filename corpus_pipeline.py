"""Corpus pipeline: quality rules, near-duplicates, secrets, mixture, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a frame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

* quality: documents that a base rule or a risk-controlled cutoff rejects go;
* near_duplicates: one document of each class of near-duplicates stays;
* secrets: every secret in a text is replaced by a mark, n_chars is recounted;
* mixture: documents are repeated or left out to reach the sources' targets;
* tokens: byte-level BPE ids of each text, with the digest of what they decode to.

Null ids, null and empty texts, repeated rows, empty tables and further columns
are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers

from tablewright.llm import bpe, mixing, neardup, quality, secrets
from tablewright.llm.common import drop, materialize, read, temporary


def quality_rules(spark, docs, sf_dir):
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    return neardup.deduplicate(docs)


def secret_scan(spark, docs, sf_dir):
    return secrets.redact(docs)


def mixture(spark, docs, sf_dir):
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def tokens(spark, docs, sf_dir):
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                            carry=["doc_id", "lang", "source"], outputs=("n_tokens", "ids", "decoded_sha256"))
    return out.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", "decoded_sha256")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secret_scan),
          ("mixture", mixture), ("tokens", tokens)]


def run(spark, sf_dir):
    """All stages over ``documents``; what a stage returns is written and read again.  A stage's own files and
    its predecessor's result go when its result is written."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: BPE and ProbMinHash are beyond SQL: tests compare with a brute-force version.
ORACLE_SQL = None
