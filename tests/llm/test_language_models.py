"""Learned operators: held-out quality, brute-force counts, defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import lm, toxicity
from tablewright.llm.words import words_of


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    common = [f"w{i}" for i in range(400)]
    out = []
    for i in range(900):
        w = [r.choice(common) for _ in range(r.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["grunk", "blarg", "snit"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, 0.5) for i, t, _ in corpus] + [(None, None, None), (5000, "", 1.0), (5001, "grunk " * 20_000, 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)


def test_toxicity_finds_held_out_texts(spark, corpus, docs):
    labels = spark.createDataFrame([(i, t) for i, _, t in corpus if i % 5] + [(1, None), (None, 1), (99999, 1)],
                                   "doc_id long, toxic int")
    rows = toxicity.score(docs, labels, carry=["doc_id"]).select("row.doc_id", "score").collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == len(corpus) + 3 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], t) for i, _, t in corpus if i % 5 == 0]
    right = sum((s >= 0.3) == bool(t) for s, t in held)
    assert right / len(held) >= 0.95
    assert got[5001] > 0.9 and abs(got[None] - got[5000]) < 1e-12
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_without_a_class(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, labels).select("score").collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).select("score").collect()} == {0.0}


def test_lm_losses_equal_plain_counts(spark, corpus, docs):
    targets = spark.createDataFrame([(i,) for i in range(0, 900, 4)], "target_id long")
    rows = lm.score(docs, targets, carry=["doc_id"], min_share=1e-3)
    got = {r["doc_id"]: r for r in rows.select("row.doc_id", "n_tokens", "target_loss", "background_loss", "score").collect()}
    texts = {i: words_of(t) for i, t, _ in corpus} | {None: [], 5000: [], 5001: words_of("grunk " * 20_000)}
    total = sum(map(len, texts.values()))
    seen = Counter(w for ws in texts.values() for w in ws)
    least = max(2, 1e-3 * total)
    vocab = {w for w, n in seen.items() if n >= least}
    read = lambda ws: [w if w in vocab else None for w in ws]
    pairs_all = Counter(p for ws in texts.values() for p in zip(["<s>", *read(ws)], read(ws)))
    kept = {p for p, n in pairs_all.items() if n >= least}

    def model(mine):
        uni = Counter(w for ws in mine for w in ws)
        pairs = Counter(p for ws in mine for p in zip(["<s>", *ws], ws))
        heads, share = Counter(), Counter()
        for (v, w), n in pairs.items():
            heads[v] += n
            share[v] += n * ((v, w) in kept)
        size, n_all = len(vocab) + 2, sum(uni.values())

        def loss(ws):
            out = 0.0
            for v, w in zip(["<s>", *ws], ws):
                n = max(heads[v], 1)
                p = (1 - lm.WEIGHT * share[v] / n) * (uni[w] + 1) / (n_all + size)
                p += lm.WEIGHT * pairs[v, w] / n if (v, w) in kept else 0.0
                out -= math.log(p)
            return out / len(ws)
        return loss

    losses = [model([read(ws) for ws in texts.values()]),
              model([read(ws) for i, ws in texts.items() if i is not None and i < 900 and i % 4 == 0])]
    for i in (0, 1, 7, 400, 899, 5001):
        ws = read(texts[i])
        assert got[i]["n_tokens"] == len(ws)
        assert abs(got[i]["background_loss"] - losses[0](ws)) < 1e-9
        assert abs(got[i]["target_loss"] - losses[1](ws)) < 1e-9
    assert got[None]["score"] is None and got[5000]["n_tokens"] == 0
    toxic = [got[i]["score"] for i, _, t in corpus if t]
    plain = [got[i]["score"] for i, _, t in corpus if not t]
    assert sum(toxic) / len(toxic) < sum(plain) / len(plain)  # the target texts are nearer to the target model
    assert lm.score(docs.limit(0), targets).count() == 0


def test_lm_target_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert lm.target_ids(labels).count() == 2500
    assert 300 < lm.target_ids(labels, 500).count() < 700


@pytest.mark.parametrize("block, bucket", [(1 << 20, 1 << 21), (30_000, 100_000), (999, 7_000_000)])
def test_lm_keeps_every_pair_seen_twice(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(lm, "BLOCK_WORDS", block)  # how words are cut into blocks and buckets changes no result
    monkeypatch.setattr(lm, "BUCKET_WORDS", bucket)
    texts = {i: "a b " * 25_000 for i in range(70)} | {100: "kiwi plum", 101: "kiwi plum once", 102: "a plum"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    targets = spark.createDataFrame([(0,), (100,), (101,)], "target_id long")
    got = {r["doc_id"]: r for r in lm.score(docs, targets, carry=["doc_id"]).select(
        "row.doc_id", "target_loss", "background_loss").collect()}
    for side, ids in (("background_loss", texts), ("target_loss", (0, 100, 101))):
        read = {i: ["?" if w == "once" else w for w in words_of(texts[i])] for i in ids}
        uni = Counter(w for ws in read.values() for w in ws)
        pairs = Counter(p for ws in read.values() for p in zip(["<s>", *ws], ws))
        fan = Counter()
        for (v, _), n in pairs.items():
            fan[v] += n
        kept = {("<s>", "a"), ("a", "b"), ("b", "a"), ("<s>", "kiwi"), ("kiwi", "plum")}  # twice in all documents
        for i in (0, 100, 101, 102):
            ws, out = ["?" if w == "once" else w for w in words_of(texts[i])], 0.0
            for v, w in zip(["<s>", *ws], ws):
                n = max(fan[v], 1)
                share = sum(pairs[p] for p in kept if p[0] == v) / n
                out -= math.log((1 - lm.WEIGHT * share) * (uni[w] + 1) / (sum(uni.values()) + 6)
                                + (lm.WEIGHT * pairs[v, w] / n if (v, w) in kept else 0.0))
            assert abs(got[i][side] - out / len(ws)) < 1e-9, (i, side)


def test_lm_target_is_every_good_document(spark):
    labels = spark.range(250_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert lm.target_ids(labels).count() == 250_000


def test_lm_moves_a_block_once_to_settle_and_once_to_score(spark, monkeypatch):
    """Asking moves no texts, and scoring a share of the blocks at a time: the disk holds less at once."""
    written = []

    def spy(df, name, *rest, **more):
        written.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return kept(df, name, *rest, **more)

    kept = lm.materialize
    monkeypatch.setattr(lm, "materialize", spy)
    monkeypatch.setattr(lm, "BLOCK_WORDS", 500)
    docs = spark.createDataFrame([(i, "a b c " * (i % 90 + 1)) for i in range(300)], "doc_id long, text string").repartition(3)
    assert lm.score(docs, docs.limit(9).select(F.col("doc_id").alias("target_id"))).count() == 300
    asks = [plan for name, plan in written if name == "lm-answers"]
    assert len(asks) == lm.SLICES and not any("CoGroup" in plan for plan in asks)
    assert [name for name, _ in written].count("lm-sums") == lm.SLICES


def test_lm_asks_sort_the_keys_of_their_slice_alone(monkeypatch):
    """Every slice used to sort all words of the block, and then all keys."""
    r = random.Random(3)
    texts = [[r.randrange(2, 300) for _ in range(r.randrange(1, 200))] for _ in range(100)]
    vocab = np.array([0, 1, *(r.randrange(-2**63, 2**63) for _ in range(298))])
    words = np.array([x for t in texts for x in (1, *t)], np.int32)
    sizes, target = np.array([len(t) + 1 for t in texts], np.int32), np.arange(100) % 3 == 0
    block = pa.RecordBatch.from_arrays(
        [pa.array([7]), *(lm._lists([0, len(x)], x) for x in (vocab, np.arange(100), sizes, target)),
         lm._packed([0, len(words)], words, 3)], ["block", "vocab", "at", "sizes", "target", "words"])

    want = [Counter(), Counter()]
    for t, hit in zip(texts, target):
        for v, w in zip([1, *t], t):
            for key in ((vocab[v], vocab[w]), (lm.UNIGRAM, vocab[w]), (vocab[v], lm.BACKOFF)):
                want[0][key] += 1
                want[1][key] += int(hit)
    keys = lm._mixed(*np.array([*want[0]], np.int64).T).tolist()

    compared = []
    for name in ("argsort", "unique"):
        monkeypatch.setattr(np, name, lambda x, *rest, of=getattr(np, name), **more: (compared.append(len(x)), of(x, *rest, **more))[1])
    asked = pa.Table.from_batches([b for k in range(lm.SLICES) for b in lm._ask(5, k)[0]([block])])
    monkeypatch.undo()
    key, v, n, t = (lm._flat(asked[c], of).tolist() for c, of in (("key", np.uint64), ("v", np.int64), ("n", np.int32), ("t", np.int32)))
    assert key == sorted(set(key)) and asked["bucket"].to_pylist() == [*range(5)]
    assert dict(zip(key, zip(n, t))) == {k: (want[0][x], want[1][x]) for k, x in zip(keys, want[0])}
    heads = {k: int(x[0]) if x[0] != lm.UNIGRAM and x[1] != lm.BACKOFF else lm.UNIGRAM for k, x in zip(keys, want[0])}
    assert dict(zip(key, v)) == heads
    assert sum(compared) <= 2 * (len(words) + 2 * len(vocab))


def test_lm_numbers_words_a_few_at_a_time(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i * i + j) % 41} ma\u00df" for j in range(i % 30))) for i in range(200)] + [(200, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    targets = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("target_id"))

    def losses():
        got = lm.score(docs, targets, carry=["doc_id"]).select("row.doc_id", "n_tokens", "target_loss", "background_loss")
        return {r[0]: (r[1], *(x and round(x, 9) for x in r[2:])) for r in got.collect()}

    whole = losses()
    monkeypatch.setattr(lm, "PENDING", 37)
    monkeypatch.setattr(lm, "BLOCK_WORDS", 300)
    assert losses() == whole and len(whole) == 201


def test_words_of_ascii_texts_equal_the_pattern():
    every = "".join(f"aB{chr(i)}c{chr(i)}" for i in range(128))
    for text in (every, every + "\u00e9", "K \u212a 1", "", " ", None):  # the Kelvin sign's lower case is an ASCII k
        assert words_of(text) == re.findall(r"\w+", (text or "").lower())
