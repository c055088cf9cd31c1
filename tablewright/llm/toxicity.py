"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary
texts, share one vocabulary and one lowest order: a bigram backs off to its
class's continuation counts, those to continuation counts pooled over both
classes.  What few contexts or texts have shown is no evidence for a class: the
log ratio of each order counts by the confidence ``n / (n + CONFIDENCE)`` of its
pooled count and otherwise falls back to the next lower order (in the end: no
difference).  Equal texts of a class count once.  A text's features are the length-normalised log-likelihood difference of its words, over
the whole text and over its highest window of ``WINDOW`` words (a short insult
in a long text); a logistic curve turns them into a probability.

Labels enter as a bounded sample: at most about ``FIT_ROWS`` texts per class
fit the counts and ``CALIBRATION_ROWS`` per class the curve (drawn by hash of
the key, disjoint); the curve weighs the classes back to their shares.  Bigrams
seen once in all serve the backoff counts only.  Every
document is scored.  The model's size is bounded by the sample, and checked.

Defined cases: a null or empty text has features 0 and so the curve's value
there; null labels and labels of unknown documents are ignored, the largest of
several labels counts; if a part of the sample lacks a class, every score is the
toxic share of the labels (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, unit_hash
from .words import find, ids_of, pairs_of, per_text, vocabulary, words_of

FIT_ROWS = 4_000
CALIBRATION_ROWS = 3_000
DISCOUNT = 0.75
WINDOW = 6
CONFIDENCE = 20.0
#: Words seen less often in the sample count as the unknown word.
MIN_COUNT = 2
MODEL_BYTES = 512 << 20


class Model:
    """Counts of both classes (ordinary, toxic) as arrays over word ids and
    sorted bigram keys.

    ``words``: the vocabulary; ``kinds``: per class and pooled, how many words
    precede each word; ``heads``: per class, how often each word precedes
    another; ``fans``: per class, how many words follow it; ``keys`` and
    ``counts``: the bigrams and their counts per class."""

    def __init__(self, words: list[str], kinds: np.ndarray, heads: np.ndarray, fans: np.ndarray,
                 keys: np.ndarray, counts: np.ndarray):
        self.ids = vocabulary(words)
        self.size = len(words) + 2
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[:, order].astype(np.float32)
        pooled = kinds[2] + 1.0
        shared = pooled / pooled.sum()
        self.trust = (pooled / (pooled + CONFIDENCE)).astype(np.float32)
        both = self.counts.sum(0)
        self.trust_pair = both / (both + np.float32(CONFIDENCE))
        self.lower, self.total, self.backoff = [], [], []
        for k in range(2):
            seen, n = np.count_nonzero(kinds[k]), max(kinds[k].sum(), 1.0)
            left = DISCOUNT * seen / n if seen else 1.0
            self.lower.append((np.maximum(kinds[k] - DISCOUNT, 0) / n + left * shared).astype(np.float32))
            total = np.maximum(heads[k], 1)
            self.total.append(total.astype(np.float32))
            self.backoff.append(np.where(heads[k] > 0, DISCOUNT * fans[k] / total, 1.0).astype(np.float32))

    def nbytes(self) -> int:
        arrays = [self.keys, self.counts, self.trust, self.trust_pair, *self.lower, *self.total, *self.backoff]
        return sum(a.nbytes for a in arrays) + sum(len(w) + 100 for w in self.ids)

    def features(self, texts: list) -> np.ndarray:
        """(texts, 2): mean difference of the log-likelihoods per word, and the
        largest mean over a window."""
        flat, starts = ids_of(texts, self.ids)
        before, keys = pairs_of(flat, starts, self.size)
        at, there = find(self.keys, keys)
        lower = self.trust[flat] * np.log(self.lower[1][flat] / self.lower[0][flat])
        logs = []
        for k in range(2):
            c = np.where(there, self.counts[k][at], 0) if len(self.keys) else np.zeros(len(flat))
            p = np.maximum(c - DISCOUNT, 0) / self.total[k][before] + self.backoff[k][before] * self.lower[k][flat]
            logs.append(np.log(p))
        trust = np.where(there, self.trust_pair[at], 0.0) if len(self.keys) else 0.0
        diff = (trust * (logs[1] - logs[0]) + (1 - trust) * lower).astype(float)
        n = np.maximum(np.diff(starts), 1)
        whole = per_text(diff, starts) / n
        sums = np.concatenate([[0.0], np.cumsum(diff)])
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        end = np.minimum(np.arange(len(flat)) + WINDOW, starts[1:][owner]) if len(flat) else np.zeros(0, np.int64)
        # windows cut short by the text's end are still divided by the full width
        peak = per_text((sums[end] - sums[:-1]) / WINDOW, starts, np.maximum)
        return np.stack([whole, peak], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple:
    """Logistic regression by Newton steps on standardised features:
    (mean, scale, coefficients)."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    b, weight = np.zeros(z.shape[1]), weight / weight.mean()
    penalty = ridge * len(x) * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (y - p)) - penalty @ b
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def _sample(labels: DataFrame, rows: dict[str, int]) -> tuple[DataFrame, dict]:
    """(doc_id, toxic, part, share drawn) of a bounded sample, and the class sizes.

    Documents are dealt to the parts by hash, two thirds to ``fit``."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg((F.max("toxic") >= 1).cast("int").alias("toxic")))
    part = F.when(unit_hash(F.lit("part"), "doc_id") < 2 / 3, "fit").otherwise("calibrate")
    known = known.withColumn("part", part)
    sizes = {(r["part"], r["toxic"]): r["n"] for r in known.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for (p, c), n in sizes.items():
        rate = F.when((F.col("part") == p) & (F.col("toxic") == c), F.lit(min(1.0, rows[p] / n))).otherwise(rate)
    drawn = known.withColumn("rate", rate).where(unit_hash(F.lit("draw"), "doc_id") < F.col("rate"))
    return drawn, sizes


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          carry: list[str] | None = None, fit_rows: int = FIT_ROWS,
          calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """``row`` (the carried columns) and ``score`` for every document; learned
    from ``labels`` (doc_id, toxic)."""
    drawn, sizes = _sample(labels, {"fit": fit_rows, "calibrate": calibration_rows})
    by_class = [sum(n for (_, c), n in sizes.items() if c == k) for k in (0, 1)]
    prior = docs.select(F.struct(*(carry or docs.columns)).alias("row"),
                        F.lit(by_class[1] / max(1, sum(by_class))).alias("score"))
    if not all(sizes.get((p, c)) for p in ("fit", "calibrate") for c in (0, 1)):
        return prior

    # the drawn labels are bounded by the two row counts
    ids = F.broadcast(drawn.withColumnRenamed("doc_id", "label_id"))
    sample = materialize(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
                         .join(ids, F.col("doc_id") == F.col("label_id")).drop("label_id")
                         .dropDuplicates(["part", "toxic", "text"]), "toxic-sample")
    model = _fit(sample.where("part = 'fit'"))
    if model.nbytes() > MODEL_BYTES:
        raise ValueError("the toxicity model exceeds its size bound: lower fit_rows")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features():
        def fn(texts):
            x = shared.value.features(texts)
            return {"whole": x[:, 0].tolist(), "peak": x[:, 1].tolist()}
        return fn

    held = map_texts(sample.where("part = 'calibrate'"), "text", "whole double, peak double", features,
                     ["toxic", "rate"]).select("row.*", "whole", "peak").toPandas()
    if held["toxic"].nunique() < 2:
        return prior
    curve = fit_curve(held[["whole", "peak"]].to_numpy(float), held["toxic"].to_numpy(float),
                      1 / held["rate"].to_numpy(float))

    def scores():
        mean, scale, b = curve

        def fn(texts):
            z = b[0] + ((shared.value.features(texts) - mean) / scale) @ b[1:]
            return {"score": (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()}
        return fn

    return map_texts(docs, text, "score double", scores, carry)


def _fit(sample: DataFrame) -> Model:
    """Counts of the sample, grouped in Spark; the tables are bounded by it."""
    def words(batches):
        import pyarrow as pa
        from collections import Counter

        seen = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(words_of(t))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()),
                                          "n": pa.array(list(seen.values()), pa.int64())})

    vocab = (sample.select("text").mapInArrow(words, "word string, n long").groupBy("word")
             .agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT).select("word").toPandas()["word"])
    vocab = sorted(vocab)
    shared = sample.sparkSession.sparkContext.broadcast(vocab)

    def bigrams(batches):
        import pyarrow as pa

        ids = vocabulary(shared.value)
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist())
            for at in range(0, batch.num_rows, 512):
                flat, starts = ids_of(batch.column(0).slice(at, 512).to_pylist(), ids)
                _, keys = pairs_of(flat, starts, len(ids) + 2)
                of = np.repeat(toxic[at:at + 512], np.diff(starts))
                found, place = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(found, pa.int64()),
                    "ordinary": pa.array(np.bincount(place, weights=1 - of, minlength=len(found)).astype(np.int64)),
                    "toxic": pa.array(np.bincount(place, weights=of, minlength=len(found)).astype(np.int64))})

    size = len(vocab) + 2
    pairs = (sample.select("text", "toxic").mapInArrow(bigrams, "key long, ordinary long, toxic long")
             .groupBy("key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))
    pairs = materialize(pairs, "toxic-pairs")
    by_word = pairs.groupBy((F.col("key") % size).alias("w")).agg(
        F.count_if(F.col("ordinary") > 0).alias("a"), F.count_if(F.col("toxic") > 0).alias("b"),
        F.count("*").alias("c")).toPandas()
    by_head = pairs.groupBy(F.floor(F.col("key") / size).cast("long").alias("v")).agg(
        F.sum("ordinary").alias("a"), F.sum("toxic").alias("b"), F.count_if(F.col("ordinary") > 0).alias("c"),
        F.count_if(F.col("toxic") > 0).alias("d")).toPandas()
    kinds, heads, fans = np.zeros((3, size)), np.zeros((2, size)), np.zeros((2, size))
    kinds[:, by_word["w"].to_numpy(np.int64)] = by_word[["a", "b", "c"]].to_numpy(float).T
    heads[:, by_head["v"].to_numpy(np.int64)] = by_head[["a", "b"]].to_numpy(float).T
    fans[:, by_head["v"].to_numpy(np.int64)] = by_head[["c", "d"]].to_numpy(float).T
    often = pairs.where(F.col("ordinary") + F.col("toxic") >= 2).select(
        "key", F.col("ordinary").cast("int").alias("ordinary"), F.col("toxic").cast("int").alias("toxic")).toPandas()
    return Model(vocab, kinds, heads, fans, often["key"].to_numpy(np.int64),
                 often[["ordinary", "toxic"]].to_numpy().T)
