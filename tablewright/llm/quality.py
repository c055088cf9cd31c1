"""Quality rules with risk-controlled thresholds.

Base rules are fixed (:data:`MIN_WORDS`, :data:`MAX_REPEAT_PERCENT`).  Beyond
them a document is rejected when one of its :data:`RATES` exceeds the cutoff of
its stratum (language).  The cutoffs come from labelled holdout texts: nothing
else is fitted, so every labelled text serves as holdout.

For each stratum, rate and cutoff of a fixed grid, the null hypothesis "this
cutoff rejects more than ``risk / len(RATES)`` of the good texts" is tested by
the exact binomial tail ``P(Bin(n, risk / len(RATES)) <= k)``, ``k`` of ``n``
good texts being rejected; this is the exact (Clopper-Pearson) upper bound read
as a test.  The cutoffs of one rate are tested as a fixed sequence from the
loosest to the strictest, which ends at the first that fails and so needs no
correction; the sequences of all strata and rates share the error ``delta``
(Bonferroni).  With probability ``1 - delta`` every stratum loses at most
``risk`` of its good texts, all rules together.  Among the cutoffs that pass,
the one with the best true minus ``FALSE_WEIGHT`` times false rejections is
taken, the highest on ties; a stratum without enough labels gets no cutoff and
loses nothing.

Defined cases: a null or empty text has no words and fails the base rule; a
null language is a stratum of its own; several labels of a document count as
the lowest; null labels and labels of unknown documents are ignored; equal
texts of a stratum count once in the holdout; without labels only the base
rules act; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fits, map_texts, materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
RATES = ("symbol_rate", "upper_rate", "dup_line_rate", "repeat_rate")
#: Cutoffs tried, fixed before any label is seen.
GRID = (0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
RISK = 0.05
DELTA = 0.05
FALSE_WEIGHT = 5.0
BROADCAST_STRATA = 100_000

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, symbol_rate double, upper_rate double, dup_line_rate double, repeat_rate double")

_word = re.compile(WORD)
_upper = re.compile("[A-Z]+")


def measure_text(text: str | None) -> tuple:
    """The values of :data:`FIELDS` for one whole text."""
    text = text or ""
    words = _word.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if _word.search(x)]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper = sum(map(len, _upper.findall(text)))
    return (n, chars, symbols, dup_lines, repeat,
            n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n,
            min(1.0, symbols / chars) if chars else 0.0, upper / chars if chars else 0.0,
            dup_lines / len(lines) if lines else 0.0, repeat / n if n else 0.0)


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more, each word once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measure(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns) and :data:`FIELDS` of each document."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def make():
        return lambda texts: dict(zip(names, map(list, zip(*map(measure_text, texts)))))

    return map_texts(docs, text, FIELDS, make, carry)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed in logarithms."""
    if k >= n:
        return 1.0
    log_p, log_q, top = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    terms = [top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k + 1)]
    most = max(terms)
    return min(1.0, math.exp(most) * math.fsum(math.exp(t - most) for t in terms))


def cutoffs(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff column per rate; null: the rate rejects nothing)
    from holdout rows (stratum, quality, rates)."""
    counts = holdout.select("stratum", "quality", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rate"), F.col(r).alias("value")) for r in RATES])).alias("x"))
    passed = sum((F.col("x.value") > F.lit(g)).cast("int") for g in GRID)
    counts = counts.groupBy("stratum", F.col("x.rate").alias("rate"), "quality", passed.alias("passed")) \
        .agg(F.count("*").alias("n"))
    tests = materialize(counts, "quality-counts")
    strata = tests.select("stratum").distinct().count()
    level = delta / max(1, strata * len(RATES))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = ([0] * (len(GRID) + 1), [0] * (len(GRID) + 1))
        for q, passed, n in zip(pdf["quality"], pdf["passed"], pdf["n"]):
            (good if q else bad)[int(passed)] += int(n)
        n_good, n_bad, best = sum(good), sum(bad), None
        for i in reversed(range(len(GRID))):
            false, true = sum(good[i + 1:]), sum(bad[i + 1:])
            if not n_good or binomial_tail(false, n_good, risk / len(RATES)) > level:
                break
            gain = (true / n_bad if n_bad else 0.0) - FALSE_WEIGHT * false / n_good
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, GRID[i])
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "rate": [pdf["rate"].iloc[0]],
                             "cutoff": [best[1] if best else None]}).astype({"cutoff": "float64"})

    chosen = tests.groupBy("stratum", "rate").applyInPandas(choose, "stratum string, rate string, cutoff double")
    return chosen.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rate") == r, F.when(~F.isnan("cutoff"), F.col("cutoff")))).alias(f"cut_{r}")
        for r in RATES])


def learn(measured: DataFrame, labels: DataFrame, key: str, stratum: str, digest, **kw) -> DataFrame:
    """Cutoffs per stratum from measured documents and a table (doc_id, quality)."""
    known = (labels.where("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    rows = measured.where("not base_failed").select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"),
                                                    digest.alias("digest"), *RATES)
    holdout = rows.join(known, "doc_id").groupBy("stratum", "digest").agg(
        F.min("quality").alias("quality"), *[F.min(r).alias(r) for r in RATES])
    return materialize(cutoffs(holdout, **kw), "quality-cutoffs")


def judge(measured: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """``measured`` with ``kept``: neither a base rule nor a cutoff rejects."""
    cuts = cuts.withColumnRenamed("stratum", "cut_stratum")
    if fits(cuts, BROADCAST_STRATA):
        cuts = F.broadcast(cuts)
    out = measured.join(cuts, F.col(stratum).eqNullSafe(F.col("cut_stratum")), "left")
    over = F.lit(False)
    for r in RATES:
        over = over | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~over)


def assess(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
           **kw) -> DataFrame:
    """One row per document: doc_id, :data:`FIELDS` and kept.  Texts are read
    once; the measures are written and used for the cutoffs and the verdicts."""
    slim = docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"),
                       F.xxhash64(text).alias("digest"))
    measured = measure(slim, "text", ["doc_id", "stratum", "digest"])
    measured = materialize(measured.select("row.*", *[c for c in measured.columns if c != "row"]), "quality")
    cuts = learn(measured, labels, "doc_id", "stratum", F.col("digest"), **kw)
    return judge(measured, cuts, "stratum").drop("cut_stratum", "digest", "stratum", *[f"cut_{r}" for r in RATES])


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
         **kw) -> DataFrame:
    """The documents kept, with the columns of ``docs``."""
    measured = measure(docs, text)
    cuts = learn(measured, labels, f"row.{key}", f"row.{stratum}", F.xxhash64(f"row.{text}"), **kw)
    return judge(measured, cuts, f"row.{stratum}").where("kept").select("row.*")
