"""Secret scans: fixed patterns plus sliding-window entropy, in SQL functions only.

Base kinds are regular expressions (:data:`KINDS`), leftmost and without
overlap; a match that fails its length rule is dropped.  The entropy kind cuts
the text into maximal runs of each character class (:data:`CLASSES`) and moves
the class's window over them: the counts per character and the sum of ``c * log2(c)`` are
updated by the character that enters and the one that leaves, and the window's
entropy is ``log2(w) - sum / w``.  A run is reported from its first to
its last window above the class's bits, unless an allow-list pattern matches it
or a base span or another class's span already covers it.

Positions count code points from 0, ends are exclusive.  They come from the
texts between the matches (``split``) and the matches themselves
(``regexp_extract_all``), whose lengths add up.

Defined cases: a null text is the empty text and has no spans; equal spans of
two kinds are both listed; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in order.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_MIN = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes: name, maximal runs, what a whole run must look like, window, bits.
CLASSES = (
    ("base64", CANDIDATE, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])(?!^[0-9A-Fa-f]+$)", 20, 3.6),
    ("hex", r"[0-9A-Fa-f]{20,}", r"^(?=.*[0-9])(?=.*[A-Fa-f])", 20, 3.0),
    ("lower", r"[a-z0-9]{20,}", r"^(?=.*[0-9].*[0-9])(?=.*[a-z])", 20, 3.6),
    ("upper", r"[A-Z0-9]{20,}", r"^(?=.*[0-9])(?=.*[A-Z])", 20, 3.5),
    ("letters", r"[A-Za-z]{32,}", r"^(?=.*[a-z])(?=.*[A-Z])", 32, 4.25),
    ("long hex", r"[0-9A-Fa-f]{24,}", r"^(?=.*[0-9])(?=.*[A-Fa-f])", 24, 3.0),
    ("one case", r"[a-z]{32,}|[A-Z]{32,}", r"", 32, 3.88),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates that are no secrets: UUIDs, numbers and dates, one repeated character, documentation samples.
ALLOW = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[0-9_+=/-]+$",
    r"^(.)\1+$",
    r"(?i)example|placeholder|sample|dummy|x{8}",
)
MARK = "[SECRET]"

_SPAN = "struct<start:int,end:int>"


def _matches(text: Column, pattern: str, keep=None) -> Column:
    """array<struct(start, end)> of the matches of ``pattern`` in ``text``;
    ``keep(zipped)`` says of a match (fields m and, if given, g) whether it counts."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        *([F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("g")] if keep else []))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        hit = F.array(F.struct(begin.alias("start"), end.alias("end")))
        counts = x["m"].isNotNull() if keep is None else (x["m"].isNotNull() & keep(x))
        return F.struct(F.coalesce(end, begin).alias("at"),
                        F.when(counts, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _g(c: Column) -> Column:
    """c * log2(c), 0 for counts of 0 and 1."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _windows(run: Column, width: int, bits: float) -> Column:
    """struct(first, last): start of the first and end of the last window of
    ``run`` whose entropy reaches ``bits`` (null if none)."""
    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
                    F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    pairs = F.transform(codes, lambda c, i: F.struct(
        c.alias("into"), F.when(i >= width, F.get(codes, i - width)).otherwise(F.lit(-1)).alias("out")))

    def step(acc, x):
        c_in = F.get(acc["counts"], x["into"])
        # the character that leaves; the same one entering and leaving changes nothing
        c_out = F.get(acc["counts"], x["out"])
        changed = x["into"] != x["out"]
        total = acc["sum"] + F.when(changed, _g(c_in + 1) - _g(c_in)).otherwise(0.0) \
            + F.when(changed & (x["out"] >= 0), _g(c_out - 1) - _g(c_out)).otherwise(0.0)
        counts = F.when(changed, F.transform(acc["counts"], lambda c, j: c + (j == x["into"]).cast("int")
                                             - (j == x["out"]).cast("int"))).otherwise(acc["counts"])
        i = acc["i"] + 1
        hit = (i >= width) & (F.lit(math.log2(width)) - total / F.lit(float(width)) >= bits)
        return F.struct(counts.alias("counts"), total.alias("sum"), i.alias("i"),
                        F.when(hit & acc["first"].isNull(), i - width).otherwise(acc["first"]).alias("first"),
                        F.when(hit, i).otherwise(acc["last"]).alias("last"))

    return F.aggregate(pairs, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy(text: Column, base: Column, classes=CLASSES, allow=ALLOW) -> Column:
    """Spans of the entropy kind, of every class, outside the ``base`` spans."""
    def judged(looks, width, bits):
        def of(span):
            run = F.substring(text, span["start"] + 1, span["end"] - span["start"])
            allowed = F.lit(False)
            for pattern in allow:
                allowed = allowed | run.rlike(pattern)
            hit = F.when(~allowed & run.rlike(looks), _windows(run, width, bits))
            return F.struct((span["start"] + hit["first"]).alias("start"), (span["start"] + hit["last"]).alias("end"))
        return of

    found = [F.when(text.rlike(pattern), F.transform(_matches(text, pattern), judged(looks, width, bits)))
             .otherwise(_none()) for _, pattern, looks, width, bits in classes]
    return F.filter(F.array_distinct(F.concat(*found)), lambda s: s["start"].isNotNull() & ~F.exists(
        base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))


def _widest(spans: Column) -> Column:
    """The distinct ``spans`` that no other one covers."""
    return F.filter(spans, lambda s: ~F.exists(
        spans, lambda b: (b != s) & (b["start"] <= s["start"]) & (b["end"] >= s["end"])))


def _of_kind(n: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), x["end"].alias("end"))


def scan(docs: DataFrame, text: str = "text", out: str = "secrets", allow=ALLOW) -> DataFrame:
    """``docs`` with the column ``out``: a struct of one span array per kind
    and ``all``, array<struct(start, kind (index into KINDS), end)> in order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.struct(
        F.when(whole.rlike(ASSIGN), _matches(whole, ASSIGN, lambda x: F.length(x["g"]) >= ASSIGN_MIN))
        .otherwise(_none()).alias("assign"),
        F.when(F.contains(whole, F.lit("AKIA")), _matches(whole, ACCESS)).otherwise(_none()).alias("access"),
        F.when(whole.rlike(HEX), _matches(whole, HEX)).otherwise(_none()).alias("hex"))
    docs = docs.withColumn(out, found)
    s = F.col(out)
    base = F.concat(s["assign"], s["access"], s["hex"])
    docs = docs.withColumn(out, s.withField("entropy", F.when(
        whole.rlike(CANDIDATE), _entropy(whole, base, allow=allow)).otherwise(_none())))
    docs = docs.withColumn(out, F.col(out).withField("entropy", _widest(F.col(out)["entropy"])))
    every = F.concat(*[F.transform(F.col(out)[k], _of_kind(n)) for n, k in enumerate(KINDS)])
    return docs.withColumn(out, F.col(out).withField("all", F.array_sort(every)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def base_spans(out: str = "secrets") -> Column:
    return F.filter(F.col(out)["all"], lambda x: x["kind"] < len(KINDS) - 1)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mark: str = MARK) -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by
    one) and ``length``, if given, recounted for the changed texts."""
    rows = scan(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text")
    spans = F.col("secrets")["all"]
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        begin = F.greatest(acc["at"], x["start"])
        new = x["start"] >= acc["at"]
        text_before = F.substring(F.col("text"), acc["at"] + 1, begin - acc["at"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"),
                        F.when(new, F.concat(acc["out"], text_before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(
        acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    hit = F.size(spans) > 0
    row = F.col("row").withField(text, F.when(hit, clean).otherwise(F.col("text")))
    rows = rows.withColumn("row", row)
    if length:
        kind = docs.schema[length].dataType
        rows = rows.withColumn("row", F.col("row").withField(length, F.when(
            hit, F.length(F.col(f"row.{text}"))).otherwise(F.col(f"row.{length}")).cast(kind)))
    return rows.select("row.*")
