"""Line dedup: lines that many documents share stay in one of them.

1. every text is exploded into its lines; a line's key is the line without
   white space at both ends, A-Z lower-cased; keys of at least ``min_chars``
   code points are hashed to 128 bits and written once with the line's
   position;
2. per hash the distinct documents are counted (first per hash and document,
   then per hash, both with partial sums, so a line that every document holds
   meets in one row per task);
3. lines of keys with ``min_docs`` documents or more lose their place in every
   document but the smallest; the join of lines with such keys is a plain
   shuffle join of two written tables, which Spark splits at a hot key;
4. the dropped positions of a text meet the text again, and what is left is
   reassembled by position.

A text and its document id, hashed to 128 bits, identify a row: rows that
repeat both share their decisions.

Defined cases: a null or empty text is one empty line; rows with one id are one
document, null ids too, and null is the largest id; a text that loses all lines
is empty; an empty table gives no rows; further columns are carried in ``row``,
whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

#: White space that does not count at both ends of a line (code points 32, 9 to 13).
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line) -> F.Column:
    """A line without white space at both ends, A-Z alone lower-cased."""
    bare = F.trim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _digest(name: str, *cols) -> list[F.Column]:
    """Two 64-bit hashes of different seeds."""
    return [F.xxhash64(*cols).alias(f"{name}1"), F.xxhash64(F.lit("second"), *cols).alias(f"{name}2")]


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, first): hashes found in at least ``min_docs`` documents and the
    smallest of these, from (h1, h2, doc, ...) rows."""
    per_doc = lines.select("h1", "h2", "doc").distinct()
    return (per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
            .where(F.col("n") >= min_docs).select("h1", "h2", "first"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 2, min_chars: int = 10,
                carry: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the ``carry`` columns, default all), n_lines (before
    dropping), n_dropped and kept (the text that is left)."""
    given = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col(key).alias("doc"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = F.split(F.col("text"), "\n", -1)
    uid = _digest("u", "doc", "text")
    lines = given.select("doc", *uid, F.posexplode(split).alias("pos", "line"))
    keyed = lines.select("doc", "u1", "u2", "pos", line_key(F.col("line")).alias("key"))
    lines = materialize(keyed.where(F.length("key") >= min_chars).select("doc", "u1", "u2", "pos", *_digest("h", "key")),
                        "line-keys")
    shared = materialize(shared_lines(lines, min_docs), "line-shared")
    dropped = materialize(
        lines.join(shared, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first")))
        .groupBy("u1", "u2").agg(F.collect_set("pos").alias("drop")), "line-dropped")
    drop(lines)
    drop(shared)
    whole = given.select("row", *uid, split.alias("lines")).join(dropped, ["u1", "u2"], "left")
    n = F.size("lines").cast("long")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(left, lambda p: F.col("lines")[p]))
    return whole.select("row", n.alias("n_lines"),
                        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
                        F.array_join(kept, "\n").alias("kept"))
