"""Ranked lexical search by blocked dense products.

Items are packed into blocks of a bounded number of items and terms.  For a
block,

1. every document is split once; of its terms only those of the block's
   vocabulary are kept, in tiles of documents (term numbers and occurrences),
   together with each task's document frequencies, documents and lengths;
2. the frequencies are summed and give the integer weight of every term;
3. each tile of documents is laid out as a dense matrix of impacts, the
   vocabulary in tiles of at most :data:`TILE_TERMS` terms as dense matrices of
   item weights, and BLAS multiplies them in float64.  A vocabulary tile ends
   where an item's weights times the largest impact would reach 2^53, and a
   weight beyond that room goes on in the next tile, so every partial sum is an
   exact integer; tiles are added in 64-bit integers;
4. a task keeps the k best of each item (equal scores by document id), which
   one window over ``tasks x items x k`` rows ranks.

Nothing of a document but its vocabulary postings is shuffled or written.

Defined cases: a null or empty text has no terms and is not counted; an item
without terms, or whose terms no document holds, has no rows; a null document
id sorts last; rows that repeat an id are documents of their own, repeated
items are searched each; empty tables give no rows; further columns are not
read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import ship_package

from .common import arrow_schema, materialize, record_batch
from .terms import ascii_but, term_splitter

# Fixed values of the ranking.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
APART = ascii_but("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SCALE, LENGTH_SHARE = 1000, 75
#: No impact exceeds SCALE ** 3 * tf // (SCALE * tf).
LARGEST_IMPACT = SCALE ** 2
#: Sizes of a block of items and of the tiles; they bound memory, not results.
BLOCK_ITEMS, BLOCK_TERMS = 1024, 200_000
TILE_DOCS, TILE_POSTINGS, TILE_TERMS = 512, 1 << 19, 1024

_TILES = ("keys array<bigint>, sizes array<bigint>, ends array<int>, terms array<int>, tfs array<int>, "
          "df_terms array<int>, dfs array<bigint>, n_docs bigint, n_terms bigint")
_HITS = "slot int, item_id bigint, doc_id bigint, score bigint"


def item_blocks(items: DataFrame, item: str, text: str) -> DataFrame:
    """Items packed into rows of at most BLOCK_ITEMS items and BLOCK_TERMS
    entries (an item of more has a row of its own)."""
    fields = "ids array<bigint>, ends array<int>, terms array<binary>, counts array<bigint>"
    schema, n = arrow_schema(fields), items.count()

    def run(batches):
        split = term_splitter(APART)
        row = {"ids": [], "ends": [], "terms": [], "counts": []}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(split(raw))
                if not found:
                    continue
                if row["ids"] and (len(row["ids"]) == BLOCK_ITEMS or len(row["terms"]) + len(found) > BLOCK_TERMS):
                    yield record_batch(schema, [row])
                    row = {"ids": [], "ends": [], "terms": [], "counts": []}
                row["ids"].append(i)
                row["terms"] += found.keys()
                row["counts"] += found.values()
                row["ends"].append(len(row["terms"]))
        if row["ids"]:
            yield record_batch(schema, [row])

    given = items.select(F.col(item).cast("long").alias("item"), F.col(text).cast("binary").alias("text"))
    return given.repartition(max(1, math.ceil(n / BLOCK_ITEMS))).mapInArrow(run, fields)


def document_tiles(docs: DataFrame, key: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """Postings of the vocabulary in tiles of documents, and per task one row
    with document frequencies, documents and terms."""
    schema = arrow_schema(_TILES)

    def run(batches):
        split, get = term_splitter(APART), {t: i for i, t in enumerate(vocabulary)}.get
        dfs = np.zeros(len(vocabulary) + 1, np.int64)
        n_docs = n_terms = 0
        fresh = lambda: {"keys": [], "sizes": [], "ends": [], "terms": [], "tfs": []}
        tile = fresh()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for k, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = split(raw)
                    if not words:
                        continue
                    n_docs += 1
                    n_terms += len(words)
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    if not found:
                        continue
                    tile["keys"].append(k)
                    tile["sizes"].append(len(words))
                    tile["terms"] += found.keys()
                    tile["tfs"] += found.values()
                    tile["ends"].append(len(tile["terms"]))
                    if len(tile["keys"]) >= TILE_DOCS or len(tile["terms"]) >= TILE_POSTINGS:
                        dfs += np.bincount(tile["terms"], minlength=len(dfs))
                        yield record_batch(schema, [tile])
                        tile = fresh()
        if tile["keys"]:
            dfs += np.bincount(tile["terms"], minlength=len(dfs))
            yield record_batch(schema, [tile])
        seen = np.flatnonzero(dfs)
        yield record_batch(schema, [{"df_terms": seen.tolist(), "dfs": dfs[seen].tolist(), "n_docs": n_docs,
                                    "n_terms": n_terms}])

    given = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return given.mapInArrow(run, _TILES)


def vocabulary_tiles(terms: np.ndarray, slots: np.ndarray, weights: list[int], largest: int = LARGEST_IMPACT,
                     width: int = TILE_TERMS) -> list[tuple]:
    """(terms, row of each entry, item slot, weight) per tile, entries sorted by
    term: per item the weights of a tile times ``largest`` stay below 2^53."""
    room = ((1 << 53) - 1) // largest
    tiles, used = [], {}
    names, rows, cols, vals = [], [], [], []

    def close():
        tiles.append((np.array(names, np.int64), np.array(rows), np.array(cols), np.array(vals, np.float64)))
        for part in (names, rows, cols, vals):
            part.clear()
        used.clear()

    for t, s, w in zip(terms.tolist(), slots.tolist(), weights):
        while w > 0:
            if names and (used.get(s, 0) >= room or (names[-1] != t and len(names) == width)):
                close()
            if not names or names[-1] != t:
                names.append(t)
            part = min(w, room - used.get(s, 0))
            used[s] = used.get(s, 0) + part
            rows.append(len(names) - 1)
            cols.append(s)
            vals.append(part)
            w -= part
    if names:
        close()
    return tiles


def tile_scores(doc, terms, impacts, n_docs: int, tiles: list[tuple], n_items: int) -> np.ndarray:
    """Scores (documents x items) of one tile of documents, in 64-bit integers."""
    total = np.zeros((n_docs, n_items), np.int64)
    for names, rows, cols, vals in tiles:
        at = np.searchsorted(names, terms)
        here = np.flatnonzero(names[np.minimum(at, len(names) - 1)] == terms)
        if not len(here):
            continue
        left = np.zeros((n_docs, len(names)))
        left[doc[here], at[here]] = impacts[here]
        right = np.zeros((len(names), n_items))
        right[rows, cols] = vals
        total += (left @ right).astype(np.int64)
    return total


class Best:
    """The k best (score, document) of every item; equal scores keep the
    smaller id, a null id is the largest."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        none = np.empty(0, np.int64)
        self.kept = [(none, none, np.empty(0, bool))] * n_items

    def add(self, scores: np.ndarray, keys: np.ndarray, nulls: np.ndarray) -> None:
        for j in np.flatnonzero(scores.max(axis=0) >= self.floor):
            rows = np.flatnonzero(scores[:, j] >= self.floor[j])
            old = self.kept[j]
            s, d, n = (np.concatenate(x) for x in zip(old, (scores[rows, j], keys[rows], nulls[rows])))
            best = np.lexsort((d, n, -s))[:self.k]
            self.kept[j] = s[best], d[best], n[best]
            if len(best) == self.k:
                self.floor[j] = s[best[-1]]  # equal scores may still bring a smaller id


def _rank(tiles: DataFrame, ids: list, vocab_tiles: list[tuple], n_docs: int, n_terms: int, k: int) -> DataFrame:
    schema = arrow_schema(_HITS)

    def run(batches):
        best = Best(len(ids), k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].values for n in ("keys", "sizes", "ends", "terms", "tfs")}
                keys, nulls = row["keys"].fill_null(0).to_numpy(), row["keys"].is_null().to_numpy(zero_copy_only=False)
                base = 100 - LENGTH_SHARE
                m = np.array([base + LENGTH_SHARE * n * n_docs // n_terms for n in row["sizes"].to_pylist()], np.int64)
                doc = np.repeat(np.arange(len(keys)), np.diff(row["ends"].to_numpy(), prepend=0))
                tf = row["tfs"].to_numpy().astype(np.int64)
                impacts = SCALE ** 3 * tf // (SCALE * tf + 8 * m[doc])
                best.add(tile_scores(doc, row["terms"].to_numpy(), impacts, len(keys), vocab_tiles, len(ids)),
                         keys, nulls)
        for slot, (scores, keys, nulls) in enumerate(best.kept):
            rows = [{"slot": slot, "item_id": ids[slot], "doc_id": None if n else d, "score": s}
                    for s, d, n in zip(scores.tolist(), keys.tolist(), nulls.tolist())]
            if rows:
                yield record_batch(schema, rows)

    fields = ["keys", "sizes", "ends", "terms", "tfs"]
    hits = tiles.where(F.col("keys").isNotNull()).select(*fields).mapInArrow(run, _HITS)
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` highest-scoring documents.
    ``key`` and ``item`` are integer columns."""
    spark = docs.sparkSession
    ship_package(spark)
    found = []
    for block in materialize(item_blocks(items, item, item_text), "lexical-items").toLocalIterator():
        vocabulary = sorted({bytes(t) for t in block["terms"]})
        number = {t: i for i, t in enumerate(vocabulary)}
        tiles = materialize(document_tiles(docs, key, text, vocabulary), "lexical-tiles")
        sums = tiles.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        n_docs, n_terms = map(int, sums)
        dfs = np.zeros(len(vocabulary), np.int64)
        for r in (tiles.select(F.inline(F.arrays_zip("df_terms", "dfs"))).groupBy("df_terms")
                  .agg(F.sum("dfs").alias("n")).collect()):  # at most BLOCK_TERMS rows, or one item's terms
            dfs[r["df_terms"]] = r["n"]
        weight = np.floor(SCALE * np.log((2.0 * n_docs + 2) / (2 * dfs + 1))).astype(np.int64)
        slots = np.repeat(np.arange(len(block["ids"])), np.diff(block["ends"], prepend=0))
        terms = np.array([number[bytes(t)] for t in block["terms"]], np.int64)
        order = np.argsort(terms, kind="stable")
        weights = [int(weight[t]) * c for t, c in zip(terms[order].tolist(), np.array(block["counts"])[order].tolist())]
        found.append(_rank(tiles, list(block["ids"]), vocabulary_tiles(terms[order], slots[order], weights),
                           n_docs, n_terms, k))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionAll, found)
