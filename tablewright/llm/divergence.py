"""Source divergence audit by single-pass in-memory indexing.

1. every task reads its documents once and builds their postings in memory.  At
   :data:`RUN_POSTINGS` occurrences the block is spilled as a term-sorted run:
   per lang and term the documents, and the occurrences in each source, in rows
   of :data:`CHUNK` terms dealt to shards by the term's hash;
2. a shard's chunks arrive sorted by their first term; a heap merges the runs
   and holds only the chunks open at the current term.  Terms in at least
   ``min_docs`` documents of their lang are written with their frequencies;
3. sizes of groups and langs are summed from the frequencies.  A pair of groups
   that both lack a term has the same value for every such term, so a pair's
   sum is that value times the kept terms, plus corrections streamed from the
   terms that one of the two holds.

All arithmetic is on integers.  The driver holds one row per (lang, source)
group; the result's ``pair`` part has the square of these.

Defined cases: null text, lang and source read as the empty text; a group
without terms, or a lang without kept terms, has its pairs (value 0 where no
term is kept); a lang with one source has no pairs; repeated rows are documents
of their own; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from itertools import count
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import ship_package

from .common import arrow_schema, fits, materialize, record_batch
from .terms import ascii_but, term_splitter

# Fixed values of the audit.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
APART = ascii_but("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
ONE = 1_000_000_000
#: Term occurrences held before a run is spilled, terms of a chunk, cells of a dense block: they bound memory, not
#: results.
RUN_POSTINGS, CHUNK, BLOCK_CELLS = 4_000_000, 512, 1 << 20
#: The group table is broadcast up to this many rows, else joined by shuffle.
BROADCAST_GROUPS = 100_000

_RUNS = ("shard int, lang string, first binary, terms array<binary>, dfs array<bigint>, ends array<int>, "
         "names array<string>, source array<int>, tfs array<bigint>")
_FREQUENCIES = "lang string, term string, total bigint, sources array<string>, counts array<bigint>"
_CORRECTIONS = "lang string, source string, other string, value decimal(38,0)"


class Block:
    """Postings of the documents read since the last spill: per document the
    numbers of its terms, in the order of reading."""

    def __init__(self):
        self.number = defaultdict(count().__next__)
        self.terms, self.sizes, self.owners = array("i"), array("q"), array("i")
        self.groups = {}

    def add(self, lang: str, source: str, terms: list[bytes]) -> None:
        self.terms.extend(map(self.number.__getitem__, terms))
        self.sizes.append(len(terms))
        self.owners.append(self.groups.setdefault((lang, source), len(self.groups)))

    def run(self, shards: int):
        """Chunks of the term-sorted run: shard by shard, lang by lang."""
        if not self.terms:
            return
        words = sorted(self.number)
        rank = np.empty(len(words), np.int64)
        rank[[self.number[w] for w in words]] = np.arange(len(words))
        # one posting per document and term
        docs = np.repeat(np.arange(len(self.sizes)), np.frombuffer(self.sizes, np.int64))
        keys, tfs = np.unique(docs * len(words) + rank[np.frombuffer(self.terms, np.int32)], return_counts=True)
        docs, term = np.divmod(keys, len(words))
        langs, lang_of = np.unique([g[0] for g in self.groups], return_inverse=True)
        sources, source_of = np.unique([g[1] for g in self.groups], return_inverse=True)
        owner = np.frombuffer(self.owners, np.int32)[docs]
        lang, source = lang_of[owner], source_of[owner]
        shard = np.array([crc32(w) % shards for w in words])[term]
        order = np.lexsort((source, term, lang, shard))
        shard, lang, term, source, tfs = (x[order] for x in (shard, lang, term, source, tfs))
        # postings of a term in a lang are one entry, those of a source too
        entry = np.flatnonzero(_changes(shard, lang, term))
        cell = np.flatnonzero(_changes(shard, lang, term, source))
        dfs = np.diff(np.append(entry, len(term)))
        sums = np.add.reduceat(tfs, cell)
        bounds = np.append(np.searchsorted(cell, entry), len(cell))
        heads = np.flatnonzero(_changes(shard[entry], lang[entry]))
        for low, end in zip(heads, np.append(heads[1:], len(entry))):
            for at in range(low, end, CHUNK):
                to = min(at + CHUNK, end)
                part = [words[i] for i in term[entry[at:to]].tolist()]
                names, which = np.unique(source[cell[bounds[at]:bounds[to]]], return_inverse=True)
                yield {"shard": shard[entry[at]], "lang": str(langs[lang[entry[at]]]), "first": part[0], "terms": part,
                       "dfs": dfs[at:to], "ends": bounds[at + 1:to + 1] - bounds[at],
                       "names": [str(x) for x in sources[names]], "source": which, "tfs": sums[bounds[at]:bounds[to]]}


def _changes(*columns) -> np.ndarray:
    """Whether any column differs from the row before; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def index_runs(docs: DataFrame, text: str, lang: str, source: str, shards: int) -> DataFrame:
    """Term-sorted runs of all documents, in chunks dealt to ``shards``."""
    most, schema = RUN_POSTINGS, arrow_schema(_RUNS)

    def run(batches):
        split, block = term_splitter(APART), Block()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for where, origin, raw in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if terms := split(raw):
                        block.add(where, origin, terms)
                        if len(block.terms) >= most:
                            for chunk in block.run(shards):
                                yield record_batch(schema, [chunk])
                            block = Block()
        for chunk in block.run(shards):
            yield record_batch(schema, [chunk])

    empty = F.lit("")
    given = docs.select(F.coalesce(lang, empty), F.coalesce(source, empty), F.col(text).cast("binary"))
    return given.mapInArrow(run, _RUNS)


def merge(chunks, min_docs: int):
    """(lang, term, {source: occurrences}) of the terms in at least ``min_docs``
    documents, from chunks sorted by shard, lang and first term; a chunk is
    opened when its first term is reached."""
    heap, number = [], count()
    ahead = next(chunks, None)
    here = None
    while heap or ahead:
        if not heap:
            here = ahead["shard"], ahead["lang"]
        while ahead and (not heap or ahead["first"] <= heap[0][0]) and (ahead["shard"], ahead["lang"]) == here:
            heapq.heappush(heap, (ahead["first"], next(number), 0, ahead))
            ahead = next(chunks, None)
        term, documents, met = heap[0][0], 0, []
        while heap and heap[0][0] == term:
            _, run, i, chunk = heap[0]
            documents += chunk["dfs"][i]
            met.append((chunk, i))
            if i + 1 < len(chunk["terms"]):
                heapq.heapreplace(heap, (chunk["terms"][i + 1], run, i + 1, chunk))
            else:
                heapq.heappop(heap)
        if documents >= min_docs:
            found = defaultdict(int)
            for chunk, i in met:
                for j in range(chunk["ends"][i - 1] if i else 0, chunk["ends"][i]):
                    found[chunk["names"][chunk["source"][j]]] += chunk["tfs"][j]
            yield here[1], term, found


def frequencies(runs: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """One row per (lang, term) in at least ``min_docs`` documents of the lang."""
    schema = arrow_schema(_FREQUENCIES)

    def run(batches):
        rows = []
        chunks = (r for batch in batches for at in range(0, batch.num_rows, 64)
                  for r in batch.slice(at, 64).to_pylist())
        for lang, term, found in merge(chunks, min_docs):
            names = sorted(found)
            rows.append({"lang": lang, "term": term.decode(), "total": sum(found.values()), "sources": names,
                         "counts": [found[s] for s in names]})
            if len(rows) == 4096:
                yield record_batch(schema, rows)
                rows = []
        if rows:
            yield record_batch(schema, rows)

    return runs.repartition(shards, "shard").sortWithinPartitions("shard", "lang", "first").mapInArrow(run, _FREQUENCIES)


def probability(counts: np.ndarray, size) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / size), exact."""
    if counts.size and int(counts.max()) >= (1 << 63) // ONE - 1:
        sizes = np.broadcast_to(size, counts.shape)
        return np.array([1 + ONE * (c + 1) // n for c, n in zip(counts.tolist(), sizes.tolist())], np.int64)
    return 1 + ONE * (counts + 1) // size


def _value(p, q):
    return (p - q) ** 2 // q


def corrections(owner: np.ndarray, place: np.ndarray, counts: np.ndarray, n_terms: int, sizes: np.ndarray) -> np.ndarray:
    """Per (group, other): what the terms at hand add to a pair's value beyond
    that of a term that both lack.  ``owner``, ``place``, ``counts``: term, group
    and occurrences of each posting; ``sizes``: occurrences plus kept terms of
    each group."""
    n = len(sizes)
    out = np.zeros((n, n), np.int64)
    lacking = probability(np.zeros(n, np.int64), sizes)
    both = _value(lacking[:, None], lacking[None, :])
    p = np.broadcast_to(lacking, (n_terms, n)).copy()
    own = probability(counts, sizes[place])
    p[owner, place] = own
    held = np.zeros((n_terms, n), bool)
    held[owner, place] = True
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(n + 1))
    step = max(1, BLOCK_CELLS // n)
    for g in np.flatnonzero(np.diff(bounds)):
        for at in range(bounds[g], bounds[g + 1], step):
            part = order[at:min(at + step, bounds[g + 1])]
            t, v = owner[part], own[part, None]
            out[g] += (_value(v, p[t]) - both[g]).sum(axis=0)
            rest = _value(lacking[None, :], v) - both[:, g]
            rest[held[t]] = 0
            out[:, g] += rest.sum(axis=0)
    return out


def _pair_corrections(table: DataFrame, langs: dict) -> DataFrame:
    """Partial sums of every task over its terms; ``langs``: lang -> (sources,
    sizes, kept terms)."""
    schema = arrow_schema(_CORRECTIONS)

    def run(batches):
        sums = {}
        for batch in batches:
            of = defaultdict(list)
            for lang, names, found in zip(*(batch.column(c).to_pylist() for c in ("lang", "sources", "counts"))):
                of[lang].append((names, found))
            for lang, rows in of.items():
                sources, sizes, n_kept = langs[lang]
                index = {s: i for i, s in enumerate(sources)}
                step = max(1, BLOCK_CELLS // len(sources))
                for at in range(0, len(rows), step):
                    part = rows[at:at + step]
                    owner = np.repeat(np.arange(len(part)), [len(names) for names, _ in part])
                    place = np.array([index[s] for names, _ in part for s in names])
                    counts = np.array([c for _, found in part for c in found])
                    got = corrections(owner, place, counts, len(part), np.array(sizes) + n_kept)
                    sums[lang] = sums[lang] + got if lang in sums else got
        from decimal import Decimal

        for lang, got in sums.items():
            sources = langs[lang][0]
            for s, values in zip(sources, got.tolist()):
                rows = [{"lang": lang, "source": s, "other": o, "value": Decimal(v)}
                        for o, v in zip(sources, values) if o != s and v]
                if rows:
                    yield record_batch(schema, rows)

    return table.select("lang", "sources", "counts").mapInArrow(run, _CORRECTIONS).groupBy("lang", "source", "other").agg(
        F.sum("value").alias("value"))


def _p(count: str, size: str) -> str:
    """The probability in SQL; beyond 64 bits the product is a decimal."""
    wide = f"cast({ONE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) div cast({size} as decimal(20,0))"
    return f"1 + case when {count} < 9000000000 then {ONE}L * ({count} + 1) div ({size}) else {wide} end"


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3,
          top: int = 200) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: how far each
    group's term probabilities are from every other source of its lang, and the
    ``top`` terms that it uses more than its lang."""
    spark = docs.sparkSession
    ship_package(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    table = materialize(frequencies(index_runs(docs, "text", "lang", "source", shards), shards, min_docs),
                        "audit-frequencies")
    posted = table.select("lang", "term", "total", F.inline(F.arrays_zip("sources", "counts"))) \
        .withColumnsRenamed({"sources": "source", "counts": "n"})
    empty = F.lit("")
    per = posted.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    kept = table.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_size"))
    found = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
    groups = materialize(
        found.join(per, ["lang", "source"], "left").join(kept, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "kept", "lang_size")]),
        "audit-groups")
    langs = {}
    for r in groups.orderBy("lang", "source").collect():  # the square of these rows is the result
        names, sizes, _ = langs.setdefault(r["lang"], ([], [], r["kept"]))
        names.append(r["source"])
        sizes.append(r["size"])
    others = groups.select("lang", F.col("source").alias("other"), F.col("size").alias("other_size"))
    pairs = groups.join(others, "lang").where(F.col("source") != F.col("other")) \
        .join(_pair_corrections(table, langs), ["lang", "source", "other"], "left")
    pairs = pairs.withColumn("p", F.expr(_p("0", "greatest(size + kept, 1)"))) \
        .withColumn("q", F.expr(_p("0", "greatest(other_size + kept, 1)")))
    both = F.expr("cast(kept as decimal(20,0)) * ((p - q) * (p - q) div q)") + F.coalesce("value", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"),
                         F.when(F.col("kept") == 0, 0).otherwise(both).cast("long").alias("value"))
    few = fits(groups, BROADCAST_GROUPS)
    terms = posted.join(F.broadcast(groups) if few else groups, ["lang", "source"]) \
        .withColumn("p", F.expr(_p("n", "size + kept"))).withColumn("q", F.expr(_p("total", "lang_size + kept"))) \
        .where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                               F.expr("(p - q) * (p - q) div q").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    return ranked.unionAll(terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
