"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A text becomes a weighted set of ``SHINGLE``-word shingles (weights: ``unit``,
each distinct shingle once, or ``count``).  Each shingle is a Poisson process
whose rate is its weight; every arrival falls into a random register, and a
register keeps the shingle that arrives first.  A shingle stops as soon as its
next arrival is later than the latest register of its text (early termination).
Two texts agree in a register with their probability Jaccard

    J = sum over common d of 1 / sum over j of max(x_j / x_d, y_j / y_d),

which for unit weights is the plain Jaccard similarity.  ``ROWS`` registers
make a band; texts that share a band are candidates, and a link needs
``J >= SIMILARITY``, computed from the shingles of both texts.

Exact copies (same words) are one node from the start.  Groups are built
without listing all pairs of a band's texts: first every text is compared with
the leader of its band, the text whose bands are the most crowded (the centre
of a group of variants), and the links' components are taken; bands that still
hold several components go on with the leader outside the first component, and
what is left after ``STARS`` such rounds is searched across components by an
exact prefix join: two texts at the similarity share a shingle among the rarest
of both, early enough in either's rarest-first order for the rest to suffice.
Texts that merely share a frequent passage never meet there.  Pairs already in
one component need no comparison, pairs whose sizes rule out the similarity are
skipped exactly.  (With ``count`` weights the last step lists the pairs of the
bands still open instead; that bound holds for plain sets only.)

With 26 bands of 5 registers a pair at similarity 0.8 is missed with
probability 3e-5.  Shingles are compared by 32-bit hashes.

Defined cases: words are runs of word characters, lower-cased; a text of one to
four words is one shingle of all its words; a text without words (null, empty)
is a class of its own; the class id is the smallest doc_id of the class (null
ids last); repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, map_texts, materialize, temporary
from .components import components
from .words import words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
STARS = 2
#: Written partitions whose rows are decided at a time, by one bit a row.
SLICE = 250
#: Word hashes kept per task.
MEMO = 500_000

FIELDS = "key string, n int, shingles array<int>, weights array<int>, bands array<long>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_block(words: list[list[str]], hashes: dict, size: int = SHINGLE):
    """(owner, hash, count) of the distinct shingles of each text, by owner."""
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, n.sum())
    ends = np.cumsum(n)
    starts = ends - n
    have = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(words)), have)
    at = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have) + starts[owner]
    h = np.zeros(len(at), np.uint64)
    for i in range(size):
        inside = at + i < ends[owner]
        h = np.where(inside, h * _ODD + flat[np.minimum(at + i, max(len(flat) - 1, 0))] + np.uint64(1), h) \
            if len(flat) else h
    h = mix(h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return owner[first], h[first], np.diff(np.append(first, len(h)))


def probminhash(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """(n_texts, m) registers: the hash of the shingle that arrives first."""
    first = np.full(n_texts * m, np.inf)
    who = np.zeros(n_texts * m, np.uint64)
    time = np.zeros(len(h))
    step = 0
    while len(h):
        step += 1
        r = mix(h + np.uint64(step * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        uniform = ((r >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
        time = time - np.log(uniform) / weight
        reg = owner * m + (mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, reg, time)
        won = time == first[reg]
        who[reg[won]] = h[won]
        latest = first.reshape(n_texts, m).max(1)
        alive = time < latest[owner]
        owner, h, weight, time = owner[alive], h[alive], weight[alive], time[alive]
    return who.reshape(n_texts, m)


def signatures(docs: DataFrame, text: str, carry: list[str] | None, weights: str = "unit",
               bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``row`` and :data:`FIELDS`; ``weights`` is null for unit weights."""
    if weights not in ("unit", "count"):
        raise ValueError(f"weights must be unit or count, not {weights}")
    salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD)

    def make():
        hashes = _Hashes()

        def fn(texts):
            words = [words_of(t) for t in texts]
            owner, h, count = shingle_block(words, hashes)
            rates = count.astype(float) if weights == "count" else np.ones(len(h))
            regs = probminhash(owner, h, rates, len(texts), bands * rows).reshape(len(texts), bands, rows)
            key = np.zeros((len(texts), bands), np.uint64) + salts
            for i in range(rows):
                key = mix(key * _ODD + regs[:, :, i])
            key = key.view(np.int64)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            small = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
            got = {"key": [], "n": [], "shingles": [], "weights": [], "bands": []}
            for i, w in enumerate(words):
                a, b = cut[i], cut[i + 1]
                got["key"].append(xxhash.xxh3_128_hexdigest(" ".join(w)) if w else None)
                got["n"].append(int(count[a:b].sum()) if weights == "count" else int(b - a))
                got["shingles"].append(small[a:b])
                got["weights"].append(count[a:b].astype(np.int32) if weights == "count" else None)
                got["bands"].append(key[i] if w else key[i, :0])
            return got
        return fn

    return map_texts(docs, text, FIELDS, make, carry)


def plain_jaccard(x: Column, y: Column) -> Column:
    """Similarity of two structs (n, shingles) with unit weights."""
    common = F.size(F.array_intersect(x["shingles"], y["shingles"]))
    return common / (x["n"] + y["n"] - common)


def probability_jaccard(frame: DataFrame) -> DataFrame:
    """``sim`` for columns x and y (structs shingles, weights), weighted."""
    def run(batches):
        for pdf in batches:
            yield pdf[["a", "b"]].assign(sim=[
                weighted_similarity(*x, *y) for x, y in
                zip(((r["shingles"], r["weights"]) for r in pdf["x"]), ((r["shingles"], r["weights"]) for r in pdf["y"]))])

    return frame.mapInPandas(run, "a long, b long, sim double")


def weighted_similarity(s, v, t, w) -> float:
    """Probability Jaccard of two weighted sets: with the ratios of the common
    shingles sorted, the sum of maxima is two running sums."""
    x, y = dict(zip(s, map(float, v))), dict(zip(t, map(float, w)))
    common = x.keys() & y.keys()
    if not common:
        return 0.0
    every = np.array([(x.get(k, 0.0), y.get(k, 0.0)) for k in x.keys() | y.keys()])
    a, b = every[:, 0], every[:, 1]
    with np.errstate(divide="ignore"):
        ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, a, b = ratio[order], a[order], b[order]
    above = np.append(np.cumsum(a[::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(b))
    total = 0.0
    for k in common:
        cut = np.searchsorted(ratio, x[k] / y[k], side="right")  # beyond: a_j / x_k is the larger
        total += 1.0 / (above[cut] / x[k] + below[cut] / y[k])
    return total


def _verified(pairs: DataFrame, shingles: DataFrame, weights: str, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose texts reach the similarity.  A text joins
    once per text it is compared with; frequent a's are split by the join."""
    side = lambda name: shingles.select(
        F.col("uid").alias(name + "_"), F.struct("n", "shingles", "weights").alias("x" if name == "a" else "y"))
    both = pairs.join(side("b"), F.col("b") == F.col("b_")).select("a", "b", "y")
    both = both.join(side("a"), F.col("a") == F.col("a_")).select("a", "b", "x", "y")
    if weights == "unit":
        sims = both.select("a", "b", plain_jaccard(F.col("x"), F.col("y")).alias("sim"))
    else:
        sims = probability_jaccard(both)
    return sims.where(F.col("sim") >= similarity).select("a", "b")


def _checked(pairs: DataFrame, done: DataFrame | None, sig: DataFrame, weights: str, similarity: float) -> DataFrame:
    """The links among ``pairs`` that are not yet ``done``."""
    if done is not None:
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    return _verified(pairs, sig, weights, similarity)


def _prefix_pairs(texts: DataFrame, sig: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) across components that can reach the plain similarity,
    from ``texts`` (uid, root): an exact filter.

    With the shingles of each text in one rarest-first order, two texts whose
    first common shingle stands at i and j share at most
    ``1 + min(n_x - i, n_y - j)``, and need ``t / (1 + t) * (n_x + n_y)``."""
    rows = texts.join(sig.select("uid", "n", "shingles"), "uid") \
        .select("uid", "root", "n", F.explode("shingles").alias("sh"))
    rows = materialize(rows, "open-shingles")
    df = rows.groupBy("sh").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("sh", "sh_")
    open_rows = rows
    rows = rows.join(df, F.col("sh") == F.col("sh_"), "left").withColumn("df", F.coalesce("df", F.lit(1))).drop("sh_")
    order = Window.partitionBy("uid").orderBy("df", "sh")
    rows = rows.withColumn("at", F.row_number().over(order)) \
        .where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1) & (F.col("df") > 1))
    rows = materialize(rows.select("uid", "root", "n", "sh", "at"), "prefixes")
    drop(open_rows)
    x, y = rows.alias("x"), rows.alias("y")
    need = F.ceil(similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    can = 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= need
    near = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")
    return x.join(y, (F.col("x.sh") == F.col("y.sh")) & (F.col("x.uid") < F.col("y.uid"))
                  & (F.col("x.root") != F.col("y.root")) & near & can) \
        .select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct()


def groups(bands: DataFrame, shingles: DataFrame, weights: str = "unit", similarity: float = SIMILARITY,
           after_read=None) -> DataFrame:
    """(node, root) of the texts linked to another, from one row per distinct
    text in ``bands`` (uid, n, bands) and the ``shingles`` (uid, n, shingles,
    weights) of those texts at least.  ``after_read`` is called once both are
    no longer needed."""
    members = bands.select("uid", "n", F.explode("bands").alias("band"))
    # what is joined back to a band or class is written first: Spark splits a hot key of a join of two
    # tables, not of a join with a grouping's output (see components.py)
    shared = materialize(members.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "band-sizes")
    members = materialize(members.join(shared, "band"), "band-members")
    crowd = members.groupBy("uid").agg(F.sum("c").alias("crowd")).withColumnRenamed("uid", "uid_")
    all_members = members
    members = materialize(members.join(crowd, F.col("uid") == F.col("uid_")).select("band", "uid", "n", "crowd"),
                          "band-crowds")
    drop(all_members)
    drop(shared)
    # only texts that share a band are ever compared: the shingles of the others are not moved again; their
    # ids are written first, so that the join below moves no shingles either while the ids fit a broadcast
    # (Spark compares their size with spark.sql.autoBroadcastJoinThreshold)
    compared = materialize(members.select(F.col("uid").alias("uid_")).distinct(), "compared")
    sig = materialize(shingles.join(compared, F.col("uid") == F.col("uid_"), "left_semi"), "candidates")
    if after_read:
        after_read()

    def similar_size(x, y):
        # counts as weights bound the plain similarity no longer: only unit weights are pruned
        return F.least(x, y) >= similarity * F.greatest(x, y) if weights == "unit" else F.lit(True)

    roots, links, done = None, None, None
    for turn in range(STARS + 1):
        if roots is None:
            open_ = members.withColumn("root", F.col("uid"))
        else:
            r = roots.select(F.col("node").alias("node_"), F.col("root"))
            open_ = members.join(r, F.col("uid") == F.col("node_"), "left") \
                .withColumn("root", F.coalesce("root", "uid")).drop("node_")
            mixed = open_.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")) \
                .where("low <> high").select("band", "low")
            mixed = materialize(mixed, "band-mixed")
            open_ = materialize(open_.join(mixed, "band"), "band-open")
            if open_.isEmpty():
                break
        if turn == STARS and weights == "unit":
            pairs = _prefix_pairs(open_.select("uid", "root").distinct(), sig, similarity)
            links = materialize(links.union(_checked(pairs, done, sig, weights, similarity)), "links")
            roots = materialize(components(links), "roots")
            break
        if turn < STARS:
            lead = open_ if turn == 0 else open_.where("root <> low")
            lead = materialize(lead.groupBy("band").agg(
                F.max(F.struct("crowd", "uid", "n", "root")).alias("lead")), "band-leaders")
        else:  # whatever is still apart: every pair across components
            lead = open_.select("band", F.struct("uid", "n", "root").alias("lead"))
        pairs = open_.join(lead, "band").where(F.col("uid") != F.col("lead.uid"))
        if turn:
            pairs = pairs.where(F.col("root") != F.col("lead.root"))
        pairs = pairs.where(similar_size(F.col("n"), F.col("lead.n"))) \
            .select(F.least("lead.uid", "uid").alias("a"), F.greatest("lead.uid", "uid").alias("b")).distinct()
        pairs = materialize(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        new = _checked(pairs, None, sig, weights, similarity)
        done = pairs if done is None else done.union(pairs)
        old = links
        links = materialize(new if old is None else old.union(new), "links")
        if old is not None:
            drop(old)
        roots = materialize(components(links), "roots")
    return roots


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None,
            weights: str = "unit", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: the carried columns in ``row``, class_id,
    class_size and kept (one row of each class).  The result joins the carried
    columns by shuffle: carry narrow ones, or use :func:`deduplicate`."""
    with temporary(docs.sparkSession):
        given = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col(key).alias("doc_id"),
                            F.col(text).alias("text")).withColumn("uid", F.monotonically_increasing_id())
        sig = signatures(given, "text", ["row", "doc_id", "uid"], weights)
        sig = materialize(sig.select("row.row", "row.doc_id", "row.uid", "key", "n", "shingles", "weights", "bands"),
                          "signatures")
        # copies: the smallest row number stands for a text
        first = sig.where("key is not null").groupBy("key").agg(F.min("uid").alias("first"))
        first = materialize(first, "texts")
        bands = sig.select("uid", "n", "bands").join(first.select("first"), F.col("uid") == F.col("first"),
                                                     "left_semi")
        # the shingles go once the candidates' are copied; rows and keys stay
        rows = materialize(sig.select("row", "doc_id", "uid", "key"), "rows", outer=True)
        roots = groups(bands, sig.select("uid", "n", "shingles", "weights"), weights, similarity, lambda: drop(sig))
        found = first.join(roots, F.col("first") == F.col("node"), "left") \
            .select(F.col("key").alias("key_"), F.coalesce("root", "first").alias("class"))
        slim = rows.select("uid", "doc_id", "key").join(found, F.col("key") == F.col("key_"), "left") \
            .select("uid", "doc_id", F.coalesce("class", F.col("uid")).alias("class"))
        slim = materialize(slim, "classed")
        per = slim.groupBy("class").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("best"),
            F.count("*").alias("class_size"))
        per = materialize(per, "class-best")  # the class of a third of all rows is split in the join
        slim = slim.join(per, "class").select("uid", F.col("best.doc_id").alias("class_id"), "class_size",
                                              (F.col("uid") == F.col("best.uid")).alias("kept"))
        slim = materialize(slim, "decided", outer=True)
    return rows.select("uid", "row").join(slim, "uid").select("row", "class_id", "class_size", "kept")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents, one of each class, with the columns of ``docs``.

    Wide rows are written once with their number and never shuffled: a bit a row
    says which are kept, and the rows of ``SLICE`` written partitions meet the
    bits of these partitions, a broadcast within Spark's limit (with more bits
    than that Spark shuffles the slice).  Several slices are written one after
    another, so the driver holds the bits of one."""
    spark = docs.sparkSession
    with temporary(spark):
        whole = docs.select(F.struct(*docs.columns).alias("row")).withColumn("uid", F.monotonically_increasing_id())
        whole = materialize(whole, "documents", outer=True)
        slim = whole.select("uid", F.col("row")[key].alias("doc_id"), F.col("row")[text].alias("text"))
        kept = classes(slim, carry=["uid"], **kw).where("kept").select("row.uid")
        bits = kept.groupBy(F.shiftright("uid", 6).alias("block")).agg(
            F.expr("bit_or(shiftleft(1L, cast(uid & 63 as int)))").alias("bits"))
        # a row number is its partition times 2 ** 33 and its place there
        bits = bits.withColumn("slice", F.expr(f"cast(shiftright(block, 27) div {SLICE} as int)"))
        bits = materialize(bits, "kept-bits", outer=True, by="slice")
        slices: dict[int, list[str]] = {}
        for file in whole.inputFiles():
            at = int(re.search(r"part-(\d+)", file.rsplit("/", 1)[1])[1])
            slices.setdefault(at // SLICE, []).append(file)
        parts = []
        for at, files in sorted(slices.items()):
            rows = spark.read.schema(whole.schema).parquet(*files)
            mine = bits.where(F.col("slice") == at)
            part = rows.join(mine, F.shiftright("uid", 6) == F.col("block")) \
                .where("shiftright(bits, cast(uid & 63 as int)) & 1 = 1").select("row")
            parts.append(part if len(slices) == 1 else materialize(part, "unique", outer=True))
    return reduce(DataFrame.unionAll, parts or [whole.select("row")]).select("row.*")
