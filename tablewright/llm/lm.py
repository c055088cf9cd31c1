"""LM scoring by cross-entropy difference.

A target model (texts labelled as good) and a background model (all documents)
share one vocabulary, one list of bigrams and one smoothing, so their losses
per word can be subtracted: ``score = target_loss - background_loss`` in nats
per word; the lower, the closer to the target.

Counts cover every document.  Every word and bigram seen ``MIN_COUNT`` times is
in the model.  Rarer words are the unknown word, rarer bigrams back off:

    P(w | v) = L * c(v, w) / c(v) + (1 - L * kept(v)) * P(w)

with ``kept(v)`` the share of v's bigrams in the model, and add-one unigrams.

Words are written once, as numbers into the word list of their block: a block
is about ``BLOCK_WORDS`` words of one task.  Each block sends what it counted
of its bigrams, words and heads, sorted by key, to the buckets of the key space
(one shuffle: the only one that is larger than the words themselves).  A
bucket adds the blocks' counts up and answers each block in the order of its
keys, so that counting and looking up are one exchange (of ``SLICES`` ranges of
keys, one after the other), and a block scores its texts with the answers
(``SLICES`` sets of blocks, one after the other).  Before it asks, a block is
written as one row in which rare words are unknown: only its answers move it again.  A frequent entry is one number per block, so no key
is hot; buckets and blocks have a bounded size, and at most one row per entry
is exchanged.  Nothing is broadcast or sent to the driver but totals.

Words and entries are told apart by 64-bit hashes: two of a billion are equal
with a probability of 3 %.

The target is every document labelled good, found by a shuffle join on the id.
As its texts are among all documents, a bigram that it has seen twice is in the
model by the count of all documents.

Defined cases: a null or empty text has no words and null losses and score; a
text longer than a block is cut into pieces that know the word before them;
null labels and labels of unknown documents are ignored, the lowest of several
counts; without target texts both models' target side is the uniform
distribution; an empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce
from itertools import chain, pairwise

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import ship_package

from .common import drop, materialize, unit_hash
from .words import START, UNKNOWN, words_of

MIN_COUNT = 2
WEIGHT = 0.7
#: Second parts of the keys that are no bigrams: "P(w)" and "what follows v".
UNIGRAM, BACKOFF = 2, 3
#: A block is closed when it has so many words, and a longer text is cut.
BLOCK_WORDS = 1 << 19
#: Words of all documents per bucket of keys, and per task at large inputs.
BUCKET_WORDS, TASK_WORDS = 1 << 20, 1 << 25
#: Blocks ask for so many ranges of keys in turn, and score in so many sets: less is on disk at a time.
SLICES = 3
#: Blocks and answers are rows of up to megabytes: so many are read, and blocks reach a Python worker, at a time.
READ_ROWS, BATCH_ROWS = 16, 4
#: Words a task has as Python strings before they become numbers of their block.
PENDING = 1 << 16
#: What the block ``told`` is told, by ``kind``; from 0 on: the bucket that answers.
RARE, TARGET, KEPT = -1, -2, -3
TOLD = "told long, kind long, x long, y long, z long, n binary, t binary"


class _Block:
    """The word list of a block, which begins with the unknown word and the
    text's start, and the words added so far as numbers into it."""

    def __init__(self):
        self.places, self.held = {UNKNOWN: 0, START: 1}, []
        self.size = 0

    def add(self, pieces: list[list]) -> np.ndarray:
        """Numbers of the pieces' words, one after the other; each begins with the
        word before it (None: the start), which is not counted."""
        import pandas as pd
        import pyarrow as pa

        words = pa.array(chain.from_iterable(pieces), pa.large_string()).dictionary_encode()
        hashes = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
        place = self.places.setdefault
        numbers = np.array([*(place(h, len(self.places)) for h in hashes.tolist()), self.places[START]], np.int32)
        out = numbers[words.indices.fill_null(len(hashes)).to_numpy()]
        inner = np.ones(len(out), bool)
        inner[np.cumsum([0, *map(len, pieces[:-1])])] = False
        self.held.append(out[inner])
        return out

    def counts(self) -> np.ndarray:
        return np.bincount(np.concatenate(self.held), minlength=len(self.places)).astype(np.int32)


def _mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit key of each pair of ids."""
    x = v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lists(offsets, values):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _packed(ends, values: np.ndarray, planes: int | None = None):
    """A binary column, in a row the values between two ends: all first bytes, then
    all second bytes and so on, which compresses well as high bytes agree (the
    first ``planes`` if the others are 0)."""
    import pyarrow as pa

    given = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)[:, :planes]
    planes = np.empty(given.shape[::-1], np.uint8)
    for plane, column in zip(planes, given.T):  # a plane at a time: numpy copies a transposed matrix slowly
        plane[:] = column
    return pa.array([np.ascontiguousarray(planes[:, a:b]).tobytes() for a, b in pairwise(ends)], pa.binary())


def _flat(column, of=np.int64) -> np.ndarray:
    """All values of a column made by :func:`_packed`, row after row."""
    size = np.dtype(of).itemsize
    rows = [np.frombuffer(x, np.uint8).reshape(size, -1) for x in column.to_pylist()]
    out, end = np.empty((sum(x.shape[1] for x in rows), size), np.uint8), 0
    for planes in rows:
        begin, end = end, end + planes.shape[1]
        for i, plane in enumerate(planes):
            out[begin:end, i] = plane
    return out.view(of).reshape(-1)


def _ends(column, of=np.int64) -> np.ndarray:
    """0 and the end of each of its rows."""
    import pyarrow.compute as pc

    lengths = pc.binary_length(column).to_numpy().astype(np.int64) // np.dtype(of).itemsize
    return np.concatenate([[0], np.cumsum(lengths)])


def _tokens(docs: DataFrame) -> DataFrame:
    """Blocks of (row, doc_id, text): a row a piece of a text with (block, at: the
    text's number, row, doc_id, n: the text's words, both only at its first
    piece, words: numbers into the block's word list as 32-bit integers, the word
    before them first), and a row a block with its word list and counts."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

    ship_package(docs.sparkSession)
    limit, most = BLOCK_WORDS, PENDING
    kind = docs.schema
    out = StructType().add("block", LongType()).add("at", LongType()).add("row", kind["row"].dataType) \
        .add("doc_id", kind["doc_id"].dataType).add("n", LongType()).add("words", BinaryType()).add("vocab", ArrayType(LongType())) \
        .add("counts", ArrayType(IntegerType()))

    def run(batches):
        task = TaskContext.get().partitionId()
        at, number, block = task << 40, task << 24, _Block()

        def close(kinds):
            words = np.fromiter(block.places, np.int64, len(block.places))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.nulls(1, pa.int64()), *[pa.nulls(1, k) for k in kinds],
                 pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), _lists([0, len(words)], words),
                 _lists([0, len(words)], block.counts())], out.names)

        def pieces(part, ats, owner, n, words):
            first = pa.array([i if x is not None else None for i, x in zip(owner, n)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), number)), pa.array(ats, pa.int64()), part.column(0).take(first),
                 part.column(1).take(pa.array(owner, pa.int32())), pa.array(n, pa.int64()),
                 _packed(np.cumsum([0, *map(len, words)]), block.add(words)),
                 pa.nulls(len(n), pa.list_(pa.int64())), pa.nulls(len(n), pa.list_(pa.int32()))], out.names)

        for batch in batches:
            kinds = [batch.column(0).type, batch.column(1).type]
            for a in range(0, batch.num_rows, 256):
                part, found, pending = batch.slice(a, 256), ([], [], [], []), 0
                for i, text in enumerate(part.column(2).to_pylist()):
                    words = words_of(text)
                    for begin in range(0, max(len(words), 1), limit):
                        piece = [words[begin - 1] if begin else None, *words[begin:begin + limit]]
                        for column, x in zip(found, (at, i, None if begin else len(words), piece)):
                            column.append(x)
                        pending += len(piece) - 1
                        block.size += len(piece) - 1
                        if pending >= most or block.size >= limit:
                            yield pieces(part, *found)
                            found, pending = ([], [], [], []), 0
                        if block.size >= limit:
                            yield close(kinds)
                            block, number = _Block(), number + 1
                    at += 1
                if found[0]:
                    yield pieces(part, *found)
        if block.size:
            yield close(kinds)

    return docs.mapInArrow(run, out)


SETTLED = "block long, vocab array<long>, at array<long>, sizes array<int>, target array<boolean>, words binary"


def _settle(pieces, told):
    """A block as one row: its word list without rare words (which are unknown
    from here on), and of each piece ``at``, its length and whether it is a target."""
    import pyarrow as pa
    import pyarrow.compute as pc

    listed = pieces.filter(pc.is_valid(pieces["vocab"]))
    texts = pieces.filter(pc.is_valid(pieces["words"]))
    vocab = listed["vocab"].combine_chunks().flatten().to_numpy()
    stays = ~np.isin(vocab, _told(told, RARE, "x"))
    number = np.where(stays, np.cumsum(stays) - 1, 0).astype(np.int32)
    at = texts["at"].combine_chunks().to_numpy(zero_copy_only=False)
    sizes = np.diff(_ends(texts["words"], np.int32))
    words = number[_flat(texts["words"], np.int32)]
    one = [_lists([0, len(x)], x) for x in (vocab[stays], at, sizes.astype(np.int32), np.isin(at, _told(told, TARGET, "x")))]
    return pa.Table.from_arrays([listed["block"], *one, _packed([0, len(words)], words, 3)],
                                ["block", "vocab", "at", "sizes", "target", "words"])


def _told(told, kind: int, column: str) -> np.ndarray:
    import pyarrow.compute as pc

    return told[column].filter(pc.equal(told["kind"], kind)).combine_chunks().to_numpy(zero_copy_only=False)


class _Texts:
    """One block of :func:`_settle` (a batch of one row): ``at`` of each piece, and of
    each of its words ``piece``, ``head`` and ``word``, numbers into the word list."""

    def __init__(self, block):
        self.vocab, self.at, sizes, self.targets = (
            block.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("vocab", "at", "sizes", "target"))
        planes = np.frombuffer(block.column("words")[0].as_buffer(), np.uint8).reshape(3, -1).astype(np.int32)
        ids = planes[0] | planes[1] << 8 | planes[2] << 16
        first = np.cumsum(sizes) - sizes
        self.word, self.head = np.delete(ids, first), np.delete(ids, first + sizes - 1)
        self.piece = np.repeat(np.arange(len(self.at)), sizes - 1)
        self.words, self.heads = (np.flatnonzero(np.bincount(x, minlength=len(self.vocab)))
                                  for x in (self.word, self.head))

    def keys(self) -> np.ndarray:
        """Keys of the bigram at each word, then of each different word and head."""
        v, one, before = self.vocab[self.head], self.vocab[self.words], self.vocab[self.heads]
        return np.concatenate([_mixed(v, self.vocab[self.word]), _mixed(np.full_like(one, UNIGRAM), one),
                               _mixed(before, np.full_like(before, BACKOFF))])

    def counts(self, hits: np.ndarray) -> np.ndarray:
        """How much its words add to each of the keys, if only the hits among them count."""
        size = len(self.vocab)
        word, head = (np.bincount(x[hits], minlength=size) for x in (self.word, self.head))
        return np.concatenate([hits, word[self.words], head[self.heads]], dtype=np.int32)

    def firsts(self) -> np.ndarray:
        """First word of each key that is a bigram."""
        return np.concatenate([self.vocab[self.head], np.full(len(self.words) + len(self.heads), UNIGRAM)])

    def answers(self, told, place: np.ndarray, column: str) -> list[np.ndarray]:
        """What the buckets answered at each word, and by word as such and as a head;
        ``place`` of each key among the different ones."""
        import pyarrow.compute as pc

        given = told.select(["kind", column]).filter(pc.greater_equal(told["kind"], 0)).sort_by("kind")
        out, n, m = _flat(given[column])[place], len(self.word), len(self.words)
        word, head = np.zeros(len(self.vocab)), np.zeros(len(self.vocab))
        word[self.words], head[self.heads] = out[n:n + m], out[n + m:]
        return [out[:n], word, head]


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where in it each different one begins."""
    order = np.argsort(key)
    ordered = key[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(key)])


def _ask(buckets: int, part: int):
    """Blocks' counts in one slice of the keys, a row a block and bucket: (bucket, block, key, v, n, t)."""
    def ask(row):
        import pyarrow as pa

        texts = _Texts(row)
        key = texts.keys()
        place = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        mine = np.flatnonzero((place >= buckets * part // SLICES) & (place < buckets * (part + 1) // SLICES))
        order, begins = _sorted(key[mine])  # only the keys of the slice are sorted
        mine = mine[order]
        one = mine[begins]
        bucket, begin = np.unique(place[one], return_index=True)
        ends = np.append(begin, len(one))
        block = row.column("block")[0].as_py()
        n, t = (np.add.reduceat(texts.counts(x)[mine], begins, dtype=np.int32) if len(one) else np.empty(0, np.int32)
                for x in (np.ones(len(texts.word), bool), texts.targets[texts.piece]))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket.astype(np.int64)), pa.array(np.full(len(bucket), block)),
             *[_packed(ends, x) for x in (key[one], texts.firsts()[one], n, t)]],
            ["bucket", "block", "key", "v", "n", "t"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield ask(batch.slice(i, 1))

    return run, "bucket long, block long, key binary, v binary, n binary, t binary"


def _answer(least: float):
    """A bucket's sums for each block that asked, 0 for bigrams that are not in the
    model, and (kind KEPT, three lists) how often bigrams of the model follow
    each head."""
    def run(asked):
        import pyarrow as pa

        key = _flat(asked["key"], np.uint64)
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        place = np.empty(len(key), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        v = _flat(asked["v"])[order[new]]
        del key, order, new
        n, t = (np.bincount(place, _flat(asked[c], np.int32)) for c in "nt")
        pair = v != UNIGRAM
        kept = pair & (n >= least)
        heads, head = np.unique(v[kept], return_inverse=True)
        kept_n, kept_t = (np.bincount(head, x[kept], len(heads)) for x in (n, t))
        n, t = (np.where(pair & ~kept, 0, x) for x in (n, t))
        ends, rows = _ends(asked["key"]), asked.num_rows
        ends = np.append(ends, ends[-1])
        last = np.append(np.zeros(rows + 1, np.int64), len(heads))
        return pa.Table.from_arrays(
            [pa.array([*asked["block"].to_pylist(), None], pa.int64()),
             pa.array([*asked["bucket"].to_pylist(), KEPT], pa.int64()),
             *[_packed(ends, x.astype(np.int64)[place]) for x in (n, t)],
             *[_lists(last, x.astype(np.int64)) for x in (heads, kept_n, kept_t)]],
            ["block", "kind", "n", "t", "heads", "kept_n", "kept_t"])

    return run, ("block long, kind long, n binary, t binary, heads array<long>, kept_n array<long>, "
                 "kept_t array<long>")


def _score(totals: tuple, size: int):
    """Log probability of each piece of a text under both models: (at, b, t)."""
    def run(block, told):
        import pyarrow as pa

        texts = _Texts(block.combine_chunks().to_batches()[0])
        key = texts.keys()
        order, begins = _sorted(key)
        among = np.empty(len(key), np.int32)
        among[order] = np.repeat(np.arange(len(begins), dtype=np.int32), np.diff(begins, append=len(key)))
        heads = _told(told, KEPT, "x")
        order = np.argsort(texts.vocab)
        place = order[np.searchsorted(texts.vocab, heads, sorter=order)]
        sums = []
        for column, kept_column, total in (("n", "y", totals[0]), ("t", "z", totals[1])):
            pair, word, fan = texts.answers(told, among, column)
            kept = np.zeros(len(texts.vocab))
            kept[place] = _told(told, KEPT, kept_column)
            fan = np.maximum(fan, 1)
            p = ((WEIGHT / fan)[texts.head] * pair
                 + (1 - WEIGHT * kept / fan)[texts.head] * ((word + 1) / (total + size))[texts.word])
            sums.append(np.bincount(texts.piece, np.log(p), len(texts.at)))
        return pa.Table.from_arrays([pa.array(texts.at), *map(pa.array, sums)], ["at", "b", "t"])

    return run, "at long, b double, t double"


@contextmanager
def _few_rows(spark, **rows):
    """So many rows in Spark's batches, by setting (dots as double underscores)."""
    names = {name.replace("__", "."): n for name, n in rows.items()}
    before = {name: spark.conf.get(name) for name in names}
    for name, n in names.items():
        spark.conf.set(name, n)
    try:
        yield
    finally:
        for name, n in before.items():
            spark.conf.set(name, n)


def target_ids(labels: DataFrame, rows: int | None = None) -> DataFrame:
    """The documents labelled good as target_id; a sample of about ``rows`` by hash if given."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id") \
        .agg(F.min("quality").alias("quality")).where("quality >= 1")
    if rows is not None:
        good = good.where(unit_hash(F.lit("target"), "doc_id") < min(1.0, rows / max(good.count(), 1)))
    return good.select(F.col("doc_id").alias("target_id"))


def _tell(df: DataFrame, kind, **values) -> DataFrame:
    """Rows of ``TOLD`` for the blocks of ``df``."""
    return df.select(F.col("block").alias("told"), *[
        (values.get(name, F.lit(None)) if name != "kind" else F.lit(kind) if isinstance(kind, int) else kind)
        .cast(of).alias(name) for name, of in (x.split() for x in TOLD.split(", ")[1:])])


def _places(tokens: DataFrame) -> DataFrame:
    """(block, word, n) of every word of each block's list."""
    return tokens.where("vocab is not null").select(
        "block", F.explode(F.arrays_zip("vocab", "counts")).alias("e")).select(
        "block", F.col("e.vocab").alias("word"), F.col("e.counts").alias("n"))


def score(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text",
          carry: list[str] | None = None, min_share: float = 0.0) -> DataFrame:
    """``row`` (the carried columns), n_tokens, target_loss, background_loss
    and score for every document; ``targets`` has the column target_id.
    Words and bigrams below ``min_share`` of all words count as rare."""
    given = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col(key).alias("doc_id"),
                        F.col(text).alias("text"))
    tokens = materialize(_tokens(given), "lm-blocks")
    rows = materialize(tokens.where("n is not null").select("at", "row", "n"), "lm-rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    least = max(MIN_COUNT, min_share * total)
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(total // BLOCK_WORDS, usual), total // TASK_WORDS) + 1

    listed = _places(tokens)
    words = materialize(listed.where(~F.col("word").isin(UNKNOWN, START)).groupBy("word").agg(
        F.sum("n").alias("n"), F.min("block").alias("first"), F.max("block").alias("last")), "lm-words")
    size = words.where(F.col("n") >= least).count() + 2
    rare = words.where(F.col("n") < least)
    if least > 2:
        rare = listed.select("block", "word").join(rare.select("word"), "word", "left_semi")
    else:  # a rare word has one place, and may stand before the next block's first
        rare = rare.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("block"), "word")
    rare = _tell(rare, RARE, x=F.col("word"))
    hits = materialize(tokens.where("length(words) > 4").select("block", "at", "doc_id", "n").join(
        targets, F.col("doc_id") == F.col("target_id"), "left_semi").select("block", "at", "n"), "lm-targets")
    target_total = hits.agg(F.sum("n")).first()[0] or 0

    def by_block(blocks, told, run, out):
        return blocks.repartition(tasks, "block").groupBy("block").cogroup(
            told.repartition(tasks, "told").groupBy("told")).applyInArrow(run, out)

    buckets = total // BUCKET_WORDS + SLICES
    pieces = tokens.where("vocab is not null or length(words) > 4").select("block", "at", "words", "vocab")
    blocks = materialize(by_block(pieces, rare.unionAll(_tell(hits, TARGET, x=F.col("at"))), _settle, SETTLED), "lm-settled")
    for df in (tokens, words, hits):
        drop(df)
    spark, read = docs.sparkSession, {"spark__sql__parquet__columnarReaderBatchSize": READ_ROWS}
    with _few_rows(spark, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS, **read):
        parts = [materialize(blocks.mapInArrow(*_ask(buckets, k)).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(
            *_answer(least)), "lm-answers") for k in range(SLICES)]
    answers = reduce(DataFrame.unionAll, parts)
    kept = materialize(answers.where("block is null").select(
        F.explode(F.arrays_zip("heads", "kept_n", "kept_t")).alias("e")).groupBy(F.col("e.heads").alias("word")).agg(
        F.sum("e.kept_n").alias("kept_n"), F.sum("e.kept_t").alias("kept_t")), "lm-kept")

    found = []
    for k in range(SLICES):
        some, replies = (df.where(F.col("block") % SLICES == k) for df in (blocks, answers))
        heads = some.select("block", F.explode("vocab").alias("word")).join(kept, "word")
        told = _tell(heads, KEPT, x=F.col("word"), y=F.col("kept_n"), z=F.col("kept_t")).unionAll(
            _tell(replies, F.col("kind"), n=F.col("n"), t=F.col("t")))
        with _few_rows(spark, **read):
            found.append(materialize(by_block(some, told, *_score((total, target_total), size)).groupBy("at").agg(
                F.sum("b").alias("b"), F.sum("t").alias("t")), "lm-sums"))
    sums = reduce(DataFrame.unionAll, found).groupBy("at").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
    for df in (blocks, kept, *parts):
        drop(df)
    return rows.join(sums, "at", "left").select(
        "row", F.col("n").alias("n_tokens"), (-F.col("t") / F.col("n")).alias("target_loss"),
        (-F.col("b") / F.col("n")).alias("background_loss"), ((F.col("b") - F.col("t")) / F.col("n")).alias("score"))
