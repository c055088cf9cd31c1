"""Licence scans by a positional index of rare words.

Base labels: places where the words of a fixed phrase stand consecutively.
The method's labels: templates are indexed by their rarest words (highest
inverse document frequency over all documents); a file looks up the rare words
it contains, the postings are intersected by relative position (file position
minus template position, within ``SLACK`` words), and where enough anchors of a
template agree on one position, its mandatory key phrases must stand inside the
aligned stretch.  ``score`` is the largest share of a verified template's words
found in its stretch; a base phrase alone scores :data:`PHRASE_SCORE`.

Defined cases: a null text is empty: no words, no labels, score 0; positions
are word numbers from 0 and null without a base place; an empty table gives no
rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# Words, base phrases and their labels.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Templates: label, wording (public licence notices), key phrases that must stand in the stretch.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the "
     "license at http www apache org licenses license 2 0", ("in compliance with the license", "license 2 0")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     ("gnu general public license", "version 2")),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation",
     ("free software foundation", "gnu general public license")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted", "without restriction")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met", ("redistribution and use in source", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)
ANCHORS = 5
SLACK = 4
AGREE = 0.6
PHRASE_SCORE = 0.5

FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")

_lower = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """Words after lower-casing A-Z alone."""
    text = text or ""
    return WORDS.findall(text.lower() if text.isascii() else text.translate(_lower))


def places(words: list[str], phrase: list[str], low: int = 0, high: int | None = None) -> list[int]:
    """Starts of ``phrase`` in ``words[low:high]``, overlapping ones too."""
    found, high = [], len(words) if high is None else min(high, len(words))
    while True:
        try:
            low = words.index(phrase[0], low, high)
        except ValueError:
            return found
        if low + len(phrase) <= high and words[low:low + len(phrase)] == phrase:
            found.append(low)
        low += 1


def document_frequencies(docs: DataFrame, text: str, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Documents, and how many hold each word of the bounded ``vocabulary``;
    counted per task before the sums are grouped."""
    def run(batches):
        import pyarrow as pa

        seen, n = Counter(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in batch.column(0).slice(at, 256).to_pylist():
                    n += 1
                    seen.update(vocabulary.intersection(words_of(t)))
        seen[""] = n
        yield pa.RecordBatch.from_pydict({"word": list(seen.keys()), "n": list(seen.values())})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, templates, n_docs: int, counts: dict[str, int]):
        self.templates = [(label, w.split(), [p.split() for p in keys]) for label, w, keys in templates]
        self.postings = defaultdict(list)
        self.need = []
        for t, (_, words, _) in enumerate(self.templates):
            rare = sorted(set(words), key=lambda w: (-math.log((n_docs + 1) / (counts.get(w, 0) + 1)), w))[:ANCHORS]
            self.need.append(math.ceil(AGREE * len(rare)))
            for i, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((t, i))
        self.words = frozenset(self.postings)

    def look_up(self, words: list[str]) -> list[tuple[str, float]]:
        """(label, share of the template's words found) of the verified templates."""
        present = self.words.intersection(words)
        if not present:
            return []
        shifts = defaultdict(list)  # per template: (file position - template position, anchor)
        for p, w in enumerate(words):
            if w in present:
                for t, i in self.postings[w]:
                    shifts[t].append((p - i, w))
        found = []
        for t, hits in shifts.items():
            label, wording, keys = self.templates[t]
            if len({w for _, w in hits}) < self.need[t]:
                continue
            hits.sort()
            best, end, last = 0.0, 0, None
            inside: Counter = Counter()
            for at, (shift, w) in enumerate(hits):  # windows of shifts no wider than SLACK
                while end < len(hits) and hits[end][0] <= shift + SLACK:
                    inside[hits[end][1]] += 1
                    end += 1
                if len(inside) >= self.need[t] and shift != last:
                    last = shift
                    low = max(0, shift - SLACK)
                    high = shift + len(wording) + 2 * SLACK
                    if all(places(words, k, low, high) for k in keys):
                        there, whole = set(words[low:high]), set(wording)
                        best = max(best, len(there & whole) / len(whole))
                inside[w] -= 1
                if not inside[w]:
                    del inside[w]
            if best:
                found.append((label, best))
        return found


def scan_text(text: str | None, index: Index, base) -> tuple:
    """The values of :data:`FIELDS` for one whole text."""
    words = words_of(text)
    starts, labels = [], set()
    for phrase, label in base:
        if at := places(words, phrase):
            starts += at
            labels.add(label)
    found = index.look_up(words)
    every = labels | {label for label, _ in found}
    score = max([PHRASE_SCORE if labels else 0.0, *(s for _, s in found)])
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(labels)), ",".join(sorted(every)), score)


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, base=BASE,
         templates=TEMPLATES) -> DataFrame:
    """``row`` (the carried columns) and :data:`FIELDS` per document."""
    vocabulary = {w for _, wording, _ in templates for w in wording.split()}
    index = Index(templates, *document_frequencies(docs, text, vocabulary))
    phrases = [(p.split(), label) for p, label in base]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def make():
        return lambda texts: dict(zip(names, map(list, zip(*(scan_text(t, index, phrases) for t in texts)))))

    return map_texts(docs, text, FIELDS, make, carry)
