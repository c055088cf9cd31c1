"""Lexical search, line dedup and the divergence audit against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import divergence, lexical, lines
from tablewright.llm.terms import ascii_but, term_splitter

WIDE = "doc_id long, text string, lang string, source string, row string, key int, pos int, term string, lines int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, repeated rows and ids, common lines."""
    r = random.Random(11)
    words = ["the", "The", "THE", "été", "Éa", "x1", "1", "日本", "İ", "a-b", "q_", "zeta", "Mu", "ſ", "kilo"]
    shared = ["A line that recurs here", "  a LINE that recurs here\t", "été à la plage\x0b", "Été à la plage", "short"]
    out = []
    for i in range(150):
        parts = [r.choice(shared) if r.random() < 0.3 else " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
                 for _ in range(r.randint(0, 6))]
        out.append((i, "\n".join(parts)))
    out += [(None, "A line that recurs here\nonly in null"), (None, "only in null"), (3, "a line THAT recurs here"),
            (900, None), (901, ""), (902, "\n\n"), (903, " \t\n"), (904, "zeta " * 40_000), (905, "Long line " * 9_000),
            (906, "\n".join(["Long line " * 9_000] * 3)), (7, out[7][1]), (7, out[7][1])]
    langs, sources = ["en", "de", None, ""], ["s1", "s2", "s3", None]
    full = [(i, t, r.choice(langs), r.choice(sources)) for i, t in out]
    return full + [(950, None, "fr", "only"), (951, "!!", "nl", "a"), (952, "", "nl", "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, "r", 1, 2, "t", 3) for x in rows], WIDE).repartition(5)


@pytest.mark.parametrize("module", [lexical, divergence])
def test_terms_are_the_patterns_matches(module, rows):
    split, pattern = term_splitter(module.APART), re.compile(module.TERM)
    odd = "".join(map(chr, range(0x250))) + " \u0085 😀"
    for text in [t for _, t, *_ in rows] + [odd, odd[::-1]]:
        assert [w.decode() for w in split((text or "").encode())] == pattern.findall(lower(text))
    assert split(None) == []


def best_by_hand(rows, items, k):
    terms = [(i, re.findall(lexical.TERM, lower(t))) for i, t, *_ in rows]
    terms = [(i, Counter(t), len(t)) for i, t in terms if t]
    n, total = len(terms), sum(x[2] for x in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in terms:
            m = 100 - 75 + 75 * size * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) *
                        (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, q in Counter(re.findall(lexical.TERM, lower(text))).items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, at + 1, x[3], -x[0]) for at, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "the zeta zeta été"), (2, "kilo"), (2, "kilo"), (3, None), (4, ""), (5, "absent words"), (None, "x1 日本"),
         (6, "the " * 30_000 + "mu"), (7, " ".join(f"w{i}" for i in range(3_000)) + " Mu a b q")]


@pytest.mark.parametrize("block", [1024, 2])
def test_search_equals_brute_force(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical, "TILE_DOCS", 16)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in lexical.search(docs, items, k=10).collect()]
    assert sorted(got, key=str) == best_by_hand(rows, ITEMS, 10)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_vocabulary_tiles_stay_exact():
    """Weights beyond a tile's room go on in the next one; sums stay whole."""
    r = random.Random(2)
    entries = sorted((r.randrange(40), s, r.choice([1, 50, 10**10, 3 * 10**10])) for s in range(5) for _ in range(12))
    sums = Counter()
    for t, s, w in entries:
        sums[t, s] += w
    terms, slots = np.array([k[0] for k in sorted(sums)]), np.array([k[1] for k in sorted(sums)])
    tiles = lexical.vocabulary_tiles(terms, slots, [sums[k] for k in sorted(sums)], width=4)
    for names, at, cols, vals in tiles:
        assert len(names) <= 4
        assert max(np.bincount(cols, vals)) * lexical.LARGEST_IMPACT < 2**53
    doc, held = np.repeat(np.arange(3), 40), np.tile(np.arange(40), 3)
    impacts = np.array([r.randrange(1, 10**6) for _ in doc])
    got = lexical.tile_scores(doc, held, impacts, 3, tiles, 5)
    for d in range(3):
        for s in range(5):
            assert got[d, s] == sum(int(impacts[d * 40 + t]) * w for (t, x), w in sums.items() if x == s)


def test_lines_equal_brute_force(docs, rows):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    split = [(i, t, (t or "").split("\n")) for i, t, *_ in rows]
    for least in (2, 3):
        holders = defaultdict(set)
        for i, _, ls in split:
            for line in ls:
                if len(key(line)) >= 10:
                    holders[key(line)].add(i)
        first = {k: min(h, key=lambda i: (i is None, i or 0)) for k, h in holders.items() if len(h) >= least}
        want = []
        for i, t, ls in split:
            kept = [x for x in ls if first.get(key(x), i) == i]
            want.append((i, t, len(ls), len(ls) - len(kept), "\n".join(kept)))
        out = lines.deduplicate(docs, min_docs=least)
        got = [tuple(r) for r in out.select("row.doc_id", "row.text", "n_lines", "n_dropped", "kept").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert any(w[3] for w in want)
    assert out.schema["row"].dataType.names == docs.columns
    assert lines.deduplicate(docs.limit(0)).count() == 0


def audit_by_hand(rows, min_docs, top):
    split = [(lang or "", source or "", re.findall(divergence.TERM, lower(t))) for _, t, lang, source in rows]
    out = []
    for lang in {x[0] for x in split}:
        df, tf, sources = Counter(), defaultdict(Counter), sorted({s for g, s, _ in split if g == lang})
        for g, s, ts in split:
            if g == lang:
                df.update(set(ts))
                tf[s].update(ts)
        kept = [t for t, n in df.items() if n >= min_docs]
        count = {s: {t: tf[s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}

        def p(of, t):
            return 1 + 10**9 * (of[t] + 1) // (sum(of.values()) + len(kept))

        for s in sources:
            pairs = [(-sum((p(count[s], t) - p(count[o], t)) ** 2 // p(count[o], t) for t in kept), o)
                     for o in sources if o != s]
            terms = [(-((p(count[s], t) - p(whole, t)) ** 2 // p(whole, t)), t) for t in kept
                     if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, at + 1) for at, (v, item) in enumerate(found)]
    return sorted(out)


def test_audit_equals_brute_force(docs, rows, monkeypatch):
    want = audit_by_hand(rows, 3, 5)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    for postings, chunk, cells in ((4_000_000, 512, 1 << 20), (20, 3, 4)):
        monkeypatch.setattr(divergence, "RUN_POSTINGS", postings)
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
        got = divergence.audit(docs, min_docs=3, top=5).select(cols).collect()
        assert sorted(map(tuple, got)) == want
    assert {"pair", "term"} == {x[2] for x in want}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_probability_of_huge_counts():
    counts, sizes = np.array([0, 10**9, 5 * 10**12]), np.array([7 * 10**12, 10**10, 10**13])
    want = [1 + 10**9 * (int(c) + 1) // int(n) for c, n in zip(counts, sizes)]
    assert divergence.probability(counts, sizes).tolist() == want
    assert divergence.probability(counts[:2], sizes[:2]).tolist() == want[:2]
