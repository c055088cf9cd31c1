"""Operators on pairs and graphs: components, aliases, near-duplicates, neighbours."""

import itertools
import random

import numpy as np
import pytest

from tablewright.llm import ann, neardup, urls
from tablewright.llm.components import components
from tablewright.llm.words import words_of

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def roots_of(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)]
    pairs += [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(180)]
    df = spark.createDataFrame(pairs + [(None, 3), (5, 5)], "a long, b long")
    want = roots_of([(a, b) for a, b in pairs if a != b])
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_urls_rules_and_aliases(spark):
    link = '<html><LINK href="{}" rel=canonical></html>'.format
    refresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [
        (1, "https://www.Example.NET/en/a?x#y", None), (2, "http://a.net/b", ""), (3, "https://b.org/fr/q", "<p>"),
        (4, "https://plain.example.com/x", link("https://bad.net/x")),            # alias of a blocked url
        (5, "https://other.example.com/y", refresh("http://plain.example.com/x")),  # two steps away
        (6, "https://mixed.example.com/y", link("https://bad.net/z")),
        (7, "https://mixed.example.com/y#top", link("https://good.org/fr/")),      # allowed alias: allow wins
        (8, "https://lone.example.com/?utm_source=a", link("/?ref=1")), (9, None, link("https://bad.net/x")),
        (10, "no scheme", None), (None, "https://x.example.com/de/", None), (12, "https://x.example.com?q=/de/", None),
        (13, "https://notexample.net/en/", None), (14, "https://net", None), (15, "ftp://É.NET/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, RULES).collect()}
    assert got[1] == ("www.example.net", "/en/a", "example.net/en/", "allow")
    assert got[2] == ("a.net", "/b", "net/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4][2:] == (None, "block") and got[5][2:] == (None, "block")
    assert got[6][2:] == (None, "allow") and got[7][2:] == (None, "allow") and got[8][2:] == (None, "allow")
    assert got[9] == got[10] == ("", "", None, "allow")
    assert got[None][2:] == ("example.com/de/", "block") and got[12] == ("x.example.com", "", None, "allow")
    assert got[13][2:] == ("net/", "block") and got[14] == ("net", "", None, "allow") and got[15][0] == "É.net"
    assert len(got) == len(rows) and urls.judge(df.limit(0), RULES).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def shingles(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " .,! ", "one two", "One  two!", "a b c d e"]
    base = [word() for _ in range(150)]
    for i in range(260):  # variants of one text from light to heavy edits: a large group that is no clique
        w = list(base)
        for _ in range(i % 16):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [passage + " " + " ".join(word() for _ in range(r.randint(20, 160))) for _ in range(150)]
    out += [" ".join(base)] * 80
    out += [" ".join(word() for _ in range(r.randint(5, 90))) for _ in range(60)]
    return out


def test_near_duplicates_equal_brute_force(spark, corpus):
    df = spark.createDataFrame([(i if i else None, t, i) for i, t in enumerate(corpus)], "doc_id long, text string, n int")
    sets = [shingles(t) for t in corpus]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(corpus)), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    want = roots_of(pairs)
    rows = {r["n"]: r for r in neardup.classes(df).select("row.n", "class_id", "class_size", "kept").collect()}
    assert len(rows) == len(corpus)
    for i in range(1, len(corpus)):
        assert rows[i]["class_id"] == want.get(i, i), i
        assert rows[i]["kept"] == (want.get(i, i) == i)
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in rows.values())
    assert neardup.classes(df.limit(0)).count() == 0


def test_deduplicate_keeps_user_columns_in_any_number_of_slices(spark, corpus, monkeypatch):
    rows = [(i, t, i, f"r{i}") for i, t in enumerate(corpus)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, tw_uid int, row string").repartition(5)
    whole = sorted(neardup.deduplicate(df).collect())
    worded = [r["doc_id"] for r in whole if r["doc_id"] > 2]           # texts without words stay, each row its own class
    assert len(set(worded)) == len(worded) == len(whole) - 6 < len(corpus)
    assert all(r["tw_uid"] == r["doc_id"] and r["row"] == f"r{r['doc_id']}" and r["text"] == corpus[r["doc_id"]]
               for r in whole)
    monkeypatch.setattr(neardup, "SLICE", 2)
    assert sorted(neardup.deduplicate(df).collect()) == whole
    assert neardup.deduplicate(df.limit(0)).columns == df.columns and neardup.deduplicate(df.limit(0)).count() == 0


def test_scratch_folders_go_with_their_owner(spark, corpus):
    import glob

    from tablewright.llm.common import materialize, temporary
    from tablewright.session import checkpoint_dir

    def folders():
        return set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/tw-*"))

    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    before = folders()
    with temporary(spark):
        kept = materialize(neardup.deduplicate(df), "kept", outer=True)
        assert len(folders() - before) > 1
    assert len(folders() - before) == 1 and kept.count() > 0


def probability_jaccard(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[d], y.get(j, 0) / y[d]) for j in x.keys() | y.keys())
               for d in x.keys() & y.keys())


def test_probability_jaccard_and_its_estimate():
    r = random.Random(6)
    for _ in range(20):
        x = {i: r.randint(1, 5) for i in r.sample(range(40), 25)}
        y = {i: r.randint(1, 5) for i in r.sample(range(40), 25)}
        assert abs(neardup.weighted_similarity(list(x), list(x.values()), list(y), list(y.values()))
                   - probability_jaccard(x, y)) < 1e-9
    h = neardup.mix(np.arange(1, 41, dtype=np.uint64) * np.uint64(77777777777))
    owner, key, weight = [], [], []
    for t, s in enumerate((x, y)):
        owner += [t] * len(s)
        key += [h[i] for i in s]
        weight += list(s.values())
    regs = neardup.probminhash(np.array(owner), np.array(key, np.uint64), np.array(weight, float), 2, 4000)
    assert abs((regs[0] == regs[1]).mean() - probability_jaccard(x, y)) < 0.04


def test_count_weights(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h " * 20), (2, "a b c d e f g h " * 21), (3, "q w e r t y u")],
                               "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df, weights="count").select("row.doc_id", "class_id").collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 12))
    x[300:600] = x[7]                                  # a third are one vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * 12), (1060, [float("nan")] * 12), (1080, [None] * 12),
           (1100, [1.0, 2.0]), (None, rows[1][1]), (1120, [float("inf")] + [1.0] * 11)]
    df = spark.createDataFrame(rows + odd + [rows[0]], "vec_id long, embedding array<double>")
    out = ann.search(df, lambda i: i % 20 == 0, k=20, leaf=64).toPandas()
    hit = total = 0
    for q, part in out.groupby("query_id"):
        part = part.sort_values("rank")
        assert q % 20 == 0 and q < 900 and list(part["rank"]) == list(range(1, 21)) and q not in set(part["vec_id"])
        scores = x @ x[q]
        assert np.allclose(part["score"], scores[part["vec_id"]], rtol=0, atol=1e-9)
        assert list(part["vec_id"]) == [i for _, i in sorted(zip(-part["score"], part["vec_id"]))]
        scores[q] = -np.inf
        hit += (part["score"] >= np.sort(scores)[-20] - 1e-9).sum()
        total += 20
    assert out["query_id"].nunique() == 45 and hit / total >= 0.9
    few = ann.search(spark.createDataFrame(rows[:5], df.schema), lambda i: i % 2 == 0, k=20).toPandas()
    assert len(few) == 3 * 4
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_ann_recall_with_uneven_lengths(spark):
    g = np.random.default_rng(4)
    x = g.standard_normal((4000, 64)) * g.lognormal(0, 0.5, 4000)[:, None]
    x[7] *= 20 * np.sqrt((x ** 2).sum(1).max()) / np.sqrt((x[7] ** 2).sum())  # one very long vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.search(df, lambda i: i % 20 == 1, k=20, leaf=64).toPandas()
    hit = 0
    for q, part in out.groupby("query_id"):
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += (part["score"] >= np.sort(scores)[-20] - 1e-9).sum()
    assert out["query_id"].nunique() == 200 and hit / 4000 >= 0.9


def test_links_are_resolved_like_a_browser_would(spark):
    """Relative links that hold ``://``, dot segments, queries, several rel words."""
    rules = (("bad.net", "/", "block"), ("example.com", "/x/", "block"))
    tag = '<link rel="{}" href="{}">'.format
    pages = [
        (1, "http://good.org/a/page", tag("canonical", "/out?to=https://bad.net/")),   # its own address
        (2, "http://good.org/b/c/page", tag("canonical", "../../y")),
        (3, "http://good.org/y", tag("alternate canonical", "https://bad.net/z")),
        (4, "http://example.com/p/q/page", tag("canonical", "../../x/./1")),
        (5, "http://good.org/list", tag("canonical", "?page=1")),
        (6, "http://good.org/list?page=1", tag("canonical", "http://bad.net/l")),
        (7, "http://good.org/d", tag("canonicals", "https://bad.net/z")),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(
        spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow"}


def test_mixture_of_null_and_repeated_keys_comes_near_its_target(spark):
    from tablewright.llm import mixing

    rows = [(None if i % 2 else 5, "word " * 10, f"s{i % 3}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for _ in range(2):
        plan = mixing.mix_plan(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
        assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.05 for r in plan)
        assert mixing.mix(docs).count() * 10 == pytest.approx(sum(r["max(target)"] for r in plan), rel=0.05)
