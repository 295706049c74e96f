"""Toxicity, quality, search, licences, WARC and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from llm.small import WORD, clashing, rows_of, table
from oracle import check
from pyspark.sql import functions as F

from callgrain.llm import cover_search, license_scan, mixing, quality_gbt, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("m", [mixing, cover_search, license_scan])
def test_matches_sql(spark, m):
    for name, q in m.QUERIES.items():
        check(spark, q, m.ORACLE_SQL[name], SF)


def area(score, y):
    """Chance that a row of class 1 has the higher score, ties by half."""
    values, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_toxicity_agrees_with_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity(clashing(docs), labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert 0.15 < got.held_out.mean() < 0.25
    held = got[got.held_out & got.toxic.notna()]
    y = held.toxic.to_numpy().astype(int)
    assert len(held) > 800 and area(held.score.to_numpy(), y) > 0.97 and (held.predicted != y).sum() <= 15
    for _, part in held.groupby("lang"):  # one cut serves all languages
        assert (part.predicted != part.toxic).mean() < 0.05
    assert toxicity.without_toxic(docs, labels).count() == (got.predicted == 0).sum()


def test_toxicity_edges(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(41, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count() and got.filter("score IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.toxicity(docs, labels.filter("toxic = 0")).agg({"predicted": "sum"}).first()[0] == 0
    assert toxicity.toxicity(docs.filter("doc_id < 0"), labels).count() == 0


def test_kneser_ney_sums_to_one():
    n0, n1 = np.array([5.0, 0.0, 3.0, 100.0]), np.array([1.0, 7.0, 0.0, 90.0])
    shared = ((n0 > 0).astype(float) + (n1 > 0)) / ((n0 > 0).sum() + (n1 > 0).sum())
    for n in (n0, n1):
        p = np.maximum(n - 0.75, 0) / n.sum() + np.minimum(n, 0.75).sum() / n.sum() * shared
        assert p.sum() == pytest.approx(1)
    r = toxicity.ratios(n0, n1)
    assert r[1] > 0 >= r[2]


def brute_evidence(rows):
    """The model of the module's text in plain dictionaries: evidence by word, and by pair beyond its word."""
    d, n = toxicity.DISCOUNT, (Counter(), Counter())
    for text, y in rows:
        words = [(c.strip(toxicity._STRIP) or c).lower() for c in text.split()]
        n[y].update(set(zip(["<s>", *words], [*words, "</s>"], strict=True)) if words else ())
    k = tuple(Counter(w for _, w in n[c]) for c in (0, 1))
    total, types = [sum(x.values()) for x in k], [len(x) for x in k]

    def shared(w):
        return sum(w in k[c] for c in (0, 1)) / sum(types)

    def lower(c, w):
        return (max(k[c][w] - d, 0) + d * types[c] * shared(w)) / total[c]

    def drawn(ratio, errors, a, b):
        return np.sign(ratio) * max(0.0, abs(ratio) - errors * np.sqrt(1 / (a + 1) + 1 / (b + 1)))

    seen = set(n[0]) | set(n[1])
    after = defaultdict(list)
    for v, w in seen:
        after[v].append(w)
    out = {}
    for w in set(k[0]) | set(k[1]):
        if w != "</s>":
            out[w] = drawn(np.log(lower(1, w) / lower(0, w)), toxicity.WORD_ERRORS, k[0][w], k[1][w])
    for v, w in seen:
        both = {x: n[0][v, x] + n[1][v, x] for x in after[v]}
        back = sum(min(x, d) for x in both.values()) / sum(both.values())
        mean = sum(lower(c, w) * total[c] for c in (0, 1)) / sum(total)
        whole = max(both[w] - d, 0) / sum(both.values()) + back * mean
        p = []
        for c in (0, 1):
            kept = sum(max(n[c][v, x] - d, 0) for x in after[v])
            below = whole * lower(c, w) / mean
            p.append((1 - back) * max(n[c][v, w] - d, 0) / kept + back * below if kept else below)
        ratio = np.log(p[1] / p[0]) - np.log(lower(1, w) / lower(0, w))
        out[v, w] = drawn(ratio, toxicity.PAIR_ERRORS, n[0][v, w], n[1][v, w])
    return {x: v for x, v in out.items() if v}


def test_toxicity_model_is_the_brute_force_one(spark):
    """Evidence of every word and pair, and the scores that follow, as plain dictionaries have them."""
    from callgrain.llm.common import mark, staged

    rng = random.Random(11)
    words = [f"W{i}." for i in range(60)] + ["!", "é", "x"]
    texts = [("", 0), ("  ", 1), ("x x x", 1)]
    for i in range(400):
        y = int(i % 4 == 0)
        texts.append((" ".join(rng.choice(words[: 25 if y else 63]) if rng.random() < 0.8 else ("bad omen" if y else "good omen") for _ in range(rng.randint(1, 30))), y))
    want = brute_evidence(texts)
    assert sum(isinstance(x, tuple) for x in want) > 3 and sum(isinstance(x, str) for x in want) > 10
    since = mark()
    rows = spark.createDataFrame(texts, "text string, toxic int").repartition(5)
    found = {r.key: (r.value, r.n) for r in toxicity.evidence(staged(toxicity.pair_counts(rows), "pairs"), since).collect()}
    hashed = toxicity.Words()
    at = {"<s>": toxicity._START, "</s>": toxicity._END}

    def word(w):
        return np.uint64(at[w]) if w in at else hashed(w)[0]

    keys = {x: int((word(x) if isinstance(x, str) else toxicity.pair_keys(np.array([word(x[0])]), np.array([word(x[1])]))[0]).astype(np.int64)) for x in want}
    assert set(keys.values()) == set(found)
    assert all(found[keys[x]][0] == pytest.approx(v, abs=1e-9) for x, v in want.items())


def labelled_texts(spark, toxic, clean, n=300):
    """Texts of random words: ``toxic(i)`` in each third one, ``clean(i)`` in the others; and their labels."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(30)]
        t.insert(rng.randrange(31), toxic(i) if i % 3 == 0 else clean(i))
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


def held_out_errors(docs, labels, **more):
    got = toxicity.toxicity(docs, labels, **more).filter("held_out").collect()
    return sum(r.predicted != (r.doc_id % 3 == 0) for r in got) / len(got)


def test_toxicity_rare_words(spark):
    # each slur is held by 6 or 7 toxic texts: fewer than 10 contexts
    docs, labels = labelled_texts(spark, lambda i: f"slur{i // 3 % 15}", lambda i: f"kind{i % 30}")
    assert held_out_errors(docs, labels) < 0.1
    # a stock phrase: its inner word has one context in however many texts
    docs, labels = labelled_texts(spark, lambda i: "w1 foul w2", lambda i: "w1 w3 w2")
    assert held_out_errors(docs, labels) < 0.1


def test_toxicity_expressions(spark):
    # the same words in both classes: their order tells
    docs, labels = labelled_texts(spark, lambda i: "x1 x2 x3 x4", lambda i: "x4 x3 x2 x1")
    assert held_out_errors(docs, labels) < 0.05


def test_toxicity_model_of_any_size(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    whole = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for head in (0, 20):  # all, or all but 20, entries are joined
        split = toxicity.toxicity(docs, labels, head=head).collect()
        assert len(split) == len(whole) and all(abs(r.score - whole[r.doc_id].score) < 1e-6 and r.predicted == whole[r.doc_id].predicted for r in split)
        kept = toxicity.without_toxic(clashing(docs), labels, head=head)
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(k for k, r in whole.items() if not r.predicted)


def test_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2)) * [1, 5] + [3, -2]
    p = 1 / (1 + np.exp(-(x @ [1.0, 0.2] - 2.6)))
    y = (rng.random(4000) < p).astype(int)
    w = toxicity.calibrate(x, y, 1e-9)
    assert np.allclose(w, [-2.6, 1.0, 0.2], atol=0.3)
    score = 1 / (1 + np.exp(-(x @ w[1:] + w[0])))
    assert abs(score.sum() - y.sum()) < 1e-3  # the likelihood's slope is 0
    apart = toxicity.calibrate(np.array([[0.0], [0.1], [0.9], [1.0]]), np.array([0, 0, 1, 1]))
    assert apart[1] > 0 and np.isfinite(apart).all()
    same = toxicity.calibrate(np.zeros((4, 1)), np.array([0, 1, 0, 0]))
    assert 1 / (1 + np.exp(-same[0])) == pytest.approx(0.25, abs=1e-3)


def test_statistics_on_columns_and_arrays(spark):
    rows = [(1.5, 4.0, 16.0, 3, 2), (-2.0, 0.0, 0.0, 10, 9), (0.0, 0.0, 0.0, 0, 0)]
    weights = [0.3, -1.0, 2.0, 0.5, 0.7]
    df = spark.createDataFrame(rows, "total double, second double, fourth double, words long, types long")
    got = [r[0] for r in df.select(toxicity.linear(weights)).collect()]
    assert got == pytest.approx(list(toxicity.statistics(np.array(rows)) @ weights[1:] + weights[0]))


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    marked = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(marked)


def test_quality_counts(spark):
    docs = table(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = sorted(((r.doc_id, *base_counts(r.text)) for r in docs.collect()), key=repr)
    got = quality_gbt.quality(clashing(docs), labels)
    assert rows_of(got, "doc_id", *quality_gbt.COUNTS[:5]) == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert quality_gbt.quality(docs.filter("doc_id < 0"), labels).count() == 0
    assert quality_gbt.quality(docs, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_quality_is_monotonic_and_flat_nodes_agree():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 9))
    y = ((x[:, 2] < 0.5) & (x[:, 1] > 0.2) ^ (rng.random(2000) < 0.05)).astype(float)
    f = quality_gbt.fit(x, y)
    assert ((f.score(x) >= 0.5) == y).mean() > 0.93
    grid = np.repeat(x[:50], 21, axis=0)
    for k in (2, 3, 4):
        g = grid.copy()
        g[:, k] = np.tile(np.linspace(0, 1, 21), 50)
        assert (np.diff(f.score(g).reshape(50, 21), axis=1) <= 1e-12).all()

    def walk(row):
        total = f.base
        for at in f.roots:
            while f.feature[at] >= 0:
                at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
            total += quality_gbt.RATE * f.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x[:40]), [walk(r) for r in x[:40]])


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_gbt.quality(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    assert got.filter("(score >= 0.5) = (quality = 1)").count() / got.count() > 0.98


def vectors(spark, seed=0, n=230, size=8):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(size)]) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(20)]  # ties
    rows += [(300, None), (301, [1.0, None]), (350, [float("nan")] * size), (351, [float("inf")] * size), (None, [0.5] * size), (400, [0.5, 0.5]), (402, [0.25, 0.5]), (7, rows[7][1]), (450, []), (452, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize(("block", "cell"), [(8192, 4096), (50, 4096), (8192, 30), (15, 40)])
def test_top_k(spark, monkeypatch, block, cell):
    monkeypatch.setattr(cover_search, "BLOCK", block)
    monkeypatch.setattr(cover_search, "CELL", cell)
    monkeypatch.setattr(cover_search, "GROUP", 3)
    df = vectors(spark)
    usable = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    want = []
    for i, q in {i: q for i, q in usable if i % 50 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p in usable if j != i and len(p) == len(q))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found)]
    assert rows_of(cover_search.top_k(clashing(df), F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert cover_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(0).normal(size=(500, 5))
    t = cover_search.CoverTree(x, 2)
    rows = lambda n: cover_search.Block._under(t, n)
    assert sorted(rows(t.root).tolist()) == list(range(500))
    for n in range(len(t.center)):
        assert np.sqrt(((x[rows(n)] - x[t.center[n]]) ** 2).sum(1)).max() <= t.r[n] + 1e-9
        assert np.linalg.norm(x[rows(n)], axis=1).max() <= t.most[n] + 1e-9
        for c in t.children[n]:  # a centre is within a level's distance of the one that it hangs below
            assert np.linalg.norm(x[t.center[c]] - x[t.center[n]]) <= cover_search.BASE ** (t.level[n] + 1) + 1e-9
    centers, spacing, parent, _, near = cover_search.farthest_first(x, 200)
    level = np.floor(np.log(spacing[1:]) / np.log(cover_search.BASE))
    for i in set(level.tolist()):  # levels nest as prefixes; their centres are apart, and near all rows
        net = x[centers[: 1 + int((level >= i).sum())]]
        d = np.linalg.norm(net[:, None] - net[None], axis=2) + np.eye(len(net)) * 1e9
        assert d.min() >= cover_search.BASE**i - 1e-9
        if i > level.min():
            assert np.linalg.norm(x[:, None] - net[None], axis=2).min(1).max() <= cover_search.BASE ** (i + 1)
    assert all(parent[j] < j for j in range(len(parent)))


def test_bound_holds_and_prunes():
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(60, 16))
    x = np.floor(256 * (middle[rng.integers(0, 60, 3000)] + 0.05 * rng.normal(size=(3000, 16))))
    ids, q = np.arange(3000), np.arange(0, 3000, 50)
    for data in (x, np.floor(256 * rng.normal(size=(3000, 16)))):
        b = cover_search.Block(data, ids)
        got = b.search(data[q], q, 5)
        s = data[q] @ data.T
        s[np.arange(len(q)), q] = -np.inf
        assert got == [sorted(zip((-r).tolist(), ids.tolist(), strict=True))[:5] for r in s]
        t = b.tree
        top = cover_search.bound(data[q], 0.0, np.linalg.norm(data[q], axis=1), t.c, t.r, t.most)
        for n in range(0, len(t.center), 7):
            assert ((data[q] @ data[cover_search.Block._under(t, n)].T).max(1) <= top[:, n]).all()
        if data is x:
            assert b.scored < 0.1 * b.asked  # the share of pairs that are scored


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [("LICENSE", "Released under the MIT License."), ("a/x.txt", "words only"), ("a/b/COPYING.md", "words " * 30 + "\n" + apache), ("a/b/c/d.txt", "no mark"), ("a/bc/e.txt", ""), (None, None), ("z/own.txt", "words\n# " + apache + "\nwords words words words words words words words words words words words words"), ("z/f.txt", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.license, r.origin, r.license_dir) for r in license_scan.scan(clashing(df.withColumnRenamed("path", "p")).withColumn("path", F.col("p"))).collect()}
    assert got["LICENSE"] == ("MIT", "own", None)
    assert got["a/x.txt"] == ("MIT", "inherited", "")
    assert got["a/b/COPYING.md"][:2] == ("Apache-2.0", "own")
    assert got["a/b/c/d.txt"] == ("Apache-2.0", "inherited", "a/b")
    assert got["a/bc/e.txt"] == ("MIT", "inherited", "")
    assert got["z/own.txt"][:2] == ("Apache-2.0", "own") and got["z/f.txt"] == ("MIT", "inherited", "")
    assert got[None] == ("MIT", "inherited", "")
    assert license_scan.scan(df.limit(0)).count() == 0


def test_full_license_texts(spark):
    full = license_scan.FULL
    code = "\n".join(f"def f{i}(x{i}): return x{i} + {i}" for i in range(400))
    holder = "Copyright (c) 2020 Some Body and others\n\n"
    rows = [(f"{k}/LICENSE", holder + v) for k, v in full.items()] + [(f"{k}/x.c", "int x;") for k in full]
    rows += [(f"text/{k}/a", v.replace("\n", " \r\n   ")) for k, v in full.items()] + [("code/a.py", full["MIT"] + code), ("code/b.py", code)]
    got = {r.path: r for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for k in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "MIT", *full):
        assert (got[f"{k}/LICENSE"].license, got[f"{k}/LICENSE"].origin) == (k, "own") and got[f"{k}/LICENSE"].cosine > 0.9
        assert (got[f"{k}/x.c"].license, got[f"{k}/x.c"].origin, got[f"{k}/x.c"].license_dir) == (k, "inherited", k)
        assert got[f"text/{k}/a"].license == k  # no name says so
    assert got["code/b.py"].license is None  # a source file with a licence in it gives none to its neighbours


def test_open_heads_and_custom_elements():
    assert warc.plain_text("<html><head><title>t</title><body><p>All text</p>") == "All text"
    assert warc.plain_text("<head><meta charset=x><script>'<p>no'</script><!-- <p>no --><p>All</p> text") == "All\ntext"
    assert warc.plain_text("<head> words without markup") == "words without markup"
    assert warc.plain_text("<head><div>no</div></head><p>All text") == "All text"
    assert warc.plain_text("<p>a<head-line>b</head-line> c<script-x>d</script-x> e<template-y>f") == "ab cd ef"
    assert warc.plain_text("<p>a<script src=x>no</script>b<style/>no</style>") == "ab"


def test_markup_is_read_in_linear_time():
    import time

    bad = ["<a title=\"", "<a '", "<!--", "<!x ", "<title>", "<head>", "<script>", "<a \">\" ", "<", "</", "<title ", "<html lang", "<head><head"]
    for piece in bad:
        for end in ("", "'", '"'):
            began = time.perf_counter()
            warc.Page(piece * (1_000_000 // len(piece)) + end)
            assert time.perf_counter() - began < 8, piece
    assert warc.plain_text("<p>it <a title='x>one</a> two") == "it one two"
    assert warc.plain_text('<p>it <a title="a > b">one</a> 1 < 2 <? x ?>') == "it one 1 < 2"


class Texts(HTMLParser):
    """Plain-text reference: drops elements without text, breaks lines at blocks."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in warc.DROPPED.split()
        if tag in warc.BLOCKS.split():
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in warc.DROPPED.split()
        if tag in warc.BLOCKS.split():
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = warc.derivatives(warc.responses(clashing(pages))).collect()
    assert len(got) == 2 * pages.count()
    html = {r.page_id: r.html for r in pages.collect()}
    by = {(r.page_id, r.record_type): r for r in got}
    for (i, kind), r in by.items():
        assert r.refers_to == by[i, "metadata"].refers_to and r.source_digest == warc.digest(html[i].encode())
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[:-4]
        assert len(block) == int(fields["Content-Length"]) and warc.digest(block) == fields["WARC-Block-Digest"] == r.block_digest
        assert fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Target-URI"] == r.target_uri and fields["WARC-Record-ID"] == r.record_id
        if kind == "conversion":
            p = Texts()
            p.feed(html[i])
            p.close()
            want = "\n".join(x for x in (" ".join(y.split()) for y in "".join(p.out).split("\n")) if x)
            assert r.text == want == block.decode() and fields["WARC-Source-Payload-Digest"] == r.source_digest
        else:
            own = html[i].encode()
            assert b"source-status: HTTP/1.1 200 OK" in block and b"source-header-content-type: text/html" in block
            assert f"source-header-content-length: {len(own)}\r\n".encode() in block and hashlib.md5(own).hexdigest().encode() in block
    # what the derivatives refer to is there, with the headers and the payload that they name
    found = {r.record_id: bytes(r.record) for r in warc.response_records(warc.responses(pages)).collect()}
    for r in got:
        head, _, block = found[r.refers_to].partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert fields["WARC-Payload-Digest"] == r.source_digest == warc.digest(block[:-4].partition(b"\r\n\r\n")[2])
        assert f"WARC-Date: {fields['WARC-Date']}\r\n".encode() in bytes(r.record) and len(block) - 4 == int(fields["Content-Length"])


def test_warc_edges(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "a\r\nb", "x<b>y</b><p title='a>b'>z&amp;&#233;<script>no<p></script><!-- c --> w<br/>v <cut"), (2, "a", "<style>only"), (2, "a", "<style>only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [r for r in warc.derivatives(warc.responses(df)).collect() if r.record_type == "conversion"]
    assert sorted(r.text for r in got) == ["", "", "", "", "xy\nz&é w\nv"]
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


def check_stages(spark, docs):
    """Each stage against brute force on what the one before it kept: rows with null and repeated ids, nulls and all."""
    import corpus_pipeline as P
    from llm.test_text_ops import dropped, linked, words_in
    from tokenizers import Tokenizer

    from callgrain.llm.common import staged
    from callgrain.llm.rank_sync import tokenizer_path

    names, out = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = staged(stage(spark, docs, SF), name)
        out[name] = ([(r.doc_id, r.text) for r in before.collect()], docs, before)
        assert name == "tokens" or docs.columns == names
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    rows, after, before = out["toxicity"]
    predicted = toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    bad = {r.doc_id for r in predicted if r.predicted}
    assert after.count() == len(rows) - sum(r.predicted for r in predicted) and texts(after) <= Counter(rows)
    assert {r.doc_id for r in after.collect()} >= {i for i, _ in rows} - bad
    rows, after, _ = out["near_copies"]
    own = {r for r in rows if r[0] is not None}
    stay = {r[0] for r in linked(sorted(own, key=repr)) if r[3]}
    assert texts(after) == Counter(r for r in own if r[0] in stay) + Counter(r for r in rows if r[0] is None)
    rows, after, _ = out["repeated_passages"]
    assert texts(after) == Counter((i, dropped(t, rows, 50)) for i, t in rows)
    rows, after, before = out["mixture"]
    taken = {}
    for r in mixing.mix(before).collect():
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + r.taken
    assert words_in(after.collect()) == {k: n for k, n in taken.items() if n}
    t = Tokenizer.from_file(tokenizer_path())
    rows, after, _ = out["tokens"]
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in after.collect()) == want
    return out


def test_pipeline(spark):
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_pipeline_edges(spark):
    """Nulls, empty and very long texts, copies, repeated rows and clashing columns, value by value; and an empty table."""
    out = check_stages(spark, clashing(table(spark)))
    rows = out["mixture"][1].collect()
    assert rows and all(r["size"] == r["key"] == r["score"] == "clash" and r.n_chars == len(r.text) for r in rows)
    assert {None, ""}.isdisjoint(r.text for r in rows)  # without words there is nothing to take
    empty = check_stages(spark, table(spark).limit(0))
    assert empty["tokens"][1].count() == 0
