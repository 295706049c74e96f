"""Spelling variants and their automata against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from llm.small import clashing, table
from oracle import check

from callgrain.llm import spelling
from callgrain.llm.automata import Automaton, backwards, matrix

SF = "/root/testdata/sf0.001"


def random_words(rng, letters, n, longest=7):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))).encode("latin-1") for _ in range(n)})


def common(a, b):
    return next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(1)
    for trial in range(150):
        words = random_words(rng, "ab" if trial % 2 else "abcdé", rng.randint(1, 60))
        rows, lengths = matrix(words)
        a = Automaton(rows, lengths)
        assert a.words == len(words) and a.number(rows, lengths).tolist() == list(range(len(words)))
        prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
        assert len(a.end) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})
        others = random_words(rng, "abé", 40)
        place = {w: i for i, w in enumerate(words)}
        assert a.number(*matrix(others)).tolist() == [place.get(w, -1) for w in others]
        assert [bytes(r[:n]) for r, n in zip(backwards(rows, lengths), lengths, strict=True)] == [w[::-1] for w in words]


@pytest.mark.parametrize("longer", [False, True])
def test_one_error_is_found_once(longer):
    rng = random.Random(2)
    for trial in range(150):
        words = random_words(rng, "ab" if trial % 2 else "abcd", rng.randint(1, 60))
        asked = random_words(rng, "abcd", 40)
        rows, lengths = matrix(asked)
        exact = np.array([rng.randint(0, len(w)) for w in asked])
        last = np.array([rng.randint(e, len(w)) for e, w in zip(exact, asked, strict=True)])
        row, number = Automaton(*matrix(words)).near(rows, lengths, exact, last, np.full(len(asked), longer))
        want = []
        for i, w in enumerate(asked):
            for j, v in enumerate(words):
                k = common(w, v)
                if longer:
                    near = len(w) == len(v) + 1 and w[:k] + w[k + 1 :] == v
                else:
                    near = len(v) == len(w) + 1 and v[:k] + v[k + 1 :] == w or len(v) == len(w) and w != v and w[k + 1 :] == v[k + 1 :]
                if near and exact[i] <= k <= last[i]:
                    want.append((i, j))
        assert sorted(zip(row.tolist(), number.tolist(), strict=True)) == sorted(want)


def brute_words(rows, least=7, times=2):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= times}


def brute(words, factor=10):
    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        k = common(a, b)
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]

    form, many = {}, {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        many[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, many[w], words[form[w]] if form[w] else None))
    return out


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


@pytest.mark.parametrize("letters", [1, 60, 400_000])
def test_forms_are_the_brute_force_ones(spark, letters):
    # a chain of four steps, ties, doubled letters, variants at both ends, and words of one crowded half
    rng = random.Random(4)
    words = {"abcdefgh": 100_000, "abcdefgx": 9_999, "abcdefgxy": 900, "abcdefxy": 90, "zabcdefxy": 9, "aaaaaaa": 40, "aaaaaaaa": 400, "aaaaaab": 4, "baaaaaa": 4, "abaaaaa": 3}
    words |= {"straße" + c: 50 for c in "abcdef"} | {"straßeé": 5, "ñandúes": 30, "ñandues": 3, "nandúes": 3}
    for _ in range(400):
        w = list(rng.choice(["international", "interna", "abcdefgh", "überaus"]))
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice("abnté")], [w[k], rng.choice("abnté")]])
        if len(w) >= 7:
            words.setdefault("".join(w), rng.choice([2, 3, 20, 25, 300]))
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    found = spelling.forms(df, letters=letters).cache()
    out = found.join(spelling.roots(found), "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
    assert got(out) == brute(words)


def test_keys_are_halved_until_they_are_small(spark):
    words = spark.range(3000).selectExpr("concat('prefix', lpad(translate(cast(id AS string), '0123456789', 'abcdefghij'), 4, 'z')) AS word", "id AS n")
    for letters in (500, 5_000):
        most = spelling.dealt(words, letters).filter("high - low > 1").groupBy("key").sum("size").agg({"sum(size)": "max"}).first()[0]
        assert most is None or most <= letters


def test_variants_of_awkward_texts(spark):
    rng = random.Random(5)
    long = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([7, 8, 30, 300]))) for _ in range(12)]
    spoil = lambda w: w[:3] + rng.choice(["", "x", w[3] + "é"]) + w[4:]
    extra = [(i, " ".join(rng.choice(long) if rng.random() < 0.9 else spoil(rng.choice(long)) for _ in range(200)) + "ÀÉ÷Wörter") for i in range(100, 140)]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in [*extra, (None, extra[0][1]), (None, None), (7, "")]], "doc_id long, text string, lang string, source string, n_chars long")
    docs = table(spark).unionByName(more).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(brute_words(rows))
    assert sum(r[1] is not None for r in want) > 5
    assert got(spelling.variants(clashing(docs))) == want
    assert got(spelling.variants(docs, letters=50)) == want
    assert spelling.variants(docs.filter("doc_id < 0")).count() == 0
    assert spelling.variants(docs.filter("text IS NULL")).count() == 0


def test_query_matches_sql(spark):
    for name, q in spelling.QUERIES.items():
        check(spark, q, spelling.ORACLE_SQL[name], SF)
