"""Suffix dedup, token counts, encoding, near copies and mixing against brute force."""

import collections
import hashlib
import random
import re

import pytest
from llm.small import WORD, clashing, rows_of, table
from pyspark.sql import functions as F

from callgrain.llm import components, hyperminhash, lexicon_bpe, mixing, rank_sync, suffix_dedup
from callgrain.llm.common import staged
from callgrain.llm.two_stage import common_prefixes, suffix_array


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(rank_sync.tokenizer_path())


def test_suffix_array():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        s = bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(1, 50))) if rng.random() < 0.7 else b"abc" * rng.randint(1, 20) + b"c" * rng.randint(0, 9)
        t = np.frombuffer(s, np.uint8)
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix_array(t, 64).tolist() == want

        def prefix(i, j, s=s):
            k = 0
            while k < 16 and max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            return k

        assert common_prefixes(t, np.array(want), 16).tolist() == [prefix(i, j) for i, j in zip(want, want[1:], strict=False)]


def removed(rows, length=400, least_words=0):
    """Brute force over all windows; removed runs of fewer words stay."""
    seen, twice = set(), set()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            (twice if w in seen else seen).add(w)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in twice:
                gone[k : k + length] = b"\1" * length
        for m in list(re.finditer(b"\1+", gone)) if least_words else ():
            if len(b[m.start() : m.end()].split()) < least_words:
                gone[m.start() : m.end()] = bytes(m.end() - m.start())
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2_000_000, 3000, 1])
def test_suffix_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = removed([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in want) > 5000
    assert rows_of(suffix_dedup.removals(clashing(docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("hot", [2_000_000, 1])
def test_suffix_dedup_passages(docs, monkeypatch, hot):
    """The contract's columns do not change beside passages, and passages are the brute force's."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, passages = removed(rows), removed(rows, 200, 50)
    assert sum(r[2] for r in passages) > 5000 and [r[2] for r in passages] != [r[2] for r in want]
    got = suffix_dedup.removals(clashing(docs), passages=(200, 40, 50)).cache()
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert rows_of(got, "doc_id", "n_bytes", "n_passage_bytes", "n_passages") == sorted((r[:4] for r in passages), key=repr)
    assert suffix_dedup.removals(docs.filter("doc_id < 0"), passages=(200, 40, 50)).count() == 0


def test_query_reports_short_passages(spark, tmp_path):
    """Passages of 51 words under 400 bytes are reported in every text that holds them, and nothing of them is removed."""
    rng = random.Random(6)
    text = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(k))
    passage, few, long = text(51), text(40), text(120)
    assert len(few) > 200 and len(passage) < 400 < len(long)
    kinds = {0: "", 1: passage, 2: few, 3: long}
    rows = [(100 * kind + k, text(80) + "\n" + p + "\n" + text(80)) for kind, p in kinds.items() for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for r in suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect():
        kind = r.doc_id // 100
        assert (r.n_passages, r.n_passage_bytes >= len(kinds[kind])) == ((1, True) if kind in (1, 3) else (0, kind == 0))
        assert (r.n_spans, r.n_removed >= len(long)) == ((1, True) if kind == 3 else (0, False))


def test_longest_run(spark):
    cases = [([(0, 200), (1, 201)], 201), ([(5, 10), (0, 5), (20, 26)], 10), ([(3, 9), (4, 6), (8, 12), (30, 31)], 9)]
    rows = spark.createDataFrame(cases, "spans array<struct<s int, e int>>, want int")
    assert all(r.got == r.want for r in rows.select("want", suffix_dedup._longest(F.col("spans")).alias("got")).collect())


@pytest.mark.parametrize("words", [0, 50])
def test_deduplicated_texts(docs, words):
    """Every row, null and repeated ids too: what is left is the brute force's, without the stray bytes of a cut character."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((i, None if t is None else dropped(t, rows, words)) for i, t in rows), key=repr)
    got = suffix_dedup.deduplicated(clashing(docs), 200, 40, words).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == want
    assert all(r["size"] == "clash" and r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def dropped(text, rows, words, length=200, seen={}):  # noqa: B006  windows are found once
    if text is None:
        return None
    key = hash(tuple(rows))
    if key not in seen:
        count = {}
        for _, t in rows:
            b = (t or "").encode()
            for k in range(len(b) - length + 1):
                count[b[k : k + length]] = count.get(b[k : k + length], 0) + 1
        seen[key] = count
    b, gone = text.encode(), bytearray(len(text.encode()))
    for k in range(len(b) - length + 1):
        if seen[key][b[k : k + length]] > 1:
            gone[k : k + length] = b"\1" * length
    out, at = b"", 0
    for m in re.finditer(b"\1+", gone):
        if len(b[m.start() : m.end()].split()) >= words:
            out, at = out + b[at : m.start()], m.end()
    return (out + b[at:]).decode("utf-8", "ignore")


def test_short_passages(spark):
    """Passages of 50 to 60 words under 400 bytes go, runs of fewer words stay, other texts are as they were."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = {n: text(n) for n in (30, 45, 51, 55, 60)}
    assert all(len(p) < 400 for p in passages.values())
    rows = [(100 * n + k, text(80) + "\n" + p + "\n" + text(80)) for n, p in passages.items() for k in range(4)] + [(k, text(200)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in suffix_dedup.deduplicated(df, 200, 40, 50).collect():
        n = r.doc_id // 100
        if n >= 51:
            assert passages[n] not in r.text and len(r.text.split()) >= 158
        else:
            assert r.text == dict(rows)[r.doc_id]


def test_anchors_over_chunks(monkeypatch):
    """Segments tile the windows whatever the chunk, and equal windows have equal anchors."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = " ".join(word() for _ in range(900)).encode()
    text += text[1000:2500]
    seen = []
    for chunk in (1 << 18, 700, 64):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        for length, anchor in ((400, 64), (200, 40)):
            found = list(suffix_dedup.Anchors(length, anchor).segments(text))
            at = {}
            for value, lo, n, _ in found:
                at.update(dict.fromkeys(range(lo, lo + n), value))
            assert sorted(at) == list(range(len(text) - length + 1)) and len(at) == sum(x[2] for x in found)
            by = {}
            assert all(by.setdefault(text[k : k + length], v) == v for k, v in at.items())
            seen.append((length, at))
    assert all(a == b for k, a in seen for j, b in seen if k == j)


def test_token_counts(docs, tokenizer):
    rows = docs.collect()
    n = [len(e.ids) for e in tokenizer.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    want = sorted(((r.doc_id, len((r.text or "").encode()), k, k > 2048) for r, k in zip(rows, n, strict=True)), key=repr)
    assert rows_of(rank_sync.token_counts(clashing(docs)), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_encoding(docs, tokenizer):
    rows = docs.collect()
    enc = tokenizer.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((r.doc_id, len(e.ids), sha(" ".join(map(str, e.ids))), sha(tokenizer.decode(e.ids, skip_special_tokens=False))) for r, e in zip(rows, enc, strict=True)), key=repr)
    for words in (65_536, 10):
        assert rows_of(lexicon_bpe.digests(clashing(docs), words=words), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    some = docs.filter("doc_id < 20")
    ids = lexicon_bpe.encode(some)
    texts = {r.doc_id: r.text for r in lexicon_bpe.decode(ids).collect()}
    assert all(texts[r.doc_id] == tokenizer.decode(tokenizer.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in some.collect())


def test_random_unicode_tokens(tokenizer):
    import pyarrow as pa

    rng = random.Random(3)
    alphabet = "aabbcAZé ÉßΣσςİıǅ  \t\n\x0b\x1c\x1d\x85\xa0　'sStTreELL0129½²ⅷ中文한ȩ́ñ!@#$%^&*()_+-=🙂👨‍👩‍👧​﻿\0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "<|endoftext|>hi<|startoftext|><|endoftext|>", "<|endoftext", "\x1c", "'s's"]
    out = rank_sync.count_batches(rank_sync.tokenizer_path(), 2048)([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])])
    got = [n for b in out for n in b.column(2).to_pylist()]
    assert got == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_transducer(tmp_path):
    def packed(words, ids):
        path = tmp_path / f"{len(words)}.lexicon"
        path.write_bytes(lexicon_bpe.pack(lexicon_bpe.build(words, ids)))
        return lexicon_bpe.Lexicon(str(path))

    words = sorted({w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops", "é", "")})
    lex = packed(words, [[i] for i in range(len(words))])
    assert lex.find(words).tolist() == list(range(len(words)))
    assert lex.find([b"to", b"topsy", b"z"]).tolist() == [-1, -1, -1]
    assert len(lex.end) < sum(map(len, words))  # suffixes are shared
    empty = packed([], [])
    assert empty.find([b"a"]).tolist() == [-1]


def linked(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in sets), key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates(spark, seed):
    docs = table(spark, seed, 150)
    want = linked([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(not r[3] for r in want) > 20
    assert rows_of(hyperminhash.near_duplicates(clashing(docs)), "doc_id", "n_shingles", "component_id", "kept") == want
    copies = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    stay = {r[0] for r in want if r[3]}
    assert hyperminhash.without_copies(docs).count() == sum(n if i is None else 1 for (i, _), n in copies.items() if i in stay)


def test_without_copies_goes_by_row(spark):
    """Rows that share an id are told apart by their texts, rows that repeat one count once."""
    a, b = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight")
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, a, "x"), (2, b, "x"), (3, "", "x"), (3, " ", "x"), (3, "", "x"), (None, a, "x"), (None, a, "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in hyperminhash.without_copies(df).collect())
    assert got == {(1, a): 1, (2, b): 1, (3, ""): 1, (3, " "): 1, (None, a): 2, (4, None): 1}


def test_small_blocks(spark, monkeypatch):
    """Blocks of few members and salted leaders give the same components."""
    monkeypatch.setattr(hyperminhash, "BLOCK", 3)
    monkeypatch.setattr(hyperminhash, "DEAL", 2)
    docs = table(spark, 2, 120)
    assert rows_of(hyperminhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == linked([(r.doc_id, r.text) for r in docs.collect()])


def test_links_in_few_steps(spark, monkeypatch):
    """Links that are stars already take one step, others as many as they need."""
    written = []
    monkeypatch.setattr(components, "staged", lambda df, label: written.append(label) or staged(df, label))
    stars = spark.createDataFrame([(1, 2), (3, 1), (5, 4), (6, 6)], "a long, b long")
    assert rows_of(components.components(stars), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert len(written) == 2
    path = spark.createDataFrame([(k, k + 1) for k in random.Random(3).sample(range(40), 40)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(path).collect()} == {(k, 0) for k in range(41)}


def test_labels_stand_without_further_links(spark, monkeypatch):
    """Components are worked out once where none may be linked with another."""
    calls = []
    monkeypatch.setattr(hyperminhash, "components", lambda links: calls.append(1) or components.components(links))
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(3, text), (2, text + " end"), (7, "quite another text of some words"), (9, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(docs).collect()}
    assert got == {2: 2, 3: 2, 7: 7, 9: 9} and len(calls) == 1


def test_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (20, 100, 400, 5000):
        x = rng.integers(0, 2**64, n * 2, dtype=np.uint64)
        a, b = np.sort(x[:n]), np.sort(x[n // 10 : n + n // 10])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        (level,) = set(hyperminhash.levels(n)) & {hyperminhash.level_of(n)}
        ra, rb = (hyperminhash.registers(s, level)[None] for s in (a, b))
        assert abs((ra == rb).mean() - true) < 0.15
        one = np.array([n])
        assert hyperminhash.possible(ra, rb, one, one, np.array([level]))[0]
        far = hyperminhash.registers(np.sort(x[n:]), level)[None]
        assert not hyperminhash.possible(ra, far, one, one, np.array([level]))[0]


def test_ranges_lose_no_pair():
    """What two rows within ranges pass, the ranges pass."""
    import numpy as np

    rng = np.random.default_rng(2)
    level, seen = 8, 0
    for _ in range(60):
        base = rng.integers(0, 2**64, 700, dtype=np.uint64)
        groups = []
        for _ in range(2):
            own = base.copy()
            k = rng.integers(0, 400)
            own[:k] = rng.integers(0, 2**64, k, dtype=np.uint64)
            regs = []
            for _ in range(rng.integers(1, 6)):
                x = own.copy()
                at = rng.integers(0, 700, 60)
                x[at] = rng.integers(0, 2**64, 60, dtype=np.uint64)
                regs.append(hyperminhash.registers(np.sort(np.unique(x)), level))
            groups.append(np.stack(regs))
        a, b = groups
        any_pair = any(hyperminhash.possible(np.broadcast_to(x, b.shape), b, np.full(len(b), 700), np.full(len(b), 700), np.full(len(b), level)).any() for x in a)
        seen += any_pair
        assert hyperminhash.overlapping(a.min(0), a.max(0), b.min(0)[None], b.max(0)[None])[0] or not any_pair
    assert 0 < seen


def exact_links(rows):
    """All links of whole texts by a prefix-filtered join on exact shingle sets."""
    import numpy as np

    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {hash(tuple(w))} if 0 < len(w) < 5 else {hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)}
    df = collections.Counter(x for s in sets.values() for x in s)
    index, links = collections.defaultdict(list), []
    for i in sorted(sets, key=lambda i: len(sets[i])):
        s = sets[i]
        found = set()
        for x in sorted(s, key=lambda x: (df[x], x))[: len(s) - int(np.ceil(0.75 * len(s))) + 1]:
            found.update(index[x])
            index[x].append(i)
        for j in found:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                links.append((i, j))
    return links


def test_no_link_is_lost(spark):
    """Every link of an exact join over 10,000 documents lies inside a component, and components are no larger than the links make them."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    links = exact_links(texts)
    comp = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(rows).collect()}
    assert len(links) > 1000
    lost = sum(comp[a] != comp[b] for a, b in links)
    assert lost <= 0.001 * len(links)
    parent = {i: i for i, _ in texts}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert lost or all(comp[i] == top(i) for i in comp)


def test_mixing(docs):
    got = mixing.mix(clashing(docs)).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:  # share what is left by weight until nobody is above the cap
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        free -= over
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    assert rows_of(mixing.mix(docs.repartition(1)), "doc_id", "taken") == rows_of(mixing.mix(docs.repartition(9)), "doc_id", "taken")


def words_in(rows):
    out = {}
    for r in rows:
        out[r.doc_id, r.source] = out.get((r.doc_id, r.source), 0) + len(WORD.findall(r.text or ""))
    return {k: n for k, n in out.items() if n}


def test_materialised_mix(docs):
    """All rows, those with null and repeated ids too."""
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    got = mixing.materialise(clashing(docs)).collect()
    texts = [r.text for r in docs.collect() if r.text]
    assert all(r["size"] == "clash" and r.n_chars == len(r.text) and any(t.startswith(r.text) for t in texts) for r in got)
    assert words_in(got) == {k: n for k, n in want.items() if n}


def test_mixing_of_repeated_ids(spark):
    """Ids that repeat or are null, in rows of different and of equal texts: reruns agree, and the cut may fall among copies."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), " ".join("w" * rng.randint(1, 30)), rng.choice(["a", "b", None])) for _ in range(150)]
    rows += [(7, "one two three four five six seven", "c")] * 120 + [(8, "", "c"), (None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for parts in (1, 9):
        d = df.repartition(parts)
        m = mixing.mix(d).collect()
        assert len(m) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in m)
        for s in ("a", "b", "c", None):
            mine = [r for r in m if r.source == s]
            assert sum(r.taken for r in mine) == int(mine[0].target) or mine[0].target > sum(r.taken for r in mine) - 1e-6 > mine[0].target - 1
        out = mixing.materialise(d).collect()
        assert sum(words_in(out).values()) == sum(r.taken for r in m)
        seen.append((sorted(map(repr, m)), sorted(map(repr, out))))
    assert seen[0] == seen[1]
    assert len({r.taken for r in m if r.doc_id == 7}) > 1


def test_empty_tables(docs):
    none = docs.filter("doc_id < 0")
    for df in (suffix_dedup.removals(none), rank_sync.token_counts(none), lexicon_bpe.digests(none), hyperminhash.near_duplicates(none), mixing.mix(none), mixing.materialise(none), hyperminhash.without_copies(none), suffix_dedup.deduplicated(none)):
        assert df.count() == 0


def test_numbers_of_copies(spark):
    """Each key's rows get 0, 1, ... by their hash, however many are alike and however they lie; no window holds a key's copies."""
    rows = [("hot", 0)] * 4000 + [("hot", k) for k in range(1, 300) for _ in range(k % 4)] + [("few", k) for k in range(20)] + [("one", 7)]
    for parts in (1, 16):
        df = spark.createDataFrame(rows, "_key string, n long").repartition(parts)
        got = mixing.numbered(df, ["_key", "n"]).withColumn("hash", F.xxhash64("_key", "n")).collect()
        assert len(got) == len(rows)
        for key in ("hot", "few", "one"):
            mine = sorted((r._nth, r.hash) for r in got if r._key == key)
            assert [n for n, _ in mine] == list(range(len(mine))) and [h for _, h in mine] == sorted(h for _, h in mine)


def test_a_hundred_thousand_copies(spark, monkeypatch):
    """One row a hundred thousand times: counts are right, and the tasks that number them are alike."""
    copies = spark.range(0, 100_000, 1, 16).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one two three four five six").alias("text"), F.lit("a").alias("source"))
    others = spark.range(100, 300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.col("id").cast("string"), 7)).alias("text"), F.lit("b").alias("source"))
    docs = copies.union(others)
    per = mixing.mix(docs).groupBy("source", "taken").count().collect()
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    for s in ("a", "b"):
        assert abs(sum(r.taken * r["count"] for r in per if r.source == s) - target[s]) <= 1
    kept = hyperminhash.without_copies(docs)
    assert kept.filter("doc_id = 5").count() == 1 and kept.filter("source = 'b'").count() == 200
    seen = []
    real = mixing.staged
    monkeypatch.setattr(mixing, "staged", lambda df, label: seen.append((label, real(df, label))) or seen[-1][1])
    mixing.mix(docs).count()
    cut = [df for label, df in seen if label == "mix-cut"]
    blocks = sorted(r["count"] for r in cut[0].groupBy("_key", "_hash", "_block").count().collect())
    # a window holds what one task read, not the copies of a key
    assert len(blocks) > 1 and sum(blocks) == 100_000 and blocks[-1] <= 2 * blocks[len(blocks) // 2]
