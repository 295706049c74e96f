"""Secrets: fixed shapes against plain loops, planted keys, and strings that are none."""

import base64
import hashlib
import random
import re
import secrets
import string
import uuid

import pytest
from llm.small import clashing, table

from callgrain.llm import secret_scan as s

SF = "/root/testdata/sf0.001"
LETTERS = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def scanner():
    return s.Scanner(s.vocabulary_path())


def brute_base(text):
    """The fixed shapes, each character tried as a start."""
    found = []
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")

    def run(i, allowed):
        while i < len(text) and text[i] in allowed:
            i += 1
        return i

    value = set(LETTERS + "+/_.=-")
    i = 0
    while i < len(text):
        hit = None
        for name in names:
            if text[i : i + len(name)].isascii() and text[i : i + len(name)].lower() == name:
                j = i + len(name)
                j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
                j = run(j, " ")
                if text[j : j + 1] in (":", "="):
                    j = run(j + 1, " ")
                    j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
                    if (end := run(j, value)) > j:
                        hit = (i, 0, end, end - j)
        if hit:
            found += [hit[:3]] if hit[3] >= 12 else []
            i = hit[2]
        else:
            i += 1
    for kind, start, allowed, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 18), (2, "", set("0123456789abcdef"), 16)):
        i = 0
        while i < len(text):
            end = run(i + len(start), allowed) if text.startswith(start, i) else i
            if end > i + len(start):
                found += [(i, kind, end)] if end - i >= least else []
                i = end
            else:
                i += 1
    return sorted(found)


def test_fixed_shapes_are_the_brute_force_ones(scanner):
    rng = random.Random(1)
    parts = ["password", "Passwd", "SECRET", "ſecret", "token", "toKen", "api_key", "ApiKey", "api", '"', "'", " ", "  ", ":", "=", "\t", "AKIA", "ABCDEFGHIJKLMN", "0123456789ABCDEF", "deadbeef", "0123456789abcdef", "xyz+/_.=-", "é", "\n", "😀", "abcdefghijkl", "abc"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [x for x in scanner(text) if x[1] < 3] == brute_base(text), text


def found_in(scanner, text):
    return [text[a:b] for a, k, b in scanner(text) if k == 3]


def test_random_keys_are_found(scanner):
    rng = random.Random(2)
    for make, share in ((lambda: "".join(rng.choice(LETTERS) for _ in range(24)), 0.98), (lambda: base64.b64encode(rng.randbytes(30)).decode(), 0.98), (lambda: base64.urlsafe_b64encode(rng.randbytes(48)).decode(), 0.99)):
        hit = 0
        for _ in range(300):
            key = make()
            text = f"é 😀 said ({key}) here"
            hit += found_in(scanner, text) == [key] or "".join(found_in(scanner, text)).count(key[:8]) > 0
        assert hit / 300 > share
    key = "q7Zt0XbV93mKpR2sWd8uYc4L"
    assert found_in(scanner, f"https://host.example/v1/{key}/list?id=3") == [key]
    assert found_in(scanner, f"session={key}") == [key]


def test_digests_and_identifiers_are_left_alone(scanner):
    plain = [
        hashlib.sha256(b"x").hexdigest().upper(), hashlib.md5(b"x").hexdigest().upper(), "sha256-" + base64.b64encode(hashlib.sha256(b"x").digest()).decode(), str(uuid.UUID(int=7**30)).upper(),
        "getElementByIdentifier", "AbstractSingletonProxyFactoryBean", "spark.sql.shuffle.partitions", "my_long_variable_name_here_2", "SOME_CONSTANT_VALUE_NAME", "src/main/java/org/apache/Main.java",
        "Donaudampfschifffahrtsgesellschaft", "antidisestablishmentarianism", "2024-01-31T10:20:30.123456", "undenkeitschheiterbeverzu", "123456789-123456789-123456789", "user.name@mail0.example.com",
    ]
    for x in plain:
        assert found_in(scanner, f"see {x} there") == [], x
    key = "q7Zt0XbV93mKpR2sWd8uYc4L"
    assert found_in(scanner, key) == [key] and found_in(s.Scanner(s.vocabulary_path(), frozenset([key])), f"a {key} b") == []
    # what a fixed shape has is no second span
    assert [x[1] for x in scanner(f'token = "{key}"')] == [0]


def test_long_texts_in_pieces(scanner):
    rng = random.Random(3)
    blob = "".join(rng.choice(LETTERS) for _ in range(200_000))
    assert found_in(scanner, "a " + blob + " b") == [blob]
    assert scanner("x" * 1_000_000) == [] and scanner("word " * 100_000) == []


def line(spans):
    return ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query(spark, scanner):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, s.op12_secret_scan(spark, SF).collect()))
    want = []
    for r in docs.collect():
        spans = scanner(r.text)
        base = brute_base(r.text or "")
        assert [x for x in spans if x[1] < 3] == base
        want.append((r.doc_id, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(line(base).encode()).hexdigest(), line(spans), sum(x[1] == 3 for x in spans)))
    assert got == sorted(want) and sum(w[3] for w in want) > 0


def test_edges_and_redaction(spark):
    key = secrets.token_urlsafe(48)
    rows = [(900, f'é token = "{key}" and 0123456789abcdef0 end', None, None, None), (900, f"x {key} y", None, None, None), (None, None, None, None, None), (901, "", None, None, None)]
    docs = table(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    found = s.summary(s.scan(clashing(docs)))
    assert found.count() == docs.count() and found.filter("spans IS NULL OR n_hex IS NULL").count() == 0
    assert {r.n_assign for r in found.filter("doc_id = 900").collect()} == {0, 1}
    empty = found.filter("doc_id = 901").first()
    assert empty.spans == "" and empty.base_sha256 == hashlib.sha256(b"").hexdigest()
    out = s.redacted(clashing(docs))
    assert out.columns == clashing(docs).columns and out.count() == docs.count()
    texts = [r.text for r in out.filter("doc_id = 900").collect()]
    assert not any(key in t for t in texts) and any(re.fullmatch(r"é <assign>\" and <hex> end", t) for t in texts)
    assert out.filter("text IS NULL").count() == docs.filter("text IS NULL").count()
    assert s.summary(s.scan(docs.filter("doc_id < 0"))).count() == 0
