"""Secrets in texts: three fixed shapes, and random strings by their token efficiency.

A vocabulary learnt from text takes several characters of a word at once, but hardly more
than one of a random key.  So a string of ``LEAST`` or more key characters whose characters
a token are below ``RATIO`` under a tiktoken vocabulary is a span of kind ``token``.

Of 3,000 generated keys of 24 letters and digits 99.9 % have fewer than 1.75 characters a
token there (half of them 1.33), of those of 20 characters 99 %; names joined from English
words have 2.4 and more, long words of invented syllables 1.6 and more (such words of one
case are identifiers).

Not looked at, as they are random by nature and no secrets:

* digests: hexadecimal strings of exactly the length of an MD5, SHA-1, SHA-2 or SHA-3 digest,
  of one case, and ``shaNNN-`` integrity values in Base64;
* identifiers: UUIDs, numbers, dates and times, words of one case or with a capital first
  letter, and names joined from such words and numbers by ``_ - . / = +`` or by capitals;
* strings that the caller names as known;
* what a fixed shape found already.

Kinds in the order of the contract: ``assign`` (a value of 12 or more characters assigned to
a name like password), ``access`` (AKIA and 18 or more characters), ``hex`` (16 or more
characters of 0-9a-f), then ``token``.  Spans are in code points, end exclusive.

Edge cases: a null or empty text has no spans; null and repeated ids and repeated rows give a
row each; a text of any length is scanned whole (long strings are tokenised in pieces of
``PIECE`` characters, as no token is looked for across them); an empty table gives no rows;
further columns are ignored by ``scan`` and kept by ``redacted``.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm.common import slices, table

KINDS = ("assign", "access", "hex", "token")
#: Least characters of a random string, and the characters a token below which it is one.
LEAST, RATIO = 20, 1.75
PIECE = 512

#: The shapes of the contract.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("passw", "secret", "token", "api")

_RUN = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_INTEGRITY = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+=*\Z")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\Z")
#: A part of a name: a number, a word of one case or with a capital, a capitalised abbreviation; a digit or two may follow.
_PART = r"(?:[0-9]+|[A-Z]?[a-z]{2,}[0-9]{0,2}|[A-Z]{2,}[0-9]{0,2}|[a-z][0-9]{0,2})"
_NAME = re.compile(rf"[+/_=.-]*{_PART}(?:[+/_=.-]+{_PART})*[+/_=.-]*\Z")
#: Joined by capitals: at least three letters a word, so that random letters seldom fit.
_CAMEL = re.compile(r"[a-z]{3,}(?:[A-Z][a-z]{2,})+[0-9]{0,2}\Z|(?:[A-Z][a-z]{2,})+[0-9]{0,2}\Z")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """A tiktoken vocabulary file as an encoding without special tokens, once a worker process."""
    import tiktoken  # only workers need it

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def harmless(s: str) -> bool:
    """A digest or an identifier."""
    return bool(len(s) in _DIGEST_LENGTHS and _DIGEST.match(s) or _UUID.match(s) or _INTEGRITY.match(s) or _NAME.match(s) or _CAMEL.match(s))


class Scanner:
    """Spans of one text; ``known`` are strings that are no secrets."""

    def __init__(self, path: str, known: frozenset[str] = frozenset(), least: int = LEAST, ratio: float = RATIO):
        self.encoding, self.known, self.least, self.ratio = encoding(path, public_tokenizers.PATTERN), known, least, ratio

    def characters_a_token(self, s: str) -> float:
        tokens = sum(len(self.encoding.encode_ordinary(s[i : i + PIECE])) for i in range(0, len(s), PIECE))
        return len(s) / tokens

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """Start, number of the kind, end of the fixed shapes."""
        found = []
        lower = text.lower()
        if any(name in lower for name in _NAMES):
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return found

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """All spans by start, then kind."""
        if not text:
            return []
        longest = max(map(len, text.split()), default=0)
        found = self.base(text) if longest >= 12 else []
        if longest >= self.least:
            taken = sorted((a, b) for a, _, b in found)
            starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
            for m in _RUN.finditer(text):
                for a, b in self.random_parts(m[0], m.start()):
                    before = bisect_left(starts, b)  # fixed shapes that begin before the end
                    if not before or ends[before - 1] <= a:
                        found.append((a, 3, b))
        return sorted(found)

    def random(self, s: str) -> bool:
        return len(s) >= self.least and s not in self.known and not harmless(s) and self.characters_a_token(s) < self.ratio

    def random_parts(self, run: str, start: int):
        """Start and end of the random strings of a run: its parts between dots and assignments, in a path those between slashes."""
        if run in self.known or harmless(run):
            return
        for m in re.finditer(r"[^.=]+={0,2}", run):
            pieces = list(re.finditer(r"[^/]+", m[0]))
            path = len(pieces) > 1 and any(len(p[0]) >= 4 and harmless(p[0]) for p in pieces)  # Base64 has slashes too, but no words between them
            for p in pieces if path else [re.match(r"(?s).*", m[0])]:
                if self.random(p[0]):
                    yield start + m.start() + p.start(), start + m.start() + p.end()


def _scan(path: str, known: frozenset[str], column: int):
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        scanner = Scanner(path, known)
        for batch in slices(batches):
            found = [[{"kind": k, "start": a, "stop": b} for a, k, b in scanner(t)] for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != column), pa.array(found, kind)], [*(n for i, n in enumerate(batch.schema.names) if i != column), "_spans"])

    return run


def scan(docs: DataFrame, path: str | None = None, known=()) -> DataFrame:
    """``doc_id, spans`` of every row: an array of ``kind`` (place in ``KINDS``), ``start``, ``stop``, by start and kind.

    path: a tiktoken vocabulary file; known: strings that are no secrets, few enough to be sent with the tasks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind: int, start: bigint, stop: bigint>>"
    return docs.select("doc_id", "text").mapInArrow(_scan(path or vocabulary_path(), frozenset(known), 1), f"doc_id {kind}, _spans {spans}").withColumnRenamed("_spans", "spans")


def _redact(path: str, known: frozenset[str], column: int, mark: str):
    def run(batches):
        scanner = Scanner(path, known)
        for batch in slices(batches):
            texts = []
            for t in batch.column(column).to_pylist():
                parts, done = [], 0
                for a, k, b in scanner(t):
                    if b > done:
                        if a >= done:
                            parts += [t[done:a], mark.format(KINDS[k])]
                        done = b
                texts.append("".join([*parts, t[done:]]) if parts else t)
            yield batch.set_column(column, batch.schema.field(column), pa.array(texts, batch.schema.field(column).type))

    return run


def redacted(docs: DataFrame, path: str | None = None, known=(), mark: str = "<{}>") -> DataFrame:
    """The rows of ``docs`` with each run of spans that overlap replaced by its first kind."""
    return docs.mapInArrow(_redact(path or vocabulary_path(), frozenset(known), docs.columns.index("text"), mark), docs.schema)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token`` of the rows of :func:`scan`."""

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = _joined(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", *map(count, range(3)), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count(3))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scan(table(spark, sf_dir, "documents")))


QUERIES = {"op12_secret_scan": op12_secret_scan}
ORACLE_SQL: dict[str, str] = {}
