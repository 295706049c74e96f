"""BPE encoding and decoding with a transducer lexicon.

The corpus' frequent chunks (runs without white space) are compiled into a
minimal acyclic transducer: words share prefixes and suffixes, the outputs along
a path add up to the word's number, and that number points at its token ids.
The automaton and the probe table of its edges are one file in the shared folder, which
each executor fetches once and its workers map; a batch's distinct chunks walk it side by
side, and chunks it does not hold are merged exactly.  The lexicon changes only
the speed, never an id.

Frequent chunks are found over all texts by lossy counting: a worker drops, each
time its table is full, what it has seen fewer than ``SEEN`` times, so a chunk
can be missed only if it is rare everywhere.  The lexicon has at most ``WORDS``
chunks of at most ``LONGEST`` bytes, which bounds what is sent to the workers.

Edge cases: a null or empty text has no ids and decodes to an empty text; special
tokens inside a text keep their ids; repeated rows give repeated rows; an empty
table gives an empty lexicon and no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm.common import shared_dir, slices, staged, table
from callgrain.llm.rank_sync import MEMO, merge_chunks, tokenizer_path
from callgrain.llm.wordbpe import PairTable, WordBpe, load

WORDS = 65_536
LONGEST = 64
TABLE = 200_000
SEEN = 4


def build(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of sorted distinct words; state 0 is the start.

    Built word by word: when the next word leaves a path, the states below the
    fork are final and are replaced by an equal state if one is known.
    """
    known: dict = {}
    states: list = []  # (is word end, ((byte, state), ...), words below)

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append((*key, node[0] + sum(states[t][2] for _, t in node[1])))
        return known[key]

    path = [[0, []]]
    before = b""
    for word in words:
        fork = len(os.path.commonprefix([before, word]))
        for depth in range(len(before), fork, -1):
            path[depth - 1][1].append((before[depth - 1], settle(path.pop())))
        path += [[0, []] for _ in range(len(word) - fork)]
        path[-1][0] = 1
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1][1].append((before[depth - 1], settle(path.pop())))
    start = settle(path[0])
    keys, target, output = [], [], []
    for s, (end, edges, _) in enumerate(states):
        passed = end
        for byte, t in edges:
            keys.append(s << 8 | byte)
            target.append(t)
            output.append(passed)
            passed += states[t][2]
    flat = [i for x in ids for i in x]
    probe = PairTable(np.array(keys, np.int64), np.array(target, np.int64))
    return {
        "slots": probe.keys, "edge": probe.rank, "target": np.array(target, np.int32), "output": np.array(output, np.int32), "end": np.array([s[0] for s in states], np.int8),
        "start": np.array([start], np.int32), "offset": np.cumsum([0, *map(len, ids)]).astype(np.int32), "ids": np.array(flat, np.int32),
    }


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One block of bytes: a header line of names, types and lengths, then the arrays, each on a multiple of 8."""
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode() + b"\n"
    parts = [head.ljust(-(-len(head) // 8) * 8, b"\0")]
    parts += [a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in arrays.values()]
    return b"".join(parts)


class Lexicon:
    """A packed transducer, memory-mapped: all of its arrays lie in the file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = self.map[: self.map.find(b"\n")].decode()
        at = -(-(len(head) + 1) // 8) * 8
        for part in head.split(";"):
            name, kind, n = part.split(",")
            array = np.frombuffer(self.map, np.dtype(kind), int(n), at)
            setattr(self, name, array)
            at += -(-array.nbytes // 8) * 8
        self.edges = PairTable.over(self.slots, self.edge)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where the lexicon does not hold it; all words step together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lengths) - lengths
        at, state, number = np.arange(n), np.full(n, int(self.start[0]), np.int64), np.zeros(n, np.int64)
        for depth in range(LONGEST + 1):
            over = lengths[at] == depth
            ended = at[over]
            out[ended] = np.where(self.end[state[over]] == 1, number[over], -1)
            at, state, number = at[~over], state[~over], number[~over]
            if not len(at):
                break
            edge = self.edges.find(state << 8 | raw[first[at] + depth])
            on = edge < len(self.target)
            at, edge, number = at[on], edge[on], number[on]
            state, number = self.target[edge].astype(np.int64), number + self.output[edge]
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.offset[number] : self.offset[number + 1]].tolist()


@lru_cache(maxsize=2)
def mapped(path: str) -> Lexicon:
    """One mapping a worker process; the pages are the executor's."""
    return Lexicon(path)


def ship(spark: SparkSession, packed: bytes) -> str:
    """Write the block to the shared folder, from where each executor fetches it once; returns its name, which follows from its content."""
    name = f"lexicon-{hashlib.sha256(packed).hexdigest()[:32]}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        part = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/.{name}-{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(packed))
        out.close()
        fs.rename(part, path)
    known = {f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}
    if name not in known:
        spark.sparkContext.addFile(str(path.toString()))
    return name


def merged_ids(bpe: WordBpe, chunks: list[str]) -> list[list[int]]:
    """Ids of each chunk by exact merging."""
    ids, ends = merge_chunks(bpe, [c for c in chunks if c not in bpe.special])
    ids, cuts = ids.tolist(), iter(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False))
    out = []
    for c in chunks:
        if c in bpe.special:
            out.append([bpe.special[c]])
        else:
            a, b = next(cuts)
            out.append(ids[a:b])
    return out


class Encoder:
    """Encodes and decodes texts; remembers at most ``MEMO`` chunks' results."""

    def __init__(self, path: str, shipped: str):
        self.bpe, self.lexicon = load(path), mapped(SparkFiles.get(shipped))
        self.memo: dict[str, tuple[str, str]] = {}
        most = max(self.bpe.tokens) + 1
        self.decimal = [str(i) for i in range(most)]
        self.token = [self.bpe.tokens.get(i, "") for i in range(most)]

    def learn(self, chunks: list[str]) -> None:
        numbers = self.lexicon.find([c.encode() for c in chunks]).tolist() if chunks else []
        rest = [c for c, n in zip(chunks, numbers, strict=True) if n < 0]
        exact = iter(merged_ids(self.bpe, rest))
        decimal, token, memo = self.decimal.__getitem__, self.token.__getitem__, self.memo
        for c, n in zip(chunks, numbers, strict=True):
            ids = next(exact) if n < 0 else self.lexicon.ids_of(n)
            memo[c] = " ".join(map(decimal, ids)), " ".join(map(token, ids))

    def batch(self, texts: list[str | None]):
        """``(decimal ids, decoded text)`` of each text."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        for at in range(0, len(texts), 256):
            split = [self.bpe.chunks(t) if t else [] for t in texts[at : at + 256]]
            self.learn(list(set().union(*split).difference(self.memo)))
            for chunks in split:
                got = list(map(self.memo.__getitem__, chunks))
                yield " ".join([x[0] for x in got]), " ".join([x[1] for x in got])

    def decode(self, ids: list[int]) -> str:
        """The library joins tokens with spaces, as the tokenizer file names no decoder."""
        return " ".join(map(self.bpe.tokens.__getitem__, ids))


def _count(path: str):
    def run(batches):
        bpe, seen = load(path), Counter()

        def out(least: int):
            kept = [(w, n) for w, n in seen.items() if n >= least and len(w.encode()) <= LONGEST and w not in bpe.special]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(bpe.chunks(text))
                    if len(seen) > TABLE:
                        yield out(SEEN)
                        seen.clear()
        yield out(SEEN)

    return run


def lexicon(docs: DataFrame, path: str, words: int = WORDS) -> bytes:
    """The packed transducer of the corpus' most frequent chunks, ``words`` at most.

    Chunks are counted by eighths of powers of two; the least step that keeps within
    ``words`` is the cut, so the driver gets no more than that, from however many tasks.
    """
    counted = docs.select("text").mapInArrow(_count(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = staged(counted.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "chunks")
    least, total = None, 0
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):  # at most 8 * 63 rows
        total += r["count"]
        if total > words:
            break
        least = r.step
    found = [] if least is None else sorted((r.word for r in counted.filter(F.col("step") >= least).select("word").collect()), key=str.encode)
    return pack(build([w.encode() for w in found], merged_ids(load(path), found)))


def encode(docs: DataFrame, path: str | None = None, words: int = WORDS) -> DataFrame:
    """``doc_id, ids array<int>`` for every row."""
    path = path or tokenizer_path()
    shipped = ship(docs.sparkSession, lexicon(docs, path, words))

    def run(batches):
        enc = Encoder(path, shipped)
        for batch in slices(batches):
            rows = [list(map(int, ids.split())) for ids, _ in enc.batch(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` for rows of ``doc_id, ids``; null ids decode to an empty text."""
    path = path or tokenizer_path()

    def run(batches):
        tokens = load(path).tokens
        for batch in slices(batches):
            rows = [" ".join(map(tokens.__getitem__, ids or [])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None, words: int = WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``; ids never leave the worker."""
    path = path or tokenizer_path()
    shipped = ship(docs.sparkSession, lexicon(docs, path, words))

    def run(batches):
        enc = Encoder(path, shipped)
        for batch in slices(batches):
            n, a, b = [], [], []
            for ids, text in enc.batch(batch.column(1).to_pylist()):
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_lexicon_bpe": op7_lexicon_bpe}
ORACLE_SQL: dict[str, str] = {}
