"""Token counts by rank-synchronous array merging.

The pre-tokens of an Arrow batch lie in one ragged array of symbols.  In each
round every sequence finds its own lowest-ranked pair and merges all places of
that pair at once; a sequence leaves when it has no pair left.  The symbols
that survive are its tokens.  Where a tokenizer's merge order would make
simultaneous merging differ from the library (a part made after its whole), only
the leftmost place merges in a round.

Edge cases: a null or empty text has 0 bytes and 0 tokens; special tokens inside
a text count as one token each, as in the library; repeated rows give repeated
rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from callgrain.llm.common import slices, table
from callgrain.llm.wordbpe import WordBpe, load

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Chunks whose result a worker remembers at most; then it starts anew.
MEMO = 300_000
#: Symbols merged in one ragged array at most (a longer single piece goes alone).
SYMBOLS = 1 << 20
NEVER = 1 << 40


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def merge_ragged(bpe: WordBpe, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and the number of ids of each piece."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    if not len(pieces):
        return np.empty(0, np.int64), lengths
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sym = bpe.first[raw]
    ends = np.cumsum(lengths)
    sym[ends - 1] = bpe.last[raw[ends - 1]]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int64), lengths)
    rank = np.append(bpe.pairs.ranks(sym[:-1], sym[1:]), NEVER)
    rank[ends - 1] = NEVER
    done_sym, done_piece = [], []
    while len(sym):
        starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        size = np.diff(np.append(starts, len(sym)))
        live = np.repeat(lowest < NEVER, size)
        if not live.all():  # finished sequences leave the array
            done_sym.append(sym[~live])
            done_piece.append(piece[~live])
            sym, piece, rank = sym[live], piece[live], rank[live]
            keep = lowest < NEVER
            lowest, size = lowest[keep], size[keep]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, size))
        if not bpe.in_order:
            at = at[np.append(True, piece[at[1:]] != piece[at[:-1]])]
        # in a run of overlapping places (a a a) every second one merges, from the left
        run = np.append(True, at[1:] != at[:-1] + 1)
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[nth % 2 == 0]
        sym[at] = bpe.pairs.made[rank[at]]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        # a merged place's pair with its right neighbour, and its left neighbour's pair, are new
        new = np.cumsum(stay)[at] - 1
        last = np.append(piece[1:] != piece[:-1], True)
        last[at] = last[at + 1]
        sym, piece, rank, last = sym[stay], piece[stay], rank[stay], last[stay]
        fresh = np.unique(np.concatenate([new, np.maximum(new - 1, 0)]))
        fresh_pairs = fresh[~last[fresh]]
        rank[fresh] = NEVER
        rank[fresh_pairs] = bpe.pairs.ranks(sym[fresh_pairs], sym[fresh_pairs + 1])
    sym, piece = np.concatenate([*done_sym, sym]), np.concatenate([*done_piece, piece])
    order = np.argsort(piece, kind="stable")
    return sym[order], np.bincount(piece, minlength=len(pieces))


def blocks(pieces: list[bytes], most: int = SYMBOLS) -> Iterator[list[bytes]]:
    """Cut a list of pieces so that no block has many more symbols than ``most``."""
    block, size = [], 0
    for p in pieces:
        if block and size + len(p) > most:
            yield block
            block, size = [], 0
        block.append(p)
        size += len(p)
    if block:
        yield block


def merge_chunks(bpe: WordBpe, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks, one after the other, and where each chunk's ids end; no special tokens among them."""
    split = [bpe.pieces(c) for c in chunks]
    ids, sizes = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
    for block in blocks([p.encode() for ps in split for p in ps]):
        got, n = merge_ragged(bpe, block)
        ids.append(got)
        sizes.append(n)
    ends = np.cumsum(np.concatenate(sizes))
    return np.concatenate(ids), ends[np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]


def count_chunks(bpe: WordBpe, chunks: list[str]) -> list[int]:
    """Tokens of each chunk (special tokens: 1)."""
    counts = iter(np.diff(merge_chunks(bpe, [c for c in chunks if c not in bpe.special])[1], prepend=0).tolist())
    return [1 if c in bpe.special else next(counts) for c in chunks]


def count_batches(path: str, limit: int):
    """``mapInArrow`` function over ``doc_id, text``."""

    def run(batches):
        bpe, memo = load(path), {}
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if len(memo) > MEMO:
                memo.clear()
            counts, sizes = [], []
            for at in range(0, len(texts), 256):  # texts whose chunks are held at once
                split = [bpe.chunks(t) if t else [] for t in texts[at : at + 256]]
                new = list(set().union(*split).difference(memo))
                memo.update(zip(new, count_chunks(bpe, new), strict=True))
                counts += [sum(map(memo.__getitem__, c)) for c in split]
                sizes += [len(t.encode()) if t else 0 for t in texts[at : at + 256]]
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), n, pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``; one pass, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count_batches(path or tokenizer_path(), limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE_SQL: dict[str, str] = {}
