"""A training corpus in five stages; each works on what the one before it kept.

Toxic documents go, one document of each group of near copies stays, repeated passages
are cut, sources are mixed to their targets, and the texts are encoded.

Each case below holds for every stage that it names; the operators state the rest.

* Null or empty texts: not toxic, in no group, without passages, of size 0 in the mix (so
  they leave the corpus there).
* Null ids: never toxic by label, in no group, told apart by their texts in the mix.
* Repeated rows: a row that repeats id and text goes with its copies in ``near_copies``.
* Ties: of a group the least doc_id stays; the order of the mix is a hash of id, text and source.
* Very long texts: read whole by every stage.
* An empty table, and a stage that leaves no rows, give no rows.
* Further columns, of whatever name, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callgrain.llm.common import mark, staged, sweep, table
from callgrain.llm.hyperminhash import without_copies
from callgrain.llm.lexicon_bpe import digests
from callgrain.llm.mixing import materialise
from callgrain.llm.suffix_dedup import PASSAGE_ANCHOR, PASSAGE_BYTES, PASSAGE_WORDS, deduplicated
from callgrain.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, fitted on ``docs`` and the labels table, does not predict toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies."""
    return without_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; each run of ``PASSAGE_WORDS`` words or more whose strings stand elsewhere too is cut from the text."""
    return deduplicated(docs, PASSAGE_BYTES, PASSAGE_ANCHOR, PASSAGE_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them; its words are the mix's words."""
    return materialise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    return digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The trained and iterative stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = mark()
        docs = staged(stage(spark, docs, sf_dir), name)
        sweep(spark, since, docs)  # what the stage wrote on its way
    return docs
