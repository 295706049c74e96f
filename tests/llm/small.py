"""A small table with the awkward rows: nulls, empty and long texts, copies, repeated rows, clashing extra columns."""

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0D]+")


def table(spark, seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base, passage = text(120), text(130)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "a b c"), (6, "A B\tc"), (7, base), (8, base), (9, base.upper()), (10, "x" * 3000), (11, "ab " * 2000)]
    for i in range(12, n):
        kind = rng.random()
        if kind < 0.3:
            words = base.split(" ")
            for _ in range(rng.randint(0, 12)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
        elif kind < 0.5:
            rows.append((i, text(rng.randint(1, 60)) + "\n" + passage + "\n" + text(rng.randint(1, 60))))
        elif kind < 0.6:
            rows.append((i, rows[-1][1]))
        else:
            rows.append((i, text(rng.randint(1, 300)) + rng.choice(["", ".", "<|endoftext|>", "　é", " 'S 12!?"])))
    rows += [rows[20], (None, base), (n, text(6000))]
    out = [(i, t, rng.choice(["en", None]), rng.choice(["a", "a", "a", "b", "é", None]), None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(out, SCHEMA).repartition(5)


def clashing(df):
    """Columns whose names operators use inside."""
    for c in ("size", "n", "key", "rep", "taken", "score", "spans", "h1", "word", "path", "license"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
