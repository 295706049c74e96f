"""Exact percentiles by distributed selection, for tables and groups of any size.

A percentile interpolates between two order statistics.  For each of them the table keeps
the range of values that holds its rank, and how many values lie below.  A round cuts each
range into ``SLICES`` slices, counts the values of each slice (with their least and
greatest), adds the counts up slice by slice, and goes on with the one slice that holds the
rank.  No buffer holds a group's values: a range gives at most ``SLICES`` counts, and the
rows that are looked at shrink with every round.

The first round cuts by magnitude, so that values of all sizes part, the others evenly
between the least and the greatest value of the range, which halves it some 12 times; so
seven rounds reach single values of any doubles.  Once all open ranges hold no more than
``FEW`` rows together, their values are counted one by one.

Nulls and NaN take no part; infinite values count as the largest finite ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.sources.scratch import folder

SLICES = 4096
FEW = 200_000
#: Rounds that suffice: one by magnitude, five for 52 bits by 12, and one to spare.
ROUNDS = 8
BROADCAST_ROWS = 200_000
_LARGEST = 1.7976931348623157e308
_SMALLEST = 1e-300


def _written(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _magnitude(x: Column) -> Column:
    """Grows with ``x``; even steps are even ratios."""
    return F.signum(x) * (F.ln(F.greatest(F.abs(x), F.lit(_SMALLEST))) + 691)


def _slice(x: Column, low: Column, high: Column, slices: int) -> Column:
    """Slice of ``x`` in its range; the ends of the range lie in the first and the last one."""
    # the width of a range may be no double: halves of large ends, multiples of small ones
    unit = F.when((F.abs(low) < 1) & (F.abs(high) < 1), F.lit(2.0**900)).otherwise(F.lit(0.5))
    share = F.try_divide(x * unit - low * unit, high * unit - low * unit)
    return F.least(F.lit(slices - 1), F.floor(F.coalesce(share, F.lit(0.0)) * slices)).cast("int")


def _same(names: list[str]) -> Column:
    """Equal groups of both sides; null is a group."""
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return on


def order_statistics(rows: DataFrame, by: list[str], state: DataFrame, groups: int, size: int, few: int = FEW, slices: int = SLICES) -> DataFrame:
    """``state`` with ``value`` instead of its range: the value of ``rank`` (from 0) in the group of ``rows`` (``by``, ``_x``).

    ``state`` has ``by``, ``rank``, ``low``, ``high``, ``below`` and further columns: ``below`` values of
    the group are less than ``low``, the one of the rank is between ``low`` and ``high``.  It comes
    with one range a group; ``groups`` and ``size`` are the numbers of groups and of rows.
    """
    kept = [c for c in state.columns if c not in ("low", "high", "below")]
    keys = [*by, "low"]
    found = None
    for number in range(ROUNDS):
        settled = state.filter("low = high").select(*kept, F.col("low").alias("value"))
        found = settled if found is None else found.unionByName(settled)
        state = state.filter("low < high")
        ranges = state.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
        many = ranges.count() if number else groups
        if not many:
            return found
        ranges = F.broadcast(ranges) if many <= BROADCAST_ROWS else ranges
        inside = rows.join(ranges, _same(by) & F.col("_x").between(F.col("_low"), F.col("_high")))
        inside = inside.select(*by, F.col("_low").alias("low"), F.col("_high").alias("high"), "_x")
        ends = (F.col("_x"), F.col("low"), F.col("high"))
        place = _slice(*ends, slices) if number else _slice(*map(_magnitude, ends), slices)
        rank = [F.count("*").alias("rows"), F.min("_x").alias("least"), F.max("_x").alias("most")]
        counts = None
        if number or size > few:
            counts = _written(inside.groupBy(*keys, place.alias("slice")).agg(*rank))
            size = counts.agg(F.sum("rows")).first()[0]
        last = size <= few
        if last:  # value by value
            counts = inside.groupBy(*keys, F.col("_x").alias("slice")).agg(*rank)
        before = F.sum("rows").over(Window.partitionBy(*keys).orderBy("slice")) - F.col("rows")  # a row a slice
        counts = counts.select(*(F.col(c).alias(f"_{c}") for c in keys), "rows", "least", "most", before.alias("before"))
        start = F.col("below") + F.col("before")
        held = state.join(counts, _same(keys) & (F.col("rank") >= start) & (F.col("rank") < start + F.col("rows")))
        if last:
            return found.unionByName(held.select(*kept, F.col("least").alias("value")))
        state = _written(held.select(*kept, F.col("least").alias("low"), F.col("most").alias("high"), start.alias("below")))
    raise AssertionError("after these rounds each range of doubles is one value")


def quantiles(df: DataFrame, column: str, shares: list[float], *by: str, few: int = FEW, slices: int = SLICES) -> DataFrame:
    """``by, n, least, most, q0, q1, ...``: a row a group with the percentiles of ``column`` for ``shares`` as doubles.

    A percentile lies between the values at both ranks around ``share * (n - 1)``, in
    proportion.  Groups without a value have no row.  The column is written once, slim, as
    it is read in every round.
    """
    x = F.col(column).cast("double")
    x = F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST))
    rows = _written(df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(*by, x.alias("_x")))
    groups = _written(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_x").alias("least"), F.max("_x").alias("most")).filter("n > 0"))
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ends = F.array(*[F.struct(F.lit(2 * k + side).alias("end"), f(p).cast("long").alias("rank")) for k, p in enumerate(at) for side, f in enumerate((F.floor, F.ceil))])
    state = groups.select(*by, F.explode(ends).alias("e"), F.col("least").alias("low"), F.col("most").alias("high"), F.lit(0).cast("long").alias("below"))
    many, size = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = order_statistics(rows, list(by), state.select(*by, "e.end", "e.rank", "low", "high", "below"), many, size, few, slices)
    values = found.groupBy(*by).agg(*[F.max(F.when(F.col("end") == k, F.col("value"))).alias(f"v{k}") for k in range(2 * len(shares))])
    values = values.select(*(F.col(c).alias(f"_{c}") for c in by), *(f"v{k}" for k in range(2 * len(shares))))
    both = groups.join(values, _same(list(by))) if by else groups.crossJoin(values)  # one row each

    def between(k: int) -> Column:
        over = at[k] - F.floor(at[k])
        return (F.when(over == 0, F.col(f"v{2 * k}")).otherwise((1 - over) * F.col(f"v{2 * k}") + over * F.col(f"v{2 * k + 1}"))).alias(f"q{k}")

    return both.select(*by, "n", "least", "most", *map(between, range(len(shares))))
