"""Exact linear-interpolation quantiles by radix selection.

Each value has an order-preserving 64-bit key. A pass counts, per group, the
values that share the digits found so far of a wanted rank by their next 16
bits, and finds the digit that holds the rank; after four passes the key, and
with it the order statistic, is known. Values are counted where they lie: they
are neither sorted nor exchanged, only counts are, and at most 65,536 counts of
a group and prefix meet in a task, however many rows the group has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import materialize

_DIGIT, _DIGITS = 16, 4
_BIAS, _MANTISSA = 1023, 52
_LEAST_NORMAL = 2.0**-1022
_INFINITE = 0x7FF << _MANTISSA  # bits of the infinite value; NaN is the next key and sorts behind it


def order_key(value: Column) -> Column:
    """A long in the order of a double: the bits of its size, negated for negative numbers. Both zeros are one."""
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")
    power = F.pow(F.lit(2.0), guess.cast("double"))
    # the logarithm may be rounded over a power of two
    exponent = F.when(power > size, guess - 1).when(power * 2 <= size, guess + 1).otherwise(guess)
    fraction = size / F.pow(F.lit(2.0), exponent.cast("double")) - 1
    normal = (exponent + _BIAS).cast("bigint") * (1 << _MANTISSA) + (fraction * float(1 << _MANTISSA)).cast("bigint")
    tiny = (size * 2.0**537 * 2.0**537).cast("bigint")
    bits = F.when(size < _LEAST_NORMAL, tiny).when(size == float("inf"), F.lit(_INFINITE)).otherwise(normal)
    return F.when(F.isnan(value), F.lit(_INFINITE + 1)).when(value < 0, -bits).otherwise(bits)


def key_value(key: Column) -> Column:
    """The double of an order key."""
    bits = F.abs(key)
    exponent = F.shiftright(bits, _MANTISSA).cast("int")
    fraction = (bits.bitwiseAND((1 << _MANTISSA) - 1)).cast("double") / float(1 << _MANTISSA)
    normal = (fraction + 1) * F.pow(F.lit(2.0), (exponent - _BIAS).cast("double"))
    tiny = bits.cast("double") * 2.0**-537 * 2.0**-537
    size = F.when(bits > _INFINITE, F.lit(float("nan"))).when(bits == _INFINITE, F.lit(float("inf"))).when(exponent == 0, tiny).otherwise(normal)
    return F.when(key < 0, -size).otherwise(size)


def _matches(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``right`` with its ``cols`` renamed, and the null-safe condition that they equal ``left``'s."""
    renamed = right.withColumnsRenamed({c: f"_of_{c}" for c in cols})
    return renamed, [left[c].eqNullSafe(renamed[f"_of_{c}"]) for c in cols]


def _narrow(values: DataFrame, wanted: DataFrame | None, by: Sequence[str], step: int) -> DataFrame:
    """Counts of the next digit, with those before it: by, prefix, digit, first, n, total."""
    shift = _DIGIT * (_DIGITS - step)
    digit = F.shiftright("key", shift)
    if wanted is None:
        found = values.select(*by, F.lit(0).cast("bigint").alias("prefix"), digit.alias("digit"))
    else:
        prefixes, same = _matches(values, wanted.select(*by, "prefix").distinct(), by)
        same.append(F.shiftright(values["key"], shift + _DIGIT) == prefixes["prefix"])
        found = values.join(prefixes, same).select(*[values[c] for c in by], prefixes["prefix"], digit.alias("digit"))
    counts = found.groupBy(*by, "prefix", "digit").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by, "prefix")
    before = whole.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(whole)})


def quantile_table(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of ``col`` per group, in columns ``q0``, ``q1``, ...

    ``df`` is read four times, so it should be a written table. A group without
    values has no row.
    """
    value = F.col(col).cast("double")
    values = df.where(value.isNotNull()).select(*by, order_key(value).alias("key"))

    def has_rank(rank: Column) -> Column:
        return (F.col("first") <= rank) & (rank < F.col("first") + F.col("n"))

    def place(p: float, total: Column) -> Column:
        return F.lit(float(p)) * (total - 1)

    ranks = []
    for i, p in enumerate(probs):
        for name, turn in ((f"lo{i}", F.floor), (f"hi{i}", F.ceil)):
            ranks.append(F.struct(F.lit(name).alias("name"), turn(place(p, F.col("total"))).cast("bigint").alias("rank")))
    cells = _narrow(values, None, by, 1).withColumn("w", F.explode(F.array(*ranks)))
    state = cells.where(has_rank(F.col("w.rank")))
    state = state.select(*by, F.col("total").alias("size"), "w.name", (F.col("w.rank") - F.col("first")).alias("rank"), F.col("digit").alias("prefix"))
    for step in range(2, _DIGITS + 1):
        state = materialize(state, "ranks")  # a few rows per group
        cells, same = _matches(state, _narrow(values, state, by, step), [*by, "prefix"])
        state = state.join(cells, same).where(has_rank(state["rank"]))
        state = state.select(*[state[c] for c in by], "size", "name", (state["rank"] - F.col("first")).alias("rank"), F.col("digit").alias("prefix"))

    # the value is worked out before it is asked for by name: its expression is long, and there may be many names
    found = state.withColumn("value", key_value(F.col("prefix"))).groupBy(*by).agg(
        F.max("size").alias("size"),
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for i in range(len(probs)) for n in (f"lo{i}", f"hi{i}")],
    )
    cols = []
    for i, p in enumerate(probs):
        at, lo, hi = place(p, F.col("size")), F.col(f"lo{i}"), F.col(f"hi{i}")
        between = (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi
        cols.append(F.when(lo == hi, lo).otherwise(between).alias(f"q{i}"))
    return found.select(*by, *cols)


def quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float]]:
    """Quantiles of several columns of a written table, as plain numbers.

    The columns are stacked, so that the same passes serve them all.
    """
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in wanted])).alias("x")
    ).select(F.col("x.name").alias("column"), "x.v")
    probs = sorted({float(p) for ps in wanted.values() for p in ps})
    rows = {r["column"]: r for r in quantile_table(stacked, "v", probs, ["column"]).collect()}  # one row per column
    return {c: [rows[c][f"q{probs.index(float(p))}"] if c in rows else None for p in ps] for c, ps in wanted.items()}
