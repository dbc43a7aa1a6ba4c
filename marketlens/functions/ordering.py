"""Global row numbers and running sums over data of any size, with one shuffle.

A window without PARTITION BY would move everything into one task. Here a
sample of the keys gives splitters, each row's bucket is the number of
splitters before it (a search in Arrow batches), and a window per bucket numbers or adds up its rows after one hash exchange and one
sort. What lies before each bucket is added afterwards; the buckets' totals, a
few for each shuffle partition, are the only rows that reach the driver.

The bucket depends on the row's keys and on splitters that are fixed before the
work starts, so a task that is run again puts its rows where they were. The
result does not depend on the splitters at all. The input is written once,
since it is read for the sample, the totals and the result.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import materialize

#: Buckets for each shuffle partition, and sampled keys for each bucket.
_BUCKETS, _SAMPLED = 4, 24
_SEED = 17


class Key(NamedTuple):
    """A sort key; nulls come first in ascending and last in descending order."""

    column: Column
    descending: bool = False


Order = Sequence["Key | Column | str"]


def down(column: Column | str) -> Key:
    """Largest first, nulls last."""
    return Key(F.col(column) if isinstance(column, str) else column, True)


def _ascending(name: str, kind: T.DataType, descending: bool) -> list[Column]:
    """Columns whose ascending order, nulls first, is the order of the key: numbers and strings alone."""
    value = F.col(name)
    if isinstance(kind, (T.DateType, T.BooleanType)):
        value, kind = (F.unix_date(value) if isinstance(kind, T.DateType) else value.cast("int")).cast("bigint"), T.LongType()
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value, kind = F.unix_micros(value.cast("timestamp")), T.LongType()
    elif isinstance(kind, T.BinaryType):
        value, kind = F.hex(value), T.StringType()
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        value, kind = (value * F.lit(Decimal(10) ** kind.scale)).cast("bigint"), T.LongType()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = value.cast("double")
        size = F.when(~F.isnan(value), -value if descending else value)
        nan = F.isnan(value).cast("int")
        return [value.isNull().cast("int"), 1 - nan, size] if descending else [nan, size]
    if not descending:
        return [value]
    if isinstance(kind, T.StringType):
        # the longer of two strings that begin alike comes first
        value = F.concat(F.translate(F.hex(value), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    elif isinstance(kind, T.IntegralType):
        value = F.bitwise_not(value)
    else:
        value = -value
    return [value.isNull().cast("int"), value]


def _placed_by(df: DataFrame, order: Order) -> tuple[DataFrame, list[str]]:
    """``df`` with the order in columns to be taken ascending, and their names."""
    keys = [k if isinstance(k, Key) else Key(F.col(k) if isinstance(k, str) else k) for k in order]
    raw = {f"_raw{i}": k.column for i, k in enumerate(keys)}
    df = df.withColumns(raw)
    parts = [c for name, k in zip(raw, keys) for c in _ascending(name, df.schema[name].dataType, k.descending)]
    names = [f"_key{i}" for i in range(len(parts))]
    return df.withColumns(dict(zip(names, parts))).drop(*raw), names


def _splitters(df: DataFrame, keys: Sequence[str], rows: int) -> list[tuple]:
    """Sampled keys in order, a few per shuffle partition."""
    buckets = _BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, _SAMPLED * buckets / max(rows, 1))
    sample = df.select(*keys).sample(share, _SEED) if share < 1 else df.select(*keys)
    found = sample.orderBy(*keys).collect()
    picked = [tuple(found[len(found) * i // buckets]) for i in range(1, buckets)] if found else []
    return [r for i, r in enumerate(picked) if not i or r != picked[i - 1]]


def _ranks(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Order-preserving numbers of values among sorted known ones: odd behind a gap, even on a known value; none is 0."""
    at = np.searchsorted(known, values)
    hit = known[np.minimum(at, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)
    return 1 + 2 * at + np.asarray(hit, bool)


class Buckets:
    """Places rows among splitters, many at a time.

    Each key becomes a small whole number that says where it lies among the
    splitters' values of that key, and the numbers of all keys become one, so a
    single search over whole numbers finds the bucket.
    """

    def __init__(self, splitters: Sequence[tuple]):
        self.known: list[np.ndarray] = []
        self.prefixes: list[np.ndarray] = []
        code = np.zeros(len(splitters), np.int64)
        for values in zip(*splitters):
            plain = [v.encode() if isinstance(v, str) else v for v in values]
            some = sorted({v for v in plain if v is not None})
            kind = object if some and isinstance(some[0], (bytes, Decimal)) else None
            self.known.append(np.array(some, kind))
            code = self._joined(code, self._codes(len(self.known) - 1, plain))
        self.codes = code

    def _codes(self, key: int, values: Sequence) -> np.ndarray:
        known, out = self.known[key], np.zeros(len(values), np.int64)
        there = np.array([v is not None for v in values], bool)
        out[there] = _ranks(known, np.array([v for v in values if v is not None], known.dtype))
        return out

    def _joined(self, prefix: np.ndarray, code: np.ndarray) -> np.ndarray:
        """One number for the keys so far; the prefix counts by its rank, so numbers stay small."""
        turn = len(self.known) - 1
        if turn == len(self.prefixes):
            self.prefixes.append(np.unique(prefix))
        return _ranks(self.prefixes[turn], prefix) * (2 * len(self.known[turn]) + 2) + code

    def __call__(self, columns: Sequence[pa.Array]) -> np.ndarray:
        code = np.zeros(len(columns[0]), np.int64)
        for turn, (known, column) in enumerate(zip(self.known, columns)):
            values = column.dictionary_encode()
            distinct = values.dictionary
            if not len(known):  # all splitters have a null here
                found = np.ones(len(distinct), np.int64)
            elif known.dtype == object:
                found = self._codes(turn, [v.encode() if isinstance(v, str) else v for v in distinct.to_pylist()])
            else:
                found = _ranks(known, distinct.to_numpy(zero_copy_only=False))
            at = values.indices.fill_null(len(found)).to_numpy(zero_copy_only=False)
            own = np.append(found, 0)[at]  # a null comes first
            code = _ranks(self.prefixes[turn], code) * (2 * len(known) + 2) + own
        return np.searchsorted(self.codes, code, side="right")


def _bucket(keys: Sequence[str], splitters: list[tuple]) -> Column:
    """Number of splitters that lie before the row or on it."""
    if not splitters:
        return F.lit(0)
    buckets = Buckets(splitters)

    @F.arrow_udf(T.IntegerType())
    def bucket(*columns: pa.Array) -> pa.Array:
        return pa.array(buckets(columns), pa.int32())

    return bucket(*keys)


def _constant(rows: Sequence[Sequence], kind: T.StructType) -> Column:
    """A constant array of structs of numbers: one JSON text, which Spark parses once when it plans, whatever its length."""

    def plain(value):
        return str(value) if isinstance(value, Decimal) else value

    text = json.dumps([{f.name: plain(v) for f, v in zip(kind, r)} for r in rows])
    return F.from_json(F.lit(text), T.ArrayType(kind), {"mode": "FAILFAST"})


def _cumulate(df: DataFrame, order: Order, values: dict[str, Column], written: bool) -> DataFrame:
    """``df`` with the running sums of the named values, each row's own included."""
    df = df if written else materialize(df, "unordered")
    keyed, keys = _placed_by(df, order)
    splitters = _splitters(keyed, keys, df.count())
    placed = keyed.withColumn("_part", _bucket(keys, splitters))
    sums = placed.groupBy("_part").agg(*[F.sum(v).alias(o) for o, v in values.items()])
    kind = T.StructType([f for f in sums.schema if f.name in values])
    # one row per bucket: bounded by the shuffle partitions, not by the data
    totals = {r["_part"]: r for r in sums.collect()}
    before, running = [], {f.name: Decimal(0) if isinstance(f.dataType, T.DecimalType) else 0 for f in kind}
    for part in range(len(splitters) + 1):
        before.append(tuple(running.values()))
        if part in totals:
            running = {o: n + (totals[part][o] or 0) for o, n in running.items()}
    local = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"_local{i}": F.coalesce(F.sum(v).over(local), F.lit(0)) for i, v in enumerate(values.values())})
    start = F.get(_constant(before, kind), F.col("_part"))
    out = out.withColumns({o: start[o] + F.col(f"_local{i}") for i, o in enumerate(values)})
    return out.select(*[c for c in df.columns if c not in values], *values)


def global_row_number(df: DataFrame, order: Order, out: str = "row_number", written: bool = False) -> DataFrame:
    """Number the rows 1..n in ``order``, which must end in a unique key.

    ``written`` says that ``df`` is cheap to read several times.
    """
    numbered = _cumulate(df, order, {out: F.lit(1).cast("bigint")}, written)
    return numbered.withColumn(out, F.col(out).cast("bigint"))


def running_sum(df: DataFrame, order: Order, values: dict[str, str], written: bool = False) -> DataFrame:
    """Running totals in ``order``: ``values`` maps input to output column.

    ``order`` must end in a unique key. Inputs should be integers or decimals,
    so that the totals do not depend on where the buckets end.
    """
    return _cumulate(df, order, {o: F.col(c) for c, o in values.items()}, written)
