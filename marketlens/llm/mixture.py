"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells (source, language, topic) are raked until their
margins meet the targets, each cell's weight becomes a sampling probability
(the cell that needs most keeps all its documents), and documents are drawn by
a hash of their id.

A margin has named weights or one cap for all its values (``AtMost``). Values a
target does not name form the class "" ("the rest"), which keeps its own share
of the tokens; named weights divide what it leaves. Of a capped margin only the
values that would pass the cap are classes of their own: totals of all values
stay a distributed table, the heavy values are looked up in it, the classes are
raked, and every other value's share of the mixture is compared with the cap in
the table, until none is above it. So any source is held down, whatever their
number, and the raked table stays small (a round adds few values, since few can
be above a fraction of the cap).

Nothing is scaled by the scarcest cell without a limit: after the caps, a class
or cell has at least ``FEWEST`` and at most ``MOST`` times its own share of the
tokens. A scarce class thus misses its weight, the other named classes divide
what it leaves, and the mixture keeps at least 1 / ``MOST`` of the tokens that
the caps alone would keep. No document is repeated.

A cap that cannot be met (fewer sources than its inverse) makes the shares
equal; none is sampled below ``LEAST`` of the others for the cap alone.

Defined results: null class values belong to the rest, and so do empty values of
a capped margin, which are of no known source; a null text has no tokens; a
class with a target and no tokens is left out and its weight is shared among the
others; a cell without tokens keeps its documents, which weigh nothing; repeated rows are drawn together (same id);
very long texts are counted whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import materialize
from .common import fresh
from .text_parts import BLANKS, steps


class AtMost(NamedTuple):
    """A margin of which no value has more than this share of the mixture."""

    share: float


Targets = Mapping[str, "Mapping[str, float] | AtMost"]

#: Margins of the production mixture; the rest keeps its own share.
TARGETS: dict[str, dict[str, float] | AtMost] = {
    "source": AtMost(0.30),
    "lang": {"en": 0.60, "de": 0.15, "fr": 0.15, "es": 0.10},
    "topic": {"prose": 0.90, "table": 0.025},
}
#: The lowest rate, beside that of other values, that a cap gives.
LEAST = 0.1
#: Least and largest share of a class or cell in the mixture, in parts of its own share.
FEWEST, MOST = 0.25, 2.0
_SLACK = 1 + 1e-6


FORM = T.StructType().add("tokens", "long").add("topic", "string")
_BLANK, _BAR, _MARK = (np.isin(np.arange(256), list(b)) for b in (BLANKS, b"|", b"!#$%&*"))


@F.arrow_udf(FORM)
def form(texts: pa.Array) -> pa.Array:
    """Words of each text and a coarse topic by form: tables and lists, shouted or symbol-laden text, prose.

    All counts come from one look at the bytes.
    """
    tokens, topics = [np.empty(0, np.int64)], [np.empty(0, object)]
    for some in steps(pc.fill_null(texts.cast(pa.string()), "")):
        ends = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        solid = ~_BLANK[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        first = ends[:-1][ends[:-1] < ends[-1]]
        begins[first] = solid[first]
        words, tails, bars, marks = (
            np.diff(np.searchsorted(np.flatnonzero(found), ends)) for found in (begins, data & 0xC0 == 0x80, _BAR[data], _MARK[data])
        )
        chars = np.diff(ends) - tails
        tokens.append(words)
        topics.append(np.select([bars * 40 > chars, marks * 40 > chars], ["table", "noise"], "prose").astype(object))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(tokens), pa.int64()), pa.array(np.concatenate(topics), pa.string())], names=FORM.names)


def rake(
    tokens: np.ndarray,
    margins: list[np.ndarray],
    tolerance: float = 1e-9,
    max_rounds: int = 1_000,
    caps: tuple[int, ...] = (),
    bounds: tuple[float, float] | None = None,
) -> np.ndarray:
    """Fit the table of tokens to the margins (each sums to 1); returns shares that sum to 1.

    The margins of the axes in ``caps`` are upper limits. Every share stays
    within ``bounds`` times the cell's own. Margins that contradict each other
    or the bounds (a class with tokens only in cells that another margin holds
    small) are met as nearly as ``max_rounds`` rounds get.
    """

    def goal(axis: int, now: np.ndarray) -> np.ndarray:
        return np.minimum(margins[axis], now) if axis in caps else margins[axis]

    share = own = tokens / tokens.sum()
    for _ in range(max_rounds):
        for axis in range(len(margins)):
            now = _margin(share, axis)
            factor = np.divide(goal(axis, now), now, out=np.zeros_like(now), where=now > 0)
            share = share * factor.reshape([-1 if a == axis else 1 for a in range(share.ndim)])
        share = share / share.sum() if bounds is None else _bounded(share, own, bounds)
        now = [_margin(share, axis) for axis in range(len(margins))]
        if max(np.abs(n - goal(axis, n)).max() for axis, n in enumerate(now)) < tolerance:
            break
    return share


def _margin(table: np.ndarray, axis: int) -> np.ndarray:
    return table.sum(axis=tuple(a for a in range(table.ndim) if a != axis))


def _bounded(wanted: np.ndarray, own: np.ndarray, bounds: tuple[float, float]) -> np.ndarray:
    """``wanted``, scaled so that it sums to what ``own`` does when held within ``bounds`` times ``own``."""
    least, most = (b * own for b in bounds)
    scaled = wanted * (own.sum() / wanted.sum())
    if (scaled >= least).all() and (scaled <= most).all():
        return scaled
    low, high = -60.0, 60.0
    for _ in range(100):
        by = (low + high) / 2
        low, high = (by, high) if np.clip(scaled * np.exp(by), least, most).sum() < own.sum() else (low, by)
    return np.clip(scaled * np.exp(high), least, most)


def _level(own: np.ndarray, cap: float) -> tuple[float, float]:
    """Where to cut the shares (the last is the rest) so that none is above the cap, and the cap that this meets."""
    named, rest = own[:-1], own[-1]
    if not named.size or named.max() <= cap:
        return 1.0, cap
    low, high = LEAST * named.max(), named.max()
    for _ in range(100):
        level = (low + high) / 2
        low, high = (level, high) if level < cap * (np.minimum(named, level).sum() + rest) else (low, level)
    return high, max(cap, high / (np.minimum(named, high).sum() + rest))


class Rates(NamedTuple):
    """For each cell its share of the mixture and the probability of keeping a document.

    ``limits`` has for each capped axis the share of all tokens above which a
    value is cut, and the share of the mixture that no value may pass.
    """

    cells: dict[tuple[str, ...], tuple[float, float]]
    limits: dict[str, tuple[float, float]]


def cell_rates(
    totals: Mapping[tuple[str, ...], int],
    targets: Targets,
    heavy: Mapping[str, list[str]],
    bounds: tuple[float, float] = (FEWEST, MOST),
) -> Rates:
    """Rates of the cells; ``heavy`` names the values of each capped axis that are classes of their own."""
    names = [[*_named(a, targets, heavy), ""] for a in targets]
    table = np.zeros([len(n) for n in names])
    place = {cell: tuple(n.index(v) for n, v in zip(names, cell)) for cell in totals}
    for cell, n in totals.items():
        table[place[cell]] += n
    if not table.sum():
        return Rates({}, {})
    held, limits = table / table.sum(), {}
    for axis, (a, t) in enumerate(targets.items()):
        if isinstance(t, AtMost):
            own = _margin(held, axis)
            limits[a] = level, _ = _level(own, t.share)
            cut = np.append(np.minimum(own[:-1], level), own[-1])
            factor = np.divide(cut, own, out=np.zeros_like(own), where=own > 0)
            held = held * factor.reshape([-1 if x == axis else 1 for x in range(held.ndim)])
            held = held / held.sum()
    margins = []
    for axis, (a, t) in enumerate(targets.items()):
        own = _margin(held, axis)
        if isinstance(t, AtMost):
            margins.append(np.append(np.full(len(own) - 1, limits[a][1]), np.inf))
            continue
        wanted = np.array([*t.values()]) * (own[:-1] > 0)
        if wanted.sum():
            wanted = _bounded(wanted, own[:-1], bounds)
        wanted = np.append(wanted, own[-1])
        if not wanted.sum():
            raise ValueError(f"no tokens in any class of {a} that has a target")
        margins.append(wanted / wanted.sum())
    capped = tuple(i for i, t in enumerate(targets.values()) if isinstance(t, AtMost))
    share = rake(held, margins, caps=capped, bounds=bounds)
    ratio = np.divide(share, table, out=np.zeros_like(share), where=table > 0)
    rate = np.where(table > 0, ratio / ratio.max(), 1.0)
    return Rates({c: (float(share[i]), float(rate[i])) for c, i in place.items()}, limits)


def _named(axis: str, targets: Targets, heavy: Mapping[str, list[str]]) -> list[str]:
    return heavy[axis] if axis in heavy else list(targets[axis])


def _class(value: Column, names: list[str]) -> Column:
    return F.when(value.isin(names), value).otherwise(F.lit("")) if names else F.lit("")


def _rate_table(cells: DataFrame, targets: Targets, rates: Rates) -> DataFrame:
    """One row per cell: its classes, share and rate; small, for joins by broadcast."""
    kind = T.StructType([T.StructField(f"_{a}", T.StringType(), False) for a in targets])
    kind = kind.add("_share", "double", False).add("_rate", "double", False)
    return F.broadcast(cells.sparkSession.createDataFrame([(*c, *v) for c, v in rates.cells.items()], kind))


def fit(
    cells: DataFrame, targets: Targets, bounds: tuple[float, float] = (FEWEST, MOST)
) -> tuple[Rates, dict[str, list[str]]]:
    """Rates for the written table ``cells`` (margins' values and n), and the heavy values of the capped margins."""
    total = cells.agg(F.sum("n")).first()[0] or 0
    caps = {a: t.share for a, t in targets.items() if isinstance(t, AtMost)}
    heavy: dict[str, list[str]] = {}
    for a, cap in caps.items():
        sums = cells.where(F.col(a) != "").groupBy(a).agg(F.sum("n").alias("n"))
        heavy[a] = sorted(r[a] for r in sums.where(F.col("n") > total * cap / 2).collect())
    while True:
        classes = {a: _class(F.col(a), _named(a, targets, heavy)) for a in targets}
        placed = cells.select("*", *[c.alias(f"_{a}") for a, c in classes.items()])
        sums = placed.groupBy(*[f"_{a}" for a in targets]).agg(F.sum("n").alias("n")).collect()
        rates = cell_rates({tuple(r[f"_{a}"] for a in targets): r["n"] for r in sums}, targets, heavy, bounds)
        if not rates.cells:
            return rates, heavy
        mixed = sum(r["n"] * rates.cells[tuple(r[f"_{a}"] for a in targets)][1] for r in sums)
        rated = placed.join(_rate_table(cells, targets, rates), [f"_{a}" for a in targets])
        more = {}
        for a, (level, limit) in rates.limits.items():
            light = rated.where((F.col(a) != "") & (F.col(f"_{a}") == "")).groupBy(a)
            light = light.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_rate")).alias("kept"))
            over = (F.col("n") > total * level * _SLACK) | (F.col("kept") > mixed * limit * _SLACK)
            more[a] = [r[a] for r in light.where(over).collect()]
        if not any(more.values()):
            return rates, heavy
        heavy = {a: sorted([*heavy[a], *more[a]]) for a in heavy}


def mix(docs: DataFrame, targets: Targets = TARGETS, seed: int = 7, keep_text: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a struct column: classes, tokens, share, rate, kept; and that column's name.

    The margins' topic is computed from the text; other margins are columns.
    Without the text the measured rows are written, so that texts are read once.
    """
    m, seen = fresh("mix"), fresh("form")
    values = {a: F.col(f"{seen}.topic") if a == "topic" else F.col(a).cast("string") for a in targets}
    cell = F.struct(
        *[(F.coalesce(v, F.lit("")) if isinstance(targets[a], AtMost) else _class(v, list(targets[a]))).alias(a) for a, v in values.items()]
    )
    placed = docs.withColumn(seen, form("text"))
    placed = placed.withColumn(m, F.struct(cell.alias("cell"), F.col(f"{seen}.tokens").alias("tokens"))).drop(seen)
    if not keep_text:
        placed = materialize(placed.drop("text"), "measured")
    cells = placed.groupBy(*[F.col(f"{m}.cell.{a}").alias(a) for a in targets]).agg(F.sum(f"{m}.tokens").alias("n"))
    cells = materialize(cells, "mixture_cells")
    rates, heavy = fit(cells, targets)
    keys = {a: F.col(f"{m}.cell.{a}") for a in targets}
    keys |= {a: _class(keys[a], names) for a, names in heavy.items()}
    table = _rate_table(cells, targets, rates)
    table = table.select(F.struct(*[F.col(f"_{a}").alias(a) for a in targets]).alias(f"{m}_cell"), F.struct("_share", "_rate").alias(f"{m}_rates"))
    placed = placed.withColumn(f"{m}_cell", F.struct(*[c.alias(a) for a, c in keys.items()])).join(table, f"{m}_cell", "left")
    share, rate = [F.coalesce(f"{m}_rates.{x}", F.lit(other)) for x, other in (("_share", 0.0), ("_rate", 1.0))]
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    out = placed.withColumn(
        m, F.struct(F.col(f"{m}_cell.*"), F.col(f"{m}.tokens"), share.alias("share"), rate.alias("rate"))
    ).withColumn(m, F.col(m).withField("kept", draw < F.col(f"{m}.rate")))
    return out, m


def mixture_verdicts(docs: DataFrame) -> DataFrame:
    found, m = mix(docs.select("doc_id", "text", "lang", "source"), keep_text=False)
    return found.select("doc_id", f"{m}.*")


def drop_unsampled(docs: DataFrame) -> DataFrame:
    """The drawn documents, with the input's columns."""
    found, m = mix(docs)
    return found.where(F.col(f"{m}.kept")).select(*docs.columns)
