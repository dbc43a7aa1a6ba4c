"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic scorer by minimising
the non-negative unbiased risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-)).  With
the logistic loss the unbiased risk is convex, so each pass is a Newton step
whose sums (loss, gradient, curvature) are added up in numpy within partitions
and entry by entry across the cluster; the driver sees one row per entry,
whatever the number of partitions. The unlabelled side is every document, the
positives every trusted label of 1; labels of 0 are not used at all. Only
training labels are learnt from, and no column but the text is an input of a
score.

The class prior pi is estimated from positives and unlabelled text. As
P(s > t | unlabelled) is at least pi P(s > t | positive) at every threshold t
of any score s, each ratio of the two shares bounds pi from above, and is near
it where few negatives score. A first fit on half the positives, with a prior
of a half, gives the score; the other half and all documents are counted by
score, and the ratio is taken where its upper confidence bound is least.

Defined results: a null text counts as empty and is scored like one; very long
texts are measured whole, one at a time; repeated rows count each; a document
with several labels counts as positive if its largest label is 1; without a
positive training label all scores are 0.5; an empty table gives no rows; other
columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import materialize
from .common import id_remainder

_LOWER, _UPPER, _DIGIT = (bytes(range(a, b)) for a, b in ((0x61, 0x7B), (0x41, 0x5B), (0x30, 0x3A)))
_SYMBOLS = (b"#*$%&<>@=_~^", b"|", b"!", b",", b".", b"?;:", b"()[]{}\"'/\\+-")
_NOT = {s: bytes(b for b in range(256) if b not in s) for s in (_LOWER, _UPPER, _DIGIT, *_SYMBOLS)}


def measure(text: str | None) -> list[float]:
    """Shares and averages that describe a text's form."""
    data = (text or "").encode()
    words = data.split()
    n, size = len(words), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    count = {s: len(data.translate(None, _NOT[s])) for s in (_LOWER, _UPPER, _DIGIT, *_SYMBOLS)}
    distinct = len(set(words))
    pairs, triples = (len(set(zip(*[words[i:] for i in range(k)]))) for k in (2, 3))
    full = max(1, n)
    most = 0.0
    if n:
        common = max(map(len, words))
        most = math.log1p(common)
    return [
        math.log1p(n),
        math.log1p(len(lines)),
        len(data) / full,
        most,
        *(math.sqrt(c / size) for c in count.values()),
        distinct / full,
        pairs / max(1, n - 1),
        triples / max(1, n - 2),
        len(set(lines)) / max(1, len(lines)),
        sum(map(bytes.isupper, words)) / full,
        sum(map(bytes.istitle, words)) / full,
        sum(len(w) == 1 for w in words) / full,
        sum(1 for w in words if w[-1:] in b".,!?") / full,
        math.sqrt(1 - sum(count.values()) / size - max(0, n - 1) / size) if sum(count.values()) + n - 1 < size else 0.0,
    ]


N_FEATURES = len(measure(""))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def features(texts: pa.Array) -> pa.Array:
    return pa.array([measure(t) for t in texts.to_pylist()], pa.list_(pa.float32()))


class Design:
    """Standardised features with hinges at fixed places, and an intercept."""

    KNOTS = (-1.0, 0.0, 1.0, 2.5)

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread = mean, np.where(spread > 1e-6, spread, 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, *[np.maximum(z - k, 0) for k in self.KNOTS]])

    @property
    def width(self) -> int:
        return 1 + N_FEATURES * (1 + len(self.KNOTS))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def risk_sums(rows: DataFrame, design: Design, w: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over all rows at the weights ``w``, added up across the cluster entry by entry.

    Unlabelled: count, loss as negative, gradient, curvature. Positive: count,
    loss as positive, loss as negative, gradient of the second, of the first.
    """
    d = design.width
    upper = np.triu_indices(d)
    names = ("n_u", "u_neg", "u_grad", "u_curve", "n_p", "p_pos", "p_neg", "p_neg_grad", "p_pos_grad")
    sizes = (1, 1, d, len(upper[0]), 1, 1, 1, d, d)

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, p = np.zeros(2 + d + len(upper[0])), np.zeros(3 + d + d)
        for b in batches:
            x = design(_matrix(b.column(0)))
            z = x @ w
            s = 1 / (1 + np.exp(-z))
            u += np.concatenate([[len(z), _softplus(z).sum()], x.T @ s, (x.T @ (x * (s * (1 - s))[:, None]))[upper]])
            own = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            x, z, s = x[own], z[own], s[own]
            p += np.concatenate([[len(z), _softplus(-z).sum(), _softplus(z).sum()], x.T @ s, x.T @ (s - 1)])
        sums = np.concatenate([u, p])
        yield pa.record_batch([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["entry", "value"])

    parts = rows.select("x", "positive").mapInArrow(add_up, "entry int, value double")
    found = parts.groupBy("entry").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(sum(sizes))
    total[found.column("entry").to_numpy()] = found.column("value").to_numpy()
    sums = dict(zip(names, np.split(total, np.cumsum(sizes)[:-1])))
    curve = np.zeros((d, d))
    curve[upper] = sums["u_curve"]
    return sums | {"u_curve": (curve + np.triu(curve, 1).T).ravel()}


def nn_risk(s: dict[str, np.ndarray], prior: float) -> tuple[float, float]:
    """The non-negative risk and its part that may not fall below zero."""
    negative = s["u_neg"][0] / s["n_u"][0] - prior * s["p_neg"][0] / s["n_p"][0]
    return prior * s["p_pos"][0] / s["n_p"][0] + max(0.0, negative), negative


def fit(rows: DataFrame, prior: float, design: Design, ridge: float = 1e-4, passes: int = 12, tolerance: float = 1e-5) -> np.ndarray:
    """Newton steps on the unbiased risk, halved while the non-negative risk grows.

    Where the part that may not be negative is, the step goes against it instead
    (its own gradient alone), which is the non-negative correction.
    """
    w = np.zeros(design.width)
    keep = np.full(design.width, ridge)
    keep[0] = 0.0
    sums = risk_sums(rows, design, w)
    risk, negative = nn_risk(sums, prior)
    risk += 0.5 * keep @ (w * w)
    for _ in range(passes):
        n_u, n_p = sums["n_u"][0], sums["n_p"][0]
        curve = sums["u_curve"].reshape(design.width, -1) / n_u + np.diag(keep + 1e-9)
        low = sums["u_grad"] / n_u - prior * sums["p_neg_grad"] / n_p
        slope = keep * w + (prior * sums["p_pos_grad"] / n_p + low if negative >= 0 else -low)
        move, size = np.linalg.solve(curve, slope), 1.0
        while True:
            tried = w - size * move
            sums = risk_sums(rows, design, tried)
            now, negative = nn_risk(sums, prior)
            now += 0.5 * keep @ (tried * tried)
            if now <= risk or size < 0.1:
                break
            size /= 2
        gain, w, risk = risk - now, tried, now
        if abs(gain) < tolerance:
            break
    return w


#: Margins are counted in so many bins from -_REACH to _REACH.
_BINS, _REACH = 400, 20.0


def margin_counts(rows: DataFrame, design: Design, w: np.ndarray, own: Column) -> tuple[np.ndarray, np.ndarray]:
    """Documents, and those of ``own``, by bins of the margin, lowest first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, _BINS), np.int64)
        for b in batches:
            z = np.clip(design(_matrix(b.column(0))) @ w, -_REACH, _REACH * (1 - 1e-9))
            place = ((z + _REACH) * (_BINS / (2 * _REACH))).astype(np.int64)
            mine = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            seen += [np.bincount(place, minlength=_BINS), np.bincount(place[mine], minlength=_BINS)]
        yield pa.record_batch([pa.array(np.arange(_BINS, dtype=np.int32)), pa.array(seen[0]), pa.array(seen[1])], names=["bin", "u", "p"])

    counted = rows.select("x", own.alias("own")).mapInArrow(count, "bin int, u bigint, p bigint")
    found = counted.groupBy("bin").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect()  # one row per bin
    out = np.zeros((2, _BINS), np.int64)
    for r in found:
        out[:, r["bin"]] = r["u"], r["p"]
    return out[0], out[1]


def estimate_prior(u: np.ndarray, p: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from counts of both by score, lowest first."""
    if not p.sum():
        return 0.5
    above_u, above_p = (np.cumsum(c[::-1]) / c.sum() for c in (u, p))
    slip_u, slip_p = (math.sqrt(math.log(4 / delta) / (2 * c.sum())) for c in (u, p))
    sure = above_p > slip_p
    bound = np.where(sure, (above_u + slip_u) / np.where(sure, above_p - slip_p, 1.0), np.inf)
    best = int(bound.argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99)) if sure.any() else 0.5


def train(rows: DataFrame, design: Design) -> tuple[float, np.ndarray]:
    """The class prior and the weights, from written rows of features and trusted positives."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    first = fit(rows.withColumn("positive", F.col("positive") & half), 0.5, design)
    prior = estimate_prior(*margin_counts(rows, design, first, F.col("positive") & ~half))
    return prior, fit(rows, prior, design)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("label_id")).distinct()
    held = id_remainder() == 0
    rows = docs.select("doc_id", held.alias("held_out"), features("text").alias("x"))
    rows = rows.join(trusted, F.col("doc_id") == F.col("label_id"), "left")
    rows = rows.select("doc_id", "held_out", "x", (F.col("label_id").isNotNull() & ~F.col("held_out")).alias("positive"))
    rows = materialize(rows, "features")
    stats = rows.agg(
        F.sum(F.col("positive").cast("bigint")).alias("p"),
        *[f(F.get("x", F.lit(i)).cast("double")).alias(f"{name}{i}") for i in range(N_FEATURES) for name, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    if not stats["p"]:
        score = F.lit(0.5)
        return rows.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    design = Design(*(np.array([stats[f"{k}{i}"] for i in range(N_FEATURES)]) for k in "ms"))
    _, w = train(rows, design)

    @F.arrow_udf(T.DoubleType())
    def score_of(x: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-(design(_matrix(x)) @ w))))

    scored = rows.select("doc_id", "held_out", score_of("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
