"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

1. Each entry becomes an integer (``SCALE`` times the entry, rounded down, plus
   ``SHIFT``). Tasks add up exact integer sums and products; with n vectors x
   and their sums S, n times the sum of x xᵀ less S Sᵀ is n² times the
   covariance V, an integer matrix free of rounding.
2. Its characteristic polynomial is computed modulo enough primes: a similarity
   transformation to Hessenberg form, then a recurrence over its columns. The
   primes are dealt out over tasks. Chinese remaindering gives the integer
   coefficients; as all eigenvalues are real and none is negative, Maclaurin's
   inequality bounds them by the trace.
3. All roots are real, so the number of roots above t is exactly the number of
   sign changes in the coefficients of p(x + t). Halving intervals isolates the
   largest eigenvalues; an interval with one root is narrowed further by the
   sign of p, to ``BITS`` binary places. Roots that equal each other to that
   depth are one root with a multiplicity.
4. For each root a task solves with M - root in decimals of ``DIGITS`` digits
   (inverse iteration): near a null vector two steps give the eigenvector to
   far more than double precision, for close roots too. A multiple root gets as
   many orthonormal vectors.
5. Vectors are centred as exact integers n x - S and projected.

The driver holds a d x d matrix, d coefficients and the chosen vectors, whatever
the number of rows; d is the vectors' dimension.

Defined results: rows whose vector is null, empty, or holds a null or a
non-finite entry are dropped, as are those of another length than most have (of
equally frequent lengths the longest counts); entries beyond ±2^52 / ``SCALE``
count as that bound, so that x is a long; rows that repeat an id count each;
components whose eigenvalue is 0 are left out, so equal vectors alone give no
rows; an empty table gives no rows; other columns do not matter, nor do texts.
A vector's sign is such that its largest entry is positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import materialize
from .common import partitions

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BITS, DIGITS = 200, 120
_TOP = float(1 << 52)
#: Whole numbers travel in pieces of so many bits, so that their sums stay exact at any size.
_LIMB = 40


# scatter --------------------------------------------------------------------


def lattice(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and their entries as whole numbers, without ``SHIFT``."""
    keep = vectors.is_valid().to_numpy(False) & (vectors.value_lengths().fill_null(0).to_numpy(False) == d)
    entries = vectors.filter(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    finite = np.isfinite(entries).all(axis=1)  # a null entry has become NaN
    keep[np.flatnonzero(keep)[~finite]] = False
    return keep, np.floor(np.clip(entries[finite] * SCALE, -_TOP, _TOP)).astype(np.int64)


def products(x: np.ndarray) -> np.ndarray:
    """The exact sum of x xᵀ over rows of whole numbers within ±2^52, as Python integers."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    for rows in np.array_split(x, max(1, -(-len(x) // 2048))):
        # digits of 20 bits, the last one signed: 2048 products of two add up exactly in a double
        digits = []
        while abs(rows).max(initial=0) >= 1 << 19:
            digits.append((rows & 0xFFFFF).astype(np.float64))
            rows = rows >> 20
        digits.append(rows.astype(np.float64))
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << 20 * (i + j))
    return total


def _limbs(value: int) -> list[int]:
    """``value`` as a sum of limb times 2 ** (_LIMB * place), limbs with the value's sign."""
    out, sign, value = [], -1 if value < 0 else 1, abs(value)
    while value:
        out.append(sign * (value & ((1 << _LIMB) - 1)))
        value >>= _LIMB
    return out


def _whole_sums(rows: DataFrame, cells: int) -> list[int]:
    """Sums of whole numbers by cell from rows (cell, limb, value); one row per cell and limb comes back."""
    out = [0] * cells
    for r in rows.groupBy("cell", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        out[r["cell"]] += int(r["value"]) << _LIMB * r["limb"]
    return out


@dataclass(frozen=True)
class Scatter:
    """n vectors with the sums S of their entries, without ``SHIFT``, and n² times their covariance."""

    n: int
    sums: list[int]
    matrix: list[list[int]]

    @property
    def trace(self) -> int:
        return sum(self.matrix[i][i] for i in range(len(self.sums)))


def dimension(table: DataFrame, col: str) -> int:
    """The length most vectors have; 0 without vectors."""
    size = F.size(col)
    most = table.where(size > 0).groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return most["d"] if most else 0


def scatter(table: DataFrame, col: str, d: int) -> Scatter:
    """Exact scatter of all vectors that count."""
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, [0] * d, np.zeros((d, d), object)
        for batch in batches:
            _, x = lattice(batch.column(0), d)
            n += len(x)
            total += products(x)
            for rows in np.array_split(x, max(1, -(-len(x) // 1024))):  # exact: 2^10 entries of 2^52
                sums = [a + b for a, b in zip(sums, rows.sum(axis=0).tolist())]
        cells = [n, *sums, *(total[i][j] for i, j in upper)]
        flat = [(c, k, v) for c, value in enumerate(cells) for k, v in enumerate(_limbs(value))]
        cell, limb, value = zip(*flat) if flat else ((), (), ())
        yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], names=["cell", "limb", "value"])

    rows = table.select(F.col(col).cast("array<double>")).mapInArrow(add, "cell int, limb int, value bigint")
    n, *rest = _whole_sums(rows, 1 + d + len(upper))
    sums, matrix = rest[:d], [[0] * d for _ in range(d)]
    for (i, j), v in zip(upper, rest[d:]):
        matrix[i][j] = matrix[j][i] = n * v - sums[i] * sums[j]
    return Scatter(n, sums, matrix)


# characteristic polynomial --------------------------------------------------


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The largest primes under ``below``; a Miller-Rabin test with these bases is exact there."""
    out, p = [], below - 1
    while len(out) < count:
        twos = ((p - 1) & (1 - p)).bit_length() - 1
        for a in (2, 3, 5, 7):
            x = pow(a, (p - 1) >> twos, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
                break
        else:
            out.append(p)
        p -= 2
    return out


def hessenberg(matrix: list[list[int]], p: int) -> np.ndarray:
    """A matrix similar to ``matrix`` modulo ``p``, zero below its first subdiagonal."""
    a = np.array([[v % p for v in row] for row in matrix], np.int64)
    for k in range(len(a) - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot, at = k + 1 + int(below[0]), k + 1
        a[[at, pivot]] = a[[pivot, at]]
        a[:, [at, pivot]] = a[:, [pivot, at]]
        times = a[at + 1 :, k] * pow(int(a[at, k]), -1, p) % p
        a[at + 1 :] = (a[at + 1 :] - times[:, None] * a[at] % p) % p
        a[:, at] = (a[:, at] + (a[:, at + 1 :] * times % p).sum(axis=1)) % p
    return a


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo ``p``, that of x^0 first."""
    a = hessenberg(matrix, p)
    d = len(a)
    found = np.zeros((d + 1, d + 1), np.int64)  # row k: polynomial of the leading k x k block
    found[0, 0] = 1
    for k in range(d):
        found[k + 1, 1:] = found[k, :-1]
        chain, factors = 1, [int(a[k, k])]
        for i in range(k - 1, -1, -1):
            chain = chain * int(a[i + 1, i]) % p
            factors.append(int(a[i, k]) * chain % p)
        terms = np.array(factors, np.int64)[:, None] * found[k::-1] % p
        found[k + 1] = (found[k + 1] - terms.sum(axis=0)) % p
    return found[d].tolist()


def coefficient_bound(trace: int, d: int) -> int:
    """No coefficient is larger: the k-th symmetric function of d numbers of this sum, none negative, is largest for equal ones."""
    return max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x - matrix), that of x^0 first, for a matrix without negative eigenvalues."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    moduli = primes(coefficient_bound(trace, d).bit_length() // 30 + 1)  # each prime has over 30 bits

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([polynomial_mod(matrix, moduli[i]) for i in ids], pa.list_(pa.int64()))], names=["i", "rest"]
            )

    tasks = min(len(moduli), partitions(spark))
    rests = {r["i"]: r["rest"] for r in spark.range(0, len(moduli), 1, tasks).mapInArrow(reduce, "i bigint, rest array<bigint>").collect()}
    whole = math.prod(moduli)
    parts = [whole // p * pow(whole // p, -1, p) for p in moduli]
    out = []
    for k in range(d + 1):
        size = sum(part * (rests[i][k] if (d - k) % 2 == 0 else -rests[i][k]) for i, part in enumerate(parts)) % whole
        out.append(size if (d - k) % 2 == 0 else -size)
    if out[d] != 1 or -out[d - 1] != trace:
        raise ArithmeticError("the polynomial disagrees with the trace")
    return out


# roots ----------------------------------------------------------------------


class RealRoots:
    """Counts and isolates roots of a polynomial whose roots are all real, in exact arithmetic."""

    def __init__(self, coefficients: list[int]):
        self.c, self.d = coefficients, len(coefficients) - 1

    def above(self, m: int, s: int) -> int:
        """Roots above m / 2^s, with multiplicities."""
        q = [c << s * (self.d - k) for k, c in enumerate(self.c)]  # roots times 2^s
        for i in range(self.d):
            for k in range(self.d - 1, i - 1, -1):
                q[k] += m * q[k + 1]
        signs = [v > 0 for v in q if v]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def sign(self, m: int, s: int) -> int:
        """Sign of the polynomial at m / 2^s."""
        value = 0
        for k in range(self.d, -1, -1):
            value = value * m + (self.c[k] << s * (self.d - k))
        return (value > 0) - (value < 0)

    def largest(self, count: int, bits: int = BITS) -> list[tuple[int, int]]:
        """(root times 2^bits, multiplicity) of the positive roots from the largest, until ``count`` are covered."""
        out, covered = [], 0
        positive = self.above(0, 0)
        high, s = 1 << max(1, -self.c[self.d - 1]).bit_length(), 0  # above the sum of all roots
        while covered < min(count, positive):
            # the largest roots not covered yet lie in (low, high] / 2^s, with none but the covered above
            low, n_low = 0, positive
            while n_low - covered != 1 and (s < bits or high - low > 1):
                if high - low == 1:
                    low, high, s = low * 2, high * 2, s + 1
                middle = (low + high) // 2
                n = self.above(middle, s)
                if n > covered:
                    low, n_low = middle, n
                else:
                    high = middle
            root = self._narrow(low, high, s, bits, (-1) ** covered) if n_low - covered == 1 else high
            out.append((root, n_low - covered))
            covered, high = n_low, low
        return out

    def _narrow(self, low: int, high: int, s: int, bits: int, above: int) -> int:
        """The one root in (low, high] / 2^s to ``bits`` places; ``above`` is the polynomial's sign just above it."""
        while s < bits or high - low > 1:
            if high - low == 1:
                low, high, s = low * 2, high * 2, s + 1
            middle = (low + high) // 2
            if self.sign(middle, s) in (above, 0):
                high = middle
            else:
                low = middle
        return high


# components -----------------------------------------------------------------


def null_vectors(matrix: list[list[int]], root: Decimal, count: int, digits: int = DIGITS) -> list[list[float]]:
    """``count`` orthonormal vectors that (matrix - root) maps to nearly nothing, by inverse iteration."""
    with localcontext(Context(prec=digits, Emin=-999_999, Emax=999_999)):
        d = len(matrix)
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        for i in range(d):
            a[i, i] -= root
        least = max(abs(a).max(), Decimal(1)).scaleb(-digits)  # stands for a pivot that vanishes
        order = np.arange(d)
        for k in range(d):
            at = k + int(np.argmax(abs(a[k:, k])))
            a[[k, at]], order[[k, at]] = a[[at, k]], order[[at, k]]
            if not a[k, k]:
                a[k, k] = least
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= a[k + 1 :, k][:, None] * a[k, k + 1 :][None, :]

        def solve(b: np.ndarray) -> np.ndarray:
            x = b[order]
            for k in range(d):
                x[k + 1 :] -= a[k + 1 :, k] * x[k]
            for k in range(d - 1, -1, -1):
                x[k] /= a[k, k]
                x[:k] -= a[:k, k] * x[k]
            return x

        def unit(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
            x = x / max(abs(x))
            for _ in range(2):
                for v in found:
                    x = x - (x @ v) * v
            return x / (x @ x).sqrt()

        rng = np.random.default_rng(d)
        found: list[np.ndarray] = []
        for _ in range(count):
            x = unit(np.array([Decimal(float(v)) for v in rng.standard_normal(d)], object), found)
            for _ in range(3):
                x = unit(solve(x), found)
            at = int(np.argmax(abs(x)))
            found.append(-x if x[at] < 0 else x)
        return [[float(v) for v in x] for x in found]


@dataclass(frozen=True)
class Whitening:
    """Eigenvalues of n² V from the largest, as fractions of 2^BITS, and unit eigenvectors."""

    fit: Scatter
    roots: list[int]
    vectors: list[list[float]]

    @property
    def explained(self) -> list[float]:
        return [r / (self.fit.trace << BITS) for r in self.roots]

    def projection(self) -> np.ndarray:
        """Maps n x - S to whitened values: one column per component."""
        size = [math.sqrt(r / (1 << BITS)) for r in self.roots]  # n times the root of the covariance's eigenvalue
        return np.array(self.vectors, np.float64).T / np.array(size)


def fit_whitening(table: DataFrame, col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The first ``components`` components with a positive eigenvalue; None if there is none."""
    spark = table.sparkSession
    d = dimension(table, col)
    fit = scatter(table, col, d) if d else None
    if fit is None or not fit.trace:
        return None
    roots = RealRoots(characteristic_polynomial(spark, fit.matrix)).largest(components)

    def iterate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            with localcontext(Context(prec=2 * DIGITS)):
                exact = [Decimal(roots[i][0]) / (1 << BITS) for i in ids]
            found = [null_vectors(fit.matrix, e, roots[i][1]) for e, i in zip(exact, ids)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["i", "vectors"])

    rows = spark.range(0, len(roots), 1, len(roots)).mapInArrow(iterate, "i bigint, vectors array<array<double>>").collect()
    vectors = [v for r in sorted(rows, key=lambda r: r["i"]) for v in r["vectors"]]
    values = [r for r, times in roots for _ in range(times)]
    return Whitening(fit, values[:components], vectors[:components])


def whiten(table: DataFrame, model: Whitening, col: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, deviation (exact, decimal; null beyond 38 digits), whitened (array) of every vector that counts."""
    n, sums, projection, d = model.fit.n, model.fit.sums, model.projection(), len(model.fit.sums)
    schema = f"{key} {table.schema[key].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    most = 10**38

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = lattice(batch.column(1), d)
            small = len(x) == 0 or d * (n * int(abs(x).max()) + max(map(abs, sums))) ** 2 < 1 << 63
            z = n * x.astype(np.int64 if small else object) - np.array(sums, np.int64 if small else object)
            far = [int(v) for v in (z * z).sum(axis=1)]
            out = z.astype(np.float64) @ projection
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))
            far = pa.array([None if v >= most else v for v in far], pa.decimal128(38, 0))
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), far, values], names=[key, "deviation", "whitened"])

    return table.select(key, F.col(col).cast("array<double>")).mapInArrow(project, schema)


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the whitened values' covariance less the identity."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(components), np.zeros((components, components))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, components)
            n, sums, total = n + len(w), sums + w.sum(axis=0), total + w.T @ w
        values = np.concatenate([[n], sums, total.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["cell", "value"])

    sums = whitened.select("whitened").mapInArrow(add, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = np.zeros(1 + components + components**2)
    for r in sums.collect():  # one row per entry of a matrix of the components
        cells[r["cell"]] = r["value"]
    mean, second = cells[1 : components + 1] / cells[0], cells[components + 1 :].reshape(components, components) / cells[0]
    return float(abs(second - np.outer(mean, mean) - np.eye(components)).max())


def whitened_components(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (null if no long), whitened, explained, identity_error."""
    schema = f"vec_id {table.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit_whitening(table, components=components)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    wide = materialize(whiten(table, model), "whitened")
    explained = F.array(*[F.lit(e) for e in model.explained])
    rows = wide.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.fit.n).cast("bigint").alias("n"),
        F.when(F.col("deviation") < F.lit(Decimal(2) ** 63), F.col("deviation")).cast("bigint").alias("deviation"),
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(identity_error(wide, len(model.roots))).alias("identity_error"),
    )
