"""Near-duplicate documents by HyperMinHash sketches, verified on full sets.

Sketch. A document's distinct five-word shingles are hashed into 240 buckets;
each bucket keeps its smallest hash, compressed to a leading-zero count and
eight mantissa bits. A bucket left empty is filled by a further round with
fresh hashes (two more, then one hash function per bucket), and the round is
part of the register, so two registers agree with the probability of the
Jaccard similarity for sets of any size.

Candidates. 48 bands of five registers: a pair of similarity 0.75 shares no
band with probability 2e-6. Documents with equal sets are one class. In each
band bucket every class is paired with the bucket's smallest class only; pairs
whose collision-corrected estimate is below 0.64 (four standard deviations under
0.75) are dropped, the rest is verified on full shingle sets. Buckets that then
hold classes not yet joined by likely pairs are gone through block against block
inside tasks, each giving a spanning forest of its likely pairs, so that two
classes of a bucket that may be a link are always in one *family*, a component
of likely pairs.

Verification. A family whose links so far leave several components is compared
as a whole, once, not bucket by bucket: its classes are dealt into blocks of
bounded bytes, block meets block with the full sets, all likely pairs of
different components are compared exactly there, and only a spanning forest of
the links goes out. A component that fills blocks of its own does not meet
itself. So no link between components is missed, no table of pairs is made
beyond the few each class has with its buckets' first classes, and a family that
is linked already costs nothing more.

Links need 100 * intersection >= 75 * union.

Defined results: null and empty texts, and texts without words, have no
shingles and are linked with nothing; texts of one to four words are one
shingle. ``doc_id`` names a document: rows that repeat it are one document, a
null id has component null unless it is linked to a document with an id.
Classes are told apart by 64-bit hashes of their sets. Other columns do not
matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import materialize
from .common import text_of
from .hashed_words import chain, hashed_words, mix

WORDS = 5
BANDS, ROWS = 48, 5
BUCKETS = BANDS * ROWS
MANTISSA = 8
ROUNDS = 3
LIKELY = 0.64
PERCENT = 75
#: Classes of a block whose sketches are compared.
BLOCK = 2048
#: Bytes of sets in a block of a family; a set counts as ``LEAST_BYTES`` at least, for its sketch.
BLOCK_BYTES, LEAST_BYTES = 8 << 20, 4096

_ROUND = np.uint64(0xC2B2AE3D27D4EB4F)
_OWN = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9))


# shingles and sketches ------------------------------------------------------


def shingle_sets(texts: pa.Array | list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles."""
    h, counts = hashed_words(texts)
    long = h[: max(0, len(h) - WORDS + 1)]
    for i in range(1, WORDS):
        long = chain(long, h[i : len(h) - WORDS + 1 + i])
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            out.append(np.unique(long[at : at + n - WORDS + 1]))
        elif n:
            one = np.array([n], np.uint64)
            for i in range(n):
                one = chain(one, h[at + i : at + i + 1])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _compress(fraction: np.ndarray, level: int) -> np.ndarray:
    """Register of a 32-bit minimum: round, leading zeros, mantissa."""
    bits = np.frexp(fraction.astype(np.float64))[1]  # bits needed; 0 for 0
    rest = fraction << (33 - bits).astype(np.uint64) & np.uint64(0xFFFFFFFF)  # behind the leading one
    code = level << 14 | (32 - bits) << MANTISSA
    return (code.astype(np.uint64) | rest >> np.uint64(32 - MANTISSA)).astype(np.uint16)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers of a non-empty set of sorted hashes."""
    out = np.zeros(BUCKETS, np.uint16)
    empty = np.ones(BUCKETS, bool)
    x = shingles
    for level in range(ROUNDS):
        if level:
            with np.errstate(over="ignore"):
                x = np.sort(mix(shingles + np.uint64(level) * _ROUND))
        place = (x >> np.uint64(32)) * np.uint64(BUCKETS)
        bucket = (place >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        first = first[empty[bucket[first]]]
        out[bucket[first]] = _compress(place[first] & np.uint64(0xFFFFFFFF), level)
        empty[bucket[first]] = False
        if not empty.any():
            return out
    left = np.flatnonzero(empty)
    for some in np.array_split(left, max(1, len(left) * len(shingles) // 1_000_000)):
        with np.errstate(over="ignore"):
            least = mix(shingles[:, None] + _OWN[some][None, :]).min(axis=0)
        out[some] = _compress(least >> np.uint64(32), ROUNDS)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key per band for each row of registers."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), r.shape[:2]).copy()
    for i in range(ROWS):
        key = chain(key, r[:, :, i])
    return key.view(np.int64)


def estimate(matches: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from agreeing registers, less what chance collisions of compressed values add.

    The collision rate of two different minima falls as 2**-MANTISSA and with
    the ratio of the set sizes; its constant is that of the HyperMinHash paper
    (Yu and Weber, 2017).
    """
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * n * m / np.square(n + m)
    return (matches / BUCKETS - chance) / (1 - chance)


SKETCH = T.StructType().add("n", "long").add("cls", "long").add("regs", "binary")


@F.arrow_udf(SKETCH)
def sketch(texts: pa.Array) -> pa.Array:
    n, cls, regs = [], [], []
    # few texts are held in words at a time
    for at in range(0, len(texts), 256):
        for s in shingle_sets(texts.slice(at, 256)):
            n.append(len(s))
            cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
            regs.append(registers(s).tobytes() if len(s) else None)
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(regs, pa.binary())], names=["n", "cls", "regs"])


def _matrix(regs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(regs.to_pylist()), np.uint16).reshape(-1, BUCKETS)


@F.arrow_udf(T.ArrayType(T.LongType()))
def keys_of(regs: pa.Array) -> pa.Array:
    keys = band_keys(_matrix(regs))
    return pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))


@F.arrow_udf(T.DoubleType())
def estimate_of(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    matches = (_matrix(a) == _matrix(b)).sum(axis=1)
    return pa.array(estimate(matches, n.to_numpy().astype(float), m.to_numpy().astype(float)))


# candidates -----------------------------------------------------------------


def _near_size(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and estimate allow a link."""
    def side(x: str) -> DataFrame:
        return classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_near_size(F.col("n_a"), F.col("n_b")))
    return both.where(estimate_of("regs_a", "regs_b", "n_a", "n_b") >= LIKELY).select("a", "b")


def _members(classes: DataFrame) -> DataFrame:
    """Band buckets with several classes: key, cls, first (its smallest class)."""
    rows = materialize(classes.select("cls", F.explode(keys_of("regs")).alias("key")), "band_keys")
    # counted on the map side; the join back can split a bucket that many share
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("first")).where("size > 1")
    return materialize(rows.join(several.drop("size"), "key"), "band_members")


PAIR = "a bigint, b bigint"


def _forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of edges (u, v) that make a spanning forest, heaviest first (Boruvka's rounds)."""
    _, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = both[: len(u)], both[len(u) :]
    label, taken = np.arange(both.max(initial=-1) + 1), []
    rank = np.empty(len(u), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(u))
    by_rank = np.argsort(rank)
    while True:
        x, y = label[u], label[v]
        live = np.flatnonzero(x != y)
        if not len(live):
            return np.unique(taken).astype(np.int64)
        best = np.full(len(label), -1)
        np.maximum.at(best, x[live], rank[live])
        np.maximum.at(best, y[live], rank[live])
        chosen = by_rank[np.unique(best[best >= 0])]
        taken += chosen.tolist()
        for i in chosen:  # join along the chosen edges
            low, high = sorted((label[u[i]], label[v[i]]))
            if low != high:
                label[label == high] = low


def _likely_pairs(table: pa.Table, group: str, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places x, y and estimates of the likely pairs of different ``group`` of a block, or of two blocks."""
    n, comp, own = (table.column(c).to_numpy() for c in ("n", group, "own"))
    i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
    regs = np.ascontiguousarray(_matrix(table.column("regs").combine_chunks()).T)
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    theirs = regs[:, right]
    for at in range(0, len(left), rows):
        some = left[at : at + rows]
        matches = np.zeros((len(some), len(right)), np.uint8)
        for mine, other in zip(regs[:, some], theirs):
            matches += mine[:, None] == other[None, :]
        a, b = n[some][:, None].astype(float), n[right][None, :].astype(float)
        similar = estimate(matches, a, b)
        good = (comp[some][:, None] != comp[right][None, :]) & (similar >= LIKELY)
        good &= 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
        if i == j:
            good &= some[:, None] < right[None, :]
        x, y = np.nonzero(good)
        yield some[x], right[y], similar[x, y]


def _pair_table(cls: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Table:
    x, y = cls[x], cls[y]
    return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})


def _join_forest(found: Iterable[tuple[np.ndarray, ...]], comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of a spanning forest over the components, from batches of pairs and weights."""
    x, y, weight = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for more in found:
        x, y, weight = (np.concatenate(both) for both in zip((x, y, weight), more))
        kept = _forest(comp[x], comp[y], weight)
        x, y, weight = x[kept], y[kept], weight[kept]
    return x, y


def _across(table: pa.Table) -> pa.Table:
    """A forest of the likely pairs between families of one block, or between two blocks of a bucket."""
    return _pair_table(table.column("cls").to_numpy(), *_join_forest(_likely_pairs(table, "fam"), table.column("fam").to_numpy()))


def _rest(members: DataFrame, classes: DataFrame, families: DataFrame) -> DataFrame:
    """Likely pairs that join families which share a bucket: a forest of each block pair."""
    fam = F.coalesce(F.col("comp"), F.col("cls")).alias("fam")
    rows = members.join(families.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "first", fam)
    # the bucket's first class has been compared with all others
    rows = materialize(rows.where(F.col("cls") != F.col("first")), "bucket_families")
    split = rows.groupBy("key").agg(F.min("fam").alias("low"), F.max("fam").alias("high"), F.count(F.lit(1)).alias("size"))
    rows = rows.join(split.where("low <> high").select("key", "size"), "key")
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("cls"), blocks)
    rows = rows.select("key", "cls", "fam", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
    units = rows.select("key", "cls", "fam", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    units = units.join(classes.select("cls", "n", "regs"), "cls")
    return units.groupBy("key", "i", "j").applyInArrow(_across, PAIR).distinct()


# verification ---------------------------------------------------------------


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, block), the block's head first: the links of the others with it."""
    key, head = None, np.empty(0, np.uint64)
    for batch in batches:
        b, block, is_head, cls = (batch.column(i).to_pylist() for i in range(4))
        out = []
        for at in range(0, len(cls), 256):
            for i, s in enumerate(shingle_sets(batch.column(4).slice(at, 256)), at):
                if is_head[i]:
                    key, head = (b[i], block[i]), s
                    continue
                assert key == (b[i], block[i])
                common = len(np.intersect1d(head, s, assume_unique=True))
                if 100 * common >= PERCENT * (len(head) + len(s) - common):
                    out.append((cls[i], b[i]))
        a, b = zip(*out) if out else ((), ())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are links, on full sets. ``pairs`` should be a written table.

    Members are compared with b's set in blocks of about 256, so that a b with
    very many partners is spread over tasks and no set is held but b's.
    """
    per = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 256).alias("blocks"))
    units = pairs.join(per, "b").select("b", "a", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"))
    heads = units.select("b", "block").distinct()
    asked = units.select("b", "block", F.lit(False).alias("head"), F.col("a").alias("cls")).unionByName(
        heads.select("b", "block", F.lit(True).alias("head"), F.col("b").alias("cls"))
    )
    asked = asked.join(classes.select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest")), "cls")
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("digest"), "text")
    found = asked.join(texts, F.col("rep_id").eqNullSafe(F.col("doc_id")) & (F.col("rep_digest") == F.col("digest")))
    rows = found.select("b", "block", "head", "cls", "text").repartition("b", "block")
    rows = rows.sortWithinPartitions("b", "block", F.col("head").desc())
    return materialize(rows.mapInArrow(_verify, PAIR).distinct(), "links")


# verification inside families ------------------------------------------------


def common_shingles(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, width: int = 1 << 14, pairs: int = 8192) -> np.ndarray:
    """Exact sizes of the intersections of sets x[i] and y[i], by bit rows over the shingles that several hold."""
    out = np.zeros(len(x), np.int64)
    sizes = np.array([len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = times[place] > 1
    row, column = np.repeat(np.arange(len(sets)), sizes)[shared], column[place[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        bit = (column[a:b] - low).astype(np.uint64)
        bits = np.zeros((len(sets), width >> 6), np.uint64)
        np.bitwise_or.at(bits, (row[a:b], bit >> np.uint64(6)), np.uint64(1) << (bit & np.uint64(63)))
        bits = bits[:, : (int(column[b - 1]) - low >> 6) + 1]
        for at in range(0, len(x), pairs):
            both = bits[x[at : at + pairs]] & bits[y[at : at + pairs]]
            out[at : at + pairs] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return out


def _linked(table: pa.Table) -> pa.Table:
    """A forest of the links between components of one block, or between two blocks of a family."""
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    n, comp = (table.column(c).to_numpy() for c in ("n", "comp"))

    def links() -> Iterator[tuple[np.ndarray, ...]]:
        for x, y, similar in _likely_pairs(table, "comp"):
            used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            if len(x):
                common = common_shingles([sets[i] for i in used], place[: len(x)], place[len(x) :])
                good = 100 * common >= PERCENT * (n[x] + n[y] - common)
                yield x[good], y[good], similar[good]

    return _pair_table(table.column("cls").to_numpy(), *_join_forest(links(), comp))


@F.arrow_udf(T.BinaryType())
def _shingle_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([s.tobytes() for at in range(0, len(texts), 256) for s in shingle_sets(texts.slice(at, 256))], pa.binary())


def _blocks(placed: DataFrame) -> DataFrame:
    """For each component of a family with several: the range of its blocks, low to high, and the family's total.

    Components smaller than a block share the blocks from 0 on; larger ones have their own behind.
    """
    size = F.sum(F.greatest(8 * F.col("n"), F.lit(LEAST_BYTES))).alias("size")
    comps = placed.groupBy("fam", "comp").agg(size)
    own = F.when(F.col("size") >= BLOCK_BYTES, F.ceil(F.col("size") / BLOCK_BYTES)).otherwise(0)
    comps = comps.withColumn("own", own.cast("bigint"))
    pool = F.ceil(F.sum(F.when(F.col("own") == 0, F.col("size")).otherwise(0)) / BLOCK_BYTES)
    fams = comps.groupBy("fam").agg(pool.alias("pool"), F.sum("own").alias("large"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    comps = comps.join(fams, "fam")
    small = comps.where("own = 0").select("fam", "comp", F.lit(0).cast("bigint").alias("low"), F.col("pool").alias("high"), (F.col("pool") + F.col("large")).alias("total"), F.lit(True).alias("pooled"))
    before = Window.partitionBy("fam").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)  # one row per component of a block or more
    low = F.col("pool") + F.coalesce(F.sum("own").over(before), F.lit(0))
    large = comps.where("own > 0").select("fam", "comp", low.alias("low"), (low + F.col("own")).alias("high"), (F.col("pool") + F.col("large")).alias("total"), F.lit(False).alias("pooled"))
    return small.unionByName(large)


def linked_in_families(families: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of each family; exact, whatever the family's size."""
    placed = families.select(F.col("node").alias("cls"), F.col("comp").alias("fam"))
    placed = placed.join(comps.withColumnRenamed("node", "cls"), "cls", "left").join(classes.select("cls", "n"), "cls")
    placed = materialize(placed.select("cls", "fam", F.coalesce("comp", "cls").alias("comp"), "n"), "families")
    asked = placed.join(_blocks(placed), ["fam", "comp"])
    asked = asked.withColumn("own", F.col("low") + F.pmod(F.xxhash64("cls"), F.col("high") - F.col("low")))
    asked = asked.join(classes.select("cls", "regs", F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest")), "cls")
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("digest"), "text")
    found = asked.join(texts, F.col("rep_id").eqNullSafe(F.col("doc_id")) & (F.col("rep_digest") == F.col("digest")))
    sets = found.select("fam", "comp", "cls", "n", "regs", "own", "low", "high", "total", "pooled", _shingle_bytes("text").alias("shingles"))
    sets = materialize(sets.groupBy("cls").agg(*[F.first(c).alias(c) for c in sets.columns if c != "cls"]), "family_sets")
    others = F.filter(
        F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1),
        lambda o: F.col("pooled") | (o < F.col("low")) | (o >= F.col("high")),
    )
    units = sets.withColumn("other", F.explode(others))
    units = units.select("fam", "comp", "cls", "n", "regs", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "shingles")
    return materialize(units.groupBy("fam", "i", "j").applyInArrow(_linked, PAIR).distinct(), "links")


# components -----------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the smallest node reachable.

    Each round points every node to its smallest neighbour, follows pointers
    once, and contracts the edges; the number of nodes at least halves.
    """
    edge = edges.select("a", "b").where("a <> b").distinct()
    out = None
    while True:
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "pointers")
        next_ = near.select(F.col("a").alias("to"), F.col("to").alias("on"))
        jump = materialize(near.join(next_, "to").select("a", F.col("on").alias("to")), "pointers")
        if out is None:
            out = jump.select(F.col("a").alias("node"), F.col("to").alias("comp"))
        else:
            step = jump.select(F.col("a").alias("comp"), F.col("to").alias("on"))
            out = out.join(step, "comp", "left").select("node", F.coalesce("on", "comp").alias("comp"))
        low = jump.select("a", F.col("to").alias("x"))
        high = jump.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edge = edge.join(low, "a").join(high, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        edge = materialize(edge.distinct(), "edges")
        if edge.isEmpty():
            break
    # a contracted node's label is a node of its component, not always the smallest
    out = materialize(out, "components")
    least = out.groupBy("comp").agg(F.min("node").alias("least"))
    return out.join(least, "comp").select("node", F.col("least").alias("comp"))


# documents ------------------------------------------------------------------


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component_id, kept for every row."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("digest"), sketch("text").alias("s")).select("doc_id", "digest", "s.*")
    rows = materialize(rows, "sketches")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    classes = rows.where("n > 0").groupBy("cls").agg(rep.alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = materialize(classes, "classes")
    members = _members(classes)
    star = members.where("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct()
    likely = materialize(_likely(star, classes), "likely")
    links = verified(likely, classes, docs)
    families = components(likely)
    more = materialize(_rest(members, classes, families), "likely")
    if not more.isEmpty():
        families = components(likely.unionByName(more))
    links = links.unionByName(linked_in_families(families, components(links), classes, docs))
    comps = components(links)
    of_class = classes.select("cls", F.col("rep.doc_id").alias("least_id")).join(comps.withColumnRenamed("node", "cls"), "cls", "left")
    of_class = of_class.select("cls", "least_id", F.coalesce("comp", "cls").alias("comp"))
    smallest = of_class.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    labels = materialize(of_class.join(smallest, "comp").select("cls", "component_id"), "labels")
    # documents without shingles are in no class; their key only spreads them
    key = F.coalesce(F.col("cls"), F.xxhash64("doc_id", "digest"))
    rows = rows.select("doc_id", "digest", "n", key.alias("cls"))
    found = rows.join(labels, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        "digest",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, with the input's columns."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["_kept_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["_kept_digest"])
    return docs.join(kept, same, "left_semi")
