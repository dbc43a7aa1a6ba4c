"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Training bigrams are counted over the whole corpus. A count c is quantised to
the level 1 + floor(log2 c), and the bigram is put into a Bloom filter once for
each level up to its own. A lookup probes levels 1, 2, ... until one is absent;
the last present level gives the count, never too low and, but for false
positives, its lower power of two. Scores interpolate it with the exact unigram
estimate by a Dirichlet prior of weight ``mu``:

    p(w | v) = (count(vw) + mu * p(w)) / (count(v) + mu)

Unigram counts are exact. Texts are dealt into chunks of bounded size; each
chunk's distinct words are counted where the word lives (by hash) and come back
in sorted order, so no table of all words is ever in one place.

The filter is built in segments, one for each shuffle bucket, with a fixed
number of bits per entry, so its error does not depend on the size of the
corpus and nothing is left out. Segments are broadcast in shards of at most
``shard_mb``; a token's score needs one shard only, so a filter of several
shards takes one pass over the texts for each and the parts are added up.

Words are told apart by 64-bit hashes, bigrams by 48-bit ones. Defined results:
a null text is empty (its end token alone); a null id counts as "" when texts
are held out; rows are scored each, repeated ones alike; without training
texts every probability is 1; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import materialize
from .common import id_remainder, partitions
from .hashed_words import START, chain, hashed_words, mix

KEY_BITS = 48
_KEY = np.uint64(64 - KEY_BITS)
_PROBES = 4
_LEVEL = np.uint64(0xD6E8FEB86659FD93)


def bigrams(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Key of each token with the token before it; texts begin after START."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = np.uint64(START)
    return chain(before, h) >> _KEY


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bucket of keys of so many bits; ascending in the key."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _slices(sorted_keys: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted keys that lie in each bucket."""
    at = bucket_of(sorted_keys, bits, buckets)
    cuts = np.flatnonzero(np.diff(at)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(at)]):
        if b > a:
            yield int(at[a]), slice(int(a), int(b))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


# exact unigram counts -------------------------------------------------------


def _word_packs(buckets: int) -> Callable:
    """Distinct words of each chunk in a batch, with their training counts, by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk, learn = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            h, n = hashed_words(b.column(2), end=True)
            starts, rows = _starts(n), []
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order])) + 1
            for docs in np.split(order, cuts):
                if not len(docs):
                    continue
                words = np.concatenate([h[starts[d] : starts[d] + n[d]] for d in docs])
                learnt = np.repeat(learn[docs], n[docs]).astype(np.int64)
                keys, counts = _summed(words, learnt)
                for bucket, part in _slices(keys, 64, buckets):
                    rows.append((bucket, int(chunk[docs[0]]), keys[part].tobytes(), counts[part].astype("<u4").tobytes()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.record_batch(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                names=["bucket", "chunk", "keys", "counts"],
            )

    return run


def _count_words(packs: pa.Table) -> pa.Table:
    """All packs of a bucket: the training counts of each chunk's words in it, in the words' order."""
    keys = [np.frombuffer(k, "<u8") for k in packs.column("keys").to_pylist()]
    counts = [np.frombuffer(c, "<u4").astype(np.int64) for c in packs.column("counts").to_pylist()]
    words, total = _summed(np.concatenate(keys), np.concatenate(counts))
    chunk = packs.column("chunk").to_numpy()
    order = np.argsort(chunk, kind="stable")
    out, chunks = [], []
    for mine in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
        own = np.unique(np.concatenate([keys[i] for i in mine]))
        chunks.append(int(chunk[mine[0]]))
        out.append(total[np.searchsorted(words, own)].astype("<i8").tobytes())
    first = [int(total.sum())] + [0] * (len(out) - 1)
    known = [int((total > 0).sum())] + [0] * (len(out) - 1)
    bucket = packs.column("bucket")[0].as_py()
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.int64()),
            "bucket": pa.array([bucket] * len(out), pa.int32()),
            "counts": pa.array(out, pa.binary()),
            "n_tokens": pa.array(first, pa.int64()),
            "n_words": pa.array(known, pa.int64()),
        }
    )


def word_counts(texts: DataFrame, buckets: int) -> DataFrame:
    packs = texts.select("chunk", "learn", "text").mapInArrow(
        _word_packs(buckets), "bucket int, chunk bigint, keys binary, counts binary"
    )
    counted = packs.groupBy("bucket").applyInArrow(
        _count_words, "chunk bigint, bucket int, counts binary, n_tokens bigint, n_words bigint"
    )
    return materialize(counted, "word_counts")


# the filter -----------------------------------------------------------------


def _bigram_packs(buckets: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = hashed_words(b.column(0), end=True)
            keys, counts = np.unique(bigrams(h, _starts(n)), return_counts=True)
            rows = [
                (bucket, (keys[p] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (keys[p] >> np.uint64(32)).astype("<u2").tobytes(), counts[p].astype("<u4").tobytes())
                for bucket, p in _slices(keys, KEY_BITS, buckets)
            ]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.record_batch(
                [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "low", "high", "counts"]
            )

    return run


def _places(keys: np.ndarray, level: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of an entry: all its probes lie in one 64-bit word of the segment."""
    with np.errstate(over="ignore"):
        x = mix(keys + np.uint64(level) * _LEVEL)
    mask = np.zeros(len(x), np.uint64)
    for i in range(_PROBES):
        mask |= np.uint64(1) << (x >> np.uint64(6 * i) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.asarray(words, np.uint64) >> np.uint64(32)).astype(np.int64), mask


def build_segment(keys: np.ndarray, counts: np.ndarray, bits_per_entry: float) -> np.ndarray:
    """Bloom filter of a bucket's keys, each at all levels up to that of its count."""
    levels = np.floor(np.log2(counts)).astype(np.int64) + 1
    words = max(1, int(np.ceil(levels.sum() * bits_per_entry / 64)))
    out = np.zeros(words, np.uint64)
    for level in range(1, int(levels.max()) + 1):
        at, mask = _places(keys[levels >= level], level, words)
        np.bitwise_or.at(out, at, mask)
    return out


def probe(segments: np.ndarray, base: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Level of each key, 0 if absent: probe level after level until one is missing."""
    out = np.zeros(len(keys), np.int64)
    live, level = np.arange(len(keys)), 0
    while len(live):
        level += 1
        at, mask = _places(keys[live], level, size[live])
        live = live[segments[base[live] + at] & mask == mask]
        out[live] = level
    return out


def _segment_table(bits_per_entry: float) -> Callable[[pa.Table], pa.Table]:
    def run(packs: pa.Table) -> pa.Table:
        parts = zip(packs.column("low").to_pylist(), packs.column("high").to_pylist(), packs.column("counts").to_pylist())
        keys, counts = [], []
        for low, high, n in parts:
            keys.append(np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32))
            counts.append(np.frombuffer(n, "<u4").astype(np.int64))
        bits = build_segment(*_summed(np.concatenate(keys), np.concatenate(counts)), bits_per_entry)
        return pa.table(
            {
                "bucket": pa.array([packs.column("bucket")[0].as_py()], pa.int32()),
                "n_words": pa.array([len(bits)], pa.int64()),
                "bits": pa.array([bits.tobytes()], pa.binary()),
            }
        )

    return run


def build_filter(texts: DataFrame, buckets: int, bits_per_entry: float) -> DataFrame:
    """A written table with one filter segment per bucket that has bigrams."""
    packs = texts.where("learn").select("text").mapInArrow(
        _bigram_packs(buckets), "bucket int, low binary, high binary, counts binary"
    )
    return materialize(
        packs.groupBy("bucket").applyInArrow(_segment_table(bits_per_entry), "bucket int, n_words bigint, bits binary"), "filter"
    )


def shards(segments: DataFrame, buckets: int, shard_mb: int) -> list[tuple[int, int]]:
    """Ranges of buckets whose segments together take at most ``shard_mb`` (one segment at least)."""
    sizes = {r["bucket"]: r["n_words"] * 8 for r in segments.select("bucket", "n_words").collect()}
    out, begin, held = [], 0, 0
    for bucket in range(buckets):
        size = sizes.get(bucket, 0)
        if held and held + size > shard_mb << 20:
            out.append((begin, bucket))
            begin, held = bucket, 0
        held += size
    return [*out, (begin, buckets)]


def _load(segments: DataFrame, begin: int, end: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    rows = segments.where((F.col("bucket") >= begin) & (F.col("bucket") < end)).collect()
    size, parts = np.zeros(end - begin, np.int64), {}
    for r in rows:
        size[r["bucket"] - begin] = r["n_words"]
        parts[r["bucket"]] = np.frombuffer(r["bits"], "<u8")
    held = [parts[b] for b in sorted(parts)] or [np.zeros(1, np.uint64)]
    return begin, end, np.cumsum(size) - size, size, np.concatenate(held)


# scores ---------------------------------------------------------------------

SCORED = "doc_id bigint, digest bigint, copy int, held_out boolean, n_tokens bigint, n_known bigint, base_score double, part double"


def _score_chunk(shard, buckets: int, total: int, distinct: int, mu: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        begin, end, base, size, segments = shard.value
        texts = docs.column("text").to_pylist()
        h, n = hashed_words(texts, end=True)
        starts = _starts(n)
        order = np.argsort(counted.column("bucket").to_numpy())
        packs = counted.column("counts").to_pylist()
        own, place = np.unique(h, return_inverse=True)
        counts = np.concatenate([np.frombuffer(packs[i], "<i8") for i in order])
        if len(counts) != len(own):
            raise RuntimeError(f"{len(own)} words in a chunk, {len(counts)} counted")
        c = counts[place].astype(np.float64)
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[starts] = c[starts + n - 1]  # texts begin as often as they end
        unigram = (c + 0.5) / (total + 0.5 * (distinct + 1))
        keys = bigrams(h, starts)
        bucket = bucket_of(keys, KEY_BITS, buckets)
        mine = (bucket >= begin) & (bucket < end)
        asked = np.flatnonzero(mine & (c > 0) & (before > 0))
        asked = asked[size[bucket[asked] - begin] > 0]
        where = bucket[asked] - begin
        level = probe(segments, base[where], size[where], keys[asked])
        seen = np.zeros_like(c)
        seen[asked] = np.where(level > 0, np.minimum(np.exp2(level - 1.0), np.minimum(c[asked], before[asked])), 0.0)
        model = np.where(mine, np.log10((seen + mu * unigram) / (before + mu)), 0.0)
        ids, digests, copies, met = docs.column("doc_id").to_pylist(), [], [], {}
        for i, text in enumerate(texts):
            data = (text or "").encode()
            digest = zlib.crc32(data) << 31 | zlib.adler32(data) >> 1
            copies.append(met.get((ids[i], digest), 0))
            met[ids[i], digest] = copies[-1] + 1
            digests.append(digest)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "digest": pa.array(digests, pa.int64()),
                "copy": pa.array(copies, pa.int32()),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                "base_score": pa.array(np.add.reduceat(np.log10(unigram), starts)),
                "part": pa.array(np.add.reduceat(model, starts)),
            }
        )

    return run


def score_documents(
    docs: DataFrame, mu: float = 20.0, bits_per_entry: float = 10.0, shard_mb: int = 64, chunk_mb: float = 3.0
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, round(size / (chunk_mb * (1 << 20))))
    held = id_remainder() == 1
    texts = docs.select(
        "doc_id",
        "text",
        held.alias("held_out"),
        (~held).alias("learn"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"),
    )
    counted = word_counts(texts, buckets)
    sums = counted.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    total, distinct = sums[0] or 0, sums[1] or 0
    segments = build_filter(texts, buckets, bits_per_entry)
    sides = texts.select("chunk", "doc_id", "held_out", "text").groupBy("chunk").cogroup(
        counted.select("chunk", "bucket", "counts").groupBy("chunk")
    )
    parts = None
    for begin, end in shards(segments, buckets, shard_mb):
        shard = spark.sparkContext.broadcast(_load(segments, begin, end))
        part = sides.applyInArrow(_score_chunk(shard, buckets, total, distinct, mu), SCORED)
        parts = part if parts is None else parts.unionByName(part)
    same = ["doc_id", "held_out", "n_tokens", "n_known"]
    scored = parts.groupBy("digest", "copy", *same).agg(F.first("base_score").alias("base_score"), F.sum("part").alias("score"))
    return scored.select(*same, F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
