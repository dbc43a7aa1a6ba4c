"""Mixture-controlled packing of token sequences by deficit round-robin.

Every source is a queue of documents. In each round a queue's deficit grows by
its quantum (its target share of one window) and it sends what the deficit
covers, cutting documents where the quantum ends. Token k of a queue is
therefore sent in round ceil(k / quantum), whatever the other queues do, so
rounds need no sequential pass: a distributed running sum gives each document
its place in its queue, documents are cut at the bounds of their queue's rounds,
the pieces are sorted by (round, source, place in queue), a second running sum
gives each its place in the stream, and the stream is cut into windows. So every
full window, not only their sum, has the target proportions, but for one token a
source. All windows but the last are full.

A queue whose quantum is below ``LEAST_PIECE`` tokens would send single words.
It saves up over as many rounds as give it that many tokens and then sends them
at once; queues that save up over equally many rounds are numbered and take
their turns in as many groups, so they do not all send together. No piece is longer than the larger of the
quantum and ``LEAST_PIECE`` plus one quantum, or than ``chunk`` if given.

Without ``weights`` a source's target is its share of all tokens, so all queues
run dry in the same round. With weights a queue that runs dry leaves the round
and the others go on; a source without a weight comes last.

Defined results: a null text is the empty text (one token, the closing id); a
null source is a queue of its own; a very long text is encoded and cut whole; rows
are packed each, repeated ids included;
an empty table gives no pieces; other columns do not matter.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import global_row_number, running_sum
from ..functions.staging import materialize
from .text_parts import Cutter, Kept, steps

#: Ends each document.
CLOSING_ID = 1
WINDOW = 2048
#: A queue sends at least so many tokens at once, the ends of documents aside.
LEAST_PIECE = 16

#: Bytes of known parts kept by one Python worker.
KEPT_BYTES = 24 << 20
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: All ASCII symbols but those of contractions and of special tokens.
_PUNCTUATION = b".,;:!?\"#$%&()*+-/=@[\\]^_`{}~"
#: What byte-level tokenizers write for each byte; a blank stays.
_WRITTEN = np.array([b if chr(b).isprintable() and b not in (0x20, 0xAD) else 0 for b in range(256)], np.uint16)
_WRITTEN[_WRITTEN == 0] = 0x100 + np.arange((_WRITTEN == 0).sum())
_WRITTEN[0x20] = 0x20
#: Bytes that no word of the letters a-z and U+00C0 to U+017F holds.
_FOREIGN = np.ones(256, bool)
_FOREIGN[[*_LETTERS, *b" \xc3\xc4\xc5", *range(0x80, 0xC0)]] = False
#: Stands between parts that are encoded together; its id comes from nothing else. So many at a time.
_BETWEEN, _TOGETHER = b"7", 2000
#: What shows whether a tokenizer can be given texts in lower-case parts.
_PROBES = (
    "Ab CD\tef\n\ngh  ij.",
    "It's, we're;they'll e.g. U.S. (x),'s 3.5 a,b 10:30!? ...",
    "Ünï ÇA É\u0301a \u00a0x\u3000y Ως 漢字,かな 😀. a\u0301,",
    "<|endoftext|>. <a>,b <|x|>",
    "a\"b#c$d%e&f(g)h*i+j-k/l=m@n[o\\p]q^r_s`t{u}v~w ###x'x -'s _é_ ==\u0338y ü*** 5%a a%5",
    "École naïve ŒUVRE Ÿ ÀÖØÝ×÷ıİĲŉſt ß ŁÓDŹ aé'tİ éa\u0301",
)

_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts as bytes, with the ids of their parts kept.

    Texts are cut at white space and between ASCII letters and punctuation, and
    A-Z count in lower case. That is right for a tokenizer whose own splitting
    does both; ``load`` refuses others (``ValueError``).
    """

    def __init__(self, tokenizer, kept_bytes: int = KEPT_BYTES):
        self.tokenizer = tokenizer
        self.type = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cutter, self.kept = Cutter(_LETTERS, _PUNCTUATION), Kept(self._ids, kept_bytes)
        ids = tokenizer.encode(_BETWEEN.decode(), add_special_tokens=False).ids
        if len(ids) != 1:
            raise ValueError("the tokenizer has no id for a digit of its own")
        self.between = ids[0]
        self.direct = self._words_need_no_splitting()

    def _words_need_no_splitting(self) -> bool:
        """Whether the merges alone give the ids of a word as it is written."""
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = self._words([*" ".join(_PROBES).lower().encode().split(), b"s", b"zq", "thélongestwordofœll".encode()])[1]
        whole = [self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
        return not any(t.isalpha() for t in added) and whole == [[t.id for t in self.tokenizer.model.tokenize(w)] for w in self._written(words)]

    @staticmethod
    def _words(parts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Which parts are words of the letters a-z and U+00C0 to U+017F, and these."""
        data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
        foreign = _FOREIGN.take(data)
        behind = data[1:]
        # two signs, and the one letter that is two in lower case
        foreign[1:] |= ((data[:-1] == 0xC3) & ((behind == 0x97) | (behind == 0xB7))) | ((data[:-1] == 0xC4) & (behind == 0xB0))
        begins = np.append(0, np.flatnonzero(data == 0x20)[:-1] + 1)
        which = np.flatnonzero(~np.logical_or.reduceat(foreign, begins))
        return which, [parts[i] for i in which.tolist()]

    @staticmethod
    def _written(words: list[bytes]) -> list[str]:
        """The words in lower case, each byte as ``_WRITTEN``."""
        text = b" ".join(words).decode().lower().encode()
        return _WRITTEN.take(np.frombuffer(text, np.uint8)).astype("<u2").tobytes().decode("utf-16-le").split(" ") if words else []

    @classmethod
    def load(cls, path: str) -> WordEncoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = cls(Tokenizer.from_file(path))
        for probe in _PROBES:
            whole = encoder.tokenizer.encode(probe, add_special_tokens=False).ids
            if np.frombuffer(encoder.encode(pa.array([probe]))[0].as_py(), encoder.type).tolist() != [*whole, CLOSING_ID]:
                raise ValueError(f"{path} does not split texts at white space and punctuation, or tells A from a")
        return encoder

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part. Words go to the merges as they are; others are encoded as texts, told apart by a digit. Many at a time."""
        out: list[bytes] = [b""] * len(parts)
        merge, size, rest = self.tokenizer.model.tokenize, self.type.itemsize, np.ones(len(parts), bool)
        if self.direct and parts:
            which, words = self._words(parts)
            rest[which] = False
            found = [merge(word) for word in self._written(words)]
            ends = (size * np.cumsum([len(tokens) for tokens in found])).tolist()
            data = np.array([t.id for tokens in found for t in tokens], self.type).tobytes()
            for i, a, b in zip(which.tolist(), [0, *ends], ends):
                out[i] = data[a:b]
        others = np.flatnonzero(rest).tolist()
        single = [i for i in others if _BETWEEN in parts[i]]
        joined = [i for i in others if _BETWEEN not in parts[i]]
        for i, e in zip(single, self.tokenizer.encode_batch_fast([parts[i].decode() for i in single], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.type).tobytes()
        for at in range(0, len(joined), _TOGETHER):
            some = joined[at : at + _TOGETHER]
            text = (b" " + _BETWEEN + b" ").join([parts[i] for i in some]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            cuts = np.flatnonzero(ids == self.between)
            if len(cuts) != len(some) - 1:
                raise ValueError("the tokenizer does not keep parts between blanks apart")
            data = ids.tobytes()
            begins, ends = [0, *(size * (cuts + 1)).tolist()], [*(size * cuts).tolist(), len(data)]
            for i, a, b in zip(some, begins, ends):
                out[i] = data[a:b]
        return out

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text and the closing id."""
        return pa.concat_arrays([self._encode(some) for some in steps(texts)]) if len(texts) else pa.array([], pa.binary())

    def _encode(self, texts: pa.Array) -> pa.Array:
        size, parts = self.type.itemsize, self.cutter(texts)
        known = self.kept(parts.distinct)
        length = pc.binary_length(known).to_numpy()[parts.which] if len(known) else np.empty(0, np.int32)
        upto = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[np.concatenate([[0], np.cumsum(parts.counts)])]
        taken = known.take(pa.array(parts.which))
        ids = np.frombuffer(taken.buffers()[2] or b"", self.type, upto[-1] // size)
        ids = np.insert(ids, upto[1:] // size, self.type.type(CLOSING_ID))
        offsets = (upto + size * np.arange(len(upto))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def _width(path: str) -> int:
    """Bytes that hold any id of the tokenizer."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def encode(docs: DataFrame, path: str) -> DataFrame:
    """A written table: row (a number of its own), doc_id, source, n_tokens, ids (little-endian bytes)."""
    width = _width(path)

    @F.arrow_udf(T.BinaryType())
    def ids_of(texts: pa.Array) -> pa.Array:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder.load(path)
        return _ENCODERS[path].encode(texts.cast(pa.string()))

    ids = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        ids_of("text").alias("ids"),
    )
    return materialize(ids.withColumn("n_tokens", (F.length("ids") / width).cast("bigint")), "token_ids")


def _queues(chunks: DataFrame, weights: Mapping[str, float] | None, window: int) -> DataFrame:
    """Where each source's queue starts in the order of all queues, its quantum, the rounds it saves up over, and its turn in them."""
    queues = chunks.groupBy("source").agg(
        F.sum("length").alias("tokens"), F.min(F.col("upto") - F.col("length")).alias("before")
    )
    if weights is None:
        total = chunks.agg(F.sum("length")).scalar()
        share = F.col("tokens") / total
    else:
        share = F.lit(None).cast("double")
        for source, weight in weights.items():
            share = F.when(F.col("source") == source, F.lit(float(weight) / sum(weights.values()))).otherwise(share)
    # a source without a weight comes last and sends window by window
    rounds = F.coalesce(F.greatest(F.lit(1), F.ceil(LEAST_PIECE / F.col("quantum"))), F.lit(1)).cast("bigint")
    queues = queues.select("source", "before", (window * share).alias("quantum")).withColumn("rounds", rounds)
    numbered = global_row_number(queues, [F.col("rounds"), F.col("source")], "number")
    return materialize(numbered.withColumn("phase", F.col("number") % F.col("rounds")).drop("number"), "queues")


def pack(
    encoded: DataFrame, window: int = WINDOW, chunk: int | None = None, weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Pieces (row, start, length, sequence_id, offset) of the written table ``encoded``."""
    documents = encoded.select("row", "source", F.col("n_tokens").alias("length"))
    # documents of a queue come in the order of a hash of their row number
    lined = running_sum(documents, [F.col("source"), F.xxhash64("row"), F.col("row")], {"length": "upto"})
    queued = lined.join(_queues(lined, weights, window), "source")
    quota = F.col("rounds") * F.coalesce("quantum", F.lit(float(window)))
    queued = queued.select(
        "row",
        "source",
        "quantum",
        "rounds",
        "phase",
        quota.alias("quota"),
        (F.col("upto") - F.col("length") - F.col("before")).alias("from"),
        (F.col("upto") - F.col("before")).alias("end"),
    )
    # tokens floor((turn - 1) * quota) to floor(turn * quota) of the queue make a turn; one more on
    # either side, since floors of products and of quotients may differ
    turns = F.sequence(F.greatest(F.lit(1), F.floor(F.col("from") / F.col("quota"))), F.floor(F.col("end") / F.col("quota")) + 2)
    cut = queued.withColumn("turn", F.explode(turns))
    low = F.greatest(F.col("from"), F.floor((F.col("turn") - 1) * F.col("quota")))
    high = F.least(F.col("end"), F.floor(F.col("turn") * F.col("quota")))
    cut = cut.withColumns({"low": low, "high": high}).where(F.col("low") < F.col("high"))
    place = F.when(F.col("quantum").isNotNull(), (F.col("turn") - 1) * F.col("rounds") + F.col("phase"))
    sent = cut.select("row", "source", place.alias("turn"), F.col("low").alias("end"), (F.col("low") - F.col("from")).alias("begin"), (F.col("high") - F.col("low")).alias("length"))
    if chunk:
        parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(chunk).cast("bigint")))
        sent = sent.withColumn("part", parts).select(
            "row", "source", "turn", (F.col("end") + F.col("part")).alias("end"), (F.col("begin") + F.col("part")).alias("begin"), F.least(F.lit(chunk), F.col("length") - F.col("part")).alias("length")
        )
    stream = running_sum(sent, [F.col("turn").isNull(), F.col("turn"), F.col("source"), F.col("end")], {"length": "to"})
    at = F.col("to") - F.col("length")
    first = F.floor(at / window)
    last = F.floor((F.col("to") - 1) / window)
    pieces = stream.select("row", "begin", "length", at.alias("at"), F.explode(F.sequence(first, last)).alias("sequence_id"))
    low = F.greatest(F.col("at"), F.col("sequence_id") * window)
    high = F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return pieces.select(
        "row",
        (F.col("begin") + low - F.col("at")).cast("bigint").alias("start"),
        (high - low).cast("bigint").alias("length"),
        "sequence_id",
        (low - F.col("sequence_id") * window).cast("bigint").alias("offset"),
    )


PLACE = T.StructType().add("start", "long").add("length", "long").add("sequence_id", "long").add("offset", "long")
PIECE = T.StructType([*PLACE.fields, T.StructField("ids_crc32", T.LongType())])


def with_checksums(pieces: DataFrame, encoded: DataFrame, width: int) -> DataFrame:
    """Join pieces to their document's ids (once per document) and add each piece's checksum."""

    @F.arrow_udf(T.ArrayType(PIECE))
    def check(ids: pa.Array, placed: pa.Array) -> pa.Array:
        _ENCODERS.clear()  # a worker that has encoded has no more use for its parts
        places = placed.flatten()
        start, length = (places.field(f).to_numpy() for f in ("start", "length"))
        begin, end = (4 * start).tolist(), (4 * (start + length)).tolist()
        ends = np.concatenate([[0], np.cumsum(placed.value_lengths().to_numpy())])
        sums = []
        for data, low, high in zip(ids, ends[:-1].tolist(), ends[1:].tolist()):
            tokens = memoryview(np.frombuffer(data.as_buffer(), f"<u{width}").astype("<u4")).cast("B")
            sums += [zlib.crc32(tokens[a:b]) for a, b in zip(begin[low:high], end[low:high])]
        fields = [places.field(f) for f in PLACE.names] + [pa.array(sums, pa.int64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=PIECE.names))

    by_row = pieces.groupBy("row").agg(F.collect_list(F.struct(*PLACE.names)).alias("pieces"))
    joined = encoded.join(by_row, "row").select("doc_id", "n_tokens", check("ids", "pieces").alias("pieces"))
    return joined.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.inline("pieces"))


def pack_documents(docs: DataFrame, path: str, **settings) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    encoded = encode(docs, path)
    return with_checksums(pack(encoded, **settings), encoded, _width(path))
