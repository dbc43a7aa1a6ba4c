"""Exact token counts of every prefix of a text, by dynamic programming.

For a vocabulary merged by score, a sequence of pieces is what the tokenizer
makes of a text exactly if each piece stands for itself and each two neighbours
stay apart when encoded alone: a merge across a border would use nothing but
the two pieces beside it. So of all pieces that end at a position one alone
agrees with the last piece of the prefix before it, and

    tokens(prefix of i) = tokens(prefix of i - length of that piece) + 1.

One pass from left to right gives the count of every prefix, bounded by the
longest piece at each position; which neighbours stay apart is remembered.

Two characters that no piece holds side by side are never merged across.
Texts are cut at all such borders and the counts of a part are kept, within
bounded bytes, so a text is put together from known parts.

What is stored per text is the change of the count at each code point (one
byte each where they fit, which they do in every vocabulary of short pieces;
else four), so questions of truncation and budget are running sums over the
stored steps and nothing is encoded again: :func:`tokens_at`,
:func:`longest_prefix`, :func:`truncate`.

Defined results: null and empty texts have no tokens and a table without steps;
characters without a piece count their UTF-8 bytes; special strings inside a
text are ordinary characters; very long texts take linear time, with or without
blanks; rows that repeat an id are counted each; other columns are kept and do
not matter; an empty table gives no rows. A model that rewrites characters or
drops blanks is refused (``ValueError``), since its prefixes are not prefixes
of the text.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_parts import Kept, steps

#: What a blank becomes.
BLANK = "▁"
#: Bytes of parts kept by one Python worker.
KEPT_BYTES = 16 << 20

TABLE = T.StructType().add("n_tokens", "long").add("width", "integer").add("steps", "binary")


class Pieces:
    """A vocabulary of pieces merged by score, and the counts of all prefixes of a string of it."""

    #: Neighbours remembered by one Python worker.
    REMEMBERED = 200_000

    def __init__(self, scores: dict[str, float]):
        self.pieces, self.scores = list(scores), list(scores.values())
        self.number = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, scores), default=1)
        #: characters that some piece holds side by side
        self.joined = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.apart: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short string: best score first, leftmost of equals."""
        parts, number, scores = list(text), self.number, self.scores
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                piece = number.get(parts[i] + parts[i + 1])
                if piece is not None and (at < 0 or scores[piece] > best):
                    best, at = scores[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int, piece: int) -> bool:
        """Whether the piece can follow ``before`` (-1: a border that nothing crosses)."""
        pair = (before + 1) * len(self.pieces) + piece
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) >= self.REMEMBERED:
                self.apart.clear()
            alone = [self.pieces[i] for i in (before, piece) if i >= 0]
            known = self.apart[pair] = self.merged("".join(alone)) == alone
        return known

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of each prefix of ``text``, the empty one included."""
        number, longest, fits = self.number, self.longest, self.fits
        counts, last = [0], [-1]
        for end in range(1, len(text) + 1):
            for size in range(1, min(longest, end) + 1):
                piece = number.get(text[end - size : end])
                if piece is not None and fits(last[end - size], piece):
                    counts.append(counts[end - size] + 1)
                    last.append(piece)
                    break
            else:  # a character without a piece, in bytes; nothing merges with it
                counts.append(counts[end - 1] + len(text[end - 1].encode()))
                last.append(-1)
        return counts

    def steps(self, text: str) -> list[int]:
        """Change of the count at each character."""
        counts = self.prefix_counts(text)
        return [b - a for a, b in zip(counts, counts[1:])]


class Borders:
    """Finds where no piece holds the characters on both sides, in many texts at a time."""

    def __init__(self, pieces: Pieces):
        known = sorted({c for pair in pieces.joined for c in pair} | {BLANK})
        number = {c: i + 1 for i, c in enumerate(known)}  # 0: characters that never merge
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.kind[ord(" ")] = number[BLANK]
        self.joins = np.zeros((len(known) + 1, len(known) + 1), bool)
        pairs = np.array([(number[a], number[b]) for a, b in pieces.joined], np.int64).reshape(-1, 2)
        self.joins[pairs[:, 0], pairs[:, 1]] = True

    def apart(self, code: np.ndarray) -> np.ndarray:
        """For each code point whether there is a border before it."""
        kind = self.kind[code]
        out = np.ones(len(code), bool)
        out[1:] = ~self.joins[kind[:-1], kind[1:]]
        return out


def load_pieces(path: str) -> Pieces:
    """The ordinary pieces of a sentencepiece model file and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " a  ﬁ\tÅ　b\n "
    if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
        raise ValueError(f"{path} rewrites texts; prefixes of what it encodes are not prefixes of the text")
    ids = range(model.get_piece_size())
    odd = [i for i in ids if model.is_unused(i)]
    if odd or model.encode("\n") != model.encode("") + model.encode("a\n")[-1:]:
        raise ValueError(f"{path} has unused pieces or no bytes to fall back to")
    plain = (i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return Pieces({model.id_to_piece(i): model.get_score(i) for i in plain})


class PrefixTables:
    """Steps of whole texts, put together from those of known parts."""

    def __init__(self, pieces: Pieces, kept_bytes: int = KEPT_BYTES, narrow: int = 126):
        self.pieces, self.borders, self.narrow = pieces, Borders(pieces), narrow
        self.kept = Kept(lambda parts: [self._narrow(p) for p in parts], kept_bytes)

    def _steps(self, part: bytes) -> list[int]:
        return self.pieces.steps(part.decode().replace(" ", BLANK))

    def _narrow(self, part: bytes) -> bytes:
        """Steps of a part as single bytes; nothing if one does not fit."""
        steps = self._steps(part)
        return bytes([s & 255 for s in steps]) if max(steps) <= self.narrow and min(steps) >= -self.narrow else b""

    def tables(self, texts: pa.Array) -> pa.StructArray:
        """``TABLE`` of each text."""
        # a blank leads each text, as the model has it
        texts = pc.binary_join_element_wise("", pc.replace_substring(pc.fill_null(texts, ""), BLANK, " "), " ")
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        at = np.flatnonzero((data & 0xC0) != 0x80)  # bytes where characters begin
        first = np.searchsorted(at, ends[:-1] - ends[0])  # each text's first character
        apart = self.borders.apart(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32))
        apart[first] = True
        offsets = np.append(at[apart], len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        known = self.kept(parts.dictionary)
        if pc.min(pc.binary_length(known)).as_py() != 0:
            # the steps of all parts in turn are those of all characters in turn
            taken = known.take(parts.indices)
            steps = np.frombuffer(taken.buffers()[2], np.int8)[: len(at)].copy()
        else:
            wide = [self._steps(p) for p in parts.dictionary.to_pylist()]
            steps = np.concatenate([wide[i] for i in parts.indices.to_pylist()]).astype(np.int32)
        # the first character takes over the blank's step
        size = np.diff(np.append(first, len(at)))
        longer = first[size > 1]
        steps[longer + 1] += steps[longer]
        steps = np.delete(steps, first)
        ends = np.concatenate([[0], np.cumsum(size - 1)])
        total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
        tokens = total[ends[1:]] - total[ends[:-1]]
        width = np.full(len(size), steps.dtype.itemsize, np.int32)
        where = (ends * steps.dtype.itemsize).astype(np.int32)
        stored = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(where), pa.py_buffer(steps)])
        return pa.StructArray.from_arrays([pa.array(tokens), pa.array(width), stored], names=TABLE.names)


_TABLES: dict[str, PrefixTables] = {}


def prefix_tables(docs: DataFrame, path: str, out: str = "prefix") -> DataFrame:
    """``docs`` with a column of type ``TABLE``: the count of every prefix of ``text``, and of the whole."""

    @F.arrow_udf(TABLE)
    def table_of(texts: pa.Array) -> pa.Array:
        if path not in _TABLES:
            _TABLES[path] = PrefixTables(load_pieces(path))
        found = [_TABLES[path].tables(some) for some in steps(texts.cast(pa.string()))]
        return pa.concat_arrays(found) if found else pa.array([], pa.struct([("n_tokens", pa.int64()), ("width", pa.int32()), ("steps", pa.binary())]))

    return docs.withColumn(out, table_of("text"))


def _counts(steps: bytes, width: int) -> np.ndarray:
    """Tokens of the prefixes of 1, 2, ... code points."""
    return np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)


@F.arrow_udf(T.LongType())
def _at(steps: pa.Array, width: pa.Array, chars: pa.Array) -> pa.Array:
    out = []
    for s, w, c in zip(steps, width.to_pylist(), chars.to_pylist()):
        counts = np.frombuffer(s.as_py() or b"", f"<i{w or 1}")
        out.append(None if c is None else int(counts[: max(c, 0)].sum(dtype=np.int64)))
    return pa.array(out, pa.int64())


@F.arrow_udf(T.LongType())
def _longest(steps: pa.Array, width: pa.Array, tokens: pa.Array, budget: pa.Array) -> pa.Array:
    out = []
    for s, w, n, most in zip(steps, width.to_pylist(), tokens.to_pylist(), budget.to_pylist()):
        if most is None or n is None:
            out.append(None)
        elif n <= most:
            out.append(len(s.as_buffer()) // w)
        else:
            within = np.flatnonzero(_counts(s.as_py(), w) <= most)
            out.append(int(within[-1]) + 1 if len(within) else 0)
    return pa.array(out, pa.int64())


def tokens_at(table: Column, chars: Column) -> Column:
    """Tokens of the prefix of ``chars`` code points (of the whole text, if it is shorter)."""
    return _at(table["steps"], table["width"], chars.cast("bigint"))


def longest_prefix(table: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix that is at most ``budget`` tokens (a count may fall as a prefix grows)."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    return _longest(table["steps"], table["width"], table["n_tokens"], budget.cast("bigint"))


def truncate(tabled: DataFrame, budget: Column | int, table: str = "prefix") -> DataFrame:
    """``text`` cut to its longest prefix within ``budget`` tokens."""
    return tabled.withColumn("text", F.substring("text", F.lit(1), longest_prefix(F.col(table), budget).cast("int")))


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_chars (what of the text the limit allows) for every row."""
    rows = prefix_tables(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path)
    table = F.col("prefix")
    return rows.select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        table["n_tokens"].alias("n_tokens"),
        (table["n_tokens"] > limit).alias("over_limit"),
        longest_prefix(table, limit).alias("limit_chars"),
    )
