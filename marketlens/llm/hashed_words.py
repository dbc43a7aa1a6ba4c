"""Words of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash

from .text_parts import Cutter, steps

#: Sorts of hash no word has: a word holds no blank.
END = xxhash.xxh3_64_intdigest(b" end")
START = xxhash.xxh3_64_intdigest(b" start")

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_CUT = Cutter()


def hashed_words(texts: pa.Array | Sequence[str | None], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in turn and the number for each text; with ``end``, one END after each.

    Words have A-Z in lower case and end at ASCII white space alone; null is empty.
    """
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    out, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for some in steps(texts.cast(pa.string())):
        parts = _CUT(some)
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in parts.distinct.to_pylist()], np.uint64)[parts.which]
        if end:
            h = np.insert(h, np.cumsum(parts.counts), np.uint64(END))
        out.append(h)
        counts.append(parts.counts + end)
    return np.concatenate(out), np.concatenate(counts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its beginning and its next word."""
    with np.errstate(over="ignore"):
        return mix(left * _GOLDEN + right)
