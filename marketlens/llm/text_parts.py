"""Cutting many texts into parts at once, and caches of parts bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text cut at a time.
STEP_BYTES = 1 << 20
#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Parts(NamedTuple):
    """Distinct parts, which of them each part is, in turn, and the number of parts of each text."""

    distinct: pa.BinaryArray
    which: np.ndarray
    counts: np.ndarray


class Cutter:
    """Cuts texts, A-Z in lower case, at blanks and between bytes of kinds that stand apart.

    ``kinds`` are sets of ASCII bytes that stand apart from each other; a byte
    in none of them stays with its neighbours.
    """

    def __init__(self, *kinds: bytes):
        self.kind = np.full(256, len(kinds) + 1, np.uint8)
        self.kind[list(BLANKS)] = 0
        for i, kind in enumerate(kinds):
            self.kind[list(kind)] = i + 1
        border = np.zeros((16, 16), bool)  # by the kinds before and behind
        some = len(kinds) + 1
        border[:some, :some] = ~np.eye(some, dtype=bool)
        border[0, some] = border[some, 0] = True
        self.border = border.ravel()

    def __call__(self, texts: pa.Array) -> Parts:
        """Parts of the texts of a string array; a null is empty."""
        texts = pc.fill_null(texts, "")
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or ends[-1] == ends[0]:
            return Parts(pa.array([], pa.binary()), np.empty(0, np.int32), np.zeros(len(texts), np.int64))
        data = _LOWER.take(np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]])
        kind = self.kind.take(data)
        begins = np.ones(len(data), bool)
        begins[1:] = self.border.take(kind[:-1] << 4 | kind[1:])
        begins[(ends[:-1] - ends[0])[ends[:-1] < ends[-1]]] = True
        solid = kind > 0
        begins &= solid
        counts = np.diff(np.searchsorted(np.flatnonzero(begins), ends - ends[0]))
        # without the blanks one part begins where the last one ends
        packed, begins = data[solid], begins[solid]
        offsets = np.append(np.flatnonzero(begins), len(packed)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        return Parts(parts.dictionary, parts.indices.to_numpy(), counts)


def steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Runs of texts of about so many bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    step = np.cumsum(sizes, dtype=np.int64) // step_bytes
    firsts = np.flatnonzero(np.diff(step, prepend=-1))
    for at, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(texts)]):
        yield texts.slice(at, end - at)
    pa.default_memory_pool().release_unused()


class Kept:
    """Values (bytes) of parts, found when first asked for and kept in bounded bytes.

    Most are kept in arrays, about 40 bytes an entry, and looked up for many parts
    at a time by two places that a part's hash gives it; the part itself is
    compared as well, and one whose places are both taken is not kept. New ones
    are gathered in a dictionary until there are ``GATHERED``. When the arrays
    take ``limit`` bytes, entries not asked for since the last time go.
    """

    LONGEST, GATHERED = 64, 20_000
    _FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    _ZOBRIST = np.random.default_rng(11).integers(0, 1 << 63, (LONGEST, 256), dtype=np.uint64).ravel()

    def __init__(self, find: Callable[[list[bytes]], Sequence[bytes]], limit: int):
        self.find, self.limit = find, limit
        self.recent: dict[bytes, bytes] = {}
        bits = max(8, (limit // 16).bit_length())
        self.shift, self.places = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        self.keys, self.values = pa.array([], pa.binary()), pa.array([], pa.binary())
        self.used = np.empty(0, bool)

    def _hash(self, parts: pa.BinaryArray) -> np.ndarray:
        """Hashes of parts; those longer than ``LONGEST`` count with their beginning."""
        ends = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
        data = np.frombuffer(parts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        begins, sizes = ends[:-1] - ends[0], np.diff(ends)
        place = np.arange(len(data), dtype=np.int32) - np.repeat(begins, sizes)
        if sizes.max(initial=0) > self.LONGEST:
            np.minimum(place, self.LONGEST - 1, out=place)
        return np.add.reduceat(self._ZOBRIST.take((place << 8) + data), begins)

    def _two_places(self, parts: pa.BinaryArray) -> Iterator[np.ndarray]:
        h = self._hash(parts)
        for factor in self._FACTORS:
            yield (h * factor >> self.shift).astype(np.int64)

    def __call__(self, parts: pa.BinaryArray) -> pa.Array:
        """The values of distinct parts, none of them empty."""
        if not len(parts):
            return parts
        at, known = np.zeros(len(parts), np.int64), np.zeros(len(parts), bool)
        if len(self.keys):
            left, asked = np.arange(len(parts)), parts
            for places in self._two_places(parts):
                found = self.places.take(places[left])
                same = pc.equal(self.keys.take(pa.array(np.maximum(found, 0))), asked).to_numpy(zero_copy_only=False) & (found >= 0)
                at[left[same]], known[left[same]] = found[same], True
                left = left[~same]
                asked = parts.take(pa.array(left))
            self.used[at[known]] = True
        rest = np.flatnonzero(~known)
        asked = parts.take(pa.array(rest)).to_pylist()
        found = list(map(self.recent.get, asked))
        new = [i for i, value in enumerate(found) if value is None]
        for i, value in zip(new, self.find([asked[i] for i in new]) if new else ()):
            found[i] = value
            if len(asked[i]) <= self.LONGEST:
                self.recent[asked[i]] = value
        at[rest] = len(self.values) + np.arange(len(rest))
        out = pa.chunked_array([self.values, pa.array(found, pa.binary())]).take(pa.array(at)).combine_chunks()
        if len(self.recent) >= self.GATHERED:
            self._settle()
        return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)

    def _settle(self) -> None:
        """Move the recent entries into the arrays."""
        if self.keys.nbytes + self.values.nbytes + len(self.used) + self.places.nbytes > self.limit:
            keys, values = (x.filter(pa.array(self.used)) for x in (self.keys, self.values))
            self.keys, self.values, self.used = keys.slice(0, 0), values.slice(0, 0), self.used[:0]
            self.places.fill(-1)
            self._add(keys, values)
            self.used.fill(False)
        self._add(pa.array(self.recent, pa.binary()), pa.array(self.recent.values(), pa.binary()))
        self.recent = {}

    def _add(self, keys: pa.BinaryArray, values: pa.BinaryArray) -> None:
        """Keep the entries for which there is a place."""
        if not len(keys):
            return
        taken = np.full(len(keys), -1, np.int64)
        for places in self._two_places(keys):
            trying = np.flatnonzero((taken < 0) & (self.places.take(places) < 0))
            self.places[places[trying]] = trying  # of several the last one stays
            got = trying[self.places.take(places[trying]) == trying]
            taken[got] = places[got]
            self.places[taken[got]] = len(self.used) + got
        kept = taken >= 0
        self.places[taken[kept]] = len(self.used) + np.arange(kept.sum())
        self.keys = pa.concat_arrays([self.keys, keys.filter(pa.array(kept))])
        self.values = pa.concat_arrays([self.values, values.filter(pa.array(kept))])
        self.used = np.append(self.used, np.ones(kept.sum(), bool))
