"""License notices: exact phrases and fuzzy short-notice search.

A notice that may differ by k edits is split into k + 1 pieces; by the
pigeonhole principle one of them stands unchanged in any match. The pieces are
looked for as exact seeds, each hit opens a candidate stretch of the text, and
the ``regex`` library's bounded-error matching verifies it and reports the span
and the number of edits. Exact phrases are places where a phrase's words stand
consecutively.

Defined results: null counts as the empty text; a text without words has no
label, null places and score 0; repeated rows get equal results; whole texts
are read, very long ones in time that grows with their length; an empty table
gives no rows; other columns do not matter. Labels are sorted and distinct.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Phrases that count as base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices for the fuzzy search, as words in lower case.
NOTICES = (
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 16

_WORD_BYTES = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
_LOWER_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in _WORD_BYTES)


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    seeds: tuple[tuple[bytes, int], ...]
    pattern: regex.Pattern


def compile_notice(text: str, label: str, chars_per_edit: int = CHARS_PER_EDIT) -> Notice:
    """Pieces of equal length with their places, and the bounded-error pattern."""
    edits = len(text) // chars_per_edit
    cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
    seeds = tuple((text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:]))
    pattern = regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(text)}){{e<={edits}}}(?!\S)")
    return Notice(text, label, edits, seeds, pattern)


_NOTICES = tuple(compile_notice(t, label) for t, label in NOTICES)


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters a-z (A-Z lowered), digits and bytes beyond ASCII."""
    return (text or "").encode().translate(_LOWER_WORDS).split()


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase stands in words joined by blanks."""
    padded, wanted, out = b" " + joined + b" ", b" " + phrase + b" ", []
    at, seen, word = padded.find(wanted), 0, 0
    while at >= 0:
        word += padded.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = padded.find(wanted, at + 1)
    return out


def fuzzy_spans(joined: bytes, notices: tuple[Notice, ...] = _NOTICES) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of every verified notice; places are characters of the joined words.

    A seed's stretch is as long as the notice and its edits, whatever the text,
    and a seed that a found span accounts for opens none, so the time grows with
    the number of notices in the text. Of overlapping spans of one notice the
    one with the fewest edits stays.
    """
    text, out = joined.decode(), []
    chars = None if len(text) == len(joined) else np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)
    for notice in notices:
        hits = set()
        for seed, place in notice.seeds:
            at = joined.find(seed)
            while at >= 0:
                # in characters; seeds are ASCII
                hits.add((at if chars is None else int(chars[at]) - 1) - place)
                at = joined.find(seed, at + 1)
        found: list[tuple[int, int, int]] = []
        for begin in sorted(hits):
            if found and found[-1][0] == 0 and abs(begin - found[-1][1]) <= notice.edits:
                continue  # the exact span found there
            span = _verify(text, begin, notice)
            if span:
                found.append(span)
        out += [(notice.label, start, end, edits) for edits, start, end in _fewest_first(found)]
    return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))


def _fewest_first(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (edits, start, end) without those that overlap a better one; equals count from the left."""
    kept: list[tuple[int, int, int]] = []  # in the order of their starts
    for span in sorted(set(found)):
        at = bisect.bisect(kept, span[1], key=lambda k: k[1])
        if (not at or kept[at - 1][2] <= span[1]) and (at == len(kept) or span[2] <= kept[at][1]):
            kept.insert(at, span)
    return kept


def _verify(text: str, begin: int, notice: Notice) -> tuple[int, int, int] | None:
    """The best match (edits, start, end) of a notice whose beginning is expected at ``begin``."""
    end = begin + len(notice.text)
    if begin >= 0 and text.startswith(notice.text, begin) and not text[max(begin - 1, 0) : begin].strip() and not text[end : end + 1].strip():
        return 0, begin, end
    # one character more than a match can reach, so that it is seen whether a word ends there
    low, high = max(begin - notice.edits, 0), min(end + notice.edits + 1, len(text))
    m = notice.pattern.search(text, low, high)
    if not m or (m.end() == high < len(text) and text[high].strip()):
        return None
    return sum(m.fuzzy_counts), m.start(), m.end()


SPAN = T.StructType().add("label", "string").add("start", "long").add("end", "long").add("edits", "integer")
FOUND = (
    T.StructType()
    .add("n_words", "long")
    .add("n_base", "long")
    .add("first_word", "long")
    .add("last_word", "long")
    .add("base_labels", "string")
    .add("labels", "string")
    .add("score", "double")
    .add("spans", T.ArrayType(SPAN))
)
_ARROW = to_arrow_type(FOUND)


def scan_text(text: str | None) -> dict:
    words = words_of(text)
    joined = b" ".join(words)
    places, base = [], set()
    for phrase, label in PHRASES.items():
        found = phrase_places(joined, phrase.encode())
        places += found
        base |= {label} if found else set()
    spans = fuzzy_spans(joined)
    labels = base | {s[0] for s in spans}
    # an exact phrase is certain; a fuzzy one counts by the share of its characters left as they are
    best = max((1 - s[3] / (s[2] - s[1]) for s in spans), default=0.0)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 if places else max(0.0, best),
        "spans": [dict(zip(("label", "start", "end", "edits"), s)) for s in spans],
    }


@F.arrow_udf(FOUND)
def scan(texts: pa.Array) -> pa.Array:
    return pa.array([scan_text(t) for t in texts.to_pylist()], _ARROW)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id with counts, places, labels, score and the verified spans."""
    return docs.select("doc_id", scan("text").alias("found")).select("doc_id", "found.*")
