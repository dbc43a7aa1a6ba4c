"""Token ids of words, and the parts kept for them."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from marketlens.llm import packing
from marketlens.llm.common import tokenizer_path
from marketlens.llm.text_parts import Kept


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder.load(tokenizer_path())


def check(encoder, texts):
    whole = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, packing.CLOSING_ID] for t in texts]
    for text, found, ids in zip(texts, encoder.encode(pa.array(texts)), whole):
        assert np.frombuffer(found.as_py(), encoder.type).tolist() == ids, text


def test_letters_and_symbols_beside_each_other(encoder):
    symbols = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    check(encoder, [f"a{s}b {s} é{s}ü É{s}'s x'{s}t {s}{t}a{t}{s} 5{s}a{s}5 Z{s}̸z é{s}n" for s in symbols for t in "'#<|-"])


def test_every_letter_of_latin_words(encoder):
    letters = [chr(c) for c in range(0xA0, 0x250)]
    check(encoder, [f"a{c}b {c} {c}{c} {c}'s 7{c} straße{c}, {c}́a" for c in letters])


def test_latin_words_go_to_the_merges(encoder, monkeypatch):
    asked = []

    class Watched:
        model = encoder.tokenizer.model

        def encode_batch_fast(self, texts, **settings):
            asked.extend(texts)
            return []

    texts = ["École### naïve*** œuvre%%% straßenbahnhof zzqxéy&&& \"thé été (lódź"]
    want = [*encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids, packing.CLOSING_ID]
    symbols = packing.WordEncoder(encoder.tokenizer)
    symbols.encode(pa.array(["### *** %%% &&& \" ("]))  # these are known from now on
    monkeypatch.setattr(symbols, "tokenizer", Watched())
    found = symbols.encode(pa.array(texts))
    assert not any(asked)
    assert np.frombuffer(found[0].as_py(), symbols.type).tolist() == want


@pytest.mark.parametrize("limit", [3_000, 60_000, 1 << 20])
def test_kept_values_are_right_and_bounded(limit):
    kept = Kept(lambda parts: [p[::-1] * (len(p) % 3) for p in parts], limit)
    kept.GATHERED = 50
    draw = random.Random(3)
    for _ in range(150):
        parts = list({b"%d" % int(draw.paretovariate(0.4) % 10**7) * draw.choice([1, 1, 1, 12]) for _ in range(40)})
        assert kept(pa.array(parts, pa.binary())).to_pylist() == [p[::-1] * (len(p) % 3) for p in parts]
    assert kept.keys.nbytes + kept.values.nbytes + kept.used.nbytes + kept.places.nbytes < limit + 20_000


def test_known_parts_are_not_looked_for_again():
    asked = []
    kept = Kept(lambda parts: asked.extend(parts) or [p + b"!" for p in parts], 1 << 20)
    kept.GATHERED = 100
    parts = pa.array([b"%d" % i for i in range(1000)], pa.binary())
    for _ in range(3):
        assert kept(parts).to_pylist() == [b"%d!" % i for i in range(1000)]
    assert len(asked) < 1100
