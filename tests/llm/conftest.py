from __future__ import annotations

import pytest

#: Texts of every awkward kind; ids may be null and rows repeat.
AWKWARD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "s1", "en"),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "s1", "en"),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "s1", "en"),
    (3, None, "s1", None),
    (4, "", None, "en"),
    (5, " \n\t ", "s2", "de"),
    (6, "Mail bob.smith@example.org or +49 (30) 123-456-78 from 10.0.0.1, card 4111 1111 1111 1111.", "s2", "en"),
    (7, "one two three", "s2", "fr"),
    (8, " ".join(f"w{i % 997}" for i in range(30_000)), "s2", "en"),
    (None, "naïve café – ünïcödé 𝔘𝔫𝔦 words, and more of them", None, None),
    (9, "Licensed under the Apache Lisence, Version 2.0\nApache License", "s1", "en"),
]


@pytest.fixture
def awkward(spark):
    rows = [(*r, len(r[1] or ""), "x", "y") for r in AWKWARD]
    # names that an operator might use itself
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, source string, lang string, n_chars bigint, kept string, dedup string"
    ).repartition(3)


@pytest.fixture
def no_docs(awkward):
    return awkward.where("false")
