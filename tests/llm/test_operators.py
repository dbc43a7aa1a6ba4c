"""The corpus operators against brute force, on awkward rows and on the small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketlens.llm import chat, content_sort, host_rules, licenses, mixture, near_dup, ngram_filter, packing, pii, pu_quality
from marketlens.llm.common import tokenizer_path

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def documents(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# chat


def chats(spark, rows):
    return chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))


def test_chat_round_trip_with_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", r"[\INST] <\\s> [[INST]] <", None, "", "[ROLE] x [/TURN]\n", "\\" * 50]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(1, 9, "tool [/ROLE]", "[/TURN]")]
    got = chats(spark, rows)
    back = got.select(chat.parse_chat(F.col("formatted")).alias("b"), chat.loss_text(F.col("segments")).alias("l")).first()
    assert [(t["role"], t["text"]) for t in back["b"]] == [(r[2], r[3] or "") for r in rows]
    assert back["l"] == "".join(r[3] or "" for r in rows if r[2] == "assistant")


@pytest.mark.parametrize(
    "roles, bad",
    [
        (["user", "assistant"], None),
        (["system", "user", "assistant", "user", "assistant"], None),
        (["assistant"], 1),
        (["user", "user", "assistant"], 2),
        (["user", "assistant", "system"], 3),
        (["user"], 2),
        ([None, "assistant"], 1),
    ],
)
def test_chat_machine(spark, roles, bad):
    row = chats(spark, [(None, i, r, "x") for i, r in enumerate(roles)]).first()
    assert row["first_bad_turn"] == bad
    assert row["valid"] == (bad is None)


def test_no_chats(spark):
    assert chat.chat_digests(chats(spark, [])).count() == 0


# exact copies


@pytest.mark.parametrize("salts", [None, 3])
def test_exact_copies(awkward, salts):
    rows = pairs_of(awkward)
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    found = content_sort.exact_dedup(awkward, salts)
    name = [c for c in found.columns if c.startswith("dedup_")][0]
    got = [(r["doc_id"], r["text"] or "", r[name]) for r in found.collect()]
    assert len(got) == len(rows)
    for d, t, v in got:
        known = [x for x in groups[t] if x is not None]
        assert v["keep_id"] == max(known, default=None)
        assert v["group_size"] == len(groups[t])
        assert v["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = content_sort.drop_copies(awkward)
    assert kept.columns == awkward.columns
    assert Counter(t or "" for _, t in pairs_of(kept)) == Counter(list(groups))


def test_a_hot_text_is_counted_whole(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(600)], "doc_id bigint, text string").repartition(7)
    got = content_sort.verdicts(docs).where("group_size > 1").agg(F.min("group_size"), F.max("group_size"), F.min("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (400, 400, 599, 1)


# near copies


def shingles(text):
    w = lower(text)
    w = WORD.findall(w)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= 75 * (len(s) + len(t) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: find(d) for d in ids}


def family(rng, n, words=60, changes=4):
    base = [f"w{rng.integers(5000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for at in rng.integers(0, words, rng.integers(0, changes)):
            copy[at] = f"x{rng.integers(10**6)}"
        yield " ".join(copy)


def test_near_copies_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [t for n in (1, 1, 2, 5, 40, 9) for t in family(rng, n, int(rng.integers(8, 120)))] + ["", None, "a b", "A B", "a b c"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(near_dup, "BLOCK", 8)  # so that buckets and families of this size take several blocks
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 5 * near_dup.LEAST_BYTES)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(shingles(t)) for d, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("bytes_", [6 * near_dup.LEAST_BYTES, near_dup.BLOCK_BYTES])
def test_a_family_of_mostly_unlinked_texts(spark, monkeypatch, bytes_):
    """Texts just under the threshold: many likely pairs, few links, and what goes out stays in proportion."""
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", bytes_)
    rng, made = np.random.default_rng(7), []
    keep = near_dup.linked_in_families
    monkeypatch.setattr(near_dup, "linked_in_families", lambda *a: made.append(keep(*a)) or made[-1])
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        for at in rng.integers(0, 200, 2 + i % 4):
            copy[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(copy)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)
    blocks = -(-120 * near_dup.LEAST_BYTES // bytes_)
    assert made[0].count() <= 120 * blocks


def test_components_equal_an_exact_search(spark):
    """All pairs that share a shingle, on whole tables."""
    rows = pairs_of(documents(spark, "/root/testdata/sf0.01"))
    sets, holders = {d: shingles(t) for d, t in rows}, defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter((a, b) for ds in holders.values() for i, a in enumerate(ds) for b in ds[:i])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), both in shared.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = near_dup.near_duplicates(documents(spark, "/root/testdata/sf0.01")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: find(d) for d in sets}


@pytest.mark.parametrize("width, pairs", [(64, 3), (1 << 14, 8192)])
def test_common_shingles(width, pairs):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 5, 100, 200, 200, 300)]
    x, y = map(np.array, zip(*[(i, j) for i in range(6) for j in range(6)]))
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)]
    got = near_dup.common_shingles(sets, x, y, width, pairs)
    assert [g for g, i, j in zip(got, x, y) if i != j] == [w for w, i, j in zip(want, x, y) if i != j]


def test_near_copies_of_awkward_rows(awkward, no_docs):
    got = near_dup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] in (1, 2, 3, 4)} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert near_dup.near_duplicates(no_docs).count() == 0
    assert near_dup.drop_near_copies(awkward).columns == awkward.columns


@pytest.mark.parametrize("n", [3, 40, 3000])
@pytest.mark.parametrize("share", [0.5, 0.75, 0.9])
def test_registers_estimate_similarity(n, share):
    rng = np.random.default_rng(n)
    both = max(1, round(n * share))
    got, want = [], both / (2 * n - both)
    for _ in range(60):
        x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(x[:n]), np.unique(x[n - both : 2 * n - both])
        same = (near_dup.registers(a) == near_dup.registers(b)).sum()
        got.append(near_dup.estimate(np.array([same]), np.array([n]), np.array([n]))[0])
    assert np.mean(got) == pytest.approx(want, abs=0.02)


# packing


def test_packing_is_whole_and_mixed(awkward, spark):
    docs = documents(spark).unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = pairs_of(docs)
    ids = Counter((d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t in rows)
    pieces = sorted(packing.pack_documents(docs, tokenizer_path(), window=256).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at, by_doc = {}, defaultdict(list)
    for p in pieces:
        assert p["offset"] == at.get(p["sequence_id"], 0) and p["length"] > 0
        at[p["sequence_id"]] = p["offset"] + p["length"]
        by_doc[p["doc_id"]].append(p)
    assert sorted(at) == list(range(len(at))) and all(at[s] == 256 for s in list(at)[:-1])
    single = {d: next(np.frombuffer(x, "<u4") for e, x in ids if e == d) for d, n in Counter(d for d, _ in rows).items() if n == 1}
    for d, tokens in single.items():
        mine = sorted(by_doc[d], key=lambda p: p["start"])
        assert [p["start"] for p in mine] == list(np.cumsum([0] + [p["length"] for p in mine])[:-1])
        assert sum(p["length"] for p in mine) == len(tokens) == mine[0]["doc_tokens"]
        assert all(zlib.crc32(tokens[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in mine)
    assert sum(at.values()) == sum(len(x) // 4 * n for (_, x), n in ids.items())


def test_deficits_stay_below_a_chunk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 3 == 0], int(rng.integers(1, 300))) for i in range(900)]
    encoded = spark.createDataFrame(rows, "row bigint, source string, n_tokens bigint")
    source = {r: s for r, s, _ in rows}
    pieces = packing.pack(encoded, window=256).collect()
    total = Counter()
    for r, s, n in rows:
        total[s] += n
    sent, all_sent = Counter(), 0
    per = defaultdict(Counter)
    for p in pieces:
        per[p["sequence_id"]][source[p["row"]]] += p["length"]
    for s in sorted(per):
        sent.update(per[s])
        all_sent += sum(per[s].values())
        assert all(abs(sent[x] - all_sent * total[x] / sum(total.values())) <= 300 + 256 for x in total)


@pytest.mark.parametrize("weights", [None, {"hot": 0.4, "even": 0.3, "small": 0.2, "tiny": 0.1}])
def test_every_full_window_meets_its_target(spark, weights):
    rng = np.random.default_rng(2)
    sources = rng.choice(["hot", "even", "small", "tiny"], 1200, p=[0.6, 0.25, 0.13, 0.02])
    rows = [(i, str(s), int(rng.integers(1, 900))) for i, s in enumerate(sources)]
    encoded = spark.createDataFrame(rows, "row bigint, source string, n_tokens bigint")
    source, total = {r: s for r, s, _ in rows}, Counter()
    for _, s, n in rows:
        total[s] += n
    share = weights or {s: n / sum(total.values()) for s, n in total.items()}
    per, cover = defaultdict(Counter), Counter()
    for p in packing.pack(encoded, window=1024, weights=weights).collect():
        per[p["sequence_id"]][source[p["row"]]] += p["length"]
        cover[p["row"]] += p["length"]
    assert cover == {r: n for r, _, n in rows}
    full = int(min(total[s] / share[s] for s in share)) // 1024 - 1
    assert full > 10
    assert all(abs(per[w][s] - 1024 * share[s]) <= 2 * len(share) for w in range(full) for s in share)


def test_many_small_sources_share_windows(spark):
    rows = [(i, "big" if i % 2 else f"s{i % 400}", 200) for i in range(4000)]
    encoded = spark.createDataFrame(rows, "row bigint, source string, n_tokens bigint")
    big, sizes = Counter(), []
    for p in packing.pack(encoded, window=1024).collect():
        big[p["sequence_id"]] += p["length"] * (p["row"] % 2)
        sizes.append(p["length"])
    windows = 4000 * 200 // 1024
    assert all(abs(big[w] - 512) <= 64 for w in range(20, windows - 20))
    assert np.median(sizes) >= 8


def test_nothing_to_pack(no_docs):
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


# language model


def test_scores(awkward, spark):
    docs = documents(spark).unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    rows = pairs_of(docs)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    count = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for d, t in rows:
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want[d, held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(base, 6)] += 1
    one, many = (
        ngram_filter.score_documents(docs, shard_mb=mb, chunk_mb=0.1).collect() for mb in (64, 0)
    )
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in one)
    assert got == want
    by = lambda rs: sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in rs)
    assert by(one) == by(many)
    assert sum(r["score"] for r in one if not r["held_out"]) > sum(r["base_score"] for r in one if not r["held_out"])


def test_scores_equal_a_plain_model(spark):
    """Counts in a dictionary, rounded down to powers of two; the filter gets so many bits that it errs nowhere."""
    docs = documents(spark)
    rows = pairs_of(docs)
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    words = {d: [*WORD.findall(lower(t)), None] for d, t in rows}
    single, pairs = Counter(), Counter()
    for d, ws in words.items():
        if not held[d]:
            single.update(ws)
            pairs.update(zip(["start", *ws[:-1]], ws))
    n, v, mu = sum(single.values()), len(single), 20.0
    starts = sum(not h for h in held.values())
    got = {r["doc_id"]: r["score"] for r in ngram_filter.score_documents(docs, mu, bits_per_entry=4000).collect()}
    for d, ws in words.items():
        score = 0.0
        for before, w in zip(["start", *ws[:-1]], ws):
            c, b = single[w], starts if before == "start" else single[before]
            base = (c + 0.5) / (n + 0.5 * (v + 1))
            seen = pairs[before, w]
            level = min(2 ** int(math.log2(seen)), c, b) if seen else 0
            score += math.log10((level + mu * base) / (b + mu))
        assert got[d] == pytest.approx(score, abs=1e-6)


def test_filter_never_counts_too_low():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    counts = rng.geometric(0.3, len(keys)) ** 2
    bits = ngram_filter.build_segment(keys, counts, 10)
    zero, size = np.zeros(len(keys), np.int64), np.full(len(keys), len(bits))
    level = ngram_filter.probe(bits, zero, size, keys)
    exact = np.floor(np.log2(counts)).astype(int) + 1
    assert (level >= exact).all() and (level == exact).mean() > 0.9
    other = rng.integers(0, 1 << 48, 5000, dtype=np.uint64)
    assert (ngram_filter.probe(bits, np.zeros(5000, np.int64), np.full(5000, len(bits)), other) > 0).mean() < 0.06


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def test_base_spans(spark, awkward):
    tricky = [
        "a@b.c%x@e.f. a@b@c.d x.@y.z 1.2.3.4.5.6.7.8 001.2.3.256 0255.1.1.1 1.2.3.4.5",
        "𝔘 4111-1111 11111111x 4111111111111111 0 +1 234 567 890 - +123456789 ++49(0)1234567890123456",
        "9" * 5000 + " " + "a" * 5000 + "@ " + "1.2.3.4 " * 2500,
    ]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id bigint, text string"))
    want = Counter()
    for d, t in pairs_of(docs):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        want[d, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)] += 1
    got = Counter((r["doc_id"], r["base_sha256"], ",".join(s for s in r["spans"].split(",") if not s.startswith("term"))) for r in pii.span_digests(docs).collect())
    assert got == want


def test_terms_that_disclose(spark):
    near = [(i, f"note {i} the Zanzibarian archivist writes from zed@example.org about item{i} today") for i in range(5)]
    rest = [(100 + i, f"the clean note number {i} writes about things today and nothing else") for i in range(60)]
    docs = spark.createDataFrame(near + rest, "doc_id bigint, text string")
    clean = {r["doc_id"]: r["clean_text"] for r in pii.sanitise(docs).collect()}
    assert clean[2] == "note 2 the [TERM] [TERM] writes [TERM] [EMAIL] about item2 today"
    assert all(clean[d] == t for d, t in rest)


def test_terms_disclose_from_anywhere_in_the_text(spark):
    filler = "the clean words of a common note "
    near = [(i, f"Zanzibarian {filler * 4}wrote in 2024, room 17, from zed@example.org, and {filler * 4}so Zanzibarian {i}") for i in range(5)]
    near += [(10 + i, f"Querulous{i}: a{i}@example.org, list@example.org {filler}about Marzipanian") for i in range(5)]
    rest = [(100 + i, f"{filler}wrote {i} in about room from and so") for i in range(200)]
    docs = spark.createDataFrame(near + rest, "doc_id bigint, text string")
    clean = {r["doc_id"]: r["clean_text"] for r in pii.sanitise(docs).collect()}
    for d, t in near[:5]:
        assert clean[d] == t.replace("Zanzibarian", "[TERM]").replace("zed@example.org", "[EMAIL]")
    assert clean[12] == f"Querulous2: [EMAIL], [EMAIL] {filler}about [TERM]"
    assert all(clean[d] == t for d, t in rest)


TERMS = re.compile(r"[^\W\d_][\w-]{2,}")


def brute_terms(rows, theta=0.9, support=3):
    """Pairs (entity, term) by PMI over distinct texts, and the term spans of every text."""
    texts = {t or "" for _, t in rows}
    words, entities, held = {}, {}, defaultdict(set)
    for t in texts:
        spans = brute_spans(t)
        entities[t] = {(k, t[s:e].lower()) for k, s, e in spans}
        found = [(m.group().lower(), m.start(), m.end()) for m in TERMS.finditer(t)]
        words[t] = [w for w in found if not any(s < w[2] and e > w[1] for _, s, e in spans)] if spans else []
        for m in TERMS.finditer(t.lower()):
            held[m.group()].add(t)
    near = defaultdict(set)
    for t in texts:
        for c in entities[t]:
            for w, _, _ in words[t]:
                near[c, w].add(t)
    total, of = len(texts), Counter(c for t in texts for c in entities[t])
    told = set()
    for (c, w), both in near.items():
        ic = math.log2(total / of[c])
        if len(both) >= support and ic > 0 and math.log2(len(both) * total / (of[c] * len(held[w]))) >= theta * ic - 1e-12:
            told.add((c, w))
    return {t: sorted({(s, e) for w, s, e in words[t] if any((c, w) in told for c in entities[t])}) for t in texts}


def brute_spans(t):
    out = []
    for kind, pattern in BRUTE_PATTERNS.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if brute_valid(kind, m.group())]
    return out


def brute_valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


BRUTE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_terms_equal_brute_force(spark):
    """Planted words of one owner, words of two, words that stand apart, lists that recur as a whole, and common ones."""
    rng = np.random.default_rng(8)
    common = [f"word{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(260):
        text = " ".join(rng.choice(common, 12))
        if i % 10 < 4:
            who = i % 4
            text += f" Owner{'abcd'[who]} of p{who}@x.org, call +49 (30) 123-456-7{who} Hint{'xy'[who // 2]}"
        if i % 13 == 0:
            text += " list: " + " ".join(f"m{k}@list.org" for k in range(30)) + " Listling abc10.0.0.7def"
        rows.append((i, text))
    rows += [(900 + i, t) for i, (_, t) in enumerate(rows[:20])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute_terms(rows)
    got = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")] for r in pii.span_digests(docs).collect()}
    assert got == {d: want[t] for d, t in rows}
    assert any(want.values())


def test_a_page_of_values_takes_linear_time(spark):
    """5,000 addresses among 20,000 words, on three pages."""
    page = " ".join(f"w{i}ord x{i}@y.org " + "some more words" if i % 4 == 0 else f"v{i}erb x{i}@y.org and words" for i in range(5000))
    rows = [(i, f"{page} Page{i}") for i in range(3)] + [(10 + i, f"short note {i} of words") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    entities, terms = pii.mentions(pii.materialize(pii.base_spans(docs), "base"))
    known, told = pii.disclosing(pii.materialize(entities, "e"), pii.materialize(terms, "t"), docs, 0.9, 3)
    assert known.count() == 5000 and known.select("class").distinct().count() == 1
    assert told.count() < 10_000
    got = {r["doc_id"]: r["n_email"] for r in pii.span_digests(docs).collect()}
    assert got[0] == 5000 and got[10] == 0


def test_no_personal_data(no_docs):
    assert pii.span_digests(no_docs).count() == 0


# licenses


def test_license_places_and_fuzzy_notices(awkward, no_docs):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(awkward).collect()}
    nine = got[9]
    assert (nine["n_base"], nine["first_word"], nine["last_word"], nine["base_labels"]) == (1, 8, 8, "apache")
    assert any(s["label"] == "apache" and s["edits"] == 2 for s in nine["spans"])
    assert got[3]["n_words"] == 0 and got[3]["first_word"] is None and got[3]["labels"] == ""
    assert licenses.scan_licenses(no_docs).count() == 0


@pytest.mark.parametrize("order", [(0, 1), (1, 0), (0, 1, 0), (0, 0, 1)])
def test_no_notice_is_lost_before_a_better_one(order):
    kinds = ("licensed under the apache licence version 2 0", "licensed under the apache license version 2 0")
    places, at = [], 0
    for k in order:
        places.append((at, at + len(kinds[k])))
        at += len(kinds[k]) + 1
    found = [(a, b) for label, a, b, _ in licenses.fuzzy_spans(" ".join(kinds[k] for k in order).encode()) if label == "apache"]
    assert set(places) <= set(found)


def unseeded(joined):
    """All notices by the regex library alone, from the left, best first among what overlaps."""
    out = []
    for notice in licenses._NOTICES:
        found, at = [], 0
        while True:
            m = notice.pattern.search(joined, at, len(joined))
            if not m:
                break
            found.append((sum(m.fuzzy_counts), m.start(), m.end()))
            at = m.start() + 1
        out += [(notice.label, s, e, n) for n, s, e in licenses._fewest_first(found)]
    return out


def test_seeded_search_equals_an_unseeded_one(spark):
    held = 0
    for _, text in pairs_of(documents(spark)):
        joined = b" ".join(licenses.words_of(text))
        if not re.search(b"licen|right|public|grant|redist", joined):
            continue
        got = licenses.fuzzy_spans(joined)
        held += bool(got)
        want = unseeded(joined.decode())
        assert {s[0] for s in got} == {s[0] for s in want}
        assert min((s[3] for s in got), default=None) == min((s[3] for s in want), default=None)
        assert len(got) == len(want)
    assert held


def test_a_megabyte_of_misspelt_notices_takes_about_a_second():
    import time

    one = "licensed under the apache lisense vrsion 2 0 "
    text = one * (1_000_000 // len(one))
    began = time.process_time()
    got = licenses.fuzzy_spans(" ".join(text.split()).encode())
    assert len(got) == 1_000_000 // len(one) and {s[0] for s in got} == {"apache"}
    double = time.process_time() - began
    began = time.process_time()
    licenses.fuzzy_spans(" ".join(text[: len(text) // 4].split()).encode())
    assert double < 8 * (time.process_time() - began) and double < 6


@pytest.mark.parametrize("text, label", [(t, label) for t, label in licenses.NOTICES])
def test_pigeonhole_seeds_lose_no_match(text, label):
    rng, notice = np.random.default_rng(len(text)), licenses.compile_notice(text, label)
    for _ in range(30):
        chars = list(text)
        for _ in range(notice.edits):
            at = int(rng.integers(1, len(chars) - 1))
            if chars[at] == " ":
                continue
            chars[at : at + 1] = [["q"], [], [chars[at], "q"]][rng.integers(3)]
        found = licenses.fuzzy_spans(f"filler {''.join(chars)} filler".encode(), (notice,))
        assert any(s[0] == label for s in found)


# mixing


def test_raked_margins():
    rng = np.random.default_rng(3)
    table = rng.integers(1, 1000, (4, 3, 5)).astype(float)
    margins = [rng.dirichlet(np.ones(k)) for k in table.shape]
    share = mixture.rake(table, margins)
    for axis, wanted in enumerate(margins):
        assert share.sum(axis=tuple(a for a in range(3) if a != axis)) == pytest.approx(wanted, abs=1e-8)


def test_mixture(spark, awkward, no_docs):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = mixture.mixture_verdicts(docs).collect()
    expected = Counter()
    for r in rows:
        expected[r["lang"]] += r["rate"] * r["tokens"]
    total = sum(expected.values())
    for lang, weight in mixture.TARGETS["lang"].items():
        assert expected[lang] / total == pytest.approx(weight, abs=0.002)
    tokens = {d: len(WORD.findall(t or "")) for d, t in pairs_of(docs)}
    assert {r["doc_id"]: r["tokens"] for r in rows} == tokens
    assert mixture.mixture_verdicts(awkward).count() == awkward.count()
    assert mixture.mixture_verdicts(no_docs).count() == 0
    assert mixture.drop_unsampled(awkward).columns == awkward.columns


def mixed_bag(spark, groups):
    """Documents (source, lang) of ten words each, as many as asked."""
    rows = [(s, la) for (s, la), n in groups.items() for _ in range(n)]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10)), s, la) for i, (s, la) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")


def test_unnamed_languages_keep_their_share(spark):
    langs = {"en": 300, "de": 150, "fr": 150, "es": 100, "it": 200, None: 100}
    docs = mixed_bag(spark, {("s%d" % (i % 5), la): n // 5 for la, n in langs.items() for i in range(5)})
    of = dict(docs.select("doc_id", "lang").collect())
    rows = mixture.mixture_verdicts(docs).collect()
    expected = Counter()
    for r in rows:
        assert r["rate"] > 0
        expected[of[r["doc_id"]]] += r["rate"] * r["tokens"]
    total = sum(expected.values())
    want = {"en": 0.42, "de": 0.105, "fr": 0.105, "es": 0.07, "it": 0.2, None: 0.1}
    assert {la: n / total for la, n in expected.items()} == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("hot", [{"src7": 600}, {"src7": 500, "src8": 500}, {"src7": 280}])
def test_any_hot_source_is_held_down(spark, hot):
    groups = {("h%d" % i, la): n for i in range(40) for la, n in {"en": 12, "de": 3, "fr": 3, "es": 2}.items()}
    # only this source has much of the scarcest language: meeting the target lifts it above its own share
    groups |= {(s, la): int(n * w) for s, n in hot.items() for la, w in {"en": 0.5, "de": 0.1, "fr": 0.1, "es": 0.3}.items()}
    docs = mixed_bag(spark, groups)
    of = dict(docs.select("doc_id", "source").collect())
    expected = Counter()
    for r in mixture.mixture_verdicts(docs).collect():
        expected[of[r["doc_id"]]] += r["rate"] * r["tokens"]
    assert max(expected.values()) / sum(expected.values()) <= 0.3 + 1e-4
    assert len(expected) == 40 + len(hot) and min(expected.values()) > 0


def test_a_light_source_that_mixing_lifts_is_held_down(spark):
    rows = [("h%d" % i, la, n) for i in range(40) for la, n in (("en", 22), ("de", 4))]
    # 6 % of the tokens, but most of two languages that are owed a quarter
    rows += [("only", "fr", 39), ("only", "es", 26), ("h0", "es", 13), ("h1", "fr", 13)]
    cells = spark.createDataFrame(rows, "source string, lang string, n bigint")
    rates, heavy = mixture.fit(cells, {"source": mixture.AtMost(0.15), "lang": mixture.TARGETS["lang"]}, bounds=(0.0, 1e9))
    assert heavy["source"] == ["only"]
    assert sum(s for c, (s, _) in rates.cells.items() if c[0] == "only") <= 0.15 + 1e-4


@pytest.mark.parametrize("scarce", [0, 1, 3])
def test_a_scarce_class_does_not_empty_the_mixture(spark, scarce):
    docs = mixed_bag(spark, {("s%d" % i, la): n for i in range(5) for la, n in {"en": 190, "de": 45, "fr": 45, "es": scarce}.items()})
    of = dict(docs.select("doc_id", "lang").collect())
    rows = mixture.mixture_verdicts(docs).collect()
    expected = Counter()
    for r in rows:
        expected[of[r["doc_id"]]] += r["rate"] * r["tokens"]
    assert sum(expected.values()) >= sum(r["tokens"] for r in rows) / mixture.MOST - 1e-6
    assert min(r["rate"] for r in rows) >= mixture.FEWEST / mixture.MOST
    # the others keep the proportions of their weights
    assert expected["en"] / expected["de"] == pytest.approx(4, rel=1e-3)


# quality


def test_classifier_held_out(spark, awkward, no_docs):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = pu_quality.score_quality(documents(spark, folder), labels)
    rows = scored.where("held_out").join(labels, "doc_id").select("quality", "score", "predicted").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    odd = pu_quality.score_quality(awkward, labels.where("doc_id < 200").limit(50))
    assert odd.count() == awkward.count() and odd.where("score is null").count() == 0
    assert pu_quality.score_quality(no_docs, labels).count() == 0
    assert pu_quality.score_quality(awkward, labels.where("false")).where("score = 0.5").count() == awkward.count()


def test_positives_alone(spark):
    """Labels of 0 are not needed: the prior comes from unlabelled text."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    alone = pu_quality.score_quality(documents(spark, folder), labels.where("quality = 1"))
    rows = alone.where("held_out").join(labels, "doc_id").select("quality", "score").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    both = pu_quality.score_quality(documents(spark, folder), labels)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, both.collect()))


def risk_table(spark, n=400):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, pu_quality.N_FEATURES)).astype(np.float32)
    rows = [(i, [float(v) for v in r], bool(r[0] + r[1] > 0 and i % 3)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id bigint, x array<float>, positive boolean").repartition(5), x.astype(float), np.array([r[2] for r in rows])


def test_risk_and_gradient_equal_plain_numpy(spark):
    rows, x, positive = risk_table(spark)
    design = pu_quality.Design(x.mean(axis=0), x.std(axis=0))
    w = np.random.default_rng(1).normal(size=design.width) * 0.1

    def risk(w, prior=0.4):
        z = design(x) @ w
        loss = lambda v: np.log1p(np.exp(-v))
        negative = loss(-z).mean() - prior * loss(-z[positive]).mean()
        return prior * loss(z[positive]).mean() + max(0.0, negative), negative

    sums = pu_quality.risk_sums(rows, design, w)
    assert pu_quality.nn_risk(sums, 0.4) == pytest.approx(risk(w))
    n_u, n_p = sums["n_u"][0], sums["n_p"][0]
    assert (n_u, n_p) == (len(x), positive.sum())
    slope = 0.4 * sums["p_pos_grad"] / n_p + sums["u_grad"] / n_u - 0.4 * sums["p_neg_grad"] / n_p
    for i in range(0, design.width, 17):
        step = np.eye(design.width)[i] * 1e-5
        assert slope[i] == pytest.approx((risk(w + step)[0] - risk(w - step)[0]) / 2e-5, abs=1e-5)
    z = design(x) @ w
    s = 1 / (1 + np.exp(-z))
    assert sums["u_curve"].reshape(design.width, -1) == pytest.approx(design(x).T @ (design(x) * (s * (1 - s))[:, None]))


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_of_planted_positives(share):
    """Counts of scores of two overlapping classes; the unlabelled are a mixture."""
    rng = np.random.default_rng(int(100 * share))
    n = 20_000
    scores = lambda mean, k: np.histogram(np.clip(rng.normal(mean, 2.0, k), -19.9, 19.9), np.linspace(-20, 20, 401))[0]
    u = scores(4.0, int(n * share)) + scores(-4.0, int(n * (1 - share)))
    assert pu_quality.estimate_prior(u, scores(4.0, 4000)) == pytest.approx(share, abs=0.05)
    assert pu_quality.estimate_prior(u, np.zeros(400, int)) == 0.5


def test_prior_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    share = labels.agg(F.avg("quality")).first()[0]
    found, keep = [], pu_quality.train
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pu_quality, "train", lambda *a: found.append(keep(*a)) or found[-1])
        pu_quality.score_quality(documents(spark, folder), labels.where("quality = 1")).count()
    assert found[0][0] == pytest.approx(share, abs=0.1)


def brute_measures(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(repeated)


def test_quality_rules(spark, awkward, no_docs):
    docs = documents(spark).unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    want = Counter((d, *brute_measures(t)) for d, t in pairs_of(docs))
    rows = host_rules.quality_verdicts(docs).collect()
    assert Counter((r["doc_id"], *(r[m] for m in host_rules.MEASURES)) for r in rows) == want
    for r in rows:
        bad = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == bad and r["kept"] == (not bad and r["host_rate"] < 0.5)
    assert host_rules.quality_verdicts(no_docs).count() == 0
    assert host_rules.drop_rejected(awkward).columns == awkward.columns


def test_host_rates_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 20 else bad, "fine") for i in range(200)] + [(300 + i, bad if i % 10 else good, "farm") for i in range(200)]
    rows += [(600, bad, "tiny"), (601, good, "other")]
    got = {r["source"]: r["host_rate"] for r in host_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).join(spark.createDataFrame(rows, "doc_id bigint, t string, source string"), "doc_id").collect()}
    assert got["fine"] < 0.15 and 0.75 < got["farm"] < 0.9
    assert 0.5 < got["tiny"] < 1 and 0 < got["other"] < 0.5


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SMALL)
        assert out.columns == docs.columns, name
        assert out.exceptAll(at).count() == 0
        at = out
    pieces = entry.queries()["pipeline"](spark, SMALL)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in at.select("doc_id").collect()}


def test_pipeline_without_documents(spark, no_docs):
    import corpus_pipeline

    at = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SMALL)
    assert at.count() == 0
