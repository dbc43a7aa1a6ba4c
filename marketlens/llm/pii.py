"""Personal data by pattern, and the terms that would give it away.

Base spans come from regular expressions with checks (number ranges, Luhn sum,
digit counts). On top of them the corpus decides which words beside a protected
value reveal it: a term t discloses an entity c when, over the distinct texts
of the whole corpus, PMI(t; c) >= theta * IC(c), with PMI = log2 p(t, c) /
(p(t) p(c)) and IC = -log2 p(c), and they occur together in at least
``min_support`` texts. The context of a value is the whole text. Removing c
alone would leave t to tell it, so all of t's occurrences in any text that holds
c become spans of kind ``term``; ``sanitise``
generalises all spans to the name of their kind. Texts without a protected
value get no spans.

Everything is column expressions and joins. Patterns use possessive repetition
and start only where a run starts or the last match ended, so they find the
plain pattern's matches in linear time. Words are counted once per distinct
text, so copies do not make evidence.

Defined results: a null text is empty and has no spans; rows are searched each,
repeated ones alike; equal ids do not matter; very long texts are searched
whole, in time that grows with their length and the values' and words' number;
an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import materialize
from .common import text_of

_MAIL = r"[A-Za-z0-9._%+-]"
#: Kinds in the order of the result, a character every match has (or none), and the pattern.
KINDS: tuple[tuple[str, str, str], ...] = (
    ("email", "@", rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    ("card", "", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TERM = "term"
TERM_PATTERN = r"\p{L}[\p{L}\p{N}_-]{2,}+"
_BLOCK = 1_000


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, 2 * d).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    def check(match: Column) -> Column:
        value = match["value"]
        digits = F.regexp_replace(value, "[^0-9]", "")
        n = F.char_length(digits)
        if kind == "ip":
            return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
        if kind == "card":
            return F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
        return n.between(9, 15) if kind == "phone" else F.lit(True)

    return check


def _placed(gaps: Column) -> Column:
    """Add start and end to (gap, len, ...) structs that follow each other in a text.

    Positions are summed up in blocks: growing one long array step by step
    would take the square of its length.
    """

    def walk(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            one = F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["value"].alias("value"))
            return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
        return F.aggregate(part, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step)

    def shift(done: Column, part: Column) -> Column:
        moved = F.transform(
            part["out"],
            lambda x: F.struct((x["start"] + done["at"]).alias("start"), (x["end"] + done["at"]).alias("end"), x["value"].alias("value")),
        )
        return F.struct((done["at"] + part["at"]).alias("at"), F.concat(done["out"], F.array(moved)).alias("out"))

    blocks = F.transform(
        F.sequence(F.lit(1), F.size(gaps), F.lit(_BLOCK)), lambda i: walk(F.slice(gaps, i, F.lit(_BLOCK)))
    )
    none = F.array().cast("array<array<struct<start:bigint,end:bigint,value:string>>>")
    joined = F.aggregate(blocks, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), shift)
    return F.flatten(joined["out"])


def _gaps(text: Column, pattern: str, found: Column) -> Column:
    """What lies before each match, with the match: (gap, len, value)."""
    return F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)),
        found,
        lambda p, m: F.struct(F.char_length(p).cast("bigint").alias("gap"), F.char_length(m).cast("bigint").alias("len"), m.alias("value")),
    )


def matches(df: DataFrame, text: str, pattern: str, out: str, gate: Column | None = None) -> DataFrame:
    """Add ``out``: array of (start, end, value) of the pattern's matches, in code points."""
    found, gaps = f"_{out}_found", f"_{out}_gaps"
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn(found, hits if gate is None else F.when(gate, hits).otherwise(F.array().cast("array<string>")))
    some = F.size(found) > 0
    df = df.withColumn(gaps, F.when(some, _gaps(F.col(text), pattern, F.col(found))))
    placed = F.when(some, _placed(F.col(gaps))).otherwise(F.array())
    return df.withColumn(out, placed).drop(found, gaps)


def _labelled(kind: int) -> Callable[[Column], Column]:
    fields = ("start", "end", "value")
    return lambda m: F.struct(F.lit(kind).alias("kind"), *[m[f].alias(f) for f in fields])


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def base_spans(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """row, doc_id, digest of the text, ``base``: array of (kind, start, end, value), and the text if it has any (or is to be kept)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    for kind, sign, pattern in KINDS:
        rows = matches(rows, "text", pattern, kind, F.contains(F.col("text"), F.lit(sign)) if sign else None)
    named = [F.transform(F.filter(kind, _valid(kind)), _labelled(i)) for i, (kind, _, _) in enumerate(KINDS)]
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("digest"), "text", F.concat(*named).alias("base"))
    return rows if keep_text else rows.withColumn("text", F.when(F.size("base") > 0, F.col("text")))


def mentions(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of texts with protected values: (row, digest, entity), distinct, and (row, digest, term, start, end) outside of the values.

    Words and values of a text are merged in the order of their places; a word
    overlaps a value exactly if a value that begins before it reaches into it or
    the next value begins within it.
    """
    some = matches(found.where(F.size("base") > 0), "text", TERM_PATTERN, "words").drop("text")
    value = F.concat_ws(":", F.col("b.kind").cast("string"), F.lower("b.value"))
    entities = some.select("row", "digest", F.explode("base").alias("b")).select("row", "digest", value.alias("entity")).distinct()
    spans = some.select("row", "digest", F.inline(F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("string").alias("value")))))
    words = some.select("row", "digest", F.inline(F.transform("words", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value")))))
    is_span = F.col("value").isNull()
    ahead = Window.partitionBy("row").orderBy("start", F.col("value").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.col("value").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    merged = spans.unionByName(words)
    merged = merged.withColumn("reach", F.max(F.when(is_span, F.col("end"))).over(ahead))
    merged = merged.withColumn("next", F.min(F.when(is_span, F.col("start"))).over(back))
    clear = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    terms = merged.where(~is_span & clear).select("row", "digest", F.lower("value").alias("term"), "start", "end")
    return entities, terms


def _classes(entities: DataFrame, min_support: int) -> DataFrame:
    """entity, class, n_entity of entities of enough texts; those that stand in the same texts are one class.

    A class is told by the number of its texts and sums of hashes of them, so a
    list of values that recurs as a whole costs as much as one value.
    """
    texts = entities.select("digest", "entity").distinct()
    alike = [F.sum(F.xxhash64(F.lit(i), "digest").cast("decimal(20,0)")).cast("string") for i in (1, 2)]
    found = texts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.concat_ws(":", *alike).alias("class"))
    # an entity of fewer texts has no pair of enough support
    return found.where(F.col("n_entity") >= min_support)


def disclosing(entities: DataFrame, terms: DataFrame, docs: DataFrame, theta: float, min_support: int) -> tuple[DataFrame, DataFrame]:
    """Written tables (entity, class, n_entity) and (class, term, n_both, n_entity, n_term) where the term reveals the class' entities.

    PMI >= theta * IC asks for n_term <= n_entity^theta * total^(1 - theta), as
    n_both is n_entity at most. So a text's terms are first cut to those not
    too common for its most frequent entity, which leaves few to be paired.
    """
    known = materialize(_classes(entities, min_support), "entities")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM_PATTERN), F.lit(0)))
    # each distinct text moves once, so its words are added up on the map side; all
    # are counted before the join: few terms are asked for in a small corpus and
    # nearly all in a large one
    texts = docs.select(text_of().alias("text")).groupBy(F.xxhash64("text").alias("digest")).agg(F.first("text").alias("text"))
    holding = texts.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = docs.select(F.xxhash64(text_of()).alias("digest")).distinct().agg(F.count(F.lit(1))).scalar()
    held = materialize(entities.select("digest", "entity").distinct().join(known, "entity").select("digest", "class", "n_entity").distinct(), "held_classes")
    rarest = F.pow("n_entity", F.lit(theta)) * F.pow(total, F.lit(1 - theta))
    limits = held.groupBy("digest").agg((F.max(rarest) * (1 + 1e-9)).alias("limit"))
    near = terms.select("digest", "term").distinct().join(limits, "digest").join(holding, "term", "left")
    # a word that lower case makes another word of is not among the counted ones
    n_term = F.coalesce("n_term", F.lit(min_support))
    near = near.where(n_term.between(min_support, F.col("limit"))).select("digest", "term", n_term.alias("n_term"))
    pairs = held.join(near, "digest").where(F.col("n_term") <= rarest * (1 + 1e-9))
    together = pairs.groupBy("class", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_entity").alias("n_entity"), F.greatest(F.first("n_term"), F.count(F.lit(1))).alias("n_term"))
    pmi = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    ic = F.log2(total / F.col("n_entity"))
    told = together.where((F.col("n_both") >= min_support) & (ic > 0) & (pmi >= theta * ic))
    return known, materialize(told, "disclosing")


def find_spans(docs: DataFrame, theta: float = 0.9, min_support: int = 3, keep_text: bool = False) -> DataFrame:
    """doc_id, digest-free spans of every row: ``base`` and ``terms``, arrays of (kind, start, end)."""
    found = materialize(base_spans(docs, keep_text), "base_spans")
    entities, terms = (materialize(x, label) for x, label in zip(mentions(found), ("mentions", "terms")))
    known, told = disclosing(entities, terms, docs, theta, min_support)
    # what a row's values have revealed of them, then where that stands in the row
    asked = entities.join(known, "entity").select("row", "class").distinct().join(told, "class").select("row", "term").distinct()
    terms = terms.join(asked, ["row", "term"], "left_semi").groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end"))).alias("terms")
    )
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    kept = ["text"] if keep_text else []
    return found.join(terms, "row", "left").select("doc_id", *kept, plain.alias("base"), F.coalesce("terms", none).alias("terms"))


def named_spans(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k, _, _ in KINDS], F.lit(TERM))
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text."""
    spans = find_spans(docs)
    counts = [F.size(F.filter("base", _of_kind(i))).cast("bigint").alias(f"n_{k}") for i, (k, _, _) in enumerate(KINDS)]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(named_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        named_spans(F.concat("base", "terms")).alias("spans"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*(k for k, _, _ in KINDS), TERM)])
    in_order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.sign(a["start"] - b["start"])).otherwise(F.sign(b["end"] - a["end"])).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        more = F.concat(acc["out"], F.array(between, F.get(names, s["kind"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    # pieces are gathered and joined once; a growing text would be copied at every span
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))
    return F.aggregate(in_order, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), rest(acc)))


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """doc_id and clean_text: protected values and disclosing terms generalised to their kind."""
    spans = find_spans(docs, keep_text=True, **settings)
    return spans.select("doc_id", redact(F.col("text"), F.concat("base", "terms")).alias("clean_text"))
