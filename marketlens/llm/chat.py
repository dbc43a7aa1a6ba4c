"""Chat formatting: a finite-state machine over roles, segments with loss flags.

A template says declaratively how each role is written, whether its text counts
for the loss and which roles may precede it. The machine's state is the last
role; its verdict and the segments are column expressions, so the whole
operator stays in the JVM.

Defined results: a null role is an unknown role named "", a null text is the
empty text, rows of one turn number are ordered by role and then text, repeated
rows are repeated turns, a null ``conv_id`` is a conversation of its own. An
unknown role is written with its name and makes the conversation invalid.
A very long text is written whole; a conversation is one row, however long.
Extra input columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = ""
UNKNOWN = "?"


@dataclass(frozen=True)
class Role:
    """How a role's turn is written, and the states it may follow."""

    name: str
    prefix: str
    suffix: str
    loss: bool
    follows: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """``other`` writes the turns of unknown roles, with ``named`` between name and text."""

    roles: tuple[Role, ...]
    accept: tuple[str, ...]
    other: Role
    named: str

    @property
    def controls(self) -> tuple[str, ...]:
        """Control strings: the bracketed words of all prefixes and suffixes."""
        parts = [x for r in (*self.roles, self.other) for x in (r.prefix, r.suffix)] + [self.named]
        return tuple(dict.fromkeys(c for p in parts for c in re.findall(r"<[^<>\s]+>|\[[^\[\]\s]+\]", p)))


INSTRUCT = Template(
    roles=(
        Role("system", "[SYS] ", " [/SYS]\n", False, (START,)),
        Role("user", "[INST] ", " [/INST]\n", False, (START, "system", "assistant")),
        Role("assistant", "<s> ", " </s>\n", True, ("user",)),
    ),
    accept=("assistant",),
    other=Role(UNKNOWN, "[ROLE] ", " [/TURN]\n", False, ()),
    named=" [/ROLE] ",
)


def _rests(template: Template) -> str:
    return "|".join(re.escape(c[1:]) for c in template.controls)


def escape_pattern(template: Template) -> str:
    """Group 1: opening bracket, 2: backslashes so far, 3: rest of a control string."""
    return rf"([\[<])(\\*)({_rests(template)})"


def escape(text: Column, template: Template) -> Column:
    """Put one more backslash behind the bracket of each control string, so none is left.

    A string that has backslashes there already gets another, which makes it reversible.
    """
    return F.regexp_replace(text, escape_pattern(template), r"$1\\$2$3")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({_rests(template)})", r"$1$2$3")


def _by_role(template: Template, role: Column, field: str) -> Column:
    out = F.lit(getattr(template.other, field))
    for r in template.roles:
        out = F.when(role == r.name, F.lit(getattr(r, field))).otherwise(out)
    return out


def _segments(template: Template, turn: Column) -> Column:
    role = turn["role"]
    known = role.isin([r.name for r in template.roles])
    prefix = F.when(known, _by_role(template, role, "prefix")).otherwise(
        F.concat(F.lit(template.other.prefix), escape(role, template), F.lit(template.named))
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return F.array(
        segment(prefix, F.lit(False)),
        segment(escape(turn["text"], template), _by_role(template, role, "loss")),
        segment(_by_role(template, role, "suffix"), F.lit(False)),
    )


def _first_bad(template: Template, turns: Column) -> Column:
    """Place of the first turn the machine refuses, from 1; one past the end if it stops too early."""
    moves = [f"{state}>{r.name}" for r in template.roles for state in r.follows]
    start = F.struct(F.lit(START).alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        allowed = F.concat(acc["state"], F.lit(">"), turn["role"]).isin(moves)
        return F.struct(
            turn["role"].alias("state"),
            (acc["seen"] + 1).alias("seen"),
            F.coalesce(acc["bad"], F.when(~allowed, acc["seen"] + 1)).alias("bad"),
        )

    def finish(acc: Column) -> Column:
        return F.coalesce(acc["bad"], F.when(~acc["state"].isin(list(template.accept)), acc["seen"] + 1))

    return F.aggregate(turns, start, step, finish)


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation: formatted text, segments with loss flags, the machine's verdict.

    Turns are gathered on the map side first; a conversation becomes one text,
    so its turns meet in one row.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: _segments(template, t)))
    out = turns.select("conv_id", segments.alias("segments"), _first_bad(template, F.col("turns")).alias("first_bad_turn"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", formatted.alias("formatted"), "segments", F.col("first_bad_turn").isNull().alias("valid"), "first_bad_turn")


def parse_chat(formatted: Column, template: Template = INSTRUCT) -> Column:
    """Read a formatted text back: array of (role, text). Inverse of the formatting."""
    rules = (*template.roles, template.other)
    turn = "|".join(f"{re.escape(r.prefix)}.*?{re.escape(r.suffix)}" for r in rules)
    found = F.regexp_extract_all(formatted, F.lit(f"(?s){turn}"), F.lit(0))

    def inner(t: Column, r: Role) -> Column:
        return F.substring(t, F.lit(len(r.prefix) + 1), F.char_length(t) - len(r.prefix) - len(r.suffix))

    def parse(t: Column) -> Column:
        body = inner(t, template.other)
        cut = F.instr(body, template.named)
        role = F.substring(body, F.lit(1), cut - 1)
        text = F.substring(body, cut + len(template.named), F.char_length(body))
        for r in template.roles:
            mine = t.startswith(r.prefix)
            role = F.when(mine, F.lit(r.name)).otherwise(role)
            text = F.when(mine, inner(t, r)).otherwise(text)
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(found, parse)


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"], template)), "")


def chat_digests(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of what is read back from formatted conversations."""
    back = chats.select(
        "conv_id",
        "valid",
        "formatted",
        parse_chat(F.col("formatted"), template).alias("back"),
        loss_text(F.col("segments"), template).alias("learned"),
    )
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )
