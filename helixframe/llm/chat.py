"""Chat formatting from a declarative template, in DataFrame expressions only.

A template gives each role a text before and after the turn and says whether the turn's text counts
for the loss. Control strings inside texts are escaped with a backslash, which unescaping takes away
again, so that a formatted conversation can be read back turn by turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """How the turns of a role are written."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role; ``other`` writes any further role, whose name stands between ``before`` and ``named``.

    ``order`` is the state machine: state -> {role: next state}; a missing entry is an error state.
    ``final`` holds the states in which a conversation may end.
    """

    begin: str
    roles: dict[str, Turn]
    other: Turn
    named: str
    order: dict[str, dict[str, str]] = field(default_factory=dict)
    start: str = "start"
    final: tuple[str, ...] = ()

    def __post_init__(self):
        marks = self.controls()
        for a in marks:
            if not a or ESCAPE in a:
                raise ValueError("control strings are not empty and hold no backslash")
            for b in marks:
                if any(b.endswith(a[:n]) for n in range(1, len(a))):
                    raise ValueError(f"{b!r} ends as {a!r} begins: texts could not be told from marks")
                if a != b and a in b:
                    raise ValueError(f"{a!r} lies within {b!r}")

    def controls(self) -> list[str]:
        turns = [*self.roles.values(), self.other]
        return sorted({self.begin, self.named, *(t.before for t in turns), *(t.after for t in turns)})


#: Roles in brackets; the answer closes with the end-of-sequence mark.
BRACKETS = Template(
    begin="<s>",
    roles={"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("[ANS]", "</s>", loss=True)},
    other=Turn("[ROLE]", "[/TEXT]"),
    named="[TEXT]",
    order={"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    final=("assistant",),
)


def escaped(text: Column, template: Template) -> Column:
    """Doubles backslashes and breaks every control string after its first character."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in template.controls():
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = BRACKETS) -> DataFrame:
    """One row per conversation: ``(conv, formatted, segments, valid)``.

    ``segments`` is an array of (text, loss) in order, whose texts joined are ``formatted``; ``valid``
    tells whether the roles pass the template's state machine. Invalid conversations are formatted
    all the same.

    Turns go by ``turn`` (null first), then role and text; repeated rows are turns of their own. Null
    roles and texts count as empty, null conversation ids as one conversation. Other columns of the
    input are left out; a key named like one of the columns returned gets an underscore behind its
    name. Each turn is escaped before the shuffle, and a conversation is one row: it is as long as its
    turns together.
    """
    name, body = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    head = F.concat(F.lit(template.other.before), escaped(name, template), F.lit(template.named))
    tail, loss = F.lit(template.other.after), F.lit(template.other.loss)
    for known, how in template.roles.items():
        head = F.when(name == known, F.lit(how.before)).otherwise(head)
        tail = F.when(name == known, F.lit(how.after)).otherwise(tail)
        loss = F.when(name == known, F.lit(how.loss)).otherwise(loss)
    own = conv + "_" if conv.lower() in ("formatted", "segments", "valid", "rows", "row") else conv
    rows = turns.select(F.col(conv).alias(own), F.struct(F.col(turn).alias("turn"), name.alias("role"), body.alias("text"), escaped(body, template).alias("body"), head.alias("head"), tail.alias("tail"), loss.alias("loss")).alias("row"))
    rows = rows.groupBy(own).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    plain = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
    segments = F.flatten(F.transform("rows", lambda r: F.array(plain(r["head"]), F.struct(r["body"].alias("text"), r["loss"].alias("loss")), plain(r["tail"]))))
    segments = F.concat(F.array(plain(F.lit(template.begin))), segments)
    steps = F.create_map(*(F.lit(x) for state, nexts in template.order.items() for r, to in nexts.items() for x in (f"{state}\n{r}", to)))
    state = F.aggregate(F.transform("rows", lambda r: r["role"]), F.lit(template.start), lambda s, r: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit("\n"), r)), F.lit("error")))
    out = rows.select(own, "rows", state.isin(list(template.final)).alias("valid"))
    return out.select(own, F.array_join(F.transform(segments, lambda s: s["text"]), "").alias("formatted"), segments.alias("segments"), "valid")


def read_back(formatted: Column, template: Template = BRACKETS) -> Column:
    """The turns of a formatted conversation: an array of (role, text, loss), unescaped."""
    known = [(r, re.escape(t.before), re.escape(t.after)) for r, t in template.roles.items()]
    rest = (re.escape(template.other.before), re.escape(template.named), re.escape(template.other.after))
    each = "(?s)(?:" + "|".join([*(f"{b}.*?{a}" for _, b, a in known), f"{rest[0]}.*?{rest[2]}"]) + ")"
    whole = F.regexp_extract_all(formatted, F.lit(each), F.lit(0))

    def turn(s: Column) -> Column:
        named = F.instr(s, template.named)
        role = unescaped(F.substring(s, len(template.other.before) + 1, named - len(template.other.before) - 1))
        text = F.substring(s, named + len(template.named), F.length(s) - named - len(template.named) + 1 - len(template.other.after))
        loss = F.lit(template.other.loss)
        for r, t in template.roles.items():
            mine = F.startswith(s, F.lit(t.before))
            role, loss = F.when(mine, F.lit(r)).otherwise(role), F.when(mine, F.lit(t.loss)).otherwise(loss)
            text = F.when(mine, F.substring(s, len(t.before) + 1, F.length(s) - len(t.before) - len(t.after))).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"), loss.alias("loss"))

    return F.transform(whole, turn)
