"""Chat conversations as training texts, in column expressions only.

A template says how turns are marked, which roles are learned, and which role may follow which. A finite
state machine runs over the roles of a conversation; every turn emits three text segments, the learned texts
flagged for the loss. What a mark of the template could begin with is escaped inside roles and texts, and
``read_turns`` undoes that; templates whose marks cannot be told apart are refused.

A conversation is put together in two steps, blocks of turns and then the blocks in order. A block's run of
the machine is a table, from every state it could start in to the state it ends in, so blocks are worked on
wherever they are and a long conversation is no single task's work before the last step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS_PER_BLOCK = 64


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    # (state, role) -> next state; anything else is an error. A conversation may end in ``final``.
    start: str = "start"
    follows: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        """Refuses marks that no escaping of roles and texts can tell apart."""
        if not self.after_role or not self.closing:
            raise ValueError("a role and a turn must end in a mark")
        if any("\\" in mark for mark in (self.opening, self.after_role, self.closing)):
            raise ValueError("marks cannot contain the escape sign, a backslash")
        for mark in (self.opening, self.after_role):
            ends = [mark[i:] for i in range(len(mark))]
            if self.closing in mark or any(self.closing.startswith(end) for end in ends):
                raise ValueError(f"{mark!r} may end in the closing mark or in its beginning")

    def _guard(self, mark: str) -> str:
        """What is kept out of escaped texts, so that the mark cannot begin in one: two signs of the mark, or its first
        where a mark that follows could supply the second."""
        alone = len(mark) == 1 or mark[1] in {m[0] for m in (self.opening, self.after_role, self.closing) if m}
        return mark[0] if alone else mark[:2]

    def escapes(self, role: bool) -> list[tuple[str, str]]:
        """What is replaced in texts, or in roles, and by what, in this order; undone in the reverse order.

        Every backslash of an escaped text begins an escape of two signs, the second of which is no backslash, and
        signs that stand for others are in no mark.
        """
        marks = [m for m in (self.opening, self.closing, self.after_role) if m]
        free = (c for c in "bnopqrstuvwxyzacdefghijklmBNOPQRSTUVWXYZACDEFGHIJKLM0123456789" if c not in "".join(marks))
        guards = {g: None for g in sorted({self._guard(m) for m in marks}, key=len)}
        found = [("\\", "\\" + next(free))]
        found += [(g, "\\" + next(free)) if len(g) == 1 else (g, f"{g[0]}\\{g[1]}") for g in guards]
        used = {self._guard(m) for m in marks if role or m != self.after_role}
        return [(a, b) for a, b in found if a == "\\" or a in used]

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *(x for a, _, b in self.follows for x in (a, b))]))

    @property
    def roles(self) -> list[str]:
        return list(dict.fromkeys(role for _, role, _ in self.follows))


def escape(text: Column, template: Template, role: bool = False) -> Column:
    """The text without anything that an opening or closing mark could begin with; in a role, nor the mark after it."""
    for plain, escaped in template.escapes(role):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column, template: Template, role: bool = False) -> Column:
    for plain, escaped in reversed(template.escapes(role)):
        if len(plain) == 2:
            plain, escaped = plain[1], escaped[1:]
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _run(roles: Column, template: Template) -> Column:
    """For each state, as an index, the state after the roles; or, from the first turn in error on, -1 - that turn."""
    states, names = template.states, template.roles
    to = {(a, r): states.index(b) for a, r, b in template.follows}
    table = F.array(*[F.array(*[F.lit(to.get((s, r))).cast("int") for r in names]) for s in states])
    first = F.struct(F.array(*[F.lit(i) for i in range(len(states))]).alias("of"), F.lit(0).alias("n"))

    def step(so_far: Column, role: Column) -> Column:
        at = F.array_position(F.array(*map(F.lit, names)), role).cast("int")
        follow = lambda s: F.when(s < 0, s).otherwise(
            F.coalesce(F.when(at > 0, F.get(F.get(table, s), at - 1)), -1 - so_far["n"])
        )
        return F.struct(F.transform(so_far["of"], follow).alias("of"), (so_far["n"] + 1).alias("n"))

    return F.aggregate(roles, first, step, lambda x: x["of"])


def format_chats(
    turns: DataFrame,
    template: Template = Template(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """(conv_id, n_turns, valid, error_turn, segments, formatted), a row per conversation.

    Turns are in the order of their number, a null first, and for equal numbers of role and text; repeated rows
    are turns of their own. Null roles and texts count as empty. Every conversation is formatted; ``valid`` says
    whether the machine accepts it, ``error_turn`` which turn, from 0, it stopped at. ``segments`` are
    (text, loss); ``formatted`` is their concatenation. A null conversation id is a conversation. No rows, no
    conversations. Other columns are not read.
    """
    col = lambda name: F.col(f"`{name}`")
    rows = turns.select(
        col(conv_col).alias("conv_id"),
        F.floor(F.coalesce(col(turn_col), F.lit(-1)) / turns_per_block).alias("block"),
        F.struct(
            col(turn_col).alias("turn"),
            F.coalesce(col(role_col), F.lit("")).alias("role"),
            F.coalesce(col(text_col), F.lit("")).alias("text"),
        ).alias("said"),
    )
    learned = list(template.learned)

    def parts(said: Column) -> Column:
        role = escape(said["role"], template, role=True)
        opening = F.concat(F.lit(template.opening), role, F.lit(template.after_role))
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(opening, F.lit(False)),
            segment(escape(said["text"], template), said["role"].isin(learned)),
            segment(F.lit(template.closing), F.lit(False)),
        )

    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("said")).alias("said"))
    blocks = blocks.select(
        "conv_id",
        F.struct(
            "block",
            F.size("said").alias("n"),
            _run(F.transform("said", lambda s: s["role"]), template).alias("of"),
            F.flatten(F.transform("said", parts)).alias("segments"),
        ).alias("part"),
    )
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    start = F.struct(F.lit(template.states.index(template.start)).alias("state"), F.lit(0).alias("n"))

    def step(so_far: Column, part: Column) -> Column:
        to = F.get(part["of"], so_far["state"])
        state = F.when(so_far["state"] < 0, so_far["state"]).when(to < 0, to - so_far["n"]).otherwise(to)
        return F.struct(state.alias("state"), (so_far["n"] + part["n"]).alias("n"))

    final = [template.states.index(s) for s in template.final]
    return whole.select(
        "conv_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_turns"),
        F.aggregate("parts", start, step, lambda x: x["state"]).alias("state"),
        F.flatten(F.transform("parts", lambda p: p["segments"])).alias("segments"),
    ).select(
        "conv_id",
        "n_turns",
        F.col("state").isin(final).alias("valid"),
        F.when(F.col("state") < 0, -1 - F.col("state")).alias("error_turn"),
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    # Every turn ends with the closing mark, so the last piece is empty.
    pieces = F.split(formatted, r"\Q" + template.closing + r"\E")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(template.opening) + 1))
        role = F.substring_index(rest, template.after_role, 1)
        text = F.substr(rest, F.length(role) + len(template.after_role) + 1)
        return F.struct(unescape(role, template, role=True).alias("role"), unescape(text, template).alias("text"))

    return F.transform(pieces, turn)


def learned_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)))
