"""Chat formatting by a declarative template, and a finite-state machine over roles; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """turn_open + role + text_open + text + turn_close for each turn; loss on the texts of loss_roles.

    control: strings that never stand unescaped inside a role or text; the three marks are among them. None may end as it
    or another begins (`aba` does), and no mark may hold another, so that what is formatted reads back in one way only.
    transitions: the state machine, from state to {role: next state}; a conversation is valid if every turn has a
    transition and the last state is final.
    """

    turn_open: str = "<|turn|>"
    text_open: str = "<|text|>"
    turn_close: str = "<|end|>"
    control: tuple[str, ...] = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "instructed", "user": "asked"},
        "instructed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })

    def __post_init__(self):
        if not {self.turn_open, self.text_open, self.turn_close} <= set(self.control):
            raise ValueError("the template's marks must be control strings")
        if any("\\" in c or len(c) < 2 for c in self.control):
            raise ValueError("control strings hold no backslash and at least two characters")
        for a in self.control:
            if any(a[k:] == b[: len(a) - k] for b in self.control for k in range(1, len(a)) if len(a) - k < len(b)):
                raise ValueError(f"a control string ends as one begins, so that its place in a text is not told: {a!r}")
        marks = (self.turn_open, self.text_open, self.turn_close)
        if any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
            raise ValueError("no mark of the template may hold another")


#: A state of no way back.
BROKEN = "broken"


def escape(text: Column, template: Template) -> Column:
    """Doubles each backslash, then puts one after the first character of each control string; unescape() reverses it."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), sorted(template.control, key=lambda c: (-len(c), c)), doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _machine(roles: Column, template: Template) -> Column:
    """The last state after roles, and how many turns were read before the first without a transition."""
    steps = F.create_map(*[F.lit(x) for s, row in template.transitions.items() for r, t in row.items() for x in (f"{s}\x00{r}", t)])

    def step(acc: Column, role: Column) -> Column:
        to = F.when(acc["state"] == BROKEN, F.lit(BROKEN)).otherwise(F.coalesce(F.try_element_at(steps, F.concat(acc["state"], F.lit("\x00"), role)), F.lit(BROKEN)))
        return F.struct(to.alias("state"), (acc["read"] + F.when(to == BROKEN, 0).otherwise(1)).alias("read"))

    return F.aggregate(roles, F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("read")), step)


def format_conversations(df: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: conv_col, valid, first_bad_turn, segments, formatted.

    segments: array of (text, loss) that concatenate to `formatted`, one for each mark, role and text. Roles and texts
    are escaped in them. Turns go by (turn, role, text). All conversations are formatted; `valid` says whether the
    state machine accepts the roles, first_bad_turn (from 0) where it stops, -1 if nowhere.

    Nulls: a null role or text is empty, a null turn comes first, a null conversation id is a conversation of its own.
    Repeated rows are turns of their own. An empty table gives an empty one; other columns are not read.
    A conversation becomes one value, so it must fit in a row; rows of one conversation are gathered once, after a shuffle.
    """
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = df.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    state = _machine(F.transform("ts", lambda t: t["role"]), template)

    def pieces(t: Column) -> Column:
        def seg(c: Column, loss: Column) -> Column:
            return F.struct(c.alias("text"), loss.alias("loss"))

        off = F.lit(False)
        return F.array(
            seg(F.lit(template.turn_open), off), seg(escape(t["role"], template), off), seg(F.lit(template.text_open), off),
            seg(escape(t["text"], template), t["role"].isin(*template.loss_roles)), seg(F.lit(template.turn_close), off),
        )

    out = turns.select("conv", F.size("ts").alias("n"), state.alias("state"), F.flatten(F.transform("ts", pieces)).alias("segments"))
    bad = F.when(F.col("state.state") == BROKEN, F.col("state.read")).when(~F.col("state.state").isin(*template.final), F.col("n") - 1).otherwise(-1)
    return out.select(F.col("conv").alias(conv_col), (bad == -1).alias("valid"), bad.cast("int").alias("first_bad_turn"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse_formatted(formatted: Column, template: Template = Template()) -> Column:
    """Back from a formatted string: array of (role, text), unescaped. An empty string has no turns."""
    quoted = r"\Q" + template.turn_close + r"\E"
    parts = F.split(formatted, quoted, -1)
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def read(p: Column) -> Column:
        body = F.substr(p, F.lit(len(template.turn_open) + 1))
        at = F.instr(body, template.text_open)
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + len(template.text_open))).alias("text"))

    return F.transform(turns, read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(df: DataFrame, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests of what format_conversations() returned, read from its segments and formatted strings."""
    read = df.select(F.col(conv_col), "valid", "first_bad_turn", parse_formatted(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid", "first_bad_turn",
    )
