"""Chat formatting: a role automaton checks the turn order, a declarative template makes segments with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands where a control string inside a text was broken up; followed by 0 it is the letter itself.
_ESCAPE = "␛"


@dataclass(frozen=True)
class Role:
    """How a role's turns look: ``opening`` + text + ``closing``; only the text of a ``learned`` role bears loss."""

    opening: str
    closing: str
    learned: bool = False


@dataclass(frozen=True)
class Template:
    """``roles`` by name; any other role is written by ``other``, its name between the two strings of ``named``.

    ``follows`` holds the automaton: for each role (None: the start) those that may come next; ``last`` those that may
    end a conversation. The first letter of a control string must occur in no control string again, so that no text
    can complete one together with what stands beside it.
    """

    roles: dict[str, Role]
    other: Role
    named: tuple[str, str]
    follows: dict[str | None, tuple[str, ...]]
    last: tuple[str, ...]
    reserved: tuple[str, ...] = field(default=())

    @property
    def controls(self) -> list[str]:
        parts = [*self.reserved, *self.named]
        for role in [*self.roles.values(), self.other]:
            parts += [role.opening, role.closing]
        return sorted({p for p in parts if p})

    def __post_init__(self):
        first = {c[0] for c in self.controls}
        if any(len(c) < 2 or first & set(c[1:]) or _ESCAPE in c for c in self.controls):
            raise ValueError("a control string must have two letters or more and begin with a letter that none goes on with")


#: Each opening differs from all others, so that a written turn can be read back.
INSTRUCT = Template(
    roles={"system": Role("[SYS]", "[/SYS]"), "user": Role("[INST]", "[/INST]"), "assistant": Role("[ANS]", "</s>", learned=True)},
    other=Role("", "[/TURN]"),
    named=("[ROLE]", "[/ROLE]"),
    follows={None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    last=("assistant",),
    reserved=("<s>",),
)


def escape(text: Column, template: Template) -> Column:
    """The text with every control string broken after its first letter; ``unescape`` gives the text back."""
    out = F.replace(text, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}0"))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}{_ESCAPE}1{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"{_ESCAPE}1"), F.lit("")), F.lit(f"{_ESCAPE}0"), F.lit(_ESCAPE))


def _by_role(role: Column, template: Template, known, other: Column) -> Column:
    out = None
    for name, form in template.roles.items():
        out = F.when(role == name, known(form)) if out is None else out.when(role == name, known(form))
    return other if out is None else out.otherwise(other)


def format_turns(turns: DataFrame, template: Template = INSTRUCT, run: int = 1024) -> DataFrame:
    """Per row of ``turns`` (conv_id, turn, role, text): conv_id, turn, role, accepted, segments.

    ``segments`` is an array of (text, loss): opening, escaped text, closing. ``accepted`` is false where the automaton
    has no step from the turn before to this one (for a first turn: from the start). Turns are ordered by turn, then role
    and text; a missing turn comes first; a missing role or text counts as empty; repeated rows are turns of their own; an
    empty table gives no rows; other columns are not read. Every turn is written, accepted or not.

    The automaton's state after a turn is the turn's role, so a step needs one row before. Rows are looked at in runs of
    turn numbers; the state at a run's start comes from the run before it, so one huge conversation is many small groups.
    """
    rows = turns.select(
        turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"),
        F.coalesce(turns["text"], F.lit("")).alias("text"),
        F.coalesce(F.floor(turns["turn"] / run), F.lit(-(1 << 62))).cast("bigint").alias("run"),
    )
    order = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    ends = rows.groupBy("conv_id", "run").agg(F.max(F.struct("turn", "role", "text"))["role"].alias("state"))
    carried = F.lag("state").over(Window.partitionBy("conv_id").orderBy("run"))
    starts = ends.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), carried.alias("carried"))
    rows = rows.withColumn("inside", F.lag("role").over(order)).join(
        starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")), "left"
    )
    state, role, text = F.coalesce("inside", "carried"), F.col("role"), escape(F.col("text"), template)
    steps = [(state.isNull() if a is None else state == a) & role.isin(*b) for a, b in template.follows.items()]
    accepted = steps[0]
    for step in steps[1:]:
        accepted = accepted | step
    name = F.concat(F.lit(template.named[0]), escape(role, template), F.lit(template.named[1] + template.other.opening))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    segments = F.array(
        segment(_by_role(role, template, lambda f: F.lit(f.opening), name), F.lit(False)),
        segment(text, _by_role(role, template, lambda f: F.lit(f.learned), F.lit(template.other.learned))),
        segment(_by_role(role, template, lambda f: F.lit(f.closing), F.lit(template.other.closing)), F.lit(False)),
    )
    return rows.select("conv_id", "turn", "role", F.coalesce(accepted, F.lit(False)).alias("accepted"), segments.alias("segments"))


def written(segments: Column) -> Column:
    """A turn as one string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_spans(segments: Column) -> Column:
    """Where the loss mask stands in the written turn: an array of (start from 0, length), in code points."""

    def span(segment: Column, place: Column) -> Column:
        before = F.aggregate(F.slice(segments, 1, place), F.lit(0), lambda total, s: total + F.length(s["text"]))
        return F.struct(segment["loss"].alias("loss"), before.alias("start"), F.length(segment["text"]).alias("length"))

    marked = F.filter(F.transform(segments, span), lambda s: s["loss"])
    return F.transform(marked, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))


def write_turns(formatted: DataFrame) -> DataFrame:
    """What a trainer gets, per turn of ``format_turns``: conv_id, turn, accepted, written (one string) and mask (spans of it)."""
    return formatted.select("conv_id", "turn", "accepted", written(F.col("segments")).alias("written"), loss_spans(F.col("segments")).alias("mask"))


def masked(turn: Column, mask: Column) -> Column:
    """All text of a written turn under its mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(turn, s["start"] + 1, s["length"]))), "")


def read_turn(turn: Column, template: Template = INSTRUCT) -> Column:
    """(role, text) of a written turn. Which of its text bears loss is not in the string: the mask says so."""
    head = F.substring_index(F.substring(turn, len(template.named[0]) + 1, 1 << 30), template.named[1], 1)

    def between(opening: Column, closing: str) -> Column:
        return F.substring(turn, F.length(opening) + 1, F.length(turn) - F.length(opening) - len(closing))

    def read(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    name = F.concat(F.lit(template.named[0]), head, F.lit(template.named[1] + template.other.opening))
    out = F.when(turn.startswith(template.named[0]), read(unescape(head), between(name, template.other.closing)))
    for role, form in template.roles.items():
        out = out.when(turn.startswith(form.opening), read(F.lit(role), between(F.lit(form.opening), form.closing)))
    return out


def digest(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, read back from what ``write_turns`` gives: counts and hashes of its turns and of its loss mask.

    Roles and texts come from the written string, the text that bears loss from the written mask alone: a mask that does not
    fit the template gives other values. A hash of a whole conversation needs its texts in one place: this summary, not the
    formatting, gathers a conversation.
    """
    out = write_turns(formatted)
    read = out.select(
        "conv_id", "turn", "accepted", F.length("written").alias("chars"), read_turn(F.col("written"), template).alias("r"),
        masked(F.col("written"), F.col("mask")).alias("loss"),
    )
    per = read.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.min("accepted").alias("steps"),
        F.array_sort(F.collect_list(F.struct("turn", "r.role", "r.text", "loss"))).alias("t"),
    )
    # Missing turn numbers come first here and last in array_sort.
    missing, there = (F.filter("t", lambda x: x["turn"].isNull()), F.filter("t", lambda x: x["turn"].isNotNull()))
    per = per.withColumn("t", F.concat(missing, there))
    loss = F.array_join(F.transform("t", lambda x: x["loss"]), "")
    turns = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
        (F.col("steps") & F.element_at("t", -1)["role"].isin(*template.last)).alias("valid"),
    )
