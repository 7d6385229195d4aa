"""Column functions over text: numbers in names, markers, prompts, templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_integer(col: Column) -> Column:
    """First run of digits as a number, NULL without one."""
    return F.nullif(F.regexp_extract(col, r"\d+", 0), F.lit("")).cast("long")


def map_label(col: Column, labels: dict[str, str], default: str | None = "Unknown") -> Column:
    """Look a label up; ``default=None`` keeps the value itself when it is not listed."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col)
    return F.coalesce(found, col if default is None else F.lit(default))


def insert_before(col: Column, start: str, end: str, text: Column | str) -> Column:
    """Insert ``text`` before the first ``end`` at or after the first ``start``."""
    new = text if isinstance(text, Column) else F.lit(text)
    begin = F.position(F.lit(start), col)
    at = F.when(begin > 0, F.position(F.lit(end), col, begin)).otherwise(F.lit(0))
    changed = F.concat(F.substring(col, F.lit(1), at - 1), new, F.substring(col, at, F.length(col)))
    return F.when(at > 0, changed).otherwise(col)


def uncomment_block(col: Column, tag: str = "qt-opengl") -> Column:
    """Take the comment marks off lines from ``<!--…<tag>`` to ``</tag>-->``, one of each per line.

    The end is looked for from the line after the start; without one the block goes to
    the end of the text.
    """
    lines = F.split(col, "\n")
    marked = F.transform(
        lines,
        lambda line, i: F.struct(
            i.alias("i"),
            F.regexp_like(line, F.lit(rf"<!--.*<{tag}>")).alias("opens"),
            F.regexp_like(line, F.lit(rf"</{tag}>-->")).alias("closes"),
        ),
    )
    edges = F.filter(marked, lambda m: m["opens"] | m["closes"])
    span = "array<struct<a:int,b:int>>"
    start = F.struct(F.lit(-1).alias("at"), F.array().cast(span).alias("spans"))

    def step(state: Column, m: Column) -> Column:
        closed = F.array(F.struct(state["at"].alias("a"), m["i"].alias("b")))
        ends = (state["at"] >= 0) & m["closes"]
        at = F.when(ends, F.lit(-1)).when((state["at"] < 0) & m["opens"], m["i"]).otherwise(state["at"])
        spans = F.when(ends, F.concat(state["spans"], closed)).otherwise(state["spans"])
        return F.struct(at.alias("at"), spans.alias("spans"))

    def finish(state: Column) -> Column:
        rest = F.array(F.struct(state["at"].alias("a"), F.lit(2**31 - 1).alias("b")))
        return F.when(state["at"] >= 0, F.concat(state["spans"], rest)).otherwise(state["spans"])

    def bare(line: Column) -> Column:
        once = F.regexp_replace(line, r"^(.*?)<!--", "$1")
        return F.regexp_replace(once, r"^(.*?)-->", "$1")

    def rewrite(spans: Column) -> Column:
        return F.transform(
            lines,
            lambda line, i: F.when(
                F.exists(spans, lambda s: (i >= s["a"]) & (i <= s["b"])), bare(line)
            ).otherwise(line),
        )

    blocks = F.array(F.aggregate(edges, start, step, finish))
    return F.array_join(F.get(F.transform(blocks, rewrite), F.lit(0)), "\n")


def truncate_floats(col: Column, places: int = 2) -> Column:
    return F.regexp_replace(col, rf"(\d+\.\d{{{places}}})\d+", "$1")


def fill_template(template: str | Column, values: dict[str, Column]) -> Column:
    """Replace each placeholder of a shared skeleton by a per-row value."""
    out = template if isinstance(template, Column) else F.lit(template)
    for mark, value in values.items():
        out = F.replace(out, F.lit(mark), F.coalesce(value, F.lit("")))
    return out


def vector(col: Column, n: int) -> Column:
    """Array of ``n`` doubles from ``"a,b,c"``; NULL when the text has another form."""
    number = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
    shape = r"^\s*" + r"\s*,\s*".join([number] * n) + r"\s*$"
    parts = F.transform(F.split(col, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(F.regexp_like(col, F.lit(shape)), parts)


def clock(seconds: Column) -> Column:
    """Seconds as h:mm:ss."""
    s = seconds.cast("long")
    return F.format_string(
        "%d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    )


# The instruction texts that trained models expect, word for word.
SHORT_INSTRUCTION = (
    "\nGenerate the behavior tree that achieves the objective of this mission."
)
LONG_INSTRUCTION = (
    "\n\nGenerate the behavior tree that achieves the objective of this mission.\nThis is how the desired behavior tree syntax is structured:The first element is always the node identifier (like --nroot or --n0), followed by the type of node. 1 and 1 define selector nodes, 2 and 3 sequence nodes, 4 is a decorator node, 5 an action and 6 a condition. Different versions of the same node type are specified by --c[nodeID] parameter for conditions and --a[nodeID] parameter for actions. Conditions range from 0-6 with the order black floor, gray floor, white floor, neighbors count, inverted neighbors count, fixed probability and light. Depending on the condition, they have additional attributes like probability (p) or neighbors and epsilon (p, w). Actions range from 0-5 in the order exploration, stop, phototaxis, anti-phototaxis, attraction and repulsion. They all have a success probability parameter p. Additional parameters for some actions are steps range (rwm), attraction (att) and repulsion rep.\nNow generate the robot controller."
)


@dataclass(frozen=True)
class ChatFormat:
    """The marks a chat template puts around the turns; another model, another instance."""

    begin: str = "<s>"
    user_open: str = "[INST] "
    user_close: str = " [/INST]"
    answer_open: str = " "
    end: str = "</s>"

    def wrap(self, user: Column, answer: Column) -> Column:
        return F.concat(
            F.lit(self.begin + self.user_open),
            user,
            F.lit(self.user_close + self.answer_open),
            answer,
            F.lit(self.end),
        )


INSTRUCT = ChatFormat()


def short_prompt(user: Column, answer: Column, chat: ChatFormat = INSTRUCT) -> Column:
    return chat.wrap(F.concat(user, F.lit(SHORT_INSTRUCTION)), answer)


def long_prompt(user: Column, answer: Column, chat: ChatFormat = INSTRUCT) -> Column:
    return chat.wrap(F.concat(user, F.lit(LONG_INSTRUCTION)), answer)


def raw_prompt(user: Column, answer: Column, chat: ChatFormat = INSTRUCT) -> Column:
    return chat.wrap(user, answer)


def open_prompt(user: Column, prompt=short_prompt, head: int = 3, tail: int = 5) -> Column:
    """Prompt with an empty answer, without its first 3 and last 5 characters."""
    whole = prompt(user, F.lit(""))
    return F.substring(whole, F.lit(head + 1), F.length(whole) - (head + tail))


def extract_response(col: Column, fallback: bool = False) -> Column:
    """Text after the first ``[/INST]`` up to the next ``[/INST]`` or ``</s>``; else NULL or all of it."""
    part = F.try_element_at(F.split(col, r"\[/INST\]"), F.lit(2))
    answer = F.try_element_at(F.split(part, "</s>"), F.lit(1))
    return F.coalesce(answer, col) if fallback else answer
