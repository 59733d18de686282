"""Chat formatting: a finite-state machine over roles and a declarative template.

All steps are DataFrame functions. A template names the control strings; control strings inside
texts and roles are escaped and can be restored exactly."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written. ``{role}`` and ``{text}`` stand for a turn's parts."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple = ("assistant",)
    # state -> role -> next state; a pair that is missing is an error, from which nothing leads on
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "asked_nothing", "user": "asked"},
        "asked_nothing": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple = ("answered",)


DEFAULT = Template()


def escaped(text):
    """No control string can start in an escaped text: ``<|`` becomes ``<\\|``, a backslash two."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def restored(text):
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escaped_role(role):
    """A role is one line: line ends are written as ``\\n`` (backslash, n)."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def restored_role(role):
    """Backslashes pair up from the left, so a line end is an n behind an odd backslash."""
    lines = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return restored(lines)


def end_state(roles, template):
    """Run the machine over an array of roles."""
    table = F.create_map(*[F.lit(x) for state, row in template.moves.items()
                           for role, after in row.items() for x in (f"{state}>{role}", after)])
    return F.aggregate(roles, F.lit("start"),
                       lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), role)),
                                                      F.lit("error")))


def format_conversations(rows, template=DEFAULT):
    """One row per conversation of ``rows`` (conv_id, turn, role, text).

    Turns stand in the order of turn, then role, then text (ties and repeated rows stay, nulls come
    first); null roles and texts count as empty, other columns are ignored. A conversation whose
    roles break the turn order is formatted all the same, with ``valid`` false.

    Returns conv_id, valid, end_state, ``segments`` (text, loss) whose texts joined make up
    ``formatted``, and ``loss_spans`` (start, length), the code points of ``formatted`` under loss."""
    turns = (rows.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    pieces = turns.withColumn("segments", F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.open), escaped_role(t["role"]), F.lit(template.after_role)).alias("text"),
                 F.lit(False).alias("loss")),
        F.struct(escaped(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.close + template.after_turn).alias("text"), F.lit(False).alias("loss"))))))
    # running length over segments: (code points so far, spans found)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walked = F.aggregate(
        "segments", start,
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x["text"])).alias("at"),
            F.when(x["loss"], F.concat(s["spans"], F.array(F.struct(
                s["at"].alias("start"), F.char_length(x["text"]).alias("length")))))
            .otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    state = end_state(F.transform("turns", lambda t: t["role"]), template)
    return pieces.select(
        "conv_id", state.alias("end_state"), state.isin(*template.final).alias("valid"), "segments",
        walked.alias("loss_spans"), F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"))


def read_back(formatted, template=DEFAULT):
    """The turns and the text under the loss spans, from ``formatted`` and ``loss_spans`` alone.

    Returns conv_id, turns (role, text), loss_texts and formatted."""
    # what stands before the first turn is empty
    chunks = F.filter(F.split("formatted", _quoted(template.open)), lambda c, i: i > 0)
    tail = len(template.close + template.after_turn)
    return formatted.select(
        "conv_id", "formatted",
        F.transform(chunks, lambda c: F.struct(
            restored_role(F.substring_index(c, template.after_role, 1)).alias("role"),
            restored(_between(c, F.locate(template.after_role, c) + len(template.after_role), tail)).alias("text"))
        ).alias("turns"),
        F.transform("loss_spans", lambda s: restored(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
        .alias("loss_texts"))


def _between(text, first, tail):
    return F.substring(text, first, F.char_length(text) - tail - first + 1)


def _quoted(text):
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)
