"""Chat formatting: a finite-state machine over roles and a declarative template. DataFrame functions only.

A conversation's turns are put in order and emitted as segments (text, loss): marker, role, marker, text, marker. Only assistant
texts bear loss. Control strings inside roles and texts get the escape character after their first character, and escape
characters are doubled, so `read_back` restores every text exactly.

The machine accepts an optional system turn, then user and assistant turns by turns, a user first. It reports; conversations
that break the order are formatted like the others.

Defined results: a null role or text is empty; turns are ordered by turn (null first), then role, then text; repeated rows are
turns of their own; conversations without id form one; no rows give none; other columns are ignored. A conversation is one output
row, so its turns meet in one task, as its output does.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole


@dataclass(frozen=True)
class Template:
    """Markers around each turn, the roles whose texts bear loss, other strings that tokenizers take as control strings, and the moves of the state machine."""

    open: str = "<|turn|>"
    mid: str = "<|text|>"
    close: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
    escape: str = "\\"
    moves: dict = field(default_factory=lambda: {"start>system": "asked", "start>user": "user", "asked>user": "user", "user>assistant": "assistant", "assistant>user": "user"})
    last: tuple[str, ...] = ("user", "assistant")

    @property
    def controls(self) -> list[str]:
        return sorted({self.open, self.mid, self.close.strip(), *self.reserved})

    def escaped(self, text: Column) -> Column:
        e = self.escape
        return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(c[0] + e + c[1:])), self.controls, F.replace(text, F.lit(e), F.lit(e + e)))

    def plain(self, text: Column) -> Column:
        e = self.escape
        return F.replace(reduce(lambda x, c: F.replace(x, F.lit(c[0] + e + c[1:]), F.lit(c)), self.controls, text), F.lit(e + e), F.lit(e))


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: conv_id, segments, formatted (the segments' texts joined), valid and broken_at (the first turn, from 0, that the machine rejects)."""
    t = template or Template()
    ordered = turns.select("conv_id", F.struct("turn", whole("role").alias("role"), whole("text").alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(F.transform("t", lambda x: F.array(seg(F.concat(F.lit(t.open), t.escaped(x["role"]), F.lit(t.mid)), no), seg(t.escaped(x["text"]), x["role"].isin(*t.loss_roles)), seg(F.lit(t.close), no))))
    moves = F.create_map(*[F.lit(x) for kv in t.moves.items() for x in kv])
    # the state after each turn; a rejected turn leads to "broken:<turn>", where it stays
    step = lambda acc, x: F.struct(F.when(acc["s"].startswith("broken"), acc["s"]).otherwise(F.coalesce(F.try_element_at(moves, F.concat_ws(">", acc["s"], x["role"])), F.concat(F.lit("broken:"), acc["n"].cast("string")))).alias("s"), (acc["n"] + 1).alias("n"))
    state = F.aggregate("t", F.struct(F.lit("start").alias("s"), F.lit(0).alias("n")), step)["s"]
    return (
        ordered.select("conv_id", segments.alias("segments"), state.alias("state"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .select("conv_id", "segments", "formatted", F.col("state").isin(*t.last).alias("valid"), F.regexp_extract("state", "^broken:(.*)$", 1).try_cast("long").alias("broken_at"))
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds turns (role, text), parsed from the formatted text alone, and loss_text, the texts under the loss mask."""
    t = template or Template()
    # every marker in the text is the template's own; a turn ends where the next marker stands
    raw = F.filter(F.split("formatted", F.lit(r"\Q" + t.open + r"\E")), lambda x: x != "")
    pair = F.transform(raw, lambda x: F.split(F.substring(x, F.lit(1), F.length(x) - len(t.close)), F.lit(r"\Q" + t.mid + r"\E")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.plain(s["text"])), "")
    return formatted.withColumns({"turns": F.transform(pair, lambda p: F.struct(t.plain(p[0]).alias("role"), t.plain(p[1]).alias("text"))), "loss_text": loss})


def chat_digest(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """The digests of what read_back finds in the output."""
    back = read_back(format_conversations(turns, template), template)
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
