"""Chat formatting: conversations rendered by a compiled template, with the spans a model is trained on.

The template (see ``templates``) is one loop over the messages.  ``CHATML`` marks each turn and puts control
strings inside texts and roles out of action reversibly: ``<|`` with any backslashes between becomes the
same with one backslash more, so no text can hold a mark, and reading takes one away.

``format_turns`` renders row by row, without a shuffle: a conversation of any length is rendered in as many tasks as
its rows are read by.  Only a template that asks for its place in the loop (``loop.first``, ``loop.last`` and so on, or
text around the loop) makes a window over each conversation; that window streams and spills.  ``read_back`` parses rendered turns again and digests each conversation.  A digest over a whole
conversation is sequential by definition: its turns stream through one task, sorted on disk, one batch in
memory; nothing is collected.

Defined results: rows are turns; a null text or role is empty; turns are in the order of turn (nulls first), role and
text, so equal rows stay apart, each a turn of its own; a null conv_id is one conversation; no rows, no
conversations; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import use_query_conf
from .common import ready_python
from .templates import Output, Template, as_text, loop_state

START, END = "<|im_start|>", "<|im_end|>"


def guard(text: str) -> str:
    """No ``<|`` is left; ``unguard`` gives the text back."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unguard(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "\\" in text else text


def guard_line(text: str) -> str:
    """``guard`` for a text that has to stay on one line."""
    return guard(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unguard_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unguard(text), flags=re.S)


def _guard_value(v) -> str:
    return guard(as_text(v))


def _guard_line_value(v) -> str:
    return guard_line(as_text(v))


CHAT_FILTERS = {"guard": _guard_value, "guard_line": _guard_line_value}

CHATML = """
{%- for m in messages -%}
{{ '<|im_start|>' ~ (m.role | guard_line) ~ '\\n' }}
{%- if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}
{%- else %}{{ m.text | guard }}{% endif -%}
{{ '<|im_end|>\\n' }}
{%- endfor -%}
"""

TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def compile_chat(source: str = CHATML) -> Template:
    return Template(source, CHAT_FILTERS)


def _columns(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


ORDER = ("turn", "role", "text")


def format_turns(conversations: DataFrame, source: str = CHATML) -> DataFrame:
    """One row a turn: ``conv_id, turn, role, text`` and its rendering ``formatted`` with ``starts`` and
    ``ends`` of the generated spans in it (code points).  What the template writes before its loop
    belongs to a conversation's first turn, what it writes after it to the last."""
    spark = conversations.sparkSession
    ready_python(spark)
    use_query_conf(spark)
    template = compile_chat(source)
    head, _, _, tail, fields = template.turns()
    around = [Output(), Output()]
    head({}, around[0])
    tail({}, around[1])
    edges = any(o.length for o in around)
    rows = _columns(conversations)
    fields = {f.removeprefix("loop.") for f in fields} | ({"first"} if around[0].length else set()) \
        | ({"last"} if around[1].length else set())
    unknown = fields - set(loop_state(0, None, True, None))
    if unknown:
        raise ValueError(f"no loop.{sorted(unknown)[0]}")
    w = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])
    both = {"index0": F.row_number().over(w) - 1,
            "previous": F.lag(F.struct("role", "text")).over(w), "following": F.lead(F.struct("role", "text")).over(w)}
    need = []
    if fields & {"index", "index0", "first"}:
        need.append("index0")
    if "previtem" in fields:
        need.append("previous")
    if "nextitem" in fields:
        need.append("following")
    if "last" in fields:
        both["last"] = F.lead(F.lit(False), 1, True).over(w)
        need.append("last")
    rows = rows.select("*", *[both[n].alias(n) for n in need])
    names = ["formatted", "starts", "ends"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, variable, turn, after, _ = template.turns()
        for batch in batches:
            got = {n: batch.column(n).to_pylist() for n in ["role", "text", *need]}
            out = []
            for i in range(batch.num_rows):
                o = Output()
                place = loop_state(got["index0"][i] if "index0" in got else 0, got.get("previous", {i: None})[i],
                                   got["last"][i] if "last" in got else False, got.get("following", {i: None})[i])
                if edges and place["first"] and "index0" in got:
                    before({}, o)
                turn({variable: {"role": got["role"][i], "text": got["text"][i]}, "loop": place}, o)
                if edges and place["last"]:
                    after({}, o)
                out.append(o)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv_id", "turn", "role", "text")],
                 pa.array([o.text() for o in out], pa.string()),
                 pa.array([[a for a, _ in o.spans] for o in out], pa.list_(pa.int64())),
                 pa.array([[b for _, b in o.spans] for o in out], pa.list_(pa.int64()))],
                names=["conv_id", "turn", "role", "text", *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:4]) \
        + ", formatted string, starts array<bigint>, ends array<bigint>"
    return rows.mapInArrow(render, schema)


class _Reader:
    """Digests of one conversation, fed with its rendered turns in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def feed(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        at = 0
        for m in TURN.finditer(formatted):
            if m.start() != at:
                break
            at = m.end()
            for part in (unguard_line(m.group(1)), "\n", unguard(m.group(2)), "\n"):
                self.turns.update(part.encode("utf-8"))
            self.n_turns += 1
        if at != len(formatted):
            raise ValueError(f"conversation {self.conv_id}: {formatted[at:at + 40]!r} is no rendered turn")
        for a, b in zip(starts, ends):
            text = unguard(formatted[a:b])
            self.loss.update(text.encode("utf-8"))
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)


def read_back(turns: DataFrame) -> DataFrame:
    """Rendered ``CHATML`` turns parsed again, one row a conversation: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv_type = turns.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for batch in batches:
            done = []
            ids = batch.column("conv_id")
            for conv, *turn in zip(ids.to_pylist(), *[batch.column(c).to_pylist() for c in ("formatted", "starts", "ends")]):
                if reader is None or reader.conv_id != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.feed(*turn)
            if done:
                yield _batch(done, names, ids.type)
            kind = ids.type
        if reader is not None:
            yield _batch([reader.row()], names, kind)

    spark = turns.sparkSession
    ready_python(spark)
    ordered = turns.repartition(F.col("conv_id")) \
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ORDER]) \
        .select("conv_id", "formatted", "starts", "ends")
    return ordered.mapInArrow(digest, f"conv_id {conv_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                      "loss_sha256 string, formatted_chars bigint")


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


__all__ = ["CHATML", "compile_chat", "format_turns", "guard", "read_back", "unguard"]
