"""Conversations rendered by a compiled template, with a loss mask, and read back.

Rows of a conversation are ordered by turn, then by role and text where turns tie. A template renders a whole conversation;
its turns are streamed through the template's loop, two in memory at a time, and the text comes out in parts, so no
conversation is too long. Parts of a conversation put together are its formatted text, and the marked spans its loss mask.
A conversation is rendered by one task, as its text is one sequence.

The control strings of the template begin with `<` or `[`. In texts and roles these two, and the escape character
itself, are written as the escape character and a letter, so that no text can hold a control string and every text comes
back as it was.

Defined results: a null text or role is empty. A null conversation id is a conversation of its own. Rows alike in all
columns are turns of their own. A conversation in which a turn number is null has it first. An empty table gives an
empty result. Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.chat_template import TemplateError, compile_template
from cleargrain.llm.shared import read_table, taken

TEMPLATE = (
    "{%- for m in messages -%}"
    "{{ '<s>[' ~ (m.role | escape) ~ '] ' }}"
    "{%- if m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{%- else -%}{{ m.text | escape }}{%- endif -%}"
    "{{ ' [/' ~ (m.role | escape) ~ ']</s>' }}"
    "{%- endfor -%}"
)
#: Escape character and what stands for each character that control strings begin with.
ESCAPE = "\x1b"
CODES = {ESCAPE: "e", "<": "l", "[": "b", "]": "d"}
_TO = str.maketrans({k: ESCAPE + v for k, v in CODES.items()})
_FROM = {v: k for k, v in CODES.items()}


def escape(text: str) -> str:
    return text.translate(_TO)


def unescape(text: str) -> str:
    first, *rest = text.split(ESCAPE)
    return first + "".join(_FROM[x[0]] + x[1:] for x in rest)


PARTS = "part_no long, text string, marked array<int>"
#: Rows and characters of an Arrow batch; characters after which a conversation goes on in another row.
OUT_ROWS, OUT_CHARS = 5000, 4 << 20
PART_CHARS = 1 << 18


class Turns:
    """A conversation's turns as they come; a template goes through them once, from the first to the last."""

    def __init__(self, turns: Iterator[dict]):
        self._turns: Iterator[dict] | None = turns

    def __iter__(self) -> Iterator[dict]:
        turns, self._turns = self._turns, None
        if turns is None:
            raise TemplateError("the turns of a conversation are read once")
        return turns


def joined_parts(pieces: Iterator[tuple[str, bool]], most: int = PART_CHARS) -> Iterator[tuple[str, list[int]]]:
    """(text, flat [from, to) pairs of code points under the loss mask) of a rendered conversation, `most` characters and a piece at most."""
    texts: list[str] = []
    marked: list[int] = []
    size, none = 0, True
    for text, mark in pieces:
        if mark and text:
            if marked and marked[-1] == size:
                marked[-1] = size + len(text)
            else:
                marked += (size, size + len(text))
        texts.append(text)
        size += len(text)
        if size >= most:
            yield "".join(texts), marked
            texts, marked, size, none = [], [], 0, False
    if size or none:
        yield "".join(texts), marked


def rendered(rows: DataFrame, template: str = TEMPLATE, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """conversation, part_no, text and marked (flat [from, to) pairs of its code points under the loss mask).

    The template sees the whole conversation as `messages`. A conversation is one row, or several where it is long; its parts
    come in order within one partition.
    """
    part = taken(rows, conv=conversation, turn=turn, role=role, text=text)
    part = part.repartition(F.col("conv")).sortWithinPartitions("conv", "turn", "role", "text")
    kind = part.schema["conv"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        types: list[pa.DataType] = []

        def turns() -> Iterator[tuple[object, dict]]:
            for batch in batches:
                types[:] = [batch.schema.field(0).type]
                for conv, role_, text_ in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    yield conv, {"role": role_ or "", "text": text_ or ""}

        out: list[tuple] = []
        chars = 0
        for conv, own in groupby(turns(), key=itemgetter(0)):
            for number, (whole, marked) in enumerate(joined_parts(render({"messages": Turns(map(itemgetter(1), own))}), part_chars)):
                out.append((conv, number, whole, marked))
                chars += len(whole)
                if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield _batch(out, types[0])
                    out, chars = [], 0
        if out:
            yield _batch(out, types[0])

    return part.mapInArrow(work, f"conv {kind}, {PARTS}").withColumnRenamed("conv", conversation)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.list_(pa.int32())]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv", "part_no", "text", "marked"])


class Reader:
    """Reads formatted text back part by part: turns, the text under the mask, and lengths."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest, self.marks = "", []

    def part(self, text: str, marked: list[int]) -> None:
        had = len(self.rest)
        whole = self.rest + text
        marks = self.marks + [(a + had, b + had) for a, b in zip(marked[::2], marked[1::2], strict=True)]
        start, used = 0, 0
        while (end := whole.find("</s>", max(start, had - 3))) >= 0:
            end += 4
            first = used
            while used < len(marks) and marks[used][1] <= end:
                used += 1
            self._turn(whole[start:end], [whole[a:b] for a, b in marks[first:used]])
            start = end
        self.rest, self.marks = whole[start:], [(a - start, b - start) for a, b in marks[used:]]
        self.chars += len(text)

    def _turn(self, text: str, loss: list[str]) -> None:
        if not text.startswith("<s>[") or not text.endswith("]</s>"):
            raise ValueError("a part isn't a turn")
        edge = text.index("]", 4)
        role = unescape(text[4:edge])
        closing = f" [/{text[4:edge]}]</s>"
        if text[edge + 1] != " " or not text.endswith(closing):
            raise ValueError("a turn doesn't end as it began")
        body = unescape(text[edge + 2 : len(text) - len(closing)])
        self.turns.update(f"{role}\n{body}\n".encode())
        marked = unescape("".join(loss))
        self.loss.update(marked.encode())
        self.loss_chars += len(marked)
        self.n_turns += 1

    def figures(self) -> tuple[int, str, int, str, int]:
        if self.rest or self.marks:
            raise ValueError("a conversation ends within a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Digests of each conversation, from the parts in their order."""
    part = parts.select(F.col(conversation).alias("conv"), "part_no", "text", "marked")
    kind = part.schema["conv"].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, out, id_type = None, None, [], None

        def batch_of() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, number, text, marked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number == 0:
                    if reader is not None:
                        out.append((held, *reader.figures()))
                    reader, held = Reader(), conv
                    if len(out) >= OUT_ROWS:
                        yield batch_of()
                        out.clear()
                reader.part(text, marked)
        if reader is not None:
            out.append((held, *reader.figures()))
        if out:
            yield batch_of()

    return part.mapInArrow(work, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conversation)


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    return read_back(rendered(rows.unionByName(own)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x, [c IN (chr(27), '<', '[', ']') FOR c IN string_split(coalesce(role, ''), '')] AS rc, [c IN (chr(27), '<', '[', ']') FOR c IN string_split(coalesce(text, ''), '')] AS xc FROM t
), g AS (
  SELECT *, length(r) + len(list_filter(rc, lambda b: b)) AS rn, length(x) + len(list_filter(xc, lambda b: b)) AS xn FROM f
), l AS (
  SELECT conv_id, coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '') AS loss,
    string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns, count(*) AS n_turns, sum(14 + 2 * rn + xn)::BIGINT AS formatted_chars
  FROM g GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM l
"""
