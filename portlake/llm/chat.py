"""Conversations rendered by a compiled template, and read back from the rendered text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .template import Template, show, show_line

#: Marks every turn; the texts of the assistant are what the model learns.
TURNS = (
    "{% for message in messages %}{{ '<|im_start|>' ~ message.role|escape_line ~ '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text|escape }}{% endgeneration %}{% else %}{{ message.text|escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)
_START, _END = "<|im_start|>", "<|im_end|>\n"


@lru_cache(maxsize=8)
def compiled(source: str) -> Template:
    return Template(source)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def format_conversations(turns: DataFrame, template: str = TURNS, limit: int = 1 << 20) -> DataFrame:
    """Rendered conversations in chunks: conv_id, chunk, formatted, spans [(begin, end)] of learned text in the chunk.

    `turns` has conv_id, turn, role, text; other columns are left out.  Turns are taken in the order of turn,
    role, text, nulls first, so repeated and tied rows have a place.  A null role or text is empty; a null
    conv_id is a conversation of its own.  A conversation is streamed through its task turn by turn, sorted
    by Spark, and only a chunk of it is ever held.
    """
    compiled(template)  # a wrong template fails here and not in a task
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        model, held, size = compiled(template), [[], [], [], []], 0
        for conv, rows in groupby(_rows(batches), lambda r: r[0]):
            for k, (part, spans) in enumerate(model.stream(({"role": role, "text": body} for _, role, body in rows), limit)):
                for c, v in zip(held, (conv, k, part, [{"begin": a, "end": b} for a, b in spans])):
                    c.append(v)
                size += len(part)
                if size >= limit:
                    yield text.batch_of(schema, *held)
                    held, size = [[], [], [], []], 0
            for _ in rows:  # what a template leaves unread
                pass
        yield text.batch_of(schema, *held)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return rows.mapInArrow(run, "conv_id long, chunk long, formatted string, spans array<struct<begin:long,end:long>>")


def turns_in(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a text rendered by `TURNS`."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(_END, line)
        if not formatted.startswith(_START, at):
            raise ValueError("a turn must begin here")
        yield show_line(formatted[at + len(_START) : line]), show(formatted[line + 1 : end])
        at = end + len(_END)


def read_back(chunks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the chunks as they follow each other."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        rows = []
        for conv, parts in groupby(_rows(batches), lambda r: r[0]):
            turns, loss, n, learned, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, formatted, spans in parts:
                size += len(formatted)
                for role, body in turns_in(formatted):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for s in spans:
                    body = show(formatted[s["begin"] : s["end"]])
                    loss.update(body.encode())
                    learned += len(body)
            rows.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), size))
            if len(rows) >= 4096:
                yield text.batch_of(schema, *zip(*rows))
                rows = []
        if rows:
            yield text.batch_of(schema, *zip(*rows))

    return chunks.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
