"""Chat formatting: conversations (a row for each turn) to training texts, with the ranges a model is trained on.

The rows of a conversation are brought together and sorted by Spark; a task walks its sorted rows and holds one
conversation at a time, so memory follows the longest conversation, which is one text by definition.

Defined cases: null roles and texts count as empty; turns of equal number go by role, then text, repeated rows all
count; a null turn comes first; rows with a null conv_id are one conversation; an empty table gives no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from roadweave.llm.chat_template import Template, unescape

TURNS = """{% for message in messages -%}
### {{ message.role | escape_line }}
{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else %}{{ message.text | escape }}{% endif %}</turn>
{% endfor %}"""
"""Turns between `### role` and `</turn>`; neither can appear inside a text."""

_TURN = re.compile(r"### ((?:[^\\\n]|\\.)*)\n(.*?)</turn>\n", re.S)
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


def format_conversations(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """(conv_id, n_turns, text, spans) for each conversation of `turns` (conv_id, turn, role, text)."""
    turns = turns.select("conv_id", "turn", "role", "text")
    schema = StructType([turns.schema["conv_id"], StructField("n_turns", IntegerType()), StructField("text", StringType()),
                         StructField("spans", ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        kinds = None

        def record(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

        def text_of(conv_id, messages: list) -> tuple:
            text, spans = compiled.render(messages=messages)
            return conv_id, len(messages), text, [{"start": a, "end": b} for a, b in spans]

        current, messages, done, size = None, [], [], 0
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.int32(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3)]
            for conv_id, role, text in zip(*columns):
                if messages and conv_id != current:
                    done.append(text_of(current, messages))
                    size += len(done[-1][2])
                    messages = []
                    if size > 4_000_000:
                        yield record(done)
                        done, size = [], 0
                current = conv_id
                messages.append({"role": role or "", "text": text or ""})
        if messages:
            done.append(text_of(current, messages))
        if done:
            yield record(done)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text formatted with TURNS."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def trained_text(text: str, spans: list) -> str:
    """What lies in the spans, unescaped, joined."""
    return "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
