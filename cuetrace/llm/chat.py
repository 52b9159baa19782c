"""Formatting of conversations by a chat template, with the loss mask, and reading the result back.

A conversation's rows are ordered by turn, then role, then text; a null turn comes last, a null role or
text counts as empty. Rows with a null conv_id are one conversation. No rows give no conversations.
Repeated rows are turns of their own. Extra columns are ignored. A conversation is one row of the result,
so its texts lie in one task; a conversation is bounded by what a row can hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from cuetrace.llm.jobs import arrow_map
from cuetrace.llm.templates import compile_template, many_lines, unescape

TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | one_line | escape }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>{{ '\\n' }}{% endfor %}")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

FORMATTED = "conv_id long, formatted string, loss_spans array<struct<begin:int,stop:int>>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, the formatted text, and the spans of it under the loss mask, in code points."""
    turn = F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"),
                                                                           t["text"].alias("text"))).alias("turns"))

    def run(batches):
        render = compile_template(template)
        for batch in batches:
            pages = [render({"messages": turns.as_py()}) for turns in batch.column("turns")]
            yield {"conv_id": batch.column("conv_id"), "formatted": [text for text, _ in pages],
                   "loss_spans": [[{"begin": a, "stop": b} for a, b in spans] for _, spans in pages]}

    return arrow_map(turns, run, FORMATTED)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a conversation formatted by `TEMPLATE`."""
    for m in TURN.finditer(formatted):
        yield many_lines(unescape(m[1])), unescape(m[2])
