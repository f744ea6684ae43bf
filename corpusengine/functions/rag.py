"""Column functions for context assembly, prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ANSWER_MARKER, PROMPT_TEMPLATE
from .text import strip_ws


def is_blank(c: Column) -> Column:
    """Null, empty or whitespace only (Python's str.strip())."""
    return c.isNull() | (strip_ws(c) == "")


def label_item(content: Column, label: Column, chars: int | None = 500,
               fmt_prefix: str = "[", fmt_suffix: str = "]\n") -> Column:
    """'[label]\\n' + first ``chars`` characters of content."""
    body = content if chars is None else F.substring(content, 1, chars)
    return F.concat(F.lit(fmt_prefix), label, F.lit(fmt_suffix), body)


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a format template into ('lit', text) and ('field', name) parts."""
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(context|question)\}", template):
        parts.append(("lit", template[pos:m.start()]))
        parts.append(("field", m.group(1)))
        pos = m.end()
    parts.append(("lit", template[pos:]))
    return [p for p in parts if p != ("lit", "")]


def render_prompt(context: Column, question: Column, template: str = PROMPT_TEMPLATE) -> Column:
    """Fill {context} and {question} in one pass, like str.format: values are
    inserted as they are and never scanned for placeholders themselves."""
    cols = {"context": context, "question": question}
    return F.concat(*[F.lit(v) if k == "lit" else cols[v] for k, v in template_parts(template)])


def clean_answer(answer: Column, marker: str = ANSWER_MARKER) -> Column:
    """Text after the last marker (whole text when absent), stripped."""
    return strip_ws(F.substring_index(answer, marker, -1))
