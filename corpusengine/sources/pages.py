"""Ordered text assembly over a page table.

A document split into pages (page number, text) becomes one text: pages
without text are dropped, the others are joined with a blank line, and the
result is stripped. Byte-level PDF decoding is out of scope; any page
extractor that lands (doc, page_no, text) rows can feed this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws


def assemble_pages(pages: DataFrame, key: str, order_col: str, text_col: str = "text",
                   out_col: str = "text") -> DataFrame:
    """One row per ``key``: non-empty page texts in ``order_col`` order,
    joined by a blank line, stripped."""
    page = F.when(F.col(text_col).isNotNull() & (F.col(text_col) != ""), F.struct(order_col, text_col))
    packed = pages.groupBy(key).agg(F.array_sort(F.collect_list(page)).alias("_p"))  # nulls are not collected
    return packed.select(key, strip_ws(F.array_join(F.transform("_p", lambda p: p[text_col]), "\n\n")).alias(out_col))
