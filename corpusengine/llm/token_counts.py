"""Token counts per field and section by offset-mapped attribution.

A document is rendered once (its fields, each followed by a line feed but the
last) and encoded once, as a whole. Byte-level tokens partition the rendered
bytes, so their lengths give every token's span; an interval join of the sorted
spans with the sorted section ends (binary search) finds the section of each
token. Tokens may cross a boundary (a space or line feed joins what follows);
``rule`` says who gets them:

* ``start``: the section that holds the token's first character;
* ``end``: the section that holds its last character;
* ``share``: every section by its share of the token's bytes.

Every rule hands out each token exactly once, so a document's counts sum to the
tokens of the whole encoding. The work is map-only: nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "share")
# A longer run of white space is cut there: the pattern's look-ahead tracks back
# over the whole run, and gives up on a million characters.
LONGEST_RUN = 500_000
LINE_FEED = 10


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SpanEncoder:
    """Encodes a text and gives the byte length of every token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = load_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """End byte of every token, ascending."""
        return np.cumsum(np.concatenate([self.lengths[self.encoding.encode_to_numpy(t)] for t in _cut(text)]))


def _cut(text: str) -> list[str]:
    """The text, cut within runs of white space longer than ``LONGEST_RUN``."""
    if len(text) <= LONGEST_RUN:
        return [text]
    ends = [m.end() for m in re.finditer(rf"\s{{{LONGEST_RUN}}}", text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]


def sections(fields: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rendered text; per section its field number, end byte, start and end
    character. A section is a line of a field, with its line feed; an empty
    field has one (empty but for the line feed that ends the field)."""
    text = "\n".join(fields)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    ends = np.flatnonzero(raw == LINE_FEED) + 1
    ends = np.append(ends, len(raw))
    lines = np.array([f.count("\n") + 1 for f in fields])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    stop = chars[ends]
    return text, np.repeat(np.arange(len(fields)), lines), ends, np.concatenate([[0], stop[:-1]]), stop


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of every section; crossing: tokens that begin
    in the section and end beyond it."""
    n = len(section_ends)
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crossing = np.bincount(first[first != last], minlength=n)[:n]
    if rule == "start":
        return np.bincount(first, minlength=n)[:n].astype(float), crossing
    if rule == "end":
        return np.bincount(last, minlength=n)[:n].astype(float), crossing
    # Share: cut the tokens at the section ends and weigh the parts.
    cuts = np.union1d(token_ends, section_ends[section_ends > 0])
    if not len(token_ends):
        return np.zeros(n), crossing
    begin = np.concatenate([[0], cuts[:-1]])
    token = np.searchsorted(token_ends, begin, side="right")
    weight = (cuts - begin) / (token_ends - starts)[token]
    return np.bincount(np.searchsorted(section_ends, begin, side="right"), weight, minlength=n)[:n], crossing


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, fields: tuple[str, ...] = ("source", "lang", "text"),
                 rule: str = "start", id_col: str = "doc_id") -> DataFrame:
    """One row per document and section: doc_id, field, section (from 0 through
    the document), start_char, end_char (in the rendered document), n_tokens
    (double; whole numbers but for ``share``), n_crossing.

    Null fields are empty. Every document has at least one section per field,
    so empty texts are listed with what their line feeds cost. Very long texts
    are encoded whole, but no token crosses every 500,000th character of a run of
    white space. Repeated rows
    stay repeated; an empty table gives an empty result. Only the named columns
    are read."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = dict(docs.dtypes)[id_col]
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encoder = SpanEncoder(ranks_path, pattern)
        labels = pa.array(names)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                columns = [c.to_pylist() for c in part.columns[1:]]
                rows, parts = [], []
                for i, values in enumerate(zip(*columns)):
                    text, field, ends, begin, stop = sections([v or "" for v in values])
                    tokens, crossing = attribute(encoder.ends(text), ends, rule)
                    rows.append(np.full(len(ends), i))
                    parts.append((field, np.arange(len(ends)), begin, stop, tokens, crossing))
                field, number, begin, stop, tokens, crossing = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.concatenate(rows))), labels.take(pa.array(field)),
                     pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(stop, pa.int64()),
                     pa.array(tokens, pa.float64()), pa.array(crossing, pa.int64())],
                    names=["doc_id", "field", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    schema = (f"doc_id {kind}, field string, section int, start_char bigint, end_char bigint, "
              "n_tokens double, n_crossing bigint")
    return docs.select(F.col(id_col).alias("_id"), *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(names)]
                       ).mapInArrow(run, schema)
