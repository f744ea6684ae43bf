"""URL filters by a bit-parallel wildcard automaton.

Glob rules over the canonical URL (lower-case host followed by path) are packed
side by side into 64-bit words. A Shift-And step moves every state of every
rule at once: ``D = ((D & M[c]) << 1) | (D & L[c])``, where bit s of ``M[c]``
says that symbol s of a rule accepts byte c and bit s of ``L[c]`` that state s
sits on a wildcard that swallows c. A rule matches when its last state is set
after the last byte. A batch of URLs runs as one matrix, a column of bytes at a
time, so the cost is bytes x words whatever the number of rules.

Globs: ``?`` one byte but ``/``; ``*`` any bytes but ``/``; ``**`` any bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

SLASH = ord("/")
# URLs simulated at once.
BATCH = 4096


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The base rules.
BASE_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
# What no base rule decides: these globs block, all else is allowed.
BLOCK_GLOBS = (
    "*spam**",
    "*pills**",
    "*casino**",
    "*.xxx/**",
    "**/wp-login.php",
    "**.exe",
    "**/cgi-bin/**",
)

# A symbol is a byte, ANY (one byte but a slash), STAR or DOUBLE.
ANY, STAR, DOUBLE = -1, -2, -3


def glob_symbols(glob: str) -> list[int]:
    out: list[int] = []
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        special = {"**": DOUBLE, "*": STAR, "?": ANY}.get(part)
        out += [special] if special is not None else list(part.encode("utf-8"))
    return out


def host_rule_symbols(rule: HostRule) -> list[list[int]]:
    """The rule's globs: the host itself and its subdomains. The wildcard never
    takes a slash, so it cannot reach into a path."""
    own = list((rule.host + rule.path).encode("utf-8")) + [DOUBLE]
    return [own, [STAR, ord("."), *own]]


class WildcardAutomaton:
    """All patterns in one multiword Shift-And machine."""

    def __init__(self, patterns: list[list[int]]):
        bits = sum(sum(s >= ANY for s in p) + 1 for p in patterns)
        self.words = max(1, -(-bits // 64))
        self.move = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        state = 0
        for pattern in patterns:
            self.start[state // 64] |= self._bit(state)
            for symbol in pattern:
                if symbol == STAR:
                    self._set(self.loop, state, [c for c in range(256) if c != SLASH])
                elif symbol == DOUBLE:
                    self._set(self.loop, state, range(256))
                else:
                    self._set(self.move, state, [c for c in range(256) if c != SLASH] if symbol == ANY else [symbol])
                    state += 1
            self.final.append((state // 64, self._bit(state)))
            state += 1

    @staticmethod
    def _bit(state: int) -> np.uint64:
        return np.uint64(1 << (state % 64))

    def _set(self, table: np.ndarray, state: int, accepted: Iterable[int]) -> None:
        table[list(accepted), state // 64] |= self._bit(state)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix (text, pattern); longest texts first inside, so that a
        step touches only the texts that still have a byte."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for at in range(lengths[0] if len(texts) else 0):
            n = int(np.searchsorted(-lengths, -at, side="left"))  # texts longer than at
            c = flat[begin[:n] + at]
            d = state[:n]
            moved = d & self.move[c]
            shifted = moved << one
            shifted[:, 1:] |= moved[:, :-1] >> top
            state[:n] = shifted | (d & self.loop[c])
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] & bit) != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where
    there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def judge_urls(pages: DataFrame, rules: tuple[HostRule, ...] = BASE_RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule (name of the longest
    rule that fits, null if none), verdict (that rule's; else block if a glob
    matches host and path, else allow).

    Null urls and urls without ``://`` have an empty host and path, which no
    rule fits. Of rules with equal names the first counts. Repeated rows stay
    repeated; an empty table gives an empty result; only the named columns are
    read."""
    kind = dict(pages.dtypes)[id_col]
    ranked = sorted(rules, key=lambda r: -len(r.name))  # stable: the first of equals wins
    patterns = [p for r in ranked for p in host_rule_symbols(r)] + [glob_symbols(g) for g in block_globs]
    names = [r.name for r in ranked] + [None]
    verdicts = [r.verdict for r in ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        machine = WildcardAutomaton(patterns)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
                hit = machine.match([(h + p).encode("utf-8") for h, p in zip(hosts, paths)])
                base = hit[:, :2 * len(ranked)].reshape(len(hosts), len(ranked), 2).any(axis=2)
                base = np.column_stack([base, np.ones(len(hosts), bool)])  # no rule
                first = base.argmax(axis=1)
                blocked = hit[:, 2 * len(ranked):].any(axis=1)
                verdict = [verdicts[f] if f < len(ranked) else "block" if x else "allow" for f, x in zip(first, blocked)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array([names[f] for f in first], pa.string()),
                     pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col(url_col))
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string")
