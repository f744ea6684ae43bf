"""N-gram Jaccard join by a token-group matrix.

A document is its set of distinct word shingles (64-bit hashes, made a batch at
a time). Equal sets are one *class*, so exact copies cost one row from then on.
All tokens have one order: by hash, but the tokens that most documents share
come last. Of two sets with Jaccard similarity t or more, the first
n - ceil(t n) + l(n) tokens share at least min(l, l') tokens; l(n) grows with
the size, so one shared passage makes no candidate. Only these *prefix* tokens
that several classes hold are looked at further:

1. **Groups.** A class joins the group of the smallest class that shares most
   of its prefix tokens. A group with too many tokens is split by hash into
   parts, each of which also gets the group's leader as a member.
2. **Own group.** A class whose prefix overlap with the rest of its group
   reaches the bound is compared there, and the links make first components.
3. **Matrix.** For every token and group the sizes and components of the
   holders. Two groups whose shared tokens reach the bound, whose sizes fit and
   which are not one component already are a candidate: the work is per group
   and token, not per member.
4. **Open.** The classes of one group query the other: its token union bounds
   the whole overlap of each query, only qualifying queries meet the members,
   and every link is checked on the whole sets.

A comparison emits only the links that join components not yet joined there,
so a family of m near copies gives at most m links a group. Whole sets travel
only for the classes that have a candidate; nothing is emitted per pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .simhash import connected_components

# Texts cut together: about so many bytes of them.
SLICE_BYTES = 4_000_000
# Tokens held by more rows than this may go to the end of the order; at most so
# many of them (8 bytes each) are sent to the tasks. The order decides only what
# is compared, never what links.
HOT_ROWS, MAX_HOT = 16, 1_000_000
# Tokens of a group part (each member counts for MEMBER_TOKENS more).
PART_TOKENS, MEMBER_TOKENS = 65_536, 256
# Class numbers broadcast at most (16 bytes each); more are a shuffle join.
MAX_BROADCAST = 500_000
# Odd multipliers of the words of a shingle and of the final mixing.
MIX = (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(33))


def _segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place in the owner's run) of the items of runs end to end."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts end to end, and how many
    each text has. A text of fewer words has its whole sequence as the one."""
    cut = [t.lower().split() for t in texts.fill_null("").cast(pa.binary()).to_pylist()]
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    word = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(cut)), np.uint64, int(n.sum()))
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    first, stop = np.cumsum(n) - n, np.cumsum(count)
    # The word at each place and those behind it, by place in the shingle.
    sums = word * np.uint64(MIX[0])
    for k in range(1, words):
        sums[:len(word) - k] += word[k:] * np.uint64(pow(MIX[0], k + 1, 1 << 64))
    for i in np.flatnonzero((n > 0) & (n < words)).tolist():
        own = word[first[i]:first[i] + n[i]].tolist()
        sums[first[i]] = sum(w * pow(MIX[0], k + 1, 1 << 64) for k, w in enumerate([*own, len(own)])) % (1 << 64)
    owner, at = _segments(count)
    token = _mixed(sums[first[owner] + at])
    for i, j in zip((stop - count).tolist(), stop.tolist()):
        token[i:j].sort()
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return token[new], np.bincount(owner[new], minlength=len(n))


def least_overlap(n, percent: int):
    """Tokens that a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def shares(n):
    """l(n): prefix tokens that two linked sets share at least (the lesser of the two)."""
    return 1 + n // 32


def prefix_length(n, percent: int):
    return np.minimum(n, n - least_overlap(n, percent) + shares(n))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices whose last column, a string, has a bounded size but for single texts."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.binary_length(b.column(b.num_columns - 1)).fill_null(0).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def _class_keys(tokens: np.ndarray, n: np.ndarray) -> pa.Array:
    """One 64-bit number per set; null for the empty set."""
    ends = np.cumsum(n) * 8
    raw = memoryview(tokens.tobytes())
    keys = [xxhash.xxh3_64_intdigest(raw[e - 8 * k:e]) - (1 << 63) if k else None for e, k in zip(ends.tolist(), n.tolist())]
    return pa.array(keys, pa.int64())


def class_rows(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, k) of every row of ``docs(doc_id, text)``: set size and class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in _sliced(batches):
            tokens, n = shingle_sets(b.column(1), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), _class_keys(tokens, n)],
                                             names=["doc_id", "n", "k"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n bigint, k bigint")


def prefix_rows(docs: DataFrame, words: int, percent: int, hot=None, wider: float = 1.0) -> DataFrame:
    """(token, k, n) for the prefix tokens of every row; ``hot`` is a broadcast
    sorted array of the tokens that come last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        last = hot.value if hot is not None else np.zeros(0, np.uint64)
        for b in _sliced(batches):
            tokens, n = shingle_sets(b.column(0), words)
            keys = _class_keys(tokens, n)
            owner, at = _segments(n)
            if len(last) and len(tokens):
                found = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
                order = np.lexsort((tokens, last[found] == tokens, owner))
                tokens = tokens[order]  # owners stay in place
            most = np.minimum(n, np.ceil(prefix_length(n, percent) * wider).astype(np.int64))
            keep = at < most[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[keep].view(np.int64)), keys.take(pa.array(owner[keep])), pa.array(n[owner[keep]], pa.int64())],
                names=["token", "k", "n"])

    return docs.select("text").mapInArrow(run, "token bigint, k bigint, n bigint")


def set_rows(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(k, tokens) of the classes in ``wanted(k)``, once each; tokens as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in _sliced(batches):
            tokens, n = shingle_sets(b.column(0), words)
            ends = np.cumsum(n) * 8
            raw = tokens.tobytes()
            own = [raw[e - 8 * k:e] for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([_class_keys(tokens, n), pa.array(own, pa.binary())], names=["k", "tokens"])

    every = docs.select("text").mapInArrow(run, "k bigint, tokens binary")
    small = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    held = every.join(F.broadcast(wanted) if small else wanted, "k")
    return held.groupBy("k").agg(F.first("tokens").alias("tokens"))


class Union:
    """Components of the numbers 0 to n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def open_group(queries: list[np.ndarray], members: list[np.ndarray], parts: list[int], percent: int,
               same: bool = False) -> list[tuple[int, int]]:
    """Links (query, member) that join components. ``parts`` numbers the
    component of each query and then of each member; with ``same`` the queries
    are the members, and each pair is looked at once."""
    size = np.array([len(m) for m in members])
    held = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), size)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    union, first, times = np.unique(held, return_index=True, return_counts=True)
    joined = Union(len(parts))
    for i, p in enumerate(parts):
        joined.up[i] = p
    links = []
    for q, tokens in enumerate(queries):
        at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        at = at[union[at] == tokens]
        if same:
            at = at[times[at] > 1]
        # The union bounds the overlap with every member at once.
        if len(at) < least_overlap(len(tokens), percent):
            continue
        rows, place = _segments(times[at])
        overlap = np.bincount(owner[first[at][rows] + place], minlength=len(members))
        for m in np.flatnonzero(100 * overlap >= percent * (len(tokens) + size - overlap)).tolist():
            a, b = joined.find(q), joined.find(m if same else len(queries) + m)
            if a != b:
                joined.up[max(a, b)] = min(a, b)
                links.append((q, m))
    return links


def _unpacked(column: pa.Array, i: int) -> tuple[list[int], list[np.ndarray], list[int]]:
    rows = column[i].as_py()
    return ([r["k"] for r in rows], [np.frombuffer(r["tokens"], np.uint64) for r in rows], [r["c"] for r in rows])


def _numbered(values: list[int]) -> list[int]:
    """For each place the first place with the same value."""
    first: dict[int, int] = {}
    return [first.setdefault(v, i) for i, v in enumerate(values)]


def group_links(groups: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) in every row of ``groups(members)`` or ``groups(queries, members)``."""
    same = "queries" not in groups.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k, sets, comps = _unpacked(b.column(b.num_columns - 1), i)
                qk, queries, qc = (k, sets, []) if same else _unpacked(b.column(0), i)
                links = open_group(queries, sets, _numbered(qc + comps), percent, same)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([qk[q] for q, _ in links], pa.int64()),
                                                      pa.array([k[m] for _, m in links], pa.int64())], names=["u", "v"])

    columns = ["members"] if same else ["queries", "members"]
    return groups.select(*columns).mapInArrow(run, "u bigint, v bigint")


def _parts(weight) -> F.Column:
    return F.ceil(F.sum(weight) / F.lit(PART_TOKENS)).cast("long")


def _listed() -> F.Column:
    return F.collect_list(F.struct("k", "c", "tokens"))


def hot_tokens(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    """At most ``MAX_HOT`` tokens, the commonest of those that more than
    ``HOT_ROWS`` rows and two classes or more hold in a wider prefix."""
    counts = (prefix_rows(docs, words, percent, wider=1.25).groupBy("token")
              .agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("a"), F.max("k").alias("b"))
              .filter((F.col("n") > HOT_ROWS) & (F.col("a") != F.col("b"))))
    top = counts.orderBy(F.desc("n"), "token").limit(MAX_HOT).select("token").toArrow().column(0)
    return np.sort(top.to_numpy().view(np.uint64))


def class_links(docs: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """Links (u, v) between classes that connect exactly those which links of the
    given similarity connect."""
    spark: SparkSession = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_tokens(docs, words, percent))
    prefix = scratch.write(prefix_rows(docs, words, percent, hot), "prefix")
    several = (prefix.groupBy("token").agg(F.min("k").alias("lead"), F.max("k").alias("b"))
               .filter("lead <> b").select("token", "lead"))
    held = scratch.write(prefix.join(several, "token").distinct(), "prefix-tokens")  # token, k, n, lead
    scratch.drop(prefix)

    # Groups, and their parts.
    votes = held.groupBy("k", "n", "lead").agg(F.count(F.lit(1)).alias("votes"))
    chosen = votes.groupBy("k", "n").agg(F.max_by("lead", F.struct("votes", -F.col("lead").cast("decimal(20,0)"))).alias("g"))
    weight = F.col("n") + MEMBER_TOKENS
    split = chosen.groupBy("g").agg(_parts(weight).alias("parts"))
    groups = scratch.write(chosen.join(split, "g").withColumn("p", F.pmod(F.xxhash64("k"), F.col("parts"))), "groups")
    cells = scratch.write(held.drop("lead").join(groups.select("k", "g", "p"), "k"), "cells")

    def least(n) -> F.Column:
        return F.ceil(n * F.lit(percent) / F.lit(100.0))

    def needed(a, b) -> F.Column:
        """Prefix tokens that linked sets of at least a and of at least b share."""
        return F.lit(1) + F.floor(F.least(F.greatest(a, least(b)), F.greatest(b, least(a))) / 32)

    # Own group: tokens that another member holds as well.
    matrix = cells.groupBy("token", "g", "p").agg(F.count(F.lit(1)).alias("holders"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    own = (cells.join(matrix.filter("holders > 1"), ["token", "g", "p"]).groupBy("k", "n", "g", "p")
           .agg(F.count(F.lit(1)).alias("shared"), F.min("lo").alias("lo"))
           .filter(F.col("shared") >= needed(F.col("n"), F.col("lo"))).select("k", "g", "p"))
    leaders = groups.filter("parts > 1").select(F.col("g").alias("k"), "g", "p").distinct()
    inside = scratch.write(own.union(leaders).distinct(), "inside")
    sets = set_rows(docs, words, inside.select("k").distinct())
    packed = inside.withColumn("c", F.col("k")).join(sets, "k").groupBy("g", "p").agg(_listed().alias("members"))
    first = scratch.write(group_links(packed.filter(F.size("members") > 1), percent), "links-inside")
    comps = connected_components(first, scratch).select(F.col("node").alias("k"), "root")

    # The matrix of what is not yet joined.
    told = scratch.write(cells.join(comps, "k", "left").withColumn("c", F.coalesce("root", "k")).drop("root"), "told")
    apart = told.groupBy("token").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("token")
    left = told.join(apart, "token")
    matrix = left.groupBy("token", "g", "p").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("c").alias("c_lo"), F.max("c").alias("c_hi"))
    query = matrix.withColumnsRenamed({c: f"q_{c}" for c in matrix.columns if c != "token"})
    later = (F.col("q_g") < F.col("g")) | ((F.col("q_g") == F.col("g")) & (F.col("q_p") < F.col("p")))
    joined = (F.col("q_c_lo") == F.col("q_c_hi")) & (F.col("q_c_lo") == F.col("c_lo")) & (F.col("c_lo") == F.col("c_hi"))
    fits = (F.col("hi") * 100 >= F.col("q_lo") * percent) & (F.col("lo") * percent <= F.col("q_hi") * 100)
    cand = (query.join(matrix, "token").filter(later & fits & ~joined).groupBy("q_g", "q_p", "g", "p")
            .agg(F.count(F.lit(1)).alias("shared"), F.min("q_lo").alias("q_lo"), F.min("lo").alias("lo"))
            .filter(F.col("shared") >= needed(F.col("q_lo"), F.col("lo"))).select("q_g", "q_p", "g", "p"))
    cand = scratch.write(cand, "candidates")

    # Open the candidate groups.
    opened = cand.select("g", "p").union(cand.select(F.col("q_g").alias("g"), F.col("q_p").alias("p"))).distinct()
    members = scratch.write(told.select("k", "c", "g", "p").distinct().join(opened, ["g", "p"]), "members")
    sets = set_rows(docs, words, members.select("k"))
    packed = scratch.write(members.join(sets, "k").groupBy("g", "p").agg(_listed().alias("members")), "opened")
    asked = packed.withColumnsRenamed({"g": "q_g", "p": "q_p", "members": "queries"})
    pairs = cand.join(packed, ["g", "p"]).join(asked, ["q_g", "q_p"])
    second = scratch.write(group_links(pairs, percent), "links-across")
    return first.union(second)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                       percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles (set size), component_id.

    Sets link when 100 x intersection >= ``percent`` x union. Sets are compared
    as sets of 64-bit hashes of the shingles, and equal sets by a 64-bit hash.
    Null, empty and wordless texts have no shingle, link with nothing and are
    their own component. Repeated rows stay repeated; rows without an id take
    the smallest id of their component, null if it has none. Very long texts are
    compared whole. An empty table gives an empty result. Other columns are not
    read, whatever their names. ``docs`` is read several times: write it first
    if it is dear to compute."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    scratch = Scratch(docs.sparkSession, "jaccard")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.write(class_rows(narrow, words), "classes")
    links = class_links(narrow, scratch, words, percent)
    roots = connected_components(links, scratch).select(F.col("node").alias("k"), "root")
    classes = rows.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("first"))
    rooted = scratch.write(classes.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(ids, "root").select("k", "component_id")
    out = rows.filter("n > 0").join(named, "k").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
