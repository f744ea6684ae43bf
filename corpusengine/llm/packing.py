"""Best-fit packing with dominance reduction.

Documents are tokenised in Arrow batches (each distinct white-space-free chunk
once while it stays in a bounded memo) and cut into pieces of at most
``capacity`` tokens. How to pack depends on the piece lengths alone, so the
instance the solver sees is a histogram of at most ``capacity`` counts,
whatever the corpus size. It returns patterns (lengths of one sequence) with
multiplicities:

* Dominance (Martello and Toth): a set of pieces that provably can be part of
  an optimal packing is fixed for good. A length whose complement exists is
  paired with it; a piece nothing fits beside stays alone; where no two others
  fit beside it, it takes the largest that does; where at most two do, it takes
  a single one as large as the best pair.
* The remainder goes best-fit decreasing, whole runs of equal lengths at a time.

The pieces then find their places as a join: pieces of a length are numbered
(hash buckets, so a length that a third of all pieces share is spread out) and
the n-th piece takes the n-th slot of that length. Full pieces are sequences by
themselves and need no number.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# Strings a Python worker remembers, in each of two generations, and the longest.
MEMO_STRINGS = 60_000
MEMO_LENGTH = 64
# ASCII punctuation but the apostrophe, which may join what follows it.
TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
# Plain words: letters below U+0180 that are already normalised and keep their
# number in lower case (all but the dotted capital I).
PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ſ]+$"
LETTERS = "".join(c for c in map(chr, range(0x180)) if re.match(PLAIN, c))
END_ID = 0
# Texts encoded together, and about how many characters of them.
GROUP = 2_000
GROUP_CHARS = 2_000_000
# Buckets that number the pieces of one length side by side.
RANK_BUCKETS = 256


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {c: chr(c) for c in own}
    return out | {c: chr(256 + n) for n, c in enumerate(c for c in range(256) if c not in out)}


BYTE_LETTERS = _byte_letters()


class Memo:
    """Ids of the strings seen last, in two generations of bounded size."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        out = list(map(self.new.get, keys))
        for i, ids in enumerate(out):
            if ids is None and (ids := self.old.get(keys[i])) is not None:
                out[i] = self.new[keys[i]] = ids
        return out

    def put(self, key: str, ids: bytes) -> None:
        if len(key) <= MEMO_LENGTH:
            self.new[key] = ids


class ChunkEncoder:
    """Token ids of whole texts.

    Valid for byte-level tokenizers that cut a text into runs of letters, digits
    and other characters, never across white space, drop the white space, ignore
    case and mark the last token of a run. Then the chunks between ASCII white
    space are encoded independently of each other, and so is ASCII punctuation
    behind a letter. A group of texts is cut and its distinct chunks found by
    Arrow; plain words (Latin letters, see PLAIN) are one run each, and new ones
    go through the merges in one call, without the steps that normalise and cut."""

    def __init__(self, path: str, memo_strings: int = MEMO_STRINGS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings that look like special tokens are ordinary text.
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        split = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": split, "added_tokens": []}))
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self.words, self.others = Memo(memo_strings), Memo(memo_strings)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text ends."""
        cut = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = cut.flatten().dictionary_encode()
        units, first, second = self._units(coded.dictionary)
        length = np.fromiter(map(len, units), np.int64, len(units)) // 4
        pool = np.frombuffer(b"".join(units), "<u4")
        start = np.cumsum(length) - length
        # Every chunk is two units, the second often empty.
        chunk = coded.indices.to_numpy(zero_copy_only=False)
        unit = np.stack([first[chunk], second[chunk]], axis=1).ravel()
        size = length[unit]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = pool[np.repeat(start[unit] - (stop - size), size) + np.arange(total)]
        ends = np.concatenate([[0], stop[1::2]])[cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()]
        return ids, ends

    def _units(self, chunks: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of the parts of the chunks, and each chunk's two parts by number:
        a plain word and the punctuation behind it, or the chunk and nothing."""
        stems = pc.ascii_rtrim(chunks, characters=TAIL)
        plain = pc.match_substring_regex(stems, PLAIN)
        words = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        tails = pc.utf8_ltrim(chunks.filter(plain), characters=LETTERS).dictionary_encode()
        others = chunks.filter(pc.invert(plain))
        units = [*self._word_ids(words.dictionary.to_pylist()), *self._other_ids(tails.dictionary.to_pylist()),
                 *self._other_ids(others.to_pylist()), b""]
        at = plain.to_numpy(zero_copy_only=False)
        first, second = np.empty(len(chunks), np.int64), np.full(len(chunks), len(units) - 1)
        n = len(words.dictionary)
        first[at] = words.indices.to_numpy(zero_copy_only=False)
        second[at] = n + tails.indices.to_numpy(zero_copy_only=False)
        first[~at] = n + len(tails.dictionary) + np.arange(len(others))
        return units, first, second

    def _word_ids(self, words: list[str]) -> list[bytes]:
        out = self.words.find(words)
        new = [i for i, ids in enumerate(out) if ids is None]
        if new:
            asked = [words[i] if words[i].isascii() else words[i].encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
                     for i in new]
            ids = np.array(self.merges.encode_batch_fast([" ".join(asked)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) != len(new):
                raise ValueError("this tokenizer does not mark the last token of every word")
            raw, begin = ids.tobytes(), 0
            for i, stop in zip(new, (stops * 4).tolist()):
                out[i] = raw[begin:stop]
                self.words.put(words[i], out[i])
                begin = stop
        return out

    def _other_ids(self, chunks: list[str]) -> list[bytes]:
        out = self.others.find(chunks)
        new = {chunks[i]: None for i, ids in enumerate(out) if ids is None}
        if new:
            for c, e in zip(new, self.tokenizer.encode_batch_fast(list(new), add_special_tokens=False)):
                new[c] = struct.pack(f"<{len(e.ids)}I", *e.ids)
                self.others.put(c, new[c])
            out = [new[c] if ids is None else ids for c, ids in zip(chunks, out)]
        return out


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker."""
    return ChunkEncoder(path)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, bounded in rows and (but for single texts) characters
    of their second column."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy().astype(np.int64)) if b.num_rows else np.zeros(0)
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            stop = min(at + GROUP, max(at + 1, int(np.searchsorted(size, before + GROUP_CHARS, side="right"))))
            yield b.slice(at, stop - at)
            at = stop


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id",
               text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        for b in groups(batches):
            ids, ends = encoder.encode(b.column(1))
            at, out, begin = [], [], 0
            for row, stop in enumerate(ends.tolist()):
                raw = ids[begin:stop].tobytes() + end
                begin = stop
                for piece, start in enumerate(range(0, len(raw) // 4, capacity)):
                    own = raw[4 * start:4 * (start + capacity)]
                    at.append(row)
                    out.append((piece, start, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
            columns = [list(c) for c in zip(*out)]
            if not columns:
                continue
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns) + 1])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _fixed_by_dominance(count: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes dominating sets out of ``count`` (pieces by length), in place."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            count[x] -= times
        fixed.append((lengths, times))

    # Perfect fits: what else a set with a holds fits where its complement was.
    for a in range(capacity, 0, -1):
        b = capacity - a
        if b == 0 and count[a]:
            fix((a,), count[a])
        elif a > b and b and min(count[a], count[b]):
            fix((a, b), min(count[a], count[b]))
        elif a == b and count[a] >= 2:
            fix((a, a), count[a] // 2)

    changed = True
    while changed:
        changed = False
        for a in range(capacity - 1, 0, -1):
            while count[a]:
                room = capacity - a
                count[a] -= 1  # one copy of a is placed; the others are candidates
                beside = next((b for b in range(min(room, capacity - 1), 0, -1) if count[b]), 0)
                small = []
                for s in range(1, room + 1):
                    small += [s] * min(count[s], 3 - len(small))
                    if len(small) == 3:
                        break
                count[a] += 1
                pair = sum(small[:2]) if len(small) >= 2 else capacity + 1
                triple = sum(small) if len(small) == 3 else capacity + 1
                if not beside:
                    fix((a,), count[a] if a > room else 1)
                elif pair > room or (triple > room and beside >= _best_pair(count, a, room)):
                    # Equal pieces pair up among themselves: the condition only gets
                    # easier as pairs of them go.
                    fix((a, beside), count[a] // 2 if a == beside else min(count[a], count[beside]))
                else:
                    break
                changed = True
    return fixed


def _best_pair(count: list[int], a: int, room: int) -> int:
    """Largest sum of two pieces that fit beside one piece of length a."""
    best = 0
    have = [s for s in range(1, room) if count[s] - (s == a) > 0]
    low, high = 0, len(have) - 1
    while low <= high:
        total = have[low] + have[high]
        if low == high and count[have[low]] - (have[low] == a) < 2:
            break
        if total <= room:
            best, low = max(best, total), low + 1
        else:
            high -= 1
    return best


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how many sequences have each."""
    count = [0] * (capacity + 1)
    for length, n in counts.items():
        count[length] = n
    patterns = _fixed_by_dominance(count, capacity)
    # Best fit, longest first; open[r]: [pattern, sequences] with r tokens left.
    open_: list[list[list]] = [[] for _ in range(capacity + 1)]
    for s in range(capacity, 0, -1):
        n, room = count[s], s
        while n and room <= capacity:
            if not open_[room]:
                room += 1
                continue
            pattern, times = open_[room].pop()
            # A sequence takes equal pieces until none fits (it stays the best fit).
            each = room // s
            full = min(times, n // each)
            if full:
                open_[room - each * s].append([pattern + (s,) * each, full])
            n -= full * each
            times -= full
            if times and n:
                open_[room - n * s].append([pattern + (s,) * n, 1])
                n, times = 0, times - 1
            if times:
                open_[room].append([pattern, times])
        if n:
            each = capacity // s
            if n // each:
                open_[capacity - each * s].append([(s,) * each, n // each])
            if n % each:
                open_[capacity - n % each * s].append([(s,) * (n % each), 1])
    merged: dict[tuple[int, ...], int] = {}
    for pattern, times in patterns + [(p, t) for group in open_ for p, t in group]:
        merged[pattern] = merged.get(pattern, 0) + times
    return list(merged.items())


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, offset, each): the pieces numbered lo to
    hi-1 of that length go ``each`` to a sequence, from that offset on."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            each = pattern.count(length)
            lo = taken.get(length, 0)
            taken[length] = lo + each * times
            out.append((length, lo, taken[length], sequence, offset, each))
            offset += length * each
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ids, as little-endian bytes, with ``with_ids``).

    Null and empty texts are the end id alone. Repeated rows are packed as
    often as they come; an empty table gives an empty result. Only the named
    columns are read. Sequence ids are arbitrary: negative for pieces that fill
    a sequence by themselves."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(cut_pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids)
                           .withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    short = pieces.filter(F.col("length") < capacity)
    # At most capacity - 1 rows, whatever the corpus.
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(slots(pack_lengths(counts, capacity)),
                                  "length bigint, lo bigint, hi bigint, seq bigint, offset bigint, each bigint")

    bucket = F.pmod(F.xxhash64("_uid"), F.lit(RANK_BUCKETS)).alias("_bucket")
    short = short.withColumn("_bucket", bucket)
    sizes = short.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "_bucket").orderBy("_uid")
    ranked = (short.withColumn("_rank", F.row_number().over(inside) - 1).join(first, ["length", "_bucket"])
              .withColumn("_rank", F.col("_rank") + F.col("first")).drop("first"))
    # Slot rows are bounded by the distinct patterns, which depend on the
    # lengths that occur and not on how often they do.
    placed = ranked.join(F.broadcast(table.withColumnsRenamed({"length": "_len"})),
                         (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    nth = F.col("_rank") - F.col("lo")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    last = ["ids"] if with_ids else []
    full = pieces.filter(F.col("length") == capacity).select(
        *columns, (-1 - F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *last)
    return placed.select(
        *columns, (F.col("seq") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset") + F.col("length") * F.pmod(nth, F.col("each"))).alias("offset"), *last).unionByName(full)
