"""Language-model scoring with a hidden Markov model.

Tokens are emitted in two steps: the latent state draws a word class (a fixed
hash of the spelling, ``CLASSES`` of them), the class draws the word. So the
latent part of the model is bounded (states x classes) while the word part
follows the corpus: it needs the training count of every word.

1. *Encode.* Documents become blocks of bounded size, dictionary-encoded (local
   word numbers and the block's vocabulary), and are written once.
2. *Baum-Welch.* Expected transition and emission counts are gathered per task
   over all training tokens, in segments of ``SEGMENT`` tokens, and summed over
   the tasks as one vector per state. The states start as noise around the class
   counts of the whole training text, and every pass covers all of it.
3. *Counts.* The training count of a word is a sum, combined in the tasks before
   the shuffle. Every block then asks for the counts of its vocabulary: words that
   hold a ``HOT`` th of all vocabulary rows or more (so there are at most ``HOT``)
   answer from a broadcast, all others by a join. Nothing moves per token, and no
   frequent word becomes one group.
4. *Scores.* Each block meets its counts and the scaled forward recursion gives
   the exact likelihood of every whole document.

Within a class, counts are discounted absolutely; what is taken off goes to
words never seen in training.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CLASSES = 16_384
SHORT = 4_096  # classes of words of up to three bytes; longer ones share the rest
SEGMENT = 64
# Bounds of a block: words of its documents, and documents.
BLOCK_WORDS = 800_000
BLOCK_DOCS = 4_000
# The end token: no word holds a space.
END = b" "
DISCOUNT = 0.75
# Bounds of the broadcast counts: words, and bytes of a word.
HOT = 10_000
HOT_BYTES = 64


def word_class(word: bytes) -> int:
    """Class 0 is the end token; short words are told apart by spelling, longer
    ones by their first two and last three bytes."""
    if word == END:
        return 0
    if len(word) <= 3:
        return 1 + zlib.crc32(word) % (SHORT - 1)
    return SHORT + zlib.crc32(word[:2] + word[-3:]) % (CLASSES - SHORT)


def class_column(word: Column) -> Column:
    """``word_class`` of a binary column."""
    ends = F.concat(F.substring(word, 1, 2), F.substring(word, -3, 3))
    return (F.when(word == F.lit(END), F.lit(0).cast("long"))
            .when(F.octet_length(word) <= 3, 1 + F.crc32(word) % (SHORT - 1))
            .otherwise(SHORT + F.crc32(ends) % (CLASSES - SHORT)))


def _packed(tokens: np.ndarray) -> bytes:
    """Word numbers (frequent words have small ones) as four byte planes."""
    planes = np.stack([(tokens >> shift).astype(np.uint8) for shift in (0, 8, 16, 24)])
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return sum(planes[k].astype(np.int64) << 8 * k for k in range(4))


def _block(number: int, texts: list[list[bytes]], train: np.ndarray) -> dict:
    lengths = np.array([len(t) for t in texts], np.int32)
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    tokens = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-np.bincount(tokens, minlength=len(flat.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    tokens = rank[tokens]
    words = flat.dictionary.take(pa.array(order)).to_pylist()
    counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(words))
    return {"block": number, "lengths": lengths.tobytes(), "train": train.astype(np.uint8).tobytes(),
            "tokens": _packed(tokens), "words": words,
            "classes": np.array([word_class(w) for w in words], np.uint16).tobytes(), "counts": counts.astype(np.int64)}


def encode_blocks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, train, text)`` as one row per block; map-only."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"block bigint, ids array<{kind}>, lengths binary, train binary, tokens binary, "
              "words array<binary>, classes binary, counts array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def row(ids: list, texts: list, train: list) -> pa.RecordBatch:
            made = _block(number, texts, np.array(train, bool))
            return pa.RecordBatch.from_arrays(
                [pa.array([made["block"]]), pa.array([ids], pa.list_(id_type)), pa.array([made["lengths"]], pa.binary()),
                 pa.array([made["train"]], pa.binary()), pa.array([made["tokens"]], pa.binary()),
                 pa.array([made["words"]], pa.list_(pa.binary())), pa.array([made["classes"]], pa.binary()),
                 pa.array([made["counts"]], pa.list_(pa.int64()))],
                names=["block", "ids", "lengths", "train", "tokens", "words", "classes", "counts"])

        ids, texts, train, size, id_type = [], [], [], 0, pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for i, t, x in zip(b.column(0), b.column(1), b.column(2)):
                words = (x.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                if texts and (size + len(words) > BLOCK_WORDS or len(texts) == BLOCK_DOCS):
                    yield row(ids, texts, train)
                    ids, texts, train, size, number = [], [], [], 0, number + 1
                ids.append(i.as_py())
                train.append(t.as_py())
                texts.append(words)
                size += len(words)
        if texts:
            yield row(ids, texts, train)

    return docs.select("doc_id", "train", F.col("text")).mapInArrow(run, schema)


class Parameters:
    """Start, transition (state, state) and emission (class, state) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def estimate(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, total: np.ndarray) -> Parameters:
        """From expected counts; ``total``: training tokens by class, to smooth with."""
        overall = (total + 0.5) / (total.sum() + 0.5 * CLASSES)
        emit = emit + 20.0 * overall[:, None]
        move = move + 0.1
        return cls((start + 0.1) / (start + 0.1).sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def expected_counts(p: Parameters, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward over sequences laid end to end: expected start,
    transition and emission counts, and the log10 likelihood."""
    order = np.argsort(-lengths, kind="stable")
    n, k = len(lengths), len(p.start)
    size = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
    if not n or size[0] == 0:
        return start, move, emit, 0.0
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))]
    alpha, scale = [], []
    for t, m in enumerate(live):
        a = p.emit[classes[begin[:m] + t]]
        a = a * (p.start if t == 0 else alpha[-1][:m] @ p.move)
        s = a.sum(axis=1, keepdims=True)
        alpha.append(a / s)
        scale.append(s)
    where, weight = [], []
    beta = np.ones((live[-1], k))
    for t in range(len(live) - 1, -1, -1):
        gamma = alpha[t] * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        at = classes[begin[:live[t]] + t]
        where.append(at)
        weight.append(gamma)
        if t == 0:
            start = gamma.sum(axis=0)
            break
        right = p.emit[at] * beta / scale[t]
        move += (alpha[t - 1][:live[t]].T @ right) * p.move
        before = np.ones((live[t - 1], k))
        before[:live[t]] = right @ p.move.T
        beta = before
    where, weight = np.concatenate(where), np.concatenate(weight)
    for j in range(k):
        emit[:, j] = np.bincount(where, weight[:, j], minlength=CLASSES)
    return start, move, emit, float(sum(np.log10(s).sum() for s in scale))


def segments(lengths: np.ndarray, train: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the training documents and the lengths of their segments."""
    own = classes[np.repeat(train, lengths)]
    size = lengths[train]
    parts = -(-size // SEGMENT)
    out = np.full(int(parts.sum()), SEGMENT, np.int64)
    out[np.cumsum(parts) - 1] = size - (parts - 1) * SEGMENT
    return own, out


def _training_part(row: dict) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
    classes = np.frombuffer(row["classes"], np.uint16)
    tokens = _unpacked(row["tokens"], int(lengths.sum()))
    return segments(lengths, np.frombuffer(row["train"], np.uint8).astype(bool), classes[tokens].astype(np.int64))


def sample_segments(blocks: DataFrame, seed_tokens: int, n_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and lengths of a random sample of training segments, every segment
    of every block with the same chance; at most ``seed_tokens`` tokens. To look
    at a corpus with: the model takes nothing from it."""
    share = min(1.0, seed_tokens / max(1, n_all))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rng = np.random.default_rng(zlib.crc32(row["tokens"]))
                classes, size = _training_part(row)
                drawn = rng.random(len(size)) < share
                if not drawn.any():
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([zlib.crc32(row["tokens"])], pa.int64()),
                     pa.array([classes[np.repeat(drawn, size)].astype(np.uint16).tobytes()], pa.binary()),
                     pa.array([size[drawn].astype(np.int64).tobytes()], pa.binary())], names=["h", "classes", "size"])

    rows = blocks.select("lengths", "train", "tokens", "classes").mapInArrow(run, "h bigint, classes binary, size binary")
    got = rows.collect()  # about seed_tokens tokens, whatever the corpus
    got.sort(key=lambda r: (r["h"], bytes(r["classes"])))
    size = np.concatenate([np.frombuffer(r["size"], np.int64) for r in got] or [np.empty(0, np.int64)])
    classes = np.concatenate([np.frombuffer(r["classes"], np.uint16) for r in got] or [np.empty(0, np.uint16)]).astype(np.int64)
    # What chance drew beyond the bound goes at random, not from the last blocks.
    order = np.random.default_rng(7).permutation(len(size))
    some = np.zeros(len(size), bool)
    some[order[np.cumsum(size[order]) <= seed_tokens]] = True
    return classes[np.repeat(some, size)], size[some]


def seed_parameters(total: np.ndarray, states: int) -> Parameters:
    """Breaks the symmetry between the states: noise around ``total``, the training
    tokens by class."""
    rng = np.random.default_rng(5)
    return Parameters.estimate(np.ones(states), np.ones((states, states)) + 30 * np.eye(states),
                               (total[:, None] + 0.5) * rng.gamma(1.0, 1.0, (CLASSES, states)), total)


def baum_welch_pass(blocks: DataFrame, p: Parameters, total: np.ndarray, salt: int = 16) -> Parameters:
    """One pass over all training tokens. A task sends one vector per state."""
    states = len(p.start)
    sent = blocks.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = sent.value
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
        for b in batches:
            for row in b.to_pylist():
                classes, size = _training_part(row)
                for at in range(0, len(size), 2000):
                    part = size[at:at + 2000]
                    off = int(size[:at].sum())
                    s, m, e, _ = expected_counts(own, classes[off:off + int(part.sum())], part)
                    start, move, emit = start + s, move + m, emit + e
        rows = [np.concatenate([[start[j]], move[j], emit[:, j]]) for j in range(states)]
        yield pa.RecordBatch.from_arrays([pa.array(range(states), pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                                         names=["state", "counts"])

    rows = blocks.select("lengths", "train", "tokens", "classes").mapInArrow(run, "state int, counts array<double>")
    rows = rows.select("state", F.spark_partition_id().alias("salt"), array_to_vector("counts").alias("v"))
    sums = rows.groupBy("state", F.pmod("salt", F.lit(salt)).alias("salt")).agg(Summarizer.sum(F.col("v")).alias("v"))
    sums = sums.groupBy("state").agg(Summarizer.sum(F.col("v")).alias("v"))
    got = {r["state"]: np.array(r["c"]) for r in sums.select("state", vector_to_array("v").alias("c")).collect()}
    if not got:
        return p
    table = np.stack([got[j] for j in range(states)])
    return Parameters.estimate(table[:, 0], table[:, 1:1 + states], table[:, 1 + states:].T, total)


def forward_log10(p: Parameters, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of every class sequence, by scaled recursion. All
    sequences step together; the longest come first."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    out = np.zeros(len(lengths))
    state = np.tile(p.start, (len(lengths), 1))
    edges = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for t, m in enumerate(edges):
        a = state[:m] * p.emit[classes[begin[:m] + t]]
        s = a.sum(axis=1)
        out[:m] += np.log10(s)
        a /= s[:, None]
        state[:m] = a @ p.move
    back = np.empty_like(out)
    back[order] = out
    return back


def _score_block(row: dict, known: np.ndarray, counts: np.ndarray, p: Parameters, n_all: int, v_all: int,
                 class_tokens: np.ndarray, class_words: np.ndarray) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of every document of a block."""
    lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
    word_classes = np.frombuffer(row["classes"], np.uint16).astype(np.int64)
    tokens = _unpacked(row["tokens"], int(lengths.sum()))
    c = np.zeros(len(word_classes))
    c[known] = counts
    base = np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1)))
    total = class_tokens[word_classes]
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.where(c > 0, (c - DISCOUNT) / total, np.where(total > 0, DISCOUNT * class_words[word_classes] / total, 1.0))
    inside = np.log10(inside)
    at = np.cumsum(lengths) - lengths
    add = lambda per_word: np.add.reduceat(per_word[tokens], at)  # noqa: E731  every document has its end token
    score = forward_log10(p, word_classes[tokens], lengths) + add(inside)
    return [lengths, add((c > 0).astype(np.int64)), add(base), score]


def known_counts(words: DataFrame, totals: DataFrame, rows: int) -> DataFrame:
    """(block, i, c): every vocabulary entry of a block that was seen in training,
    with its count. ``totals``: word, c, blocks; ``rows``: the sum of its blocks."""
    hot = totals.filter((F.col("blocks") * HOT >= rows) & (F.octet_length("word") <= HOT_BYTES)).select("word", "c")
    asked = words.select("block", "i", "word").join(F.broadcast(hot), "word", "left")
    rest = asked.filter("c IS NULL").drop("c").join(totals.select("word", "c"), "word")
    return asked.filter("c IS NOT NULL").select("block", "i", "c").unionByName(rest.select("block", "i", "c"))


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", states: int = 8,
                passes: int = 6) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability of the text under the model).

    The model learns from the rows where ``train`` is true (a null condition
    counts as false). Null and empty texts are the end token alone. Repeated
    rows stay repeated; an empty table gives an empty result; without training
    rows every word is unknown. Only the named columns are read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"),
                         F.col(text_col).alias("text"))
    blocks = scratch.write(encode_blocks(narrow), "blocks")

    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w")).select(
        "block", "i", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = scratch.write(words.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks"))
                           .filter("c > 0").withColumn("class", class_column(F.col("word"))), "counts")

    # Totals by class: at most CLASSES rows, whatever the corpus.
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    rows = 0
    for r in totals.groupBy("class").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("words"),
                                         F.sum("blocks").alias("rows")).collect():
        class_tokens[r["class"]], class_words[r["class"]] = r["tokens"], r["words"]
        rows += r["rows"]
    n_all, v_all = int(class_tokens.sum()), int(class_words.sum())

    p = seed_parameters(class_tokens, states)
    for _ in range(passes if n_all else 0):
        p = baum_welch_pass(blocks, p, class_tokens)

    known = known_counts(words, totals, rows).select(F.col("block").alias("of"), "i", "c")
    payload = blocks.select("block", "ids", "lengths", "tokens", "classes")
    model = spark.sparkContext.broadcast((p, class_tokens, class_words))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own, tokens, kinds = model.value
        ids = left.column("ids").combine_chunks()
        parts = []
        for row in left.drop_columns(["ids"]).to_pylist():
            parts.append(_score_block(row, right.column("i").to_numpy(), right.column("c").to_numpy(), own, n_all, v_all,
                                      tokens, kinds))
        n_tokens, n_known, base, full = (np.concatenate(x) for x in zip(*parts)) if parts else [np.empty(0)] * 4
        return pa.table({"doc_id": ids.flatten() if len(ids) else ids, "n_tokens": pa.array(n_tokens, pa.int64()),
                         "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(len(base), n_all), pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(full, pa.float64())})

    return payload.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        score, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
