"""Quality classifier: an interpolated modified Kneser-Ney character model.

The model is trained on trusted text (documents labelled good) and gives every
document a perplexity; a document is kept when it is not above a quantile of
the trusted documents' perplexities in its own language and length band, and
neither is the share of its character runs that repeat earlier ones (a text of
one ordinary word over and over has a low perplexity).

* The symbols are the code points, of every script, and a begin and an end mark.
* Counts of character trigrams are gathered per Arrow batch and summed by
  Spark in shards (hash of the trigram). Everything else of the estimate is
  joins of count tables: continuation counts come from the trigrams, context
  totals and discounts from each order, and each order joins the next lower.
* A text's log-probability adds up over its characters. ``text_scores`` joins
  per-document trigram counts with the sharded tables, whatever their size. Texts
  go in blocks: the distinct trigrams of all blocks meet the tables by key, each
  block gets the values of its own trigrams back, and its documents' counts are
  weighted with them. No row moves per character or per trigram of a document,
  and no table is collected.
* ``ArrayModel`` holds small tables in one process, to score single texts with;
  ``judge`` and ``keep_ordinary`` do not use it. Both give the same sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import Scratch, place, restored, sheltered

# Alphabet: all code points (those below LATIN, which is all of them), begin, end.
# The code of a trigram fits 63 bits.
LATIN = 0x110000
BEGIN, END = LATIN, LATIN + 1
ALPHABET = LATIN + 2
# Rows of a probability table that ``ArrayModel`` may hold.
MAX_ROWS = 2_000_000
# Cells of such an array: contexts times characters seen.
MAX_CELLS = 20_000_000
# Characters a text is treated at a time.
BLOCK = 1 << 20
# Bounds of a block of texts: symbols and texts.
BLOCK_SYMBOLS, BLOCK_TEXTS = 1 << 22, 4_000
# Length of the character runs that are looked for again, and the factor of their hash.
RUN, HASH = 8, np.uint64(0x9E3779B97F4A7C15)
# Length bands (powers of two), and the fewest trusted documents of a language
# that has limits of its own.
BANDS, FEW = 32, 20
# One of so many trusted documents is held out of training, for the limits.
HELD = 2
# Share of a text's symbols that its perplexity leaves out, the least expected
# ones: a credential or a number in good prose says nothing about the prose.
TRIMMED = 0.1
ADDED = ("_lp", "_chars", "_ppl", "_limit", "_rep", "_rep_limit", "_keep")
# What tells texts apart.
KEY = ["_kn_h1", "_kn_h2"]


def symbols(text: str) -> np.ndarray:
    """Alphabet symbols of a text with two begin marks and an end mark."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.full(len(cp) + 3, BEGIN, np.int64)
    out[2:-1] = cp
    out[-1] = END
    return out


def grams(s: np.ndarray) -> np.ndarray:
    """Trigram codes: (a * ALPHABET + b) * ALPHABET + c."""
    return (s[:-2] * ALPHABET + s[1:-1]) * ALPHABET + s[2:]


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text, sorted, and their counts."""
    s = symbols(text)
    parts = [np.unique(grams(s[at:at + BLOCK + 2]), return_counts=True) for at in range(0, len(s) - 2, BLOCK)]
    if len(parts) == 1:
        return parts[0]
    g, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(g), np.int64)
    np.add.at(n, at, np.concatenate([n for _, n in parts]))
    return g, n


def trigram_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(g, n) over all texts; counted per batch, then summed in shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                codes = [grams(symbols(t.as_py() or "")) for t in b.column(0).slice(at, 500)]
                g, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], names=["g", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "g bigint, n bigint")
    return rows.groupBy("g").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts n1..n4."""
    row = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x) for x in row)
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 0.75, 0.9  # too little text for the estimate
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k - 0.01, max(0.01, d)) for k, d in zip(
        (1, 2, 3), (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def kneser_ney(counts: DataFrame, scratch: Scratch) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Probability and back-off tables per order from trigram ``counts(g, n)``.

    Order 3 and 2: (ctx, c, p) and (ctx, gamma); order 1: (c, p) and the weight
    of the uniform distribution (one row). Counts of order 2 and 1 are
    continuation counts (number of distinct preceding symbols)."""
    c3 = scratch.write(counts.select(F.expr(f"g div {ALPHABET}").alias("ctx"),
                                     F.pmod("g", F.lit(ALPHABET)).alias("c"), "n"), "count3")
    c2 = scratch.write(c3.groupBy(F.pmod("ctx", F.lit(ALPHABET)).alias("ctx"), "c").agg(F.count(F.lit(1)).alias("n")), "count2")
    c1 = scratch.write(c2.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "count1")

    def weights(c: DataFrame, keys: list[str], d) -> DataFrame:
        return c.groupBy(*keys).agg(F.sum("n").cast("double").alias("total"),
                                    F.sum(_discount(F.col("n"), d)).alias("left")).withColumn(
            "gamma", F.col("left") / F.col("total"))

    d3, d2, d1 = _discounts(c3), _discounts(c2), _discounts(c1)
    # Order 1 has one context: two numbers.
    one = c1.agg(F.sum("n").cast("double"), F.sum(_discount(F.col("n"), d1))).first()
    total, gamma = (one[0], one[1] / one[0]) if one[0] else (1.0, 1.0)
    p1 = scratch.write(c1.select("c", ((F.col("n") - _discount(F.col("n"), d1)) / total + gamma / ALPHABET).alias("p")), "p1")
    w2 = weights(c2, ["ctx"], d2)
    p2 = c2.join(w2, "ctx").join(p1.withColumnRenamed("p", "lower"), "c")
    p2 = scratch.write(p2.select("ctx", "c", ((F.col("n") - _discount(F.col("n"), d2)) / F.col("total")
                                              + F.col("gamma") * F.col("lower")).alias("p")), "p2")
    w3 = weights(c3, ["ctx"], d3)
    p3 = c3.withColumn("b", F.pmod("ctx", F.lit(ALPHABET))).join(w3, "ctx").join(
        p2.select(F.col("ctx").alias("b"), "c", F.col("p").alias("lower")), ["b", "c"])
    p3 = scratch.write(p3.select("ctx", "c", ((F.col("n") - _discount(F.col("n"), d3)) / F.col("total")
                                              + F.col("gamma") * F.col("lower")).alias("p")), "p3")
    g1 = counts.sparkSession.createDataFrame([(gamma,)], "gamma double")
    return {1: (p1, g1), 2: (p2, scratch.write(w2.select("ctx", "gamma"), "gamma2")),
            3: (p3, scratch.write(w3.select("ctx", "gamma"), "gamma3"))}


class ArrayModel:
    """The tables as arrays: a row of log10 probabilities per context.

    Contexts of two symbols that were not seen fall back to the row of their
    last symbol, as the interpolation does (their weight is all back-off)."""

    def __init__(self, tables: dict[int, tuple[list, list]]):
        (p1, g1), (p2, g2), (p3, g3) = tables[1], tables[2], tables[3]
        seen = sorted({int(c) for c, _ in p1} | {BEGIN})
        self.compact = np.full(ALPHABET, len(seen), np.int32)  # the last column: symbols never seen
        self.compact[seen] = np.arange(len(seen))
        k = self.k = len(seen) + 1
        unseen = (g1[0][0] if g1 else 1.0) / ALPHABET
        uni = np.full(k, unseen)
        for c, p in p1:
            uni[self.compact[c]] = p
        bi = np.tile(uni, (k, 1))
        for ctx, gamma in g2:
            bi[self.compact[ctx]] = gamma * uni
        for ctx, c, p in p2:
            bi[self.compact[ctx], self.compact[c]] = p
        rows = {int(ctx): i for i, (ctx, _) in enumerate(g3)}
        tri = np.empty((len(rows) + k, k))
        tri[len(rows):] = bi
        self.row = np.tile(np.arange(k, dtype=np.int32) + len(rows), (k, 1))
        for ctx, gamma in g3:
            a, b = self.compact[ctx // ALPHABET], self.compact[ctx % ALPHABET]
            tri[rows[ctx]] = gamma * bi[b]
            self.row[a, b] = rows[ctx]
        for ctx, c, p in p3:
            tri[rows[ctx], self.compact[c]] = p
        self.log = np.log10(tri).ravel()
        self.row = self.row.ravel()

    def symbol_logs(self, text: str) -> np.ndarray:
        """log10 probability of every character and the end mark."""
        s = symbols(text)
        parts = []
        for at in range(0, len(s) - 2, BLOCK):
            x = self.compact[s[at:at + BLOCK + 2]]
            parts.append(self.log[self.row[x[:-2] * self.k + x[1:-1]].astype(np.int64) * self.k + x[2:]])
        return np.concatenate(parts)

    def log_prob(self, text: str) -> float:
        return float(self.symbol_logs(text).sum())


def core_mean(logs: np.ndarray) -> float:
    """Mean log10 probability of the symbols but for the ``TRIMMED`` share that
    is the least expected."""
    out = int(len(logs) * TRIMMED)
    return float(np.partition(logs, out)[out:].mean()) if out else float(logs.mean())


def collect_model(tables: dict[int, tuple[DataFrame, DataFrame]]) -> ArrayModel | None:
    """The array model for single texts, or None when the tables exceed ``MAX_ROWS``
    or ``MAX_CELLS``."""
    if tables[3][0].count() > MAX_ROWS:
        return None
    k = tables[1][0].count() + 2  # with the begin mark and the characters never seen
    if (tables[3][1].count() + k) * k > MAX_CELLS:
        return None
    return ArrayModel({k: tuple([tuple(r) for r in t.collect()] for t in pair) for k, pair in tables.items()})


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers as four byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` plus ``KEY``: rows that agree in it have the same text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({KEY[0]: F.xxhash64(text), KEY[1]: F.hash(text, F.length(text))})


def count_blocks(texts: DataFrame, text_col: str) -> DataFrame:
    """``texts`` with ``KEY`` as one row per block: the distinct trigrams ``g``, and
    per text its key, the number of its own trigrams (``sizes``), their places in
    ``g`` (``steps``: differences, the first from 0) and counts; map-only."""
    schema = "block bigint, g array<bigint>, h1 array<bigint>, h2 array<int>, sizes binary, steps binary, counts binary"

    def row(number: int, h1: list, h2: list, own: list) -> pa.RecordBatch:
        g = np.unique(np.concatenate([x for x, _ in own]))
        sizes = np.array([len(x) for x, _ in own], np.int64)
        steps = np.concatenate([np.diff(np.searchsorted(g, x), prepend=0) for x, _ in own])
        counts = np.concatenate([n for _, n in own])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([g], pa.list_(pa.int64())), pa.array([h1], pa.list_(pa.int64())),
             pa.array([h2], pa.list_(pa.int32())), *[pa.array([_packed(x)], pa.binary()) for x in (sizes, steps, counts)]],
            names=["block", "g", "h1", "h2", "sizes", "steps", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        h1, h2, own, size = [], [], [], 0
        for b in batches:
            for a, c, t in zip(b.column(0), b.column(1), b.column(2)):
                text = t.as_py() or ""
                if own and (size + len(text) > BLOCK_SYMBOLS or len(own) == BLOCK_TEXTS):
                    yield row(number, h1, h2, own)
                    h1, h2, own, size, number = [], [], [], 0, number + 1
                h1.append(a.as_py())
                h2.append(c.as_py())
                own.append(text_counts(text))
                size += len(text) + 1
        if own:
            yield row(number, h1, h2, own)

    return texts.select(*KEY, F.col(text_col)).mapInArrow(run, schema)


def gram_logs(asked: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(g, log): log10 probability of every trigram of ``asked(g)``, by joins with
    the tables of each order."""
    flat = asked.withColumns({"ctx": F.expr(f"g div {ALPHABET}"), "c": F.pmod("g", F.lit(ALPHABET))})
    flat = flat.withColumn("b", F.pmod("ctx", F.lit(ALPHABET)))
    (p1, g1), (p2, g2), (p3, g3) = tables[1], tables[2], tables[3]
    uniform = g1.first()
    unseen = (uniform[0] if uniform else 1.0) / ALPHABET
    joined = (flat.join(p3, ["ctx", "c"], "left").withColumnRenamed("p", "x3")
              .join(g3.withColumnRenamed("gamma", "y3"), "ctx", "left")
              .join(p2.select(F.col("ctx").alias("b"), "c", F.col("p").alias("x2")), ["b", "c"], "left")
              .join(g2.select(F.col("ctx").alias("b"), F.col("gamma").alias("y2")), "b", "left")
              .join(p1.withColumnRenamed("p", "x1"), "c", "left"))
    low = F.coalesce("x2", F.coalesce("y2", F.lit(1.0)) * F.coalesce("x1", F.lit(unseen)))
    return joined.select("g", F.log10(F.coalesce("x3", F.coalesce("y3", F.lit(1.0)) * low)).alias("log"))


def _score_block(row: dict, logs: np.ndarray) -> list[np.ndarray]:
    """Log10 probability, symbols and ``core_mean`` of every text of a block, from
    the ``logs`` of its trigrams."""
    n_texts = len(row["h1"])
    sizes = _unpacked(row["sizes"], n_texts)
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    at = np.cumsum(_unpacked(row["steps"], total))
    at -= np.repeat(np.concatenate([[0], at[begin[1:] - 1]]), sizes)
    n, log = _unpacked(row["counts"], total), logs[at]
    lp, chars = np.add.reduceat(n * log, begin), np.add.reduceat(n, begin)
    # A text's trigrams, the least expected first; TRIMMED of them are left out.
    order = np.lexsort((log, np.repeat(np.arange(n_texts), sizes)))
    n, log = n[order], log[order]
    upto = np.cumsum(n) - np.repeat(np.cumsum(chars) - chars, sizes)
    left = np.clip(upto - np.repeat((chars * TRIMMED).astype(np.int64), sizes), 0, n)
    return [lp, chars, np.add.reduceat(left * log, begin) / np.add.reduceat(left, begin)]


def text_scores(docs: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]], text_col: str, scratch: Scratch) -> DataFrame:
    """A row per distinct text: ``KEY``, _lp (log10 probability of the text), _chars
    (its symbols: characters and the end mark) and _core (their ``core_mean``)."""
    blocks = scratch.write(count_blocks(keyed(docs.select(text_col), text_col), text_col), "blocks")
    asked = blocks.select(F.col("block").alias("of"), F.explode("g").alias("g"))
    logs = scratch.write(gram_logs(asked.select("g").distinct(), tables), "logs")
    # Exploded from a scan that looks small: never a broadcast.
    told = asked.join(logs.hint("merge"), "g").select("of", "g", "log")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        logs = right.column("log").to_numpy()[np.argsort(right.column("g").to_numpy())]
        parts = [_score_block(row, logs) for row in left.drop_columns(["h1", "h2"]).append_column(
            "h1", left.column("h1")).to_pylist()]
        lp, chars, core = (np.concatenate(x) for x in zip(*parts)) if parts else [np.empty(0)] * 3
        h1, h2 = (left.column(c).combine_chunks() for c in ("h1", "h2"))
        return pa.table({KEY[0]: h1.flatten(), KEY[1]: h2.flatten(), "_lp": pa.array(lp, pa.float64()),
                         "_chars": pa.array(chars, pa.int64()), "_core": pa.array(core, pa.float64())})

    rows = blocks.drop("g").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(
        score, f"{KEY[0]} bigint, {KEY[1]} int, _lp double, _chars bigint, _core double")
    out = scratch.write(rows.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("_lp", "_chars", "_core")]), "text-scores")
    scratch.drop(blocks)
    scratch.drop(logs)
    return out


def log_prob_by_joins(docs: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]], text_col: str,
                      out: str = "_lp", chars: str = "_chars", core: str = "_core") -> DataFrame:
    """``docs`` plus the log10 probability of the text, its symbols (characters and
    the end mark) and their ``core_mean``."""
    scores = text_scores(docs, tables, text_col, Scratch(docs.sparkSession, "kn-joins"))
    scores = scores.withColumnsRenamed({"_lp": out, "_chars": chars, "_core": core})
    return keyed(docs, text_col).join(scores.hint("merge"), KEY).drop(*KEY)


def held_out(id_col: str) -> Column:
    """Every ``HELD``-th trusted document, by a hash of its id."""
    return F.pmod(F.xxhash64(id_col, F.lit("held out")), F.lit(HELD)) == 0


def trusted_ids(labels: DataFrame, label_id: str, label_col: str) -> DataFrame:
    return labels.filter(F.col(label_col) == 1).select(F.col(label_id).alias("_kn_id")).dropna().distinct()


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, label_col: str,
          doc_id_col: str | None = None) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Tables from all trusted documents but those that the limits come from.

    The ids grow with the corpus, so they are never broadcast whole: the half of
    the texts that is not held out is shuffled once."""
    doc_id_col = doc_id_col or id_col
    ids = trusted_ids(labels, id_col, label_col).filter(~held_out("_kn_id"))
    texts = docs.select(F.col(doc_id_col).alias("_kn_id"), F.col(text_col).alias("text")).filter(~held_out("_kn_id"))
    return kneser_ney(trigram_counts(texts.join(ids.hint("merge"), "_kn_id")), scratch)


def repeated_share(text: str) -> float:
    """Share of a text's runs of ``RUN`` characters that occurred before in it."""
    s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(s) - RUN + 1
    if n < 2:
        return 0.0
    run = np.zeros(n, np.uint64)
    for i in range(RUN):
        run = run * HASH + s[i:i + n]
    return 1.0 - len(np.unique(run)) / n


def with_repeats(docs: DataFrame, text_col: str, out: str = "_rep") -> DataFrame:
    """``docs`` plus the repeated share of the text; map-only."""
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])
    names, at = [f.name for f in schema.fields], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            share = [repeated_share(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(share, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def _range(counts: dict[int, int], band: int, least: int) -> tuple[int, int]:
    """The narrowest range of bands around ``band`` with ``least`` documents, or all."""
    lo = hi = band
    while sum(counts.get(x, 0) for x in range(lo, hi + 1)) < least and (lo > 0 or hi < BANDS - 1):
        lo, hi = max(0, lo - 1), min(BANDS - 1, hi + 1)
    return lo, hi


def _few(n: int, quantile: float, most: float, mean: float, sd: float | None, spread: float, chars: int) -> float:
    """Limit of a perplexity in bits from too few values to have the quantile: the
    greatest or, if higher, the normal prediction limit (Student's quantile). A
    mean over ``chars`` characters varies by at least ``spread`` / chars."""
    z, v = NormalDist().inv_cdf(quantile), max(n - 1, 1)
    t = z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v * v)
    sd = max(sd or 0.0, math.sqrt(max(spread, 0.0) / chars))
    return max(most, mean + t * sd * math.sqrt(1 + 1 / n))


def _few_shares(quantile: float, mean: float, sd: float | None) -> float:
    """Limit of a repeated share, mostly 0, from too few values: whatever the
    distribution, no more lie above it (Cantelli's inequality)."""
    return min(1.0, mean + (sd or 0.0) * math.sqrt(quantile / (1 - quantile)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          label_col: str = "quality", quantile: float = 0.995) -> DataFrame:
    """``docs`` plus _lp, _chars, _ppl (perplexity per character, of the ``TRIMMED``
    text), _limit, _rep
    (repeated share), _rep_limit and _keep. A column of ``docs`` with one of these
    names gives way to it; ``keep_ordinary`` keeps all columns.

    Half of the trusted documents are not trained on. A text is kept when
    neither its perplexity nor its repeated share is above the ``quantile`` of
    that half, over the documents of the text's language and length band
    (lengths double from band to band). A band with too few of them to have the
    quantile (200 for 99.5 %) takes in its neighbours; ``_few`` tells what holds
    for a language with too few at all lengths. Languages with fewer than ``FEW``
    trusted documents, and the null language, use those of all languages. Empty
    texts are kept. Without held-out trusted documents nothing is rejected."""
    judged = _judged(docs, labels, id_col, text_col, lang_col, label_col, quantile)
    own = [F.col(f"in{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ADDED]
    return judged.select(*own, *ADDED)


def keep_ordinary(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", label_col: str = "quality", quantile: float = 0.995,
                  margin: float = 1.15) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns and
    values, whatever their names. A filter for good should leave good documents
    alone that are a little unlike the trusted ones: here a perplexity of
    ``margin`` times the limit passes."""
    judged = _judged(docs, labels, id_col, text_col, lang_col, label_col, quantile, margin)
    return restored(judged.filter("_keep"), docs)


def _judged(docs: DataFrame, labels: DataFrame, label_id: str, text_col: str, lang_col: str, label_col: str,
            quantile: float, margin: float = 1.0) -> DataFrame:
    """The sheltered ``docs`` plus the columns of ``judge``."""
    id_col, text_col, lang_col = (place(docs, c) for c in (label_id, text_col, lang_col))
    docs = sheltered(docs)
    spark = docs.sparkSession
    scratch = Scratch(spark, "kneser-ney")
    tables = train(docs, labels, scratch, label_id, text_col, label_col, id_col)
    scores = text_scores(docs, tables, text_col, scratch).withColumns(
        {"_kn_bits": -F.col("_core"), "_kn_band": F.floor(F.log2("_chars")).cast("int")}).hint("merge")

    # Keyed where they are read, then joined: here the texts are not shuffled.
    narrow = docs.select(F.col(id_col).alias("_kn_id"), F.col(lang_col).alias("_kn_lang"), F.col(text_col))
    apart = trusted_ids(labels, label_id, label_col).filter(held_out("_kn_id"))
    held = narrow.filter(held_out("_kn_id") & F.col("_kn_id").isNotNull())
    held = keyed(with_repeats(held, text_col), text_col).drop(text_col).join(apart.hint("merge"), "_kn_id")
    good = scratch.write(held.join(scores, KEY).drop(*KEY), "scores").filter(F.col("_chars") > 1)

    # Each trusted document counts for its language ("=en") and for all ("*").
    key = F.explode(F.array_compact(F.array(F.concat(F.lit("="), F.col("_kn_lang").cast("string")), F.lit("*"))))
    named = good.select("_kn_bits", "_kn_band", "_rep", "_chars", key.alias("of"))
    counts: dict[str, dict[int, int]] = {}
    for r in named.groupBy("of", "_kn_band").count().collect():  # at most BANDS rows per language
        counts.setdefault(r["of"], {})[r["_kn_band"]] = r["count"]
    least = math.ceil(round(1 / (1 - quantile), 6)) if quantile < 1 else 1
    ranges = [(of, band, *_range(own, band, least)) for of, own in counts.items() for band in range(BANDS)
              if of == "*" or sum(own.values()) >= FEW]
    # A row per band a document counts in, then one aggregate.
    takes = spark.createDataFrame(ranges, "of string, band int, lo int, hi int").select(
        "of", "band", F.explode(F.sequence("lo", "hi")).alias("_kn_band"))
    stats = [f(c).alias(f"{n}_{c}") for c in ("_kn_bits", "_rep") for n, f in (
        ("top", lambda c: F.percentile_approx(c, quantile, 10_000)), ("most", F.max), ("mean", F.avg), ("sd", F.stddev_samp))]
    found = named.join(F.broadcast(takes), ["of", "_kn_band"]).groupBy("of", "band").agg(
        F.count(F.lit(1)).alias("n"), *stats, F.avg("_chars").alias("c"), F.avg(F.col("_chars") * F.col("_kn_bits")).alias("cx"),
        F.avg(F.col("_chars") * F.col("_kn_bits") * F.col("_kn_bits")).alias("cxx"))
    limits = {}
    for r in found.collect():
        bits, share = ([r[f"{x}_{c}"] for x in ("top", "most", "mean", "sd")] for c in ("_kn_bits", "_rep"))
        if r["n"] >= least:
            # The quantile of n + 1 values, one of them unknown: of few it is the greatest.
            at = 1 if math.ceil((r["n"] + 1) * quantile) >= r["n"] else 0
            limits[r["of"], r["band"]] = bits[at], share[at]
        else:  # repetition is not a matter of language: there the limit of all of them
            # Mean of chars x squared distance from the mean.
            spread = r["cxx"] - 2 * bits[2] * r["cx"] + bits[2] ** 2 * r["c"]
            limits[r["of"], r["band"]] = _few(r["n"], quantile, *bits[1:], spread, 2 ** r["band"]), (
                _few_shares(quantile, *share[2:]) if r["of"] == "*" else None)

    def table(of: str, cols: str) -> DataFrame:
        mine = [(k[1:], band, *x) for (k, band), x in limits.items() if (k == "*") == (of == "*")]
        return F.broadcast(spark.createDataFrame(mine, cols))

    out = keyed(with_repeats(docs, text_col), text_col).join(scores, KEY).drop(*KEY, "_core")
    lang = table("=", "_kn_l string, _kn_b int, _kn_x double, _kn_r double")
    out = out.join(lang, (F.col(lang_col).cast("string") == F.col("_kn_l")) & (F.col("_kn_band") == F.col("_kn_b")), "left")
    every = table("*", "_kn_a string, _kn_ab int, _kn_ax double, _kn_ar double")
    out = out.join(every, F.col("_kn_band") == F.col("_kn_ab"), "left")
    limit = F.coalesce("_kn_x", "_kn_ax", F.lit(math.inf)) + math.log10(margin)
    out = out.withColumns({"_ppl": F.pow(F.lit(10.0), "_kn_bits"), "_limit": F.pow(F.lit(10.0), limit),
                           "_rep_limit": F.coalesce("_kn_r", "_kn_ar", F.lit(1.0))})
    # Sums of the same text may differ in their last digits when they are joins.
    ordinary = (F.col("_kn_bits") <= limit + 1e-9) & (F.col("_rep") <= F.col("_rep_limit"))
    out = out.withColumn("_keep", (F.col("_chars") <= 1) | ordinary)
    return out.drop("_kn_bits", "_kn_band", "_kn_l", "_kn_b", "_kn_x", "_kn_r", "_kn_a", "_kn_ab", "_kn_ax", "_kn_ar")
