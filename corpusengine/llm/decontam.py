"""Benchmark decontamination: exact window containment by a prefix-filtered
set join, in SQL functions only.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter
item is one window). A document word inside any occurrence of a window is hit.

* Rarity: the benchmark's words are counted over the whole corpus (broadcast
  semi join of the benchmark vocabulary, map-side counts).
* Prefix: containment of *all* words of a window makes the necessary prefix one
  token, so a window is looked up by its rarest word only.
* Length and position: the word's place in the window fixes where an
  occurrence would start; starts outside the document are dropped.
* Verification: the words there are compared with the window, exactly, in the
  same row. Only verified occurrences leave the scan stage.

Documents are read once for the join, never shuffled: a document's words stay
in its row and only (document key, start, length, items) moves. The window
table is broadcast in blocks of a checked size; a larger benchmark takes more
passes, nothing is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, same_row_key, place, restored, sheltered

# What is not a word character (after lower-casing A-Z).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Rows of one broadcast: windows (each at most a few hundred bytes) and words.
MAX_WINDOWS = 100_000
MAX_VOCABULARY = 500_000

KEY = ["_id", "_h1", "_h2", "_nul"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def item_windows(items: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: win (array of words), items (ids as strings).

    Items without words have no window; an item without an id still makes its
    words hit, but is not listed. Repeated items count once."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    words = words.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    cut = words.select("item", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("s"))
    return (cut.select("item", F.slice("w", F.col("s"), F.col("n")).alias("win"))
            .groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items")))


def word_counts(words: DataFrame, vocabulary: DataFrame, broadcast: bool) -> DataFrame:
    """Corpus frequency of the words of ``vocabulary(token)``; ``words(w)`` are arrays."""
    flat = words.select(F.explode("w").alias("token"))
    if broadcast:
        return flat.join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    return flat.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).join(vocabulary, "token")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, min_share: int = 20,
                  id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", keep_key: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated (n_hit > 0 and min_share * n_hit >= n_words).

    Null texts have no words; repeated rows stay repeated; an empty benchmark
    hits nothing; an empty corpus gives an empty result. Only the named columns
    of the inputs are read. With ``keep_key`` the row key of ``same_row_key``
    is returned as well (one row per distinct key)."""
    scratch = Scratch(docs.sparkSession, "decontam")
    wins = scratch.write(item_windows(items, window, item_id_col, item_text_col), "windows")
    words = docs.select(*same_row_key(F.col(id_col), F.col(text_col)), words_of(F.col(text_col)).alias("w"))

    vocabulary = scratch.write(wins.select(F.explode("win").alias("token")).distinct(), "vocabulary")
    few = vocabulary.count() <= MAX_VOCABULARY
    freq = word_counts(words.select("w"), vocabulary, few)
    places = wins.select("win", "items", F.posexplode("win").alias("off", "token")).join(
        F.broadcast(freq) if few else freq, "token", "left")
    prefix = places.groupBy("win").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "token", "off")).alias("p"), F.first("items").alias("items"))
    table = scratch.write(prefix.select(
        F.col("p.token").alias("token"), F.col("p.off").alias("off"), F.size("win").alias("len"), "win", "items"), "prefixes")
    blocks = -(-max(table.count(), 1) // MAX_WINDOWS)

    # The empty word stands for the row itself: it carries n_words, and rows
    # without a hit, through the same join.
    rows = words.withColumn("n_words", F.size("w"))
    marked = docs.sparkSession.sql("SELECT '' AS token, 0 AS off, 0 AS len, array('') AS win, array('') AS items").select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    hits = []
    for b in range(blocks):
        part = table.filter(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
        if b == 0:
            part = part.union(marked)
        own = F.concat(F.array(F.lit("")), F.col("w")) if b == 0 else F.col("w")
        flat = rows.select(*KEY, "n_words", "w", F.posexplode(own).alias("at", "token"))
        start = F.col("at") - F.col("off") - (1 if b == 0 else 0)  # from 0
        same = (F.when(F.col("token") == "", F.lit(True))
                .when((start >= 0) & (start + F.col("len") <= F.col("n_words")),
                      F.slice("w", start + 1, F.col("len")) == F.col("win")).otherwise(F.lit(False)))
        found = flat.join(F.broadcast(part), "token").filter(same)
        real = F.col("token") != ""
        hits.append(found.select(
            *KEY, "n_words", F.when(real, F.struct(start.alias("s"), (start + F.col("len")).alias("e"))).alias("span"),
            F.when(real, F.col("items")).alias("items")))
    grouped = reduce(DataFrame.unionByName, hits).groupBy(*KEY).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(F.col("span").isNull(), 1)).alias("_copies"),
        F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    # Length of the union of the spans: they come sorted, each adds what lies
    # beyond the furthest end so far.
    cover = F.aggregate(F.sort_array("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"),
                                              F.greatest(a["end"], x["e"]).alias("end")), lambda a: a["n"])
    ids = F.array_sort(F.array_distinct(F.flatten("items")))
    out = grouped.select(*KEY, "_copies", "n_words", cover.cast("long").alias("n_hit"), ids.alias("ids"))
    out = out.select(
        *KEY, "_copies", F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
    if keep_key:
        return out.drop("_copies", "doc_id")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop(*KEY, "_copies", "_copy")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, min_share: int = 20,
                      id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated. All columns are kept, with
    their values, whatever their names."""
    like, docs, id_col, text_col = docs, sheltered(docs), place(docs, id_col), place(docs, text_col)
    bad = contamination(docs, items, window, min_share, id_col, text_col, item_id_col, item_text_col, keep_key=True)
    bad = bad.filter("contaminated").select(*[F.col(k).alias(f"_bad{k}") for k in KEY])
    keyed = docs.select("*", *[c.alias(f"_own{k}") for c, k in zip(
        same_row_key(F.col(id_col), F.col(text_col)), KEY)])
    on = reduce(lambda a, b: a & b, [keyed[f"_own{k}"].eqNullSafe(bad[f"_bad{k}"]) for k in KEY])
    return restored(keyed.join(bad, on, "left_anti"), like)
