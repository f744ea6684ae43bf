"""SimHash near-duplicate groups with pigeonring filtering.

Fingerprints are made once per row in Arrow batches. Everything after that is
DataFrame work on distinct fingerprints, so any number of exact copies costs
one row per map task.

Links (``max_bits`` <= 2) come from a pigeonring cascade over ``segments``
consecutive bit ranges laid out on a ring. If two fingerprints differ in at
most t bits over m segments, some start i exists from which *every* prefix of
l consecutive segments differs in at most floor(l*t/m) bits. With t = 2 and
m = 5 the budgets are 0, 0, 1, 1, 2:

1. chain of two segments, budget 0: equal 26 bits;
2. chain of three, budget 1: the third segment shares a value within one bit;
3. whole ring, budget 2: two fingerprints are within two bits exactly when
   they share a value within one bit of each, so survivors meet on such
   values (flips outside the two equal segments only). At most 65
   fingerprints lie within one bit of a value, hence no meeting group is ever
   larger, whatever the data. A final ``bit_count`` checks every link.

A level keeps a fingerprint only if its chain key is shared. Nothing emits the
pairs of a bucket: keys are counted with map-side combine and joined back.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, place, restored, sheltered

HASH_SEED = 42
# Shingle hashes expanded to bits at a time (64 bytes each).
BIT_BLOCK = 65_536


def simhash64(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text (null: as the empty text)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BIT_BLOCK):
        bits = np.unpackbits(h[at:at + BIT_BLOCK].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "_fp",
                     shingle: int = 3) -> DataFrame:
    """``docs`` plus a signed 64-bit fingerprint column."""
    schema = StructType([*docs.schema.fields, StructField(out_col, LongType())])
    names = [f.name for f in schema.fields]
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            fps = np.fromiter((simhash64(t.as_py(), shingle) for t in b.column(at)),
                              np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=names)

    return docs.mapInArrow(run, schema)


def _segments(m: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of m ranges covering 64 bits."""
    at, out = 0, []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        out.append((at, width))
        at += width
    return out


def _mask(parts) -> int:
    return sum(((1 << w) - 1) << a for a, w in parts)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _shared(rows: DataFrame) -> DataFrame:
    """(s, fp) of the rows whose (s, key) is held by more than one row. Each
    fingerprint has a key at most once per start, so two rows mean two
    fingerprints.

    Never a broadcast: the rows are exploded from a scan whose size, which Spark
    judges by, does not tell how many they are."""
    held = rows.groupBy("s", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(held.select("s", "key").hint("merge"), ["s", "key"]).select("s", "fp").distinct()


def hamming_links(fps: DataFrame, scratch: Scratch, max_bits: int = 2, segments: int = 5) -> DataFrame:
    """Links (u, v), u < v, over distinct fingerprints ``fps(fp)``.

    The links hold at most ``max_bits`` differing bits each and connect
    exactly the fingerprints that are connected by such links (members of a
    meeting group are linked to its smallest member)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    if segments <= max_bits:
        raise ValueError("segments must exceed max_bits")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).filter("u < v")
    seg = _segments(segments)
    ring = lambda i, n: [seg[(i + k) % segments] for k in range(n)]
    budget = [k * max_bits // segments for k in range(segments + 1)]
    equal = max(k for k in range(segments + 1) if budget[k] == 0)
    starts = range(segments)

    # Level 1: the longest chain with budget 0.
    rows = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(ring(i, equal))))).alias("key"))
        for i in starts])).alias("x")).select("fp", "x.s", "x.key")
    alive = scratch.write(_shared(rows), "chain-equal")

    def flips(bits_of) -> F.Column:
        """Per start: 0 and each single bit of the given segments."""
        return F.element_at(F.array(*[
            F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for a, w in bits_of(i) for b in range(a, a + w)])
            for i in starts]), F.col("s") + 1)

    def per_start(parts) -> F.Column:
        return F.element_at(F.array(*[F.lit(_signed(_mask(parts(i)))) for i in starts]), F.col("s") + 1)

    # Level 2: one more segment, within one bit of a shared value.
    longer = alive.select("s", "fp", F.explode(flips(lambda i: ring(i, equal + 1)[-1:])).alias("f")).select(
        "s", "fp", F.col("fp").bitwiseXOR(F.col("f")).bitwiseAND(per_start(lambda i: ring(i, equal + 1))).alias("key"))
    alive2 = scratch.write(_shared(longer), "chain-one")
    scratch.drop(alive)

    # Level 3: the whole ring; the groups are bounded by geometry (<= 65).
    rest = lambda i: ring(i, segments)[equal:]
    meet = alive2.select("fp", F.explode(flips(rest)).alias("f")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("f")).alias("key"))
    groups = meet.groupBy("key").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    links = (groups.select(F.array_min("members").alias("u"), F.explode("members").alias("v"))
             .filter((F.col("u") < F.col("v"))
                     & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)).distinct())
    if max_bits == 1:
        # Members may be two bits apart: meet on the fingerprints themselves.
        own = alive2.select("fp").distinct()
        links = (meet.join(own.select(F.col("fp").alias("key")).hint("merge"), "key")
                 .select(F.least("fp", "key").alias("u"), F.greatest("fp", "key").alias("v"))
                 .filter("u < v").distinct())
    return links


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links(u, v)``; root is the smallest
    node of its component.

    Each round points every node at its smallest neighbour, follows the
    pointers to their ends, and contracts the links. Aggregates combine
    map-side and joins are plain shuffle joins (a hub is split as join skew).
    """
    edges = scratch.write(links, "edges")
    mapping = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = scratch.write(both.groupBy("u").agg(F.min("v").alias("v"))
                           .select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "up")
        while True:
            nxt = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = scratch.write(up.join(nxt, "root").select("node", F.col("next").alias("root"),
                                                              (F.col("next") != F.col("root")).alias("moved")), "jump")
            scratch.drop(up)
            up = jumped
            if up.filter("moved").limit(1).count() == 0:
                break
        roots = up.select("node", "root")
        if mapping is None:
            new = roots
        else:
            new = (mapping.join(roots.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
                   .select("node", F.coalesce("next", "root").alias("root")))
        new = scratch.write(new, "mapping")
        scratch.drop(mapping)
        mapping = new
        left = (edges.join(roots.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
                .join(roots.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
                .filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        left = scratch.write(left, "edges")
        scratch.drop(edges)
        scratch.drop(up)
        edges = left
        if edges.limit(1).count() == 0:
            return mapping


def fingerprint_components(rows: DataFrame, scratch: Scratch, max_bits: int = 2, segments: int = 5) -> DataFrame:
    """(fp, root, first_id, component_id) of every distinct fingerprint in
    ``rows(doc_id, fp)``.

    root names the component by its smallest fingerprint; first_id is the
    smallest doc_id of the fingerprint and component_id that of the component
    (null ids are passed over; null when there is no other)."""
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = hamming_links(distinct.select("fp"), scratch, max_bits, segments)
    roots = connected_components(links, scratch)
    joined = (distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    ids = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return joined.join(ids, "root").select("fp", "root", "first_id", "component_id")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          shingle: int = 3, max_bits: int = 2, segments: int = 5) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and wordless texts have fingerprint zero and link like any other.
    Repeated rows stay repeated; rows without an id take the component of
    their fingerprint. An empty table gives an empty result. Other columns of
    the input are not read, whatever their names."""
    scratch = Scratch(docs.sparkSession, "simhash")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fps = with_fingerprint(narrow, "text", "fp", shingle).select("doc_id", "fp")
    rows = scratch.write(fps, "fingerprints")
    comps = fingerprint_components(rows, scratch, max_bits, segments).select("fp", "component_id")
    return rows.join(comps, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 3, max_bits: int = 2, segments: int = 5) -> DataFrame:
    """The rows of ``docs``, one per near-duplicate group, all columns kept.

    The row with the smallest id stays (rows without an id only when no row of
    the group has one); of several rows with that id and fingerprint, one. Extra
    columns keep their values whatever their names."""
    scratch = Scratch(docs.sparkSession, "simhash-drop")
    like, docs, id_col, text_col = docs, sheltered(docs), place(docs, id_col), place(docs, text_col)
    kept = scratch.write(with_fingerprint(docs, text_col, "_simhash_fp", shingle), "documents")
    rows = kept.select(F.col(id_col).alias("doc_id"), F.col("_simhash_fp").alias("fp"))
    comps = scratch.write(fingerprint_components(rows, scratch, max_bits, segments), "components")
    # The representative: smallest id, then smallest fingerprint (two rows may
    # share an id); rows without an id come last.
    best = comps.groupBy("root").agg(F.min(F.struct(
        F.col("first_id").isNull().alias("no_id"), "first_id", "fp")).alias("b"))
    keys = best.select(F.col("b.first_id").alias("_simhash_id"), F.col("b.fp").alias("_simhash_key"))
    hit = kept.join(keys.hint("merge"), (F.col("_simhash_fp") == F.col("_simhash_key"))
                    & F.col(id_col).eqNullSafe(F.col("_simhash_id")))
    once = Window.partitionBy("_simhash_fp", id_col).orderBy("_simhash_fp")
    return restored(hit.withColumn("_simhash_n", F.row_number().over(once)).filter("_simhash_n = 1"), like)
