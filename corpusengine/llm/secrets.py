"""Secret scans with corpus-wide ownership, in SQL functions only.

A text is cut once per kind by ``split``; the pieces and the matches give every
span as a running sum of lengths (code points). The found candidates, a small
fraction of the text, are written once; then

* every secret's hash is aggregated by repository and owner
  (hash, owner, repository -> hash, owner -> hash, each with map-side combine);
* a hash held by ``min_owners`` owners or more is a widely copied *example*,
  else an owner-specific, *live*-looking credential;
* the candidates join that verdict. A hash copied into a third of all rows is
  join skew on a plain shuffle join, which adaptive execution splits.

Base kinds (``assign``, ``access``, ``hex``) are always reported. The other
kinds are looser; the method adds their spans only where they are live and lie
outside every base span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, place, restored, sheltered

MASK = "[SECRET]"


@dataclass(frozen=True)
class Kind:
    """One kind of candidate: matches of ``regex`` whose ``group`` has at least
    ``least`` characters and agrees with every expression in ``also``.
    ``hint`` is a cheap test that every text with a match passes."""

    name: str
    regex: str
    least: int
    group: int = 0
    hint: str | None = None
    also: tuple[str, ...] = ()
    base: bool = False


# The base kinds. In either case means A-Z and a-z only.
BASE_KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         12, 2, r"(?i)passw|secret|token|api_?key", base=True),
    Kind("access", r"AKIA[A-Z0-9]+", 18, 0, r"AKIA", base=True),
    # Whole runs only: a run is tried at its first character alone.
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 16, 0, r"[0-9a-f]{16}", base=True),
)
METHOD_KINDS = (
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0, r"-----BEGIN"),
    # Whole runs only, as for hex: a run is tried at its first character alone.
    Kind("jwt", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{11,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0, r"eyJ", (r"^eyJ",)),
    # Long runs that mix letters and digits.
    Kind("mixed", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 20, 0, r"[A-Za-z0-9+/_=-]{20}",
         (r"[0-9]", r"[A-Za-z]")),
)


def _candidates(text: Column, kind: Kind, order: int) -> Column:
    """All matches of one kind, in order: array of (k, kind, i, gap, len, value)."""
    rx = F.lit(kind.regex)
    hits = F.regexp_extract_all(text, rx, F.lit(0))
    values = F.regexp_extract_all(text, rx, F.lit(kind.group)) if kind.group else hits
    gaps = F.split(text, kind.regex, -1)
    # Zipped first, so that every array is made once and not per match; the gap
    # behind the last match has no hit.
    pairs = F.zip_with(hits, values, lambda h, v: F.struct(h.alias("h"), v.alias("v")))
    zipped = F.zip_with(pairs, gaps, lambda x, g: F.struct(x["h"].alias("h"), x["v"].alias("v"), g.alias("g")))
    made = F.transform(
        F.filter(zipped, lambda x: x["h"].isNotNull()),
        lambda x, i: F.struct(F.lit(order).alias("k"), F.lit(kind.name).alias("kind"), (i + 1).alias("i"),
                              F.length(x["g"]).alias("gap"), F.length(x["h"]).alias("len"), x["v"].alias("value")))
    none = F.array().cast("array<struct<k:int,kind:string,i:int,gap:int,len:int,value:string>>")
    some = text.rlike(kind.regex) if kind.hint is None else text.rlike(kind.hint) & text.rlike(kind.regex)
    return F.when(some, made).otherwise(none)


def scan(docs: DataFrame, text_col: str, kinds: tuple[Kind, ...]) -> DataFrame:
    """``docs`` plus ``_found`` (all candidates) and ``_uid`` (to be written)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[_candidates(text, k, n) for n, k in enumerate(kinds)])
    return docs.withColumn("_found", found).withColumn("_uid", F.monotonically_increasing_id())


def spans(scanned: DataFrame, kinds: tuple[Kind, ...], owner: str, repo: str, min_owners: int) -> DataFrame:
    """Per row with a candidate: ``_uid`` and ``found``, the reported spans by
    start and kind: array of (start, k, kind, end, base, owners, repos, live)."""
    flat = scanned.select("_uid", F.col(owner).alias("_owner"), F.col(repo).alias("_repo"),
                          F.explode("_found").alias("c")).select("_uid", "_owner", "_repo", "c.*")
    so_far = Window.partitionBy("_uid", "k").orderBy("i")
    flat = flat.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int"))
    ok = F.lit(False)
    for n, k in enumerate(kinds):
        good = F.length("value") >= k.least
        for pattern in k.also:
            good = good & F.col("value").rlike(pattern)
        ok = ok | ((F.col("k") == n) & good)
    found = flat.filter(ok).select(
        "_uid", "_owner", "_repo", (F.col("end") - F.col("len")).alias("start"), "k", "kind", "end",
        F.element_at(F.array(*[F.lit(k.base) for k in kinds]), F.col("k") + 1).alias("base"),
        F.sha2("value", 256).alias("hash"))
    owned = (found.select("hash", "_owner", "_repo").distinct()
             .groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("repos"))
             .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")))
    told = found.join(owned, "hash").withColumn("live", F.col("owners") < min_owners)
    per_row = told.groupBy("_uid").agg(F.sort_array(F.collect_list(F.struct(
        "start", "k", "kind", "end", "base", "owners", "repos", "live"))).alias("all"))
    base = F.filter("all", lambda x: x["base"])
    added = F.filter("all", lambda x: ~x["base"] & x["live"] & ~F.exists(
        base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return per_row.select("_uid", F.sort_array(F.concat(base, added)).alias("found"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str | None = None, min_owners: int = 3,
                 base: tuple[Kind, ...] = BASE_KINDS, method: tuple[Kind, ...] = METHOD_KINDS) -> DataFrame:
    """One row per input row: doc_id, n_<kind> for every base kind,
    base_sha256, spans, n_live and n_example (base and added spans by verdict).

    A document is its own repository unless ``repo_col`` names one. Null texts
    are empty; null owners are one owner. Repeated rows stay repeated (they
    count once for ownership). Empty tables give empty results; only the named
    columns are read."""
    scratch = Scratch(docs.sparkSession, "secrets")
    kinds = (*base, *method)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(owner_col).alias("_owner"),
                         F.col(repo_col or id_col).alias("_repo"), F.col(text_col).alias("_text"))
    rows = scratch.write(scan(narrow, "_text", kinds).drop("_text"), "candidates")
    found = spans(rows.filter(F.size("_found") > 0), kinds, "_owner", "_repo", min_owners)
    none = F.array().cast(found.schema["found"].dataType)
    out = rows.select("_uid", F.col("_id").alias("doc_id")).join(found, "_uid", "left").withColumn(
        "found", F.coalesce("found", none))
    own = F.filter("found", lambda x: x["base"])

    def count(test) -> Column:
        return F.size(F.filter("found", test)).cast("long")

    def of_kind(name: str) -> Column:
        return count(lambda x: x["kind"] == name).alias(f"n_{name}")

    return out.select(
        "doc_id", *[of_kind(k.name) for k in base],
        F.sha2(_listed(own), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_example"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                   length_col: str | None = "n_chars", min_owners: int = 3, mask: str = MASK,
                   base: tuple[Kind, ...] = BASE_KINDS, method: tuple[Kind, ...] = METHOD_KINDS) -> DataFrame:
    """All rows and columns of ``docs``; every reported span of the text is
    replaced by ``mask`` (overlapping spans by one) and ``length_col``, if it
    exists, counts the new text. Rows without a span are untouched; only rows
    with one are shuffled. Extra columns keep their values whatever their names."""
    like, docs = docs, sheltered(docs)
    id_col, text_col, owner_col = place(like, id_col), place(like, text_col), place(like, owner_col)
    length_col = place(like, length_col) if length_col in like.columns else None
    scratch = Scratch(docs.sparkSession, "redact")
    kinds = (*base, *method)
    rows = scratch.write(scan(docs, text_col, kinds), "documents")
    some = rows.filter(F.size("_found") > 0)
    found = scratch.write(spans(some, kinds, owner_col, id_col, min_owners), "spans")
    joined = some.join(found.withColumnRenamed("found", "_spans"), "_uid", "left")
    # Merge overlapping spans, then keep the text between them.
    step = "struct<out:array<string>,at:int>"
    text = F.col(text_col)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")).cast(step)
    pieces = F.aggregate(
        F.col("_spans"), start,
        lambda a, x: F.when(x["start"] >= a["at"], F.struct(
            F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask))).alias("out"),
            x["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    new = joined.withColumn(text_col, F.when(F.size("_spans") > 0, pieces).otherwise(text))
    if length_col is not None:
        kind = dict(docs.dtypes)[length_col]
        new = new.withColumn(length_col, F.when(F.size("_spans") > 0, F.length(text_col).cast(kind))
                             .otherwise(F.col(length_col)))
    return restored(rows.filter(F.size("_found") == 0), like).union(restored(new, like))
