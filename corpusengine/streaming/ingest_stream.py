"""Incremental ingestion with Structured Streaming.

Landed files are read with the file source; each micro-batch drops filings
already in the manifest (stream-static anti join, so no unbounded operator
state), chunks them and appends to a Parquet sink. ``availableNow`` processes
whatever has landed and stops; the checkpoint makes a re-run a no-op and lets
late files be picked up by the next run. Chunk ids are deterministic, so a
replayed batch rewrites the same rows; the corpus merge afterwards (K3) is
idempotent as well.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ..config import IngestConfig
from ..functions.chunking import chunk_fixed, chunk_id
from ..operators.filings import drop_seen


def chunk_stream(
    spark: SparkSession,
    landing_dir: str,
    schema: StructType | str,
    sink_dir: str,
    checkpoint_dir: str,
    key_cols: tuple[str, ...],
    text_col: str = "text",
    seen: DataFrame | None = None,
    seen_col: str = "accessionNumber",
    cfg: IngestConfig = IngestConfig(),
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Run one availableNow pass of the chunking stream; return the sink."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(landing_dir)
    if seen is not None:
        src = drop_seen(src, seen, seen_col)
    chunks = chunk_fixed(src.select(*key_cols, text_col), text_col, cfg.chunk_size, cfg.chunk_overlap)
    out = chunks.withColumn("chunk_id", chunk_id(*[F.col(c) for c in key_cols], F.col("chunk_ix")))
    q = (
        out.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(sink_dir)


def index_stream(
    spark: SparkSession,
    daily_index_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    forms=None,
) -> DataFrame:
    """Parse every landed daily index file (one row per file with
    ``wholetext``) into filing rows and append them to a Parquet table.

    Each run processes only files that landed since the last run (the file
    source keeps the list in the checkpoint), so days that arrive late are
    picked up by the next run and re-runs add nothing."""
    from ..config import DAILY_FORMS
    from ..operators.filings import filter_forms, parse_master_index

    files = (
        spark.readStream.format("text").option("wholetext", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "master.*.idx")
        .load(daily_index_dir)
        .select(
            F.regexp_extract(F.col("_metadata.file_name"), r"master\.([0-9]{8})\.idx", 1).alias("_d"),
            F.col("_metadata.file_name").alias("_name"),
            F.col("value").alias("text"),
        )
        .select(F.date_format(F.try_to_date("_d", "yyyyMMdd"), "yyyy-MM-dd").alias("file_date"), "_name", "text")
    )
    # A file whose name holds no date keeps its rows, with the name as error.
    files = files.select("file_date", F.when(F.col("file_date").isNull(), F.concat(F.lit("error:bad index name "), F.col("_name")))
                         .alias("error"), "text")
    rows = filter_forms(parse_master_index(files), forms or DAILY_FORMS)
    q = (
        rows.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(sink_dir)


def fresh_filings(
    spark: SparkSession,
    landing_dir: str,
    schema: StructType | str,
    sink_dir: str,
    checkpoint_dir: str,
    event_col: str = "filed_at",
    key: str = "accessionNumber",
    delay: str = "7 days",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """T5: one availableNow pass over landed filing rows that accepts a filing
    once, as long as it comes no later than ``delay`` behind the newest event time
    seen so far; returns the accepted rows of all passes.

    The keys seen are held as event-time state and dropped when the watermark has
    passed them, so the state follows the delay and not the history, and a restart
    goes on from the checkpoint. ``late_filings`` lists what came too late. Rows
    without a key are one key; rows without an event time are never late."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(landing_dir).withWatermark(event_col, delay).dropDuplicatesWithinWatermark([key])
    q = (
        rows.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(schema).parquet(sink_dir)


def late_filings(landed: DataFrame, accepted: DataFrame, key: str = "accessionNumber") -> DataFrame:
    """(key, reason) of the landed filings of which no row was accepted."""
    missed = landed.select(key).distinct().alias("l").join(
        accepted.select(key).alias("a"), F.col(f"l.{key}").eqNullSafe(F.col(f"a.{key}")), "left_anti")
    return missed.select(key, F.lit("late").alias("reason"))


ATTEMPT = "key string, newest timestamp, attempt string, micros bigint, failures bigint"


def _first_per_key(batches):
    """Per task and batch of rows one row a key: its first success and how many
    failures, so that a key with very many attempts sends few rows."""
    for rows in batches:
        if not len(rows):
            continue
        good = rows[rows["ok"]].sort_values(["micros", "attempt"]).drop_duplicates("key")
        first = {k: (a, m) for k, a, m in zip(good["key"], good["attempt"], good["micros"].tolist())}
        seen = rows.assign(failed=~rows["ok"]).groupby("key", as_index=False).agg(
            newest=("filed_at", "max"), failures=("failed", "sum"))
        seen["attempt"] = [first.get(k, (None, 0))[0] for k in seen["key"]]
        seen["micros"] = [first.get(k, (None, 0))[1] for k in seen["key"]]
        yield seen[["key", "newest", "attempt", "micros", "failures"]]


def _accept(keep_ms: int):
    """State of a key: accepted or not, and the failures before."""
    def run(key, chunks, state):
        if state.hasTimedOut:
            state.remove()
            return
        done, failures = state.get if state.exists else (False, 0)
        best, newest = None, 0
        for rows in chunks:
            newest = max(newest, int(rows["newest"].max().timestamp() * 1000))
            if not done:
                failures += int(rows["failures"].sum())
                found = [(m, a) for m, a in zip(rows["micros"].tolist(), rows["attempt"]) if isinstance(a, str)]
                best = min([*found, *([best] if best else [])], default=None)
        state.update((done or best is not None, failures))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_ms)
        if best:
            yield pd.DataFrame({"key": [key[0]], "attempt": [best[1]], "micros": [best[0]], "failures": [failures]})

    return run


def first_success(
    spark: SparkSession,
    landing_dir: str,
    schema: StructType | str,
    sink_dir: str,
    checkpoint_dir: str,
    ok: str,
    key: str = "accessionNumber",
    attempt: str = "attempt",
    event_col: str = "filed_at",
    delay: str = "7 days",
    keep_days: float = 30,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """One availableNow pass over landed ingestion attempts; returns the
    accepted attempt of every key so far: (key, attempt, filed_at, failures).

    ``ok`` is an SQL condition; a failed attempt (false or null) leaves the key
    open, so a later one may succeed. The first pass with a success accepts its
    earliest (event time, then ``attempt`` as text); ``failures`` counts the failed
    attempts that landed until then, those of that pass included. What a key has
    seen is state with a time limit, ``keep_days`` behind its newest attempt in
    event time; nothing written before is read again, and a restart goes on from
    the checkpoint. Attempts more than ``delay`` behind the newest event time of
    earlier passes are late: they are not accepted (``late_filings`` lists them).
    Rows without a key, an attempt or an event time are no attempts. Other columns
    are not read."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    at = F.col(event_col).cast("timestamp")
    rows = reader.parquet(landing_dir).select(
        F.col(key).cast("string").alias("key"), at.alias("filed_at"), F.col(attempt).cast("string").alias("attempt"),
        F.unix_micros(at).alias("micros"), F.coalesce(F.expr(ok), F.lit(False)).alias("ok"))
    rows = rows.where("key IS NOT NULL AND attempt IS NOT NULL AND filed_at IS NOT NULL")
    some = rows.mapInPandas(_first_per_key, ATTEMPT).withWatermark("newest", delay)
    out = some.groupBy("key").applyInPandasWithState(
        _accept(int(keep_days * 86_400_000)), "key string, attempt string, micros bigint, failures bigint",
        "done boolean, failures bigint", "append", GroupStateTimeout.EventTimeTimeout)
    q = (
        out.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    done = spark.read.schema("key string, attempt string, micros bigint, failures bigint").parquet(sink_dir)
    return done.select("key", "attempt", F.timestamp_micros("micros").alias("filed_at"), "failures")
