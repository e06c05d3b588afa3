"""Structured Streaming forms of the redaction and trace summaries (``series`` holds that of metric series).

A job summarises one batch of rows; ``follow`` appends the summaries of all new batches to a folder, one partition per
batch, written anew if a batch is repeated.  Summaries of one window or session may come from several batches, so they are merged when
they are read: rows that arrive hours late count like all others, no window is ever closed, and no state is held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlake.operators.privacy import ledger_name, matches, span_kind
from provlake.operators.retrieval import full_chain
from provlake.session import work_dir
from provlake.streaming.series import series_state  # noqa: F401


def stream_table(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table of a folder as a stream, be it one file or a folder of files; its schema is that of the files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    # a stream refuses the path of a single file, but takes a pattern that only this file or folder matches
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{directory}/{name}.parque[t]")


def follow(job: Callable[[DataFrame], DataFrame], rows: DataFrame, where: str) -> None:
    """Append ``job``'s summaries of what is new in the stream ``rows``; called again, it goes on where it ended."""
    def take(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{where}/parts/batch={number}")

    q = rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def kept_parts(spark: SparkSession, where: str, schema: str | None = None) -> DataFrame:
    """All summaries under ``where``; ``schema`` is that of a folder that no batch has reached yet."""
    try:
        return spark.read.parquet(f"{where}/parts").drop("batch")
    except AnalysisException as e:  # a stream without any file writes none
        if e.getCondition() != "PATH_NOT_FOUND" or schema is None:
            raise
        return spark.createDataFrame([], schema)


# --- hourly redaction ledger ---------------------------------------------------------
LEDGER_PART = "window_start timestamp, case_id string, kind string, redactions bigint"


def redaction_windows(texts: DataFrame, width: str = "1 hour") -> DataFrame:
    """``texts``: (ts, case_id, text) -> counts per window, case and kind."""
    kinds = texts.select("ts", "case_id", F.explode(F.transform(matches(F.col("text")), span_kind)).alias("k"))
    return (kinds.groupBy(F.window("ts", width).alias("w"), "case_id", ledger_name(F.col("k")).alias("kind"))
            .agg(F.count("*").alias("redactions"))
            .select(F.col("w.start").alias("window_start"), "case_id", "kind", "redactions"))


def merged_ledger(parts: DataFrame) -> DataFrame:
    return parts.groupBy("window_start", "case_id", "kind").agg(F.sum("redactions").alias("redactions"))


# --- trace sessions ----------------------------------------------------------------------
GAP_MINUTES = 30
SESSION_PART = "file string, first_at timestamp, last_at timestamp, requests bigint, all_full_chain boolean"


def chained(rows: DataFrame, start: str, end: str, gap_minutes: int) -> DataFrame:
    """Number (``no``) the sessions of each file: a row belongs to the one before if it starts less than the gap after all before have ended."""
    order = Window.partitionBy("file").orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(F.unix_micros(start) - F.unix_micros(reach) >= gap_minutes * 60_000_000, F.lit(True))
    return rows.withColumn("cut", cut.cast("int")).withColumn("no", F.sum("cut").over(order))


def chain_sessions(lines: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """``lines``: (ts, file, line) -> sessions of these rows, and whether every request was a full chain."""
    v = F.try_parse_json("line")
    marked = lines.withColumn("full_chain", F.coalesce(full_chain(F.col("line"), v), F.lit(False)))
    return (marked.groupBy(F.session_window("ts", f"{gap_minutes} minutes").alias("s"), "file")
            .agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("requests"), F.min("full_chain").alias("all_full_chain"))
            .select("file", "first_at", "last_at", "requests", "all_full_chain"))


def merged_sessions(parts: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Sessions of all rows.  Between two rows of a part there is less than a gap, so parts that touch or overlap are one session."""
    end = F.max("last_at") + F.expr(f"INTERVAL {gap_minutes} MINUTES")
    return (chained(parts, "first_at", "last_at", gap_minutes).groupBy("file", "no")
            .agg(F.min("first_at").alias("session_start"), end.alias("session_end"), F.sum("requests").alias("requests"),
                 F.min("all_full_chain").alias("all_full_chain")).drop("no"))


MERGED = {redaction_windows: (merged_ledger, LEDGER_PART), chain_sessions: (merged_sessions, SESSION_PART)}


def run_to_end(job: Callable[[DataFrame], DataFrame], rows: DataFrame, name: str) -> DataFrame:
    """The merged result of ``job`` over everything that is in the stream now."""
    where = work_dir(rows.sparkSession, name)
    follow(job, rows, where)
    merge, schema = MERGED[job]
    return merge(kept_parts(rows.sparkSession, where, schema))
