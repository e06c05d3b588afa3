"""Metric series of runs kept up to date by a stream.

Every batch appends one summary per (run, chunk of line numbers): the range of lines, first and last step, how many, whether
they never fell, and the first and last loss.  Lines before and after the range that earlier batches have seen make a summary each, so the ranges of
a chunk never overlap and are merged when they are read.  A line inside the range seen is late: its neighbours are gone, so it is written
out as late instead, and the series of its chunk is taken from the source when it is asked for.  What is kept grows with
runs, chunks and the batches that touch them, not with lines, and any split and order of files gives the batch result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlake.functions.numbers import micros
from provlake.operators.logs import LINES_PER_CHUNK, chunk_summaries, merged, metric_series, series_of_chunks
from provlake.session import work_dir

SUMMARY = ["low", "high", "entries", "n_steps", "first_step", "last_step", "ordered", "first_loss", "last_loss"]
PART = ("chunk bigint, low bigint, high bigint, entries bigint, n_steps bigint, first_step bigint, last_step bigint, "
        "ordered boolean, first_loss string, last_loss string, taken_at timestamp, batch bigint")


def usable(metrics: DataFrame) -> DataFrame:
    """(run, line_no, step, loss) with only the losses that are numbers."""
    return metrics.select("run", F.col("line_no").cast("bigint").alias("line_no"), F.col("step").cast("bigint").alias("step"),
                          F.when(micros(F.col("loss")).isNotNull(), F.col("loss")).alias("loss"))


def with_chunk(metrics: DataFrame, chunk_rows: int) -> DataFrame:
    return usable(metrics).withColumn("chunk", F.floor(F.col("line_no") / chunk_rows))


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the batches have written to a folder, which need not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _summaries(spark: SparkSession, where: str, like: DataFrame) -> DataFrame:
    return _parts(spark, f"{where}/summaries", f"run {dict(like.dtypes)['run']}, {PART}")


def _same_chunk(other: str) -> Column:
    return F.expr(f"l.run <=> {other}.run AND l.chunk <=> {other}.chunk")


def follow_series(metrics: DataFrame, where: str, chunk_rows: int = LINES_PER_CHUNK, ttl_ms: int | None = None) -> None:
    """Take what is new in the stream ``metrics`` (run, line_no, step, loss) into the series kept under ``where``.

    May be called again, by any session, to go on where the last call ended; a batch that is repeated is written anew.  With ``ttl_ms`` a
    batch does not look at ranges written longer ago; where its own overlap them, the chunk is then read from the source.
    """
    spark = metrics.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        lines = with_chunk(batch, chunk_rows)
        seen = _summaries(spark, where, lines).where(F.col("batch") < number)
        if ttl_ms is not None:
            seen = seen.where(F.unix_millis(F.current_timestamp()) - F.unix_millis("taken_at") <= ttl_ms)
        first = number == 0 or seen.isEmpty()
        if first:
            marked = lines.withColumn("place", F.lit("after"))
        else:
            ranges = seen.groupBy("run", "chunk").agg(F.min("low").alias("low"), F.max("high").alias("high")).alias("r")
            place = F.when(F.expr("l.line_no < r.low"), "before").when(F.expr("l.line_no <= r.high"), "late").otherwise("after")
            marked = lines.alias("l").join(ranges, _same_chunk("r"), "left").select("l.*", place.alias("place")).persist()
            marked.where("place = 'late'").select("run", "line_no", "chunk").write.mode("overwrite").parquet(f"{where}/late/batch={number}")
        parts = chunk_summaries(marked.where("place <> 'late'"), "place").select("run", "chunk", *SUMMARY, F.current_timestamp().alias("taken_at"))
        parts.write.mode("overwrite").parquet(f"{where}/summaries/batch={number}")
        if not first:
            marked.unpersist()

    q = metrics.writeStream.foreachBatch(take).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def series_state(metrics: DataFrame, name: str = "series") -> DataFrame:
    """Series of a stream that has no table behind it: its lines are kept in one, which the series then follows."""
    spark = metrics.sparkSession
    where = work_dir(spark, name)
    keep_lines(metrics, where)
    schema = metrics.schema
    try:
        lines = spark.read.schema(schema).parquet(f"{where}/lines")
    except AnalysisException as e:  # a stream without any file writes no table
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return metric_series(spark.createDataFrame([], schema))
    follow_series(spark.readStream.schema(schema).parquet(f"{where}/lines"), where)
    return read_series(lines, where)


def keep_lines(metrics: DataFrame, where: str) -> None:
    q = (metrics.writeStream.format("parquet").outputMode("append").option("path", f"{where}/lines")
         .option("checkpointLocation", f"{where}/taken").trigger(availableNow=True).start())
    q.awaitTermination()


def late_lines(spark: SparkSession, where: str, like: DataFrame) -> DataFrame:
    """(run, line_no) of all lines that came after lines around them had been summed up."""
    return _late(spark, where, like).select("run", "line_no")


def _late(spark: SparkSession, where: str, like: DataFrame) -> DataFrame:
    return _parts(spark, f"{where}/late", f"run {dict(like.dtypes)['run']}, line_no bigint, chunk bigint")


def kept_summaries(spark: SparkSession, where: str, like: DataFrame) -> DataFrame:
    """The summary of every (run, chunk), and whether it must be taken from the source instead: a line was late, or ranges overlap."""
    earlier = Window.partitionBy("run", "chunk").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    parts = _summaries(spark, where, like)
    parts = parts.withColumn("overlaps", F.coalesce(F.col("low") <= F.max("high").over(earlier), F.lit(False)))
    chunks = merged(parts, ["run", "chunk"], F.col("low"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("overlaps").alias("overlaps"))
    late = _late(spark, where, like).select("run", "chunk").distinct().select("run", "chunk", F.lit(True).alias("is_late")).alias("t")
    return (chunks.alias("l").join(late, _same_chunk("t"), "left")
            .select("l.run", "l.chunk", *SUMMARY, F.coalesce("is_late", "overlaps").alias("broken")))


def read_series(source: DataFrame, where: str, chunk_rows: int = LINES_PER_CHUNK) -> DataFrame:
    """Series of every run from the summaries under ``where``; ``source``, the table behind the stream, is read for chunks with late lines only."""
    kept = kept_summaries(source.sparkSession, where, source)
    broken = kept.where("broken").select("run", "chunk").alias("b")
    again = chunk_summaries(with_chunk(source, chunk_rows).alias("l").join(broken, _same_chunk("b"), "left_semi"))
    return series_of_chunks(kept.where("NOT broken").drop("broken").unionByName(again))
