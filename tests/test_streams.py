"""Streams: any split, order and lateness of the input gives the batch result, over several runs of a query."""

import random

import pytest
from pyspark.sql import functions as F

from provlake.operators.logs import metric_series
from provlake.streaming import jobs, series

SCHEMA = "run string, line_no long, step long, loss string"


def metric_rows():
    rnd = random.Random(2)
    rows = []
    for run, fall in (("up", 0), ("down", 1), ("gaps", 2)):
        for n in range(300):
            step = n * 10 if not fall or n != 250 else 5
            rows.append((run, n * 7, None if fall == 2 and n % 3 else step, rnd.choice(["1.5", "2.25", "none", None, "0.5"])))
    return rows + [("one", 3, 9, None), ("bare", 4, None, "x")]


def ordered(rows):
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("order", ["shuffled", "newest first"])
def test_series_over_three_batches_with_a_restart(spark, tmp_path, order):
    rows = metric_rows()
    if order == "shuffled":
        random.Random(1).shuffle(rows)
    else:
        rows = rows[::-1]
    source, where = str(tmp_path / "lines"), str(tmp_path / "kept")
    for k in range(3):
        part = rows[k * len(rows) // 3:(k + 1) * len(rows) // 3]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        series.follow_series(spark.readStream.schema(SCHEMA).parquet(source), where, chunk_rows=256)
    got = series.read_series(spark.read.schema(SCHEMA).parquet(source), where, chunk_rows=256)
    want = metric_series(spark.createDataFrame(rows, SCHEMA))
    assert ordered(got.select(*want.columns).collect()) == ordered(want.collect())
    late = series.late_lines(spark, where, spark.read.schema(SCHEMA).parquet(source)).count()
    assert (late > 0) == (order == "shuffled")
    kept = series.kept_summaries(spark, where, spark.read.schema(SCHEMA).parquet(source))
    assert kept.count() == len({(r[0], r[1] // 256) for r in rows})


def test_an_expired_state_is_read_from_the_source(spark, tmp_path):
    import time

    source, where = str(tmp_path / "lines"), str(tmp_path / "kept")
    rows = [("a", n, n, "1.0") for n in range(20)]
    for part in (rows[10:], rows[:10]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        series.follow_series(spark.readStream.schema(SCHEMA).parquet(source), where, ttl_ms=1000)
        time.sleep(2)
    got = series.read_series(spark.read.schema(SCHEMA).parquet(source), where)
    assert [(r.entry_count, r.first_step, r.last_step, r.steps_monotonic) for r in got.collect()] == [(20, 0, 19, True)]


TEXTS = "ts timestamp, case_id string, text string"


def test_late_texts_are_counted(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02}:{m:02}:00", f"c{m % 2}", "mail a@bc.de and sk-" + "a1" * 12) for h in (5, 1, 3) for m in (0, 20, 40)]
    source, where = str(tmp_path / "texts"), str(tmp_path / "kept")
    frame = lambda part: spark.createDataFrame(part, "ts string, case_id string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):  # hours 5, 1 and 3: the later two arrive hours late
        frame(rows[3 * k:3 * k + 3]).coalesce(1).write.mode("append").parquet(source)
        jobs.follow(jobs.redaction_windows, spark.readStream.schema(TEXTS).parquet(source), where)
    got = {(r.window_start.hour, r.case_id, r.kind): r.redactions for r in jobs.merged_ledger(jobs.kept_parts(spark, where)).collect()}
    want = {}
    for ts, case, _ in rows:
        for kind in ("email_address", "credential"):
            key = int(ts[11:13]), case, kind
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_sessions_that_late_rows_join(spark, tmp_path):
    full, bare = '{"query": "q", "retrieved": [{"text": "t", "score": 1}]}', '{"query": "q", "retrieved": [{"text": "t"}]}'
    minutes = [[0, 20, 120], [200, 45, 215], [65, 90, 400]]  # the third batch joins 0 and 20 with 45, which came later
    source, where = str(tmp_path / "lines"), str(tmp_path / "kept")
    schema = "ts timestamp, file string, line string"
    for part in minutes:
        rows = [(1704067200 + m * 60, "f", bare if m == 400 else full) for m in part]
        (spark.createDataFrame(rows, "s long, file string, line string").select(F.timestamp_seconds("s").alias("ts"), "file", "line")
         .coalesce(1).write.mode("append").parquet(source))
        jobs.follow(jobs.chain_sessions, spark.readStream.schema(schema).parquet(source), where)
    got = [((r.session_start.hour * 60 + r.session_start.minute), (r.session_end.hour * 60 + r.session_end.minute), r.requests, r.all_full_chain)
           for r in jobs.merged_sessions(jobs.kept_parts(spark, where)).orderBy("session_start").collect()]
    assert got == [(0, 120, 5, True), (120, 150, 1, True), (200, 245, 2, True), (400, 430, 1, False)]


@pytest.mark.parametrize("name", ["stream_redaction_ledger", "stream_chain_sessions"])
def test_a_table_in_several_files_is_streamed_whole(spark, sf, tmp_path, name):
    """A table may be one file or a folder of part files; the folder gave no rows."""
    import __spark_entry__ as entry

    for table in ("documents", "conversations"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    assert jobs.stream_table(spark, str(tmp_path), "documents").isStreaming
    got, want = (entry.queries()[name](spark, d) for d in (str(tmp_path), sf))
    assert ordered(got.collect()) == ordered(want.collect()) != []


def test_the_ledger_counts_private_spans_that_documents_hold_themselves(spark, tmp_path):
    """The SQL counted planted spans and e-mails only."""
    import duckdb

    import __spark_entry__ as entry
    import oracle

    jwt, key = "eyJhbGci.eyJzdWIi.c2lnbmF0", "-----BEGIN EC PRIVATE KEY-----\nab@cd.de\n"
    texts = ["key AKIA" + "Z9" * 8 + " sk-" + "b" * 20 + ",ghp_" + "c" * 30, f"{jwt} {jwt} {jwt}. x{jwt}", "see C:\\a b\\c d E:/f, http://x/y \\\\s\\t ab: c",
             key + "-----END EC PRIVATE KEY-----\nx@y.de", key + "no end C:/x", "m@a.de n@b.co.uk,sk-" + "d" * 20 + "@e.org xAKIA" + "Q" * 16, "", None]
    rows = [(22 * i + k, text, "en", f"s{i % 2}") for i, text in enumerate(texts) for k in (9, 10, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "stream_redaction_ledger"
    assert oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) == ""


def test_a_series_is_summed_up_without_python_state_per_chunk(spark, tmp_path):
    """A Python call per (run, chunk) does not end in time on the 2 million chunks of 1 GB; rows around a known range make two summaries."""
    source, where = str(tmp_path / "lines"), str(tmp_path / "kept")
    for part in ([("a", 10, 10, "2.0"), ("a", 20, 20, "x"), (None, 1, 5, "1")], [("a", 1, 1, "4.0"), ("a", 30, 2, "1.0"), (None, 2, 6, "2")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        series.follow_series(spark.readStream.schema(SCHEMA).parquet(source), where)
    assert not (tmp_path / "kept" / "state" / "state").exists()
    assert spark.read.parquet(f"{where}/summaries").where("run = 'a'").count() == 3
    lines = spark.read.schema(SCHEMA).parquet(source)
    assert series.late_lines(spark, where, lines).count() == 0
    assert ordered(series.read_series(lines, where).collect()) == ordered(metric_series(lines).collect())
