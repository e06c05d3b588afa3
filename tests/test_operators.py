"""Order-dependent helpers against brute force, and hand-made edge cases."""

import hashlib
import json
import random
import struct

from pyspark.sql import functions as F

from provlake.functions.numbers import micros, parse_int, percent_decrease
from provlake.operators import logs as L
from provlake.operators import ordered as O
from provlake.operators import privacy as P
from provlake.operators import verification as X
from provlake.operators.skew import context_join
from provlake.sources.headers import tensor_header_ingest
from provlake.streaming import jobs as J


def skewed(spark, n=3000):
    """A third of all rows in one group."""
    rnd = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", i, rnd.randrange(1000)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, pos bigint, v bigint").repartition(6)


def groups(rows):
    out = {}
    for g, p, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((p, v))
    return out


def test_dense_positions(spark):
    rows, df = skewed(spark)
    got = {(r.g, r.pos): r.position for r in O.dense_positions(df, "g", ["pos"]).collect()}
    assert got == {(g, p): i + 1 for g, ps in groups(rows).items() for i, (p, _) in enumerate(ps)}


def test_first_rows(spark):
    rows, df = skewed(spark)
    got = {(r.g, r.pos) for r in O.first_rows(df, "g", "pos", 17, chunk_rows=40).collect()}
    assert got == {(g, p) for g, ps in groups(rows).items() for p, _ in ps[:17]}


def test_chunked_lag(spark):
    rows, df = skewed(spark)
    got = {(r.g, r.pos): r.prev.v if r.prev else None
           for r in O.chunked_lag(df, ["g"], F.floor(F.col("pos") / 25), ["pos"], ["v"]).collect()}
    assert got == {(g, p): (ps[i - 1][1] if i else None) for g, ps in groups(rows).items() for i, (p, _) in enumerate(ps)}


def test_step_order_across_chunks(spark):
    rows = [(1, i, 0, i) for i in range(100)] + [(2, i, 0, i if i != 40 else 5) for i in range(100)] + [(3, 7, 0, 1)]
    got = {r.run: (r.first_step, r.last_step, r.n_steps, r.ordered)
           for r in L.step_order(spark.createDataFrame(rows, "run bigint, line_no bigint, idx int, step bigint"), chunk_rows=10).collect()}
    assert got == {1: (0, 99, 100, True), 2: (0, 99, 100, False), 3: (1, 1, 1, True)}


def test_context_join_splits_hot_keys(spark):
    rows, df = skewed(spark)
    ctx = df.groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    out = context_join(df.withColumn("id", F.col("pos").cast("string")), ctx, "g", "n", "id", rows_per_salt=100)
    assert out.count() == len(rows) and out.where("top < v OR top IS NULL").count() == 0


def values(spark, c, xs):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i").select(c(F.col("x"))).collect()]


def test_numbers(spark):
    assert values(spark, parse_int, ["1_000", "1,000", "3.0", "-7", "3.5", "", "12345678901234567890", "'8'"]) == [1000, 1000, 3, -7, None, None, None, 8]
    assert values(spark, micros, ["0.5", "-1.9999999", "1e-3", ".5", "x", "9e99"]) == [500000, -1999999, 1000, 500000, None, None]
    assert values(spark, lambda x: percent_decrease(F.lit("2.0"), x), ["1.0", "3.0", "1.999"]) == [50, -50, 0]
    assert values(spark, lambda x: percent_decrease(F.lit("0"), x), ["1.0"]) == [None]


def test_scrub(spark):
    cases = {
        "a@b.com.": "[REDACTED:email].", "me@host": "me@host", "x" + "AKIA" + "A" * 16: "x" + "AKIA" + "A" * 16,
        "AKIA" + "A" * 16 + " AKIA" + "B" * 16: "[REDACTED:aws-access-key-id] [REDACTED:aws-access-key-id]",
        "C:\\Program Files\\x.bin next": "[OUT-OF-SCOPE-PATH] next", "C:\\a@b.com\\x": "[OUT-OF-SCOPE-PATH]",
        "-----BEGIN PRIVATE KEY-----\nabc": "[REDACTED:private-key-block]", "-----BEGIN CERTIFICATE-----\nabc": "-----BEGIN CERTIFICATE-----\nabc",
        "é@x.org": "é@x.org", "sk-" + "a" * 30 + "-eyJabcd.efgh.ijkl": "[REDACTED:api-key].efgh.ijkl",
    }
    got = values(spark, P.scrub_text, list(cases))
    assert got == list(cases.values())
    assert values(spark, P.scrub_text, got) == got  # a second pass changes nothing


def test_whole_long_text_is_scrubbed(spark):
    body = "word " * 40_000
    assert values(spark, P.scrub_text, [body + "a@b.org"]) == [body + "[REDACTED:email]"]


def test_language(spark):
    assert values(spark, P.forbidden_language, ["vendor-supplied", "He LIED; fraud", "authentication", "is 99% sure", "scam_x"]) == [None, "lied", None, "99%", None]
    assert values(spark, P.forbidden_language, [X.STATEMENT] + list(X.FAMILY_TEXT.values()) + list(X.BAND_TEXT.values())) == [None] * (1 + len(X.FAMILY_TEXT) + len(X.BAND_TEXT))


def test_canary_round_trip(spark):
    df = spark.range(-60, 60).select("id", *[X.strip_canary(X.render_with_canary(F.col("id"), F.lit(d))).alias(f"d{d}") for d in range(10)])
    for r in df.collect():
        # minus zero tenths cannot be told from zero, and is never rendered
        assert all(r[f"d{d}"] == r.id for d in range(10))


def test_canary_digits_are_those_of_the_digests_taken_once(spark):
    def wanted(i):
        seed = hashlib.sha256(bytes.fromhex(hashlib.sha256(str(i).encode()).hexdigest()) + f"case-{i}n{i % 97}".encode()).digest()
        more = hashlib.sha256(b"CL-CANARY-BLOCK" + seed + bytes([0, 0, 0, 1])).digest()
        return [b % 10 for b in seed + more if b < 250]

    ids = spark.range(300).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hex"), F.concat(F.lit("case-"), "id").alias("text"),
                                  F.concat(F.lit("n"), F.col("id") % 97).alias("nonce"))
    df = ids.select("id", *[X.canary_digits(F.col("hex"), F.col("text"), F.col("nonce"), n).alias(f"d{n}") for n in (6, 32)])
    assert all(r.d6 == wanted(r.id)[:6] and r.d32 == wanted(r.id)[:32] for r in df.collect())
    assert ids.select(X.canary_digits(F.lit(None).cast("string"), F.col("text"), F.col("nonce")).alias("d")).first().d is None
    # the seed and its expansion: no digest stands in what runs per byte
    plan = ids.select(X.canary_digits(F.col("hex"), F.col("text"), F.col("nonce")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.splitlines()[0].count("sha2(") == 2


def container(path, header: bytes, body: int = 24, length=None):
    path.write_bytes(struct.pack("<Q", len(header) if length is None else length) + header + b"\0" * body)
    return str(path)


def test_header_ingest_reads_headers_only(spark, tmp_path):
    good = json.dumps({"a": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    files = [(1, "good", container(tmp_path / "good", good)), (1, "long", container(tmp_path / "long", good, length=10**6)),
             (1, "huge", container(tmp_path / "huge", good, length=2**63 + 5)), (1, "text", container(tmp_path / "text", b"\xff\xfe")),
             (1, "gone", str(tmp_path / "gone"))]
    (tmp_path / "short").write_bytes(b"abc")
    files.append((1, "short", str(tmp_path / "short")))
    got = {r.artifact: r for r in tensor_header_ingest(spark.createDataFrame(files, "case_id bigint, artifact string, path string")).collect()}
    assert got["good"].header_json == good.decode() and got["good"].note is None and got["good"].header_bytes == len(good)
    assert all(got[k].note for k in ("long", "huge", "text", "gone", "short"))


def test_stream_equals_batch_for_any_split_of_files(spark, tmp_path):
    rows = [(r, i, (i if r % 2 else (i * 7) % 11), f"{i}.5") for i in range(60) for r in (1, 2, 3)]
    schema = "run bigint, line_no bigint, step bigint, loss string"
    # later lines arrive in earlier files, and one line of a run long after its neighbours
    for part in ([r for r in rows if r[1] >= 30], [r for r in rows if r[1] < 30 and r[1] != 17], [r for r in rows if r[1] == 17]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = sorted(map(str, L.metric_series(spark.createDataFrame(rows, schema)).collect()))
    assert sorted(map(str, J.series_state(stream).collect())) == want
    (tmp_path / "empty").mkdir()
    assert J.series_state(spark.readStream.schema(schema).parquet(str(tmp_path / "empty"))).count() == 0


def test_streams_run_to_their_end(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "a", "mail x@y.org now") for h in range(4) for m in (5, 50)]
    for i in range(4):
        spark.createDataFrame(rows[2 * i:2 * i + 2], "ts string, case_id string, text string").selectExpr("CAST(ts AS timestamp) AS ts", "case_id", "text") \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, case_id string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = J.run_to_end(J.redaction_windows, stream, "ledger-test").collect()
    assert len(got) == 4 and sum(r.redactions for r in got) == 8


def test_pairs_below_any_depth_are_skipped(spark):
    deep = '{"step":5,"m":{"loss":9,"a":{"b":{"c":{"d":{"e":{"loss":8}}}}}},"loss":1.5}'
    many = " ".join(f"k{i}={i}" for i in range(300))
    df = spark.createDataFrame([(1, 1, deep), (2, 1, many), (3, 1, "key=" + "v" * 2000)], "run bigint, line_no bigint, line string")
    got = [(r.run, r.key, r.value) for r in L.log_pairs(df).orderBy("run", "pair_no").collect()]
    assert [g for g in got if g[0] == 1] == [(1, "step", "5"), (1, "loss", "1.5")]
    assert sum(g[0] == 2 for g in got) == 300 and got[-1] == (3, "key", "v" * 2000)


def test_roots_that_differ_by_a_slash_are_one(spark):
    from provlake.sources import inventory as I

    roots = spark.createDataFrame([(1, 1, "/data/en"), (1, 2, "/data/en/"), (1, 3, "/data/en/x"), (1, 4, "/data/e")], "case_id bigint, root_no bigint, root string")
    assert sorted((r.root_no, r.root) for r in I.distinct_roots(roots).collect()) == [(1, "/data/en"), (4, "/data/e")]


def test_a_window_needs_no_python_worker(spark, sf):
    from provlake.checks.registry import QUERIES
    plan = QUERIES["conclusions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_series_of_sparse_runs_is_merged_over_chunks_and_blocks(spark):
    """Runs of sparse line numbers over many chunks and blocks, lines with no step and with several, against a plain loop."""
    rnd = random.Random(8)
    rows, want = [], {}
    for run in range(12):
        at, step, steps = 0, 0, []
        for _ in range(rnd.randrange(1, 60)):
            at += rnd.choice([1, 1, 7, 40])
            step += rnd.choice([0, 1, 5]) if run % 2 else rnd.choice([-1, 1, 5])
            mine = [step + i for i in range(rnd.choice([0, 1, 1, 3]))]
            steps += mine
            step = mine[-1] if mine else step
            rows += [(run, at, i, s) for i, s in enumerate(mine)]
        if steps:
            want[run] = (steps[0], steps[-1], len(steps), all(a <= b for a, b in zip(steps, steps[1:])))
    df = spark.createDataFrame(rows, "run bigint, line_no bigint, idx int, step bigint")
    got = {r.run: (r.first_step, r.last_step, r.n_steps, r.ordered) for r in L.step_order(df, chunk_rows=3).collect()}
    assert got == want and {w[3] for w in want.values()} == {True, False}
    entries = df.groupBy("run", "line_no").agg(F.expr("transform(array_sort(collect_list(struct(idx, step))), x -> x.step)").alias("steps"))
    out = L.series_summary(entries.select("run", "line_no", F.lit(True).alias("is_entry"), "steps", F.array().cast("array<string>").alias("losses")))
    assert {r.run: (r.first_step, r.last_step, r.steps_monotonic) for r in out.collect()} == {
        k: (a, b, ok if n > 1 else None) for k, (a, b, n, ok) in want.items()}


def test_a_rule_family_reads_the_kinds_it_speaks_about_only():
    from provlake import vocab as V
    from provlake.plans import rules
    from provlake.plans.caseflags import kinds_read

    assert kinds_read(rules.binding()) == ["artifact_reference", "container_manifest"]
    assert set(kinds_read(rules.lora())) == {"adapter_config", "adapter_tensor_set", "merge_record", "serving_config", "trainable_parameter_record"}
    assert kinds_read(rules.scope()) == [] and kinds_read(["n_facts > 0"]) == sorted(V.FACT_KINDS)
    assert "checkpoint_step" in kinds_read(rules.scratch()) and kinds_read(["step_min = 0"]) == ["checkpoint_step"]
