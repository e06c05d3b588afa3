"""Checks of the streaming jobs (T) and of the header reader and sink."""

from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.checks import q_logs, q_privacy, views_logs  # noqa: F401
from provlake.checks.q_privacy import PLANTS
from provlake.checks.registry import ORACLES, QUERIES
from provlake.checks.sqlviews import pick, register, with_clause
from provlake.sources.headers import tensor_header_ingest
from provlake.sources.sink import read_evidence, staged, write_evidence
from provlake.streaming import jobs as J
from provlake.streaming.series import follow_series, read_series


def stream_query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; the stream reads the driver's own file."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_clause(sql)
        return fn
    return wrap


@stream_query("stream_series_state", q_logs.series_sql("o_metric"))
def stream_series_state(spark, sf_dir):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    metrics = lambda e: e.select(F.col("user_id").alias("run"), F.col("event_id").alias("line_no"),
                                 F.when(F.col("user_id") % 2 == 0, F.col("event_id")).otherwise(k).alias("step"),
                                 F.col("value").cast("decimal(18,6)").cast("string").alias("loss"))
    where = J.work_dir(spark, "series")
    follow_series(metrics(J.stream_table(spark, sf_dir, "events")), where)
    return read_series(metrics(spark.read.parquet(f"{sf_dir}/events.parquet")), where)


# A text counts with its planted part and with every private span of its own body, by the rule of ``operators.privacy.matches``: kinds are taken out
# in the order key block, path, e-mail, JWT, token, each by a pattern without look-around.
_PC, _JOIN = r"""[^"'<>|?*\n\r\t .,;)\]\x01]""", r"[.,;)\]\x01]+"
_NOT_WORD = "(?:^|[^A-Za-z0-9_])"
OWN_KEY = r"-----BEGIN[^\r\n]*?PRIVATE KEY[^\r\n]*?-----[\r\n](?s:.*?)(?:-----END(?s:.*?)-----\n|-----END|\z)"
OWN_PATH = (rf"(?:{_NOT_WORD}[A-Za-z]:[\\/](?:{_PC}|{_JOIN}{_PC})+"
            rf"|\\\\(?:{_JOIN}{_PC}|{_PC}(?:{_PC}|{_JOIN}{_PC}))(?:{_PC}|{_JOIN}{_PC})*)")
OWN_JWT = rf"{_NOT_WORD}eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{{4,}}\.[A-Za-z0-9_-]{{4,}}(?:[^A-Za-z0-9_.-]|$)"
OWN_TOKEN = _NOT_WORD + "(?:" + "|".join(
    f"{p}{'[A-Z0-9]' if p in V.UPPER_ONLY_TOKENS else '[A-Za-z0-9_-]'}{{{n},}}" for p, n, _ in V.TOKEN_SHAPES) + ")"
MAIL_AND_END = "([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[.][A-Za-z]{2,24})([.]*(?:[^A-Za-z0-9.-]|$))"
_count = lambda x, p: f"LEN(REGEXP_EXTRACT_ALL({x}, {q_logs.q(p)}))"
_without = lambda x, p, put="|": f"REGEXP_REPLACE({x}, {q_logs.q(p)}, {q_logs.q(put)}, 'g')"
# a space goes on with a path only if a component follows: such spaces are marked first
register("o_own_path", f"""SELECT doc_id, case_id, {_count('body', OWN_KEY)} AS n_key,
  REGEXP_REPLACE({_without('body', OWN_KEY)}, {q_logs.q(' ([^' + chr(92) * 2 + '/ ]*[' + chr(92) * 2 + '/])')}, CHR(1) || {q_logs.q(chr(92) + '1')}, 'g') AS t FROM {{v_text}}""")
register("o_own_mail", f"""SELECT doc_id, case_id, n_key, {_count('t', OWN_PATH)} AS n_path, REPLACE({_without('t', OWN_PATH)}, CHR(1), ' ') AS t FROM {{o_own_path}}""")
# signs between words are doubled, so that two spans may share one
register("o_own_jwt", f"""SELECT doc_id, case_id, n_key, n_path, {_count('t', MAIL_AND_END)} AS n_mail,
  REGEXP_REPLACE({_without('t', MAIL_AND_END, '|' + chr(92) + '2')}, '([^A-Za-z0-9_.-])', {q_logs.q((chr(92) + '1') * 2)}, 'g') AS t FROM {{o_own_mail}}""")
register("o_own", f"""SELECT doc_id, case_id, n_key, n_path, n_mail, {_count('t', OWN_JWT)} AS n_jwt, {_count(_without('t', OWN_JWT), OWN_TOKEN)} AS n_token FROM {{o_own_jwt}}""")
# document n is said to arrive n minutes after the first of January 2024
register("o_said", f"""SELECT doc_id, case_id, {pick('doc_id % 11', [p[2] for p in PLANTS])} AS kind, {q_privacy.N_PLANT} AS n FROM {{v_text}} WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, case_id, 'email_address', n_mail FROM {{o_own}}
  UNION ALL SELECT doc_id, case_id, 'absolute_path', n_path FROM {{o_own}}
  UNION ALL SELECT doc_id, case_id, 'credential', n_key + n_jwt + n_token FROM {{o_own}}""")


@stream_query("stream_redaction_ledger", """
SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (doc_id // 60) AS window_start, case_id, kind, CAST(SUM(n) AS BIGINT) AS redactions
FROM {o_said} WHERE kind IS NOT NULL AND n > 0
GROUP BY doc_id // 60, case_id, kind""")
def stream_redaction_ledger(spark, sf_dir):
    d = J.stream_table(spark, sf_dir, "documents")
    plant = F.expr(q_privacy.plant_sql(0).replace("CHR(", "char("))
    texts = d.select(F.timestamp_seconds(1704067200 + F.col("doc_id") * 60).alias("ts"), F.col("source").alias("case_id"),
                     F.concat(plant, F.lit(" "), F.col("text")).alias("text"))
    return J.run_to_end(J.redaction_windows, texts, "ledger")


register("v_request", """SELECT 'f' || (conv_id % 20) AS file, conv_id, turn, conv_id % 6 = 0 AS unscored, conv_id * 80 + turn AS at_s
  FROM {conversations} WHERE role = 'user'""")


@stream_query("stream_chain_sessions", """
WITH g AS (SELECT *, CASE WHEN at_s - LAG(at_s) OVER (PARTITION BY file ORDER BY at_s, turn) >= 1800 THEN 1 ELSE 0 END AS cut FROM {v_request}),
n AS (SELECT *, SUM(cut) OVER (PARTITION BY file ORDER BY at_s, turn ROWS UNBOUNDED PRECEDING) AS no FROM g),
s AS (SELECT file, no, MIN(at_s) AS a, MAX(at_s) + 1800 AS z, COUNT(*) AS requests, BOOL_AND(NOT unscored) AS all_full_chain FROM n GROUP BY file, no)
SELECT file, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * a AS session_start, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * z AS session_end, requests, all_full_chain
FROM s""")
def stream_chain_sessions(spark, sf_dir):
    c = J.stream_table(spark, sf_dir, "conversations").where("role = 'user'")
    chunk = F.when(F.col("conv_id") % 6 == 0, F.lit('{"text": "b"}')).otherwise(F.lit('{"text": "b", "score": 0.5}'))
    line = F.concat(F.lit('{"query": "'), F.sha2("text", 256), F.lit('", "retrieved": ['), chunk, F.lit("]}"))
    lines = c.select(F.timestamp_seconds(1704067200 + F.col("conv_id") * 80 + F.col("turn")).alias("ts"),
                     F.concat(F.lit("f"), (F.col("conv_id") % 20).cast("string")).alias("file"), line.alias("line"))
    return J.run_to_end(J.chain_sessions, lines, "sessions")


@stream_query("write_evidence", "SELECT case_id, facet, band, CAST(score_tenths AS BIGINT) AS score_tenths FROM {s_conclusion}")
def evidence_round_trip(spark, sf_dir):
    """Conclusions saved twice over the same folder, the second time from what the first save holds, and read back."""
    from provlake.checks.q_scoring import _conclusions
    from provlake.checks.sqlviews import spark_view

    where = J.work_dir(spark, "evidence")
    c = _conclusions(lambda v: spark_view(spark, sf_dir, v)).select("case_id", "facet", "band", "score_tenths")
    write_evidence({"conclusions": c}, where)
    write_evidence({"conclusions": read_evidence(spark, where, "conclusions")}, where)
    return read_evidence(spark, where, "conclusions")


def line(cols: list[str]) -> str:
    return "CONCAT_WS('|', " + ", ".join(f"'{c}=' || CAST({c} AS {{T}})" for c in cols) + ")"


SAVED = {  # table: (view behind it, columns compared)
    "outcomes": ("v_outcome", ["emit_block", "emit_fact", "emit_step", "rule_id", "kind", "facet", "claim", "anchor", "achievement", "tier", "source_group"]),
    "cap_requests": ("v_cap", ["claim", "cap_id", "triggered_by"]),
    "abstention_requests": ("v_abstention", ["facet", "abstention_id"]),
    "out_of_scope": ("v_scope", ["facet"]),
    "claim_scores": ("s_score", ["claim", "raw_tenths", "score_tenths", "rubric_divisor", "caps", "best_tier", "source_groups", "contradicted_by"]),
    "conclusions": ("s_conclusion", ["facet", "claim", "band", "score_tenths", "abstentions", "method_label_emitted"]),
}


def saved_sql(name: str) -> str:
    view, cols = SAVED[name]
    return f"SELECT '{name}' AS name, case_id, {line(cols)} AS line FROM {{{{{view}}}}}".format(T="VARCHAR").replace("CAST(rubric_divisor", "CAST(divisor")


@stream_query("write_evidence_tables", " UNION ALL ".join(saved_sql(n) for n in SAVED))
def evidence_tables(spark, sf_dir):
    """All six tables saved twice in one store, the second time over what the first save holds, and read back whole."""
    from provlake.checks.q_scoring import _stack, caps_text
    from provlake.checks.sqlviews import spark_view
    from provlake.operators import scoring

    get, where = lambda v: spark_view(spark, sf_dir, v), J.work_dir(spark, "evidence")
    tables = {n: get(SAVED[n][0]) for n in list(SAVED)[:4]}
    claims = staged(scoring.claim_rows(get("v_case"), _stack(get)), "claim-rows")  # folded once for both tables
    tables |= {"claim_scores": scoring.score_table(claims), "conclusions": scoring.conclusion_table(claims)}
    write_evidence(tables, where)
    write_evidence({n: read_evidence(spark, where, n) for n in SAVED}, where)
    out = None
    for name, (_, cols) in SAVED.items():
        df = read_evidence(spark, where, name)
        if name == "claim_scores":
            df = df.withColumn("caps", caps_text())
        lists = [c for c in cols if df.schema[c].dataType.typeName() == "array"]
        df = df.withColumns({c: F.concat_ws("|", c) for c in lists})
        rows = df.selectExpr(f"'{name}' AS name", "case_id", line(cols).format(T="STRING") + " AS line")
        out = rows if out is None else out.unionByName(rows)
    return out


B = lambda s: s.replace("{", "{{").replace("}", "}}")  # noqa: E731  braces of JSON inside a view text
# one container per supplier: eight length bytes, then a header shorter than 128 bytes; some declare more than they hold
register("v_container", f"""SELECT artifact, header, CASE WHEN s_suppkey % 5 = 0 THEN 127 ELSE LENGTH(header) END AS declared FROM (
  SELECT s_suppkey, 'c' || s_suppkey AS artifact, '{B('{"w":{"dtype":"F32","shape":[')}' || (s_nationkey + 1) || '{B('],"data_offsets":[0,')}' || (s_nationkey * 4 + 4) || '{B(']}}')}' AS header FROM {{supplier}}) t""")


@stream_query("tensor_header_ingest", """SELECT artifact, CASE WHEN declared = LENGTH(header) THEN header END AS header_json, declared AS header_bytes, LENGTH(header) + 9 AS file_size,
  CASE WHEN declared > LENGTH(header) THEN 'declared header reaches past the end of the file' END AS note FROM {v_container}""")
def header_ingest(spark, sf_dir):
    """Containers written from the suppliers to the shared folder, listed and read back."""
    from provlake.checks.sqlviews import spark_view
    from provlake.sources.inventory import list_files

    where = J.work_dir(spark, "containers")
    prefix = F.concat(F.char(F.col("declared")), F.repeat(F.char(F.lit(0)), F.lit(7)))
    # a text file ends its only line with one more byte
    made = spark_view(spark, sf_dir, "v_container").select("artifact", F.concat(prefix, "header").alias("value"))
    # a small table is one partition, whose task would write all files; AQE does not merge partitions of a stated number
    made.repartition(max(64, 4 * spark.sparkContext.defaultParallelism), "artifact").write.partitionBy("artifact").text(where)
    files = list_files(spark, where).select(F.lit(1).cast("bigint").alias("case_id"), F.regexp_extract("path", "artifact=([^/]*)/", 1).alias("artifact"), "path")
    return tensor_header_ingest(files.where("artifact <> ''")).select("artifact", "header_json", "header_bytes", "file_size", "note")
