"""Checks of log extraction."""

from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.checks import views_logs  # noqa: F401
from provlake.checks.registry import query
from provlake.checks.sqlviews import register
from provlake.functions.numbers import micros, parse_int
from provlake.functions.stamps import LEADING, STAMP
from provlake.operators import logs as L


def q(text: str) -> str:
    """A Python string as an SQL literal inside a view text."""
    return "'" + text.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def sql_int(x: str) -> str:
    s = f"REGEXP_REPLACE(TRIM({x}), {q(chr(94) + '[' + chr(34) + chr(39) + ']+|[' + chr(34) + chr(39) + ']+$')}, '', 'g')"
    digits = f"REGEXP_REPLACE(SPLIT_PART({s}, '.', 1), '[-+_,]', '', 'g')"
    return (f"CASE WHEN REGEXP_MATCHES({s}, '^([+-][0-9_,]*|[0-9][0-9_,]*)([.]0*)?$') AND LENGTH({digits}) BETWEEN 1 AND 19 "
            f"THEN TRY_CAST((CASE WHEN {s} LIKE '-%' THEN '-' ELSE '' END) || {digits} AS BIGINT) END")


def sql_micros(x: str) -> str:
    s = f"REGEXP_REPLACE(TRIM({x}), {q(chr(94) + '[' + chr(34) + chr(39) + ']+|[' + chr(34) + chr(39) + ']+$')}, '', 'g')"
    return (f"CASE WHEN REGEXP_MATCHES({s}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') "
            f"THEN TRY_CAST(TRUNC(TRY_CAST({s} AS DECIMAL(28,9)) * 1000000) AS BIGINT) END")


def keys(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


register("o_pair", """SELECT run, line_no, ROW_NUMBER() OVER (PARTITION BY run, line_no ORDER BY i) - 1 AS pair_no, key, value FROM {o_written}""")


@query("log_pairs", "SELECT run, line_no, pair_no, key, value FROM {o_pair}")
def log_pairs(get):
    return L.log_pairs(get("v_log"))


CASES = " ".join(f"WHEN label LIKE '%{s}' THEN '{n}'" for s, n in V.LABELS)
register("o_segment", f"""
SELECT run, line_no, UNNEST(segs) AS seg, UNNEST(RANGE(LEN(segs))) AS seg_no FROM (
  SELECT run, line_no, STRING_SPLIT(REGEXP_REPLACE(line, {q(LEADING)}, ''), '||') AS segs FROM {{v_log}}) t""")
register("o_label", f"""
SELECT *, CASE {CASES} END AS field FROM (
 SELECT run, line_no, seg_no, TRIM(LOWER(REGEXP_REPLACE(REGEXP_EXTRACT(seg, '^([^=:]*)[=:]', 1), '\\s+', ' ', 'g'))) AS label,
   TRIM(REGEXP_EXTRACT(seg, '^[^=:]*[=:](.*)$', 1)) AS value FROM {{o_segment}} WHERE REGEXP_MATCHES(seg, '[=:]')) t
WHERE label LIKE '% %' AND value <> ''""")
register("o_label_kept", f"""
SELECT run, field, line_no, seg_no, CASE WHEN field IN ('num_epochs', 'final_loss') THEN CASE WHEN {sql_micros('value')} IS NOT NULL THEN value END
   ELSE CAST({sql_int('value')} AS VARCHAR) END AS kept FROM {{o_label}} WHERE field IS NOT NULL""")
register("o_labels", """
SELECT run, field, kept AS value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run, field
   ORDER BY CASE WHEN field = 'num_epochs' THEN 1 ELSE -1 END * (line_no * 100 + seg_no)) AS rn FROM {o_label_kept} WHERE kept IS NOT NULL) t WHERE rn = 1""")


@query("log_labels", "SELECT * FROM {o_labels}")
def log_labels(get):
    return L.log_labels(get("v_log"))


register("o_stamp", f"""
SELECT run, line_no, raw, STRFTIME(TRY_CAST(SUBSTRING(raw, 1, 10) || ' ' || SUBSTRING(raw, 12, 8) AS TIMESTAMP)
    - TO_SECONDS(CASE WHEN d = '' THEN 0 ELSE (CASE WHEN o LIKE '-%' THEN -1 ELSE 1 END) * (CAST(SUBSTRING(d, 1, 2) AS BIGINT) * 3600 + CAST(SUBSTRING(d, 3, 2) AS BIGINT) * 60) END),
    '%Y-%m-%dT%H:%M:%SZ') AS utc
FROM (SELECT *, REGEXP_REPLACE(o, '[+:-]', '', 'g') AS d FROM (
  SELECT *, REGEXP_EXTRACT(SUBSTRING(raw, 11), '[+-][0-9][0-9]:?[0-9][0-9]$', 0) AS o FROM (
    SELECT run, line_no, REGEXP_EXTRACT(line, {q(STAMP)}, 0) AS raw FROM {{v_log}}) a WHERE raw <> '') b) c""")


@query("log_timestamps", "SELECT run, line_no, raw, utc FROM {o_stamp}")
def log_timestamps(get):
    return L.log_timestamps(get("v_log"))


def series_sql(source: str, cond: str = "") -> str:
    return f"""
WITH e AS (SELECT * FROM {{{source}}}),
s AS (SELECT *, LAG(step) OVER (PARTITION BY run ORDER BY line_no, idx) AS prev FROM e WHERE step IS NOT NULL),
o AS (SELECT run, ARG_MIN(step, line_no * 300 + idx) AS first_step, ARG_MAX(step, line_no * 300 + idx) AS last_step, COUNT(*) AS n,
        BOOL_AND(prev IS NULL OR step >= prev) AS ordered FROM s GROUP BY run),
l AS (SELECT run, ARG_MIN(loss, line_no * 300 + idx) AS first_loss, ARG_MAX(loss, line_no * 300 + idx) AS last_loss FROM e WHERE loss IS NOT NULL GROUP BY run),
t AS (SELECT run, COUNT(DISTINCT line_no) FILTER (WHERE is_entry) AS entry_count FROM e GROUP BY run)
SELECT t.run, t.entry_count, o.first_step, o.last_step, CASE WHEN o.n >= 2 THEN o.ordered END AS steps_monotonic, l.first_loss, l.last_loss,
  CASE WHEN {sql_micros('l.first_loss')} <> 0 THEN CAST(TRUNC(({sql_micros('l.first_loss')} - {sql_micros('l.last_loss')}) * 100.0 / {sql_micros('l.first_loss')}) AS BIGINT) END AS loss_decreasing_percent
FROM t LEFT JOIN o ON o.run = t.run LEFT JOIN l ON l.run = t.run {cond}"""


register("o_metric", f"SELECT run, line_no, 0 AS idx, step, CASE WHEN {sql_micros('loss')} IS NOT NULL THEN loss END AS loss, TRUE AS is_entry FROM {{v_metric}}")


@query("metric_series", series_sql("o_metric"))
def metric_series(get):
    return L.metric_series(get("v_metric"))


register("o_log_entry", f"""
SELECT run, line_no, pair_no AS idx, CASE WHEN key IN {keys(V.STEP_KEYS)} THEN {sql_int('value')} END AS step,
  CASE WHEN key IN {keys(V.LOSS_KEYS)} AND {sql_micros('value')} IS NOT NULL THEN value END AS loss, key IN {keys(V.ENTRY_KEYS)} AS is_entry FROM {{o_pair}}""")
register("o_log_series", series_sql("o_log_entry", "WHERE t.entry_count > 0"))


@query("log_series", "SELECT * FROM {o_log_series}")
def log_series(get):
    return L.log_series(get("v_log"))


CKPT = "(CONTAINS(LOWER(line), 'checkpoint') AND REGEXP_MATCHES(LOWER(line), 'sav|writ|dump'))"


@query("checkpoint_steps", f"""
WITH d AS (SELECT run, TRY_CAST(s AS BIGINT) AS step, MIN(line_no * 300 + i) AS seen FROM (
   SELECT run, line_no, UNNEST(x) AS s, UNNEST(RANGE(LEN(x))) AS i FROM (
     SELECT run, line_no, REGEXP_EXTRACT_ALL(LOWER(line), 'checkpoint-([0-9]+)', 1) AS x FROM {{v_log}} WHERE {CKPT}) a) b WHERE TRY_CAST(s AS BIGINT) IS NOT NULL GROUP BY run, s),
k AS (SELECT run, step, 2 AS o FROM d
  UNION ALL SELECT run, first_step, 0 FROM {{o_log_series}} WHERE first_step IS NOT NULL
  UNION ALL SELECT run, last_step, 1 FROM {{o_log_series}} WHERE last_step IS NOT NULL)
SELECT run, step, CASE MIN(o) WHEN 0 THEN 'series_first' WHEN 1 THEN 'series_last' ELSE 'checkpoint_directory' END AS origin FROM k GROUP BY run, step""")
def checkpoint_steps(get):
    return L.checkpoint_steps(get("v_log"))


START = "REGEXP_MATCHES(LOWER(line), '" + "|".join(V.RUN_START_PHRASES) + "')"


@query("run_chronology", f"""
WITH x AS (SELECT s.*, {START.replace('line', 'v.line')} AS is_start, {CKPT.replace('line', 'v.line')} AS is_ckpt
           FROM {{o_stamp}} s JOIN {{v_log}} v ON v.run = s.run AND v.line_no = s.line_no),
m AS (SELECT run, MAX(line_no) FILTER (WHERE is_start) AS sl, MIN(line_no) AS fl, MAX(line_no) AS ll FROM x GROUP BY run),
c AS (SELECT m.run, MAX(x.line_no) AS cl FROM m JOIN x ON x.run = m.run AND x.is_ckpt AND (m.sl IS NULL OR x.line_no >= m.sl) GROUP BY m.run)
SELECT m.run, s.raw AS run_started_at_text, s.utc AS run_started_at, k.raw AS checkpoint_at_text, k.utc AS checkpoint_at,
       f.raw AS observed_first_at, l.raw AS observed_last_at
FROM m LEFT JOIN c ON c.run = m.run LEFT JOIN x s ON s.run = m.run AND s.line_no = m.sl LEFT JOIN x k ON k.run = m.run AND k.line_no = c.cl
JOIN x f ON f.run = m.run AND f.line_no = m.fl JOIN x l ON l.run = m.run AND l.line_no = m.ll""")
def run_chronology(get):
    return L.run_chronology(get("v_log"))


RATE = "REGEXP_MATCHES(key, '" + "|".join(V.RATE_MARKERS) + "')"


@query("token_counts", f"""
SELECT COALESCE(a.run, b.run) AS run, COALESCE(a.n, CAST(b.value AS BIGINT)) AS tokens FROM
 (SELECT run, MAX({sql_int('value')}) AS n FROM {{o_pair}} WHERE key IN {keys(V.TOKEN_KEYS)} AND NOT {RATE} GROUP BY run HAVING n IS NOT NULL) a
 FULL JOIN (SELECT * FROM {{o_labels}} WHERE field = 'tokens') b ON b.run = a.run""")
def token_counts(get):
    return L.token_counts(get("v_log"))


MENTION = rf"(?:^|[^a-z0-9.])([0-9]+ *x *(?:{'|'.join(V.ACCELERATORS)})[a-z0-9\-]*)"
register("o_int_pair", f"SELECT run, line_no, pair_no, key, {sql_int('value')} AS n FROM {{o_pair}}")
register("o_mention", f"""
SELECT run, line_no, i, CAST(REGEXP_EXTRACT(m, '^([0-9]+)', 1) AS BIGINT) AS n, REGEXP_EXTRACT(m, 'x *([a-z0-9\\-]+)$', 1) AS tok FROM (
  SELECT run, line_no, UNNEST(x) AS m, UNNEST(RANGE(LEN(x))) AS i FROM (
    SELECT run, line_no, REGEXP_EXTRACT_ALL(LOWER(line), {q(MENTION)}, 1) AS x FROM {{v_log}}) a) b
WHERE CAST(REGEXP_EXTRACT(m, '^([0-9]+)', 1) AS BIGINT) BETWEEN 1 AND 100000""")


@query("hardware_records", f"""
WITH r AS (SELECT DISTINCT run FROM {{v_log}}), x AS (
SELECT r.run,
  COALESCE((SELECT ARG_MAX(n, line_no * 300 + pair_no) FROM {{o_int_pair}} p WHERE p.run = r.run AND key = 'world_size' AND n IS NOT NULL),
    (SELECT CAST(value AS BIGINT) FROM {{o_labels}} l WHERE l.run = r.run AND field = 'world_size')) AS world_size,
  COALESCE((SELECT ARG_MAX(n, line_no * 300 + pair_no) FROM {{o_int_pair}} p WHERE p.run = r.run AND key IN {keys(V.GPU_COUNT_KEYS)} AND n IS NOT NULL),
    (SELECT ARG_MIN(n, line_no * 300 + i) FROM {{o_mention}} m WHERE m.run = r.run)) AS gpu_count,
  COALESCE((SELECT STRING_AGG(DISTINCT value, '; ' ORDER BY value) FROM {{o_pair}} p WHERE p.run = r.run AND key IN {keys(V.DEVICE_KEYS)} AND value <> ''), '') AS device_name,
  COALESCE((SELECT STRING_AGG(DISTINCT n || 'x ' || tok, '; ' ORDER BY n || 'x ' || tok) FROM {{o_mention}} m WHERE m.run = r.run), '') AS description
FROM r) SELECT * FROM x WHERE world_size IS NOT NULL OR gpu_count IS NOT NULL OR device_name <> '' OR description <> ''""")
def hardware_records(get):
    return L.hardware_records(get("v_log"))


@query("compute_records", f"""
SELECT * FROM (SELECT run,
  MAX(CASE WHEN key IN {keys(V.RUNTIME_KEYS)} THEN {sql_micros('value')} // 1000000 END) AS wall_clock_seconds,
  ARG_MAX({sql_int('value')}, line_no * 300 + pair_no) FILTER (WHERE key IN {keys(V.GPU_HOUR_KEYS)} AND {sql_int('value')} IS NOT NULL) AS gpu_hours,
  MAX(CASE WHEN key IN {keys(V.FLOP_KEYS)} THEN {sql_int('value')} END) AS total_flos,
  ARG_MAX({sql_int('value')}, line_no * 300 + pair_no) FILTER (WHERE key IN {keys(V.SEED_KEYS)} AND {sql_int('value')} IS NOT NULL) AS seed,
  ARG_MAX({sql_int('value')}, line_no * 300 + pair_no) FILTER (WHERE key = 'data_seed' AND {sql_int('value')} IS NOT NULL) AS data_seed
FROM {{o_pair}} GROUP BY run) t WHERE COALESCE(wall_clock_seconds, gpu_hours, total_flos, seed, data_seed) IS NOT NULL""")
def compute_records(get):
    return L.compute_records(get("v_log"))


@query("numeric_parse", f"SELECT event_id, txt, {sql_int('txt')} AS as_int, {sql_micros('txt')} AS as_micros FROM {{v_number}}")
def numeric_parse(get):
    return get("v_number").select("event_id", "txt", parse_int(F.col("txt")).alias("as_int"), micros(F.col("txt")).alias("as_micros"))


@query("log_tail", "SELECT run, line_no, line, FALSE AS overlong FROM {v_log}")
def log_whole(get):
    return L.log_tail(get("v_log"))


@query("log_tail_limited", """
WITH s AS (SELECT run, line_no, line, SUM(STRLEN(line) + 1) OVER (PARTITION BY run ORDER BY line_no DESC ROWS UNBOUNDED PRECEDING) AS from_end FROM {v_log}),
k AS (SELECT * FROM s WHERE from_end <= 2000)
SELECT run, COUNT(*) FILTER (WHERE STRLEN(line) <= 100) AS kept_lines, COUNT(*) FILTER (WHERE STRLEN(line) > 100) AS overlong_lines,
  MIN(line_no) FILTER (WHERE STRLEN(line) <= 100) AS first_line FROM k GROUP BY run""")
def log_tail(get):
    return L.log_tail_summary(get("v_log"), tail_bytes=2000, max_line=100, chunk_rows=64)


register("o_state_entry", f"""
SELECT run, event_id AS line_no, 0 AS idx, k AS step, loss, TRUE AS is_entry FROM {{v_state}}""")


@query("trainer_state_series", f"""
SELECT run, entry_count, first_step, last_step, last_step + 1 AS global_step, steps_monotonic AS monotone_step_order, first_loss, last_loss,
 CONCAT_WS('|', first_step, CASE WHEN last_step <> first_step THEN last_step END, CASE WHEN first_step <> last_step + 1 THEN last_step + 1 END) AS checkpoint_steps
FROM ({series_sql('o_state_entry')}) t""")
def trainer_state_series(get):
    # a run's block of 500 events is one bounded JSON state
    states = (get("v_state").groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "k", "loss"))).alias("h"))
        .select("run", F.to_json(F.struct(
            (F.element_at("h", -1)["k"] + 1).alias("global_step"),
            F.transform("h", lambda e: F.struct(e["k"].alias("step"), e["loss"].try_cast("decimal(18,6)").alias("loss"))).alias("log_history"))).alias("body")))
    return (L.trainer_state_series(states)
            .withColumn("checkpoint_steps", F.concat_ws("|", F.col("checkpoint_steps").cast("array<string>"))))
