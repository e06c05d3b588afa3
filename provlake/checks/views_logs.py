"""Training logs derived from ``events``."""

from provlake.checks.sqlviews import register

K = "CAST(REGEXP_EXTRACT(props, '[0-9]+', 0) AS BIGINT)"
register("v_event", f"""
SELECT event_id, user_id, event_type, ts, {K} AS k, CAST(CAST(value AS DECIMAL(18,6)) AS STRING) AS loss,
       SUBSTRING(CAST(ts AS STRING), 1, 19) AS sec FROM {{events}}""")
ZONE = "CASE event_id % 6 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '-0530' WHEN 3 THEN ',123' WHEN 4 THEN '.5Z' ELSE '' END"
register("v_log", f"""
SELECT user_id AS run, event_id AS line_no,
  CASE WHEN event_id % 97 = 0 THEN REPLACE(sec, '-0', '-9') ELSE sec END || {ZONE} ||
  CASE event_type
   WHEN 'view' THEN ' INFO step=' || k || ' loss=' || loss || CASE WHEN k % 7 = 0 THEN ' tokens_per_sec=9 tokens=' || (k * 1000) ELSE '' END
   WHEN 'click' THEN ' {{{{"step": ' || k || ', "note": "cfg: [' || (k % 5) || '", "nested": {{{{"loss": 9, "t": "}}}} ", "u": "{{{{", "a": {{{{"b": {{{{"q": "]' || CHR(92) || '"[", "c": {{{{"d": [{{{{"loss": 8, "step": 1}}}}]}}}}}}}}}}}}, "l": [1, 2]}}}}, "loss": ' || loss || ', "total_tokens": "' || (k * 10) || ',000", "train_runtime": ' || loss || ', "total_flos": ' || k || '000}}}}'
   WHEN 'signup' THEN ' ***** Running training ***** world_size=' || (k % 9) || ' data_seed=' || k || ' device=cuda:' || (k % 3)
   WHEN 'purchase' THEN ' Saving model checkpoint to out/checkpoint-' || k || ' and checkpoint-' || (k + 1) || '; gpu_hours: 3.0'
   ELSE CASE k % 3 WHEN 0 THEN ' Num examples = ' || k || ' || Num Epochs = ' || (k % 5) || ' || seed=' || k
        WHEN 1 THEN ' trainable params: 4,19' || (k % 10) || ' || all params: 6_742 || Total tokens = ' || k || ' || World size: 4'
        ELSE ' Using ' || (k % 9) || 'x A100-80GB and 2 x H100, n_gpu=' || (k % 4) || ', "random_seed": ' || k END
  END AS line
FROM {{v_event}}""")
# the pairs that each kind of line holds, in order, from the columns the line is written from
WRITTEN = {
    "view": [("'step'", "k"), ("'loss'", "loss"), ("'tokens_per_sec'", "CASE WHEN k % 7 = 0 THEN '9' END"), ("'tokens'", "CASE WHEN k % 7 = 0 THEN k * 1000 END")],
    "click": [("'step'", "k"), ("'note'", "'cfg: [' || (k % 5)"), ("'loss'", "loss"), ("'total_tokens'", "(k * 10) || ',000'"), ("'train_runtime'", "loss"),
              ("'total_flos'", "k || '000'")],
    "signup": [("'world_size'", "k % 9"), ("'data_seed'", "k"), ("'device'", "'cuda:' || (k % 3)")],
    "purchase": [("'gpu_hours'", "'3.0'")],
    "else0": [("'seed'", "k")],
    "else1": [("'params'", "4"), ("'size'", "4")],
    "else2": [("'n_gpu'", "k % 4"), ("'random_seed'", "k")],
}
KIND_OF_LINE = "CASE WHEN event_type IN ('view', 'click', 'signup', 'purchase') THEN event_type ELSE 'else' || (k % 3) END"
register("o_written", " UNION ALL ".join(
    # a comma behind the seconds makes a pair of the minutes and seconds
    [f"SELECT user_id AS run, event_id AS line_no, -1 AS i, SUBSTRING(sec, 15, 2) AS key, SUBSTRING(sec, 18, 2) AS value FROM {{v_event}} WHERE event_id % 6 = 3"]
    + [f"SELECT user_id, event_id, {i}, {key}, CAST({value} AS VARCHAR) FROM {{v_event}} WHERE {KIND_OF_LINE} = '{kind}' AND ({value}) IS NOT NULL"
       for kind, pairs in WRITTEN.items() for i, (key, value) in enumerate(pairs)]))
register("v_metric", """
SELECT user_id AS run, event_id AS line_no, CASE WHEN user_id % 2 = 0 THEN event_id ELSE k END AS step, loss FROM {v_event}""")
register("v_number", """
SELECT event_id, CASE event_id % 10 WHEN 0 THEN k || '_000' WHEN 1 THEN k || ',000' WHEN 2 THEN '-' || k || '.0' WHEN 3 THEN k || '.5'
   WHEN 4 THEN loss || '1234567' WHEN 5 THEN k || 'e-3' WHEN 6 THEN ' "' || k || '" ' WHEN 7 THEN '1234567890123456789' || k
   WHEN 8 THEN 'x' || k ELSE '-' || loss END AS txt FROM {v_event}""")
# one trainer state per run and per block of events, its history a bounded array
register("v_state", """
SELECT user_id || '-' || CAST(FLOOR(event_id / 500) AS BIGINT) AS run, event_id, k, loss, event_type FROM {v_event}""")
