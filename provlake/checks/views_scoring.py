"""Evidence tables derived from ``lineitem`` and ``orders`` for the scoring checks."""

from provlake import vocab as V
from provlake.checks.sqlviews import dim, idiv, lit, pick, register

# which rule stands for each anchor in these tables
ANCHOR_RULE = {
    "unmerged_lora": ["CL-LORA-002", "CL-BASE-001", "CL-BASE-005", "CL-LORA-013", "CL-BIND-002"],
    "merged_adapter": ["CL-BASE-001", "CL-MERGE-005", "CL-MERGE-003", "CL-MERGE-006", "CL-BIND-002"],
    "dense_finetune": ["CL-DENSE-001", "CL-DENSE-008", "CL-DENSE-003", "CL-DENSE-004", "CL-DENSE-009", "CL-BIND-002"],
    "continued_pretraining": ["CL-BASE-001", "CL-CPT-005", "CL-CPT-002", "CL-CPT-004", "CL-CPT-006", "CL-BIND-002"],
    "distillation": ["CL-DIST-001", "CL-DIST-004", "CL-DIST-003", "CL-DIST-006", "CL-DIST-007", "CL-BIND-002"],
    "rag": ["CL-RAG-002", "CL-RAG-001", "CL-RAG-005", "CL-RAG-008", "CL-BIND-002"],
    "external_api": ["CL-API-004", "CL-API-001", "CL-API-003", "CL-API-009", "CL-API-005"],
    "scratch": ["CL-SCRATCH-004", "CL-SCRATCH-001", "CL-SCRATCH-002", "CL-SCRATCH-003", "CL-SCRATCH-005",
                "CL-SCRATCH-007", "CL-SCRATCH-010", "CL-SCRATCH-013"],
}
BY_NAME = sorted(V.RUBRIC)
ANCHOR_DIM = [
    (BY_NAME.index(c), c, V.CLAIM_FACET[c], i, len(anchors), a, w, ANCHOR_RULE[c][i])
    for c, anchors in V.RUBRIC.items() for i, (a, w) in enumerate(anchors)
]

register("d_anchor", dim(ANCHOR_DIM, "claim_no, claim, facet, anchor_no, n_anchors, anchor, weight, rule_id"))
register("d_claim", dim(
    [(BY_NAME.index(c), c, f, len(V.RUBRIC[c]), V.DIVISOR[c]) for c, f in V.CLAIMS],
    "claim_no, claim, facet, n_anchors, divisor"))
register("d_facet", dim([(i, f) for i, f in enumerate(V.FACETS)], "facet_no, facet"))
register("d_cap", dim([(i, c, m) for i, (c, m) in enumerate(V.CAPS)], "cap_no, cap_id, max_tenths"))
register("d_tier", dim([(t, i) for i, t in enumerate(V.TIERS)], "tier, tier_rank"))
register("d_method", dim(V.METHOD_ANCHORS, "claim, rule_id"))
register("d_exclusive", dim(V.EXCLUSIVE_PAIRS, "claim, rival"))

register("v_case", f"SELECT DISTINCT {idiv('o_orderkey', 5)} AS case_id FROM {{orders}}")

CASE = idiv("l_orderkey", 5)
register("v_outcome_raw", f"""
SELECT {CASE} AS case_id,
       CASE WHEN (l_orderkey * 10 + l_linenumber) % 4 = 0 THEN (l_partkey + l_suppkey) % 8
            ELSE {CASE} % 8 END AS claim_no,
       ((l_orderkey % 5) * 10 + l_linenumber) * 100000000000000 + l_partkey * 10000000 + l_suppkey AS emit_fact,
       l_partkey * 7 + l_suppkey AS anchor_pick, l_partkey, l_suppkey,
       'dir::' || l_returnflag || l_linestatus AS source_group
FROM {{lineitem}}""")
register("v_outcome", f"""
SELECT r.case_id, CAST(0 AS INT) AS emit_block, CAST(r.emit_fact AS BIGINT) AS emit_fact, CAST(0 AS INT) AS emit_step,
       d.rule_id,
       CASE WHEN r.l_partkey % 97 = 0 THEN {lit(V.CONTRADICTION)} ELSE {lit(V.SUPPORT)} END AS kind,
       d.facet, d.claim,
       CASE WHEN r.l_partkey % 97 = 0 THEN NULL ELSE d.anchor END AS anchor,
       CASE WHEN r.l_partkey % 97 = 0 THEN 0 ELSE {pick('r.l_partkey % 5', [100, 100, 80, 60, 30])} END AS achievement,
       CASE WHEN r.l_partkey % 97 = 0 THEN NULL WHEN r.l_suppkey % 3 = 0 THEN 'E2' ELSE 'E1' END AS tier,
       r.source_group
FROM {{v_outcome_raw}} r JOIN {{d_anchor}} d
  ON d.claim_no = r.claim_no AND d.anchor_no = r.anchor_pick % d.n_anchors""")

CASE_O = idiv("o_orderkey", 5)
register("v_cap", f"""
SELECT {CASE_O} AS case_id, {pick('o_orderkey % 8', BY_NAME)} AS claim,
       {pick('o_orderkey % 53', [c for c, _ in V.CAPS])} AS cap_id,
       {pick('o_custkey % 2', ['CL-INV-008', 'CL-BASE-003'])} AS triggered_by
FROM {{orders}} WHERE o_orderkey % 53 < 7""")
register("v_abstention", f"""
SELECT {CASE_O} AS case_id, {pick('o_orderkey % 4', V.FACETS)} AS facet,
       {pick('o_orderkey % 61', V.ABSTENTIONS)} AS abstention_id
FROM {{orders}} WHERE o_orderkey % 61 < 9""")
register("v_scope", f"""
SELECT {CASE_O} AS case_id, {pick('o_orderkey % 211', V.FACETS)} AS facet
FROM {{orders}} WHERE o_orderkey % 211 < 4""")

# --- the same judgement, written as plain SQL --------------------------------
register("s_best", f"""
SELECT case_id, claim, anchor, achievement, rule_id AS witness_rule, source_group AS witness_group, tier AS witness_tier
FROM (SELECT o.*, ROW_NUMBER() OVER (PARTITION BY o.case_id, o.claim, o.anchor
        ORDER BY achievement DESC, emit_block, emit_fact, emit_step, rule_id DESC, source_group DESC, tier DESC) AS rn
      FROM {{s_in}} o SEMI JOIN {{d_anchor}} d ON o.claim = d.claim AND o.anchor = d.anchor
      WHERE o.kind = {lit(V.SUPPORT)}) x WHERE rn = 1""")
register("s_matrix", """
SELECT c.case_id, d.claim, d.facet, d.anchor, d.weight, COALESCE(b.achievement, 0) AS achievement,
       b.witness_rule, b.witness_group, b.witness_tier
FROM {s_case} c CROSS JOIN {d_anchor} d
LEFT JOIN {s_best} b ON b.case_id = c.case_id AND b.claim = d.claim AND b.anchor = d.anchor""")
register("s_raw", """
SELECT m.case_id, m.claim, m.facet,
       CAST(LEAST(1000, GREATEST(0, (SUM(m.weight * m.achievement) * 1000 + SUM(m.weight) * 50) // (SUM(m.weight) * 100))) AS BIGINT) AS raw_tenths,
       CAST(SUM(m.weight) AS BIGINT) AS divisor,
       MAX(CASE WHEN m.achievement > 0 THEN t.tier_rank END) AS best_rank,
       MAX(CASE WHEN m.achievement > 0 THEN m.witness_tier END) AS best_tier,
       COUNT(DISTINCT CASE WHEN m.achievement > 0 AND m.witness_group <> '' THEN m.witness_group END) AS n_groups,
       COALESCE(STRING_AGG(DISTINCT CASE WHEN m.achievement > 0 AND m.witness_group <> '' THEN m.witness_group END, '|'
            ORDER BY CASE WHEN m.achievement > 0 AND m.witness_group <> '' THEN m.witness_group END), '') AS source_groups
FROM {s_matrix} m LEFT JOIN {d_tier} t ON t.tier = m.witness_tier
GROUP BY m.case_id, m.claim, m.facet""")
register("s_caps", f"""
SELECT case_id, claim, cap_id, max_tenths, STRING_AGG(DISTINCT triggered_by, '+' ORDER BY triggered_by) AS triggers FROM (
  SELECT q.case_id, q.claim, q.cap_id, q.triggered_by, d.max_tenths FROM {{s_cap}} q JOIN {{d_cap}} d ON d.cap_id = q.cap_id
  UNION ALL
  SELECT case_id, claim, {lit(V.SINGLE_SOURCE_CAP)}, {lit(V.SINGLE_SOURCE_RULE)}, 849 FROM {{s_raw}} WHERE n_groups <= 1 AND raw_tenths > 849) u
GROUP BY case_id, claim, cap_id, max_tenths""")
register("s_contra", f"""
SELECT case_id, claim, rule_id, COUNT(*) AS times FROM {{s_in}}
WHERE kind = {lit(V.CONTRADICTION)} AND claim IS NOT NULL GROUP BY case_id, claim, rule_id""")
register("s_score", """
SELECT r.*, COALESCE(k.caps, '') AS caps, COALESCE(x.contradicted_by, '') AS contradicted_by,
       CAST(CASE WHEN x.case_id IS NOT NULL THEN 0 ELSE LEAST(r.raw_tenths, COALESCE(k.lowest, 1000)) END AS BIGINT) AS score_tenths,
       m.case_id IS NOT NULL AS has_method
FROM {s_raw} r
LEFT JOIN (SELECT case_id, claim, MIN(max_tenths) AS lowest,
                  STRING_AGG(cap_id || ':' || max_tenths || ':' || triggers, '|' ORDER BY max_tenths) AS caps
           FROM {s_caps} GROUP BY case_id, claim) k ON k.case_id = r.case_id AND k.claim = r.claim
LEFT JOIN (SELECT case_id, claim, STRING_AGG(rule_id, '|' ORDER BY rule_id) AS contradicted_by
           FROM {s_contra} GROUP BY case_id, claim) x ON x.case_id = r.case_id AND x.claim = r.claim
LEFT JOIN (SELECT DISTINCT o.case_id, o.claim FROM {s_in} o JOIN {d_method} d ON d.claim = o.claim AND d.rule_id = o.rule_id
           WHERE o.kind = 'supporting_evidence') m ON m.case_id = r.case_id AND m.claim = r.claim""")
register("s_rank", """
SELECT s.*, ROW_NUMBER() OVER (PARTITION BY case_id, facet ORDER BY score_tenths DESC, claim) AS rn FROM {s_score} s""")
register("s_facet", """
SELECT b.*, COALESCE(r.rival, 0) AS rival_tenths, b.score_tenths - COALESCE(r.rival, 0) AS separation,
       COALESCE(a.alternatives, '') AS alternatives,
       b.claim IN (SELECT claim FROM {d_exclusive}) AS has_exclusive,
       EXISTS (SELECT 1 FROM {s_scope} z WHERE z.case_id = b.case_id AND z.facet = b.facet) AS out_of_scope,
       EXISTS (SELECT 1 FROM {s_in} o WHERE o.case_id = b.case_id AND o.facet = b.facet AND o.kind = 'contradiction') AS facet_contradicted
FROM {s_rank} b
LEFT JOIN (SELECT x.case_id, x.facet, MAX(y.score_tenths) AS rival
           FROM {s_rank} x JOIN {s_rank} y ON y.case_id = x.case_id AND y.facet = x.facet AND y.rn > 1
           JOIN {d_exclusive} e ON e.claim = x.claim AND e.rival = y.claim
           WHERE x.rn = 1 GROUP BY x.case_id, x.facet) r ON r.case_id = b.case_id AND r.facet = b.facet
LEFT JOIN (SELECT case_id, facet, STRING_AGG(claim || ':' || score_tenths, '|' ORDER BY rn) AS alternatives
           FROM {s_rank} WHERE rn > 1 GROUP BY case_id, facet) a ON a.case_id = b.case_id AND a.facet = b.facet
WHERE b.rn = 1""")
register("s_abst", """
SELECT case_id, facet, STRING_AGG(DISTINCT id, '|' ORDER BY id) AS abstentions FROM (
  SELECT case_id, facet, abstention_id AS id FROM {s_abstention}
  UNION ALL SELECT case_id, facet, 'ABS-HYBRID-TOO-CLOSE' FROM {s_facet}
    WHERE score_tenths > 0 AND separation < 150 AND has_exclusive AND rival_tenths > 0
  UNION ALL SELECT case_id, facet, 'ABS-EVIDENCE-MUTABLE' FROM {s_facet}
    WHERE score_tenths >= 800 AND COALESCE(best_rank, 0) < 2) u GROUP BY case_id, facet""")
register("s_conclusion", f"""
WITH g AS (
  SELECT f.*, COALESCE(a.abstentions, '') AS abstentions, COALESCE(i.rule_ids, '') AS rule_ids,
         f.score_tenths >= 800 AS gate_score, f.has_method AS gate_method, COALESCE(f.best_rank >= 2, FALSE) AS gate_tier,
         NOT (f.facet_contradicted OR f.contradicted_by <> '') AS gate_uncontradicted, f.separation >= 150 AS gate_separation
  FROM {{s_facet}} f
  LEFT JOIN {{s_abst}} a ON a.case_id = f.case_id AND a.facet = f.facet
  LEFT JOIN (SELECT case_id, facet, STRING_AGG(DISTINCT rule_id, '|' ORDER BY rule_id) AS rule_ids
             FROM {{s_in}} WHERE facet IS NOT NULL GROUP BY case_id, facet) i ON i.case_id = f.case_id AND i.facet = f.facet),
h AS (SELECT g.*, gate_score AND gate_method AND gate_tier AND gate_uncontradicted AND gate_separation AS gate_passes FROM g),
b AS (SELECT h.*, CASE WHEN out_of_scope THEN {lit(V.BAND_NOT_SUPPLIED)}
  WHEN NOT gate_uncontradicted THEN {lit(V.BAND_CONTRADICTED)}
  WHEN abstentions <> '' THEN {lit(V.BAND_INSUFFICIENT)}
  WHEN score_tenths >= 700 AND NOT gate_passes THEN {lit(V.BAND_PARTIAL)}
  WHEN score_tenths >= 850 THEN {lit(V.BAND_CORROBORATED)}
  WHEN score_tenths >= 700 THEN {lit(V.BAND_STRONG)}
  WHEN score_tenths >= 500 THEN {lit(V.BAND_WEAK)} ELSE {lit(V.BAND_INSUFFICIENT)} END AS band FROM h)
SELECT b.*, gate_passes AND NOT out_of_scope AS method_label_emitted FROM b""")
# evidence the scoring checks run on
register("s_in", "SELECT * FROM {v_outcome}")
register("s_case", "SELECT * FROM {v_case}")
register("s_cap", "SELECT * FROM {v_cap}")
register("s_abstention", "SELECT * FROM {v_abstention}")
register("s_scope", "SELECT * FROM {v_scope}")
