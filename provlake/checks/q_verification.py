"""Checks of verification, digests and fleet queries (V, E15, F32)."""

from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.checks import q_scoring, q_sources, views_facts as VF
from provlake.checks.q_scoring import _conclusions, joined
from provlake.checks.registry import ORACLES, query
from provlake.checks.sqlviews import idiv, lit, pick, register, with_clause
from provlake.operators import scoring as S
from provlake.operators import verification as X
from provlake.operators.configs import facts_union
from provlake.operators.privacy import redaction_ledger
from provlake.operators.skew import apart, crowded
from provlake.sources.sink import staged

CASE = idiv("o_orderkey", 5)
register("v_payload", f"SELECT {CASE} AS case_id, 'doc_' || o_orderkey AS name, @SHA(CAST(o_orderkey AS VARCHAR(20))@) AS sha256, o_orderkey FROM {{orders}} WHERE o_orderkey % 17 <> 0")
register("v_envelope", f"""SELECT {CASE} AS case_id, 'doc_' || o_orderkey AS name, @SHA(CAST(o_orderkey AS VARCHAR(20)) || CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE '' END@) AS sha256
  FROM {{orders}} WHERE o_orderkey % 23 <> 0""")
register("o_issue", """
SELECT COALESCE(e.case_id, p.case_id) AS case_id, COALESCE(e.name, p.name) AS name,
  CASE WHEN p.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' WHEN e.sha256 <> p.sha256 THEN 'altered' END AS issue
FROM {v_envelope} e FULL JOIN {v_payload} p ON p.case_id = e.case_id AND p.name = e.name""")


@query("envelope_check", "SELECT * FROM {o_issue} WHERE issue IS NOT NULL")
def envelope_check(get):
    return X.envelope_check(get("v_envelope"), get("v_payload"))


def tree(prefix: str, text_view: str) -> str:
    """SQL of the digest tree over a view of (case_id, t)."""
    register(f"{prefix}_l", f"""SELECT case_id, leaf, SHA256(STRING_AGG(t, CHR(10) ORDER BY t)) AS d FROM (SELECT case_id, t, SUBSTRING(SHA256(t), 1, 4) AS leaf FROM {{{text_view}}}) x GROUP BY case_id, leaf""")
    register(f"{prefix}_b", f"""SELECT case_id, SUBSTRING(leaf, 1, 2) AS branch, SHA256(STRING_AGG(leaf || ':' || d, CHR(10) ORDER BY leaf || ':' || d)) AS d FROM {{{prefix}_l}} GROUP BY case_id, SUBSTRING(leaf, 1, 2)""")
    register(prefix, f"""SELECT case_id, SHA256(STRING_AGG(branch || ':' || d, CHR(10) ORDER BY branch || ':' || d)) AS digest FROM {{{prefix}_b}} GROUP BY case_id""")
    return prefix


register("o_root_t", "SELECT case_id, name || ':' || sha256 AS t FROM {v_payload}")
tree("o_root", "o_root_t")


@query("root_digest", "SELECT case_id, digest AS root_digest FROM {o_root}")
def root_digest(get):
    return X.root_digest(get("v_payload"))


register("v_unreadable", "SELECT case_id FROM {v_case} WHERE case_id % 41 = 7")


def roots(actual):
    """Declared roots: true ones, but for some cases; some cases have no envelope."""
    return (actual.where("case_id % 6 <> 0")
            .select("case_id", F.when(F.col("case_id") % 37 == 0, "other").otherwise(F.col("root_digest")).alias("declared_root")))


register("o_integrity", """
SELECT c.case_id, CASE WHEN c.case_id % 41 = 7 THEN 'unreadable' WHEN r.digest IS NULL OR c.case_id % 6 = 0 THEN 'incomplete'
  WHEN EXISTS (SELECT 1 FROM {o_issue} i WHERE i.case_id = c.case_id AND i.issue = 'missing') THEN 'incomplete'
  WHEN c.case_id % 37 = 0 OR EXISTS (SELECT 1 FROM {o_issue} i WHERE i.case_id = c.case_id AND i.issue IS NOT NULL) THEN 'modified' ELSE 'intact' END AS integrity_status
FROM {v_case} c LEFT JOIN {o_root} r ON r.case_id = c.case_id""")


def integrity(get):
    actual = staged(X.root_digest(get("v_payload")), "roots")
    return X.integrity_status(get("v_case"), get("v_envelope"), get("v_payload"), roots(actual), get("v_unreadable"), actual)


@query("integrity_status", "SELECT * FROM {o_integrity}")
def integrity_status(get):
    return integrity(get)


def stated(c):
    """Delivered conclusions: the true ones, some edited."""
    k = F.col("case_id")
    return (c.where(k % 31 != 3)
            .withColumn("score_tenths", F.col("score_tenths") + F.when(k % 13 == 0, 100).otherwise(0))
            .withColumn("band", F.when(k % 17 == 0, V.BAND_WEAK).otherwise(F.col("band")))
            .withColumn("method_label_emitted", F.when(k % 19 == 0, ~F.col("method_label_emitted")).otherwise(F.col("method_label_emitted")))
            .withColumn("ruleset_version", F.when(k % 29 == 0, 2).otherwise(1)))


register("o_diff", f"""
SELECT case_id, facet, CASE WHEN case_id % 31 = 3 OR case_id % 29 = 0 THEN 'not_possible' WHEN case_id % 13 = 0 OR (case_id % 17 = 0 AND band <> {lit(V.BAND_WEAK)}) THEN 'diverges'
   WHEN case_id % 19 = 0 THEN 'diverges_elsewhere' ELSE 'matches' END AS status,
  CASE WHEN case_id % 31 <> 3 THEN CASE WHEN case_id % 17 = 0 THEN {lit(V.BAND_WEAK)} ELSE band END END AS stated_band, band AS recomputed_band,
  CASE WHEN case_id % 31 <> 3 THEN score_tenths + CASE WHEN case_id % 13 = 0 THEN 100 ELSE 0 END END AS stated_tenths, score_tenths AS recomputed_tenths FROM {{s_conclusion}}""")


def diff(c):
    return X.recompute_diff(stated(c), c)


@query("recompute_diff", "SELECT * FROM {o_diff}")
def recompute_diff(get):
    return diff(staged(_conclusions(get), "conclusions"))


register("v_challenge", f"""
SELECT {CASE} AS case_id, o_orderkey % 11 <> 5 AS parsed, {CASE} + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS names_case, o_orderdate AS issued,
  CASE WHEN o_orderkey % 7 < 5 THEN 'ab' END AS signature, o_orderkey % 7 < 4 AS has_key, o_orderkey % 7 <> 2 AS signature_valid, o_orderkey
FROM {{orders}} WHERE o_orderkey % 5 = 1""")
register("o_challenge", """
SELECT c.case_id, CASE WHEN h.case_id IS NULL THEN 'absent' WHEN NOT h.parsed THEN 'signature_invalid' WHEN h.names_case <> c.case_id THEN 'case_mismatch'
  WHEN TIMESTAMP '1998-06-01 00:00:00' > h.issued + INTERVAL 14 DAYS THEN 'expired' WHEN h.signature IS NULL THEN 'unsigned' WHEN h.has_key AND h.signature_valid THEN 'bound' ELSE 'signature_invalid' END AS challenge_status
FROM {v_case} c LEFT JOIN {v_challenge} h ON h.case_id = c.case_id""")


def challenge(get):
    h = get("v_challenge").withColumn("expires_at", F.col("issued") + F.expr("INTERVAL 14 DAYS")).drop("issued", "o_orderkey")
    return X.challenge_status(get("v_case"), h, F.lit("1998-06-01 00:00:00").cast("timestamp"))


@query("challenge_status", "SELECT * FROM {o_challenge}")
def challenge_status(get):
    return challenge(get)


STRENGTH = "CASE band " + " ".join(f"WHEN {lit(b)} THEN {i}" for i, b in enumerate(V.BAND_STRENGTH)) + " END"
register("o_weakest", f"SELECT case_id, ARG_MIN(band, {STRENGTH}) AS evidence_status FROM {{s_conclusion}} GROUP BY case_id")


@query("weakest_band", "SELECT * FROM {o_weakest}")
def weakest_band(get):
    return X.weakest_band(_conclusions(get))


@query("verification_axes", """
SELECT a.*, integrity_status = 'intact' AND recomputation = 'matches' AS is_sound, challenge_status = 'bound' AS is_bound,
  integrity_status = 'intact' AND recomputation = 'matches' AND challenge_status = 'bound' AS all_clear
FROM (SELECT i.case_id, i.integrity_status, h.challenge_status, c.coverage_status, w.evidence_status,
  CASE WHEN d.np THEN 'not_possible' WHEN d.bad THEN 'diverges' ELSE 'matches' END AS recomputation
  FROM {o_integrity} i JOIN {o_challenge} h ON h.case_id = i.case_id JOIN {o_coverage} c ON c.case_id = i.case_id JOIN {o_weakest} w ON w.case_id = i.case_id
  JOIN (SELECT case_id, BOOL_OR(status = 'not_possible') AS np, BOOL_OR(status <> 'matches') AS bad FROM {o_diff} GROUP BY case_id) d ON d.case_id = i.case_id) a""")
def verification_axes(get):
    c = staged(_conclusions(get), "conclusions")
    return X.verification_axes(get("v_case"), integrity(get), challenge(get), q_sources.coverage_status(get), X.weakest_band(c),
                               X.recomputation(diff(c)))


# --- canary ---------------------------------------------------------------------------
register("v_canary", "SELECT case_id, @SHA(CAST(case_id AS VARCHAR(20))@) AS digest_hex, 'case-' || case_id AS case_text, 'n' || (case_id % 97) AS nonce FROM {v_case}")


def sql_bytes(h: str) -> str:
    return f"[CAST('0x' || SUBSTRING({h}, CAST(i * 2 + 1 AS INT), 2) AS INT) FOR i IN RANGE(32)]"


register("o_seed", "SELECT *, SHA256(FROM_HEX(digest_hex) || ENCODE(case_text || nonce)) AS seed FROM {v_canary}")
register("o_canary", f"""
SELECT case_id, [b % 10 FOR b IN {sql_bytes('seed')} || {sql_bytes("SHA256(ENCODE('CL-CANARY-BLOCK') || FROM_HEX(seed) || FROM_HEX('00000001'))")} IF b < 250][1:6] AS digits FROM {{o_seed}}""")


def digits(get):
    return get("v_canary").select("case_id", X.canary_digits(F.col("digest_hex"), F.col("case_text"), F.col("nonce")).alias("digits"))


@query("canary_digits", "SELECT case_id, ARRAY_TO_STRING(digits, '') AS digits FROM {o_canary}")
def canary_digits(get):
    return digits(get).select("case_id", F.concat_ws("", F.col("digits").cast("array<string>")).alias("digits"))


@query("canary_check", """SELECT case_id, case_id % 10 NOT IN (3, 5) AND NOT (case_id % 10 = 7) AS canary_ok FROM {v_case}""")
def canary_check(get):
    k = F.col("case_id")
    shown = (digits(get).select("case_id", F.posexplode("digits").alias("i", "d"))
             .withColumn("d", F.when((k % 10 == 3) & (F.col("i") == 2), (F.col("d") + 1) % 10).otherwise(F.col("d")))
             .withColumn("shown", X.render_with_canary((k % 1000 - 500).cast("bigint") + F.col("i"), F.col("d")))
             # a value that rounds to minus zero cannot have been rendered
             .withColumn("shown", F.when((k % 10 == 5) & (F.col("i") == 0), F.concat(F.lit("0"), F.col("shown"))).otherwise(F.col("shown")))
             .where(k % 10 != 7).select("case_id", (F.col("i") + 1).alias("position"), "shown"))
    return X.canary_check(shown, digits(get))


register("v_shown", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '74.32' WHEN 1 THEN '-0.05' WHEN 2 THEN '07.43' WHEN 3 THEN '-12.34' WHEN 4 THEN '1.2' WHEN 5 THEN '+1.23' WHEN 6 THEN '0.00' ELSE p_size || '.' || (p_size % 10) || '7' END AS shown, p_size FROM {part}")


@query("canary_strip", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 743 WHEN 3 THEN -123 WHEN 6 THEN 0 WHEN 7 THEN p_size * 10 + p_size % 10 END AS tenths FROM {v_shown}")
def canary_strip(get):
    return get("v_shown").select("p_partkey", X.strip_canary(F.col("shown")).alias("tenths"))


# --- digests, documents, fleet -----------------------------------------------------------
register("o_manifest_t", """SELECT case_id, CONCAT_WS('|', 'artifact_id=' || artifact_id, 'artifact_type=' || artifact_type, 'mtime=' || mtime, 'sha256=' || sha256) AS t
  FROM (SELECT *, mtime_s AS mtime FROM {v_artifact}) x""")
tree("o_manifest", "o_manifest_t")


@query("manifest_digest", "SELECT case_id, digest AS manifest_digest FROM {o_manifest}")
def manifest_digest(get):
    return X.manifest_digest(get("v_artifact").withColumnRenamed("mtime_s", "mtime"))




def parts_of(*columns: str, **named: str) -> str:
    """``name=value`` of columns by name, as ``row_text`` writes them; ``named`` gives columns that another expression stands for."""
    of = {c: c for c in columns} | named
    return "CONCAT_WS('|', " + ", ".join(f"'{c}=' || {of[c]}" for c in sorted(of)) + ") AS t"


register("o_ev_conclusions_t", "SELECT case_id, " + parts_of(
    "facet", "claim", "band", "score_tenths", "abstentions", "best_tier", "method_label_emitted", "alternatives", "rule_ids", "rival_tenths", "separation",
    "gate_score", "gate_method", "gate_tier", "gate_uncontradicted", "gate_separation", "gate_passes", rubric_divisor="divisor") + " FROM {s_conclusion}")
register("o_ev_anchors", """SELECT case_id, claim, STRING_AGG(a, ',' ORDER BY a) AS anchors FROM (
  SELECT case_id, claim, CONCAT_WS(':', anchor, weight, achievement, witness_rule, witness_group, witness_tier) AS a FROM {s_matrix}) x GROUP BY case_id, claim""")
register("o_ev_claim_scores_t", "SELECT s.case_id, " + parts_of(
    "raw_tenths", "score_tenths", "anchors", "caps", "best_tier", "source_groups", "contradicted_by", claim="s.claim", rubric_divisor="divisor",
    has_method_anchor="has_method") + " FROM {s_score} s JOIN {o_ev_anchors} a ON a.case_id = s.case_id AND a.claim = s.claim")
ENTRY = [c for c in S.ENTRY_COLUMNS if c != "case_id"]
register("o_ev_emissions_t", f"""SELECT case_id, {parts_of(*ENTRY)} FROM {{v_outcome}}
  UNION ALL SELECT q.case_id, {parts_of(anchor='cap_id', claim='q.claim', facet='d.facet', kind=lit(V.CAP_REQUEST), rule_id='triggered_by')}
    FROM {{v_cap}} q LEFT JOIN {{d_claim}} d ON d.claim = q.claim
  UNION ALL SELECT case_id, {parts_of('facet', anchor='abstention_id', kind=lit(V.ABSTENTION_REQUEST))} FROM {{v_abstention}}
  UNION ALL SELECT case_id, {parts_of('facet', kind=lit(V.OUT_OF_SCOPE))} FROM {{v_scope}}""")
DECLARED = ["weight_origin", "parameter_update", "training_stage", "augmentation"]
register("o_ev_declared_t", f"SELECT case_id, {parts_of(*DECLARED)} FROM {{v_declared}}")
OBSERVED = [
    "fact_seq", "fact_id", "kind", "artifact_id", "source_group", "pinned", "revision", "base_name", "parameters", "is_base", "model_type", "num_parameters",
    "vocab_changed", "lora_rank", "targets", "modules_to_save", "use_dora", "pairs", "ranks", "has_dora", "enable_lora", "lora_modules", "trainable", "total",
    "step", "entry_count", "monotonic", "objective", "tokens", "category", "full_chain", "image_digest", "in_scope", "flops", "started_at", "checkpoint_at"]
register("o_ev_observations_t", f"SELECT case_id, {parts_of(*OBSERVED)} FROM {{v_fact_flat}}")
for _part in ("conclusions", "claim_scores", "emissions", "declared", "observations"):
    tree(f"o_ev_{_part}", f"o_ev_{_part}_t")


def evidence(get):
    """What was declared, observed and emitted, what follows from it, and the manifest of the artifacts, each with all of its columns."""
    stacked = q_scoring._stack(get)
    few, many = apart(stacked, "case_id", crowded(stacked, "case_id"))
    # moved once, for the scores and for their own digest; what goes together stands side by side, so that it compresses well
    placed = few.select("case_id", "emit_fact", "achievement", "tier", "source_group", "emit_block", "emit_step", "rule_id", "kind", "facet", "claim", "anchor").repartition("case_id")
    rows = S.claim_rows(get("v_case"), many, placed, shared=True)
    anchor = lambda a: F.concat_ws(":", a["anchor"], a["weight"], a["achievement"], a["witness_rule"], a["witness_group"], a["witness_tier"])
    scores = S.score_table(rows).withColumns({
        "anchors": joined(F.array_sort(F.transform("anchors", anchor)), ","), "caps": q_scoring.caps_text(),
        "source_groups": joined("source_groups"), "contradicted_by": joined("contradicted_by")})
    conclusions = S.conclusion_table(rows).withColumns({
        "abstentions": joined("abstentions"), "alternatives": q_scoring.alternatives_text(), "rule_ids": joined("rule_ids")})
    return X.evidence_digest(get("v_case"), {
        "declared": get("v_declared").select("case_id", *DECLARED), "manifest": get("v_artifact").withColumnRenamed("mtime_s", "mtime"),
        "observations": get("v_fact_flat").select("case_id", *OBSERVED)},
        placed={"emissions": placed}, spread={"emissions": many}, few={"claim_scores": scores, "conclusions": conclusions})


EVIDENCE_PARTS = ["claim_scores", "conclusions", "declared", "emissions", "manifest", "observations"]


@query("evidence_digest", "SELECT c.case_id, SHA256(CONCAT_WS(CHR(10), " + ", ".join(f"'{p}=' || {p}.digest" for p in EVIDENCE_PARTS) + ")) AS evidence_digest FROM {v_case} c"
       + "".join(f" LEFT JOIN {{{'o_manifest' if p == 'manifest' else 'o_ev_' + p}}} {p} ON {p}.case_id = c.case_id" for p in EVIDENCE_PARTS))
def evidence_digest(get):
    return evidence(get)


@query("reproducibility", "SELECT COUNT(*) AS cases, 0 AS differing FROM {v_case}")
def reproducibility(get):
    # the second run reads the rows in another order and dealt otherwise over its tasks, without moving them first
    order = {"v_outcome": "emit_fact", "v_fact_flat": "fact_seq", "v_artifact": "artifact_id"} | dict.fromkeys(["v_cap", "v_abstention", "v_scope", "v_declared"], "case_id")

    def shuffled(v):
        odd = F.pmod(F.xxhash64(order.get(v, F.lit(0))), F.lit(2)) == 1
        return get(v).where(odd).unionByName(get(v).where(~odd)) if v in order else get(v)

    # the digests of the first run are saved, so that its shuffles are gone before the second run begins
    a, b = staged(evidence(get), "first-run"), evidence(shuffled)
    mark = lambda df, x, y: df.select(F.lit(x).alias("x"), F.lit(y).alias("y"))
    return (mark(a, 1, 0).unionByName(mark(X.reproducibility(a, b), 0, 1))
            .agg(F.coalesce(F.sum("x"), F.lit(0)).alias("cases"), F.coalesce(F.sum("y"), F.lit(0)).alias("differing")))


@query("report_document", """
SELECT c.case_id, (SELECT COUNT(*) FROM {s_conclusion} s WHERE s.case_id = c.case_id) AS n_conclusions, 1 AS version,
  COALESCE((SELECT STRING_AGG(DISTINCT rule_id, '|' ORDER BY rule_id) FROM {v_outcome} o WHERE o.case_id = c.case_id AND kind = 'contradiction'), '') AS contradictions FROM {v_case} c""")
def report_document(get):
    texts = get("orders").select(F.floor(F.col("o_orderkey") / 5).alias("case_id"), F.lit("mail a@bc.de").alias("text"))
    doc = X.report_document(get("v_case"), get("v_outcome"), _conclusions(get), q_sources.coverage_status(get), redaction_ledger(texts), staged(evidence(get), "evidence"))
    j = lambda p: F.get_json_object("document", p)
    return doc.select("case_id", F.size(F.from_json(j("$.conclusions"), "array<string>")).alias("n_conclusions"), j("$.ruleset_version").cast("int").alias("version"),
                      joined(F.from_json(j("$.contradictions"), "array<string>")).alias("contradictions"))


register("v_submission", f"SELECT {CASE} AS case_id, 'ROOT1/f' || (o_orderkey % 3) AS path_alias, CASE WHEN o_orderkey % 4 > 0 THEN @SHA(CAST(o_custkey % 2 AS VARCHAR(20))@) END AS sha256 FROM {{orders}}")


@query("hash_conflict", """SELECT case_id, path_alias, COUNT(DISTINCT sha256) AS digests, 'ABS-HASH-CONFLICT' AS abstention_id FROM {v_submission}
  WHERE sha256 IS NOT NULL GROUP BY case_id, path_alias HAVING COUNT(DISTINCT sha256) > 1""")
def hash_conflict(get):
    return X.hash_conflict(get("v_submission"))


@query("hash_conflict_conclusions")
def hash_conflict_conclusions(get):
    """Conclusions when the digests of a case's submissions count: every facet of a case with a conflict abstains."""
    asked = get("v_abstention").unionByName(X.conflict_abstentions(get("v_submission")))
    return q_scoring.flat_conclusions(S.conclusions(get("v_case"), S.entries(get("v_outcome"), get("v_cap"), asked, get("v_scope"))))


def _conflict_oracle() -> str:
    """The SQL of the conclusions, with the conflicts among what asks for abstention."""
    found = f"SELECT DISTINCT case_id FROM ({with_clause('SELECT * FROM {v_submission}')}) s WHERE sha256 IS NOT NULL GROUP BY case_id, path_alias HAVING COUNT(DISTINCT sha256) > 1"
    facets = ", ".join(f"({lit(f)})" for f in V.FACETS)
    old = "s_abstention AS (SELECT * FROM v_abstention)"
    text = with_clause(q_scoring.FLAT_CONCLUSION_SQL)
    assert old in text
    return text.replace(old, f"s_abstention AS (SELECT case_id, facet, abstention_id FROM v_abstention UNION ALL SELECT case_id, facet, 'ABS-HASH-CONFLICT' FROM ({found}) c, (VALUES {facets}) AS f(facet))")


ORACLES["hash_conflict_conclusions"] = _conflict_oracle()


@query("fleet_summary", """
SELECT facet, band, coverage_status, COUNT(*) AS cases, GROUPING(facet, band, coverage_status) AS level
FROM {s_conclusion} s JOIN {o_coverage} c ON c.case_id = s.case_id GROUP BY GROUPING SETS ((facet, band, coverage_status), (facet, band), (facet), ())""".replace("SELECT facet, band, coverage_status,", "SELECT facet, band, c.coverage_status,").replace("s JOIN", "s JOIN"))
def fleet_summary(get):
    return X.fleet_summary(_conclusions(get), q_sources.coverage_status(get))


register("v_exp_band", f"SELECT DISTINCT {CASE} AS case_id, {pick('o_orderkey % 4', V.FACETS)} AS facet, CASE o_orderkey % 3 WHEN 0 THEN {lit(V.BAND_INSUFFICIENT)} WHEN 1 THEN {lit(V.BAND_WEAK)} ELSE {lit(V.BAND_CORROBORATED)} END AS band FROM {{orders}} WHERE o_orderkey % 9 = 0")
register("v_exp_name", f"SELECT {CASE} AS case_id, {pick('o_orderkey % 4', V.FACETS)} AS facet FROM {{orders}} WHERE o_orderkey % 5 = 1")
register("v_exp_abst", f"SELECT {CASE} AS case_id, {pick('o_orderkey % 4', V.FACETS)} AS facet, {pick('o_orderkey % 61', V.ABSTENTIONS)} AS abstention_id FROM {{orders}} WHERE o_orderkey % 61 < 9 OR o_orderkey % 61 = 20")
register("v_exp_quiet", "SELECT case_id FROM {v_case} WHERE case_id % 3 = 0")


@query("corpus_expectations", """
SELECT e.case_id, e.facet, 'band' AS violation FROM {v_exp_band} e LEFT JOIN {s_conclusion} s ON s.case_id = e.case_id AND s.facet = e.facet WHERE s.band IS DISTINCT FROM e.band
UNION ALL SELECT e.case_id, e.facet, 'named' FROM {v_exp_name} e JOIN {s_conclusion} s ON s.case_id = e.case_id AND s.facet = e.facet WHERE s.method_label_emitted
UNION ALL SELECT e.case_id, e.facet, 'abstention' FROM {v_exp_abst} e LEFT JOIN {s_conclusion} s ON s.case_id = e.case_id AND s.facet = e.facet
  WHERE NOT COALESCE(LIST_CONTAINS(STRING_SPLIT(s.abstentions, '|'), e.abstention_id), FALSE)
UNION ALL SELECT case_id, NULL, 'contradiction' FROM {v_exp_quiet} q WHERE EXISTS (SELECT 1 FROM {v_outcome} o WHERE o.case_id = q.case_id AND o.kind = 'contradiction')""")
def corpus_expectations(get):
    return X.corpus_violations(_conclusions(get), get("v_outcome"), get("v_exp_band"), get("v_exp_name"), get("v_exp_abst"), get("v_exp_quiet"))


CAT = "(" + ", ".join(f"('{r}')" for r in V.CATALOGUE) + ")"
register("v_emitted", """SELECT rule_id FROM {v_outcome} UNION ALL SELECT triggered_by FROM {v_cap} UNION ALL SELECT 'CL-XSOURCE-001' FROM {v_scope}""")


@query("catalogue_coverage", f"""
WITH cat AS (SELECT * FROM (VALUES {CAT[1:-1]}) AS t(rule_id)), seen AS (SELECT rule_id, COUNT(*) AS times FROM {{v_emitted}} GROUP BY rule_id)
SELECT rule_id, 'not_catalogued' AS finding, times FROM seen WHERE rule_id NOT IN (SELECT rule_id FROM cat)
UNION ALL SELECT rule_id, 'not_emitted', 0 FROM cat WHERE rule_id NOT IN (SELECT rule_id FROM seen)""")
def catalogue_coverage(get):
    return X.catalogue_coverage(get("v_emitted"))


@query("conclusion_text", "SELECT case_id, facet, CASE band " + " ".join(f"WHEN {lit(b)} THEN {lit(t)}" for b, t in X.BAND_TEXT.items()) + " END || ' (' || CASE claim "
       + " ".join(f"WHEN {lit(c)} THEN {lit(t)}" for c, t in X.CLAIM_TEXT.items()) + " END || ').' AS text FROM {s_conclusion}")
def conclusion_text(get):
    return X.conclusion_text(_conclusions(get)).select("case_id", "facet", "text")


@query("report_language_guard", "SELECT 0 AS findings, COUNT(*) AS texts FROM {s_conclusion}")
def report_language_guard(get):
    texts = X.conclusion_text(_conclusions(get)).select("text", F.lit(X.STATEMENT).alias("statement"), F.explode("rule_ids").alias("rule_id"), "case_id", "facet")
    texts = texts.withColumn("rule_text", X.catalogue_text(F.col("rule_id")))
    found = X.language_guard(texts, ["text", "statement", "rule_text"])
    mark = lambda df, x, y: df.select(F.lit(x).alias("x"), F.lit(y).alias("y"))
    return (mark(found, 1, 0).unionByName(mark(_conclusions(get), 0, 1))
            .agg(F.coalesce(F.sum("x"), F.lit(0)).alias("findings"), F.coalesce(F.sum("y"), F.lit(0)).alias("texts")))


@query("facts_union", """SELECT case_id, kind, artifact_id, source_group, seq AS fact_seq, 'F-' || CASE WHEN seq < 10000 THEN LPAD(CAST(seq AS VARCHAR), 4, '0') ELSE CAST(seq AS VARCHAR) END AS fact_id
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY fact_seq % 7, fact_seq) AS seq FROM {v_fact_flat}) t""")
def facts_union_rows(get):
    f = VF.facts(get).withColumn("emit_no", F.col("fact_seq")).withColumn("artifact_seq", F.pmod("fact_seq", F.lit(7))).drop("fact_seq", "fact_id")
    parts = [f.where(F.pmod("emit_no", F.lit(2)) == i) for i in (0, 1)]
    return facts_union(parts).select("case_id", "kind", "artifact_id", "source_group", "fact_seq", "fact_id")


