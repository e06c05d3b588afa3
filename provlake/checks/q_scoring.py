"""Checks of the scoring operators (E)."""

from pyspark.sql import functions as F

from provlake.checks import views_scoring  # noqa: F401
from provlake.checks.registry import joined, query
from provlake.operators import scoring as S


def _stack(get):
    return S.entries(get("v_outcome"), get("v_cap"), get("v_abstention"), get("v_scope"))


@query("best_anchor", "SELECT * FROM {s_best}")
def best_anchor(get):
    return S.best_anchor(get("v_outcome"))


@query("anchor_matrix", "SELECT case_id, claim, anchor, weight, achievement, witness_rule, witness_group, witness_tier FROM {s_matrix}")
def anchor_matrix(get):
    return S.anchor_matrix(get("v_case"), _stack(get))


@query("raw_tenths", "SELECT case_id, claim, raw_tenths, divisor AS rubric_divisor FROM {s_raw}")
def raw_tenths(get):
    return S.claim_scores(get("v_case"), _stack(get)).select(
        "case_id", "claim", "raw_tenths", F.col("rubric_divisor").cast("bigint").alias("rubric_divisor"))


@query("tier_and_groups", "SELECT case_id, claim, best_tier, source_groups FROM {s_raw}")
def tier_and_groups(get):
    return S.claim_scores(get("v_case"), _stack(get)).select(
        "case_id", "claim", "best_tier", joined("source_groups").alias("source_groups"))


@query("caps_applied", "SELECT case_id, claim, cap_id, CAST(max_tenths AS BIGINT) AS max_tenths, triggers FROM {s_caps}")
def caps_applied(get):
    return (S.claim_scores(get("v_case"), _stack(get))
            .select("case_id", "claim", F.inline("caps"))
            .select("case_id", "claim", "cap_id", "max_tenths", joined("triggered_by", "+").alias("triggers")))


@query("contradicted_claims", "SELECT * FROM {s_contra}")
def contradicted_claims(get):
    return S.contradicted_claims(get("v_outcome"))


def caps_text():
    return joined(F.transform("caps", lambda c: F.concat_ws(":", c["cap_id"], c["max_tenths"], joined(c["triggered_by"], "+"))))


@query("claim_scores", """SELECT case_id, claim, raw_tenths, score_tenths, divisor AS rubric_divisor, caps, best_tier,
       source_groups, contradicted_by FROM {s_score}""")
def claim_scores(get):
    return S.claim_scores(get("v_case"), _stack(get)).select(
        "case_id", "claim", "raw_tenths", "score_tenths", F.col("rubric_divisor").cast("bigint").alias("rubric_divisor"),
        caps_text().alias("caps"), "best_tier", joined("source_groups").alias("source_groups"),
        joined("contradicted_by").alias("contradicted_by"))


@query("outcome_rollup", """SELECT case_id, kind, STRING_AGG(DISTINCT rule_id, '|' ORDER BY rule_id) AS rule_ids
       FROM {s_in} GROUP BY case_id, kind""")
def outcome_rollup(get):
    return S.outcome_rollup(get("v_outcome")).select("case_id", "kind", joined("rule_ids").alias("rule_ids"))


def _conclusions(get):
    return S.conclusions(get("v_case"), _stack(get))


def alternatives_text():
    return joined(F.transform("alternatives", lambda a: F.concat_ws(":", a["claim"], a["score_tenths"])))


@query("facet_ranking", "SELECT case_id, facet, claim, score_tenths, alternatives FROM {s_facet}")
def facet_ranking(get):
    return _conclusions(get).select("case_id", "facet", "claim", "score_tenths", alternatives_text().alias("alternatives"))


@query("separation", "SELECT case_id, facet, claim, CAST(rival_tenths AS BIGINT) AS rival_tenths, CAST(separation AS BIGINT) AS separation FROM {s_facet}")
def separation(get):
    return _conclusions(get).select("case_id", "facet", "claim", "rival_tenths", "separation")


@query("abstentions", "SELECT case_id, facet, abstentions FROM {s_abst}")
def abstentions(get):
    return (_conclusions(get).where(F.size("abstentions") > 0)
            .select("case_id", "facet", joined("abstentions").alias("abstentions")))


@query("emission_gate", """SELECT case_id, facet, claim, gate_score, gate_method, gate_tier, gate_uncontradicted,
       gate_separation, gate_passes FROM {s_conclusion}""")
def emission_gate(get):
    return _conclusions(get).select("case_id", "facet", "claim", "gate_score", "gate_method", "gate_tier",
                                    "gate_uncontradicted", "gate_separation", "gate_passes")


@query("support_band", "SELECT case_id, facet, band FROM {s_conclusion}")
def support_band(get):
    return _conclusions(get).select("case_id", "facet", "band")


def flat_conclusions(df):
    return df.select(
        "case_id", "facet", "claim", "band", "score_tenths", F.col("rubric_divisor").cast("bigint").alias("rubric_divisor"),
        joined("abstentions").alias("abstentions"), "best_tier", "method_label_emitted",
        alternatives_text().alias("alternatives"), joined("rule_ids").alias("rule_ids"))


FLAT_CONCLUSION_SQL = """SELECT case_id, facet, claim, band, score_tenths, divisor AS rubric_divisor, abstentions, best_tier,
       method_label_emitted, alternatives, rule_ids FROM {s_conclusion}"""


@query("conclusions", FLAT_CONCLUSION_SQL)
def conclusions(get):
    return flat_conclusions(_conclusions(get))
