"""Checks of the rule families (R) and of the whole evaluation."""

from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.checks import views_facts as VF
from provlake.checks import views_rules  # noqa: F401
from provlake.checks.q_scoring import flat_conclusions
from provlake.checks.registry import query
from provlake.plans import rules
from provlake.plans.evaluate import cite, emissions, evaluate

NAMES = {
    "scope": "rule_scope", "base": "rule_base", "lora": "rule_lora", "merged": "rule_merged", "dense": "rule_dense",
    "cpt": "rule_cpt", "distillation": "rule_distillation", "scratch": "rule_scratch", "rag": "rule_rag",
    "api": "rule_api", "compute": "rule_compute", "chronology": "rule_chronology", "params": "rule_params",
    "binding": "rule_binding", "cross_facet": "rule_cross_facet", "global_caps": "rule_global_caps",
}
COLUMNS = ["case_id", "emit_block", "emit_fact", "emit_step", "rule_id", "kind", "facet", "claim", "anchor",
           "achievement", "tier", "source_group", "fact_id"]


def inputs(get):
    return get("v_case"), VF.facts(get), VF.artifacts(get), VF.declared(get)


def _register(family, name):
    @query(name, f"SELECT {', '.join(COLUMNS)} FROM {{r_{family}_rows}}")
    def run(get):
        return emissions(*inputs(get), families=[family]).select(*COLUMNS)


for _family, _name in NAMES.items():
    assert _family in rules.CASE_FAMILIES
    _register(_family, _name)


@query("outcome_citation", """SELECT case_id, rule_id, kind, fact_id, source_group, artifact_sha256 FROM {r_cited}""")
def outcome_citation(get):
    e = emissions(*inputs(get))
    return cite(e, VF.artifacts(get)).select("case_id", "rule_id", "kind", "fact_id", "source_group", "artifact_sha256")


def evaluated(get):
    return evaluate(*inputs(get))


KINDS = ", ".join(f"'{k}'" for k in V.OUTCOME_KINDS)


def rescored(sql: str) -> str:
    """The scoring SQL over rule emissions instead of the scoring tables."""
    from provlake.checks.sqlviews import with_clause
    text = with_clause(sql)
    swap = {
        "s_in AS (SELECT * FROM v_outcome)": f"s_in AS (SELECT * FROM r_all WHERE kind IN ({KINDS}))",
        "s_cap AS (SELECT * FROM v_cap)": "s_cap AS (SELECT case_id, claim, anchor AS cap_id, rule_id AS triggered_by FROM r_all WHERE kind = 'cap_request')",
        "s_abstention AS (SELECT * FROM v_abstention)": "s_abstention AS (SELECT case_id, facet, anchor AS abstention_id FROM r_all WHERE kind = 'abstention_request')",
        "s_scope AS (SELECT * FROM v_scope)": "s_scope AS (SELECT case_id, facet FROM r_all WHERE kind = 'out_of_scope')",
    }
    for old, new in swap.items():
        text = text.replace(old, new)
    head = with_clause("SELECT * FROM {r_all}")
    head = head[: head.rindex("\nSELECT * FROM r_all")]
    # the rule views come first, then the scoring views that read them
    return head + ",\n" + text[len("WITH "):].replace("v_case AS (SELECT DISTINCT", "v_case_again AS (SELECT DISTINCT")


@query("evaluate_conclusions")
def evaluate_conclusions(get):
    """Facts to conclusions in one plan."""
    return flat_conclusions(evaluated(get).conclusions)


def _add_oracle():
    from provlake.checks.q_scoring import FLAT_CONCLUSION_SQL
    from provlake.checks.registry import ORACLES
    ORACLES["evaluate_conclusions"] = rescored(FLAT_CONCLUSION_SQL)


_add_oracle()
