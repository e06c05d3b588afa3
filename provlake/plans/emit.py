"""Declaring rule emissions as SQL predicates.

A rule is a predicate and constants; a family is a list of them.  Families are
evaluated together in one projection over the case row (or over the facts a
rule speaks about), which becomes rows by ``inline``: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.functions.dims import rows_text, text

_TARGET = ["facet", "claim", "anchor"]


def _row(block, step, rule, kind, when, targets=None, achievement="0", tier=None, fact=None) -> str:
    """SQL text of one emission; ``targets`` are (facet, claim, anchor) triples, one row each.

    ``fact`` names a struct with the cited fact; a rule citing a fact fires only
    when the fact is there.
    """
    cited = (lambda n, t: f"cast({fact}.{n} as {t})") if fact else (lambda n, t: f"cast(null as {t})")
    cond = f"({when}) AND {fact}.fact_id IS NOT NULL" if fact else when
    marks = rows_text(targets or [(None, None, None)], _TARGET)
    return f"""CASE WHEN {cond} THEN named_struct(
      'emit_block', {block}, 'emit_fact', coalesce({cited('fact_seq', 'bigint')}, 0L), 'step', {step},
      'rule_id', cast({text(rule)} as string), 'kind', {text(kind)},
      'targets', cast({marks} as array<struct<facet:string,claim:string,anchor:string>>),
      'achievement', cast({achievement} as int), 'tier', cast({text(tier)} as string),
      'source_group', coalesce({cited('source_group', 'string')}, ''),
      'fact_id', {cited('fact_id', 'string')}, 'artifact_id', {cited('artifact_id', 'string')}) END"""


def _claims(claims) -> list[tuple]:
    """``[(claim, anchor), ...]`` with each claim's own facet."""
    return [(V.CLAIM_FACET[c], c, a) for c, a in claims]


def support(block, step, rule, claims, achievement, tier, fact, when="true") -> str:
    return _row(block, step, rule, V.SUPPORT, when, _claims(claims), achievement, tier, fact)


def statement(block, step, rule, when, claim=None, fact=None) -> str:
    """Supporting outcome that feeds no anchor."""
    return _row(block, step, rule, V.SUPPORT, when, _claims([(claim, None)]) if claim else None, fact=fact)


def missing(block, step, rule, claims, when) -> str:
    return _row(block, step, rule, V.MISSING, when, _claims(claims))


def contradict(block, step, rule, facet, claim, fact, when="true") -> str:
    return _row(block, step, rule, V.CONTRADICTION, when, [(facet, claim, None)], fact=fact)


def ambiguity(block, step, rule, when) -> str:
    return _row(block, step, rule, V.AMBIGUITY, when)


def limitation(block, step, rule, when="true") -> str:
    return _row(block, step, rule, V.LIMITATION, when)


def request(block, step, rule, when="true", times: int = 1) -> str:
    return _row(block, step, rule, V.REQUEST, when, [(None, None, None)] * times)


def cap(rule, claims, cap_id, when) -> str:
    return _row(0, 0, rule, V.CAP_REQUEST, when, [(V.CLAIM_FACET[c], c, cap_id) for c in claims])


def abstain(facets, abstention, when) -> str:
    return _row(0, 0, None, V.ABSTENTION_REQUEST, when, [(f, None, abstention) for f in facets])


def out_of_scope(facets, when) -> str:
    return _row(0, 0, None, V.OUT_OF_SCOPE, when, [(f, None, None) for f in facets])


def emitted(rows: DataFrame, specs: list[str]) -> DataFrame:
    """Evaluate the declared emissions over each row."""
    return (
        # array_compact keeps the long list of rules out of generated code, where compiling it dominates
        rows.selectExpr("case_id", "inline(array_compact(array(" + ",\n".join(specs) + ")))")
        .select("*", F.posexplode("targets").alias("pos", "t"))
        .selectExpr("case_id", "emit_block", "emit_fact", "step * 10 + pos AS emit_step", "rule_id", "kind",
                    "t.facet", "t.claim", "t.anchor", "achievement", "tier", "source_group", "fact_id", "artifact_id")
    )
