"""From facts to conclusions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.operators import scoring
from provlake.operators.skew import context_join
from provlake.operators.verification import conflict_abstentions
from provlake.plans import rules
from provlake.plans.caseflags import case_flags, kinds_read, read_facts
from provlake.plans.emit import abstain, emitted
from provlake.session import small_methods
from provlake.sources.sink import staged, write_evidence

EVIDENCE_TABLES = ["outcomes", "cap_requests", "abstention_requests", "out_of_scope", "claim_scores", "conclusions"]


def loop_context(cases: DataFrame, loop: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per case: what a rule that walks over facts needs to know about the others."""
    cfg = F.col("kind") == "adapter_config"
    per_case = loop.groupBy("case_id").agg(
        F.count("*").alias("n_rows"), F.count(F.when(cfg, 1)).alias("n_configs"),
        F.max(F.when(cfg & F.col("num1").isNotNull(), F.struct("fact_seq", "num1")))["num1"].alias("declared_rank"),
        F.max(F.when(cfg & F.col("targets").isNotNull(), F.struct("fact_seq", "targets")))["targets"].alias("declared_targets"))
    stamped = artifacts.groupBy("case_id").agg(F.count("mtime").alias("n_mtime"))
    return (per_case.join(cases.select("case_id"), "case_id")
            .join(stamped, "case_id", "left").fillna({"n_mtime": 0}))


def emissions(cases: DataFrame, facts: DataFrame, artifacts: DataFrame, declared: DataFrame,
              families: list[str] | None = None, pinned_only: bool = False) -> DataFrame:
    """All rule emissions of the chosen families (every family by default)."""
    of_cases, of_facts = emission_parts(cases, facts, artifacts, declared, families, pinned_only)
    return of_cases if of_facts is None else of_cases.unionByName(of_facts)


def emission_parts(cases: DataFrame, facts: DataFrame, artifacts: DataFrame, declared: DataFrame,
                   families: list[str] | None = None, pinned_only: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Emissions of rules over the case row, at most a few hundred a case and lying where the case list has its case, and of rules over single facts."""
    small_methods(facts.sparkSession)
    chosen = families or list(rules.CASE_FAMILIES)
    specs = [s for f in chosen for s in (
        rules.global_caps(pinned_only) if f == "global_caps" else rules.CASE_FAMILIES[f]())]
    flags = case_flags(cases, facts, artifacts, declared, kinds_read(specs))
    out = emitted(flags, specs)

    looped, of_facts = [f for f in chosen if f in rules.FACT_FAMILIES], None
    if looped:
        wanted = [x for f in looped for x in rules.FACT_FAMILY_KINDS[f]]
        loop = read_facts(facts.where(F.col("kind").isin(wanted)))
        rows = (context_join(loop, loop_context(cases, loop, artifacts), "case_id", "n_rows", "fact_id")
                .where("n_rows IS NOT NULL")  # facts of cases outside the case list say nothing
                .withColumn("me", F.struct("fact_seq", "fact_id", "artifact_id", "source_group")))
        of_facts = emitted(rows, [s for f in looped for s in rules.FACT_FAMILIES[f]()])
    return out, of_facts


def cite(rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Attach the digest of the cited artifact; null when it was not hashed."""
    digests = artifacts.select("case_id", "artifact_id", F.col("sha256").alias("artifact_sha256"))
    return rows.join(digests, ["case_id", "artifact_id"], "left")


@dataclass
class EvidenceResult:
    """What an evaluation yields; every table is lazy and built when asked for."""

    cases: DataFrame
    artifacts: DataFrame
    emissions: DataFrame
    parts: tuple[DataFrame, DataFrame] | None = None  # the emissions that lie with their case, and the others, where that is known

    def _claim_rows(self) -> DataFrame:
        if self.parts is None:
            return scoring.claim_rows(self.cases, self.emissions)
        return scoring.claim_rows(self.cases, self.parts[1], self.parts[0])

    def _of(self, kind: str) -> DataFrame:
        return self.emissions.where(F.col("kind") == kind)

    @cached_property
    def outcomes(self) -> DataFrame:
        return cite(self.emissions.where(F.col("kind").isin(V.OUTCOME_KINDS)), self.artifacts)

    @cached_property
    def cap_requests(self) -> DataFrame:
        return self._of(V.CAP_REQUEST).selectExpr("case_id", "claim", "anchor AS cap_id", "rule_id AS triggered_by")

    @cached_property
    def abstention_requests(self) -> DataFrame:
        return self._of(V.ABSTENTION_REQUEST).selectExpr("case_id", "facet", "anchor AS abstention_id")

    @cached_property
    def out_of_scope(self) -> DataFrame:
        return self._of(V.OUT_OF_SCOPE).select("case_id", "facet")

    @cached_property
    def claim_scores(self) -> DataFrame:
        return scoring.score_table(self._claim_rows())

    @cached_property
    def conclusions(self) -> DataFrame:
        return scoring.conclusion_table(self._claim_rows())

    def save(self, path: str, version: int = V.RULESET_VERSION) -> None:
        """Evaluate once and save the six tables of the screen as one commit."""
        done = EvidenceResult(self.cases, self.artifacts, staged(self.emissions, "emissions"))
        # scores and conclusions are two readings of the same claim rows
        rows = staged(scoring.claim_rows(done.cases, done.emissions), "claim-rows")
        folded = {"claim_scores": scoring.score_table(rows), "conclusions": scoring.conclusion_table(rows)}
        write_evidence({name: folded[name] if name in folded else getattr(done, name) for name in EVIDENCE_TABLES}, path, version)


def conflicts(cases: DataFrame, artifacts: DataFrame, submissions: DataFrame) -> DataFrame:
    """Emissions of the cases whose files have another digest in one of ``submissions`` (case_id, path_alias, sha256, and hash_scope if known)."""
    columns = [c for c in ("case_id", "path_alias", "sha256", "hash_scope") if c in artifacts.columns and c in submissions.columns]
    asked = conflict_abstentions(artifacts.select(*columns).unionByName(submissions.select(*columns))).select("case_id").distinct()
    return emitted(cases.select("case_id").join(asked, "case_id", "left_semi"), [abstain(V.FACETS, "ABS-HASH-CONFLICT", "true")])


def evaluate(cases: DataFrame, facts: DataFrame, artifacts: DataFrame, declared: DataFrame,
             pinned_only: bool = False, submissions: DataFrame | None = None) -> EvidenceResult:
    """Screen every case.  Nothing runs until one of the tables is used.

    With the artifacts of other ``submissions`` of the cases, a file whose digests disagree makes its case abstain.
    """
    # the case list is dealt by case, so that what its rows emit lies there
    placed, others = emission_parts(cases.repartition("case_id"), facts, artifacts, declared, pinned_only=pinned_only)
    if submissions is not None:
        others = others.unionByName(conflicts(cases, artifacts, submissions))
    return EvidenceResult(cases, artifacts, placed.unionByName(others), (placed, others))
