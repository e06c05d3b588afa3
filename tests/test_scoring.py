"""Properties of scoring."""

import pytest
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.checks.sqlviews import spark_view
from provlake.operators import scoring as S


def test_vocabulary():
    assert set(V.DIVISOR.values()) == {100}
    assert len(V.CATALOGUE) == 135 and len(V.NEVER_EMITTED) == 16 and len(V.FACT_KINDS) == 35 and len(V.ARTIFACT_TYPES) == 26


def row(case, seq, rule, claim, anchor, ach, tier="E1", group="dir::a", kind=V.SUPPORT):
    return (case, 0, seq, 0, rule, kind, V.CLAIM_FACET[claim], claim, anchor, ach, tier, group)


SCHEMA = ("case_id bigint, emit_block int, emit_fact bigint, emit_step int, rule_id string, kind string, facet string, claim string, "
          "anchor string, achievement int, tier string, source_group string")


@pytest.fixture(scope="module")
def scores(spark):
    rows = [
        row(1, 1, "R1", "rag", "index", 70, group="dir::a"), row(1, 2, "R2", "rag", "index", 70, "E2", "dir::b"),
        row(2, 1, "R1", "rag", "index", 70), row(2, 1, "R1", "rag", "index", 70), row(2, 5, "M", "rag", "replay", 0, None, "", V.MISSING),
        row(3, 1, "R0", "rag", "index", 0), row(3, 2, "X", "rag", None, 0, None, "", V.CONTRADICTION),
        row(4, 1, "R1", "dense_finetune", "base", 100),
    ] + [row(5, i, "CL-RAG-001", "rag", a, 100, "E2") for i, (a, _) in enumerate(V.RUBRIC["rag"])]
    cases = spark.createDataFrame([(i,) for i in range(1, 7)], "case_id bigint")
    entries = S.entries(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(
        [(5, "rag", "CAP-NO-BASE", "T1"), (5, "rag", "CAP-QUESTIONNAIRE", "T2")], "case_id bigint, claim string, cap_id string, triggered_by string"))
    return {(r.case_id, r.claim): r for r in S.claim_scores(cases, entries).collect()}


def test_tie_goes_to_the_first_emission(scores):
    a = [x for x in scores[1, "rag"].anchors if x.anchor == "index"][0]
    assert (a.witness_rule, a.witness_tier) == ("R1", "E1") and scores[1, "rag"].raw_tenths == 140


def test_repeats_and_missing_anchors_change_nothing(scores):
    assert scores[2, "rag"].raw_tenths == scores[1, "rag"].raw_tenths == 140


def test_zero_support_takes_the_slot_and_contradiction_zeroes(scores):
    r = scores[3, "rag"]
    assert r.score_tenths == 0 and list(r.contradicted_by) == ["X"]
    assert [x.witness_rule for x in r.anchors if x.anchor == "index"] == ["R0"]


def test_anchor_outside_the_rubric_is_dropped(scores):
    assert scores[4, "dense_finetune"].raw_tenths == 0


def test_lowest_cap_wins_and_all_are_reported(scores):
    r = scores[5, "rag"]
    assert r.raw_tenths == 1000 and r.score_tenths == 250
    assert [c.cap_id for c in r.caps] == ["CAP-QUESTIONNAIRE", "CAP-NO-BASE", "CAP-SINGLE-SOURCE"]


def test_empty_case_has_all_scores(scores):
    assert len([1 for c, _ in scores if c == 6]) == 8 and len(scores) == 48


def test_order_of_rows_does_not_matter(spark, sf):
    o = spark_view(spark, sf, "v_outcome")
    cases = spark_view(spark, sf, "v_case")
    text = lambda df: sorted(map(str, S.conclusions(cases, S.entries(df)).collect()))
    assert text(o) == text(o.orderBy(F.rand(7)).repartition(5))


def test_all_bands_occur(spark):
    get = lambda v: spark_view(spark, "/root/testdata/sf0.01", v)
    c = S.conclusions(get("v_case"), S.entries(get("v_outcome"), get("v_cap"), get("v_abstention"), get("v_scope")))
    assert {r.band for r in c.select("band").distinct().collect()} == set(V.BAND_STRENGTH)


def test_what_is_folded_is_worked_out_before_the_rows_move(spark):
    stacked = spark.createDataFrame([row(1, 1, "R1", "rag", "index", 70)], SCHEMA)
    plan = S.claim_rows(spark.range(1, 3).select(F.col("id").alias("case_id")), stacked)._jdf.queryExecution().optimizedPlan().toString()
    folds = [x for x in plan.splitlines() if "Aggregate [case_id" in x and "collect_list(" in x]
    assert len(folds) == 1 and "CASE WHEN" not in folds[0]
