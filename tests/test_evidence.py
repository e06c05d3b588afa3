"""The evidence store, and digests of several submissions in the screen."""

import pytest
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.checks import views_facts as VF
from provlake.checks.sqlviews import spark_view
from provlake.operators.verification import conflict_abstentions, hash_conflict
from provlake.plans.evaluate import EVIDENCE_TABLES, EvidenceResult, evaluate
from provlake.sources.sink import committed, commits, read_evidence, staged, write_evidence

ARTIFACTS = "case_id bigint, path_alias string, sha256 string, hash_scope string"



def rows(df):
    return sorted(map(str, df.collect()))


def test_a_save_that_dies_leaves_the_last_one_whole(spark, tmp_path):
    where = str(tmp_path / "store")
    table = lambda n: spark.range(n).withColumn("ruleset_version", F.lit("mine"))
    write_evidence({"a": table(3), "b": table(4)}, where, 1)

    dying = table(9).where(F.raise_error(F.lit("lost")).isNull())
    with pytest.raises(Exception, match="lost"):
        write_evidence({"a": table(7), "b": dying}, where, 1)
    assert [read_evidence(spark, where, n, 1).count() for n in "ab"] == [3, 4]
    with pytest.raises(LookupError):
        read_evidence(spark, where, "a", 2)

    write_evidence({"a": table(5), "b": table(0)}, where, 1)
    write_evidence({"a": table(1)}, where, 2)
    assert [read_evidence(spark, where, n, 1).count() for n in "ab"] == [5, 0]
    assert read_evidence(spark, where, "b", 1).columns == ["id", "ruleset_version"] and read_evidence(spark, where, "a", 2).count() == 1
    with pytest.raises(LookupError):  # the last commit of a version names all of its tables
        read_evidence(spark, where, "b", 2)
    assert sorted(r.seq for r in commits(spark, where).collect()) == [1, 1, 2, 2, 3]


def test_nothing_to_save_and_a_taken_name(spark, tmp_path):
    assert committed(spark, str(tmp_path / "none")) == {}
    for tables in ({}, {"commits": spark.range(1)}):
        with pytest.raises(ValueError):
            write_evidence(tables, str(tmp_path / "x"))


def test_a_table_may_be_saved_over_what_it_is_read_from(spark, tmp_path):
    where = str(tmp_path / "store")
    write_evidence({"a": spark.range(3)}, where)
    for n in (6, 12):
        write_evidence({"a": (old := read_evidence(spark, where, "a")).unionAll(old)}, where)
        assert read_evidence(spark, where, "a").count() == n


def test_conflicts_are_between_digests_that_should_agree(spark):
    out = V.OUT_OF_SCOPE_PATH
    arts = spark.createDataFrame([
        (1, "ROOT1/a", "x", "full"), (1, "ROOT1/a", "x", "full"), (1, "ROOT1/a", "y", "full"), (1, "ROOT1/b", "x", "full"),
        (2, "ROOT1/a", "x", "full"), (2, "ROOT1/a", "y", "head_only"), (2, "ROOT1/a", None, "none"), (3, out, "x", "full"), (3, out, "y", "full"),
        (4, None, "x", "full"), (4, None, "y", "full")], ARTIFACTS)
    assert [tuple(r) for r in hash_conflict(arts).collect()] == [(1, "ROOT1/a", 2, "ABS-HASH-CONFLICT")]
    assert sorted(tuple(r) for r in conflict_abstentions(arts).collect()) == sorted((1, f, "ABS-HASH-CONFLICT") for f in V.FACETS)
    assert sorted(r.case_id for r in conflict_abstentions(arts.drop("hash_scope"), ["weight_origin"]).collect()) == [1, 2]
    assert conflict_abstentions(spark.createDataFrame([], ARTIFACTS)).count() == 0


@pytest.fixture(scope="module")
def inputs(spark, sf):
    get = lambda v: spark_view(spark, sf, v)
    cases = get("v_case").where("case_id < 12")
    arts = VF.artifacts(get).withColumn("path_alias", F.concat(F.lit("ROOT1/"), "artifact_id"))
    return tuple(t.join(cases, "case_id", "left_semi") for t in (cases, VF.facts(get), arts, VF.declared(get)))


def test_a_case_with_a_conflict_abstains_and_others_do_not(spark, inputs):
    cases, facts, arts, declared = inputs
    hashed = arts.where("sha256 IS NOT NULL")
    which = hashed.orderBy("case_id").first().case_id
    other = hashed.select("case_id", "path_alias", F.when(F.col("case_id") == which, F.lit("changed")).otherwise(F.col("sha256")).alias("sha256"))
    stranger = spark.createDataFrame([(999, "ROOT1/z", "1"), (999, "ROOT1/z", "2")], "case_id bigint, path_alias string, sha256 string")
    plain = {(r.case_id, r.facet): r for r in evaluate(cases, facts, arts, declared).conclusions.collect()}
    seen = {(r.case_id, r.facet): r for r in evaluate(cases, facts, arts, declared, submissions=other.unionByName(stranger)).conclusions.collect()}
    assert seen.keys() == plain.keys()
    for key, r in seen.items():
        if key[0] == which:
            assert "ABS-HASH-CONFLICT" in r.abstentions and r.band in (V.BAND_INSUFFICIENT, V.BAND_CONTRADICTED, V.BAND_NOT_SUPPLIED)
            assert r.score_tenths == plain[key].score_tenths
        else:
            assert r == plain[key]


def test_a_result_is_saved_whole_and_evaluated_once(spark, inputs, tmp_path):
    result = evaluate(*inputs)
    result.save(str(tmp_path / "store"))
    assert set(committed(spark, str(tmp_path / "store"))) == set(EVIDENCE_TABLES) and len(EVIDENCE_TABLES) == 6
    again = EvidenceResult(result.cases, result.artifacts, staged(result.emissions, "again"))  # a second evaluation, done once
    for name in EVIDENCE_TABLES:
        assert rows(read_evidence(spark, str(tmp_path / "store"), name)) == rows(getattr(again, name)), name


def test_conclusions_are_worked_out_once_for_both_saves(spark, sf, monkeypatch):
    """The second save worked them out anew, which doubled all shuffles."""
    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    from provlake.checks import q_scoring

    seen = spark.sparkContext.accumulator(0)

    def band(case_id):
        seen.add(1)
        return "none"

    rows = spark.range(10).select(F.col("id").alias("case_id"), F.lit("f").alias("facet"), F.udf(band)("id").alias("band"), F.lit(1).alias("score_tenths"))
    monkeypatch.setattr(q_scoring, "_conclusions", lambda get: rows)
    assert entry.queries()["write_evidence"](spark, sf).count() == 10
    assert seen.value == 10


def test_a_save_folds_the_claim_rows_once(spark, tmp_path, monkeypatch):
    from provlake.operators import scoring

    get, calls, fold = lambda v: spark_view(spark, "/root/testdata/sf0.001", v), [], scoring.claim_rows
    result = evaluate(get("v_case"), VF.facts(get), VF.artifacts(get), VF.declared(get))
    cases = result.cases.where("case_id < 3")
    result = EvidenceResult(cases, result.artifacts, staged(result.emissions.where("case_id < 3"), "few"))
    monkeypatch.setattr(scoring, "claim_rows", lambda *a: calls.append(1) or fold(*a))
    result.save(str(tmp_path / "once"))
    assert len(calls) == 1
    for name in ("claim_scores", "conclusions"):
        assert rows(read_evidence(spark, str(tmp_path / "once"), name)) == rows(getattr(result, name))


def test_sessions_made_elsewhere_run_rules_as_small_methods(spark, sf):
    """HotSpot compiles no method above 8,000 bytes; Spark's own limit lets stages of rules become such methods."""
    from provlake.checks import QUERIES

    limit, own = "spark.sql.codegen.hugeMethodLimit", spark.newSession()
    for stated, used in (("65535", "8000"), ("20000", "20000")):
        own.conf.set(limit, stated)
        QUERIES["outcome_citation"](own, sf)
        assert own.conf.get(limit) == used


def test_what_case_rows_emit_stays_with_its_case(spark, inputs):
    """All emissions moved twice on their way to the conclusions; those of rules over the case row need not move at all."""
    result = evaluate(*inputs)
    moves = []

    def walk(node, above):
        name = node.nodeName()
        if name == "Generate" and "targets#" in node.output().toString():  # the rules as rows
            moves.append(above)
        for i in range(node.children().size()):
            walk(node.children().apply(i), above + (name == "Exchange"))

    walk(result.conclusions.select("*")._jdf.queryExecution().executedPlan().initialPlan(), 0)
    assert min(moves) == 0
    whole = EvidenceResult(result.cases, result.artifacts, result.emissions)  # the same, with nothing known of where rows lie
    for name in ("conclusions", "claim_scores"):
        assert rows(getattr(result, name)) == rows(getattr(whole, name)), name
