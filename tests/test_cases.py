"""Golden and hard cases as fact rows, run through the whole evaluation."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from provlake import evaluate
from provlake import vocab as V
from provlake.operators.verification import corpus_violations
from provlake.schema import FACTS


def val(v):
    if isinstance(v, bool):
        return Row(i=None, num=None, s=None, b=v, l=None)
    if isinstance(v, int):
        return Row(i=v, num=None, s=None, b=None, l=None)
    if isinstance(v, list):
        return Row(i=None, num=None, s=None, b=None, l=v)
    return Row(i=None, num=None, s=v, b=None, l=None)


ADAPTER = ("adapter_config", dict(peft_type="LORA", r=16, target_modules=["q_proj", "v_proj"], base_model_name_or_path="org/b"))
PAIRS = ("adapter_tensor_set", dict(lora_pair_count=8, inferred_ranks=["16"], target_module_suffixes=["q_proj", "v_proj"]))
DENSE = ("tensor_header", dict(tensor_count=12, parameters=1200))
CONFIG = ("model_config", dict(model_type="llama", architecture="LlamaForCausalLM"))
REF = ("base_model_reference", dict(base_ref="org/b", revision_pinned=False))
STEPS = [("checkpoint_step", dict(step=s)) for s in (100, 200, 300)]
METRIC = ("training_metric", dict(entry_count=3, steps_monotonic=True))
TRACE = ("retrieval_trace", dict(entry_count=2, request_level_chain=True))

# name -> (artifact types, facts, declared)
CASES = {
    "unmerged_lora": (["peft_adapter_config", "safetensors", "trainer_state"], [ADAPTER, REF, PAIRS, CONFIG, METRIC] + STEPS, {}),
    "dense_logs": (["safetensors", "transformers_config"], [DENSE, CONFIG, METRIC, ("optimizer_record", {})] + STEPS, {}),
    "api_rag_no_weights": (["dependency_lockfile", "deployment_manifest", "retrieval_trace"],
                           [("sdk_dependency", dict(category="provider_sdk", name="x")), ("provider_endpoint", dict(host="h")), TRACE,
                            ("prompt_template", {}), ("retrieval_index", {})], dict(aug=["rag", "external_api_router"])),
    "merged_lora": (["safetensors", "model_card"], [DENSE, CONFIG, REF], dict(update="merged_adapter_consistent")),
    "cpt_final_only": (["safetensors"], [DENSE, CONFIG], dict(stage="continued_pretraining")),
    "scratch_final_only": (["safetensors"], [DENSE, CONFIG], dict(origin="random_initialization_claimed")),
    "quantised": (["safetensors"], [DENSE, CONFIG, ("quantization_record", {})], {}),
    "rank_mismatch": (["safetensors"], [("adapter_config", dict(r=32)), ("adapter_tensor_set", dict(lora_pair_count=8, inferred_ranks=["8"]))], {}),
    "one_step": (["safetensors"], [DENSE, ("training_metric", dict(entry_count=5))], {}),
    "copied_times": (["safetensors"] * 4, [ADAPTER], {}),
    "nothing": ([], [], {}),
}
IDS = {n: i for i, n in enumerate(CASES)}


@pytest.fixture(scope="module")
def result(spark):
    facts, arts, decl = [], [], []
    for name, (types, rows, d) in CASES.items():
        c = IDS[name]
        decl.append((c, d.get("origin"), d.get("update"), d.get("stage"), d.get("aug", [])))
        arts += [(c, f"A-{i}", t, f"{i:064d}", 1_700_000_000 if name == "copied_times" else 1_700_000_000 + i) for i, t in enumerate(types)]
        facts += [(c, i, f"F-{i}", k, "A-0", "dir::ROOT1", {n: val(v) for n, v in f.items()}) for i, (k, f) in enumerate(rows)]
    cases = spark.createDataFrame([(i,) for i in IDS.values()], "case_id bigint")
    a = (spark.createDataFrame(arts, "case_id bigint, artifact_id string, artifact_type string, sha256 string, t bigint")
         .withColumn("mtime", F.timestamp_seconds("t")))
    d = spark.createDataFrame(decl, "case_id bigint, weight_origin string, parameter_update string, training_stage string, inference_augmentation array<string>")
    res = evaluate(cases, spark.createDataFrame(facts, FACTS), a, d)
    names = {i: n for n, i in IDS.items()}
    concl = {(names[r.case_id], r.facet): r for r in res.conclusions.collect()}
    outs = [(names[r.case_id], r) for r in res.outcomes.collect()]
    return res, concl, outs


def fired(outs, case, kind=None):
    return {r.rule_id for n, r in outs if n == case and (kind is None or r.kind == kind)}


def test_every_case_has_four_conclusions(result):
    assert len(result[1]) == 4 * len(CASES)


@pytest.mark.parametrize("case", ["unmerged_lora", "dense_logs", "merged_lora", "cpt_final_only", "scratch_final_only", "one_step", "copied_times"])
def test_quiet_cases_raise_no_contradiction(result, case):
    assert fired(result[2], case, V.CONTRADICTION) == set()


def test_rank_mismatch_is_a_cited_contradiction(result):
    hits = [r for n, r in result[2] if n == "rank_mismatch" and r.kind == V.CONTRADICTION]
    assert [r.rule_id for r in hits] == ["CL-LORA-006"] and hits[0].fact_id == "F-1" and hits[0].artifact_sha256
    assert result[1]["rank_mismatch", "parameter_update"].band == V.BAND_CONTRADICTED


def test_required_abstentions(result):
    c = result[1]
    assert "ABS-CPT-FINAL-ONLY" in c["cpt_final_only", "training_stage"].abstentions
    assert "ABS-SCRATCH-NOMATCH-ONLY" in c["scratch_final_only", "weight_origin"].abstentions
    assert "ABS-QUANTIZED-ONLY" in c["quantised", "parameter_update"].abstentions


def test_no_method_is_named_from_weak_evidence(result):
    assert not any(r.method_label_emitted for r in result[1].values())


def test_scope_without_weights_and_without_files(result):
    c = result[1]
    assert c["api_rag_no_weights", "weight_origin"].band == V.BAND_NOT_SUPPLIED
    assert c["api_rag_no_weights", "parameter_update"].band == V.BAND_NOT_SUPPLIED
    assert {c["nothing", f].band for f in V.FACETS} == {V.BAND_NOT_SUPPLIED}


def test_single_step_flag_absent_is_not_disorder(result):
    assert "CL-DENSE-006" in fired(result[2], "one_step") and "CL-DENSE-007" not in fired(result[2], "one_step")


def test_copied_times_are_ambiguity_only(result):
    assert "CL-CHRONO-003" in fired(result[2], "copied_times", V.AMBIGUITY)


def test_corpus_query_finds_no_violation(spark, result):
    e = lambda rows, schema: spark.createDataFrame(rows, schema)
    bad = corpus_violations(
        result[0].conclusions, result[0].outcomes,
        e([(IDS["api_rag_no_weights"], "weight_origin", V.BAND_NOT_SUPPLIED)], "case_id bigint, facet string, band string"),
        e([(IDS["merged_lora"], "parameter_update")], "case_id bigint, facet string"),
        e([(IDS["quantised"], "parameter_update", "ABS-QUANTIZED-ONLY")], "case_id bigint, facet string, abstention_id string"),
        e([(IDS["copied_times"],)], "case_id bigint"))
    assert bad.collect() == []


def test_corpus_query_names_every_violation_and_reads_the_conclusions_once(spark):
    e = lambda rows, schema: spark.createDataFrame(rows, schema)
    c = spark.range(1, 3).select(F.col("id").alias("case_id"), F.lit("f").alias("facet"), F.lit("weak").alias("band"),
                                 (F.col("id") == 1).alias("method_label_emitted"), F.array(F.lit("A")).alias("abstentions"))
    bad = corpus_violations(
        c, e([(1, V.CONTRADICTION), (2, V.SUPPORT)], "case_id bigint, kind string"),
        e([(1, "f", "weak"), (2, "f", "strong"), (2, "f", None), (3, "f", "weak"), (3, "f", None)], "case_id bigint, facet string, band string"),
        e([(1, "f"), (1, "f"), (2, "f"), (3, "f"), (None, "f")], "case_id bigint, facet string"),
        e([(1, "f", "A"), (2, "f", "B"), (3, "f", "A"), (1, None, "A")], "case_id bigint, facet string, abstention_id string"),
        e([(1,), (2,)], "case_id bigint"))
    got = sorted((r.case_id, r.facet or "", r.violation) for r in bad.collect())
    assert got == sorted([(2, "f", "band"), (2, "f", "band"), (3, "f", "band"), (1, "f", "named"), (1, "f", "named"),
                          (2, "f", "abstention"), (3, "f", "abstention"), (1, "", "abstention"), (1, "", "contradiction")])
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
