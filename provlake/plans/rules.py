"""The rule families, declared over the case row or over the facts they speak about.

Predicates are SQL text over the columns of :mod:`provlake.plans.caseflags`:
``x.n`` facts of a kind, ``x.first`` the first of them, ``x.hit`` the first one
that the kind's search accepts.  Block numbers give the emission order that
decides ties between equally strong witnesses: family, then block in the
family, then fact, then step.
"""

from __future__ import annotations

from provlake import vocab as V
from provlake.functions.dims import text
from provlake.plans import emit as E

BASE_ANCHORS = [(c, "exact_base" if c == "merged_adapter" else "base") for c in V.BASE_DEPENDENT]
BASE_CONSISTENCY = [(c, "base_consistency") for c in V.BASE_DEPENDENT]
STRUCTURE = [("unmerged_lora", "structure")]


def n(kind: str) -> str:
    return f"coalesce(k_{kind}.n, 0L)"


def has(kind: str) -> str:
    return f"({n(kind)} > 0)"


def lacks(kind: str) -> str:
    return f"({n(kind)} = 0)"


def found(kind: str) -> str:
    return f"(k_{kind}.hit.fact_id IS NOT NULL)"


def first(kind: str) -> str:
    return f"k_{kind}.first"


def declared(column: str, *names: str) -> str:
    return f"coalesce({column} IN ({', '.join(text(x) for x in names)}), false)"


def augments(name: str) -> str:
    return f"coalesce(array_contains(inference_augmentation, {text(name)}), false)"


TRAINS = f"({declared('weight_origin', *V.TRAINED_ORIGINS)} OR {declared('parameter_update', *V.TRAINED_UPDATES)})"
STEPS = "n_steps"
# parameter sum over container headers; null when no header states one
SEEN = ("if(k_tensor_header.num_sum IS NULL, null, "
        "least(k_tensor_header.num_sum, cast(9223372036854775807 as decimal(38,0))))")


def scope() -> list[str]:
    none, unweighted = "n_artifacts = 0", "n_artifacts > 0 AND NOT has_weights"
    return [
        E.limitation(0, 1, "CL-INV-007", none),
        E.out_of_scope(V.FACETS, none),
        E.limitation(0, 2, "CL-INV-007", unweighted),
        E.out_of_scope(["weight_origin", "parameter_update"], unweighted),
        E.limitation(0, 3, "CL-INV-008", "n_artifacts > 0 AND only_text"),
        E.limitation(0, 4, "CL-FMT-006", "n_opaque > 0"),
    ]


def base() -> list[str]:
    a, b = "k_adapter_config.hit.text1", "k_model_config.hit.text1"
    unnamed = lacks("base_model_reference")
    return [
        E.support(12, 1, "CL-BASE-005", BASE_CONSISTENCY, 60, "E1", first("model_config"), "k_model_config.first.flag"),
        E.support(13, 1, "CL-BASE-007", BASE_CONSISTENCY, 40, "E1", first("tokenizer_identity")),
        E.contradict(14, 1, "CL-BASE-004", "weight_origin", None, first("adapter_config"), f"{a} <> {b} AND {a} <> '' AND {b} <> ''"),
        E.missing(15, 1, "CL-BASE-003", BASE_ANCHORS, unnamed),
        E.abstain(["weight_origin", "parameter_update"], "ABS-BASE-UNKNOWN", unnamed),
        E.request(15, 2, "CL-BASE-001", "k_base_model_reference.n > 0 AND NOT k_base_model_reference.any_flag",
                  times=len(V.BASE_DEPENDENT)),
    ]


def lora() -> list[str]:
    no_config, no_sets = lacks("adapter_config"), lacks("adapter_tensor_set")
    some = f"NOT ({no_config} AND {no_sets})"
    share = first("trainable_parameter_record")
    part, whole = f"cast({share}.num1 as decimal(30,0))", f"cast({share}.num2 as decimal(30,0))"
    partial = f"{whole} > 0 AND {part} > 0 AND {part} < {whole}"
    small = f"{part} * 10000 < {whole} * 501"
    load = [("unmerged_lora", "load_or_remerge_record")]
    return [
        E.missing(22, 1, "CL-LORA-007", STRUCTURE, f"{has('adapter_config')} AND {no_sets}"),
        E.support(23, 1, "CL-LORA-008", STRUCTURE, 40, "E2", first("adapter_tensor_set"), no_config),
        E.ambiguity(23, 2, "CL-LORA-008", f"{no_config} AND {has('adapter_tensor_set')}"),
        E.support(24, 1, "CL-LORA-013", load, 100, "E1", "load_record"),
        E.missing(24, 2, "CL-LORA-014", load, f"load_record.fact_id IS NULL AND {some}"),
        E.support(25, 1, "CL-LORA-015", [("unmerged_lora", "base_consistency")], 80, "E1", share, f"{partial} AND {small}"),
        E.ambiguity(25, 2, "CL-LORA-016", f"{partial} AND NOT {small}"),
        E.contradict(25, 3, "CL-LORA-016", "parameter_update", "unmerged_lora", share, f"{whole} > 0 AND {part} >= {whole}"),
        E.limitation(26, 1, "CL-LORA-012", some),
    ]


def merged() -> list[str]:
    on = (f"({declared('parameter_update', 'merged_adapter_consistent')} OR "
          f"(coalesce(k_tensor_header.num_max > 0, false) AND {lacks('adapter_tensor_set')}))")
    quantised = f"{on} AND {has('quantization_record')}"
    exact, adapter = [("merged_adapter", "exact_base")], [("merged_adapter", "pre_merge_adapter")]
    return [
        E.support(30, 1, "CL-MERGE-001", exact, 60, "E2", first("tensor_header"), on),
        E.support(30, 2, "CL-MERGE-004", exact, 80, "E2", first("tensor_header"),
                  f"{on} AND {has('model_config')} AND {has('tokenizer_identity')}"),
        E.support(31, 1, "CL-MERGE-002", adapter, 70, "E1", first("merge_record"), on),
        E.support(32, 1, "CL-MERGE-003", adapter, 100, "E2", first("adapter_tensor_set"), f"{on} AND {has('tensor_header')}"),
        E.missing(33, 1, "CL-MERGE-005", [("merged_adapter", "delta_pattern")], on),
        E.request(33, 2, "CL-MERGE-006", on),
        E.cap("CL-MERGE-006", ["merged_adapter"], "CAP-MERGE-UNREPRO", on),
        E.limitation(33, 3, "CL-MERGE-007", quantised),
        E.abstain(["parameter_update"], "ABS-QUANTIZED-ONLY", quantised),
    ]


def dense() -> list[str]:
    header, pre_post, progression = first("tensor_header"), [("dense_finetune", "pre_post")], [("dense_finetune", "progression")]
    return [
        E.support(40, 1, "CL-DENSE-001", pre_post, 100, "E2", header, has("base_model_reference")),
        E.support(40, 2, "CL-DENSE-002", pre_post, 20, "E2", header, lacks("base_model_reference")),
        E.support(41, 1, "CL-DENSE-003", [("dense_finetune", "optimizer_trainability")], 100, "E1", first("optimizer_record")),
        E.support(42, 1, "CL-DENSE-004", progression, 100, "E1", first("checkpoint_step"), f"{STEPS} >= 2"),
        E.missing(42, 2, "CL-DENSE-005", progression, f"{STEPS} < 2 AND {has('tensor_header')}"),
        E.request(44, 1, "CL-DENSE-008"),
        E.limitation(44, 2, "CL-DENSE-009", has("tensor_header")),
    ]


def continued_pretraining() -> list[str]:
    goal, corpus = has("training_objective"), has("dataset_manifest")
    on = f"({declared('training_stage', 'continued_pretraining')} OR {goal} OR {corpus})"
    bare = f"{on} AND NOT ({goal} OR {corpus} OR {has('optimizer_record')} OR {has('training_metric')})"
    aimless = f"{on} AND NOT ({goal} OR {corpus}) AND ({has('optimizer_record')} OR {has('training_metric')})"
    data, claim = [("continued_pretraining", "objective_data_tokens")], "continued_pretraining"
    tokens = f"if({has('token_count_record')} OR coalesce(k_dataset_manifest.first.flag, false), 100, 60)"
    return [
        E.support(50, 1, "CL-CPT-001", data, 45, "E1", first("training_objective"), on),
        E.support(51, 1, "CL-CPT-002", data, tokens, "E1", first("dataset_manifest"), on),
        E.support(52, 1, "CL-CPT-003", data, 55, "E1", first("tokenizer_identity"), f"{on} AND k_tokenizer_identity.first.flag"),
        E.support(53, 1, "CL-CPT-004", [(claim, "optimizer")], 100, "E1", first("optimizer_record"), on),
        E.support(54, 1, "CL-CPT-005", [(claim, "trajectory")], 100, "E1", first("training_metric"), on),
        E.limitation(55, 1, "CL-CPT-006", on),
        E.missing(56, 1, "CL-CPT-007", data, bare),
        E.abstain(["training_stage"], "ABS-CPT-FINAL-ONLY", bare),
        E.cap("CL-CPT-007", [claim], "CAP-CPT-NO-OBJ", bare),
        E.cap("CL-CPT-006", [claim], "CAP-CPT-NO-OBJ", aimless),
    ]


def distillation() -> list[str]:
    on = (f"({declared('training_stage', 'distillation')} OR {declared('weight_origin', 'distilled_from_teacher')}"
          f" OR {has('teacher_reference')})")
    pinned = "coalesce(k_teacher_reference.first.flag, false)"
    bare = f"{on} AND {lacks('teacher_reference')} AND {lacks('teacher_output_cache')}"
    one = lambda anchor: [("distillation", anchor)]
    return [
        E.support(60, 1, "CL-DIST-001", one("teacher"), 100, "E1", first("teacher_reference"), f"{on} AND {pinned}"),
        E.support(60, 2, "CL-DIST-002", one("teacher"), 30, "E1", first("teacher_reference"), f"{on} AND NOT {pinned}"),
        E.support(61, 1, "CL-DIST-003", one("objective"), 100, "E1", first("training_objective"),
                  f"{on} AND lower(k_training_objective.first.text1) RLIKE 'kl|kd|distill|soft_target|logit'"),
        E.support(62, 1, "CL-DIST-004", one("teacher_outputs"), 100, "E1", first("teacher_output_cache"), on),
        E.support(63, 1, "CL-DIST-006", one("trajectory"), 100, "E1", first("training_metric"), on),
        E.limitation(64, 1, "CL-DIST-007", on),
        E.abstain(["training_stage"], "ABS-DISTILL-STYLE-ONLY", bare),
        E.cap("CL-DIST-007", ["distillation"], "CAP-CPT-NO-OBJ", bare),
        E.request(64, 2, "CL-DIST-008", bare),
    ]


def scratch() -> list[str]:
    on = declared("weight_origin", "random_initialization_claimed")
    zero = "coalesce(step_min = 0, false)"
    one = lambda anchor: [("scratch", anchor)]
    return [
        E.support(70, 1, "CL-SCRATCH-001", one("step_zero"), 100, "E1", first("checkpoint_step"), f"{on} AND {zero}"),
        E.missing(70, 2, "CL-SCRATCH-009", one("step_zero"), f"{on} AND NOT {zero}"),
        E.cap("CL-SCRATCH-009", ["scratch"], "CAP-SCRATCH-NO-ZERO", f"{on} AND NOT {zero}"),
        E.support(71, 1, "CL-SCRATCH-002", one("trajectory"), 100, "E1", first("checkpoint_step"), f"{on} AND {STEPS} >= 3"),
        E.support(72, 1, "CL-SCRATCH-003", one("optimizer_data_order"), f"if({has('seed_record')}, 100, 60)", "E1",
                  first("optimizer_record"), on),
        E.support(73, 1, "CL-SCRATCH-004", one("identity"), 100, "E1", first("training_objective"), on),
        E.support(74, 1, "CL-SCRATCH-005", one("data_tokenizer"), 70, "E1", first("dataset_manifest"), on),
        E.support(75, 1, "CL-SCRATCH-007", one("compute_jobs"), 100, "E1", first("hardware_record"), on),
        E.limitation(76, 1, "CL-SCRATCH-010", on),
        E.abstain(["weight_origin"], "ABS-SCRATCH-NOMATCH-ONLY", f"{on} AND NOT {zero} AND {STEPS} < 3"),
        E.statement(76, 2, "CL-SCRATCH-011", on),
        E.statement(76, 3, "CL-SCRATCH-012", on),
        E.ambiguity(76, 4, "CL-SCRATCH-013", f"{on} AND {has('tokenizer_identity')} AND {lacks('dataset_manifest')}"),
        E.contradict(77, 1, "CL-XFACET-003", "weight_origin", "scratch", "k_adapter_config.hit", on),
    ]


def rag() -> list[str]:
    on = f"({augments('rag')} OR {has('retrieval_index')} OR {has('retrieval_trace')})"
    chain, index = [("rag", "retrieval_trace")], [("rag", "index")]
    return [
        E.support(80, 1, "CL-RAG-002", index, 100, "E1", first("retrieval_index"), on),
        E.limitation(80, 2, "CL-RAG-007", f"{on} AND {has('retrieval_index')}"),
        E.support(81, 1, "CL-RAG-003", index, 70, "E1", first("embedding_model"), on),
        E.support(82, 1, "CL-RAG-005", [("rag", "prompt_assembly")], 100, "E1", first("prompt_template"), on),
        E.support(83, 1, "CL-RAG-001", chain, 100, "E2", "k_retrieval_trace.hit", on),
        E.support(83, 2, "CL-RAG-001", chain, 40, "E1", first("retrieval_trace"), f"{on} AND NOT {found('retrieval_trace')}"),
        E.missing(83, 3, "CL-RAG-001", chain, f"{on} AND {lacks('retrieval_trace')}"),
        E.statement(84, 1, "CL-RAG-008", on),
    ]


def external_api() -> list[str]:
    called = f"{has('provider_endpoint')} OR {found('sdk_dependency')} OR {has('outbound_request_trace')}"
    on = f"({augments('external_api_router')} OR {called})"
    seen = f"{on} AND ({called} OR {has('serving_config')})"
    one = lambda anchor: [("external_api", anchor)]
    return [
        E.support(90, 1, "CL-API-001", one("config"), 100, "E1", first("provider_endpoint"), on),
        E.support(91, 1, "CL-API-002", one("config"), 60, "E1", "k_sdk_dependency.hit", on),
        E.support(92, 1, "CL-API-003", one("observed_egress"), 100, "E1", first("outbound_request_trace"), on),
        E.support(93, 1, "CL-API-004", one("binding"), 100, "E1", first("serving_config"), on),
        E.support(94, 1, "CL-API-005", one("other"), 100, "E2", "caller", f"{on} AND NOT local_weights"),
        E.ambiguity(94, 2, "CL-API-010", f"{on} AND local_weights AND {has('provider_endpoint')} AND {TRAINS}"),
        E.limitation(95, 1, "CL-API-006", seen),
        E.limitation(95, 2, "CL-API-007", seen),
        E.limitation(95, 3, "CL-API-008", seen),
        E.request(95, 4, "CL-API-009", seen),
        E.cap("CL-API-006", V.WEIGHT_CLAIMS, "CAP-API-ONLY", f"{seen} AND {TRAINS} AND NOT local_weights"),
    ]


def compute() -> list[str]:
    wide, f = "decimal(38,0)", V.COMPUTE_BAND_FACTOR
    params = f"coalesce({SEEN}, cast(k_compute_record.first.num1 as {wide}))"
    tokens = f"cast(k_token_count_record.first.num1 as {wide})"
    known = f"({params} IS NOT NULL AND {tokens} IS NOT NULL)"
    # a product past 38 digits reads as null: larger than any declared value
    expected = f"try_multiply(try_multiply({params}, {tokens}), cast(6 as {wide}))"
    flops = f"cast(k_compute_record.first.num2 as {wide})"
    low = f"coalesce(NOT if({expected} >= 0, {expected} < {f} * ({flops} + 1), {f} * {flops} >= {expected}), true)"
    high = f"coalesce({flops} > try_multiply({expected}, cast({f} as {wide})), false)"
    given = f"{known} AND {flops} IS NOT NULL"
    jobs = [("scratch", "compute_jobs")]
    return [
        E.missing(100, 1, "CL-COMPUTE-004", jobs, f"NOT {known}"),
        E.support(100, 2, "CL-COMPUTE-001", jobs, 60, "E1", first("compute_record"), f"{given} AND NOT {low} AND NOT {high}"),
        E.ambiguity(100, 3, "CL-COMPUTE-002", f"{given} AND {low}"),
        E.ambiguity(100, 4, "CL-COMPUTE-003", f"{given} AND NOT {low} AND {high}"),
        E.limitation(100, 5, "CL-COMPUTE-005", known),
    ]


def chronology() -> list[str]:
    return [
        E.ambiguity(110, 1, "CL-CHRONO-003", "n_mtime > 3 AND mtime_min = mtime_max"),
        E.limitation(112, 1, "CL-CHRONO-005", "n_mtime > 0"),
    ]


def parameters() -> list[str]:
    said = "cast(k_model_config.num_first.num1 as decimal(30,0))"
    near = f"abs({SEEN} - {said}) * 50 <= {said}"
    pre_post, cfg = [("dense_finetune", "pre_post")], first("model_config")
    return [
        E.support(120, 1, "CL-PARAM-001", pre_post, 30, "E2", first("tensor_header"), f"{SEEN} IS NOT NULL"),
        E.support(121, 1, "CL-PARAM-002", pre_post, 70, "E2", cfg, f"{said} > 0 AND {near}"),
        E.contradict(121, 2, "CL-PARAM-003", "parameter_update", None, cfg, f"{said} > 0 AND NOT {near}"),
        E.limitation(122, 1, "CL-PARAM-004", f"{SEEN} IS NOT NULL AND {has('quantization_record')}"),
    ]


def binding() -> list[str]:
    inside, pinned = found("artifact_reference"), found("container_manifest")
    outside = f"{has('artifact_reference')} AND NOT {inside} AND NOT {pinned}"
    return [
        E.support(130, 1, "CL-BIND-001", V.BINDABLE, 100, "E1", "k_artifact_reference.hit"),
        E.support(130, 2, "CL-BIND-002", V.BINDABLE, 100, "E1", "k_container_manifest.hit", f"NOT {inside}"),
        E.support(130, 3, "CL-BIND-003", V.BINDABLE, 20, "E1", first("artifact_reference"), outside),
        E.limitation(130, 4, "CL-BIND-003", outside),
        E.abstain(V.FACETS, "ABS-NO-BINDING", outside),
        E.missing(130, 5, "CL-BIND-004", V.BINDABLE, f"{lacks('artifact_reference')} AND NOT {pinned}"),
        E.limitation(131, 1, "CL-BIND-005"),
    ]


def cross_facet() -> list[str]:
    return [
        E.contradict(140, 1, "CL-XFACET-002", "parameter_update", None, "adapter",
                     declared("parameter_update", "no_update_observed")),
        E.ambiguity(141, 1, "CL-XFACET-004", f"{augments('local_direct_inference')} AND {has('provider_endpoint')}"),
        E.statement(142, 1, "CL-XFACET-001",
                    "coalesce(weight_origin, parameter_update, training_stage) IS NOT NULL OR size(inference_augmentation) > 0"),
    ]


def global_caps(pinned_only: bool = False) -> list[str]:
    """``pinned_only`` asks for a pinned base; by default a named base already lifts the cap."""
    exact = "coalesce(k_base_model_reference.any_flag, false)" if pinned_only else has("base_model_reference")
    trajectory = f"({n('checkpoint_step')} >= 2 OR {has('training_metric')})"
    return [
        E.cap("CL-INV-008", V.WEIGHT_CLAIMS, "CAP-QUESTIONNAIRE", "NOT structural"),
        E.cap("CL-BASE-003", V.NO_BASE_CLAIMS, "CAP-NO-BASE", f"structural AND NOT {exact} AND NOT {trajectory}"),
        E.limitation(150, 1, "CL-MERGE-007", f"{has('quantization_record')} AND {lacks('adapter_tensor_set')}"),
    ]


CASE_FAMILIES = {
    "scope": scope, "base": base, "lora": lora, "merged": merged, "dense": dense,
    "cpt": continued_pretraining, "distillation": distillation, "scratch": scratch, "rag": rag,
    "api": external_api, "compute": compute, "chronology": chronology, "params": parameters,
    "binding": binding, "cross_facet": cross_facet, "global_caps": global_caps,
}

# --- families that speak about every fact of a kind; ``me`` is the fact itself ---


def base_facts() -> list[str]:
    ref = "kind = 'base_model_reference'"
    return [
        E.support(10, 1, "CL-BASE-001", BASE_ANCHORS, 100, "E1", "me", f"{ref} AND flag"),
        E.support(10, 2, "CL-BASE-002", BASE_ANCHORS, 30, "E1", "me", f"{ref} AND NOT flag"),
        E.support(11, 1, "CL-BASE-009", BASE_CONSISTENCY, 100, "E2", "me", "kind = 'tensor_header' AND flag"),
    ]


def lora_facts() -> list[str]:
    cfg, sets = "kind = 'adapter_config'", "kind = 'adapter_tensor_set'"
    ranks = "coalesce(size(list2), 0)"
    one = f"{sets} AND {ranks} = 1 AND list2[0] RLIKE '^[+-]?[0-9]+$' AND try_cast(list2[0] AS bigint)"
    several = f"{sets} AND {ranks} > 1 AND declared_rank IS NOT NULL"
    overlap = "exists(targets, t -> exists(declared_targets, d -> contains(t, d) OR contains(d, t)))"
    return [
        E.support(20, 1, "CL-LORA-001", STRUCTURE, 45, "E1", "me", cfg),
        E.support(20, 2, "CL-LORA-009", STRUCTURE, 60, "E1", "me", f"{cfg} AND {ranks} > 0"),
        E.statement(20, 3, "CL-LORA-010", f"{cfg} AND flag", "unmerged_lora", "me"),
        E.support(21, 1, "CL-LORA-002", STRUCTURE, 75, "E2", "me", f"{sets} AND num1 > 0"),
        E.support(21, 2, "CL-LORA-003", STRUCTURE, 100, "E2", "me", f"{one} = declared_rank"),
        E.contradict(21, 3, "CL-LORA-006", "parameter_update", "unmerged_lora", "me", f"{one} <> declared_rank"),
        E.ambiguity(21, 4, "CL-LORA-011", several),
        E.support(21, 5, "CL-LORA-002", STRUCTURE, 75, "E2", "me", several),
        E.support(21, 6, "CL-LORA-004", STRUCTURE, 90, "E2", "me", f"{sets} AND {overlap}"),
        E.ambiguity(21, 7, "CL-LORA-010", f"{sets} AND flag AND n_configs = 0"),
    ]


def dense_facts() -> list[str]:
    series = "kind = 'training_metric' AND num1 >= 2"
    return [
        E.support(43, 1, "CL-DENSE-006", [("dense_finetune", "progression")], 70, "E1", "me", f"{series} AND flag"),
        E.contradict(43, 2, "CL-DENSE-007", "parameter_update", None, "me", f"{series} AND NOT flag"),
    ]


def _utc(c: str) -> str:
    """Strict UTC second stamps; anything else reads as unknown."""
    shape = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
    return f"try_to_timestamp(if({c} RLIKE '{shape}', {c}, null), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def chronology_facts() -> list[str]:
    return [E.contradict(111, 1, "CL-CHRONO-004", "training_stage", None, "me",
                         f"kind = 'file_chronology' AND n_mtime > 0 AND {_utc('text1')} > {_utc('text2')}")]


FACT_FAMILIES = {"base": base_facts, "lora": lora_facts, "dense": dense_facts, "chronology": chronology_facts}
FACT_FAMILY_KINDS = {
    "base": ["base_model_reference", "tensor_header"], "lora": ["adapter_config", "adapter_tensor_set"],
    "dense": ["training_metric"], "chronology": ["file_chronology"],
}
