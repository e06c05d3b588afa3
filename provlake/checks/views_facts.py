"""Facts, artifacts and declared facets derived from ``lineitem`` and ``orders``."""

from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.checks import views_scoring  # noqa: F401
from provlake.checks.sqlviews import idiv, pick, register
from provlake.functions.fields import pack

CASE = idiv("l_orderkey", 5)
CASE_O = idiv("o_orderkey", 5)


def on(**arms: str) -> str:
    """CASE over the fact kind."""
    return "CASE " + " ".join(f"WHEN kind = '{k}' THEN {e}" for k, e in arms.items()) + " END"


def when(cond: str, value: str) -> str:
    return f"(CASE WHEN {cond} THEN {value} END)"


register("v_fact_base", f"""
SELECT {CASE} AS case_id,
       l_orderkey * 1000000000 + (l_partkey * 1009 + l_suppkey * 31 + l_linenumber * 7 + CAST(l_quantity AS BIGINT)) % 1000000000 AS fact_seq,
       {pick('(l_partkey + l_linenumber) % 35', V.FACT_KINDS)} AS kind,
       l_orderkey, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q
FROM {{lineitem}}""")
register("v_fact_flat", f"""
SELECT case_id, fact_seq, 'F-' || fact_seq AS fact_id, kind, 'A-' || l_orderkey AS artifact_id,
  CASE WHEN s % 4 = 0 THEN 'artifact::A-' || l_orderkey ELSE 'dir::ROOT1/d' || (s % 4) END AS source_group,
  {on(base_model_reference="CASE p % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END", teacher_reference="p % 2 = 0")} AS pinned,
  {on(base_model_reference=when("q % 6 = 0", "'abc1234'"))} AS revision,
  {on(base_model_reference="'org/base-' || (p % 5)", adapter_config=when("s % 3 <> 0", "'org/base-' || (p % 4)"),
      model_config=when("q % 3 <> 0", "'org/base-' || (s % 4)"))} AS base_name,
  {on(tensor_header=when("q % 5 <> 0", "(q % 3 + 1) * 5000"), compute_record=when("q % 2 = 0", "q * 1000"))} AS parameters,
  {on(tensor_header="s % 4 = 0")} AS is_base,
  {on(model_config=when("q % 2 = 0", "'llama'"))} AS model_type,
  {on(model_config=when("q % 4 <> 3", "(p % 3 + 1) * 5000 + q"))} AS num_parameters,
  {on(tokenizer_identity="CASE q % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END")} AS vocab_changed,
  {on(adapter_config=when("q % 7 <> 0", "q % 4 * 8"))} AS lora_rank,
  {on(adapter_config="CASE p % 5 WHEN 1 THEN 'q_proj' WHEN 2 THEN 'q_proj,v_proj' WHEN 3 THEN 'gate' WHEN 4 THEN '' END",
      adapter_tensor_set="CASE s % 4 WHEN 1 THEN 'v_proj' WHEN 2 THEN 'q_proj,k_proj' WHEN 3 THEN 'up_gate_proj' END")} AS targets,
  {on(adapter_config="CASE q % 6 WHEN 0 THEN 'lm_head' WHEN 1 THEN '' END")} AS modules_to_save,
  {on(adapter_config="q % 4 = 0")} AS use_dora,
  {on(adapter_tensor_set="q % 6")} AS pairs,
  {on(adapter_tensor_set="CASE q % 5 WHEN 1 THEN '8' WHEN 2 THEN '8,16' WHEN 3 THEN 'x' WHEN 4 THEN CAST(q % 4 * 8 AS VARCHAR(20)) END")} AS ranks,
  {on(adapter_tensor_set="q % 3 = 0")} AS has_dora,
  {on(serving_config="q % 4 = 0")} AS enable_lora,
  {on(serving_config=when("q % 9 = 0", "'m=a'"))} AS lora_modules,
  {on(trainable_parameter_record="q * 10")} AS trainable,
  {on(trainable_parameter_record="(p % 5) * 2000")} AS total,
  {on(checkpoint_step=when("q % 11 <> 0", "q % 6 * 100"))} AS step,
  {on(training_metric="q % 4", retrieval_trace="q")} AS entry_count,
  {on(training_metric="CASE p % 9 WHEN 2 THEN FALSE WHEN 3 THEN TRUE WHEN 4 THEN TRUE WHEN 5 THEN TRUE END")} AS monotonic,
  {on(training_objective=pick("p % 5", ["causal_lm", "kl_div", "DistillLoss", "sft", "Logit_match"]))} AS objective,
  {on(dataset_manifest=when("q % 2 = 0", "q * 1000"), token_count_record="q * 1000")} AS tokens,
  {on(sdk_dependency="CASE WHEN p % 3 = 0 THEN 'provider_sdk' ELSE 'training' END")} AS category,
  {on(retrieval_trace="q % 4 = 0")} AS full_chain,
  {on(container_manifest=when("q % 2 = 0", "'sha256:ab'"))} AS image_digest,
  {on(artifact_reference="q % 5 = 0")} AS in_scope,
  {on(compute_record=pick("p % 4", [3750000000, 1000, 900000000000000]))} AS flops,
  {on(file_chronology="'2024-01-0' || (q % 9 + 1) || 'T00:00:00Z'")} AS started_at,
  {on(file_chronology="CASE WHEN q % 10 = 0 THEN '2024-01-05 00:00' ELSE '2024-01-05T00:00:00Z' END")} AS checkpoint_at
FROM {{v_fact_base}}""")
register("v_artifact", f"""
SELECT {CASE_O} AS case_id, 'A-' || o_orderkey AS artifact_id,
  CASE WHEN {CASE_O} % 6 = 0 THEN {pick('o_orderkey % 6', V.TEXT_ONLY_TYPES)}
       ELSE {pick('(o_orderkey * 7) % 26', V.ARTIFACT_TYPES)} END AS artifact_type,
  CASE WHEN o_orderkey % 7 <> 0 THEN @SHA(CAST(o_orderkey AS VARCHAR(20))@) END AS sha256,
  CASE WHEN {CASE_O} % 9 = 0 THEN NULL WHEN {CASE_O} % 4 = 0 THEN 1700000000 ELSE 1700000000 + o_custkey END AS mtime_s
FROM {{orders}} WHERE {CASE_O} % 11 <> 0""")
register("v_declared", f"""
SELECT {CASE_O} AS case_id,
  {pick('o_custkey % 6', ['random_initialization_claimed', 'derivative_of_disclosed_base', 'distilled_from_teacher', 'unknown'])} AS weight_origin,
  {pick('o_custkey % 7', ['no_update_observed', 'unmerged_peft_observed', 'merged_adapter_consistent', 'partial_or_dense_update', 'unknown'])} AS parameter_update,
  {pick('o_custkey % 5', ['continued_pretraining', 'supervised_instruction_tuning', 'distillation'])} AS training_stage,
  {pick('o_custkey % 4', ['rag', 'external_api_router,rag', 'local_direct_inference'])} AS augmentation
FROM {{orders}} WHERE o_orderkey % 5 = 0""")


def artifacts(get):
    return get("v_artifact").withColumn("mtime", F.timestamp_seconds("mtime_s"))


def declared(get):
    return get("v_declared").withColumn("inference_augmentation", F.coalesce(
        F.split("augmentation", ","), F.array().cast("array<string>")))


def _list(name: str):
    return ("l", f"if({name} = '', cast(array() as array<string>), split({name}, ','))")


# kind -> field -> (slot, expression over the flat columns)
FIELDS = {
    "base_model_reference": {"revision_pinned": ("b", "pinned"), "revision": ("s", "revision"), "base_ref": ("s", "base_name")},
    "teacher_reference": {"revision_pinned": ("b", "pinned")},
    "adapter_config": {
        "base_model_name_or_path": ("s", "base_name"), "r": ("i", "if(fact_seq % 2 = 1, lora_rank, null)"),
        "lora_rank": ("i", "if(fact_seq % 2 = 0, lora_rank, null)"), "target_modules": _list("targets"),
        "modules_to_save": _list("modules_to_save"), "use_dora": ("b", "use_dora")},
    "adapter_tensor_set": {
        "target_module_suffixes": _list("targets"), "lora_pair_count": ("i", "pairs"),
        "inferred_ranks": _list("ranks"), "has_dora": ("b", "has_dora")},
    "model_config": {"_name_or_path": ("s", "base_name"), "model_type": ("s", "model_type"), "num_parameters": ("i", "num_parameters")},
    "tensor_header": {"parameters": ("i", "parameters"), "is_base": ("b", "is_base")},
    "compute_record": {"parameters": ("i", "parameters"), "flops": ("i", "flops")},
    "tokenizer_identity": {"vocab_changed": ("b", "vocab_changed")},
    "serving_config": {"enable_lora": ("b", "enable_lora"), "lora_modules": ("s", "lora_modules")},
    "trainable_parameter_record": {"trainable": ("i", "trainable"), "total": ("i", "total")},
    # a present key of the wrong type hides the alias behind it
    "checkpoint_step": {"global_step": ("i", "coalesce(step, 7)"), "step": ("s", "if(step is null, 'seven', null)")},
    "training_metric": {"entry_count": ("i", "entry_count"), "steps_monotonic": ("b", "monotonic")},
    "retrieval_trace": {"entry_count": ("i", "entry_count"), "full_chain": ("b", "full_chain")},
    "training_objective": {"objective": ("s", "objective")}, "dataset_manifest": {"tokens": ("i", "tokens")},
    "token_count_record": {"tokens": ("i", "tokens")}, "sdk_dependency": {"category": ("s", "category")},
    "container_manifest": {"image_digest": ("s", "image_digest")}, "artifact_reference": {"in_scope": ("b", "in_scope")},
    "file_chronology": {"run_started_at": ("s", "started_at"), "checkpoint_at": ("s", "checkpoint_at")},
}


def facts(get):
    """The typed field map of each fact, with several of the accepted key names."""
    fields = pack({})
    for kind, entries in FIELDS.items():
        fields = F.when(F.col("kind") == kind, pack(entries)).otherwise(fields)
    return get("v_fact_flat").select(
        "case_id", "fact_seq", "fact_id", "kind", "artifact_id", "source_group", fields.alias("fields"))
