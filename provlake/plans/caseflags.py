"""What the rules need to know about a case, folded from its facts.

Two aggregates: first per (case, kind), which combines on the map side and so
shrinks a case of any size to 35 rows before they meet, then per case into one
map keyed by kind.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.functions.fields import any_bool, any_int, any_list, any_text


def _per_kind(**by_kind: Column) -> Column:
    """A column whose reading depends on the fact's kind; null for other kinds."""
    out = None
    for kind, c in by_kind.items():
        out = F.when(F.col("kind") == kind, c) if out is None else out.when(F.col("kind") == kind, c)
    return out


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def read_facts(facts: DataFrame) -> DataFrame:
    """Typed columns for every field the rules read (aliases resolved once)."""
    return facts.select(
        "case_id", "kind", "fact_seq", "fact_id", "artifact_id", "source_group",
        _per_kind(
            base_model_reference=true(any_bool("revision_pinned", "pinned", "has_revision"))
            | any_text("revision", "commit", "sha").isNotNull(),
            teacher_reference=true(any_bool("revision_pinned", "pinned")),
            tensor_header=true(any_bool("is_base", "base_weights")),
            model_config=any_text("model_type", "architecture", "architectures").isNotNull(),
            tokenizer_identity=true(any_bool("vocab_changed", "vocab_extended")),
            dataset_manifest=any_int("tokens", "token_count").isNotNull(),
            adapter_config=true(any_bool("use_dora")) | true(any_bool("use_rslora")),
            adapter_tensor_set=true(any_bool("has_dora")),
            training_metric=F.coalesce(any_bool("steps_monotonic", "monotone_step_order"), F.lit(True)),
        ).alias("flag"),
        _per_kind(
            serving_config=true(any_bool("enable_lora", "lora")) | any_text("lora_modules", "adapter_path").isNotNull(),
            sdk_dependency=true(any_text("category") == "provider_sdk"),
            retrieval_trace=true(any_bool("request_level_chain", "full_chain")),
            artifact_reference=true(any_bool("in_scope", "resolved")),
            container_manifest=any_text("image_digest", "digest").isNotNull(),
            adapter_config=any_text("base_model_name_or_path", "base_ref").isNotNull(),
            model_config=any_text("_name_or_path", "base_ref").isNotNull(),
        ).alias("found"),
        _per_kind(
            training_objective=any_text("objective", "loss"),
            adapter_config=any_text("base_model_name_or_path", "base_ref"),
            model_config=any_text("_name_or_path", "base_ref"),
            file_chronology=any_text("run_started_at", "started_at"),
        ).alias("text1"),
        _per_kind(file_chronology=any_text("checkpoint_at", "referenced_at")).alias("text2"),
        _per_kind(
            tensor_header=any_int("parameters"), compute_record=any_int("parameters"),
            adapter_config=any_int("r", "rank", "lora_rank"),
            adapter_tensor_set=F.coalesce(any_int("lora_pair_count", "pairs"), F.lit(0)),
            model_config=any_int("declared_parameters", "num_parameters"),
            trainable_parameter_record=any_int("trainable", "trainable_params"),
            token_count_record=any_int("tokens", "token_count", "total_tokens"),
            training_metric=F.coalesce(any_int("entry_count", "entries"), F.lit(0)),
        ).alias("num1"),
        _per_kind(
            trainable_parameter_record=any_int("total", "all_params", "total_params"),
            compute_record=any_int("flops", "total_flos", "total_flops"),
        ).alias("num2"),
        _per_kind(
            adapter_config=any_list("target_modules", "targets"),
            adapter_tensor_set=any_list("target_module_suffixes", "targets"),
        ).alias("targets"),
        _per_kind(
            adapter_config=any_list("modules_to_save"),
            adapter_tensor_set=any_list("inferred_ranks", "ranks"),
        ).alias("list2"),
    )


def kind_summary(read: DataFrame) -> DataFrame:
    """One row per case and kind."""
    seq = F.col("fact_seq")
    cite = F.struct("fact_seq", "fact_id", "artifact_id", "source_group", "flag", "text1", "num1", "num2")
    return read.groupBy("case_id", "kind").agg(
        F.count("*").alias("n"),
        F.min(cite).alias("first"),
        F.min(F.when(F.col("found"), cite)).alias("hit"),
        F.min(F.when(F.col("num1").isNotNull(), F.struct("fact_seq", "num1"))).alias("num_first"),
        F.max(F.when(F.col("num1").isNotNull(), F.struct("fact_seq", "num1"))).alias("num_last"),
        F.max(F.when(F.col("targets").isNotNull(), F.struct(seq, F.col("targets")))).alias("targets_last"),
        F.sum(F.col("num1").cast("decimal(38,0)")).alias("num_sum"),
        F.max("num1").alias("num_max"),
        F.max("flag").alias("any_flag"), F.min("flag").alias("all_flag"),
    )


def step_summary(facts: DataFrame) -> DataFrame:
    """Distinct checkpoint steps per case, kept apart so that the wide aggregate needs no distinct."""
    steps = facts.where(F.col("kind") == "checkpoint_step").select("case_id", any_int("step", "global_step").alias("step"))
    return (steps.distinct().groupBy("case_id")
            .agg(F.count("step").alias("n_steps"), F.min("step").alias("step_min")))


def artifact_summary(artifacts: DataFrame) -> DataFrame:
    t = F.col("artifact_type")
    return artifacts.groupBy("case_id").agg(
        F.count("*").alias("n_artifacts"),
        F.max(t.isin(V.WEIGHT_BEARING_TYPES)).alias("has_weights"),
        F.max(t.isin(V.STRUCTURAL_TYPES)).alias("structural"),
        F.max(t.isin(V.LOCAL_WEIGHT_TYPES)).alias("local_weights"),
        F.min(t.isin(V.TEXT_ONLY_TYPES)).alias("only_text"),
        F.count(F.when(t == "opaque_serialization", 1)).alias("n_opaque"),
        F.count("mtime").alias("n_mtime"), F.min("mtime").alias("mtime_min"), F.max("mtime").alias("mtime_max"),
    )


# columns of the case row that stand for facts of other kinds
DERIVED = {"load_record": ["serving_config", "merge_record"], "caller": ["provider_endpoint", "sdk_dependency"],
           "adapter": ["adapter_config", "adapter_tensor_set"], "n_steps": ["checkpoint_step"], "step_min": ["checkpoint_step"]}


def kinds_read(predicates: list[str]) -> list[str]:
    """The fact kinds that predicates over the case row speak about."""
    words = set(re.findall(r"\w+", " ".join(predicates)))
    read = {k for k in V.FACT_KINDS if f"k_{k}" in words} | {k for c, kinds in DERIVED.items() if c in words for k in kinds}
    return sorted(V.FACT_KINDS if "n_facts" in words else read)


def case_flags(cases: DataFrame, facts: DataFrame, artifacts: DataFrame, declared: DataFrame, kinds_needed: list[str] | None = None) -> DataFrame:
    """One row per case: a column per fact kind, artifact summary and declared facets.

    With ``kinds_needed`` only facts of these kinds are read, as far as the columns of other kinds are not used.
    """
    if kinds_needed is not None:
        facts = facts.where(F.col("kind").isin(kinds_needed))
    per_kind = kind_summary(read_facts(facts))
    summary = [c for c in per_kind.columns if c not in ("case_id", "kind")]
    kinds = (per_kind.groupBy("case_id").agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.col("kind").alias("key"), F.struct(*summary).alias("value")))).alias("kinds"),
        F.sum("n").alias("n_facts")))
    zero = {"n_artifacts": 0, "has_weights": False, "structural": False, "local_weights": False,
            "only_text": False, "n_opaque": 0, "n_mtime": 0, "n_facts": 0, "n_steps": 0}
    return (
        cases.select("case_id")
        .join(kinds, "case_id", "left")
        .join(step_summary(facts), "case_id", "left")
        .join(artifact_summary(artifacts), "case_id", "left")
        .join(declared.select("case_id", "weight_origin", "parameter_update", "training_stage",
                              "inference_augmentation"), "case_id", "left")
        .fillna(zero)
        # one column per kind, so that rules read a column and not the map
        .select("*", *[F.try_element_at("kinds", F.lit(k)).alias(f"k_{k}") for k in V.FACT_KINDS])
        .drop("kinds")
        .withColumns({
            "load_record": F.coalesce(F.col("k_serving_config.hit"), F.col("k_merge_record.first")),
            "caller": F.coalesce(F.col("k_provider_endpoint.first"), F.col("k_sdk_dependency.hit")),
            "adapter": F.coalesce(F.col("k_adapter_config.first"), F.col("k_adapter_tensor_set.first")),
        })
    )
