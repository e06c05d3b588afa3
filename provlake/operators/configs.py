"""Facts from model, adapter, tokenizer and training configuration (JSON), and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.operators.ordered import dense_positions
from provlake.functions.fields import pack

# --- fixed values: scalar keys copied from each kind of file ----------------------
MODEL_KEYS = {
    "i": ["hidden_size", "num_hidden_layers", "num_attention_heads", "num_key_value_heads", "intermediate_size",
          "vocab_size", "max_position_embeddings"],
    "s": ["model_type", "torch_dtype", "transformers_version"], "b": ["tie_word_embeddings"], "l": ["architectures"],
}
ADAPTER_KEYS = {
    "i": ["lora_alpha", "r"], "num": ["lora_dropout"], "s": ["peft_type", "task_type", "bias", "base_model_name_or_path"],
    "b": ["fan_in_fan_out", "use_dora", "use_rslora", "inference_mode"], "l": ["target_modules", "modules_to_save"],
}
TOKENIZER_KEYS = {"i": ["model_max_length"], "s": ["tokenizer_class"], "b": ["clean_up_tokenization_spaces"]}
TRAINING_KEYS = {
    "i": ["max_steps", "per_device_train_batch_size", "gradient_accumulation_steps", "warmup_steps", "seed"],
    "num": ["learning_rate", "num_train_epochs", "weight_decay"], "s": ["optim", "lr_scheduler_type"],
    "b": ["bf16", "fp16", "gradient_checkpointing"],
}
KEYS_BY_TYPE = {
    "transformers_config": ("model_config", MODEL_KEYS), "peft_adapter_config": ("adapter_config", ADAPTER_KEYS),
    "tokenizer_config": ("tokenizer_identity", TOKENIZER_KEYS), "training_args": ("optimizer_record", TRAINING_KEYS),
}
OBJECTIVE_KEYS = ["objective", "task_type", "loss_type", "training_objective"]
_TYPE = {"i": "bigint", "num": "string", "s": "string", "b": "boolean", "l": "array<string>"}


def config_facts(configs: DataFrame, artifact_type: str) -> DataFrame:
    """``configs``: (artifact, body) of one artifact type -> (artifact, kind, fields).

    A field is kept only in its own type: a quoted number is not a number.
    """
    kind, keys = KEYS_BY_TYPE[artifact_type]
    schema = "struct<" + ",".join(f"{k}:{_TYPE[s]}" for s, ks in keys.items() for k in ks) + ">"
    # reading drops a value of the wrong type; a string for an integer is such a value
    fields = {k: (s, f"array_sort(array_distinct(v.{k}))" if s == "l" else f"v.{k}") for s, ks in keys.items() for k in ks}
    if "architectures" in keys.get("l", []):
        fields["architecture"] = ("s", "try_element_at(array_sort(v.architectures), 1)")
    if "modules_to_save" in fields:
        fields["modules_to_save"] = ("l", "if(size(v.modules_to_save) > 0, array_sort(array_distinct(v.modules_to_save)), null)")
    return (configs.select("artifact", F.from_json("body", schema).alias("v"))
            .select("artifact", F.lit(kind).alias("kind"), pack(fields).alias("fields")))


def rank_notes(configs: DataFrame) -> DataFrame:
    """Adapter configurations whose ``r`` is given but is no integer."""
    r = F.try_variant_get(F.try_parse_json("body"), "$.r", "variant")
    return (configs.withColumn("r_type", F.schema_of_variant(r)).where("r_type IS NOT NULL AND r_type <> 'BIGINT'")
            .select("artifact", F.lit("CL-FMT-009").alias("rule_id"), "r_type"))


def training_objectives(configs: DataFrame) -> DataFrame:
    """The first objective key that holds text."""
    schema = "struct<" + ",".join(f"{k}:string" for k in OBJECTIVE_KEYS) + ">"
    named = [F.when(F.coalesce(F.col(f"v.{k}"), F.lit("")) != "", F.struct(F.col(f"v.{k}").alias("objective"), F.lit(k).alias("declared_in")))
             for k in OBJECTIVE_KEYS]
    return (configs.select("artifact", F.from_json("body", schema).alias("v")).select("artifact", F.coalesce(*named).alias("o"))
            .where("o IS NOT NULL").select("artifact", "o.objective", "o.declared_in"))


def shard_files(indexes: DataFrame) -> DataFrame:
    """``indexes``: (artifact, case_id, body) -> one row per shard with the tensors mapped to it."""
    read = indexes.select("case_id", "artifact", F.explode(F.from_json(F.get_json_object("body", "$.weight_map"), "map<string,string>")).alias("tensor", "shard"))
    return read.groupBy("case_id", "artifact", "shard").agg(F.count("*").alias("tensors"))


def shard_completeness(indexes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per index: shards, tensors, and how many shards are absent from the case."""
    present = artifacts.select("case_id", F.substring_index("path_alias", "/", -1).alias("shard"), F.lit(1).alias("seen")).distinct()
    return (shard_files(indexes).join(present, ["case_id", "shard"], "left")
            .groupBy("case_id", "artifact").agg(
                F.count("*").alias("shard_file_count"), F.sum("tensors").alias("tensor_count"),
                F.count(F.when(F.col("seen").isNull(), 1)).alias("missing_shards")))


def missing_shards(indexes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each shard an index names that the case does not hold."""
    present = artifacts.select("case_id", F.substring_index("path_alias", "/", -1).alias("shard"))
    return shard_files(indexes).join(present, ["case_id", "shard"], "left_anti").select("case_id", "artifact", "shard")


def base_references(refs: DataFrame) -> DataFrame:
    """``refs``: any columns with ``base_ref`` and ``explicit_revision`` -> pinned or not.

    Only a commit pins a base: 7 to 40 lowercase hex digits, given or after ``@``.
    """
    commit = "[0-9a-f]{7,40}"
    embedded = F.nullif(F.regexp_extract("base_ref", f"@({commit})$", 1), F.lit(""))
    revision = F.coalesce(F.nullif(F.col("explicit_revision"), F.lit("")), embedded)
    return (refs.where("base_ref <> ''").withColumn("revision", revision)
            .withColumn("revision_pinned", F.coalesce(F.col("revision").rlike(f"^{commit}$"), F.lit(False)))
            .drop("explicit_revision"))


def card_bases(cards: DataFrame) -> DataFrame:
    """``cards``: (artifact, front JSON) whose ``base_model`` is one name or a list of names."""
    raw = F.get_json_object("front", "$.base_model")
    many = F.from_json(raw, "array<string>")
    return (cards.select("artifact", F.explode(F.when(raw.startswith("["), many).otherwise(F.array(raw))).alias("base_ref"))
            .where("base_ref <> ''").withColumn("explicit_revision", F.lit(None).cast("string")))


def source_group(artifact_type: Column, artifact_id: Column, path_alias: Column) -> Column:
    """Containers stand alone; all other files of one directory are one source."""
    parent = F.regexp_replace(path_alias, "/[^/]*$", "")
    return (F.when(artifact_type.isin(*V.CONTAINER_TYPES), F.concat(F.lit("artifact::"), artifact_id))
            .otherwise(F.concat(F.lit("dir::"), parent)))


def facts_union(parts: list[DataFrame]) -> DataFrame:
    """Stack fact tables of one shape and number them by artifact, then by emission."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (dense_positions(out, "case_id", ["artifact_seq", "emit_no"], "fact_seq")
            .withColumn("fact_id", F.format_string("F-%04d", F.col("fact_seq")))
            .select("case_id", "fact_seq", "fact_id", "kind", "artifact_id", "source_group", "fields"))
