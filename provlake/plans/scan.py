"""From the files of a case to its facts: route by type and name, read, scrub, group, number, and note what could not be read.

Inputs are tables: ``artifacts`` (case_id, artifact_seq, artifact_id, artifact_type, path_alias), ``lines`` (case_id,
artifact_id, line_no, line) of line-oriented files, ``bodies`` (case_id, artifact_id, body) of JSON files and prompts, ``headers`` (case_id,
artifact_id, header_json, header_bytes, file_size, note) of tensor containers and ``pairs`` (case_id, artifact_id, key, ival, sval) of
key-value containers.  ``ROUTES`` names the reader of every artifact; what a reader finds becomes (kind, fields) in one shape.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.fields import pack
from provlake.operators import configs, dependencies, deployment, logs, manifests, retrieval, tensors
from provlake.operators.privacy import field_scrub
from provlake.plans.evaluate import EvidenceResult, evaluate
from provlake.session import small_methods, work_dir
from provlake.sources.sink import staged
from provlake import vocab as V

# --- fixed values: which reader reads what; the first row that fits wins ------------
# (reader, artifact types, pattern of the lower-case file name, the table it reads)
ROUTES = [
    ("log", ["training_log"], "", "lines"),
    ("trace", ["retrieval_trace"], "", "lines"),
    ("npm", ["dependency_lockfile"], r"^package(-lock)?\.json$", "bodies"),
    ("toml", ["dependency_lockfile"], r"^(cargo\.lock|pyproject\.toml|poetry\.lock)$", "lines"),
    ("requirements", ["dependency_lockfile"], r"^(requirements.*|pip-freeze\.txt|conda-list\.txt)$", "lines"),
    ("build", ["deployment_manifest", "serving_config"], "^(dockerfile|containerfile)$", "lines"),
    ("env", ["deployment_manifest", "serving_config"], r"^\.env", "lines"),
    ("yaml", ["deployment_manifest", "serving_config"], r"\.ya?ml$", "lines"),
    ("embedding", ["vector_index"], r"^(config_sentence_transformers|modules)\.json$", "bodies"),
    ("trace", ["vector_index"], r"\.(jsonl|ndjson)$", "lines"),
    ("prompt", ["vector_index"], r"\.(jinja|j2|prompt|tmpl)$", "bodies"),
    ("store", ["vector_index"], "|".join(m.replace(".", "\\.") for m, _ in V.STORE_MARKERS), None),
    ("tensors", ["safetensors"], "", "headers"),
    ("gguf", ["gguf"], "", "pairs"),
    ("card", ["model_card"], "", "lines"),
    ("shards", ["shard_index"], "", "bodies"),
    ("config", ["transformers_config", "generation_config", "peft_adapter_config", "tokenizer_config", "trainer_state", "training_args"], "", "bodies"),
    ("json", ["generic_json", "deepspeed_config", "accelerate_config"], "", "bodies"),
]
JSON_READERS = ["npm", "embedding", "shards", "config", "json"]
KEY = "file"  # case and artifact in one column, as the readers group by one
_SEP = "\x1f"


def routed(artifacts: DataFrame) -> DataFrame:
    """Artifacts with ``reader`` and the table it ``reads``; both null for a type or name that has no reader."""
    name = F.lower(F.substring_index("path_alias", "/", -1))
    reader = reads = F.lit(None).cast("string")
    for who, types, pattern, table in reversed(ROUTES):
        fits = F.col("artifact_type").isin(*types) & (name.rlike(pattern) if pattern else F.lit(True))
        reader, reads = F.when(fits, who).otherwise(reader), F.when(fits, F.lit(table)).otherwise(reads)
    return artifacts.withColumns({"reader": reader, "reads": reads, "file_name": name})


@dataclass
class Scan:
    """Facts ready for ``evaluate``, and the notes of the readers."""
    facts: DataFrame
    notes: DataFrame


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn(KEY, F.concat_ws(_SEP, F.col("case_id").cast("string"), "artifact_id"))


@dataclass
class Routed:
    """The tables of a scan, each row with the ``reader`` and type of its artifact, saved by reader: a reader opens its own rows only."""
    artifacts: DataFrame
    lines: DataFrame
    bodies: DataFrame
    headers: DataFrame
    pairs: DataFrame
    given: list[str]


HEADER_ROWS = "case_id bigint, artifact_id string, header_json string, header_bytes bigint, file_size bigint, note string"
PAIR_ROWS = "case_id bigint, artifact_id string, key string, ival bigint, sval string"


def route(artifacts: DataFrame, lines: DataFrame, bodies: DataFrame, headers: DataFrame | None = None, pairs: DataFrame | None = None) -> Routed:
    """Join every table with its artifacts once and save it by reader."""
    spark = artifacts.sparkSession
    small_methods(spark)
    where = work_dir(spark, "scan")
    given = ["lines", "bodies"] + ["headers"] * (headers is not None) + ["pairs"] * (pairs is not None)

    def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    listing = kept(routed(artifacts), "artifacts")
    places = listing.select("case_id", "artifact_id", "artifact_type", F.coalesce("reader", F.lit("none")).alias("reader"))

    def placed(df: DataFrame, name: str) -> DataFrame:
        return kept(keyed(df).join(places, ["case_id", "artifact_id"]), name, "reader")

    return Routed(listing, placed(lines, "lines"), placed(bodies, "bodies"),
                  placed(headers if headers is not None else spark.createDataFrame([], HEADER_ROWS), "headers"),
                  placed(pairs if pairs is not None else spark.createDataFrame([], PAIR_ROWS), "pairs"), given)


def _of_reader(rows: DataFrame, *readers: str) -> DataFrame:
    return rows.where(F.col("reader").isin(*readers))


def _facts(rows: DataFrame, key: str, kind: str, fields: dict[str, tuple[str, str]], order: str = "0") -> DataFrame:
    """Reader rows in the common shape; ``fields`` maps a field to (slot, SQL over the row)."""
    return rows.select(F.col(key).alias(KEY), F.lit(kind).alias("kind"), F.expr(f"cast({order} as string)").alias("sub"), pack(fields).alias("fields"))


def same(slot: str, *names: str) -> dict[str, tuple[str, str]]:
    return {n: (slot, n) for n in names}


def log_facts(lines: DataFrame) -> list[DataFrame]:
    """Everything a training log says."""
    where = work_dir(lines.sparkSession, "log-pairs")
    read = logs.with_pairs(lines.withColumnRenamed(KEY, "run").select("run", "line_no", "line"))
    read.write.parquet(where)  # the pairs of a line are found once, for all that reads them
    run = lines.sparkSession.read.schema(read.schema).parquet(where)
    compute = logs.compute_records(run)
    labels = logs.log_labels(run).groupBy("run").pivot("field", ["trainable_params", "total_params"]).agg(F.first("value"))
    return [
        _facts(logs.log_series(run), "run", "training_metric", same("i", "entry_count", "first_step", "last_step", "loss_decreasing_percent")
               | same("b", "steps_monotonic") | same("num", "first_loss", "last_loss")),
        _facts(logs.checkpoint_steps(run), "run", "checkpoint_step", same("i", "step") | {"position": ("s", "origin")}, order="lpad(step, 20, '0')"),
        _facts(labels.where("trainable_params IS NOT NULL OR total_params IS NOT NULL"), "run", "trainable_parameter_record",
               {"trainable": ("i", "trainable_params"), "total": ("i", "total_params")}),
        _facts(logs.token_counts(run), "run", "token_count_record", same("i", "tokens")),
        _facts(logs.hardware_records(run), "run", "hardware_record", same("i", "world_size", "gpu_count")
               | {n: ("s", f"nullif({n}, '')") for n in ("device_name", "description")}),
        _facts(compute.where("coalesce(wall_clock_seconds, gpu_hours, total_flos) IS NOT NULL"), "run", "compute_record",
               same("i", "wall_clock_seconds", "gpu_hours", "total_flos")),
        _facts(compute.where("coalesce(seed, data_seed) IS NOT NULL"), "run", "seed_record", same("i", "seed", "data_seed")),
        _facts(logs.run_chronology(run).where("coalesce(run_started_at, checkpoint_at) IS NOT NULL"), "run", "file_chronology",
               same("s", "run_started_at", "checkpoint_at", "observed_first_at", "observed_last_at")),
    ]


def config_parts(bodies: DataFrame) -> list[DataFrame]:
    """Facts of configuration files: their own kind, objectives and base models."""
    parts = []
    for artifact_type in configs.KEYS_BY_TYPE:
        mine = bodies.where(F.col("artifact_type") == artifact_type).select(F.col(KEY).alias("artifact"), "body")
        found = configs.config_facts(mine, artifact_type)
        parts.append(found.select(F.col("artifact").alias(KEY), "kind", F.lit("0").alias("sub"), "fields"))
    training = bodies.where(F.col("artifact_type") == "training_args").select(F.col(KEY).alias("artifact"), "body")
    parts.append(_facts(configs.training_objectives(training), "artifact", "training_objective", same("s", "objective", "declared_in")))
    adapters = bodies.where(F.col("artifact_type") == "peft_adapter_config").select(
        F.col(KEY).alias("artifact"), F.get_json_object("body", "$.base_model_name_or_path").alias("base_ref"), F.get_json_object("body", "$.revision").alias("explicit_revision"))
    parts.append(_facts(configs.base_references(adapters), "artifact", "base_model_reference", same("s", "base_ref", "revision") | same("b", "revision_pinned")))
    states = bodies.where(F.col("artifact_type") == "trainer_state").select(F.col(KEY).alias("run"), "body")
    series = logs.trainer_state_series(states)
    parts.append(_facts(series.where("entry_count > 0"), "run", "training_metric", same("i", "entry_count", "first_step", "last_step")
                        | {"steps_monotonic": ("b", "monotone_step_order")} | same("num", "first_loss", "last_loss")))
    parts.append(_facts(series.select("run", F.explode("checkpoint_steps").alias("step")), "run", "checkpoint_step", same("i", "step"), order="lpad(step, 20, '0')"))
    return parts


def line_parts(lines: DataFrame) -> list[DataFrame]:
    """Facts of dependency lists, traces, build files, manifests, variables and model cards."""
    def of(reader):
        return _of_reader(lines, reader).select(KEY, "line_no", "line")

    by_line = "lpad(line_no, 20, '0')"
    packages = dependencies.dependency_packages(of("requirements")).unionByName(manifests.toml_packages(of("toml")))
    traces = retrieval.retrieval_chain(of("trace"))
    build, yaml = manifests.build_file(of("build")), manifests.yaml_file(of("yaml"))
    images = build["images"].unionByName(yaml["images"]).withColumn("image_digest", F.nullif(F.regexp_extract("image", "@sha256:(.*)$", 1), F.lit("")))
    serving = deployment.serving_commands(build["commands"].unionByName(yaml["commands"]))
    variables = deployment.env_vars(of("env").unionByName(build["variables"]).unionByName(yaml["variables"]))
    secret = F.col("role") == "credential"
    variables = variables.withColumn("withheld", secret).withColumn("reason", F.when(secret, "the variable name indicates a credential"))
    endpoints = deployment.provider_endpoints(
        variables.where("endpoint_url IS NOT NULL").select(KEY, "line_no", F.col("name").alias("declared_in"), F.col("endpoint_url").alias("url"))
        .unionByName(yaml["addresses"]))
    cards = configs.base_references(manifests.card_base_lines(of("card")).withColumn("explicit_revision", F.lit(None).cast("string")))
    return [
        _facts(packages, KEY, "sdk_dependency", same("s", "name", "ecosystem", "category", "version"), order=by_line),
        _facts(traces.where("NOT malformed"), KEY, "retrieval_trace", same("i", "entry_count", "full_chain_entry_count") | same("b", "request_level_chain")
               | same("l", "field_names")),
        _facts(images, KEY, "container_manifest", same("s", "image", "image_digest"), order=by_line),
        _facts(serving, KEY, "serving_config", same("s", "engine", "model_path", "served_model_name", "lora_modules", "quantization") | same("i", "port")
               | same("b", "enable_lora"), order=by_line),
        _facts(serving.where("model_path IS NOT NULL"), KEY, "artifact_reference", {"target_path": ("s", "model_path"), "in_scope": ("b", "false")}, order=by_line),
        _facts(variables.where("endpoint_url IS NULL"), KEY, "serving_config", {"env_var_set": ("s", "name"), "value_withheld": ("b", "withheld")}
               | same("s", "value", "reason"), order=by_line),
        _facts(endpoints, KEY, "provider_endpoint", same("s", "endpoint_url", "host", "provider", "declared_in") | same("b", "is_loopback_or_private"), order=by_line),
        _facts(cards, KEY, "base_model_reference", same("s", "base_ref", "revision") | same("b", "revision_pinned"), order=by_line),
    ]


def body_parts(bodies: DataFrame) -> list[DataFrame]:
    """Facts of package manifests, shard indexes, embedding settings, prompts, and the reduced precision a configuration states."""
    def of(reader, name):
        return _of_reader(bodies, reader).select(F.col(KEY).alias(name), "body")

    shards = configs.shard_files(of("shards", "artifact").withColumn("case_id", F.lit(0))).groupBy("artifact").agg(
        F.count("*").alias("shard_file_count"), F.sum("tensors").alias("tensor_count"))
    prompts = retrieval.prompt_templates(of("prompt", KEY).withColumnRenamed("body", "text"), preview=V.PROMPT_PREVIEW)
    quantized = of("config", "artifact").select("artifact", F.get_json_object("body", "$.quantization_config").alias("q"),
                                                F.get_json_object("body", "$.quantization_config.quant_method").alias("quant_method")).where("q IS NOT NULL")
    return [
        _facts(dependencies.npm_packages(of("npm", KEY)), KEY, "sdk_dependency", same("s", "name", "ecosystem", "category", "version"), order="concat(section_no, name)"),
        _facts(shards, "artifact", "shard_index", same("i", "shard_file_count", "tensor_count")),
        _facts(retrieval.chunking_configs(of("embedding", KEY)), KEY, "retrieval_index", same("i", "chunk_size", "chunk_overlap", "top_k", "similarity_top_k")
               | same("s", "splitter", "text_splitter", "embed_model", "vector_store", "store")),
        _facts(prompts, KEY, "prompt_template", same("s", "preview", "sha256") | same("i", "length_bytes") | same("b", "has_context_placeholder")),
        _facts(quantized, "artifact", "quantization_record", same("s", "quant_method") | {"reason": ("s", "'the configuration states a quantization'")}),
    ]


def container_parts(headers: DataFrame, pairs: DataFrame) -> list[DataFrame]:
    """Facts of tensor containers from their headers and key-value pairs."""
    read = _of_reader(headers, "tensors").where("header_json IS NOT NULL").select(F.col(KEY).alias("artifact"), "header_json", "header_bytes", "file_size")
    rows = tensors.tensor_explode(read)
    sizes = read.select("artifact", (F.col("header_bytes") + 8).alias("data_start"), "file_size", "header_bytes")
    summary = tensors.tensor_summary(rows, sizes).join(sizes.select("artifact", "header_bytes"), "artifact")
    usable = rows.join(summary.select("artifact"), "artifact", "left_semi")
    kv = _of_reader(pairs, "gguf").select(F.col(KEY).alias("artifact"), "key", "ival", "sval")
    picked = tensors.gguf_kv(kv).where("note IS NULL").groupBy("artifact").pivot("leaf", ["context_length", "block_count"]).agg(F.first("value"))
    model = kv.where("key = 'general.architecture'").select("artifact", F.col("sval").alias("architecture")).join(picked, "artifact", "left")
    kinds = kv.where("key = 'general.file_type' AND ival IS NOT NULL").select("artifact", F.col("ival").alias("code"))
    none = rows.sparkSession.createDataFrame([], "artifact string, body string")
    reduced = tensors.quantization_records(usable, tensors.metadata_explode(read.join(summary.select("artifact"), "artifact", "left_semi")), kinds, none)
    return [
        _facts(summary, "artifact", "tensor_header", same("i", "tensor_count", "parameters", "max_rank", "largest_tensor_elements", "header_bytes") | same("l", "dtypes")),
        _facts(tensors.lora_pairs(usable), "artifact", "adapter_tensor_set", same("i", "lora_pair_count", "unpaired_key_count", "rank_disagreement_count")
               | same("l", "inferred_ranks", "target_module_suffixes") | same("b", "has_dora", "modules_to_save_present")),
        _facts(model, "artifact", "model_config", same("s", "architecture") | same("i", "context_length", "block_count")),
        _facts(reduced, "artifact", "quantization_record", {"reason": ("s", "concat_ws(': ', source, nullif(detail, ''))")}, order="source"),
    ]


def name_parts(artifacts: DataFrame) -> list[DataFrame]:
    """Facts that a file's name alone carries: retrieval stores."""
    stores = keyed(artifacts.where("reader = 'store'")).withColumn("store", retrieval.store_kind(F.col("file_name")))
    return [_facts(stores, KEY, "retrieval_index", same("s", "store") | {"evidence": ("s", "'a store file of this kind is in the scanned scope'")})]


def reader_notes(files: Routed) -> DataFrame:
    """(case_id, rule_id, path_alias, detail) of every artifact that was not read, or not read as what it is."""
    place = lambda c: [F.split(c, _SEP)[0].cast("bigint").alias("case_id"), F.split(c, _SEP)[1].alias("artifact_id")]
    noted = lambda df, rule, detail: df.select("case_id", "artifact_id", F.lit(rule).alias("rule_id"), detail.alias("detail"))
    broken = _of_reader(files.bodies, *JSON_READERS).where(F.try_parse_json("body").isNull())
    traces = retrieval.retrieval_chain(_of_reader(files.lines, "trace").select(KEY, "line_no", "line")).where("malformed")
    ranks = configs.rank_notes(files.bodies.where("artifact_type = 'peft_adapter_config'").select(F.col(KEY).alias("artifact"), "body"))
    tables = {"lines": files.lines, "bodies": files.bodies, "headers": files.headers, "pairs": files.pairs}
    seen = [tables[t].select("case_id", "artifact_id", F.lit(t).alias("reads")).distinct() for t in files.given]
    absent = files.artifacts.where(F.col("reads").isin(*files.given)).join(stacked(seen), ["case_id", "artifact_id", "reads"], "left_anti")
    out = stacked([
        noted(broken, "CL-FMT-010", F.lit("no valid JSON")), noted(traces.select(*place(KEY)), "CL-FMT-010", F.lit("a line is no valid JSON")),
        noted(ranks.select(*place("artifact")), "CL-FMT-009", F.lit("rank is no integer")),
        noted(files.artifacts.where("reader IS NULL"), "CL-FMT-002", F.lit("no reader for this type and name")),
        noted(_of_reader(files.headers, "tensors").where("note IS NOT NULL"), "CL-FMT-002", F.col("note")),
        noted(absent, "CL-INV-002", F.lit("could not be reopened for reading"))])
    return (out.join(files.artifacts.select("case_id", "artifact_id", "path_alias"), ["case_id", "artifact_id"])
            .select("case_id", "rule_id", "path_alias", "detail"))


def stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan(artifacts: DataFrame, lines: DataFrame, bodies: DataFrame, headers: DataFrame | None = None, pairs: DataFrame | None = None,
         scrub: bool = True) -> Scan:
    """Facts of all artifacts, scrubbed, grouped and numbered by artifact and then by kind, and the readers' notes."""
    files = route(artifacts, lines, bodies, headers, pairs)
    # a broken file leaves a note and no fact; prompts are no JSON
    sound = files.bodies.where((F.col("reader") == "prompt") | F.try_parse_json("body").isNotNull())
    found = stacked(log_facts(_of_reader(files.lines, "log")) + config_parts(_of_reader(sound, "config")) + line_parts(files.lines) + body_parts(sound)
                    + container_parts(files.headers, files.pairs) + name_parts(files.artifacts))
    listed = keyed(files.artifacts).select(KEY, "case_id", "artifact_seq", "artifact_id",
                                           configs.source_group(F.col("artifact_type"), F.col("artifact_id"), F.col("path_alias")).alias("source_group"))
    placed = found.join(listed, KEY)
    if scrub:  # behind the join, so that the optimiser does not copy the patterns into every reader's branch
        placed = field_scrub(placed)
    placed = placed.withColumn("emit_no", F.struct(kind_order(F.col("kind")).alias("k"), "sub"))
    # numbering reads its rows three times, and a reader should run once
    return Scan(configs.facts_union([staged(placed.drop(KEY, "sub"), "scan-facts")]), reader_notes(files))


def kind_order(kind: Column) -> Column:
    from provlake.functions.dims import rank_of

    return rank_of(kind, V.FACT_KINDS)


def screen(cases: DataFrame, artifacts: DataFrame, lines: DataFrame, bodies: DataFrame, declared: DataFrame, headers: DataFrame | None = None,
           pairs: DataFrame | None = None) -> tuple[EvidenceResult, DataFrame]:
    """Files to conclusions: the evaluation of what was found, and the notes on what was not read."""
    found = scan(artifacts, lines, bodies, headers, pairs)
    return evaluate(cases, found.facts, artifacts, declared), found.notes
