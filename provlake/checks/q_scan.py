"""Checks of the assembly of facts from files (F32)."""

from pyspark.sql import functions as F

from provlake.checks import q_logs, q_texts  # noqa: F401
from provlake.checks.q_logs import keys, sql_int
from provlake.checks.registry import query
from provlake.checks.sqlviews import register
from provlake import vocab as V
from provlake.functions.fields import any_int, any_text
from provlake.plans.scan import reader_notes, route, scan, screen

# logs, adapter configurations and dependency lists of ten cases
register("v_scan_file", """
SELECT DISTINCT run % 10 AS case_id, run AS artifact_seq, 'L-' || run AS artifact_id, 'training_log' AS artifact_type, 'ROOT1/logs/' || run || '.log' AS path_alias FROM {v_log}
UNION ALL SELECT p_partkey % 10, 1000000 + p_partkey, artifact, 'peft_adapter_config', 'ROOT1/' || artifact || '/adapter_config.json' FROM {v_adapter_cfg}
UNION ALL SELECT DISTINCT 3, 2000000 + CAST(SUBSTRING(file, 2) AS BIGINT), 'D-' || file, 'dependency_lockfile', 'ROOT1/requirements-' || file || '.txt' FROM {v_dep}""")
register("v_scan_line", """SELECT run % 10 AS case_id, 'L-' || run AS artifact_id, line_no, line FROM {v_log}
UNION ALL SELECT 3, 'D-' || file, line_no, line FROM {v_dep}""")
register("v_scan_body", "SELECT p_partkey % 10 AS case_id, artifact AS artifact_id, CASE WHEN p_partkey % 50 = 7 THEN '{{\"cut' ELSE body END AS body, p_partkey FROM {v_adapter_cfg}")
register("o_scan_fact", f"""
SELECT 'L-' || run AS artifact_id, 'training_metric' AS kind, entry_count AS n, NULL AS t FROM {{o_log_series}}
UNION ALL SELECT 'L-' || run, 'seed_record', n, NULL FROM (
  SELECT run, ARG_MAX({sql_int('value')}, line_no * 300 + pair_no) FILTER (WHERE key IN {keys(V.SEED_KEYS)} AND {sql_int('value')} IS NOT NULL) AS n,
    BOOL_OR(key IN {keys(V.SEED_KEYS + ['data_seed'])} AND {sql_int('value')} IS NOT NULL) AS any_seed FROM {{o_pair}} GROUP BY run) t WHERE any_seed
UNION ALL SELECT artifact_id, 'adapter_config', CASE WHEN a.p_partkey % 4 = 1 THEN p_size END, p_brand FROM {{v_adapter_cfg}} a JOIN {{v_scan_body}} b ON b.p_partkey = a.p_partkey WHERE a.p_partkey % 50 <> 7
UNION ALL SELECT artifact_id, 'base_model_reference', NULL, p_brand FROM {{v_adapter_cfg}} a JOIN {{v_scan_body}} b ON b.p_partkey = a.p_partkey WHERE a.p_partkey % 50 <> 7
UNION ALL SELECT 'D-' || file, 'sdk_dependency', NULL, package FROM {{v_dep_part}} WHERE form > 2""")


def found(get):
    return scan(get("v_scan_file"), get("v_scan_line"), get("v_scan_body").select("case_id", "artifact_id", "body"))


KINDS = ["training_metric", "seed_record", "adapter_config", "base_model_reference", "sdk_dependency"]


@query("scan_facts", "SELECT artifact_id, kind, n, t FROM {o_scan_fact}")
def scan_facts(get):
    facts = found(get).facts.where(F.col("kind").isin(*KINDS))
    by_kind = F.when(F.col("kind") == "training_metric", any_int("entry_count")).when(F.col("kind") == "seed_record", any_int("seed")) \
        .when(F.col("kind") == "adapter_config", any_int("r"))
    text = F.when(F.col("kind") == "adapter_config", any_text("base_model_name_or_path")).when(F.col("kind") == "base_model_reference", any_text("base_ref")) \
        .when(F.col("kind") == "sdk_dependency", any_text("name"))
    return facts.select("artifact_id", "kind", by_kind.alias("n"), text.alias("t"))


@query("scan_notes", """SELECT p_partkey % 10 AS case_id, 'CL-FMT-010' AS rule_id, 'ROOT1/a' || p_partkey || '/adapter_config.json' AS path_alias, 'no valid JSON' AS detail FROM {v_scan_body} WHERE p_partkey % 50 = 7
UNION ALL SELECT p_partkey % 10, 'CL-FMT-009', 'ROOT1/a' || p_partkey || '/adapter_config.json', 'rank is no integer' FROM {v_scan_body} WHERE p_partkey % 4 IN (0, 2) AND p_partkey % 50 <> 7""")
def scan_notes(get):
    return reader_notes(route(get("v_scan_file"), get("v_scan_line"), get("v_scan_body").select("case_id", "artifact_id", "body")))


# --- whole facts of manifests, model cards and containers -------------------------------------
B = lambda s: s.replace("{", "{{").replace("}", "}}")  # noqa: E731  braces of JSON inside a view text
NAMES = {"N": ("dependency_lockfile", "package.json"), "B": ("deployment_manifest", "Dockerfile"), "Y": ("deployment_manifest", "compose.yaml"),
         "T": ("dependency_lockfile", "Cargo.lock"), "C": ("model_card", "README.md"), "H": ("safetensors", "m.safetensors"),
         "I": ("shard_index", "model.index.json"), "S": ("vector_index", "index.faiss"), "P": ("opaque_serialization", "w.pt"),
         "U": ("dependency_lockfile", "environment.yml")}
register("v_kit", "SELECT s_suppkey AS k, s_suppkey % 10 AS case_id, s_nationkey AS n, s_name AS owner FROM {supplier}")
register("v_kit_file", " UNION ALL ".join(
    f"SELECT case_id, k * 10 + {i} AS artifact_seq, '{letter}-' || k AS artifact_id, '{kind}' AS artifact_type, 'ROOT1/' || k || '/{name}' AS path_alias FROM {{v_kit}}"
    for i, (letter, (kind, name)) in enumerate(NAMES.items())))
KIT_LINES = {
    "B": ["'FROM reg/i' || n || ':1@sha256:d' || k", "'ENV MY_TOKEN=t' || k", "'ENV MODE=m' || n", "'CMD [\"vllm\", \"serve\", \"/m/' || n || '\", \"--port\", \"' || (8000 + n) || '\"]'"],
    "Y": ["'services:'", "'  a:'", "'    image: c' || n", "'    environment:'", "'      - LEVEL=' || n", "'    url: https://h' || k || '.example/p?q=' || n"],
    "T": ["'[[package]]'", "'name = \"crate-' || n || '\"'", "'version = \"' || k || '\"'"],
    "C": ["'---'", "'base_model: org/m' || n", "'---'", "'by ' || owner"],
}
register("v_kit_line", " UNION ALL ".join(f"SELECT case_id, '{letter}-' || k AS artifact_id, CAST({i} AS BIGINT) AS line_no, {line} AS line FROM {{v_kit}}"
                                          for letter, lines in KIT_LINES.items() for i, line in enumerate(lines)))
register("v_kit_body", f"""SELECT case_id, 'N-' || k AS artifact_id, '{B('{"dependencies":{"openai":"^')}' || n || '{B('","dep_')}' || k || '{B('":"1"}}')}' AS body FROM {{v_kit}}
UNION ALL SELECT case_id, 'I-' || k, '{B('{"weight_map":{"a":"s1","b":"s')}' || (k % 2 + 1) || '{B('"}}')}' FROM {{v_kit}}""")
register("v_kit_header", f"""SELECT case_id, 'H-' || k AS artifact_id, header AS header_json, CAST(LENGTH(header) AS BIGINT) AS header_bytes, CAST(LENGTH(header) + 8 + 4 * (n + 1) AS BIGINT) AS file_size,
  CAST(NULL AS STRING) AS note FROM (SELECT *, '{B('{"w":{"dtype":"F32","shape":[')}' || (n + 1) || '{B('],"data_offsets":[0,')}' || (4 * n + 4) || '{B(']}}')}' AS header FROM {{v_kit}}) t""")
KIT_FACTS = [
    ("N", "sdk_dependency", "'category=provider_sdk|ecosystem=npm|name=openai|version=^' || n"), ("N", "sdk_dependency", "'category=other|ecosystem=npm|name=dep-' || k || '|version=1'"),
    ("B", "container_manifest", "'image=reg/i' || n || ':1@sha256:d' || k || '|image_digest=d' || k"),
    ("B", "serving_config", "'enable_lora=false|engine=vllm|model_path=/m/' || n || '|port=' || (8000 + n)"), ("B", "artifact_reference", "'in_scope=false|target_path=/m/' || n"),
    ("B", "serving_config", "'env_var_set=MY_TOKEN|reason=the variable name indicates a credential|value_withheld=true'"),
    ("B", "serving_config", "'env_var_set=MODE|value=m' || n || '|value_withheld=false'"),
    ("Y", "container_manifest", "'image=c' || n"), ("Y", "serving_config", "'env_var_set=LEVEL|value=' || n || '|value_withheld=false'"),
    ("Y", "provider_endpoint", "'declared_in=url|endpoint_url=https://h' || k || '.example/p|host=h' || k || '.example|is_loopback_or_private=false'"),
    ("T", "sdk_dependency", "'category=other|ecosystem=cargo|name=crate-' || n || '|version=' || k"), ("C", "base_model_reference", "'base_ref=org/m' || n || '|revision_pinned=false'"),
    ("I", "shard_index", "'shard_file_count=' || (k % 2 + 1) || '|tensor_count=2'"),
    ("S", "retrieval_index", "'evidence=a store file of this kind is in the scanned scope|store=faiss'"),
]
register("o_kit_fact", " UNION ALL ".join(f"SELECT '{letter}-' || k AS artifact_id, '{kind}' AS kind, {said} AS said FROM {{v_kit}}" for letter, kind, said in KIT_FACTS)
         + """ UNION ALL SELECT 'H-' || SUBSTRING(artifact_id, 3), 'tensor_header', 'dtypes=F32|header_bytes=' || header_bytes || '|largest_tensor_elements=' || ((file_size - header_bytes - 8) // 4)
  || '|max_rank=1|parameters=' || ((file_size - header_bytes - 8) // 4) || '|tensor_count=1' FROM {v_kit_header}""")


def kit(get):
    return [get("v_kit_file"), get("v_kit_line"), get("v_kit_body"), get("v_kit_header")]


@query("scan_files", "SELECT artifact_id, kind, said FROM {o_kit_fact}")
def scan_files(get):
    """Whole facts, every field of every kind, of ten sorts of files per supplier."""
    value = lambda v: F.coalesce(v["i"].cast("string"), v["num"], v["s"], v["b"].cast("string"), F.array_join(v["l"], ","))
    said = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], value(e["value"])))), "|")
    return scan(*kit(get)).facts.select("artifact_id", "kind", said.alias("said"))


@query("scan_file_notes", """SELECT case_id, 'CL-FMT-002' AS rule_id, path_alias, 'no reader for this type and name' AS detail FROM {v_kit_file}
WHERE artifact_type = 'opaque_serialization' OR path_alias LIKE '%/environment.yml'""")
def scan_file_notes(get):
    return reader_notes(route(*kit(get)))


@query("scan_conclusions", """SELECT c.case_id, f.facet, c.files FROM (SELECT case_id, COUNT(*) AS files FROM {v_kit_file} GROUP BY case_id) c
CROSS JOIN (SELECT UNNEST(['weight_origin', 'parameter_update', 'training_stage', 'inference_augmentation']) AS facet) f""")
def scan_conclusions(get):
    """From files to conclusions: every case is concluded on all facets, whatever of it could be read."""
    files, lines, bodies, headers = kit(get)
    cases = files.select("case_id").distinct()
    none = F.lit(None).cast("string")
    declared = cases.select("case_id", *[none.alias(c) for c in ("weight_origin", "parameter_update", "training_stage")],
                            F.array().cast("array<string>").alias("inference_augmentation"), none.alias("exact_claim_text"))
    full = files.withColumn("read_status", F.lit("ok")).withColumn("mtime", F.lit(None).cast("timestamp"))
    result, _ = screen(cases, full, lines, bodies, declared, headers)
    counted = files.groupBy("case_id").agg(F.count("*").alias("files"))
    return result.conclusions.select("case_id", "facet").join(counted, "case_id")
