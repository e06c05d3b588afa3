"""Checks of dependencies, retrieval, deployment and configuration facts."""

from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.checks import views_facts as VF
from provlake.checks.registry import joined, query
from provlake.checks.sqlviews import dim, idiv, lit, pick, register
from provlake.functions.fields import any_bool, any_int, any_list, any_text
from provlake.operators import configs as C
from provlake.operators import dependencies as D
from provlake.operators import deployment as P
from provlake.operators import retrieval as R

B = lambda s: s.replace("{", "{{").replace("}", "}}")  # noqa: E731  braces of JSON inside a view text

# --- dependency lists -----------------------------------------------------------
register("d_package", dim([(i, p, c) for i, (p, c) in enumerate(V.PACKAGE_CATEGORY)], "no, package, category"))
register("v_dep_part", f"""
SELECT 's' || {idiv('p_partkey', 100)} AS file, p_partkey AS line_no, p_partkey % 8 AS form,
  COALESCE(d.package, 'mod-' || p_partkey) AS package, COALESCE(d.category, 'other') AS category, p_size || '.' || (p_partkey % 10) AS ver
FROM {{part}} LEFT JOIN {{d_package}} d ON d.no = p_partkey % 53""")
register("v_dep", """
SELECT file, line_no, CASE form WHEN 0 THEN '# note ' || package WHEN 1 THEN '-r other.txt' WHEN 2 THEN '   '
  WHEN 3 THEN package || '==' || ver WHEN 4 THEN UPPER(package) || '>=' || ver || ',<9' WHEN 5 THEN package || '[extra]==' || ver || ' # why'
  WHEN 6 THEN REPLACE(package, '-', '_') ELSE package || ' ; python_version<"3.9"' END AS line FROM {v_dep_part}""")


@query("dependency_packages", """
SELECT file, line_no, package AS name, 'python' AS ecosystem, category,
  CASE form WHEN 3 THEN ver WHEN 4 THEN ver WHEN 5 THEN '[extra]==' || ver END AS version
FROM {v_dep_part} WHERE form > 2""")
def dependency_packages(get):
    return D.dependency_packages(get("v_dep"))


@query("dependency_packages_limited", """
SELECT file, line_no, package AS name, 'python' AS ecosystem, category,
  CASE form WHEN 3 THEN ver WHEN 4 THEN ver WHEN 5 THEN '[extra]==' || ver END AS version
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM {v_dep_part} WHERE form > 2) t WHERE rn <= 30""")
def dependency_packages_limited(get):
    return D.dependency_packages(get("v_dep"), limit=30)


register("v_npm", f"""
SELECT 'n' || line_no AS file, '{B('{"dependencies": {"')}' || package || '": "^' || ver || '{B('"}, "packages": {"node_modules/a/node_modules/')}' || package
  || '{B('": {"version": "')}' || ver || '{B('", "dev": true}}}')}' AS body, package, category, ver FROM {{v_dep_part}}""")


@query("npm_packages", """SELECT file, 0 AS section_no, package AS name, 'npm' AS ecosystem, category, '^' || ver AS version FROM {v_npm}
UNION ALL SELECT file, 2, package, 'npm', category, ver FROM {v_npm}""")
def npm_packages(get):
    return D.npm_packages(get("v_npm"))


# --- retrieval traces -------------------------------------------------------------
register("v_turn", """
SELECT u.conv_id, u.turn, 'f' || (u.conv_id % 20) AS file, u.conv_id * 1000 + u.turn AS line_no, @SHA(u.text@) AS asked, @SHA(a.text@) AS told
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
register("v_trace", f"""
SELECT file, line_no, conv_id, '{B('{"')}' || CASE conv_id % 4 WHEN 0 THEN 'query' WHEN 1 THEN 'question' WHEN 2 THEN 'input' ELSE 'query' END || '": '
  || CASE WHEN conv_id % 23 = 0 THEN '7' WHEN conv_id % 29 = 0 THEN '""' ELSE '"' || asked || '"' END
  || ', "' || CASE conv_id % 3 WHEN 0 THEN 'retrieved' WHEN 1 THEN 'documents' ELSE 'chunks' END || '": '
  || CASE WHEN conv_id % 19 = 0 THEN '[]' WHEN conv_id % 17 = 0 THEN '["' || told || '"]'
     ELSE '[{B('{"text": "')}' || told || '{B('", "score": 0.9}, {"text": "b", "')}' || CASE WHEN conv_id % 6 = 0 THEN 'rank' ELSE 'distance' END || '{B('": 1}]')}' END
  || ', "k' || (line_no % 90) || '{B('": 1}')}' AS line FROM {{v_turn}}""")
FULL = "NOT (conv_id % 23 = 0 OR conv_id % 29 = 0 OR conv_id % 19 = 0 OR conv_id % 17 = 0 OR conv_id % 6 = 0)"
register("o_entry", "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM {v_trace}) t WHERE rn <= 120")


def chain_sql(view: str, names: int) -> str:
    return f"""
WITH n AS (SELECT DISTINCT file, UNNEST(JSON_KEYS(line)) AS name FROM {{{view}}}),
k AS (SELECT file, STRING_AGG(name, '|' ORDER BY name) AS field_names FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file ORDER BY name) AS rn FROM n) t
      WHERE rn <= {names} GROUP BY file)
SELECT e.file, COUNT(*) AS entry_count, COUNT(*) FILTER (WHERE {FULL}) AS full_chain_entry_count, BOOL_AND({FULL}) AS request_level_chain,
  FALSE AS malformed, MAX(k.field_names) AS field_names FROM {{{view}}} e JOIN k ON k.file = e.file GROUP BY e.file"""


@query("retrieval_chain", chain_sql("v_trace", 1_000_000_000))
def retrieval_chain(get):
    return R.retrieval_chain(get("v_trace")).withColumn("field_names", joined("field_names"))


@query("retrieval_chain_limited", chain_sql("o_entry", 64))
def retrieval_chain_limited(get):
    return R.retrieval_chain(get("v_trace"), limit=120, max_names=64).withColumn("field_names", joined("field_names"))


register("v_prompt", f"""
SELECT 'd' || doc_id AS file, CASE doc_id % 5 WHEN 0 THEN 'Use {B('{context}')} ' WHEN 1 THEN 'Ask {B('{{question}}')} ' WHEN 2 THEN '{B('{documents}')}' ELSE '' END || text AS text,
  doc_id FROM {{documents}}""")


@query("prompt_templates", f"""
SELECT file, text AS preview, SHA256(text) AS sha256, STRLEN(text) AS length_bytes, doc_id % 5 = 0 AS has_context_placeholder
FROM {{v_prompt}} WHERE doc_id % 5 < 3 OR {' OR '.join(f"CONTAINS(text, {lit(m)})" for m in V.PROMPT_MARKERS)}""")
def prompt_templates(get):
    return R.prompt_templates(get("v_prompt"))


STORE_NAMES = ["chroma.sqlite3", "INDEX.faiss", "my_lance", "old-docstore.json", "meta.json", "notes.txt", "index.pkl"]
register("v_store", f"SELECT p_partkey, {pick('p_partkey % 7', STORE_NAMES)} AS file_name FROM {{part}}")
register("v_chunking", f"""SELECT 'c' || p_partkey AS file, '{B('{"a": 1')}' || CASE WHEN p_partkey % 2 = 0 THEN ', "chunk_size": ' || p_size ELSE '' END
  || CASE WHEN p_partkey % 3 = 0 THEN ', "embed_model": "' || p_brand || '"' ELSE '' END || '{B('}')}' AS body, p_partkey, p_size, p_brand FROM {{part}}""")


@query("store_kind", f"SELECT p_partkey, file_name, {pick('p_partkey % 7', ['chroma', 'faiss', 'lancedb', 'llama_index', 'qdrant', None, 'faiss'])} AS store FROM {{v_store}}")
def store_kind(get):
    return get("v_store").withColumn("store", R.store_kind(F.col("file_name")))


@query("chunking_configs", """SELECT file, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS chunk_size, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS embed_model,
  'config' AS store FROM {v_chunking} WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def chunking_configs(get):
    return R.chunking_configs(get("v_chunking")).select("file", "chunk_size", "embed_model", "store")


# --- endpoints, variables, commands, images -----------------------------------------
HOSTS = [h for h, _ in V.PROVIDER_HOSTS]
PROVIDERS = [p for _, p in V.PROVIDER_HOSTS]
register("v_url_part", f"""
SELECT page_id, url AS page_url, CASE WHEN page_id % 4 = 0 THEN {pick(idiv('page_id', 4) + ' % 14', HOSTS)}
   WHEN page_id % 9 = 1 THEN {pick('page_id % 5', ['localhost', '10.0.0.8', '192.168.1.2', '127.0.0.1', '0.0.0.0'])} END AS planted,
  CASE WHEN page_id % 4 = 0 THEN {pick(idiv('page_id', 4) + ' % 14', PROVIDERS)} END AS provider FROM {{pages}}""")
register("v_url", """
SELECT page_id, CASE WHEN page_id % 31 = 5 THEN 'ftp://x/' || page_id WHEN page_id % 31 = 6 THEN 'plain text'
  WHEN planted IS NOT NULL THEN ' "https://' || CASE WHEN page_id % 5 = 0 THEN 'user:p%40ss@' ELSE '' END || planted || ':8080/v1/' || page_id || '?key=secret#frag",'
  ELSE page_url END AS url FROM {v_url_part}""")
register("o_url", """
SELECT page_id, planted, provider, page_url, CASE WHEN planted IS NOT NULL THEN 'https://' || planted || ':8080/v1/' || page_id
  ELSE SPLIT_PART(SPLIT_PART(page_url, '?', 1), '#', 1) END AS endpoint_url FROM {v_url_part} WHERE page_id % 31 NOT IN (5, 6)""")


@query("provider_endpoints", """
SELECT page_id, endpoint_url, COALESCE(planted, SPLIT_PART(SPLIT_PART(endpoint_url, '/', 3), ':', 1)) AS host, provider,
  COALESCE(planted IN ('localhost', '10.0.0.8', '192.168.1.2', '127.0.0.1', '0.0.0.0'), FALSE) AS is_loopback_or_private FROM {o_url}""")
def provider_endpoints(get):
    return P.provider_endpoints(get("v_url"))


NAMES = ["OPENAI_API_KEY", "MODEL_NAME", "BASE_URL", "authToken", "DB_PASSWORD", "MODE", "X_SECRET"]
register("v_env", f"""
SELECT page_id, 'e' || {idiv('page_id', 50)} AS file, page_id AS line_no, CASE page_id % 8 WHEN 7 THEN '# A=' || page_id
  ELSE CASE WHEN page_id % 3 = 0 THEN 'export ' ELSE '  ' END || {pick('page_id % 8', NAMES)} || ' = ' ||
  CASE WHEN page_id % 8 = 2 THEN '"https://u:p@api.x.ai/' || page_id || '?q=1"' ELSE '''v=' || page_id || '''' END END AS line FROM {{pages}}""")


@query("env_vars", f"""
SELECT file, line_no, {pick('page_id % 8', NAMES)} AS name, {pick('page_id % 8', ['credential', 'setting', 'endpoint', 'credential', 'credential', 'setting', 'credential'])} AS role,
  CASE WHEN page_id % 8 IN (1, 5) THEN 'v=' || page_id END AS value, CASE WHEN page_id % 8 = 2 THEN 'https://api.x.ai/' || page_id END AS endpoint_url
FROM {{v_env}} WHERE page_id % 8 < 7""")
def env_vars(get):
    return P.env_vars(get("v_env"))


register("v_cmd", f"""
SELECT p_partkey AS fact_no, CASE p_partkey % 6 WHEN 0 THEN 'vllm serve /models/m' || p_partkey || ' --port ' || (8000 + p_size)
  WHEN 1 THEN 'python -m VLLM.entrypoints --model /models/m' || p_partkey || ' --served-model-name=n' || p_size || ' --enable-lora --lora-modules a=b'
  WHEN 2 THEN 'ollama run qwen' || p_size || ':7b' WHEN 3 THEN 'llama-server -m /models/m' || p_partkey || '.gguf --quantize q' || p_size || ' --port x'
  WHEN 4 THEN 'sglang start --model --port 9000' ELSE 'nginx -g daemon' END AS cmd, p_size FROM {{part}}""")


@query("serving_commands", f"""
SELECT fact_no, p_size, {pick('fact_no % 6', ['vllm', 'vllm', 'ollama', 'llama-server', 'sglang'])} AS engine,
  CASE fact_no % 6 WHEN 0 THEN '/models/m' || fact_no WHEN 1 THEN '/models/m' || fact_no WHEN 2 THEN 'qwen' || p_size || ':7b' WHEN 3 THEN '/models/m' || fact_no || '.gguf' END AS model_path,
  CASE WHEN fact_no % 6 = 1 THEN 'n' || p_size END AS served_model_name, CASE WHEN fact_no % 6 = 1 THEN 'a=b' END AS lora_modules,
  CASE WHEN fact_no % 6 = 3 THEN 'q' || p_size END AS quantization, CASE fact_no % 6 WHEN 0 THEN 8000 + p_size WHEN 4 THEN 9000 END AS port, fact_no % 6 = 1 AS enable_lora
FROM {{v_cmd}} WHERE fact_no % 6 < 5""")
def serving_commands(get):
    return P.serving_commands(get("v_cmd"))


CASE_P = idiv("p_partkey", 7)
register("v_serving", f"""SELECT {CASE_P} AS case_id, 'F-' || p_partkey AS fact_id, CASE WHEN p_partkey % 5 > 0 THEN '/srv/' || p_brand || '/models/m' || (p_partkey % 3) || CASE WHEN p_partkey % 4 = 0 THEN '/' ELSE '' END END AS model_path,
  p_brand, p_partkey FROM {{part}}""")
register("v_case_art", f"""SELECT {CASE_P} AS case_id, 'A-' || p_partkey AS artifact_id, CASE WHEN p_size % 2 = 0 THEN 'ROOT1/models/m' || (p_partkey % 3) ELSE 'ROOT2/other/xm' || (p_partkey % 3) END AS path_alias,
  {pick('p_partkey % 26', V.ARTIFACT_TYPES)} AS artifact_type FROM {{part}}""")


@query("artifact_references", """
SELECT s.case_id, s.fact_id, s.model_path AS target_path, EXISTS (SELECT 1 FROM {v_case_art} a WHERE a.case_id = s.case_id
   AND a.path_alias = 'ROOT1/models/m' || (s.p_partkey % 3)) AS in_scope FROM {v_serving} s WHERE model_path IS NOT NULL""")
def artifact_references(get):
    return P.artifact_references(get("v_serving"), get("v_case_art"))


register("v_build", """SELECT 'b' || p_size AS file, p_partkey AS line_no, CASE p_partkey % 3 WHEN 0 THEN 'FROM repo/img' || p_size || '@sha256:ab' || p_partkey || ' AS x'
  WHEN 1 THEN '  from repo/img:' || p_size ELSE 'RUN from x' END AS line, p_size FROM {part}""")


@query("container_digests", """SELECT file, line_no, 'repo/img' || CASE line_no % 3 WHEN 0 THEN p_size || '@sha256:ab' || line_no ELSE ':' || p_size END AS image,
  CASE WHEN line_no % 3 = 0 THEN 'ab' || line_no END AS image_digest FROM {v_build} WHERE line_no % 3 < 2""")
def container_digests(get):
    return P.container_digests(get("v_build"))


# --- configuration ------------------------------------------------------------------
register("v_adapter_cfg", f"""
SELECT 'a' || p_partkey AS artifact, '{B('{"peft_type": "LORA", "lora_dropout": 0.05, ')}' ||
  CASE p_partkey % 4 WHEN 0 THEN '"r": "8", ' WHEN 1 THEN '"r": ' || p_size || ', ' WHEN 2 THEN '"r": 8.5, ' ELSE '' END
  || '"use_dora": ' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || ', "target_modules": ["v_proj", "q_proj", "v_proj"], "modules_to_save": '
  || CASE WHEN p_size % 3 = 0 THEN '["lm_head"]' ELSE '[]' END || ', "base_model_name_or_path": "' || p_brand || '{B('"}')}' AS body, p_partkey, p_size, p_brand FROM {{part}}""")


@query("config_facts", """SELECT artifact, 'adapter_config' AS kind, CASE WHEN p_partkey % 4 = 1 THEN p_size END AS r, '0.05' AS lora_dropout, p_size % 2 = 0 AS use_dora,
  'q_proj|v_proj' AS target_modules, CASE WHEN p_size % 3 = 0 THEN 'lm_head' END AS modules_to_save, p_brand AS base FROM {v_adapter_cfg}""")
def config_facts(get):
    return C.config_facts(get("v_adapter_cfg"), "peft_adapter_config").select(
        "artifact", "kind", any_int("r").alias("r"), any_text("lora_dropout").alias("lora_dropout"), any_bool("use_dora").alias("use_dora"),
        joined(any_list("target_modules")).alias("target_modules"),
        F.when(any_list("modules_to_save").isNotNull(), joined(any_list("modules_to_save"))).alias("modules_to_save"),
        any_text("base_model_name_or_path").alias("base"))


@query("config_rank_notes", "SELECT artifact, 'CL-FMT-009' AS rule_id, CASE WHEN p_partkey % 4 = 0 THEN 'STRING' ELSE 'DECIMAL(2,1)' END AS r_type FROM {v_adapter_cfg} WHERE p_partkey % 4 IN (0, 2)")
def config_rank_notes(get):
    return C.rank_notes(get("v_adapter_cfg"))


register("v_args", f"""SELECT 't' || p_partkey AS artifact, '{B('{"seed": ')}' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ', "loss_type": "kl' || p_size || '"' ELSE '' END
  || CASE WHEN p_partkey % 3 = 0 THEN ', "task_type": ""' WHEN p_partkey % 3 = 1 THEN ', "task_type": "sft"' ELSE '' END || '{B('}')}' AS body, p_partkey, p_size FROM {{part}}""")


@query("training_objectives", """SELECT artifact, CASE WHEN p_partkey % 3 = 1 THEN 'sft' ELSE 'kl' || p_size END AS objective,
  CASE WHEN p_partkey % 3 = 1 THEN 'task_type' ELSE 'loss_type' END AS declared_in FROM {v_args} WHERE p_partkey % 3 = 1 OR p_partkey % 2 = 0""")
def training_objectives(get):
    return C.training_objectives(get("v_args"))


register("v_index_part", f"SELECT {idiv('p_partkey', 20)} AS case_id, 'i' || {idiv('p_partkey', 20)} AS artifact, 't' || p_partkey AS tensor, 'model-' || (p_size % 7) || '.safetensors' AS shard FROM {{part}}")
register("v_shard_art", f"SELECT {idiv('p_partkey', 20)} AS case_id, 'ROOT1/w/model-' || (p_partkey % 5) || '.safetensors' AS path_alias FROM {{part}} WHERE p_partkey % 3 > 0")


def indexes(get):
    # an index here maps 20 tensors, so its JSON is a bounded text
    return (get("v_index_part").groupBy("case_id", "artifact").agg(F.map_from_entries(F.collect_list(F.struct("tensor", "shard"))).alias("weight_map"))
            .select("case_id", "artifact", F.to_json(F.struct("weight_map")).alias("body")))


@query("shard_completeness", """
SELECT case_id, artifact, COUNT(DISTINCT shard) AS shard_file_count, COUNT(*) AS tensor_count,
  COUNT(DISTINCT CASE WHEN NOT EXISTS (SELECT 1 FROM {v_shard_art} a WHERE a.case_id = i.case_id AND a.path_alias = 'ROOT1/w/' || i.shard) THEN shard END) AS missing_shards
FROM {v_index_part} i GROUP BY case_id, artifact""")
def shard_completeness(get):
    return C.shard_completeness(indexes(get), get("v_shard_art"))


@query("missing_shards", """SELECT DISTINCT case_id, artifact, shard FROM {v_index_part} i
  WHERE NOT EXISTS (SELECT 1 FROM {v_shard_art} a WHERE a.case_id = i.case_id AND a.path_alias = 'ROOT1/w/' || i.shard)""")
def missing_shards(get):
    return C.missing_shards(indexes(get), get("v_shard_art"))


register("v_ref", """SELECT p_partkey, 'org/m' || p_size || CASE p_partkey % 4 WHEN 0 THEN '@abc12345' WHEN 1 THEN '@main' ELSE '' END AS base_ref,
  CASE p_partkey % 3 WHEN 0 THEN 'deadbeef' WHEN 1 THEN '' END AS explicit_revision FROM {part}""")


@query("base_references", """SELECT p_partkey, base_ref, CASE WHEN p_partkey % 3 = 0 THEN 'deadbeef' WHEN p_partkey % 4 = 0 THEN 'abc12345' END AS revision,
  p_partkey % 3 = 0 OR p_partkey % 4 = 0 AS revision_pinned FROM {v_ref}""")
def base_references(get):
    return C.base_references(get("v_ref"))


register("v_card", f"""SELECT 'c' || p_partkey AS artifact, '{B('{"license": "x"')}' || CASE p_partkey % 3 WHEN 0 THEN ', "base_model": "org/' || p_brand || '@' || '0123abc"'
  WHEN 1 THEN ', "base_model": ["a/b", "c/' || p_size || '"]' ELSE '' END || '{B('}')}' AS front, p_partkey, p_brand, p_size FROM {{part}}""")


@query("card_bases", """SELECT artifact, 'org/' || p_brand || '@0123abc' AS base_ref, '0123abc' AS revision, TRUE AS revision_pinned FROM {v_card} WHERE p_partkey % 3 = 0
UNION ALL SELECT artifact, 'a/b', NULL, FALSE FROM {v_card} WHERE p_partkey % 3 = 1
UNION ALL SELECT artifact, 'c/' || p_size, NULL, FALSE FROM {v_card} WHERE p_partkey % 3 = 1""")
def card_bases(get):
    return C.base_references(C.card_bases(get("v_card")))


@query("source_group", f"""SELECT artifact_id, CASE WHEN artifact_type IN ({', '.join(map(lit, V.CONTAINER_TYPES))}) THEN 'artifact::' || artifact_id
  ELSE 'dir::' || REGEXP_EXTRACT(path_alias, '^(.*)/', 1) END AS source_group FROM {{v_case_art}}""")
def source_group(get):
    return get("v_case_art").select("artifact_id", C.source_group(F.col("artifact_type"), F.col("artifact_id"), F.col("path_alias")).alias("source_group"))


@query("field_any", """SELECT case_id, fact_id, CASE WHEN kind = 'checkpoint_step' THEN step END AS step,
  CASE WHEN kind = 'adapter_config' THEN lora_rank END AS rank_value, base_name, CASE WHEN kind = 'training_metric' THEN COALESCE(monotonic, TRUE) END AS ordered FROM {v_fact_flat}""")
def field_any(get):
    k = lambda kind, c: F.when(F.col("kind") == kind, c)
    return VF.facts(get).select(
        "case_id", "fact_id", k("checkpoint_step", any_int("step", "global_step")).alias("step"),
        k("adapter_config", any_int("r", "rank", "lora_rank")).alias("rank_value"),
        any_text("base_ref", "base_model_name_or_path", "_name_or_path").alias("base_name"),
        k("training_metric", F.coalesce(any_bool("steps_monotonic"), F.lit(True))).alias("ordered"))
