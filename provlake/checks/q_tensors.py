"""Checks of container facts."""

from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.checks.registry import joined, query
from provlake.checks.sqlviews import dim, idiv, lit, pick, register
from provlake.operators import tensors as T

FILE = idiv("p_partkey", 64)
LAYER = idiv("p_partkey", 2)
BAD = f"({FILE} % 3 = 0)"
register("v_tensor_base", f"""
SELECT p_partkey AS p, 'f' || {FILE} AS artifact, {LAYER} AS layer, {BAD} AS bad, p_size, p_brand,
  {LAYER} % 16 + 1 + CASE WHEN p_partkey % 2 = 1 AND {LAYER} % 50 = 7 THEN 1 ELSE 0 END AS r,
  {pick(f'{LAYER} % 6', ['F32', 'BF16', 'I8', 'F16', 'F8_E4M3', 'X9'])} AS dtype,
  {pick(f'{LAYER} % 6', [4, 2, 1, 2, 1, 3])} AS width
FROM {{part}}""")
register("v_tensor", """
SELECT artifact, 'layers.' || layer || CASE WHEN p % 37 = 0 THEN '.modules_to_save' ELSE '' END ||
  CASE WHEN layer % 2 = 0 THEN '.q_proj' ELSE '.v_proj' END ||
  CASE WHEN p % 31 = 0 THEN '.lora_magnitude_vector' WHEN p % 43 = 0 THEN '' WHEN layer % 11 = 0 THEN '.lora_embedding_' || CASE WHEN p % 2 = 0 THEN 'A' ELSE 'B' END
    ELSE '.lora_' || CASE WHEN p % 2 = 0 THEN 'A' ELSE 'B' END END || '.weight' AS name,
  dtype, CASE WHEN bad AND p % 59 = 0 THEN -1 WHEN p % 2 = 0 THEN r ELSE 8 END AS d0, CASE WHEN p % 2 = 0 THEN 8 ELSE r END AS d1,
  CASE WHEN bad AND p % 61 = 0 THEN p % 64 * 2000 + r * 8 * width + 5
       WHEN bad AND p % 40 = 0 THEN p % 64 * 2000 - 1990 * CASE WHEN p % 64 > 0 THEN 1 ELSE 0 END ELSE p % 64 * 2000 END AS b,
  p % 64 * 2000 + r * 8 * width + CASE WHEN bad AND p % 53 = 0 THEN 1 ELSE 0 END
    - CASE WHEN bad AND p % 40 = 0 AND p % 61 <> 0 THEN 1990 * CASE WHEN p % 64 > 0 THEN 1 ELSE 0 END ELSE 0 END AS e, p, p_size, p_brand
FROM {v_tensor_base}""")
register("v_tfile", """
SELECT artifact, 1000 AS data_start, CASE WHEN MIN(p) % 5 = 0 THEN 100000 ELSE 1000000 END AS file_size FROM {v_tensor} GROUP BY artifact""")


def tensors(get):
    return get("v_tensor").select("artifact", "name", "dtype", F.array("d0", "d1").cast("array<bigint>").alias("shape"),
                                  F.col("b").cast("bigint").alias("begin"), F.col("e").cast("bigint").alias("end"))


@query("tensor_explode", """SELECT artifact, name, dtype, d0 || 'x' || d1 AS shape, CAST(b AS BIGINT) AS begin, CAST(e AS BIGINT) AS "end" FROM {v_tensor}""")
def tensor_explode(get):
    # a file holds at most 64 tensors here, so a header is a bounded text
    entry = F.struct("name", F.struct("dtype", F.array("d0", "d1").alias("shape"), F.array("b", "e").alias("data_offsets")))
    headers = (get("v_tensor").groupBy("artifact").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
               .select("artifact", F.to_json("m").alias("header_json")))
    return T.tensor_explode(headers).select("artifact", "name", "dtype", joined(F.col("shape").cast("array<string>"), "x").alias("shape"), "begin", "end")


WIDTH = "CASE dtype " + " ".join(f"WHEN '{d}' THEN {w}" for d, w in V.DTYPE_BYTES) + " END"
register("o_check", f"""
SELECT *, d0 * d1 AS elements, CASE WHEN d0 < 0 OR d1 < 0 THEN 'shape_dimension' WHEN b > e THEN 'begin_after_end'
  WHEN {WIDTH} IS NOT NULL AND e - b <> d0 * d1 * {WIDTH} THEN 'span_length' END AS reason, {WIDTH} IS NOT NULL AS dtype_known FROM {{v_tensor}}""")


@query("tensor_check", "SELECT artifact, name, CAST(elements AS BIGINT) AS elements, reason, dtype_known FROM {o_check}")
def tensor_check(get):
    return T.tensor_check(tensors(get)).select("artifact", "name", "elements", "reason", "dtype_known")


register("o_overlap", """
SELECT artifact, name, CAST(b AS BIGINT) AS begin, prev_name, CAST(prev_end AS BIGINT) AS prev_end FROM (
  SELECT *, LAG(name) OVER w AS prev_name, LAG(e) OVER w AS prev_end FROM {o_check} WHERE reason IS NULL
  WINDOW w AS (PARTITION BY artifact ORDER BY b, e, name)) t WHERE b < prev_end""")


@query("tensor_overlap", "SELECT * FROM {o_overlap}")
def tensor_overlap(get):
    return T.tensor_overlap(tensors(get))


register("o_past", """
SELECT f.artifact, CAST(MAX(e) AS BIGINT) AS max_end, f.file_size FROM {v_tfile} f JOIN {o_check} c ON c.artifact = f.artifact
WHERE c.reason IS NULL GROUP BY f.artifact, f.file_size, f.data_start HAVING f.data_start + MAX(e) > f.file_size""")


@query("tensor_past_end", "SELECT * FROM {o_past}")
def tensor_past_end(get):
    return T.past_end(tensors(get), get("v_tfile"))


register("o_usable", """
SELECT * FROM {o_check} WHERE artifact NOT IN (SELECT artifact FROM {o_check} WHERE reason IS NOT NULL
  UNION ALL SELECT artifact FROM {o_overlap} UNION ALL SELECT artifact FROM {o_past})""")


@query("tensor_summary", """
SELECT artifact, COUNT(*) AS tensor_count, CAST(SUM(elements) AS BIGINT) AS parameters, STRING_AGG(DISTINCT dtype, '|' ORDER BY dtype) AS dtypes,
  2 AS max_rank, CAST(MAX(elements) AS BIGINT) AS largest_tensor_elements FROM {o_usable} GROUP BY artifact""")
def tensor_summary(get):
    return T.tensor_summary(tensors(get), get("v_tfile")).withColumn("dtypes", joined("dtypes"))


register("o_lora", """
SELECT *, REGEXP_EXTRACT(name, '^(.*?)(lora_magnitude_vector|lora_embedding_A|lora_embedding_B|lora_A|lora_B)(.*)$', 1) AS prefix,
  REGEXP_EXTRACT(name, '^(.*?)(lora_magnitude_vector|lora_embedding_A|lora_embedding_B|lora_A|lora_B)(.*)$', 2) AS marker FROM {v_tensor}""")


@query("lora_pairs", """
WITH m AS (SELECT *, CASE WHEN marker LIKE 'lora_emb%' THEN 'emb' ELSE 'lora' END AS family FROM {o_lora} WHERE marker <> ''),
h AS (SELECT artifact, family, prefix, MAX(CASE WHEN marker LIKE '%A' THEN d0 END) AS ra, MAX(CASE WHEN marker LIKE '%B' THEN d1 END) AS rb
      FROM m WHERE marker <> 'lora_magnitude_vector' GROUP BY artifact, family, prefix),
k AS (SELECT artifact, UNNEST([ra, rb]) AS r FROM h WHERE ra IS NOT NULL AND rb IS NOT NULL)
SELECT a.artifact, COUNT(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) AS lora_pair_count,
  COUNT(*) FILTER (WHERE h.artifact IS NOT NULL AND (ra IS NULL OR rb IS NULL)) AS unpaired_key_count, COUNT(*) FILTER (WHERE ra <> rb) AS rank_disagreement_count,
  COALESCE((SELECT STRING_AGG(CAST(r AS VARCHAR), '|' ORDER BY r) FROM (SELECT DISTINCT r FROM k WHERE k.artifact = a.artifact) z), '') AS inferred_ranks,
  (SELECT STRING_AGG(DISTINCT s, '|' ORDER BY s) FROM (SELECT REGEXP_EXTRACT(prefix, '([^.]+)[.]*$', 1) AS s FROM m WHERE m.artifact = a.artifact) y) AS target_module_suffixes,
  (SELECT BOOL_OR(marker = 'lora_magnitude_vector') FROM m WHERE m.artifact = a.artifact) AS has_dora,
  (SELECT BOOL_OR(CONTAINS(name, 'modules_to_save')) FROM {v_tensor} v WHERE v.artifact = a.artifact) AS modules_to_save_present
FROM (SELECT DISTINCT artifact FROM m) a LEFT JOIN h ON h.artifact = a.artifact GROUP BY a.artifact""")
def lora_pairs(get):
    return (T.lora_pairs(tensors(get)).withColumn("inferred_ranks", joined("inferred_ranks"))
            .withColumn("target_module_suffixes", joined("target_module_suffixes")))


register("v_meta", "SELECT artifact, 'k' || (p % 3) AS key, CASE p % 5 WHEN 0 THEN 'GPTQ v2' WHEN 1 THEN 'nf4' ELSE 'plain' END AS value FROM {v_tensor} WHERE p % 13 = 0")
register("v_code", "SELECT 'g' || p AS artifact, p_size % 21 AS code FROM {v_tensor}")
register("v_qconfig", """SELECT 'c' || p AS artifact, CASE WHEN p % 3 = 0 THEN '{{{{"quantization_config":{{{{"bits":4,"quant_method":"m' || p_size || '"}}}}}}}}' ELSE '{{{{"a":1}}}}' END AS body,
  p, p_size FROM {v_tensor}""".replace("{{{{", "{{").replace("}}}}", "}}"))
HINT = "CASE " + " ".join(f"WHEN CONTAINS(LOWER(key || '|' || value), '{h}') THEN '{h}'" for h in V.QUANT_HINTS) + " END"
register("d_ftype", dim([(c, n) for c, n in V.GGUF_FILE_TYPES], "code, name"))


@query("quantization_records", f"""
SELECT artifact, 'dtype' AS source, STRING_AGG(DISTINCT dtype, ',' ORDER BY dtype) AS detail FROM {{o_usable}}
  WHERE dtype IN ({', '.join(map(lit, V.EIGHT_BIT_DTYPES))}) GROUP BY artifact
UNION ALL SELECT artifact, 'metadata', MIN(key || ':' || {HINT}) FROM {{v_meta}} WHERE {HINT} IS NOT NULL GROUP BY artifact
UNION ALL SELECT c.artifact, 'file_type', d.name FROM {{v_code}} c JOIN {{d_ftype}} d ON d.code = c.code WHERE c.code > 1
UNION ALL SELECT artifact, 'config', 'm' || p_size FROM {{v_qconfig}} WHERE p % 3 = 0""")
def quantization_records(get):
    return T.quantization_records(T.usable_tensors(tensors(get), get("v_tfile")), get("v_meta"),
                                  get("v_code"), get("v_qconfig"))


register("v_kv", f"""
SELECT 'm' || {idiv('p_partkey', 4)} AS artifact,
  CASE p_partkey % 4 WHEN 0 THEN 'general.architecture' WHEN 1 THEN {pick('p_size % 3', ['llama', 'qwen', 'gemma'])} || '.context_length'
    WHEN 2 THEN 'mistral.context_length' ELSE 'llama.block_count' END AS key,
  CASE WHEN p_partkey % 4 > 0 AND p_size % 5 > 0 THEN p_size * 128 END AS ival,
  CASE WHEN p_partkey % 4 = 0 THEN {pick('p_size % 2', ['llama', 'qwen'])} END AS sval FROM {{part}}""")


@query("gguf_kv", """
WITH i AS (SELECT k.*, REGEXP_EXTRACT(key, '[.](context_length|block_count)$', 1) AS leaf,
   (SELECT sval FROM {v_kv} a WHERE a.artifact = k.artifact AND a.key = 'general.architecture') AS arch FROM {v_kv} k WHERE ival IS NOT NULL)
SELECT artifact, leaf, CASE WHEN MAX(key = arch || '.' || leaf) THEN MAX(arch || '.' || leaf) WHEN COUNT(*) = 1 THEN MAX(key) END AS source_key,
  CASE WHEN MAX(key = arch || '.' || leaf) THEN MAX(CASE WHEN key = arch || '.' || leaf THEN ival END) WHEN COUNT(*) = 1 THEN MAX(ival) END AS value,
  CASE WHEN NOT MAX(key = arch || '.' || leaf) AND COUNT(*) > 1 THEN 'CL-FMT-004' END AS note
FROM i WHERE leaf <> '' GROUP BY artifact, leaf""")
def gguf_kv(get):
    return T.gguf_kv(get("v_kv"))


