"""Checks of inventory and sources."""

from pyspark.sql import functions as F

from provlake.checks.registry import query
from provlake.checks.sqlviews import dim, register
from provlake.sources import inventory as I

HEX = lambda b: b.hex().upper()
GGUF, SQLITE, ZIP, PB, TEXT = HEX(b"GGUF"), HEX(b"SQLite format 3\x00"), HEX(b"PK\x03\x04"), HEX(b"\x08\x12"), HEX(b"hello")
ST = HEX((16).to_bytes(8, "little") + b'{"')
TRACE = b'{"Query": "a", "retrieved": []}'.hex().upper()
TEMPLATE = b"Use {context}".hex().upper()
FILES = [  # name, first bytes, type
    ("weights.dat", GGUF, "gguf"), ("x.safetensors", ST, "safetensors"), ("y.safetensors", TEXT, "unrecognised"),
    ("some.db", SQLITE, "vector_index"), ("m.onnx", PB, "onnx"), ("n.onnx", TEXT, "onnx"),
    ("adapter_config.json", TEXT, "peft_adapter_config"), ("Config.JSON", TEXT, "transformers_config"),
    ("generation_config.json", TEXT, "generation_config"), ("tokenizer.json", TEXT, "tokenizer_config"),
    ("trainer_state.json", TEXT, "trainer_state"), ("args.json", TEXT, "training_args"), ("README.md", TEXT, "model_card"),
    ("Dockerfile", TEXT, "deployment_manifest"), ("requirements.txt", TEXT, "dependency_lockfile"),
    ("index.faiss", TEXT, "vector_index"), (".env", TEXT, "serving_config"), ("model.safetensors.index.json", TEXT, "shard_index"),
    ("docker-compose.prod.yml", TEXT, "deployment_manifest"), ("ds_config_zero3.json", TEXT, "deepspeed_config"),
    ("my_accelerate.yaml", TEXT, "accelerate_config"), ("pytorch_model.bin", TEXT, "opaque_serialization"),
    ("wheel.whl", ZIP, "opaque_serialization"), ("t.jsonl", TRACE, "retrieval_trace"), ("m.jsonl", TEXT, "training_log"),
    ("p.txt", TEMPLATE, "vector_index"), ("train_1.out", TEXT, "training_log"), ("run.log", TEXT, "training_log"),
    ("a.json", TEXT, "generic_json"), ("a.yml", TEXT, "generic_yaml"), ("a.toml", TEXT, "generic_toml"),
    ("notes.rst", TEXT, "plain_text"), ("noext", TEXT, "unrecognised"), ("q.gguf", "00", "unrecognised"),
]
register("d_file", dim([(i, *f) for i, f in enumerate(FILES)], "no, name, head_hex, artifact_type"))
register("v_listing", f"""
SELECT CAST(SUBSTRING(source, 4) AS BIGINT) AS case_id, doc_id, '/Data/' || source || '/' || lang || '/d' || (doc_id % 9) || '/' || doc_id || '/' || f.name AS path, f.name,
  f.head_hex, f.artifact_type, n_chars AS size_bytes, 1704067200 + doc_id * 60 AS mtime, doc_id % 29 = 0 AS is_link,
  CASE WHEN doc_id % 31 = 0 THEN 70 ELSE 6 END AS depth, text AS content FROM {{documents}} d JOIN {{d_file}} f ON f.no = d.doc_id % {len(FILES)}""")
register("o_numbered", """SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY REPLACE(path, '/', CHR(1))) AS seq FROM {v_listing}""")


@query("assign_ids", "SELECT doc_id, seq, 'A-' || CASE WHEN seq < 10000 THEN LPAD(CAST(seq AS VARCHAR), 4, '0') ELSE CAST(seq AS VARCHAR) END AS id FROM {o_numbered}")
def assign_ids(get):
    return I.assign_ids(get("v_listing").select("case_id", "path", "doc_id"), "A").select("doc_id", "seq", "id")


register("o_reached", """SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY REPLACE(path, '/', CHR(1))) AS seq FROM {v_listing} WHERE depth <= 64""")
ARTIFACT = """SELECT case_id, seq AS artifact_seq, 'A-' || CASE WHEN seq < 10000 THEN LPAD(CAST(seq AS VARCHAR), 4, '0') ELSE CAST(seq AS VARCHAR) END AS artifact_id, path,
  CASE WHEN is_link THEN 0 ELSE size_bytes END AS size_bytes, CASE WHEN NOT is_link THEN mtime END AS mtime,
  CASE WHEN is_link THEN 'skipped_reparse_point' ELSE 'ok' END AS read_status"""
LISTED = ["case_id", "path", "depth", "size_bytes", "mtime", "is_link"]


@query("artifact_inventory", ARTIFACT + " FROM {o_numbered}")
def artifact_inventory(get):
    return I.artifact_inventory(get("v_listing").select(*LISTED))


@query("artifact_inventory_limited", ARTIFACT + " FROM {o_reached} WHERE seq <= 40")
def artifact_inventory_limited(get):
    return I.artifact_inventory(get("v_listing").select(*LISTED), max_depth=64, max_files=40)


@query("inventory_notes", "SELECT case_id, 'CL-INV-003' AS rule_id, path, 'link not followed' AS detail, 0 AS left_out FROM {v_listing} WHERE is_link")
def inventory_notes(get):
    return I.inventory_notes(get("v_listing"))


@query("inventory_notes_limited", """
SELECT case_id, 'CL-INV-006' AS rule_id, '' AS path, 'traversal depth limit reached' AS detail, COUNT(*) AS left_out FROM {v_listing} WHERE depth > 64 GROUP BY case_id
UNION ALL SELECT case_id, 'CL-INV-006', '', 'file limit reached', COUNT(*) - 40 FROM {v_listing} WHERE depth <= 64 GROUP BY case_id HAVING COUNT(*) > 40
UNION ALL SELECT case_id, 'CL-INV-003', path, 'link not followed', 0 FROM {v_listing} WHERE is_link AND depth <= 64""")
def inventory_notes_limited(get):
    return I.inventory_notes(get("v_listing"), max_depth=64, max_files=40)


@query("artifact_classify", "SELECT doc_id, name, artifact_type FROM {v_listing}")
def artifact_classify(get):
    return get("v_listing").select("doc_id", "name", I.artifact_type(F.col("name"), F.unhex("head_hex")).alias("artifact_type"))


# every case has the same root with and without its slash, one inside another, and one whose name only begins like another's
register("v_root", """
SELECT DISTINCT CAST(SUBSTRING(source, 4) AS BIGINT) AS case_id, n.no AS root_no, REPLACE(n.root, '?', source) AS root FROM {documents} JOIN (
  SELECT * FROM (VALUES (1, '/data/?/fr/d1'), (2, '/data/?/EN'), (3, '/Data/?/en/'), (4, '/data/?/FR'), (5, '/data/?/en/d2/'), (6, '/data/?/e'), (7, '/data/?/de/d1'), (8, '/data/?/de/d1/')) AS t(no, root)) n
  ON n.no <> LENGTH(source)""")


@query("distinct_roots", """
SELECT case_id, root_no, root FROM {v_root} r WHERE NOT EXISTS (SELECT 1 FROM {v_root} o WHERE o.case_id = r.case_id AND o.root_no <> r.root_no
  AND CASE WHEN RTRIM(LOWER(o.root), '/') = RTRIM(LOWER(r.root), '/') THEN o.root_no < r.root_no
      ELSE STARTS_WITH(LOWER(r.root), RTRIM(LOWER(o.root), '/') || '/') END)""")
def distinct_roots(get):
    return I.distinct_roots(get("v_root"))


@query("path_alias", """
SELECT doc_id, COALESCE((SELECT MIN_BY('ROOT' || root_no || SUBSTRING(l.path, LENGTH(RTRIM(root, '/')) + 1), root_no) FROM {v_root} r WHERE r.case_id = l.case_id
   AND STARTS_WITH(LOWER(l.path), RTRIM(LOWER(root), '/') || '/')), '[OUT-OF-SCOPE-PATH]') AS path_alias FROM {v_listing} l""")
def path_alias(get):
    return I.path_alias(get("v_listing").select("case_id", "doc_id", "path"), get("v_root")).select("doc_id", "path_alias")


register("v_excluded", "SELECT DISTINCT CAST(SUBSTRING(source, 4) AS BIGINT) AS case_id, '/data/' || source || '/DE/d' || (doc_id % 3) AS excluded FROM {documents} WHERE doc_id % 2 = 0")


@query("root_scope", """
SELECT doc_id, CASE WHEN x THEN 0 ELSE size_bytes END AS size_bytes, CASE WHEN NOT x THEN mtime END AS mtime, CASE WHEN x THEN 'skipped_by_submitter' ELSE 'ok' END AS read_status
FROM (SELECT l.*, EXISTS (SELECT 1 FROM {v_excluded} e WHERE e.case_id = l.case_id AND STARTS_WITH(LOWER(l.path), LOWER(e.excluded) || '/')) AS x FROM {v_listing} l) t""")
def root_scope(get):
    return I.root_scope(get("v_listing").select("case_id", "doc_id", "path", "size_bytes", "mtime"), get("v_excluded")).select("doc_id", "size_bytes", "mtime", "read_status")


register("v_opened", """SELECT doc_id, content, doc_id % 13 <> 0 AS opened, size_bytes AS size_before, size_bytes + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS size_after,
  mtime AS mtime_before, mtime + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS mtime_after FROM {v_listing}""")


def digest_sql(view: str, budget: int) -> str:
    return f"""
SELECT doc_id, CASE WHEN opened THEN SHA256(ARRAY_SLICE(ENCODE(content), 1, {budget})) END AS sha256, CASE WHEN NOT opened THEN 'none' WHEN STRLEN(content) > {budget} THEN 'head_only' ELSE 'full' END AS hash_scope,
  CASE WHEN opened THEN LEAST(STRLEN(content), {budget}) END AS bytes_hashed,
  CASE WHEN NOT opened THEN 'not_hashed' WHEN size_before <> size_after OR mtime_before <> mtime_after THEN 'changed' WHEN STRLEN(content) > {budget} THEN 'too_large' ELSE 'ok' END AS read_status,
  CONCAT_WS('|', CASE WHEN opened AND (size_before <> size_after OR mtime_before <> mtime_after) THEN 'CL-INV-004' END, CASE WHEN opened AND STRLEN(content) > {budget} THEN 'CL-INV-005' END) AS notes
FROM {{{view}}}"""


DIGEST = ["doc_id", "sha256", "hash_scope", "bytes_hashed", "read_status", "notes"]


@query("content_digest", digest_sql("v_opened", 1_000_000_000))
def content_digest(get):
    return I.content_digest(get("v_opened")).select(*DIGEST)


@query("content_digest_budget", digest_sql("v_opened", 700))
def content_digest_budget(get):
    return I.content_digest(get("v_opened"), 700).select(*DIGEST)


register("v_status", """SELECT CAST(FLOOR(o_orderkey / 5) AS BIGINT) AS case_id, CASE WHEN CAST(FLOOR(o_orderkey / 5) AS BIGINT) % 3 = 0 THEN 'ok' WHEN o_custkey % 5 = 0 THEN 'permission_denied' WHEN o_custkey % 7 = 0 THEN 'not_found' ELSE 'ok' END AS outcome,
  CASE WHEN CAST(FLOOR(o_orderkey / 5) AS BIGINT) % 11 = 0 THEN 'io_error' WHEN CAST(FLOOR(o_orderkey / 5) AS BIGINT) % 3 = 0 THEN 'ok' WHEN o_custkey % 5 = 0 THEN 'access_denied' WHEN o_custkey % 7 = 0 THEN 'io_error' WHEN o_custkey % 9 = 0 THEN 'not_hashed' ELSE 'ok' END AS read_status FROM {orders}""")
register("v_fmt_note", "SELECT CAST(FLOOR(o_orderkey / 5) AS BIGINT) AS case_id, CASE WHEN o_custkey % 2 = 0 THEN 'CL-FMT-002' ELSE 'CL-FMT-010' END AS rule_id FROM {orders} WHERE o_orderkey % 37 = 0")
register("o_coverage", """
SELECT c.case_id, CASE WHEN NOT COALESCE(BOOL_OR(s.read_status IN ('ok', 'too_large', 'changed', 'not_hashed')), FALSE) THEN 'minimal'
  WHEN NOT EXISTS (SELECT 1 FROM {v_fmt_note} n WHERE n.case_id = c.case_id) AND BOOL_AND(s.read_status = 'ok') THEN 'complete' ELSE 'partial' END AS coverage_status
FROM {v_case} c LEFT JOIN {v_status} s ON s.case_id = c.case_id GROUP BY c.case_id""")


@query("coverage_status", "SELECT * FROM {o_coverage}")
def coverage_status(get):
    return I.coverage_status(get("v_case"), get("v_status"), get("v_fmt_note"))


@query("coverage_ledger", """
SELECT case_id, rule_id, COUNT(*) AS notes FROM (SELECT case_id, CASE outcome WHEN 'permission_denied' THEN 'CL-INV-002' ELSE 'CL-INV-006' END AS rule_id FROM {v_status} WHERE outcome <> 'ok'
  UNION ALL SELECT case_id, rule_id FROM {v_fmt_note}) t GROUP BY case_id, rule_id""")
def coverage_ledger(get):
    failed = get("v_status").where("outcome <> 'ok'").withColumn("rule_id", I.io_outcome(F.col("outcome"))[1])
    return I.coverage_ledger([failed, get("v_fmt_note")])
