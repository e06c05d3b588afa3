"""File listings: scope, aliases, classification, digests, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.operators.ordered import dense_positions


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of every file under ``root``; file bodies are pruned from the scan."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")))


def walk_key(path: Column) -> Column:
    """Sort key of a depth-first walk with names in byte order."""
    return F.translate(path, "/", "\x01")


def assign_ids(rows: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Dense ids per case in walk order: ``A-0001``, ``A-0002``, ..."""
    keyed = rows.withColumn("_walk", walk_key(F.col(path)))
    return (dense_positions(keyed, "case_id", ["_walk"], "seq").drop("_walk")
            .withColumn("id", F.format_string(prefix + "-%04d", F.col("seq"))))


def artifact_inventory(listing: DataFrame, max_depth: int | None = None, max_files: int | None = None) -> DataFrame:
    """``listing``: (case_id, path, depth, size_bytes, mtime, is_link) -> numbered artifact rows.

    Limits, where given, leave out files that are too deep and those past the number in walk order;
    ``inventory_notes`` says how many.  Links are kept, unmeasured.
    """
    reached = listing if max_depth is None else listing.where(F.col("depth") <= max_depth)
    numbered = assign_ids(reached, "A")
    if max_files is not None:
        numbered = numbered.where(F.col("seq") <= max_files)
    return numbered.select(
        "case_id", F.col("seq").alias("artifact_seq"), F.col("id").alias("artifact_id"), "path",
        F.when(F.col("is_link"), 0).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(~F.col("is_link"), F.col("mtime")).alias("mtime"),
        F.when(F.col("is_link"), "skipped_reparse_point").otherwise("ok").alias("read_status"))


def inventory_notes(listing: DataFrame, max_depth: int | None = None, max_files: int | None = None) -> DataFrame:
    """One note per case for each limit met, with the files it left out; one per link."""
    too_deep = F.lit(False) if max_depth is None else F.col("depth") > max_depth
    deep, rest = F.count_if(too_deep), F.count_if(~too_deep)
    per_case = listing.groupBy("case_id").agg(deep.alias("deep"), (rest - F.lit(max_files) if max_files is not None else F.lit(0)).alias("many"))
    limits = per_case.select("case_id", F.inline(F.array(
        F.struct(F.lit("traversal depth limit reached").alias("detail"), F.col("deep").cast("bigint").alias("left_out")),
        F.struct(F.lit("file limit reached").alias("detail"), F.col("many").cast("bigint").alias("left_out"))))).where("left_out > 0")
    links = listing.where("is_link").where(~too_deep)
    return (limits.select("case_id", F.lit("CL-INV-006").alias("rule_id"), F.lit("").alias("path"), "detail", "left_out")
            .unionByName(links.select("case_id", F.lit("CL-INV-003").alias("rule_id"), "path", F.lit("link not followed").alias("detail"),
                                      F.lit(0).cast("bigint").alias("left_out"))))


def _key(path: Column) -> Column:
    """How paths are compared: without case and trailing slashes."""
    return F.rtrim(F.lower(path), F.lit("/"))


def _above(key: Column) -> Column:
    """The folders that hold a path, all levels."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def distinct_roots(roots: DataFrame) -> DataFrame:
    """Drop a root that repeats an earlier one or lies inside another, by components: each looks its folders up."""
    keyed = roots.withColumn("_key", _key(F.col("root")))
    first = keyed.groupBy("case_id", "_key").agg(F.min(F.struct("root_no", "root")).alias("r"))
    inside = (first.select("case_id", "_key", F.explode(_above(F.col("_key"))).alias("_up")).where("_up <> _key")
              .join(first.select("case_id", F.col("_key").alias("_up")), ["case_id", "_up"], "left_semi").select("case_id", "_key").distinct())
    return first.join(inside, ["case_id", "_key"], "left_anti").select("case_id", "r.root_no", "r.root")


def _holders(listing: DataFrame, places: DataFrame, value: Column) -> DataFrame:
    """``listing`` with ``_held``: the least ``value`` of the places (case_id, _place, ...) that hold a file, or are it.

    Files are looked up by their folder, and each folder once by all folders above it, so the work is in equi-joins.
    """
    keyed = listing.withColumn("_key", _key(F.col("path"))).withColumn("_folder", F.regexp_replace("_key", "/[^/]*$", ""))
    named = places.groupBy("case_id", "_place").agg(F.min(value).alias("_v"))
    folders = keyed.select("case_id", "_folder").distinct()
    up = folders.select("case_id", "_folder", F.explode(F.array_distinct(F.concat(_above(F.col("_folder")), F.array("_folder")))).alias("_place"))
    held = up.join(named, ["case_id", "_place"]).groupBy("case_id", "_folder").agg(F.min("_v").alias("_by_folder"))
    exact = named.select("case_id", F.col("_place").alias("_key"), F.col("_v").alias("_itself"))
    return (keyed.join(held, ["case_id", "_folder"], "left").join(exact, ["case_id", "_key"], "left")
            .withColumn("_held", F.least("_by_folder", "_itself")).drop("_key", "_folder", "_by_folder", "_itself"))


def root_scope(listing: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Mark files under an excluded path; their size and time are not shown."""
    places = exclusions.select("case_id", _key(F.col("excluded")).alias("_place"))
    marked = _holders(listing, places, F.lit(1)).withColumn("skipped", F.col("_held").isNotNull())
    return (marked.withColumn("size_bytes", F.when(F.col("skipped"), 0).otherwise(F.col("size_bytes")))
            .withColumn("mtime", F.when(~F.col("skipped"), F.col("mtime")))
            .withColumn("read_status", F.when(F.col("skipped"), "skipped_by_submitter").otherwise("ok"))
            .drop("_held", "skipped"))


def path_alias(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Absolute path -> ``ROOTn/rest`` under the first registered root; else out of scope."""
    places = roots.select("case_id", _key(F.col("root")).alias("_place"), "root_no", "root")
    rest = F.expr("substring(path, length(rtrim('/', _held.root)) + 1)")
    return (_holders(listing, places, F.struct("root_no", "root"))
            .withColumn("path_alias", F.when(F.col("_held").isNull(), V.OUT_OF_SCOPE_PATH)
                        .otherwise(F.concat(F.lit("ROOT"), F.col("_held.root_no").cast("string"), rest)))
            .drop("_held"))


# --- fixed values: names and endings the classifier knows ------------------------
EXACT_NAMES = {
    "peft_adapter_config": ["adapter_config.json"], "transformers_config": ["config.json"],
    "generation_config": ["generation_config.json"],
    "tokenizer_config": ["tokenizer_config.json", "tokenizer.json", "special_tokens_map.json", "vocab.json", "merges.txt"],
    "trainer_state": ["trainer_state.json"], "training_args": ["training_args.json", "args.json", "run_args.json"],
    "model_card": ["readme.md", "model_card.md"], "deployment_manifest": ["dockerfile", "containerfile", "procfile"],
    "dependency_lockfile": ["requirements.txt", "requirements-dev.txt", "cargo.lock", "package.json", "package-lock.json",
                            "pyproject.toml", "poetry.lock", "environment.yml", "environment.yaml", "conda-list.txt", "pip-freeze.txt"],
    "vector_index": ["index.faiss", "index.pkl", "docstore.json", "index_store.json", "chroma.sqlite3", "meta.json",
                     "config_sentence_transformers.json", "modules.json"],
    "serving_config": [".env", ".env.local", ".env.production"],
}
OPAQUE_ENDINGS = ["pt", "pth", "bin", "pkl", "pickle", "joblib", "npy", "npz", "ckpt", "msgpack", "dill"]
ENDINGS = {"generic_json": ["json"], "generic_yaml": ["yaml", "yml"], "generic_toml": ["toml"],
           "plain_text": ["md", "txt", "rst", "csv", "tsv"]}
TEMPLATE_ENDINGS = ["jinja", "j2", "prompt", "tmpl"]
HEAD_BYTES = 1024
GGUF_MAGIC, SQLITE_MAGIC, ZIP_MAGIC, PROTOBUF_FIRST_FIELD = b"GGUF", b"SQLite format 3\x00", b"PK\x03\x04", b"\x08"
MAX_HEADER = 64 * 1024 * 1024


def in_hex(magic: bytes) -> str:
    """How Spark's ``hex`` shows these bytes."""
    return magic.hex().upper()


def artifact_type(name: Column, head: Column) -> Column:
    """Type of a file from its name and first bytes: content before name, name before ending."""
    low, hexed = F.lower(name), F.hex(F.substring(head, 1, 16))
    ext = F.regexp_extract(low, r"[^.]\.([^.]*)$", 1)
    said = F.decode(F.substring(head, 1, HEAD_BYTES), "ISO-8859-1")
    said_low = F.lower(said)
    # little-endian length in the first eight bytes; only the low four can be non-zero
    length = F.conv(F.concat(*[F.substring(hexed, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    tensors = (F.substring(hexed, 9, 8) == "00000000") & length.between(2, MAX_HEADER) & (F.substring(hexed, 17, 2) == in_hex(b"{"))
    has = lambda t, *parts: F.greatest(*[F.contains(t, F.lit(p)) for p in parts]) if len(parts) > 1 else F.contains(t, F.lit(parts[0]))
    trace = has(said_low, '"query"', '"question"') & has(said_low, '"retrieved"', '"documents"', '"chunks"', '"contexts"')
    out = (F.when(hexed.startswith(in_hex(GGUF_MAGIC)), "gguf").when(tensors, "safetensors")
           .when(hexed.startswith(in_hex(SQLITE_MAGIC)), "vector_index")
           .when((ext == "onnx") & (hexed.startswith(in_hex(PROTOBUF_FIRST_FIELD)) | (F.coalesce(F.length(hexed), F.lit(0)) == 0)), "onnx"))
    for kind, names in EXACT_NAMES.items():
        out = out.when(low.isin(*names), kind)
    return (out.when(low.endswith(".index.json"), "shard_index")
            .when(low.startswith("docker-compose") & ext.isin("yml", "yaml"), "deployment_manifest")
            .when(low.startswith("ds_config") | low.startswith("deepspeed"), "deepspeed_config")
            .when(F.contains(low, F.lit("accelerate")) & ext.isin("yaml", "yml", "json"), "accelerate_config")
            .when((ext == "service") | low.startswith("k8s") | low.startswith("deployment."), "deployment_manifest")
            .when(ext.isin(*OPAQUE_ENDINGS), "opaque_serialization")
            .when(ext.isin("safetensors", "gguf"), "unrecognised").when(ext == "onnx", "onnx")
            .when(hexed.startswith(in_hex(ZIP_MAGIC)), "opaque_serialization")
            .when(ext.isin("jsonl", "ndjson"), F.when(trace, "retrieval_trace").otherwise("training_log"))
            .when(ext.isin(*TEMPLATE_ENDINGS) | has(said, "{context}", "{{context}}", "{question}"), "vector_index")
            .when((ext == "log") | (F.contains(low, F.lit("train")) & ext.isin("txt", "out", "err")), "training_log")
            .when(ext.isin(*ENDINGS["generic_json"]), "generic_json").when(ext.isin(*ENDINGS["generic_yaml"]), "generic_yaml")
            .when(ext.isin(*ENDINGS["generic_toml"]), "generic_toml").when(ext.isin(*ENDINGS["plain_text"]), "plain_text")
            .otherwise("unrecognised"))


def content_digest(files: DataFrame, budget: int | None = None) -> DataFrame:
    """``files``: content, whether it was opened, and size and time before and after.

    Over a budget, where one is given, the digest covers the head only; a file that moved is marked changed.
    """
    size = F.octet_length("content").cast("bigint")
    body = F.col("content").cast("binary")
    sha256 = F.sha2(body if budget is None else F.substring(body, 1, budget), 256)
    return digest_outcome(files, sha256, size, budget, size if budget is None else F.least(size, F.lit(budget))).drop("content")


def digest_outcome(files: DataFrame, sha256: Column, size: Column, budget: int | None, hashed: Column) -> DataFrame:
    """Add digest, scope, status and notes from ``opened`` and the sizes and times before and after."""
    head_only = F.lit(False) if budget is None else size > budget
    changed = ~(F.col("size_before").eqNullSafe(F.col("size_after")) & F.col("mtime_before").eqNullSafe(F.col("mtime_after")))
    opened = F.col("opened")
    return (files
            .withColumn("sha256", F.when(opened, sha256))
            .withColumn("hash_scope", F.when(~opened, "none").when(head_only, "head_only").otherwise("full"))
            .withColumn("bytes_hashed", F.when(opened, hashed))
            .withColumn("read_status", F.when(~opened, "not_hashed").when(changed, "changed").when(head_only, "too_large").otherwise("ok"))
            .withColumn("notes", F.concat_ws("|", F.when(opened & changed, "CL-INV-004"), F.when(opened & head_only, "CL-INV-005"))))


READABLE = ["ok", "too_large", "changed", "not_hashed"]


def coverage_status(cases: DataFrame, artifacts: DataFrame, notes: DataFrame) -> DataFrame:
    """Nothing readable: minimal; everything read and nothing noted: complete; else partial."""
    seen = artifacts.groupBy("case_id").agg(
        F.max(F.col("read_status").isin(*READABLE)).alias("any_readable"), F.min(F.col("read_status") == "ok").alias("all_ok"))
    noted = notes.groupBy("case_id").agg(F.count("*").alias("n_notes"))
    return (cases.select("case_id").join(seen, "case_id", "left").join(noted, "case_id", "left")
            .select("case_id", F.when(~F.coalesce("any_readable", F.lit(False)), "minimal")
                    .when(F.col("n_notes").isNull() & F.col("all_ok"), "complete").otherwise("partial").alias("coverage_status")))


def io_outcome(kind: Column) -> tuple[Column, Column]:
    """Read status and rule of an input failure."""
    denied = kind == "permission_denied"
    return F.when(denied, "access_denied").otherwise("io_error"), F.when(denied, "CL-INV-002").otherwise("CL-INV-006")


def coverage_ledger(notes: list[DataFrame]) -> DataFrame:
    """All notes of inventory and readers, counted per case and rule."""
    out = notes[0].select("case_id", "rule_id")
    for n in notes[1:]:
        out = out.unionByName(n.select("case_id", "rule_id"))
    return out.groupBy("case_id", "rule_id").agg(F.count("*").alias("notes"))
