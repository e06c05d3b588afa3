"""Fixed vocabulary of the evidence screen.

Everything here is small dimension data whose values are part of the result
contract (rule ids, claim names, weights, thresholds).  Operators turn these
lists into literal columns or broadcast tables; nothing here grows with data.
"""

from __future__ import annotations

RULESET_VERSION = 1

# --- fixed values: facets, in report order ---------------------------------
FACETS = ["weight_origin", "parameter_update", "training_stage", "inference_augmentation"]

# --- fixed values: claims and the facet each competes for -------------------
CLAIMS = [
    ("unmerged_lora", "parameter_update"),
    ("merged_adapter", "parameter_update"),
    ("dense_finetune", "parameter_update"),
    ("continued_pretraining", "training_stage"),
    ("distillation", "training_stage"),
    ("rag", "inference_augmentation"),
    ("external_api", "inference_augmentation"),
    ("scratch", "weight_origin"),
]
CLAIM_FACET = dict(CLAIMS)

# --- fixed values: rubric anchors and weights (each claim sums to 100) ------
RUBRIC = {
    "unmerged_lora": [
        ("structure", 30), ("base", 20), ("base_consistency", 20),
        ("load_or_remerge_record", 20), ("deployment_binding", 10),
    ],
    "merged_adapter": [
        ("exact_base", 15), ("delta_pattern", 25), ("pre_merge_adapter", 20),
        ("merge_reproduction", 30), ("binding", 10),
    ],
    "dense_finetune": [
        ("pre_post", 15), ("broad_deltas", 20), ("optimizer_trainability", 20),
        ("progression", 20), ("replay", 15), ("binding", 10),
    ],
    "continued_pretraining": [
        ("base", 10), ("trajectory", 15), ("objective_data_tokens", 25),
        ("optimizer", 20), ("replay", 20), ("binding", 10),
    ],
    "distillation": [
        ("teacher", 15), ("teacher_outputs", 25), ("objective", 20),
        ("trajectory", 15), ("replay", 15), ("binding", 10),
    ],
    "rag": [
        ("index", 20), ("retrieval_trace", 25), ("prompt_assembly", 25),
        ("replay", 15), ("binding", 15),
    ],
    "external_api": [
        ("binding", 20), ("config", 20), ("observed_egress", 35),
        ("upstream_correlation", 20), ("other", 5),
    ],
    "scratch": [
        ("identity", 5), ("step_zero", 20), ("trajectory", 20),
        ("optimizer_data_order", 15), ("data_tokenizer", 10), ("compute_jobs", 15),
        ("replay", 10), ("candidate_exclusion", 5),
    ],
}
RUBRIC_ROWS = [(c, a, w) for c, anchors in RUBRIC.items() for a, w in anchors]
DIVISOR = {c: sum(w for _, w in anchors) for c, anchors in RUBRIC.items()}

# --- fixed values: claims that exclude each other ---------------------------
EXCLUSIVE_GROUPS = [
    ("unmerged_lora", "merged_adapter", "dense_finetune"),
    ("continued_pretraining", "distillation"),
]
EXCLUSIVE_PAIRS = [(a, b) for g in EXCLUSIVE_GROUPS for a in g for b in g if a != b]
EXCLUSIVE_CLAIMS = sorted({a for a, _ in EXCLUSIVE_PAIRS})

# --- fixed values: rules that count as a method-specific anchor -------------
METHOD_ANCHORS = [
    ("unmerged_lora", "CL-LORA-002"), ("unmerged_lora", "CL-LORA-003"),
    ("unmerged_lora", "CL-LORA-004"), ("merged_adapter", "CL-MERGE-003"),
    ("dense_finetune", "CL-DENSE-001"), ("dense_finetune", "CL-DENSE-003"),
    ("dense_finetune", "CL-DENSE-004"), ("continued_pretraining", "CL-CPT-002"),
    ("continued_pretraining", "CL-CPT-004"), ("distillation", "CL-DIST-003"),
    ("distillation", "CL-DIST-004"), ("rag", "CL-RAG-001"),
    ("external_api", "CL-API-001"), ("external_api", "CL-API-003"),
    ("scratch", "CL-SCRATCH-001"), ("scratch", "CL-SCRATCH-002"),
]

# --- fixed values: caps, in enumeration order -------------------------------
CAPS = [
    ("CAP-QUESTIONNAIRE", 250), ("CAP-API-ONLY", 350), ("CAP-NO-BASE", 550),
    ("CAP-MERGE-UNREPRO", 600), ("CAP-CPT-NO-OBJ", 400),
    ("CAP-SCRATCH-NO-ZERO", 450), ("CAP-SINGLE-SOURCE", 849),
]
CAP_MAX = dict(CAPS)
SINGLE_SOURCE_CAP = "CAP-SINGLE-SOURCE"
SINGLE_SOURCE_RULE = "CL-XSOURCE-001"

# --- fixed values: abstentions ----------------------------------------------
ABSTENTIONS = [
    "ABS-BASE-UNKNOWN", "ABS-QUANTIZED-ONLY", "ABS-HASH-CONFLICT", "ABS-NO-BINDING",
    "ABS-CPT-FINAL-ONLY", "ABS-DISTILL-STYLE-ONLY", "ABS-SCRATCH-NOMATCH-ONLY",
    "ABS-HYBRID-TOO-CLOSE", "ABS-EVIDENCE-MUTABLE",
]

# --- fixed values: gate and band thresholds ---------------------------------
GATE_MIN_TENTHS = 800
GATE_MIN_SEPARATION = 150
GATE_MIN_TIER = "E2"
TIERS = ["E0", "E1", "E2", "E3", "E4"]

BAND_CORROBORATED = "corroborated_within_supplied_evidence"
BAND_STRONG = "strongly_consistent"
BAND_WEAK = "weakly_consistent"
BAND_PARTIAL = "partially_supported"
BAND_INSUFFICIENT = "insufficient_evidence_abstained"
BAND_CONTRADICTED = "contradicted_within_observed_scope"
BAND_NOT_SUPPLIED = "artifact_not_supplied_or_out_of_scope"
BAND_FLOORS = [(850, BAND_CORROBORATED), (700, BAND_STRONG), (500, BAND_WEAK)]
# weakest first
BAND_STRENGTH = [
    BAND_CONTRADICTED, BAND_NOT_SUPPLIED, BAND_INSUFFICIENT, BAND_PARTIAL,
    BAND_WEAK, BAND_STRONG, BAND_CORROBORATED,
]

# --- fixed values: outcome kinds --------------------------------------------
SUPPORT = "supporting_evidence"
MISSING = "missing_anchor"
CONTRADICTION = "contradiction"
AMBIGUITY = "ambiguity"
LIMITATION = "coverage_limitation"
REQUEST = "next_evidence_request"
OUTCOME_KINDS = [SUPPORT, MISSING, CONTRADICTION, AMBIGUITY, LIMITATION, REQUEST]
# entries of the emission stream that are not outcomes
CAP_REQUEST = "cap_request"
ABSTENTION_REQUEST = "abstention_request"
OUT_OF_SCOPE = "out_of_scope"

# --- fixed values: fact kinds -----------------------------------------------
FACT_KINDS = [
    "declared_claim", "declared_facet", "adapter_config", "adapter_tensor_set",
    "tensor_header", "model_config", "tokenizer_identity", "shard_index",
    "quantization_record", "merge_record", "checkpoint_step", "training_metric",
    "optimizer_record", "trainable_parameter_record", "training_objective",
    "dataset_manifest", "token_count_record", "seed_record", "teacher_reference",
    "teacher_output_cache", "provider_endpoint", "sdk_dependency",
    "outbound_request_trace", "retrieval_index", "embedding_model",
    "retrieval_trace", "prompt_template", "serving_config", "container_manifest",
    "artifact_reference", "compute_record", "hardware_record", "file_chronology",
    "opaque_artifact", "base_model_reference",
]

# --- fixed values: artifact types -------------------------------------------
ARTIFACT_TYPES = [
    "safetensors", "shard_index", "gguf", "onnx", "opaque_serialization",
    "transformers_config", "peft_adapter_config", "generation_config",
    "tokenizer_config", "trainer_state", "training_args", "accelerate_config",
    "deepspeed_config", "training_log", "dependency_lockfile",
    "deployment_manifest", "serving_config", "vector_index", "retrieval_trace",
    "dataset_manifest", "model_card", "generic_json", "generic_yaml",
    "generic_toml", "plain_text", "unrecognised",
]
WEIGHT_BEARING_TYPES = ["safetensors", "gguf", "onnx", "opaque_serialization", "shard_index"]
STRUCTURAL_TYPES = ["safetensors", "gguf", "onnx", "shard_index"]
LOCAL_WEIGHT_TYPES = ["safetensors", "gguf", "shard_index"]
TEXT_ONLY_TYPES = [
    "plain_text", "model_card", "generic_json", "generic_yaml", "generic_toml", "unrecognised",
]
CONTAINER_TYPES = ["safetensors", "gguf", "onnx", "shard_index"]
UNPARSED_TYPES = ["opaque_serialization", "unrecognised", "plain_text"]

# --- fixed values: declared facets that assert weight training ---------------
TRAINED_ORIGINS = ["random_initialization_claimed", "derivative_of_disclosed_base", "distilled_from_teacher"]
TRAINED_UPDATES = ["unmerged_peft_observed", "merged_adapter_consistent", "partial_or_dense_update"]

BASE_DEPENDENT = ["unmerged_lora", "merged_adapter", "dense_finetune", "continued_pretraining"]
WEIGHT_CLAIMS = BASE_DEPENDENT + ["distillation", "scratch"]
NO_BASE_CLAIMS = BASE_DEPENDENT + ["scratch"]
BINDABLE = [
    ("unmerged_lora", "deployment_binding"), ("merged_adapter", "binding"),
    ("dense_finetune", "binding"), ("continued_pretraining", "binding"),
    ("distillation", "binding"), ("rag", "binding"), ("external_api", "binding"),
]
COMPUTE_BAND_FACTOR = 30

# --- fixed values: the rule catalogue as id ranges per family ----------------
# family -> (highest number, numbers the catalogue lists but no rule emits)
CATALOGUE = [
    "CL-INV-001", "CL-INV-002", "CL-INV-003", "CL-INV-004", "CL-INV-005", "CL-INV-006", "CL-INV-007", "CL-INV-008",
    "CL-FMT-001", "CL-FMT-002", "CL-FMT-003", "CL-FMT-004", "CL-FMT-005", "CL-FMT-006", "CL-FMT-007", "CL-FMT-008",
    "CL-FMT-009", "CL-FMT-010", "CL-FMT-011",
    "CL-BASE-001", "CL-BASE-002", "CL-BASE-003", "CL-BASE-004", "CL-BASE-005", "CL-BASE-006", "CL-BASE-007",
    "CL-BASE-008", "CL-BASE-009",
    "CL-LORA-001", "CL-LORA-002", "CL-LORA-003", "CL-LORA-004", "CL-LORA-005", "CL-LORA-006", "CL-LORA-007",
    "CL-LORA-008", "CL-LORA-009", "CL-LORA-010", "CL-LORA-011", "CL-LORA-012", "CL-LORA-013", "CL-LORA-014",
    "CL-LORA-015", "CL-LORA-016",
    "CL-MERGE-001", "CL-MERGE-002", "CL-MERGE-003", "CL-MERGE-004", "CL-MERGE-005", "CL-MERGE-006", "CL-MERGE-007",
    "CL-DENSE-001", "CL-DENSE-002", "CL-DENSE-003", "CL-DENSE-004", "CL-DENSE-005", "CL-DENSE-006", "CL-DENSE-007",
    "CL-DENSE-008", "CL-DENSE-009",
    "CL-CPT-001", "CL-CPT-002", "CL-CPT-003", "CL-CPT-004", "CL-CPT-005", "CL-CPT-006", "CL-CPT-007",
    "CL-DIST-001", "CL-DIST-002", "CL-DIST-003", "CL-DIST-004", "CL-DIST-005", "CL-DIST-006", "CL-DIST-007",
    "CL-DIST-008",
    "CL-SCRATCH-001", "CL-SCRATCH-002", "CL-SCRATCH-003", "CL-SCRATCH-004", "CL-SCRATCH-005", "CL-SCRATCH-006",
    "CL-SCRATCH-007", "CL-SCRATCH-008", "CL-SCRATCH-009", "CL-SCRATCH-010", "CL-SCRATCH-011", "CL-SCRATCH-012",
    "CL-SCRATCH-013",
    "CL-RAG-001", "CL-RAG-002", "CL-RAG-003", "CL-RAG-004", "CL-RAG-005", "CL-RAG-006", "CL-RAG-007", "CL-RAG-008",
    "CL-API-001", "CL-API-002", "CL-API-003", "CL-API-004", "CL-API-005", "CL-API-006", "CL-API-007", "CL-API-008",
    "CL-API-009", "CL-API-010",
    "CL-COMPUTE-001", "CL-COMPUTE-002", "CL-COMPUTE-003", "CL-COMPUTE-004", "CL-COMPUTE-005",
    "CL-CHRONO-001", "CL-CHRONO-002", "CL-CHRONO-003", "CL-CHRONO-004", "CL-CHRONO-005",
    "CL-PARAM-001", "CL-PARAM-002", "CL-PARAM-003", "CL-PARAM-004",
    "CL-BIND-001", "CL-BIND-002", "CL-BIND-003", "CL-BIND-004", "CL-BIND-005",
    "CL-PRIV-001", "CL-PRIV-002", "CL-PRIV-003", "CL-PRIV-004", "CL-PRIV-005",
    "CL-XFACET-001", "CL-XFACET-002", "CL-XFACET-003", "CL-XFACET-004", "CL-XFACET-005",
]
NEVER_EMITTED = [
    "CL-INV-001",
    "CL-FMT-001", "CL-FMT-007", "CL-FMT-008", "CL-FMT-011",
    "CL-BASE-006", "CL-BASE-008",
    "CL-LORA-005",
    "CL-DIST-005",
    "CL-SCRATCH-006", "CL-SCRATCH-008",
    "CL-RAG-004", "CL-RAG-006",
    "CL-CHRONO-001", "CL-CHRONO-002",
    "CL-XFACET-005",
]

# --- fixed values: language guard -------------------------------------------
FORBIDDEN_WORDS = [
    "lied", "lying", "liar", "fraud", "fraudulent", "dishonest", "deceptive", "deceit",
    "faked", "scam", "certified", "certification", "guarantee", "guaranteed", "authentic",
    "accuse", "accuses", "accused", "accusing", "accusation", "accusations", "accusatory",
]
FORBIDDEN_PHRASES = ["proof that", "verified true", "lie detector", "99%", "100% accurate"]

# --- fixed values: credential token shapes: prefix, shortest tail, label -----
TOKEN_SHAPES = [
    ("AKIA", 16, "aws-access-key-id"), ("ASIA", 16, "aws-access-key-id"),
    ("sk-", 20, "api-key"), ("rk-", 20, "api-key"),
    ("github_pat_", 20, "github-token"), ("ghp_", 30, "github-token"),
    ("gho_", 30, "github-token"), ("ghs_", 30, "github-token"),
    ("ghu_", 30, "github-token"), ("ghr_", 30, "github-token"),
    ("hf_", 30, "hf-token"), ("AIza", 30, "google-api-key"),
    ("xoxb-", 10, "slack-token"), ("xoxp-", 10, "slack-token"),
    ("xoxa-", 10, "slack-token"), ("xapp-", 10, "slack-token"),
    ("glpat-", 15, "gitlab-token"), ("dckr_pat_", 15, "docker-token"),
    ("wandb_", 30, "wandb-key"),
]
UPPER_ONLY_TOKENS = ["AKIA", "ASIA"]

SENSITIVE_KEYS = [
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key",
    "secret_key", "private_key", "credential", "authorization", "auth_token", "session",
    "cookie", "bearer", "signature", "client_secret", "connection_string", "conn_str",
    "dsn", "sas_token", "account_key",
]
OUT_OF_SCOPE_PATH = "[OUT-OF-SCOPE-PATH]"
REDACTED_BY_KEY = "[REDACTED:by-key-name]"

# --- fixed values: limits ----------------------------------------------------
MAX_DEPTH = 64
MAX_FILES = 2_000_000
LOG_TAIL_BYTES = 4 * 1024 * 1024
LOG_MAX_LINE_BYTES = 64 * 1024
HASH_BUDGET_BYTES = 8 * 1024**3
HEADER_LIMIT_BYTES = 16 * 1024 * 1024
MAX_CHECKPOINTS = 64
MAX_TRACE_ENTRIES = 10_000
MAX_TRACE_FIELDS = 64
MAX_PACKAGES = 4096
MAX_LOG_HISTORY = 100_000

# --- fixed values: log keys ---------------------------------------------------
STEP_KEYS = ["step", "global_step", "iter", "iteration"]
LOSS_KEYS = ["loss", "train_loss", "training_loss"]
ENTRY_KEYS = STEP_KEYS + LOSS_KEYS + ["eval_loss", "learning_rate", "lr", "epoch", "grad_norm"]
TOKEN_KEYS = [
    "tokens", "total_tokens", "num_tokens", "train_tokens", "num_train_tokens",
    "token_count", "tokens_seen", "consumed_tokens",
]
RATE_MARKERS = ["per_sec", "per_second", "persec", "throughput", "speed", "_ps", "/s"]
GPU_COUNT_KEYS = ["n_gpu", "num_gpus", "gpu_count", "num_devices", "device_count", "nproc_per_node"]
DEVICE_KEYS = ["device", "device_name", "gpu_name", "accelerator"]
RUNTIME_KEYS = ["train_runtime", "runtime", "wall_clock", "wall_time", "elapsed", "elapsed_seconds"]
GPU_HOUR_KEYS = ["gpu_hours", "gpu_hrs", "accelerator_hours"]
FLOP_KEYS = ["total_flos", "total_flops", "flops"]
SEED_KEYS = ["seed", "random_seed"]
ACCELERATORS = [
    "a100", "h100", "h200", "b200", "gh200", "v100", "a10", "a10g", "l4", "l40", "l40s",
    "t4", "p100", "a6000", "rtx", "3090", "4090", "mi250", "mi300", "tpu", "gaudi", "trainium",
]
RUN_START_PHRASES = [
    "running training", "starting training", "start training", "training started",
    "begin training", "run started",
]
CHECKPOINT_VERBS = ["sav", "writ", "dump"]
# label suffix -> field
LABELS = [
    ("num examples", "num_examples"), ("num training examples", "num_examples"),
    ("num epochs", "num_epochs"), ("num train epochs", "num_epochs"),
    ("total optimization steps", "total_optimization_steps"),
    ("total optimisation steps", "total_optimization_steps"),
    ("trainable params", "trainable_params"),
    ("number of trainable parameters", "trainable_params"),
    ("all params", "total_params"), ("total params", "total_params"),
    ("num tokens", "tokens"), ("total tokens", "tokens"),
    ("world size", "world_size"), ("setting seed", "seed"), ("random seed", "seed"),
    ("train loss", "final_loss"), ("final loss", "final_loss"),
]

# --- fixed values: bytes per element of the known dtypes ------------------------
DTYPE_BYTES = [
    ("BOOL", 1), ("U8", 1), ("I8", 1), ("F8_E4M3", 1), ("F8_E5M2", 1),
    ("I16", 2), ("U16", 2), ("F16", 2), ("BF16", 2),
    ("I32", 4), ("U32", 4), ("F32", 4), ("I64", 8), ("U64", 8), ("F64", 8),
]
EIGHT_BIT_DTYPES = ["U8", "I8", "F8_E4M3", "F8_E5M2"]
QUANT_HINTS = ["quant", "gptq", "awq", "bitsandbytes", "nf4", "int4", "int8", "fp8"]
LORA_MARKERS = ["lora_embedding_A", "lora_embedding_B", "lora_A", "lora_B"]
# file type code -> storage name; the first two are full precision
GGUF_FILE_TYPES = [
    (0, "all F32"), (1, "mostly F16"), (2, "mostly Q4_0"), (3, "mostly Q4_1"),
    (4, "mostly Q4_1 with F16 embeddings"), (7, "mostly Q8_0"), (8, "mostly Q5_0"),
    (9, "mostly Q5_1"), (10, "mostly Q2_K"), (11, "mostly Q3_K_S"), (12, "mostly Q3_K_M"),
    (13, "mostly Q3_K_L"), (14, "mostly Q4_K_S"), (15, "mostly Q4_K_M"),
    (16, "mostly Q5_K_S"), (17, "mostly Q5_K_M"), (18, "mostly Q6_K"),
]
GGUF_FULL_PRECISION = [0, 1]

# --- fixed values: dependency categories by normalised package name -------------
PACKAGES = {
    "provider_sdk": [
        "openai", "anthropic", "cohere", "mistralai", "together", "replicate", "groq",
        "google-generativeai", "google-genai", "boto3", "botocore", "azure-ai-inference",
        "azure-identity", "litellm", "openrouter",
    ],
    "training": [
        "transformers", "peft", "trl", "accelerate", "deepspeed", "bitsandbytes", "torch",
        "datasets", "tokenizers", "unsloth", "axolotl", "torchtune",
    ],
    "serving": [
        "vllm", "text-generation-inference", "llama-cpp-python", "ollama", "sglang", "fastapi", "uvicorn",
    ],
    "rag": [
        "langchain", "langchain-community", "llama-index", "haystack-ai", "chromadb", "faiss-cpu",
        "faiss-gpu", "qdrant-client", "weaviate-client", "pinecone-client", "pgvector",
        "sentence-transformers", "rank-bm25",
    ],
}
PACKAGE_CATEGORY = [(p, c) for c, names in PACKAGES.items() for p in names]

# --- fixed values: retrieval evidence --------------------------------------------
STORE_MARKERS = [
    ("chroma.sqlite3", "chroma"), ("chroma-collections.parquet", "chroma"), ("index.faiss", "faiss"),
    ("index.pkl", "faiss"), ("docstore.json", "llama_index"), ("index_store.json", "llama_index"),
    ("meta.json", "qdrant"), ("collection.json", "qdrant"), ("_lance", "lancedb"),
]
PROMPT_MARKERS = ["{context}", "{{context}}", "{question}", "{{question}}", "{retrieved", "{documents}"]
PROMPT_PREVIEW = 400
QUERY_FIELDS = ["query", "question", "input", "prompt"]
CHUNK_FIELDS = ["retrieved", "documents", "chunks", "contexts", "source_nodes", "sources"]
SCORE_FIELDS = ["score", "similarity", "distance", "relevance_score"]

# --- fixed values: deployment evidence --------------------------------------------
PROVIDER_HOSTS = [
    ("api.openai.com", "openai"), ("api.anthropic.com", "anthropic"), ("api.cohere.ai", "cohere"),
    ("api.cohere.com", "cohere"), ("api.mistral.ai", "mistral"), ("api.together.xyz", "together"),
    ("api.groq.com", "groq"), ("api.replicate.com", "replicate"),
    ("generativelanguage.googleapis.com", "google"), ("openrouter.ai", "openrouter"),
    ("api.deepseek.com", "deepseek"), ("api.x.ai", "xai"), ("bedrock-runtime", "aws_bedrock"),
    ("openai.azure.com", "azure_openai"),
]
PRIVATE_HOSTS = ["localhost", "0.0.0.0", "host.docker.internal"]
PRIVATE_PREFIXES = ["127.", "192.168.", "10."]
CREDENTIAL_NAMES = ["KEY", "TOKEN", "SECRET", "PASSWORD", "PASSWD", "CREDENTIAL", "AUTH"]
ENGINES = [
    "vllm", "text-generation-launcher", "llama-server", "llama-cpp-server", "ollama", "sglang", "tgi", "mlc_llm",
]
