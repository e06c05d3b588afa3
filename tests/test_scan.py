"""The scan over one case with a file of every kind: each reader's facts, a note for each file without one, and no secret in any field."""

import json

import pytest
from pyspark.sql import functions as F

from provlake.plans import scan as S

FILES = {  # file name -> (type, table, content)
    "train.log": ("training_log", "lines", "step=1 loss=2.5 note=mail a@bc.de\nstep=2 loss=1.5"),
    "requirements-gpu.txt": ("dependency_lockfile", "lines", "torch==2.1\nopenai>=1.0  # sdk"),
    "package.json": ("dependency_lockfile", "bodies", json.dumps({"name": "x", "dependencies": {"openai": "^4.0"}, "devDependencies": {"left_pad": "1"}})),
    "Cargo.lock": ("dependency_lockfile", "lines", '[[package]]\nname = "serde"\nversion = "1.0.1"\ndependencies = [\n "a",\n]\n\n[[package]]\nname = "rand"\n[metadata]\nname = "no"'),
    "pyproject.toml": ("dependency_lockfile", "lines", '[project]\nname = "p"\ndependencies = [\n  "peft>=0.5,<1",\n  "trl[extra]==0.7",\n]\nversion = "3"\n[tool.poetry.dependencies]\n'
                       'python = "^3.10"\nvllm = {version = "0.4", extras = ["x"]}\n[tool.other]\na = "b"'),
    "environment.yml": ("dependency_lockfile", None, "name: x"),
    "Dockerfile": ("deployment_manifest", "lines", 'FROM reg/img:1@sha256:abc AS b\nENV API_KEY=sk-' + "a1" * 12 + '\nENV BASE_URL https://u:p@api.openai.com/v1?k=1\n'
                   'ENV MODE=fast\nCMD ["vllm", "serve", "/m/x", \\\n  "--port", "8000"]'),
    "docker-compose.yml": ("deployment_manifest", "lines", "services:\n  a:\n    image: img:2\n    command:\n      - vllm\n      - serve\n      - /m/y\n    environment:\n      - TOKEN=abc\n"
                           "      - A=1\n    ports:\n      - 80:80\n  b:\n    image: \"c@sha256:def\"\n    entrypoint: ollama run q\n    env:\n      - name: B\n        value: two\n"
                           "    base_url: http://localhost:8/x\n"),
    ".env": ("serving_config", "lines", "export URL=http://10.0.0.1/a\nPASSWORD=hunter2"),
    "x.service": ("deployment_manifest", None, "ExecStart=vllm"),
    "README.md": ("model_card", "lines", "---\nlicense: mit\nbase_model:\n  - org/a\n  - org/b@0123456\ntags: [x]\n---\nbase_model: no"),
    "one.md": ("model_card", "lines", "base_model: no front matter"),
    "model.index.json": ("shard_index", "bodies", json.dumps({"weight_map": {"a": "s1", "b": "s1", "c": "s2"}})),
    "index.faiss": ("vector_index", None, ""),
    "modules.json": ("vector_index", "bodies", json.dumps({"chunk_size": 512, "embed_model": "e"})),
    "rag.jinja": ("vector_index", "bodies", "use {context} and mail a@bc.de"),
    "config.json": ("transformers_config", "bodies", json.dumps({"model_type": "llama", "quantization_config": {"quant_method": "gptq"}})),
    "any.json": ("generic_json", "bodies", "{broken"),
    "m.safetensors": ("safetensors", "headers", json.dumps({"l.q.lora_A.weight": {"dtype": "F32", "shape": [8, 2], "data_offsets": [0, 64]},
                                                             "l.q.lora_B.weight": {"dtype": "F32", "shape": [2, 8], "data_offsets": [64, 128]}})),
    "cut.safetensors": ("safetensors", "headers", None),
    "m.gguf": ("gguf", "pairs", [("general.architecture", None, "llama"), ("llama.context_length", 4096, None), ("general.file_type", 2, None)]),
    "w.pt": ("opaque_serialization", None, ""),
    "gone.log": ("training_log", None, ""),
}


@pytest.fixture(scope="module")
def result(spark):
    names = list(FILES)
    arts = spark.createDataFrame([(1, i, f"A{i}", FILES[n][0], f"ROOT1/d/{n}") for i, n in enumerate(names)],
                                 "case_id bigint, artifact_seq int, artifact_id string, artifact_type string, path_alias string")
    rows = {t: [] for t in ("lines", "bodies", "headers", "pairs")}
    for i, n in enumerate(names):
        _, table, content = FILES[n]
        if table == "lines":
            rows[table] += [(1, f"A{i}", k, line) for k, line in enumerate(content.split("\n"))]
        elif table == "bodies":
            rows[table].append((1, f"A{i}", content))
        elif table == "headers":
            size = len(content) if content else None
            rows[table].append((1, f"A{i}", content, size, size + 8 + 128 if size else 3, None if content else "file is shorter than the length prefix"))
        elif table == "pairs":
            rows[table] += [(1, f"A{i}", *c) for c in content]
    frame = lambda t, s: spark.createDataFrame(rows[t], s)
    found = S.scan(arts, frame("lines", "case_id bigint, artifact_id string, line_no bigint, line string"), frame("bodies", "case_id bigint, artifact_id string, body string"),
                   frame("headers", S.HEADER_ROWS), frame("pairs", S.PAIR_ROWS))

    def plain(v):
        return next((x for x in (v["i"], v["num"], v["s"], v["b"], v["l"]) if x is not None), None)

    facts = {}
    for r in found.facts.orderBy("fact_seq").collect():
        facts.setdefault(names[int(r.artifact_id[1:])], []).append((r.kind, {k: plain(v) for k, v in r.fields.items()}))
    notes = sorted((r.path_alias.split("/")[-1], r.rule_id) for r in found.notes.collect())
    return facts, notes


def kinds(result, name, kind):
    return [f for k, f in result[0].get(name, []) if k == kind]


def test_packages(result):
    got = lambda name: sorted((f["name"], f.get("version"), f["ecosystem"], f["category"]) for f in kinds(result, name, "sdk_dependency"))
    assert [(n, v, e) for n, v, e, _ in got("requirements-gpu.txt")] == [("openai", "1.0", "python"), ("torch", "2.1", "python")]
    assert [(n, v, e) for n, v, e, _ in got("package.json")] == [("left-pad", "1", "npm"), ("openai", "^4.0", "npm")]
    assert dict((n, c) for n, _, _, c in got("package.json"))["openai"] == "provider_sdk"
    assert [(n, v, e) for n, v, e, _ in got("Cargo.lock")] == [("rand", None, "cargo"), ("serde", "1.0.1", "cargo")]
    assert [(n, v) for n, v, _, _ in got("pyproject.toml")] == [("peft", "0.5"), ("python", "^3.10"), ("trl", "[extra]==0.7"), ("vllm", "0.4")]


def test_deployment(result):
    assert kinds(result, "Dockerfile", "container_manifest") == [{"image": "reg/img:1@sha256:abc", "image_digest": "abc"}]
    serving = kinds(result, "Dockerfile", "serving_config")
    assert {"engine": "vllm", "model_path": "/m/x", "port": 8000, "enable_lora": False} in serving
    secret = next(f for f in serving if f.get("env_var_set") == "API_KEY")
    assert secret["value_withheld"] is True and "value" not in secret
    assert {"env_var_set": "MODE", "value_withheld": False, "value": "fast"} in serving
    assert kinds(result, "Dockerfile", "artifact_reference")[0]["in_scope"] is False
    end = kinds(result, "Dockerfile", "provider_endpoint")
    assert [(f["host"], f["endpoint_url"]) for f in end] == [("api.openai.com", "https://api.openai.com/v1")]
    assert [(f["image"], f.get("image_digest")) for f in kinds(result, "docker-compose.yml", "container_manifest")] == [("img:2", None), ("c@sha256:def", "def")]
    served = kinds(result, "docker-compose.yml", "serving_config")
    assert sorted((f["engine"], f.get("model_path")) for f in served if "engine" in f) == [("ollama", "q"), ("vllm", "/m/y")]
    assert sorted((f["env_var_set"], f.get("value")) for f in served if "env_var_set" in f) == [("A", "1"), ("B", "two"), ("TOKEN", None)]
    assert [f["is_loopback_or_private"] for f in kinds(result, "docker-compose.yml", "provider_endpoint")] == [True]
    assert [f["is_loopback_or_private"] for f in kinds(result, ".env", "provider_endpoint")] == [True]


def test_models(result):
    assert sorted((f["base_ref"], f["revision_pinned"]) for f in kinds(result, "README.md", "base_model_reference")) == [("org/a", False), ("org/b@0123456", True)]
    assert not kinds(result, "one.md", "base_model_reference")
    assert kinds(result, "model.index.json", "shard_index") == [{"shard_file_count": 2, "tensor_count": 3}]
    header = kinds(result, "m.safetensors", "tensor_header")[0]
    assert (header["tensor_count"], header["parameters"], header["dtypes"]) == (2, 32, ["F32"])
    assert kinds(result, "m.safetensors", "adapter_tensor_set")[0]["lora_pair_count"] == 1
    assert kinds(result, "m.gguf", "model_config")[0] == {"architecture": "llama", "context_length": 4096}
    assert kinds(result, "m.gguf", "quantization_record") and kinds(result, "config.json", "quantization_record")[0]["quant_method"] == "gptq"
    assert kinds(result, "index.faiss", "retrieval_index")[0]["store"] == "faiss"
    assert kinds(result, "modules.json", "retrieval_index")[0]["chunk_size"] == 512
    assert kinds(result, "rag.jinja", "prompt_template")[0]["preview"] == "use {context} and mail [REDACTED:email]"


def test_every_unread_file_leaves_a_note(result):
    assert result[1] == sorted([("any.json", "CL-FMT-010"), ("cut.safetensors", "CL-FMT-002"), ("environment.yml", "CL-FMT-002"), ("x.service", "CL-FMT-002"),
                                ("w.pt", "CL-FMT-002"), ("gone.log", "CL-INV-002")])


def test_no_secret_is_in_any_field(result):
    said = json.dumps(result[0])
    for secret in ("sk-" + "a1" * 12, "hunter2", "a@bc.de", "u:p@", "abc\", \"TOKEN"):
        assert secret not in said


def test_readers_run_once_for_the_numbering(spark, monkeypatch):
    """The found facts are saved before they are numbered, which reads them three times."""
    rows = lambda data, ddl: spark.createDataFrame(data, ddl)
    files = rows([(1, 1, "a", "training_log", "ROOT1/a.log")], "case_id long, artifact_seq long, artifact_id string, artifact_type string, path_alias string")
    lines = rows([(1, "a", 1, "step=1 loss=2.5 seed=7"), (1, "a", 2, "step=2 loss=1.5")], "case_id long, artifact_id string, line_no long, line string")
    numbered, union = [], S.configs.facts_union
    monkeypatch.setattr(S.configs, "facts_union", lambda parts: numbered.extend(parts) or union(parts))
    facts = S.scan(files, lines, rows([], "case_id long, artifact_id string, body string")).facts
    assert {"training_metric", "seed_record"} <= {r.kind for r in facts.collect()}
    assert all("/scan-facts-" in f for part in numbered for f in part.inputFiles()) and numbered[0].inputFiles()
