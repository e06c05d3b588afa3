"""Digests of real files: whole, within a budget, moved while read, and out of reach."""

import pathlib
import hashlib
import resource

from pyspark.sql import functions as F

from provlake.sources.files import file_digests, read_file
from provlake.sources.inventory import artifact_type

KEYS = "case_id bigint, artifact string, path string"


def test_files_are_digested_and_classified(spark, tmp_path):
    contents = {"a.bin": b"GGUF" + b"\x00" * 100, "empty.log": b"", "big.txt": bytes(range(256)) * 100_000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(1, n, str(tmp_path / n)) for n in [*contents, "gone.txt"]], KEYS)
    whole = {r.artifact: r for r in file_digests(files).withColumn("type", artifact_type(F.col("artifact"), F.col("head"))).collect()}
    for name, data in contents.items():
        r = whole[name]
        assert (r.sha256, r.bytes_hashed, r.hash_scope, r.read_status, r.notes) == (hashlib.sha256(data).hexdigest(), len(data), "full", "ok", "")
        assert bytes(r.head) == data[:1024]
    assert (whole["a.bin"].type, whole["empty.log"].type, whole["big.txt"].type) == ("gguf", "training_log", "plain_text")
    gone = whole["gone.txt"]
    assert (gone.sha256, gone.hash_scope, gone.read_status, gone.notes) == (None, "none", "io_error", "CL-INV-006")
    part = {r.artifact: r for r in file_digests(files, budget=1000).collect()}
    assert part["big.txt"].sha256 == hashlib.sha256(contents["big.txt"][:1000]).hexdigest()
    assert (part["big.txt"].hash_scope, part["big.txt"].read_status, part["big.txt"].notes, part["big.txt"].bytes_hashed) == ("head_only", "too_large", "CL-INV-005", 1000)
    assert part["a.bin"].hash_scope == "full"


def test_a_file_that_grows_while_it_is_read_is_seen(tmp_path, monkeypatch):
    path = tmp_path / "grows.log"
    path.write_bytes(b"x" * 100)
    real = hashlib.sha256

    class Growing:
        def __init__(self):
            self.inner = real()

        def update(self, part):
            self.inner.update(part)
            with path.open("ab") as f:
                f.write(b"y" * 10)

        def hexdigest(self):
            return self.inner.hexdigest()

    monkeypatch.setattr(hashlib, "sha256", Growing)
    opened, _, _, _, _, before, after, *_ = read_file(str(path), budget=100)
    assert opened and before == 100 and after > before


def test_a_large_file_needs_little_memory(tmp_path):
    path = tmp_path / "large.bin"
    with path.open("wb") as f:
        f.truncate(3 * 1024**3)  # a hole of 3 GB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert read_file(str(path))[4] == 3 * 1024**3
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 * 1024  # KB


def test_containers_are_written_by_many_tasks(spark, sf):
    """One task wrote a file for every supplier."""
    import __spark_entry__ as entry
    from provlake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    entry.queries()["tensor_header_ingest"](spark, sf)
    kept = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    newest = max(kept.glob("containers-*"), key=lambda p: p.stat().st_mtime)
    assert len({p.name.split("-")[1] for p in newest.glob("artifact=*/part-*")}) > 1
