"""Digests and first bytes of real files.

A task streams its files in chunks: one chunk and a running SHA-256 are in memory, whatever the size of a file.  Size and
time are taken before and after, so a file that moved meanwhile is seen.  A digest is sequential, so one file is one
task's work; files are dealt to tasks by their paths.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.sources.inventory import HEAD_BYTES, digest_outcome, io_outcome

CHUNK_BYTES = 8 * 1024 * 1024
SCHEMA = ("case_id bigint, artifact string, path string, opened boolean, io_kind string, head binary, digest string, bytes_hashed bigint, "
          "size_before bigint, size_after bigint, mtime_before timestamp, mtime_after timestamp")


def read_file(path: str, budget: int | None = None, head_bytes: int = HEAD_BYTES, chunk_bytes: int = CHUNK_BYTES) -> tuple:
    """The columns of ``SCHEMA`` from ``opened`` on; a file that cannot be read has only the kind of its failure."""
    from pyarrow import fs

    try:
        system, where = fs.FileSystem.from_uri(path)
        before = system.get_file_info(where)
        head, digest, done = b"", hashlib.sha256(), 0
        with system.open_input_stream(where) as stream:
            while (left := chunk_bytes if budget is None else min(chunk_bytes, budget - done)) > 0 and (part := stream.read(left)):
                if len(head) < head_bytes:
                    head += part[:head_bytes - len(head)]
                digest.update(part)
                done += len(part)
        after = system.get_file_info(where)
    except PermissionError:
        return (False, "permission_denied", *[None] * 7)
    except (OSError, ValueError) as e:
        return (False, "not_found" if isinstance(e, FileNotFoundError) else "io_error", *[None] * 7)
    return True, None, head, digest.hexdigest(), done, before.size, after.size, before.mtime, after.mtime


def file_digests(files: DataFrame, budget: int | None = None) -> DataFrame:
    """``files``: (case_id, artifact, path) -> digest, first bytes, scope and status of every file, as ``content_digest`` gives them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (*key, *read_file(key[2], budget))
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    rows = files.select("case_id", "artifact", "path").repartition("path").mapInArrow(read, SCHEMA)
    status, rule = io_outcome(F.col("io_kind"))
    size = F.greatest("size_before", "size_after")
    out = digest_outcome(rows, F.col("digest"), size, budget, F.col("bytes_hashed")).drop("digest")
    failed = F.col("io_kind").isNotNull()
    return (out.withColumn("read_status", F.when(failed, status).otherwise(F.col("read_status")))
            .withColumn("notes", F.when(failed, rule).otherwise(F.col("notes"))))
