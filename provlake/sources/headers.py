"""Header-only reading of tensor containers.

Only the eight length bytes and the header itself are read, never the tensors;
Spark decides which task opens which file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

HEADER_SCHEMA = "case_id bigint, artifact string, path string, header_json string, header_bytes bigint, file_size bigint, note string"


def read_header(stream, size: int, limit: int | None = None) -> tuple[str | None, int | None, str | None]:
    """(header text, header length, note) of an open file."""
    start = stream.read(8)
    if len(start) < 8:
        return None, None, "file is shorter than the length prefix"
    n = min(int.from_bytes(start, "little"), 2**63 - 1)
    if limit is not None and n > limit:
        return None, n, "declared header exceeds the header limit"
    if 8 + n > size:
        return None, n, "declared header reaches past the end of the file"
    try:
        return stream.read(n).decode("utf-8"), n, None
    except UnicodeDecodeError:
        return None, n, "header is not UTF-8"


def tensor_header_ingest(files: DataFrame, limit: int | None = None) -> DataFrame:
    """``files``: (case_id, artifact, path) -> header text, its length, file size, note."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for case_id, artifact, path in zip(batch["case_id"], batch["artifact"], batch["path"]):
                header, n, note, size = None, None, None, None
                try:
                    system, where = fs.FileSystem.from_uri(path)
                    size = system.get_file_info(where).size
                    with system.open_input_file(where) as stream:
                        header, n, note = read_header(stream, size or 0, limit)
                except (OSError, ValueError) as e:  # an unreadable file is noted, never fatal
                    note = f"not read: {type(e).__name__}"
                out = pd.DataFrame([(case_id, artifact, path, header, n, size, note)],
                                   columns=["case_id", "artifact", "path", "header_json", "header_bytes", "file_size", "note"])
                yield out.astype({"header_bytes": "Int64", "file_size": "Int64"})  # one header in memory at a time

    return files.select("case_id", "artifact", "path").mapInPandas(read, HEADER_SCHEMA)
