"""Token-id files: blocks of ids stored as compressed bit or byte planes, with a chunk index.

The file format is a Parquet table with one row per chunk of a fixed number of
ids.  A chunk is transposed into planes (the lowest bytes or bits of all ids, then
the next, ...), each compressed with zstandard on its own; high planes of small
ids compress to almost nothing.  The narrow columns beside the payload are the
chunk index: shard, chunk, counts, and for each document that touches the chunk
its id, place and length.  Every chunk can be decoded alone, so a reader needs no
order of files, and a lost executor costs only its chunks.

Edge cases: a null or empty text is a document of the end id alone; a null
doc_id sorts first; repeated rows are documents of their own; columns besides
doc_id and text are ignored; an empty table gives an empty file.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlake.llm.common import arrow_batch, arrow_schema, shared_folder, ship_package
from provlake.llm.tokens import encoded_rows

CHUNK_SCHEMA = ("shard int, chunk long, n_ids int, mode string, planes array<binary>, doc_no array<long>, doc_id array<long>, "
                "doc_at array<int>, doc_len array<int>, doc_piece array<long>, doc_last array<boolean>")
PIECE_SCHEMA = "shard int, doc_no long, doc_id long, piece long, local_start long, n long, crc long, ids binary"


def to_planes(ids, mode: str, level: int = 3) -> list[bytes]:
    """Compressed planes of a block of unsigned 32-bit ids, lowest first; planes above the highest set bit are left out."""
    import numpy as np
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if mode == "byte":
        return [pack(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range((top + 7) // 8)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [pack(np.packbits(bits[:, k], bitorder="little").tobytes()) for k in range(top)]


def from_planes(planes: list[bytes], n: int, mode: str):
    """The ids of a block, as little-endian unsigned 32-bit integers."""
    import numpy as np
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    if mode == "byte":
        out = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(unpack(p), dtype=np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(unpack(p), dtype=np.uint8), count=n, bitorder="little")
        out = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, mode: str = "byte", chunk_ids: int = 65_536,
                 shards: int | None = None, cut: str = "spaced") -> None:
    """Encode every text and write the token file of ``docs(doc_id, text)`` to ``path`` in ascending doc_id order.

    Shards are ranges of doc_id, as many as the session has shuffle partitions unless given.  A shard is
    streamed: at most one chunk of ids and one group of texts are in memory.
    """
    ship_package(docs.sparkSession)
    arrow = arrow_schema(CHUNK_SCHEMA)

    def chunks(batches):
        import numpy as np
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        held, filled, segs, rows, number = [], 0, [], [], 0

        def close():
            nonlocal held, filled, segs, number
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            cols = list(zip(*segs, strict=True))
            rows.append((shard, number, len(ids), mode, to_planes(ids, mode), *map(list, cols)))
            held, filled, segs, number = [], 0, [], number + 1

        def out():
            done = arrow_batch(rows, arrow)
            rows.clear()
            return done

        for doc_no, (doc_id, ids) in enumerate(encoded_rows(batches, tokenizer, cut, end_id)):
            at, size, piece = 0, len(ids) // 4, 0
            while at < size:
                take = min(size - at, chunk_ids - filled)
                held.append(ids[4 * at:4 * (at + take)])
                segs.append((doc_no, doc_id, filled, take, piece, at + take == size))
                at, filled, piece = at + take, filled + take, piece + 1
                if filled == chunk_ids:
                    close()
                    if len(rows) == 16:
                        yield out()
        if filled:
            close()
        if rows:
            yield out()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = texts.repartitionByRange(shards, "doc_id") if shards else texts.repartitionByRange("doc_id")
    (ranged.sortWithinPartitions("doc_id", "text").mapInArrow(chunks, CHUNK_SCHEMA)
     .write.option("compression", "uncompressed").parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file, from its chunks: doc_id, start, n_tokens, ids_crc32.

    Documents inside one chunk are finished there; those cut by a chunk border are joined from their pieces.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    ship_package(spark)
    arrow = arrow_schema(PIECE_SCHEMA)

    def pieces(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = from_planes(r["planes"], r["n_ids"], r["mode"]).tobytes()
                base, out = r["chunk_start"], []
                for no, doc, at, n, piece, last in zip(r["doc_no"], r["doc_id"], r["doc_at"], r["doc_len"], r["doc_piece"],
                                                       r["doc_last"], strict=True):
                    raw = ids[4 * at:4 * (at + n)]
                    whole = piece == 0 and last
                    out.append((r["shard"], no, doc, piece, base + at, n, zlib.crc32(raw) if whole else None, None if whole else raw))
                yield arrow_batch(out, arrow)

    # all chunks of a shard but its last are full, so the index alone tells where each begins
    full = chunks.groupBy("shard").agg(F.max("n_ids").alias("full"), F.sum("n_ids").alias("ids"))
    # one row per shard, so no more rows than the file had write tasks
    bases = full.withColumn("base", F.coalesce(F.sum("ids").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "full", "base")
    decoded = chunks.join(F.broadcast(bases), "shard").withColumn("chunk_start", F.col("base") + F.col("chunk") * F.col("full")).drop("full", "base")
    joined = F.aggregate(F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("piece", "ids")))),
                         F.lit(b""), lambda a, e: F.concat(a, e["ids"]))
    return (decoded.mapInArrow(pieces, PIECE_SCHEMA).groupBy("shard", "doc_no")
            .agg(F.first("doc_id").alias("doc_id"), F.min("local_start").alias("start"), F.sum("n").alias("n_tokens"),
                 F.coalesce(F.max("crc"), F.crc32(joined)).alias("ids_crc32"))
            .select("doc_id", "start", "n_tokens", "ids_crc32"))


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token file of all documents, read back: one row per document."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
