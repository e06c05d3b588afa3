"""Vector bin packing of token sequences.

Every sequence has three limits at once: tokens, segments and loss-bearing
tokens.  One sequence is open at a time; the dot-product heuristic picks, of the
pieces that fit, the one whose demand points most along the sequence's remaining
room (both as shares of the limits, weighted by the pool's mean demand).  Where
nothing fits whole, the best piece is cut to the room that is left, so sequences
close full.  A sequence closed by another limit, and the last of a task, is dealt
into sequences whose lengths are powers of two, which need no padding.

Each input partition packs its own rows with a pool of bounded size: nothing is
shuffled, and a rerun over the same files gives the same sequences.

Edge cases: a null or empty text is the end id alone; a null id stays null; repeated rows
are packed each on its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm.common import arrow_batch, arrow_schema, ship_package
from provlake.llm.tokens import encoded_rows

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
TASK_BITS = 38  # sequence_id holds the task above these bits


def powers_of_two(pieces: list[tuple], total: int):
    """Deal pieces (…, start, length) in order into runs whose lengths are the powers of two that make up ``total``."""
    pieces = list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        room, run = total & (1 << bit), []
        while room:
            key, start, n = pieces.pop()
            run.append((key, start, min(n, room)))
            if n > room:
                pieces.append((key, start + room, n - room))
            room -= min(n, room)
        if run:
            yield run


def pack_pool(take, limits: tuple[int, int, int]):
    """Yield sequences as lists of (key, start, length).

    ``take()`` returns new pieces (key, start, length, loss_flag) or None at the end; a piece with the loss
    flag bears loss on every token but the first of its document.
    """
    import numpy as np

    cap = np.array(limits, dtype=float)
    pool: list[tuple] = []
    demand = np.zeros((0, 3))

    def needs(items):
        return np.array([(n, 1, (n - (start == 0)) if loss else 0) for _, start, n, loss in items], dtype=float).reshape(-1, 3)

    open_, left, ended = [], list(limits), False
    while True:
        if not ended and len(pool) < 1024:
            if (new := take()) is None:
                ended = True
            else:
                pool += new
                demand = np.vstack([demand, needs(new)])
            continue
        if not pool:
            break
        room = np.array(left, dtype=float)
        share = demand / cap
        score = share @ (share.mean(axis=0) * room / cap)
        fits = (demand <= room).all(axis=1)
        i = int(np.argmax(np.where(fits, score, -1.0))) if fits.any() else int(np.argmax(score))
        key, start, n, loss = pool[i]
        room_for = min(n, left[0], left[2] + (start == 0) if loss else n)
        pool[i], demand[i] = pool[-1], demand[-1]
        pool.pop()
        demand = demand[:-1]
        if room_for < n:
            rest = (key, start + room_for, n - room_for, loss)
            pool.append(rest)
            demand = np.vstack([demand, needs([rest])])
        if room_for:
            open_.append((key, start, room_for))
            left = [left[0] - room_for, left[1] - 1, left[2] - (room_for - (start == 0) if loss else 0)]
        if not left[0]:
            yield open_
            open_, left = [], list(limits)
        elif not left[1] or not left[2] or not room_for:
            yield from powers_of_two(open_, sum(n for *_, n in open_))
            open_, left = [], list(limits)
    if open_:
        yield from powers_of_two(open_, sum(n for *_, n in open_))


def pack(rows: DataFrame, tokenizer: str, end_id: int, max_tokens: int = 4096, max_segments: int = 256, max_loss_tokens: int | None = None,
         id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, cut: str = "words") -> DataFrame:
    """Pieces of all rows in sequences, with their ids (little-endian unsigned 32-bit).

    ``loss_col`` names a boolean column (an answer turn, say); without it all tokens bear loss, but for the
    first of a text, which nothing predicts.  ``max_loss_tokens`` defaults to ``max_tokens``.
    """
    limits = (max_tokens, max_segments, max_loss_tokens or max_tokens)
    ship_package(rows.sparkSession)
    arrow = arrow_schema(PIECES)

    def packed(batches):
        from pyspark import TaskContext

        base, texts, flags = TaskContext.get().partitionId() << TASK_BITS, {}, []

        def rows_in():
            for batch in batches:
                flags.extend(batch.column(2).to_pylist())
                yield batch

        source = enumerate(encoded_rows(rows_in(), tokenizer, cut, end_id))

        def take():
            new = []
            for no, (doc_id, ids) in source:
                if no == 0 or no % 4096 == 0:
                    del flags[:no - seen[0]]
                    seen[0] = no
                loss = bool(flags[no - seen[0]])
                texts[no] = [doc_id, ids, len(ids) // 4]
                new += [(no, at, min(max_tokens, len(ids) // 4 - at), loss) for at in range(0, len(ids) // 4, max_tokens)]
                if len(new) >= 1024:
                    break
            return new or None

        seen, out, size = [0], [], 0

        for number, run in enumerate(pack_pool(take, limits)):
            at = 0
            for no, start, n in run:
                doc = texts[no]
                out.append((doc[0], start, n, len(doc[1]) // 4, base + number, at, doc[1][4 * start:4 * (start + n)]))
                at += n
                doc[2] -= n
                if not doc[2]:
                    del texts[no]
            size += at
            if size > 1 << 20:
                yield arrow_batch(out, arrow)
                out, size = [], 0
        if out:
            yield arrow_batch(out, arrow)

    loss = F.coalesce(F.col(loss_col).cast("boolean"), F.lit(False)) if loss_col else F.lit(True)
    return rows.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), loss).toDF("k", "t", "l").mapInArrow(packed, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens: one row per piece."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
