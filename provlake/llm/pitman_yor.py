"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word of the training texts has a restaurant for the word that follows it (the end token stands before a text);
their parent is the root restaurant of words.  Its base is a spelling model of restaurants for
the last three, two, one and no bytes of a word, each sharing its parent with its siblings, over uniform bytes.  A
table of a restaurant is a customer of its parent, so a word sends its spelling down once per table of the root.
Seating is sampled by Gibbs sweeps: every restaurant's tables are drawn anew, given the others, by the
Chinese-restaurant process; predictive probabilities are averaged over the sweeps after burn-in.

What grows with the corpus (words, pairs, counts, tables) is held in tables and handled in tasks.  Pairs are counted in
each block, and go once to the cell of a grid, by a group of the first and one of the second word, so no frequent word meets
one task.  A pair seen once has one table whatever is drawn; only pairs seen twice or more are seated in sweeps, and
what they lack in tables against customers is told to their words.  The spelling
restaurants are hashed into fixed numbers of slots, so their cells are at most SLOTS * 256 however large the
corpus, and only these meet on the driver.  Texts are read once, into blocks of word numbers with a word list
each; counts and probabilities come to the word lists, and blocks are scored from them.  A block deals its word list over
parts by the words' hashes; what goes between blocks, parts and cells are columns of numbers in order, by planes of bytes.
A cell of the grid is told of the words it has in pairs seen twice or more only.

As in the base score, all words that training never saw are one outcome, the unknown word: its spelling probability
is what the known words leave.  So the probabilities of all outcomes sum to one.

Randomness is a function of word, sweep and step, so reruns and retries seat alike.

Edge cases: null and empty texts are the end token alone; a null doc_id counts as id "" for the fold; repeated rows count
and are scored each; other columns are ignored; an empty table gives no rows, and without training rows the
spelling model alone gives (uniform) probabilities.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm.common import arrow_batch, arrow_schema, saved, ship_package

END = b""  # the end token: no word is empty
BLOCK_TOKENS = 1_000_000
SLOTS = 256 * 32 * 4  # restaurants of the deepest spelling level: last byte, 5 bits of the one before, 2 of the one before that
PARENT_BITS = (2, 5, 8)  # slots of a level shifted by these are the slots of its parent
STOP = 0x20  # ends a spelling, and stands before its first byte: words hold no space
SPELL_DISCOUNT, SPELL_STRENGTH, WORD_STRENGTH, PAIR_STRENGTH = 0.5, 1.0, 1.0, 1.0
TABLES, KNOWN, GUESTS = -1, -2, -3  # beside the cells: tables of all words, spelling probability of all known words, customers of the root
CELL_TOKENS, LEAST_GROUPS = 1_300_000, 4  # tokens to a cell of the pair grid, on average; groups on a side, at least
PART_BYTES, LEAST_PARTS = 16_000_000, 8  # text to a part of the words, on average; parts, at least
ONCE, NEVER = -1, -2  # in place of a pair's number among those of its cell that training saw twice or more
EXACT = 16  # customers seated one by one; later ones in blocks over which rates change by at most a quarter

BLOCKS = "block long, part int, size int, doc_id array<long>, held array<boolean>, n array<int>, tokens binary, words binary, counts binary"
LISTS = "block long, part int, data binary, id long, word string, c long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def draws(keys, step: int):
    """Uniform numbers in (0, 1) that depend on key and step only."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = keys + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def poisson(mean, u, v):
    """Poisson numbers from uniform ones: by inversion for small means, by a rounded normal for others."""
    import numpy as np

    out = np.maximum(np.rint(mean + np.sqrt(mean) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)), 0)
    small = np.flatnonzero(mean < 30)
    m, left, k = mean[small], u[small].copy(), np.zeros(len(small))
    p = np.exp(-m)
    going = left > p
    for step in range(1, 120):
        if not going.any():
            break
        left = np.where(going, left - p, left)
        p = p * m / step
        k = np.where(going, step, k)
        going &= left > p
    out[small] = k
    return out


def seat(counts, mass, discount: float, keys, sweep: int):
    """Tables taken by ``counts`` customers of one dish each, if a new table has weight ``mass`` (Chinese-restaurant process)."""
    import numpy as np

    tables = (counts > 0).astype(float)
    base = sweep * 4096
    for i in range(1, EXACT):
        more = np.flatnonzero(counts > i)
        if not len(more):
            return tables
        tables[more] += draws(keys[more], base + i) < mass[more] / (mass[more] + i - discount * tables[more])
    at, step = float(EXACT), EXACT
    while len(more := np.flatnonzero(counts > at)):
        c, m, t = counts[more], mass[more], tables[more]
        upto = np.minimum(c, np.ceil(at * 1.25))
        mean = m * np.log((m + upto - discount * t) / (m + at - discount * t))
        new = poisson(mean, draws(keys[more], base + step), draws(keys[more], base + step + 1))
        tables[more] = t + np.minimum(new, upto - at)
        at, step = np.ceil(at * 1.25), step + 2
    return tables


def spelled(words: list[str]):
    """Per byte of all spellings: slot of the deepest restaurant, byte; and where each word begins."""
    import numpy as np

    raw = [w.encode("utf-8", "surrogatepass") + b" " for w in words]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in raw])[:-1])).astype(np.int64)
    before = [np.concatenate((np.full(k, STOP), data[:-k] if k < len(data) else data[:0]))[:len(data)] for k in (1, 2, 3)]
    one = before[0]
    two = np.where(one == STOP, STOP, before[1])
    three = np.where(two == STOP, STOP, before[2])
    return (one * 32 + two % 32) * 4 + three % 4, data, starts


class Spelling:
    """The sampled spelling restaurants, and the predictive table of the deepest ones."""

    def __init__(self):
        import numpy as np

        self.sweep = 0
        self.levels = [np.zeros((n, 256)) for n in (1, 256, 256 * 32, SLOTS)]  # predictive, from the root
        for p in self.levels:
            p += 1 / 256
        self.tables = [np.zeros((len(p), 1)) for p in self.levels]  # of each restaurant, in the last sweep

    def resample(self, cells: dict[int, int]) -> None:
        """Seat the customers of the deepest restaurants, ``{slot * 256 + byte: customers}``, down to the root."""
        import numpy as np

        self.sweep += 1
        guests = np.zeros((SLOTS, 256))
        if cells:
            guests.reshape(-1)[np.fromiter(cells.keys(), dtype=np.int64)] = np.fromiter(cells.values(), dtype=float)
        counts, seated = [None] * 4, [None] * 4
        for level in (3, 2, 1, 0):
            rows, dishes = np.nonzero(guests)
            c = guests[rows, dishes]
            up = rows >> PARENT_BITS[3 - level] if level else rows * 0
            base = self.levels[level - 1][up, dishes] if level else np.full(len(rows), 1 / 256)
            mass = (SPELL_STRENGTH + SPELL_DISCOUNT * self.tables[level][rows, 0]) * base
            keys = (rows * 256 + dishes + level * (1 << 40)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            t = np.zeros_like(guests)
            t[rows, dishes] = seat(c, mass, SPELL_DISCOUNT, keys, self.sweep)
            counts[level], seated[level] = guests, t
            self.tables[level] = t.sum(axis=1, keepdims=True)
            if level:
                guests = np.zeros((len(self.levels[level - 1]), 256))
                np.add.at(guests, (up, dishes), t[rows, dishes])
        below = np.full((1, 256), 1 / 256)
        for level in range(4):
            c, t = counts[level], seated[level]
            if level:
                below = self.levels[level - 1][np.arange(len(c)) >> PARENT_BITS[3 - level]]
            total, tables = c.sum(axis=1, keepdims=True), self.tables[level]
            self.levels[level] = ((np.maximum(c - SPELL_DISCOUNT * t, 0) + (SPELL_STRENGTH + SPELL_DISCOUNT * tables) * below)
                                  / (SPELL_STRENGTH + total))

    def table(self):
        """Natural logs of the predictive probabilities of the deepest restaurants, compressed: each executor holds a copy on disk."""
        import numpy as np
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(np.log(self.levels[3]).astype(np.float32).tobytes())


def opened(table: bytes):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(table), dtype=np.float32).reshape(SLOTS, 256)


def word_logs(words: list[str], table):
    import numpy as np

    slot, byte, starts = spelled(words)
    return np.add.reduceat(table[slot, byte].astype(float), starts) if len(starts) else np.zeros(0)


def word_tables(counts, spelling_logs, keys, state: dict):
    """Tables of each word in the root restaurant, in the sweep that ``state`` describes."""
    import numpy as np

    mass = (WORD_STRENGTH + state["discount"] * state["tables"]) * np.exp(spelling_logs)
    return seat(counts, np.maximum(mass, 1e-300), state["discount"], keys, state["sweep"])


def word_blocks(docs: DataFrame, parts: int, fold: int = 7, held: int = 2) -> DataFrame:
    """Blocks of word numbers, and for each part of the words (``part``, null for the block itself) the block's words in it, their
    numbers and counts in training texts; written once."""
    arrow = arrow_schema(BLOCKS)
    ship_package(docs.sparkSession)

    def blocks(batches):
        import numpy as np
        import zstandard
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId() << 32, 0
        pack = zstandard.ZstdCompressor(level=1).compress

        def close(index, ids, rows):
            flat, words = np.concatenate(ids), list(index)
            mask = np.repeat([not h for _, h, _ in rows], [n for *_, n in rows])
            trained = np.bincount(flat[mask], minlength=len(words))
            part = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % parts
            order = np.argsort(part, kind="stable")
            held_parts, starts = np.unique(part[order], return_index=True)
            out = [(task + number, None, len(words), *map(list, zip(*rows, strict=True)), squeeze(flat), None, None)]
            out += [(task + number, k, None, None, None, None, None, pack(b" ".join([words[i] for i in at.tolist()])), squeeze(steps(at), trained[at]))
                    for k, at in zip(held_parts.tolist(), np.split(order, starts[1:]), strict=True)]
            return arrow_batch(out, arrow)

        index, ids, rows, size = {END: 0}, [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                own = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
                ids += [own, np.zeros(1, dtype=np.int64)]
                rows.append((doc_id, zlib.crc32(str("" if doc_id is None else doc_id).encode()) % fold == held, len(words) + 1))
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield close(index, ids, rows)
                    index, ids, rows, size, number = {END: 0}, [], [], 0, number + 1
        if rows:
            yield close(index, ids, rows)

    return saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(blocks, BLOCKS), "blocks")


def word_lists(blocks: DataFrame, parts: int) -> DataFrame:
    """LISTS, written once: the words that training saw with their ids and counts (``block`` null), and for each block and part the
    block's numbers of such words with their ids."""
    schema = arrow_schema(LISTS)

    def number(sent):
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack, sent = zstandard.ZstdDecompressor().decompress, sent.sort_by("block")
        part = sent["part"][0].as_py()
        lists = [unsqueeze(d, 2) for d in sent["counts"].to_pylist()]
        every = pa.chunked_array([pa.array(unpack(w).split(b" "), type=pa.binary()) for w in sent["words"].to_pylist()]).combine_chunks().dictionary_encode()
        at = every.indices.to_numpy()
        count = np.bincount(at, weights=np.concatenate([n for _, n in lists]), minlength=len(every.dictionary)).astype(np.int64)
        known = count > 0
        rank = np.where(known, np.cumsum(known) - 1, -1)
        out = []
        for block, (pos, _), own in zip(sent["block"].to_pylist(), lists, np.split(rank[at], np.cumsum([len(n) for _, n in lists])[:-1]), strict=True):
            out.append((block, part, squeeze(steps(np.cumsum(pos)[own >= 0]), own[own >= 0]), None, None, None))
        told, n = arrow_batch(out, schema), int(known.sum())
        words = every.dictionary.filter(pa.array(known)).cast(pa.string())
        none = [pa.nulls(n, f.type) for f in list(schema)[:3]]
        leads = pa.RecordBatch.from_arrays([*none, pa.array(np.arange(n) * parts + part), words, pa.array(count[known])], schema=schema)
        return pa.Table.from_batches([told, leads])

    sent = blocks.where("part IS NOT NULL").select("block", "part", "words", "counts")
    return saved(sent.groupBy("part").applyInArrow(number, LISTS), "lists")


def squeeze(*columns) -> bytes:
    """Columns of 64-bit numbers of one length, by planes of bytes."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def unsqueeze(data: bytes, columns: int = 1):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.int64).reshape(-1) for p in planes]


def steps(numbers):
    """Ascending numbers as the steps between them, which take fewer bytes."""
    import numpy as np

    return np.diff(numbers, prepend=0)


def group_of(ids, groups: int):
    import numpy as np

    with np.errstate(over="ignore"):
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % groups


def block_pairs(r: dict):
    """Of a block's pairs (word before, word): the distinct ones in order, as two columns, and which one each token ends."""
    import numpy as np

    ids, size = unsqueeze(r["tokens"])[0], r["size"]
    before = np.concatenate((np.zeros(1, dtype=np.int64), ids[:-1]))  # texts end with word 0, the end token
    pairs, at = np.unique(before * size + ids, return_inverse=True)
    return pairs // size, pairs % size, at


def in_cells(ids, a, b, groups: int):
    """Which of a block's pairs have two words that training saw (others have no id but -1, and no count), by cell and there by the ids; and their cells."""
    import numpy as np

    use = np.flatnonzero((ids[a] >= 0) & (ids[b] >= 0))
    rank, g = np.empty(len(ids), dtype=np.int64), group_of(ids, groups)
    rank[np.argsort(ids)] = np.arange(len(ids))
    x, y = a[use], b[use]
    cell = g[x] * groups + g[y]
    order = np.argsort((cell * len(ids) + rank[x]) * len(ids) + rank[y])
    return use[order], cell[order]


def cell_pairs(blocks: DataFrame, lists: DataFrame, parts: int, groups: int) -> DataFrame:
    """``(cell, block, data, once, twice)``, written once: with block -1 the pairs of a cell that training saw twice or more, with
    their counts; with a block's number which of them the block's pairs in that cell are."""
    sent_schema, kept_schema = arrow_schema("cell int, block long, data binary"), arrow_schema("cell int, block long, data binary, once long, twice long")

    def send(block, listed):
        import numpy as np
        import pyarrow as pa

        out = []
        for r in block.to_pylist():
            ids = np.full(r["size"], -1, dtype=np.int64)
            for part, d in zip(listed["part"].to_pylist(), listed["data"].to_pylist(), strict=True):
                pos, rank = unsqueeze(d, 2)
                ids[np.cumsum(pos)] = rank * parts + part
            a, b, token = block_pairs(r)
            trained = np.bincount(token, weights=np.repeat(~np.array(r["held"]), r["n"]), minlength=len(a)).astype(np.int64)
            use, cell = in_cells(ids, a, b, groups)
            a, b, trained = ids[a[use]], ids[b[use]], trained[use]
            cells, starts = np.unique(cell, return_index=True)
            ends = np.append(starts[1:], len(cell))
            out += [(k, r["block"], squeeze(steps(a[i:j]), b[i:j], trained[i:j])) for k, i, j in zip(cells.tolist(), starts.tolist(), ends.tolist(), strict=True)]
        return pa.Table.from_batches([arrow_batch(out, sent_schema)])

    def merge(sent):
        import numpy as np
        import pyarrow as pa

        received = [unsqueeze(d, 3) for d in sent["data"].to_pylist()]
        a, b, n = (np.concatenate(c) for c in zip(*((np.cumsum(a), b, n) for a, b, n in received), strict=True))
        (first, i), (second, j) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        pairs, at = np.unique(i * len(second) + j, return_inverse=True)
        total = np.bincount(at, weights=n).astype(np.int64)
        often = total > 1
        number = np.where(often, np.cumsum(often) - 1, np.where(total == 1, ONCE, NEVER))[at]
        cell, pairs = sent["cell"][0].as_py(), pairs[often]
        ends = np.cumsum([len(p[0]) for p in received])[:-1]
        out = [(cell, -1, squeeze(first[pairs // len(second)], second[pairs % len(second)], total[often]), int((total == 1).sum()), int((total == 2).sum()))]
        out += [(cell, k, stepped(x), 0, 0) for k, x in zip(sent["block"].to_pylist(), np.split(number, ends), strict=True)]
        return pa.Table.from_batches([arrow_batch(out, kept_schema)])

    sized = blocks.where("part IS NULL").select("block", "size", "held", "n", "tokens")
    sent = (sized.groupBy("block").cogroup(lists.where("block IS NOT NULL").select("block", "part", "data").groupBy("block"))
            .applyInArrow(send, "cell int, block long, data binary"))
    return saved(sent.groupBy("cell").applyInArrow(merge, "cell int, block long, data binary, once long, twice long"), "cells")


def stepped(numbers) -> bytes:
    """Numbers that ascend but for ONCE and NEVER among them."""
    import numpy as np

    out = numbers - NEVER
    often = numbers >= 0
    out[often] = steps(numbers[often]) - NEVER
    return squeeze(out)


def unstepped(data: bytes):
    import numpy as np

    out = unsqueeze(data)[0] + NEVER
    often = out >= 0
    out[often] = np.cumsum(out[often])
    return out


SEATED = "cell int, tables binary, lacks array<struct<id:long,customers:long,tables:long>>"


def seat_pairs(cells: DataFrame, words: DataFrame | None, discount: float, sweep: int) -> DataFrame:
    """Tables of the pairs seen twice or more (one each without ``words``), and what their words lack for it; written once.

    ``words(cell, id, key, p, t)`` are the words of these pairs with their probability in the root and their restaurant's tables, once
    for each cell that has them.
    """
    schema = arrow_schema(SEATED)

    def seated(pairs, told=None):
        import numpy as np
        import pyarrow as pa

        out = []
        for r in pairs.to_pylist():
            a, b, n = unsqueeze(r["data"], 3)
            t = np.ones(len(n))
            if told is not None and len(n):
                ids = told["id"].to_numpy()
                o = np.argsort(ids)
                ids, key, p, tables = ids[o], told["key"].to_numpy()[o], told["p"].to_numpy()[o], told["t"].to_numpy()[o]
                x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
                with np.errstate(over="ignore"):
                    keys = key[x].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + key[y].view(np.uint64)
                mass = (PAIR_STRENGTH + discount * tables[x]) * p[y]
                t = seat(n.astype(float), np.maximum(mass, 1e-300), discount, keys, sweep)
            t = t.astype(np.int64)
            ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            lack, none = n - t, np.zeros(len(n), dtype=np.int64)
            customers = np.bincount(at, weights=np.concatenate((none, lack)), minlength=len(ids)).astype(np.int64)
            tables = np.bincount(at, weights=np.concatenate((lack, none)), minlength=len(ids)).astype(np.int64)
            lacks = [{"id": i, "customers": c, "tables": u} for i, c, u in zip(ids.tolist(), customers.tolist(), tables.tolist(), strict=True)]
            out.append((r["cell"], squeeze(t), lacks))
        return pa.Table.from_batches([arrow_batch(out, schema)])

    own = cells.where("block = -1").select("cell", "data").groupBy("cell")
    if words is None:
        def first(pairs):
            return seated(pairs)

        return saved(own.applyInArrow(first, SEATED), "seated", compression="zstd")

    def again(pairs, told):
        return seated(pairs, told)

    return saved(own.cogroup(words.groupBy("cell")).applyInArrow(again, SEATED), "seated", compression="zstd")


def score_documents(docs: DataFrame, fold: int = 7, held: int = 2, burn_in: int = 1, samples: int = 2) -> DataFrame:
    """Scores of all rows, learned from those outside the held fold: SCORES and ``train_tokens``."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("size")).first().size
    parts = max(LEAST_PARTS, size // PART_BYTES + 1)
    blocks = word_blocks(docs, parts, fold, held)
    lists = word_lists(blocks, parts)
    leads = lists.where("block IS NULL").select("id", "word", "c")
    first = leads.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    tokens, words = first.tokens, first.words
    groups = max(LEAST_GROUPS, int((tokens / CELL_TOKENS) ** 0.5) + 1)
    cells = cell_pairs(blocks, lists, parts, groups)
    sums = cells.agg(F.coalesce(F.sum("once"), F.lit(0)).alias("once"), F.coalesce(F.sum("twice"), F.lit(0)).alias("twice")).first()
    estimate = lambda s: min(max(s.once / max(s.once + 2 * s.twice, 1), 0.1), 0.95)
    pair_discount = estimate(sums)

    def lacking(seated):
        return saved(seated.select(F.inline("lacks")).groupBy("id").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")), "lacks", compression="zstd")

    seated = seat_pairs(cells, None, pair_discount, 0)
    lacks, wanted = lacking(seated), seated.select("cell", F.explode("lacks.id").alias("id"))
    flagged = saved(leads.join(lacks.select("id", F.lit(True).alias("often")), "id", "left"), "words", compression="zstd")
    key = F.xxhash64("word").alias("key")
    rare, often = flagged.where("often IS NULL"), flagged.where("often")  # often: in a pair seen twice or more

    def current(lacks):
        """Words with their customers in the root and the tables of their restaurant."""
        told = often.join(lacks, "id").select("id", "word", key, (F.col("c") - F.col("customers")).alias("n"), (F.col("c") - F.col("tables")).alias("t"))
        return rare.select("id", "word", key, F.col("c").alias("n"), F.col("c").alias("t")).unionByName(told), told

    discount = estimate(current(lacks)[0].agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first())
    spelling, state, states, seatings = Spelling(), {"discount": discount, "tables": float(words), "sweep": 0}, [], []
    cell_schema, root_schema = arrow_schema("cell long, n double"), arrow_schema("id long, key long, p double, t long")

    def in_root(logs, n, keys, state):
        """Probabilities of words in the root."""
        import numpy as np

        own = np.maximum(n - state["discount"] * word_tables(n, logs, keys, state), 0)
        return (own + (WORD_STRENGTH + state["discount"] * state["total"]) * np.exp(logs)) / (WORD_STRENGTH + state["guests"])

    for sweep in range(1, burn_in + samples + 1 if words else 1):
        state = state | {"sweep": sweep}
        shared = spark.sparkContext.broadcast(spelling.table())
        everyone, told = current(lacks)

        def spread(batches, state=state, shared=shared):
            import numpy as np
            import pyarrow as pa

            table = opened(shared.value)
            for b in batches:
                if not b.num_rows:
                    continue
                words, n = b.column(0).to_pylist(), b.column(1).to_numpy().astype(float)
                logs = word_logs(words, table)
                t = word_tables(n, logs, b.column(2).to_numpy().view(np.uint64), state)
                slot, byte, starts = spelled(words)
                cells, at = np.unique(slot * 256 + byte, return_inverse=True)
                sent = np.bincount(at, weights=np.repeat(t, np.diff(np.append(starts, len(byte)))))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, [TABLES, KNOWN, GUESTS])), pa.array(np.append(sent, [t.sum(), np.exp(logs).sum(), n.sum()]))], schema=cell_schema)

        got = dict(everyone.select("word", "n", "key").mapInArrow(spread, "cell long, n double").groupBy("cell").agg(F.sum("n")).collect())  # at most SLOTS * 256 cells
        total, known, guests = got.pop(TABLES, 0.0), got.pop(KNOWN, 0.0), got.pop(GUESTS, 0.0)
        spelling.resample(got)
        # a sample is the seating of words drawn in this sweep, over the spelling model it was drawn with, and the seating of pairs that it was drawn for
        drawn = state | {"total": total, "known": known, "guests": guests}
        states.append((drawn, shared))
        seatings.append((seated, lacks))
        state = state | {"tables": total}
        if sweep < burn_in + samples:

            def root(batches, drawn=drawn, shared=shared):
                import numpy as np
                import pyarrow as pa

                table = opened(shared.value)
                for b in batches:
                    if b.num_rows:
                        p = in_root(word_logs(b.column(1).to_pylist(), table), b.column(3).to_numpy().astype(float), b.column(2).to_numpy().view(np.uint64), drawn)
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), b.column(4)], schema=root_schema)

            rooted = told.select("id", "word", "key", "n", "t").mapInArrow(root, "id long, key long, p double, t long")
            seated = seat_pairs(cells, rooted.join(wanted, "id"), pair_discount, sweep)
            lacks = lacking(seated)
    states, seatings = states[burn_in:], seatings[burn_in:]
    if not states:
        states = [({"discount": discount, "tables": 0.0, "sweep": 0, "total": 0.0, "known": 0.0, "guests": 0.0}, spark.sparkContext.broadcast(spelling.table()))]
        seatings = [(seated, lacks)]
    taken = len(states)
    joined, c = often, F.col("c")
    for k, (_, lacks) in enumerate(seatings):
        joined = joined.join(lacks.toDF("id", f"n{k}", f"t{k}"), "id")
    rated_columns = lambda df, often: df.select(
        "id", "word", key, "c", *[(c - F.col(f"{x}{k}") if often else c).alias(f"{x}{k}") for x in "nt" for k in range(taken)])
    rated_schema = arrow_schema("id long, c long, data binary")

    def rate(batches):
        import numpy as np
        import pyarrow as pa

        tables = [opened(shared.value) for _, shared in states]
        for b in batches:
            if not b.num_rows:
                continue
            listed, keys = b.column(1).to_pylist(), b.column(2).to_numpy().view(np.uint64)
            out = np.zeros((b.num_rows, 2 * taken), dtype="<f4")
            for k, (state, _) in enumerate(states):
                out[:, k] = in_root(word_logs(listed, tables[k]), b.column(4 + k).to_numpy().astype(float), keys, state)
                out[:, taken + k] = b.column(4 + taken + k).to_numpy()
            raw, width = out.tobytes(), 8 * taken
            data = [raw[x:x + width] for x in range(0, len(raw), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(data, type=pa.binary())], schema=rated_schema)

    rated = rated_columns(rare, False).unionByName(rated_columns(joined, True)).mapInArrow(rate, "id long, c long, data binary")
    GIVEN = "block long, kind int, origin int, data binary"  # kind 0: of the words in a part, 1: of the pairs in a cell
    given_schema = arrow_schema(GIVEN)

    def answer(asked, rated):
        import numpy as np
        import pyarrow as pa

        rank, c = rated["id"].to_numpy() // parts, rated["c"].to_numpy()
        place = np.zeros(rank.max(initial=-1) + 1, dtype=np.int64)
        place[rank] = np.arange(len(rank))
        both = np.frombuffer(b"".join(rated["data"].to_pylist()), dtype="<f4").reshape(-1, 2 * taken)
        columns = [c, *both[:, :taken].copy().view("<i4").astype(np.int64).T, *both[:, taken:].astype(np.int64).T]
        out = []
        for block, part, d in zip(asked["block"].to_pylist(), asked["part"].to_pylist(), asked["data"].to_pylist(), strict=True):
            pos, own = unsqueeze(d, 2)
            at = place[own]
            out.append((block, 0, part, squeeze(pos, own, *[x[at] for x in columns])))
        return pa.Table.from_batches([arrow_batch(out, given_schema)])

    asked = lists.where("block IS NOT NULL").select("block", "part", "data")
    rated = rated.withColumn("part", F.pmod("id", F.lit(parts)).cast("int"))
    ratings = asked.groupBy("part").cogroup(rated.groupBy("part")).applyInArrow(answer, GIVEN)

    def give(rows):
        import numpy as np
        import pyarrow as pa

        n, t, out, asked = None, 0, [], []
        for block, d in zip(rows["block"].to_pylist(), rows["data"].to_pylist(), strict=True):
            if block == -1:
                n = unsqueeze(d, 3)[2]
            elif block < -1:
                t = t + unsqueeze(d)[0]
            else:
                asked.append((block, d))
        n, t = np.append(n, [0, 1]), np.append(t, [0, taken])  # NEVER and ONCE count from the end
        for block, d in asked:
            at = unstepped(d)
            out.append((block, 1, rows["cell"][0].as_py(), squeeze(n[at], t[at])))
        return pa.Table.from_batches([arrow_batch(out, given_schema)])

    seats = cells.select("cell", "block", "data")
    for k, (seated, _) in enumerate(seatings):
        seats = seats.unionByName(seated.select("cell", F.lit(-2 - k).cast("long").alias("block"), F.col("tables").alias("data")))
    given = seats.groupBy("cell").applyInArrow(give, GIVEN)
    score_schema = arrow_schema(SCORES)

    def score(block, told):
        import numpy as np
        import pyarrow as pa

        given = list(zip(told["kind"].to_pylist(), told["origin"].to_pylist(), told["data"].to_pylist(), strict=True))
        out = []
        for r in block.to_pylist():
            size = r["size"]
            c, ids = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
            root = np.tile(np.array([max(1 - s["known"], 1e-300) * (WORD_STRENGTH + s["discount"] * s["total"]) / (WORD_STRENGTH + s["guests"]) for s, _ in states]), (size, 1))
            tables = np.zeros((size, taken))
            for _, part, d in (x for x in given if x[0] == 0):
                pos, rank, own, *both = unsqueeze(d, 3 + 2 * taken)
                pos = np.cumsum(pos)
                ids[pos], c[pos] = rank * parts + part, own
                for k in range(taken):
                    root[pos, k], tables[pos, k] = both[k].astype("<i4").view("<f4"), both[taken + k]
            a, b, token = block_pairs(r)
            use, _ = in_cells(ids, a, b, groups)
            n, t = np.zeros(len(a)), np.zeros(len(a))
            if len(use):
                n[use], t[use] = (np.concatenate(x) for x in zip(*(unsqueeze(d, 2) for kind, _, d in sorted(given, key=lambda x: x[:2]) if kind == 1), strict=True))
            p = n - pair_discount * t / taken
            for k in range(taken):
                p += (PAIR_STRENGTH + pair_discount * tables[a, k]) * root[b, k] / taken
            log = np.log10(np.maximum(p / (PAIR_STRENGTH + c[a]), 1e-300))[token]
            word = b[token]
            n = np.array(r["n"], dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            base = np.log10((c + 1) / (tokens + words + 1))[word]
            per = [np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64)[word], base, log)]
            out += zip(r["doc_id"], r["held"], n.tolist(), *(x.tolist() for x in per), strict=True)
        return pa.Table.from_batches([arrow_batch(out, score_schema)])

    scored = (blocks.where("part IS NULL").select("block", "size", "doc_id", "held", "n", "tokens").groupBy("block")
              .cogroup(ratings.unionByName(given).groupBy("block")).applyInArrow(score, SCORES))
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document."""
    scored = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
