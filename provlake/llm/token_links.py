"""Aligning two tokenizers over the same bytes by lockstep merging.

A byte-level vocabulary (A) and a piece vocabulary (B) cut the same bytes differently.  Texts are encoded in blocks.  One
NumPy state vector holds a pointer into A and one into B for every lane; a step emits the link under all pointers, notes a
cut where both tokens end together, and advances whichever token ends first (both at a cut).  Finished lanes are taken out
of the vector.  A lane is a document, or a run of ``LANE`` A tokens of a long one: its B pointer begins at the token over
its first byte and a link belongs to the lane of its A token, so lanes need nothing from each other and a document of any
length takes no more steps than a short one.

Corpus-wide counts come from blocks, not from documents: a block is one row that lists each id pair once, with the number
of its documents that link it, and each document's pairs as numbers into that list.  Pairs are counted over blocks, and
the counts go back to each block once.  No pair can hold more rows of that join than there are blocks, and every block
brings very many pairs, so there is no hot key.

Edge cases: null and empty texts, and texts whose pieces do not give back their bytes, have no tokens (zeros and an empty
digest); strings of special tokens are ordinary text; a null doc_id stays null; repeated rows are documents of their own
and count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlake.llm.common import arrow_batch, arrow_schema, documents, saved, ship_package
from provlake.llm.tokens import BYTE_LETTERS, PieceEncoder

LANE = 256  # A tokens that one lane walks at most
BLOCK_TOKENS = 500_000  # A and B tokens after which a block is closed (a longer document is a block of its own)
KEPT_PIECES = 300_000  # pieces that one worker keeps of each vocabulary
ID_BITS = 20  # bits of an id in a pair: pair = a * 2**20 + b

ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, cut_a array<int>, cut_b array<int>"
BLOCK = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
         "pair_end array<long>, pair_no binary, pair_n binary, pairs array<long>, pair_docs array<int>")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

_vocabularies: dict[tuple[str, str], tuple] = {}


class LiteralEncoder(PieceEncoder):
    """The byte-level vocabulary (A) with the strings of special tokens as ordinary text."""

    def __init__(self, path: str):
        super().__init__(path, "spaced")
        self.tok.encode_special_tokens, self.added = True, []
        letters = {c: b for b, c in BYTE_LETTERS.items()} | {chr(b): b for b in range(256) if b not in BYTE_LETTERS}
        self.token_bytes = [b""] * self.tok.get_vocab_size(with_added_tokens=True)
        special = self.tok.get_added_tokens_decoder()
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.token_bytes[i] = token.encode() if i in special else bytes(letters[c] for c in token)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > KEPT_PIECES:
            self.cache.clear()
        return super().encode(texts)


class SentenceEncoder:
    """The piece vocabulary (B).  None of its pieces has a space behind another character, so texts are cut before each
    space that follows a character, and every unit is encoded once; a vocabulary with other pieces encodes whole texts."""

    CUT = re.compile(r"(?<! )(?= )")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_unit = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.model.piece_to_id("▁")
        self.cache: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(ids, dtype="<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def units(self, text: str) -> list[str]:
        """Units of space + text, each without its first space."""
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        return [u[1:] for u in self.CUT.split(" " + text)[1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            return self._ids(texts)
        if len(self.cache) > KEPT_PIECES:
            self.cache.clear()
        look = self.cache.get
        cut = [self.units(t) for t in texts]
        found = [list(map(look, u)) for u in cut]
        gaps = [i for i, f in enumerate(found) if None in f]
        missing = list({u for i in gaps for u, ids in zip(cut[i], found[i], strict=True) if ids is None})
        self.cache.update(zip(missing, self._ids(missing), strict=True))
        if "" in self.cache:  # a last space alone, which the library itself would not encode
            self.cache[""] = self.space.to_bytes(4, "little")
        for i in gaps:
            found[i] = list(map(look, cut[i]))
        return [b"".join(f) for f in found]


def vocabularies(path_a: str, path_b: str):
    """The worker's two encoders with, for each, the byte lengths of its ids."""
    import numpy as np

    if (path_a, path_b) not in _vocabularies:
        a, b = LiteralEncoder(path_a), SentenceEncoder(path_b)
        sizes = [np.array([len(t) for t in v.token_bytes], dtype=np.int64) for v in (a, b)]
        if max(map(len, sizes)) > 1 << ID_BITS:
            raise ValueError("ids of both vocabularies must be below 2**20")
        _vocabularies[path_a, path_b] = a, b, *sizes
    return _vocabularies[path_a, path_b]


def lockstep(end_a, end_b, begin, stop):
    """Links and cuts of all lanes.

    ``end_a`` and ``end_b`` are the byte offsets where tokens end, counted through the block; lane k walks the A tokens
    ``begin[k]`` to ``stop[k]``.  Returns the A and B token numbers of every link (in no order) and of every cut.
    """
    import numpy as np

    i = begin.copy()
    j = np.searchsorted(end_b, np.where(begin > 0, end_a[begin - 1], 0), side="right")
    link_a, link_b, cut_a, cut_b = [], [], [], []
    while len(i):
        ea, eb = end_a[i], end_b[j]
        link_a.append(i)
        link_b.append(j)
        both = ea == eb
        cut_a.append(i[both])
        cut_b.append(j[both])
        i, j = i + (ea <= eb), j + (eb <= ea)
        done = i == stop
        if done.any():
            left = ~done
            i, j, stop = i[left], j[left], stop[left]
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (link_a, link_b, cut_a, cut_b)]


class Block:
    """The documents of one block, encoded and aligned."""

    def __init__(self, rows, vocab, lane: int = LANE):
        import numpy as np

        *_, len_a, len_b = vocab
        self.doc_ids = [doc for doc, _, _ in rows]
        self.n_a, self.n_b = (np.array([len(r[k]) // 4 for r in rows], dtype=np.int64) for k in (1, 2))
        self.a, self.b = (np.frombuffer(b"".join(r[k] for r in rows), dtype="<u4").astype(np.int64) for k in (1, 2))
        self.at_a, self.at_b = (np.concatenate(([0], np.cumsum(n))) for n in (self.n_a, self.n_b))
        self.doc_a = np.repeat(np.arange(len(rows)), self.n_a)
        # both sides of every document have the same bytes, so one count of bytes through the block serves both
        place = np.arange(len(self.a)) - self.at_a[self.doc_a]
        begin = np.flatnonzero(place % lane == 0)
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(np.cumsum(len_a[self.a]), np.cumsum(len_b[self.b]), begin,
                                                                    np.append(begin[1:], len(self.a)))
        self.n_links = np.bincount(self.doc_a[self.link_a], minlength=len(rows))
        self.n_groups = np.bincount(self.doc_a[self.cut_a], minlength=len(rows))

    def group_texts(self) -> list[bytes]:
        """Per document ``a1,a2|b1;a3|b2,b3``: the decimal ids of every group, in order."""
        import numpy as np

        n_a, n_b = len(self.a), len(self.b)
        digits = np.array([str(k) for k in range(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1)], dtype="S8").view(np.uint8).reshape(-1, 8)
        width = (digits != 0).sum(axis=1)
        last_a, last_b = np.zeros(n_a, dtype=bool), np.zeros(n_b, dtype=bool)
        last_a[self.cut_a], last_b[self.cut_b] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        before_b = np.concatenate(([0], ends_b))  # B tokens before each group
        ids, sign = np.empty(n_a + n_b, dtype=np.int64), np.empty(n_a + n_b, dtype=np.uint8)
        to_a = np.arange(n_a) + before_b[group_a]
        to_b = np.arange(n_b) + ends_a[group_b] if n_b else np.zeros(0, dtype=np.int64)
        ids[to_a], sign[to_a] = self.a, np.where(last_a, ord("|"), ord(","))
        ids[to_b], sign[to_b] = self.b, np.where(last_b, ord(";"), ord(","))
        size = width[ids]
        wide = digits[ids]
        wide[np.arange(len(ids)), size] = sign
        flat = wide[np.arange(8) <= size[:, None]].tobytes()
        end = np.concatenate(([0], np.cumsum(size + 1)))[self.at_a + self.at_b].tolist()
        return [flat[x:max(x, y - 1)] for x, y in zip(end[:-1], end[1:], strict=True)]

    def documents(self) -> list[tuple]:
        """Whole alignments, rows of ``ALIGNED``: links in order of A and then B, cuts as the tokens that end there."""
        import numpy as np

        order = np.lexsort((self.link_b, self.link_a))
        la, lb = self.link_a[order], self.link_b[order]
        cut_a, cut_b = np.sort(self.cut_a), np.sort(self.cut_b)
        upto = np.searchsorted(la, self.at_a).tolist()
        cuts = np.searchsorted(cut_a, self.at_a).tolist()
        out = []
        for k, doc in enumerate(self.doc_ids):
            a0, a1, b0, b1 = self.at_a[k], self.at_a[k + 1], self.at_b[k], self.at_b[k + 1]
            links, ends = slice(upto[k], upto[k + 1]), slice(cuts[k], cuts[k + 1])
            out.append((doc, self.a[a0:a1], self.b[b0:b1], la[links] - a0, lb[links] - b0, cut_a[ends] - a0, cut_b[ends] - b0))
        return out

    def row(self, number: int) -> tuple:
        """The row of ``BLOCK``."""
        import numpy as np

        mask = (1 << ID_BITS) - 1
        code, n = np.unique((self.doc_a[self.link_a] << (2 * ID_BITS)) | (self.a[self.link_a] << ID_BITS) | self.b[self.link_b], return_counts=True)
        pair = code & ((mask << ID_BITS) | mask)
        pairs = np.unique(pair)
        no = np.searchsorted(pairs, pair)
        pair_end = np.searchsorted(code >> (2 * ID_BITS), np.arange(len(self.doc_ids)), side="right")
        shas = [hashlib.sha256(t).hexdigest() if t else "" for t in self.group_texts()]
        return (number, self.doc_ids, self.n_a, self.n_b, self.n_groups, self.n_links, shas, pair_end, no.astype("<u4").tobytes(),
                n.astype("<u4").tobytes(), pairs, np.bincount(no, minlength=len(pairs)))


def encoded_blocks(batches, vocab, block_tokens: int = BLOCK_TOKENS, rows: int = 256):
    """Arrow batches of (doc_id, text) -> lists of (doc_id, A ids, B ids), the ids as bytes, closed at ``block_tokens``."""
    enc_a, enc_b, *_ = vocab

    def joined(table, ids):
        return b"".join(map(table.__getitem__, memoryview(ids).cast("I").tolist()))

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            texts = [t or "" for t in part.column(1).to_pylist()]
            full = [t for t in texts if t]
            ids = iter(zip(full, enc_a.encode([" " + t for t in full]), enc_b.encode(full), strict=True))
            for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                a = b = b""
                if text:
                    raw, a, b = next(ids)
                    raw = b" " + raw.encode()
                    if joined(enc_a.token_bytes, a) != raw or joined(enc_b.token_bytes, b) != raw:
                        a = b = b""
                held.append((doc, a, b))
                size += (len(a) + len(b)) // 4
                if size >= block_tokens or len(held) == 1 << (63 - 2 * ID_BITS):
                    yield held
                    held, size = [], 0
    if held:
        yield held


def texts_of(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def aligned(docs: DataFrame, path_a: str, path_b: str, block_tokens: int = BLOCK_TOKENS, lane: int = LANE) -> DataFrame:
    """Every document of ``docs(doc_id, text)`` with both id lists, all links and all cuts, as token numbers from 0."""
    texts, schema = texts_of(docs), arrow_schema(ALIGNED)

    def run(batches):
        vocab = vocabularies(path_a, path_b)
        for rows in encoded_blocks(batches, vocab, block_tokens):
            yield arrow_batch(Block(rows, vocab, lane).documents(), schema)

    return texts.mapInArrow(run, ALIGNED)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_tokens: int = BLOCK_TOKENS, lane: int = LANE) -> DataFrame:
    """One row of ``BLOCK`` per block, saved, since counting pairs reads it twice."""
    texts, schema = texts_of(docs), arrow_schema(BLOCK)

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        vocab = vocabularies(path_a, path_b)
        for k, rows in enumerate(encoded_blocks(batches, vocab, block_tokens)):
            yield arrow_batch([Block(rows, vocab, lane).row(first + k)], schema)

    return saved(texts.mapInArrow(run, BLOCK), "token-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, docs, best)``: in how many documents the pair is linked, and whether no pair of the same A id has more.

    An A id has at most as many pairs as B has ids, so the window over it is bounded by the vocabulary.
    """
    counts = (blocks.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_docs").alias("docs")))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", ID_BITS)))
    return saved(counts.select("pair", "docs", (F.col("docs") == most).alias("best")), "token-pairs")


def with_counts(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of ``RESULT`` per document."""
    wanted = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(counts, "pair")
    schema = arrow_schema(RESULT)

    def finish(rows, found):
        import numpy as np
        import pyarrow as pa

        out = []
        pair, docs = found.column("pair").to_numpy(), found.column("docs").to_numpy()
        best = found.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(pair)  # as the block lists its pairs
        docs, best = docs[order], best[order]
        for r in rows.to_pylist():
            no, n = (np.frombuffer(r[c], dtype="<u4").astype(np.int64) for c in ("pair_no", "pair_n"))
            ends = np.concatenate(([0], np.array(r["pair_end"], dtype=np.int64)))
            sums = [np.concatenate(([0], np.cumsum(x[no] * n)))[ends] if len(no) else np.zeros(len(ends), dtype=np.int64) for x in (best, docs)]
            n_best, count_sum = (np.diff(s) for s in sums)
            out += zip(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], n_best.tolist(), count_sum.tolist(), r["sha"], strict=True)
        return pa.Table.from_batches([arrow_batch(out, schema)])

    return (blocks.drop("pairs", "pair_docs").groupBy("block").cogroup(wanted.groupBy("of"))
            .applyInArrow(finish, RESULT))


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the two public tokenizers over every document, with corpus-wide counts of linked ids."""
    import public_tokenizers

    blocks = aligned_blocks(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return with_counts(blocks, pair_counts(blocks))
