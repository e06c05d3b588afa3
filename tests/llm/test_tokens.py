import uuid
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from provlake.llm import packing, token_planes, tokens


def plain(name, texts, end):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words")])
def test_pieces_encode_like_whole_texts(name, mode, odd_rows, table):
    texts = [r[1] or "" for r in odd_rows] + [r[0] for r in table("documents").select("text").collect()]
    texts += ["  lead", "trail  ", "a\n  b", "a  \n b", "a   b", " 's it 're", "İ Σας ΑΣ", "é ́x", "1 234  56", "日本 語 😀😀 ok"]
    got = tokens.PieceEncoder(public_tokenizers.path(name), mode).encode(texts)
    assert [g + (3).to_bytes(4, "little") for g in got] == plain(name, texts, 3)


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(5, "<u4"), rng.integers(0, 50257, 4099).astype("<u4"), np.array([2**32 - 1, 0, 7], "<u4")):
        assert (token_planes.from_planes(token_planes.to_planes(ids, mode), len(ids), mode) == ids).all()


@pytest.mark.parametrize("mode,chunk", [("byte", 65536), ("bit", 50)])
def test_token_file_gives_back_every_id(spark, odd_docs, odd_rows, tmp_path, mode, chunk):
    path = str(tmp_path / uuid.uuid4().hex)
    token_planes.write_tokens(odd_docs, path, public_tokenizers.path("byte_bpe_50k.json"), mode=mode, chunk_ids=chunk, shards=4)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_planes.read_tokens(spark, path).collect())
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    start, want = 0, []
    for r, ids in zip(rows, plain("byte_bpe_50k.json", [r[1] for r in rows], 0), strict=True):
        want.append((start, r[0], len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == want


def test_empty_tables(spark, no_docs, tmp_path):
    path = str(tmp_path / "none")
    token_planes.write_tokens(no_docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_planes.read_tokens(spark, path).count() == 0
    assert packing.packed_documents(no_docs).count() == 0


def check_packed(rows, docs, limits):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    padding = 0
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == list(np.cumsum([0] + [r.length for r in seq])[:-1])
        total = sum(r.length for r in seq)
        loss = sum(r.length - (r.start == 0) for r in seq)
        assert total <= limits[0] and len(seq) <= limits[1] and loss <= limits[2]
        padding += 0 if total & (total - 1) == 0 else limits[0] - total
    for doc_id, want in docs.items():
        whole = b"".join(bytes(r.ids) for r in sorted(by_doc[doc_id], key=lambda r: r.start))
        assert whole == want
    assert padding == 0


@pytest.mark.parametrize("limits", [(4096, 256, 4096), (64, 3, 40)])
def test_every_id_is_packed_once_within_all_limits(odd_docs, odd_rows, limits):
    out = packing.pack(odd_docs, public_tokenizers.path("word_bpe_49k.json"), 2, *limits).collect()
    unique = [r for r in odd_rows if r[0] != 8]
    docs = dict(zip([r[0] for r in unique], plain("word_bpe_49k.json", [r[1] for r in unique], 2), strict=True))
    check_packed(out, docs, limits)
    assert sum(r.length for r in out if r.doc_id == 8) == 2 * next(r.doc_tokens for r in out if r.doc_id == 8)


def test_rows_without_loss_leave_its_limit_free(spark):
    rows = spark.createDataFrame([(i, "word " * 30, i % 2 == 0) for i in range(40)], "doc_id long, text string, answer boolean").coalesce(1)
    out = packing.pack(rows, public_tokenizers.path("word_bpe_49k.json"), 2, 128, 100, 64, loss_col="answer").collect()
    loss = defaultdict(int)
    for r in out:
        loss[r.sequence_id] += (r.length - (r.start == 0)) if r.doc_id % 2 == 0 else 0
    assert sum(r.length for r in out) == 40 * 31 and max(loss.values()) <= 64
