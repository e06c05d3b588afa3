import hashlib
from collections import Counter, defaultdict

import pytest

from provlake.llm import token_links

PLANTED = ["a  b   c ", " lead", "  ", " ", "tail ", "▁mark", "nul\x00l", "<s></s><unk><0x41> <|endoftext|>", "é ü 日本語 🙂🙂 naïve", "\t\ttab\n\n \n x",
           "x" * 5000, " ".join(["word"] * 3000), "日本" * 900, "don't  can't won't", "same text", "same text"]


def plain(texts):
    """Every link, group and count by direct comparison of byte ranges."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = {}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for k, b in enumerate(b for b in range(256) if b not in printable):
        letters[chr(256 + k)] = b
    letters |= {chr(b): b for b in printable}
    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append(([], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, s = 0, []
            for p in parts:
                s.append((at, at + len(p)))
                at += len(p)
            spans.append(s)
        links, first = [], 0
        for i, (x, y) in enumerate(spans[0]):
            while spans[1][first][1] <= x:
                first += 1
            j = first
            while j < len(b) and spans[1][j][0] < y:
                links.append((i, j))
                j += 1
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for cut in common:
            i2 = next(k for k in range(i, len(a)) if spans[0][k][1] == cut) + 1
            j2 = next(k for k in range(j, len(b)) if spans[1][k][1] == cut) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        out.append((a, b, links, groups))
    docs = Counter(p for a, b, links, _ in out for p in {(a[i], b[j]) for i, j in links})
    top = defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    rows = []
    for a, b, links, groups in out:
        pairs = [(a[i], b[j]) for i, j in links]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(groups), len(links), sum(docs[p] == top[p[0]] for p in pairs), sum(docs[p] for p in pairs), sha))
    return out, rows


@pytest.fixture(scope="module")
def texts(odd_rows, table):
    return [r[1] for r in odd_rows] + PLANTED + [r.text for r in table("documents").select("text").collect()]


@pytest.fixture(scope="module")
def want(texts):
    return plain(texts)


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_counts_links_and_groups_equal_a_plain_comparison(spark, texts, want, paths):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for tokens, lane in ((token_links.BLOCK_TOKENS, token_links.LANE), (3000, 7)):
        blocks = token_links.aligned_blocks(docs, *paths, tokens, lane)
        got = {r.doc_id: tuple(r)[1:] for r in token_links.with_counts(blocks, token_links.pair_counts(blocks)).collect()}
        assert len(got) == len(texts)
        for i, w in enumerate(want[1]):
            assert got[i] == w, (texts[i] or "")[:60]


def test_whole_alignments(spark, texts, want, paths):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in token_links.aligned(docs, *paths, 2000, 16).collect():
        a, b, links, groups = want[0][r.doc_id]
        assert (r.a_ids, r.b_ids) == (a, b) and list(zip(r.link_a, r.link_b, strict=True)) == links
        assert len(r.cut_a) == len(r.cut_b) == len(groups)


def test_edge_cases(spark, odd_docs, odd_rows, no_docs, paths):
    blocks = token_links.aligned_blocks(odd_docs, *paths)
    rows = token_links.with_counts(blocks, token_links.pair_counts(blocks)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)
    by_id = {r.doc_id: tuple(r)[1:] for r in rows}
    assert by_id[1] == by_id[2] == (0, 0, 0, 0, 0, 0, "") and by_id[None][0] > 0
    blocks = token_links.aligned_blocks(no_docs, *paths)
    assert token_links.with_counts(blocks, token_links.pair_counts(blocks)).count() == 0


def test_query(spark, sf, table):
    from provlake.llm import QUERIES

    docs = table("documents").collect()
    want = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs])[1], strict=True))
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_token_links"](spark, sf).collect()} == want
