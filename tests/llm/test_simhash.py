import random
from collections import defaultdict

import pytest
from xxhash import xxh64_intdigest

from provlake.llm import simhash_trie as st
from provlake.llm.components import connected_components


def plain_fingerprint(words):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    k = min(3, len(words))
    hashes = [xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, link):
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if link(items[i], items[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(items))]


def near(a, b):
    return (a ^ b).bit_count() <= 3


@pytest.mark.parametrize("split_above", [20_000, 5])
def test_trie_finds_all_links(spark, split_above):
    rnd = random.Random(3)
    prints = [0, 7, (1 << 64) - 1]
    for _ in range(30):
        prints.append(rnd.getrandbits(64))
        for _ in range(rnd.randrange(12)):  # chains of close fingerprints in every block
            f = rnd.choice(prints[-5:])
            for b in rnd.sample(range(64), rnd.randrange(1, 5)):
                f ^= 1 << b
            prints.append(f)
    prints = sorted(set(prints))
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    labels = {r.node: r.label for r in connected_components(st.trie_links(df, 3, split_above)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for s, r in zip(signed, plain_components(prints, near), strict=True):
        got[labels.get(s, s)].add(s)
        want[r].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_documents(spark, odd_docs, odd_rows, split_words):
    prints = [plain_fingerprint(split_words(r[1])) for r in odd_rows]
    roots = plain_components(prints, near)
    least = {}
    for r, root in zip(odd_rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted(((r[0], f - (1 << 64) if f >> 63 else f, least.get(root)) for r, f, root in zip(odd_rows, prints, roots, strict=True)),
                  key=str)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in st.simhash_components(odd_docs).collect()), key=str)
    assert got == want


def test_empty_and_long_path(spark, no_docs):
    assert st.simhash_components(no_docs).count() == 0
    path = spark.range(300).selectExpr("id as u", "id + 1 as v")
    assert connected_components(path).select("label").distinct().count() == 1
