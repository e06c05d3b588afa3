import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from provlake.llm import mixing


def plain_targets(sizes):
    """Deal by weight, cap, deal the excess again, until none is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * sizes[s] or sizes[s] == 0]
        if not over:
            return {**full, **{s: weight[s] * level for s in free}}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def plain_quotas(shares, seats):
    got = [0] * len(shares)
    for _ in range(seats if any(shares) else 0):
        got[max(range(len(shares)), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_apportionment_goes_to_the_highest_quotient(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for g in range(30):
        shares = [float(rnd.choice([0, 1, 3, 10, rnd.randrange(1, 5000)])) for _ in range(rnd.randrange(1, 40))]
        seats = rnd.choice([0, 1, 5, 37, 1000])
        want |= {(g, i): q for i, q in enumerate(plain_quotas(shares, seats))}
        rows += [(g, i, s, seats) for i, s in enumerate(shares)]
    df = spark.createDataFrame(rows, "g int, i int, share double, seats long")
    assert {(r.g, r.i): r.quota for r in mixing.apportion(df, ["g"], "share", "seats", ["i"]).collect()} == want


@pytest.mark.parametrize("block,shard", [(64, 4_000_000), (16, 3000)])
def test_plan(spark, odd_docs, odd_rows, split_words, block, shard):
    rows = mixing.plan_mix(odd_docs, block_words=block, shard_words=shard).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r[0], len(split_words(r[1]))) for r in odd_rows)
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len(split_words(r[1]))
    targets, taken, shards = plain_targets(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.passes * r["size"] + r.extra <= 3 * r["size"]
        taken[r.source] += r.passes * r["size"] + r.extra
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 2 * block * (1 + sizes[s] // shard)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan_mix(odd_docs.repartition(5), block_words=block, shard_words=shard).collect()))


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, "w " * 5000, "big") for i in range(20)] + [(100, "a b c d e f g h i j", "ten"), (101, "w " * 20, "twenty"), (102, "w " * 100, "two"), (103, "w " * 100, "two"),
                                                           (104, "one", "single")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(df).groupBy("source", "target").agg(F.sum(F.col("passes") * F.col("size") + F.col("extra")).alias("taken")).collect()
    assert {r.source: (r.target, r.taken) for r in plan if r.source != "big"} == {"ten": (30, 30), "twenty": (60, 60), "two": (600, 600), "single": (3, 3)}
    big = next(r for r in plan if r.source == "big")
    assert abs(big.taken - big.target) <= 1
    assert {r.source for r in mixing.mix_documents(df).select("source").distinct().collect()} == {"big", "ten", "twenty", "two", "single"}


def test_rows_of_the_mix(spark, odd_docs, odd_rows, split_words, no_docs):
    plan = mixing.plan_mix(odd_docs).withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
    want = {r.doc_id: r.t for r in plan.groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()}
    got = defaultdict(int)
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    originals = defaultdict(list)
    for r in odd_rows:
        originals[r[0]].append(split_words(r[1]))
    for r in mixed.collect():
        words = split_words(r.text)
        got[r.doc_id] += len(words)
        assert words in [o[:len(words)] for o in originals[r.doc_id]] and r.n_chars == len(r.text)
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert mixing.plan_mix(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0
