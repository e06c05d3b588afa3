import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from provlake.llm import quality_llr as q


def plain_counts(text, split_words):
    words, text = split_words(text), text or ""
    wins = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if wins[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if split_words(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_a_plain_scan(spark, odd_docs, table, split_words):
    loop = [(901, "a b c d e f g h " * 5), (902, "a " * 40), (903, "x\nx\n\nx \n x"), (904, "é😀 *%$ <b>|"), (905, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 z 1 2 3 4 5 6 7 8 9")]
    df = odd_docs.select("doc_id", "text").union(table("documents").select("doc_id", "text")).union(spark.createDataFrame(loop, "doc_id long, text string"))
    rows = q.base_rules(df.withColumn("n", F.monotonically_increasing_id()).repartition(8)).collect()
    assert len(rows) == df.count()
    for r in rows:
        want = plain_counts(r.text, split_words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_ratio_equals_plain_counting(spark, split_words):
    texts = [(1, "good words here good"), (2, "bad *** bad"), (3, None), (4, "good"), (4, "good"), (5, "mixed good bad words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    hashes = dict(docs.select(F.explode(F.array_distinct(q.words(F.col("text")))).alias("w")).distinct().select("w", F.pmod(F.xxhash64("w"), F.lit(q.BUCKETS))).collect())
    pair = {tuple(r)[:2]: r[2] for r in docs.select(q.words(F.col("text")).alias("w")).where("size(w) > 1").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))).alias("p"))
        .select("p.a", "p.b", F.pmod(F.xxhash64(F.xxhash64("p.a"), F.xxhash64("p.b")), F.lit(q.BUCKETS))).collect()}
    raw, target, feats = Counter(), Counter(), defaultdict(list)
    for n, (doc, text) in enumerate(texts):
        w = split_words(text)
        feats[n] = [hashes[x] for x in w] + [pair[p] for p in zip(w, w[1:], strict=False)]
        raw.update(feats[n])
        target.update(feats[n] if doc in (1, 4) else [])
    nr, nt = sum(raw.values()), sum(target.values())
    llr = {b: math.log((target[b] + 50 * raw[b] / nr) / ((nt + 50) * raw[b] / nr)) for b in raw}
    model = q.ratio_model(docs, spark.createDataFrame([(1,), (4,)], "doc_id long"), prior=50)
    assert {r.bucket: pytest.approx(r.llr) for r in model.collect()} == llr
    got = sorted((r.doc_id, r.llr) for r in q.judged(docs, model).collect())
    want = sorted((d, sum(llr[b] for b in feats[n]) / len(feats[n]) if feats[n] else 0.0) for n, (d, _) in enumerate(texts))
    assert [(d, pytest.approx(x)) for d, x in got] == want


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    model = q.ratio_model(odd_docs, q.trusted_sample(spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    rows = q.judged(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(r.kept == (not r.base_failed) for r in rows)
    assert q.judged(no_docs, q.ratio_model(no_docs, no_docs.select("doc_id"))).count() == 0


def test_verdict_follows_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = q.op2_quality_llr(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.95 and kept[0] < 0.05
