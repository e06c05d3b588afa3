"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Two multinomials over hashed word n-grams (single words and pairs) are counted: one over trusted documents, one over
the whole raw corpus.  The trusted one is smoothed towards the raw one, so an n-gram that no trusted
text can have shown yet says little.  A document's score is the mean log ratio over its n-grams, and every
document is held against the same fixed threshold.

Repeated windows are compared by 64-bit hashes of 8 words; two different windows of one document
agree by chance with a probability below 1e-9 even for a million words.

Edge cases: null and empty texts have no words and fail the base rules; a document with no n-gram scores 0; repeated
rows are judged each; other columns are ignored; an empty table gives no rows; without trusted documents the ratio is 0
everywhere, so the base rules alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm.common import let, saved, words

BUCKETS = 1 << 16  # rows of the model, which bounds what is broadcast
TRUSTED_ROWS = 20_000  # labelled documents that the trusted multinomial is fitted on, at most
PRIOR = 300_000.0  # n-grams' worth of the raw multinomial added to the trusted one
KEEP_FROM = -0.125  # mean log ratio from which a document is kept
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the list, the first included."""
    windows = F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)),
                                                          lambda i: F.xxhash64(F.slice(hashes, i, F.lit(width))))
                     ).otherwise(F.array().cast("array<bigint>"))

    def covered(wins):
        ordered = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda p: F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                                                | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(width)), F.lit(width))),
                                                 F.lit(0), lambda a, n: a + n))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """Add the counts and ``base_failed`` to ``docs(text)``, and ``hashes``: the words' 64-bit hashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return (docs.withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
            .withColumn("n_words", F.size("hashes").cast("long"))
            .withColumn("word_chars", F.length(bare).cast("long"))
            .withColumn("n_symbols", (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
            .withColumn("n_repeat_words", repeated_words(F.col("hashes")))
            .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))


def ngram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and word pairs."""
    pairs = F.when(F.size(hashes) > 1, F.zip_with(F.slice(hashes, F.lit(1), F.size(hashes) - 1), F.slice(hashes, F.lit(2), F.size(hashes) - 1),
                                                  lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets))), pairs)


def ratio_model(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """``(bucket, llr)`` counted over all ``docs(doc_id, text)``; ``trusted(doc_id)`` is a bounded list of the trusted ones."""
    hashes = docs.select(F.col("doc_id").alias("id"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    marked = hashes.join(F.broadcast(trusted.select(F.col("doc_id").alias("id"), F.lit(1).alias("good")).distinct()), "id", "left")
    counts = saved(marked.select(F.coalesce("good", F.lit(0)).cast("long").alias("good"), F.explode(ngram_buckets(F.col("hashes"), buckets)).alias("bucket"))
                   .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")), "ngrams")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    share = F.col("raw") / F.lit(float(total.raw or 1))
    return counts.select("bucket", F.log((F.col("target") + prior * share) / ((float(total.target or 0) + prior) * share)).alias("llr"))


def trusted_sample(labels: DataFrame, rows: int = TRUSTED_ROWS, seed: int = 5) -> DataFrame:
    """At most ``rows`` ids of documents labelled as good, chosen by a seeded hash."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)


def judged(docs: DataFrame, model: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, ``base_failed``, ``llr`` and ``kept`` of every row of ``docs(doc_id, text)``."""
    buckets = model.agg(F.count("*")).first()[0]
    assert buckets <= BUCKETS, "the model is broadcast, so its size is bounded"
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = (base_rules(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
            .select("row", "doc_id", *counts, "base_failed", F.explode_outer(ngram_buckets(F.col("hashes"))).alias("bucket")))
    scored = rows.join(F.broadcast(model), "bucket", "left").groupBy("row").agg(
        *[F.first(c).alias(c) for c in ["doc_id", *counts, "base_failed"]], F.coalesce(F.avg("llr"), F.lit(0.0)).alias("llr"))
    return scored.drop("row").withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= keep_from))


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and verdict for every document; trusted are labelled documents of good quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ratio_model(docs, trusted_sample(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged(docs, model)
