"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of two word lists (a short fixed one, and words that the labelled training texts
show to go with toxicity), second-person words near listed words, capitals, punctuation and
obfuscation.  Trees are fitted on one part of a bounded sample of labelled rows and calibrated on another; every
text is then scored whole, in one pass and without a shuffle.

Edge cases: null and empty texts have all features zero and get that text's score; labels without a document, or null,
are not used, a document with both labels counts as toxic; where the sample has one class only, every score is its
smoothed rate; a null doc_id counts as held out; repeated rows are scored each; other columns are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlake.llm.common import fold_of, saved, ship_package

LABELLED_ROWS = 30_000  # labelled documents that the model is fitted on, at most
LEXICON_WORDS = 150  # learned words and stems, at most
STEM = 5  # letters of a stem

SEED_LEXICON = frozenset(
    "idiot moron stupid dumb loser pathetic worthless disgusting trash scum clown garbage filth vermin jerk fool "
    "imbecile pig hate dumm dummkopf abschaum versager müll widerlich nutzlos stupide crétin imbécile ordure minable "
    "dégoûtant nul inútil estúpido idiota basura asqueroso escoria payaso imbécil".split())
SECOND_PERSON = frozenset("you your yours you're u ya du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti vos usted ustedes".split())
PLAIN_LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+[*@$!.\-_0-9]+[\w*@$!.\-]*[^\W\d_]")
LONG_RUN = re.compile(r"([^\W\d_])\1\1")
FEATURES = ["log_words", "seed_rate", "seed_count", "learned_rate", "learned_count", "near_second_person", "second_person_rate", "capitals",
            "capital_words", "exclamations", "punctuation", "symbols", "digits", "masked_rate", "masked_hits", "long_runs"]


def unmasks(word: str, learned: frozenset[str]) -> bool:
    """Does a word with signs inside stand for a listed word?  A star may stand for nothing or for any one letter."""
    plain = word.lower().translate(PLAIN_LETTERS)
    if plain in SEED_LEXICON or plain in learned or plain[:STEM] + "*" in learned:
        return True
    if "*" not in word:
        return False
    holes = "*".join(p.translate(PLAIN_LETTERS) for p in word.lower().split("*"))
    return any(len(w) == len(holes) and all(a in ("*", b) for a, b in zip(holes, w, strict=True)) for w in SEED_LEXICON | learned)


def text_features(text: str | None, learned: frozenset[str]) -> list[float]:
    """The dense features of one text, in the order of FEATURES."""
    import numpy as np

    text = text or ""
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    words = WORD.findall(text.lower())
    n = len(tokens)
    seed = [i for i, w in enumerate(words) if w in SEED_LEXICON]
    found = [i for i, w in enumerate(words) if w in learned or w[:STEM] + "*" in learned]
    you = {i for i, w in enumerate(words) if w in SECOND_PERSON}
    close = sum(any(j in you for j in range(i - 3, i + 4)) for i in {*seed, *found}) if you else 0
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=128)
    letters = bytes_[65:91].sum() + bytes_[97:123].sum()
    masked = MASKED.findall(text)
    unmasked = sum(unmasks(m, learned) for m in masked)
    count = lambda chars: float(sum(bytes_[ord(c)] for c in chars))
    return [float(np.log1p(n)), len(seed) / n, float(np.log1p(len(seed))), len(found) / n, float(np.log1p(len(found))), close / n, len(you) / n,
            float(bytes_[65:91].sum() / max(letters, 1)), sum(w.isupper() and len(w) > 1 for w in tokens) / n, count("!?") / n,
            count(".,;:!?'\"()-") / len(text), count("#*$%&|<>@^~") / n, float(bytes_[48:58].sum() / len(text)), len(masked) / n,
            float(np.log1p(unmasked)), len(LONG_RUN.findall(text)) / n]


def with_features(docs: DataFrame, learned: list[str], name: str = "features") -> DataFrame:
    ship_package(docs.sparkSession)
    lexicon = frozenset(learned)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t, lexicon) for t in texts])

    return docs.withColumn(name, array_to_vector(features(F.col("text").cast("string"))))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, seed: int = 11) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``rows`` labelled ids outside the held-out fold, chosen by a seeded hash."""
    ids = (labels.where("doc_id is not null and toxic is not null").where(fold_of(F.col("doc_id"), 5) != 0)
           .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
           .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows))
    return saved(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "labelled")


def learned_lexicon(labelled: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """Words and stems (written with a star) far more frequent among toxic texts than among others, by document counts over the labelled sample."""
    totals = labelled.agg(F.sum("label").alias("toxic"), F.count("*").alias("all")).first()
    if not totals.toxic or totals.toxic == totals.all:
        return []
    bare = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")), " ")
    stems = F.transform(F.filter(bare, lambda w: F.length(w) > STEM), lambda w: F.concat(F.substr(w, F.lit(1), F.lit(STEM)), F.lit("*")))
    counts = (labelled.select("label", F.explode(F.array_distinct(F.concat(bare, stems))).alias("word")).where("length(word) > 1")
              .groupBy("word").agg(F.sum("label").alias("t"), F.count("*").alias("n")).where("t >= 3"))
    odds = F.log((F.col("t") + 0.5) / (totals.toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (totals.all - totals.toxic + 1.0))
    # two in a thousand words of one class pass a log-odds of 2 by chance in a small sample, so it is weighed by its count
    return [r.word for r in counts.withColumn("odds", odds).where("odds > 2 and t * odds > 12")
            .orderBy(F.desc(F.col("t") * F.col("odds")), "word").limit(most).collect()]


@dataclass
class ToxicityModel:
    lexicon: list[str]
    rate: float
    trees: GBTClassificationModel | None = None
    steps: IsotonicRegressionModel | None = None

    def scored(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with the calibrated score of every text, from 0 to 1."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.rate))
        own = ["_features", "_raw", "_probability", "_prediction", "_tree", "_score"]
        rated = (self.trees.transform(with_features(docs, self.lexicon, "_features"))
                 .withColumn("_tree", vector_to_array("_probability")[1]))
        if self.steps is None:
            rated = rated.withColumn("_score", F.col("_tree"))
        else:
            rated = self.steps.transform(rated)
        return rated.withColumn(name, F.greatest(F.least("_score", F.lit(1.0)), F.lit(0.0))).drop(*own)


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, trees: int = 20, depth: int = 4, seed: int = 3) -> ToxicityModel:
    """Fit on labelled documents: folds 2 to 4 of the id grow the trees, fold 1 calibrates them, fold 0 is never seen."""
    labelled = labelled_sample(docs, labels, rows)
    growing, lexicon = labelled.where(fold_of(F.col("doc_id"), 5) != 1), []
    n = {r.label: r["count"] for r in growing.groupBy("label").count().collect()}
    rate = (n.get(1.0, 0) + 1) / (sum(n.values()) + 2)
    if len(n) < 2:
        return ToxicityModel(lexicon, rate)
    lexicon = learned_lexicon(growing)
    rows_ = saved(with_features(labelled, lexicon, "_features").select("doc_id", "label", vector_to_array("_features").alias("x")), "features").select(
        "doc_id", "label", array_to_vector("x").alias("_features"))
    gbt = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_prediction", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=5)
    gbt = gbt.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    grown = gbt.fit(rows_.where(fold_of(F.col("doc_id"), 5) != 1).coalesce(4))
    held = grown.transform(rows_.where(fold_of(F.col("doc_id"), 5) == 1)).withColumn("_tree", vector_to_array("_probability")[1])
    steps = None
    if held.select("label").distinct().count() == 2:
        steps = IsotonicRegression(featuresCol="_tree", labelCol="label", predictionCol="_score").fit(held.select("_tree", "label").coalesce(1))
    return ToxicityModel(lexicon, rate, grown, steps)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, unchanged."""
    model = fit(docs, labels)
    return model.scored(docs, "_toxicity").where(F.col("_toxicity") < threshold).select(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.scored(docs.select("doc_id", "text")).select(
        "doc_id", (F.coalesce(fold_of(F.col("doc_id"), 5), F.lit(0)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
