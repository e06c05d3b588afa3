"""Licence scan by diagonal voting, in DataFrame operations only.

All rolling runs of three words of every text are joined by hash to the positions of the same runs in the licence
templates, and the words behind the hash are compared.  A hit at word p of a text and word t of a template votes for the
diagonal p - t: all words of an unchanged copy vote for one diagonal.  Votes are counted per diagonal; diagonals of one
template at most ``SHIFT`` apart, whose hits follow each other within ``GAP`` words, are merged, since an inserted or
left out word moves what follows to a neighbouring diagonal.  A merged span is verified by the share of the template's
words that its hits cover: short templates (below ``NEAR_FROM`` words) must stand whole on one diagonal, long ones to
``LEAST_SHARE`` and without much else between.

Only hits and one row per document are moved, once, to the document's row number; all later grouping stays there.

Edge cases: null and empty texts have no words and no labels (score 0, no first or last word); a null doc_id stays null; repeated rows are
judged each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlake.llm.common import documents, let
from provlake.llm.license_texts import BASE, NOTICES

RUN = 3  # words that are hashed together
SHIFT = 12  # diagonals that far apart still belong together
GAP = 12  # words between two hits of one span
NEAR_FROM = 20  # words of a template from which it may differ
LEAST_SHARE = 0.8
LONGEST = 1.25  # words of a verified span to words of its template

TEMPLATES = [(label, text, True) for label, text in BASE] + [(label, text, False) for label, text in NOTICES]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    """Words of ASCII letters, digits and all other characters above 0x7F, with A-Z in lower case.

    Lower case of other letters cannot touch a template, but for the two signs that become ASCII letters.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    folded = F.when(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(folded, SEPARATORS, -1), "")


def runs(words: Column, size: int = RUN) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    def all_of(w):
        return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
                      ).otherwise(F.array().cast("array<bigint>"))

    return let(words, all_of)


def template_runs(spark: SparkSession, templates=None) -> DataFrame:
    """``(template, tpos, run, run_words)``: every position of every template; a few hundred rows, whatever the corpus."""
    rows = [F.struct(F.lit(k).alias("template"), F.lit(text).alias("text")) for k, (_, text, _) in enumerate(templates or TEMPLATES)]
    words = spark.range(1).select(F.inline(F.array(*rows))).select("template", license_words(F.col("text")).alias("w"))
    return words.select("template", "w", F.posexplode(runs(F.col("w"))).alias("tpos", "run")).select(
        "template", "tpos", "run", F.slice("w", F.col("tpos") + 1, F.lit(RUN)).alias("run_words"))


def hits(docs: DataFrame, templates=None) -> DataFrame:
    """``(row, doc_id, n_words, template, pos, tpos)``: all hits, and one row per document without a template."""
    texts = docs.select(F.col("doc_id"), license_words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    # run -1 stands for the document itself
    every = texts.select("row", "doc_id", "w", F.explode(F.concat(
        F.transform(runs(F.col("w")), lambda h, i: F.struct(i.alias("pos"), h.alias("run"))),
        F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("bigint").alias("run"))))).alias("at"))
    every = every.select("row", "doc_id", "w", "at.pos", "at.run")
    known = F.broadcast(template_runs(docs.sparkSession, templates).withColumnRenamed("run", "known"))
    same = F.col("run") == F.col("known")
    for k in range(RUN):
        same &= F.get("w", F.col("pos") + k) == F.get("run_words", F.lit(k))
    found = every.join(known, same, "left").where(F.col("template").isNotNull() | (F.col("pos") < 0))
    return found.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "template", "pos", "tpos").repartition("row")


def of_template(values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("template"))


def spans(found: DataFrame, templates=None) -> DataFrame:
    """Merged spans of ``hits``: row, doc_id, n_words, label, base, first_word, last_word, share, verified.

    A document without hits has one row without a label.
    """
    templates = templates or TEMPLATES
    sizes = [len(text.split()) for _, text, _ in templates]
    size, near = of_template(sizes), of_template([n >= NEAR_FROM for n in sizes])
    key = ["row", "template"]
    diagonals = (found.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy(*key, "diagonal")
                 .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("tpos")).alias("seen")))
    places = diagonals.select(
        *key, "diagonal", "doc_id", "n_words", "seen", (F.col("diagonal") + F.array_min("seen")).alias("first"),
        (F.col("diagonal") + F.array_max("seen") + (RUN - 1)).alias("last"))
    by_diagonal = Window.partitionBy(*key).orderBy("diagonal")
    far = ~near | (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > SHIFT)
    bundles = places.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("bundle", F.sum("far").over(by_diagonal))
    by_place = Window.partitionBy(*key, "bundle").orderBy("first", "diagonal")
    behind = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    islands = (bundles.withColumn("apart", F.coalesce(F.col("first") > behind + GAP, F.lit(True)).cast("int"))
               .withColumn("island", F.sum("apart").over(by_place)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("seen")), lambda t: F.sequence(t, t + (RUN - 1))))))
    merged = islands.groupBy(*key, "bundle", "island").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        covered.alias("covered"))
    share = F.col("covered") / size
    length = F.col("last_word") - F.col("first_word") + 1
    verified = F.when(near, (share >= LEAST_SHARE) & (length <= LONGEST * size)).otherwise(F.col("covered") == size)
    return merged.select(
        "row", "doc_id", "n_words", of_template([label for label, _, _ in templates]).alias("label"), of_template([b for _, _, b in templates]).alias("base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce(share, F.lit(0.0)).alias("share"), F.coalesce(verified, F.lit(False)).alias("verified"))


def labelled(found: DataFrame) -> DataFrame:
    """Per document: words, places of the base phrases, labels, and the best share of a template as score."""
    base = F.col("verified") & F.col("base")

    def names(condition):
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("verified")).alias("labels"), F.max("share").alias("score")).drop("row")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return labelled(spans(hits(documents(spark, sf_dir))))


def oracle() -> str:
    """DuckDB SQL for the query: runs are joined by their words."""
    rows = ", ".join(f"({k}, '{label}', {str(b).lower()}, string_split('{text}', ' '))" for k, (label, text, b) in enumerate(TEMPLATES))
    return f"""
WITH t AS (SELECT *, len(w) AS size, len(w) >= {NEAR_FROM} AS near FROM (VALUES {rows}) AS v(template, label, base, w)),
tr AS (SELECT template, unnest(range(len(w) - 2)) AS tpos, w FROM t),
tg AS (SELECT template, tpos, w[tpos + 1] AS a, w[tpos + 2] AS b, w[tpos + 3] AS c FROM tr),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
dr AS (SELECT row, w, unnest(range(len(w) - 2)) AS pos FROM d WHERE len(w) > 2),
dg AS (SELECT row, pos, w[pos + 1] AS a, w[pos + 2] AS b, w[pos + 3] AS c FROM dr),
h AS (SELECT row, template, pos - tpos AS diagonal, min(tpos) AS lo, max(tpos) AS hi, list(tpos) AS seen
      FROM dg JOIN tg USING (a, b, c) GROUP BY ALL),
p AS (SELECT h.*, size, near, label, base, diagonal + lo AS first, diagonal + hi + 2 AS last FROM h JOIN t USING (template)),
q AS (SELECT *, CASE WHEN near AND diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= {SHIFT} THEN 0 ELSE 1 END AS far FROM p),
r AS (SELECT *, sum(far) OVER (PARTITION BY row, template ORDER BY diagonal) AS bundle FROM q),
s AS (SELECT *, CASE WHEN first <= {GAP} + max(last) OVER (PARTITION BY row, template, bundle ORDER BY first, diagonal
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS apart FROM r),
u AS (SELECT *, sum(apart) OVER (PARTITION BY row, template, bundle ORDER BY first, diagonal) AS island FROM s),
m AS (SELECT row, template, any_value(size) AS size, any_value(near) AS near, any_value(label) AS label, any_value(base) AS base,
        min(first) AS first, max(last) AS last,
        len(list_distinct(flatten(list_transform(flatten(list(seen)), lambda x: [x, x + 1, x + 2])))) AS covered
      FROM u GROUP BY row, template, bundle, island),
v AS (SELECT *, covered / size AS share, CASE WHEN near THEN covered / size >= {LEAST_SHARE} AND last - first + 1 <= {LONGEST} * size
        ELSE covered = size END AS verified FROM m),
g AS (SELECT row, count(*) FILTER (verified AND base) AS n_base, min(first) FILTER (verified AND base) AS first_word,
        max(first) FILTER (verified AND base) AS last_word,
        array_to_string(list_sort(list_distinct(list(label) FILTER (verified AND base))), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list(label) FILTER (verified))), ',') AS labels, max(share) AS score FROM v GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (row)"""
