"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

A mix of as many words as the corpus has is dealt to the sources by weight; no source gives more
than ``max_epochs`` times its size, and what that leaves over is dealt to the others by weight.
The words of all sources are cut into blocks of one size, shard by shard (64 words, or a smaller power of two where that is needed for the
smallest target to be ``LEAST_BLOCKS`` blocks); the blocks of the mix are
apportioned to sources, and those of a source to its shards, always to the highest quotient
share / (2 seats + 1).  In a shard, documents stand in seeded order and the quota takes whole passes
over the blocks, then blocks from the front.  A document on the last border gives its first words.

Shards split any source into windows of bounded size; statistics of sources and shards are the only
tables handled in one task or window.

Edge cases: a null source is a source of its own, last in order; null and empty texts have size zero and take
nothing; repeated rows count each; a null doc_id is allowed; other columns are ignored by ``mix``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlake.llm.common import saved, word_count, words

BLOCK_WORDS = 64
LEAST_BLOCKS = 16
SHARD_WORDS = 4_000_000


def weight_by_order(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, for ranks from 1."""
    return ((rank - 1) % 3 + 1).cast("double")


def source_targets(sizes: DataFrame, max_epochs: int = 3, weight=weight_by_order) -> DataFrame:
    """``(source, source_size, rank, target)`` from per-document ``(source, size)``.

    Sources fill in the order of capacity per weight; a source is full exactly if its capacity is below its
    weight's share of what the sources before it left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = (per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
              .withColumn("weight", weight(F.col("rank"))).withColumn("room", F.col("source_size") * F.lit(max_epochs)))
    filling = Window.orderBy(F.col("room") / F.col("weight"), "rank")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("room").over(before), F.lit(0))
    share = ranked.withColumn("level", left / F.sum("weight").over(after)).withColumn("full", F.col("room") <= F.col("weight") * F.col("level"))
    # all sources that are not full share one level: that of the first of them
    level = F.min(F.when(~F.col("full"), F.struct(F.col("room") / F.col("weight"), "rank", "level"))).over(Window.partitionBy())["level"]
    return share.select("source", "source_size", "rank", F.when(F.col("full"), F.col("room").cast("double"))
                        .otherwise(F.col("weight") * level).alias("target"))


def apportion(parties: DataFrame, group: list[str], share: str, seats: str, order: list[str]) -> DataFrame:
    """Add ``quota``: the ``seats`` of each group go one by one to the highest ``share / (2 quota + 1)``; ties by ``order``.

    With n parties, rounding the shares of n/2 seats less grants only seats that are won, and rounding those of
    n/2 seats more bounds what anyone can win: between them lie about 2 n quotients, which are ranked.
    """
    whole = Window.partitionBy(*group)
    n, total, s = F.count("*").over(whole), F.sum(share).over(whole), F.col(seats)
    sure = F.greatest(s - F.ceil(n / 2), F.lit(0)).cast("double")
    part = F.when(total > 0, F.col(share) / total).otherwise(F.lit(0.0))
    based = (parties.withColumn("_sure", F.round(part * sure).cast("long"))
             .withColumn("_more", F.when(total > 0, F.ceil(part * (s + n / 2) + 1) - F.col("_sure")).otherwise(F.lit(0)).cast("long")))
    based = based.withColumn("_left", s - F.sum("_sure").over(whole))
    asked = based.where("_more > 0 and _left > 0").select(*group, *order, share, "_left", F.explode(F.sequence(F.lit(0).cast("long"), "_more")).alias("_k"), "_sure")
    best = Window.partitionBy(*group).orderBy((F.col(share) / (2 * (F.col("_sure") + F.col("_k")) + 1)).desc(), *order)
    won = (asked.withColumn("_place", F.row_number().over(best)).where("_place <= _left")
           .groupBy(*group, *order).agg(F.count("*").alias("_won")))
    keys = group + order
    pairs = [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    on = pairs[0]
    for p in pairs[1:]:
        on = on & p
    return (based.alias("p").join(won.alias("w"), on, "left")
            .select("p.*", (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota")).drop("_exact", "_sure", "_more", "_left"))


def plan_mix(docs: DataFrame, seed: int = 17, max_epochs: int = 3, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
             row_key: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, passes, extra)`` and ``row_key`` for every row of ``docs``.

    The mix takes the whole document ``passes`` times and then its first ``extra`` words.
    """
    sizes = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), *row_key), "sizes")
    targets = saved(source_targets(sizes, max_epochs), "targets")
    smallest = targets.where("target > 0").agg(F.min("target")).first()[0]
    if smallest is not None:
        block_words = min(block_words, 1 << max(0, int(smallest / LEAST_BLOCKS).bit_length() - 1))
    shards = F.greatest(F.ceil(F.col("source_size") / F.lit(shard_words)), F.lit(1))
    order = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "hash")
    dealt = (sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
             .withColumn("mixed", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "mixed"), shards)))
    per_shard = dealt.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    all_blocks = F.round(F.sum("target").over(Window.partitionBy()) / F.lit(block_words)).cast("long")
    seats = apportion(targets.select("rank", "target").withColumn("seats", all_blocks), [], "target", "seats", ["rank"]).select(
        "rank", F.col("quota").alias("seats"))
    quotas = apportion(per_shard.join(seats, "rank").withColumn("words", F.col("words").cast("double")), ["rank"], "words", "seats", ["shard"])
    held = F.ceil(F.col("words") / F.lit(block_words))
    cut = quotas.select("rank", "shard", "quota", held.cast("long").alias("held")).withColumn(
        "quota", F.least("quota", F.col("held") * F.lit(max_epochs))).select(
        "rank", "shard", F.when(F.col("held") > 0, F.floor(F.col("quota") / F.greatest("held", F.lit(1)))).otherwise(0).alias("passes"),
        F.when(F.col("held") > 0, F.col("quota") % F.greatest("held", F.lit(1)) * F.lit(block_words)).otherwise(0).alias("upto"))
    before = Window.partitionBy("rank", "shard").orderBy("mixed", "doc_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    extra = F.greatest(F.least(F.col("size"), F.col("upto") - F.col("at")), F.lit(0))
    return (placed.join(cut, ["rank", "shard"]).select(*row_key, "doc_id", "source", "size", "source_size", "target",
                                                       F.col("passes").cast("long").alias("passes"), extra.cast("long").alias("extra")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: documents as often as it takes them, the last time perhaps only their first words.

    A cut document has its words joined by single spaces.  All columns of ``docs`` are kept; ``n_chars`` follows the text.
    """
    numbered = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    plan = plan_mix(numbered, row_key=("_row",), **options).select(
        "_row", F.col("passes").alias("_passes"), F.col("extra").alias("_extra"), F.col("size").alias("_size"))
    takes = F.when((F.col("_extra") > 0) & (F.col("_extra") < F.col("_size")), F.col("_passes") + 1).otherwise(
        F.col("_passes") + F.when(F.col("_extra") > 0, 1).otherwise(0))
    rows = (numbered.join(plan, "_row").withColumn("_takes", takes).where("_takes > 0")
            .withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_takes").cast("long")))))
    cut = (F.col("_nth") > F.col("_passes")) & (F.col("_extra") < F.col("_size"))
    text = F.when(cut, F.array_join(F.slice(words(F.col("text")), 1, F.col("_extra").cast("int")), " ")).otherwise(F.col("text"))
    out = rows.withColumn("_text", text)
    return out.select(*[F.col("_text").alias("text") if c == "text" else
                        F.length("_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"))
