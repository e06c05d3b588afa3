"""Claim scores and facet conclusions.

The whole judgement is one stream: outcomes, cap requests, abstention requests
and out-of-scope marks are stacked into *entries*, reduced to at most a few
hundred rows per case by a map-side combinable aggregate (so a case holding a
large share of all rows is reduced before it is shuffled), moved once to their
case, and then folded to claims and facets with no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.functions.dims import literal_rows, lookup, rank_of, rows_text, text

ENTRY_COLUMNS = [
    "case_id", "emit_block", "emit_fact", "emit_step", "rule_id", "kind", "facet", "claim",
    "anchor", "achievement", "tier", "source_group",
]
_RUBRIC_KEYS = [(f"{c}/{a}", w) for c, a, w in V.RUBRIC_ROWS]


def anchor_weight(claim: Column, anchor: Column) -> Column:
    """Rubric weight, null for an anchor the claim's rubric lacks."""
    return lookup(F.concat(claim, F.lit("/"), anchor), _RUBRIC_KEYS)


def tier_rank(tier: Column) -> Column:
    return rank_of(tier, V.TIERS)


def entries(outcomes: DataFrame, caps: DataFrame | None = None, abstentions: DataFrame | None = None,
            scope: DataFrame | None = None) -> DataFrame:
    """Stack everything the rules produced into one table."""
    def shaped(df: DataFrame, **cols: Column) -> DataFrame:
        null = {"emit_block": "int", "emit_fact": "bigint", "emit_step": "int", "rule_id": "string",
                "facet": "string", "claim": "string", "anchor": "string", "achievement": "int",
                "tier": "string", "source_group": "string"}
        return df.select("case_id", *[
            cols[c].alias(c) if c in cols else F.lit(None).cast(null[c]).alias(c)
            for c in ENTRY_COLUMNS if c != "case_id"
        ])

    out = outcomes.select(*ENTRY_COLUMNS)
    if caps is not None:
        out = out.unionByName(shaped(
            caps, kind=F.lit(V.CAP_REQUEST), claim=F.col("claim"), anchor=F.col("cap_id"),
            facet=lookup(F.col("claim"), V.CLAIMS), rule_id=F.col("triggered_by")))
    if abstentions is not None:
        out = out.unionByName(shaped(
            abstentions, kind=F.lit(V.ABSTENTION_REQUEST), facet=F.col("facet"), anchor=F.col("abstention_id")))
    if scope is not None:
        out = out.unionByName(shaped(scope, kind=F.lit(V.OUT_OF_SCOPE), facet=F.col("facet")))
    return out


def _witness() -> Column:
    """Best achievement first, then first emission; the rest only makes ties exact."""
    return F.max(F.struct(
        F.col("achievement"),
        (-F.col("emit_block")).alias("nb"), (-F.col("emit_fact")).alias("nf"), (-F.col("emit_step")).alias("ns"),
        F.col("rule_id"), F.col("source_group"), F.col("tier")))


def best_anchor(outcomes: DataFrame) -> DataFrame:
    """Per case, claim and rubric anchor: the best achievement and what witnessed it."""
    return (
        outcomes
        .where((F.col("kind") == V.SUPPORT) & anchor_weight(F.col("claim"), F.col("anchor")).isNotNull())
        .groupBy("case_id", "claim", "anchor").agg(_witness().alias("w"))
        .select("case_id", "claim", "anchor", F.col("w.achievement").alias("achievement"),
                F.col("w.rule_id").alias("witness_rule"), F.col("w.source_group").alias("witness_group"),
                F.col("w.tier").alias("witness_tier"))
    )


def summarise(stacked: DataFrame) -> DataFrame:
    """Reduce entries to vocabulary-bounded groups per case (one exchange)."""
    return (
        stacked
        .groupBy("case_id", F.coalesce("facet", F.lit("")).alias("facet"),
                 F.coalesce("claim", F.lit("")).alias("claim"),
                 F.coalesce("anchor", F.lit("")).alias("anchor"), "kind")
        .agg(_witness().alias("w"), F.collect_set("rule_id").alias("rules"))
    )


def _as_entries(groups: DataFrame) -> DataFrame:
    """Summaries as entries again, which sum up to the same: one for the witness and one for each rule."""
    def entry(rule: Column, *rest: Column) -> Column:
        names = [("emit_block", "int"), ("emit_fact", "bigint"), ("emit_step", "int"), ("achievement", "int"), ("tier", "string"), ("source_group", "string")]
        return F.struct(rule.alias("rule_id"), *[c.cast(t).alias(n) for c, (n, t) in zip(rest or [F.lit(None)] * len(names), names)])

    w = F.col("w")
    witness = entry(w["rule_id"], -w["nb"], -w["nf"], -w["ns"], w["achievement"], w["tier"], w["source_group"])
    return groups.select("case_id", "facet", "claim", "anchor", "kind",
                         F.inline(F.concat(F.array(witness), F.transform("rules", lambda r: entry(r))))).select(*ENTRY_COLUMNS)


def _frame(cases: DataFrame) -> DataFrame:
    """Twelve marker rows per case: eight claims and four facet-only rows."""
    rows = [(f, c) for c, f in V.CLAIMS] + [(f, "") for f in V.FACETS]
    return cases.select("case_id", F.inline(literal_rows(rows, ["facet", "claim"])))


def div(a: Column, b: Column) -> Column:
    """Integer division truncating toward zero."""
    return F.call_function("div", a, b)


def tenths(weighted: Column, divisor: Column) -> Column:
    """Tenths of a percent, rounded half up in integers and clamped to 0..1000."""
    denominator = divisor.cast("bigint") * 100
    value = div(weighted.cast("bigint") * 1000 + div(denominator, F.lit(2)), denominator)
    return F.greatest(F.lit(0), F.least(F.lit(1000), value)).cast("bigint")


def claim_rows(cases: DataFrame, stacked: DataFrame, placed: DataFrame | None = None, shared: bool = False) -> DataFrame:
    """Twelve rows per case, still on the case's partition: claims, and facet rows (claim '').

    ``placed`` are more entries, few a case, which lie with their case as after ``repartition("case_id")``: they move no further.
    ``shared`` says that others read the same placed entries, so that no filter on the result may reach them.
    """
    supports = F.col("kind") == V.SUPPORT
    weight = anchor_weight(F.col("claim"), F.col("anchor"))
    scored = supports & weight.isNotNull()
    achieved = scored & (F.col("w.achievement") > 0)
    is_cap, is_abs = F.col("kind") == V.CAP_REQUEST, F.col("kind") == V.ABSTENTION_REQUEST
    contradicts = F.col("kind") == V.CONTRADICTION
    method_rules = lookup(F.col("claim"), [(c, [r for k, r in V.METHOD_ANCHORS if k == c]) for c, _ in V.CLAIMS])

    # what is folded is worked out before the rows move: the aggregates behind the exchange, which take every row several times, then read plain columns
    groups = summarise(stacked)
    if placed is not None:
        groups = summarise(placed.select(*ENTRY_COLUMNS).unionByName(_as_entries(groups).repartition("case_id")))
        cases = cases.select("case_id").repartition("case_id")
    worth = groups.unionByName(_frame(cases), allowMissingColumns=True).select(
        "case_id", "facet", "claim",
        F.when(scored, weight * F.col("w.achievement")).alias("points"),
        F.when(achieved, tier_rank(F.col("w.tier"))).alias("rank"),
        F.when(achieved & (F.col("w.source_group") != ""), F.col("w.source_group")).alias("group"),
        F.when(scored, F.struct("anchor", F.struct(
            F.col("w.achievement").alias("achievement"), F.col("w.rule_id").alias("witness_rule"),
            F.col("w.source_group").alias("witness_group"), F.col("w.tier").alias("witness_tier")))).alias("hit"),
        F.when(is_cap, F.struct(
            lookup(F.col("anchor"), V.CAPS).cast("bigint").alias("max_tenths"),
            F.col("anchor").alias("cap_id"), F.array_sort("rules").alias("triggered_by"))).alias("cap"),
        F.when(contradicts, F.col("rules")).alias("against"),
        (supports & F.arrays_overlap("rules", method_rules)).alias("by_method"),
        F.when(is_abs, F.col("anchor")).alias("abstention"),
        (F.col("kind") == V.OUT_OF_SCOPE).alias("outside"), contradicts.alias("contradicts"),
        F.when(F.col("kind").isin(V.OUTCOME_KINDS), F.col("rules")).alias("rules"))
    folded = (worth.repartition("case_id") if placed is None else worth).groupBy("case_id", "facet", "claim").agg(
        F.coalesce(F.sum("points"), F.lit(0)).cast("bigint").alias("weighted"),
        F.max("rank").alias("best_rank"),
        F.array_sort(F.collect_set("group")).alias("source_groups"),
        F.collect_list("hit").alias("hits"),
        F.collect_list("cap").alias("asked_caps"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("against")))).alias("contradicted_by"),
        F.coalesce(F.max("by_method"), F.lit(False)).alias("has_method_anchor"),
        F.collect_set("abstention").alias("asked_abstentions"),
        F.coalesce(F.max("outside"), F.lit(False)).alias("out_of_scope"),
        F.coalesce(F.max("contradicts"), F.lit(False)).alias("contradicted"),
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rule_ids"),
        F.max("facet").alias("_facet"), F.max("claim").alias("_claim"),
    )
    if shared:
        # a filter on these columns stays behind the aggregate, so that all that reads the placed entries shares their one exchange
        folded = folded.drop("facet", "claim").withColumnsRenamed({"_facet": "facet", "_claim": "claim"})
    folded = folded.drop("_facet", "_claim")
    divisor = lookup(F.col("claim"), list(V.DIVISOR.items()))
    single = (F.size("source_groups") <= 1) & (F.col("raw_tenths") > V.CAP_MAX[V.SINGLE_SOURCE_CAP])
    single_cap = F.array(F.struct(
        F.lit(V.CAP_MAX[V.SINGLE_SOURCE_CAP]).cast("bigint").alias("max_tenths"),
        F.lit(V.SINGLE_SOURCE_CAP).alias("cap_id"), F.array(F.lit(V.SINGLE_SOURCE_RULE)).alias("triggered_by")))
    lowest = F.coalesce(F.try_element_at("caps", F.lit(1))["max_tenths"], F.lit(1000).cast("bigint"))
    return (
        folded
        .withColumn("rubric_divisor", divisor)
        .withColumn("raw_tenths", tenths(F.col("weighted"), F.col("rubric_divisor")))
        # each cap has its own maximum, so sorting the structs sorts by maximum
        .withColumn("caps", F.array_sort(F.when(single, F.concat("asked_caps", single_cap)).otherwise(F.col("asked_caps"))))
        .withColumn("score_tenths", F.when(F.size("contradicted_by") > 0, F.lit(0).cast("bigint"))
                    .otherwise(F.least("raw_tenths", lowest)))
        .withColumn("best_tier", F.try_element_at(
            F.expr(text(V.TIERS)), (F.col("best_rank") + 1).cast("int")))
    )


def anchor_array(hits: Column) -> Column:
    """Every rubric anchor of the claim, with zero achievement where nothing was seen."""
    arms = " ".join(f"WHEN '{c}' THEN {rows_text(a, ['anchor', 'weight'])}" for c, a in V.RUBRIC.items())
    rubric = F.expr(f"CASE claim {arms} END")
    seen = F.map_from_entries(hits)
    return F.transform(rubric, lambda a: F.struct(
        a["anchor"].alias("anchor"), a["weight"].alias("weight"),
        F.coalesce(F.try_element_at(seen, a["anchor"])["achievement"], F.lit(0)).alias("achievement"),
        F.try_element_at(seen, a["anchor"])["witness_rule"].alias("witness_rule"),
        F.try_element_at(seen, a["anchor"])["witness_group"].alias("witness_group"),
        F.try_element_at(seen, a["anchor"])["witness_tier"].alias("witness_tier")))


def claim_scores(cases: DataFrame, stacked: DataFrame) -> DataFrame:
    """Eight rows per case, also for a case with no evidence at all."""
    return score_table(claim_rows(cases, stacked))


def score_table(rows: DataFrame) -> DataFrame:
    """The claims among claim rows, with every anchor of their rubric."""
    return (
        rows.where(F.col("claim") != "")
        .select("case_id", "claim", "raw_tenths", "score_tenths", "rubric_divisor",
                anchor_array(F.col("hits")).alias("anchors"),
                "caps", "best_tier", "source_groups", "contradicted_by", "has_method_anchor")
    )


def anchor_matrix(cases: DataFrame, stacked: DataFrame) -> DataFrame:
    """Every claim x rubric anchor of every case."""
    return claim_scores(cases, stacked).select("case_id", "claim", F.inline("anchors"))


def contradicted_claims(outcomes: DataFrame) -> DataFrame:
    """Which rules contradict each claim, and how often."""
    return (
        outcomes.where((F.col("kind") == V.CONTRADICTION) & F.col("claim").isNotNull())
        .groupBy("case_id", "claim", "rule_id").agg(F.count("*").alias("times"))
    )


def outcome_rollup(outcomes: DataFrame) -> DataFrame:
    """Per case and outcome kind: the distinct rule ids, sorted."""
    return outcomes.groupBy("case_id", "kind").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def _exclusive(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("/"), b).isin(*[f"{x}/{y}" for x, y in V.EXCLUSIVE_PAIRS])


def band_from_score(score: Column) -> Column:
    band = None
    for floor, name in V.BAND_FLOORS:
        band = F.when(score >= floor, name) if band is None else band.when(score >= floor, name)
    return band.otherwise(V.BAND_INSUFFICIENT)


def conclude(rows: DataFrame) -> DataFrame:
    """Fold the claim rows of a case to its four facets, keeping each gate clause."""
    is_claim = F.col("claim") != ""
    # ascending sort puts the best score first and breaks ties by claim name
    ranked = F.array_sort(F.collect_list(F.when(is_claim, F.struct(
        (-F.col("score_tenths")).alias("neg"), "claim", "score_tenths", "raw_tenths", "best_tier", "best_rank",
        "rubric_divisor", "has_method_anchor", F.col("contradicted").alias("claim_contradicted")))))
    facets = rows.groupBy("case_id", "facet").agg(
        ranked.alias("candidates"),
        F.array_distinct(F.flatten(F.collect_list("asked_abstentions"))).alias("asked"),
        F.max("out_of_scope").alias("out_of_scope"),
        F.max("contradicted").alias("facet_contradicted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("rule_ids")))).alias("rule_ids"),
    ).where(F.col("facet") != "")
    best = F.element_at("candidates", 1)
    score, rank = F.col("best.score_tenths"), F.coalesce(F.col("best.best_rank"), F.lit(0))
    min_rank = V.TIERS.index(V.GATE_MIN_TIER)
    has_exclusive = F.col("claim").isin(*V.EXCLUSIVE_CLAIMS)
    too_close = (score > 0) & (F.col("separation") < V.GATE_MIN_SEPARATION) & has_exclusive & (F.col("rival_tenths") > 0)
    mutable = (score >= V.GATE_MIN_TENTHS) & (rank < min_rank)

    def opt(cond: Column, name: str) -> Column:
        return F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    contradicted = F.col("facet_contradicted") | F.col("best.claim_contradicted")
    by_score = band_from_score(score)
    return (
        facets
        .withColumn("best", best).withColumn("claim", F.col("best.claim"))
        .withColumn("rest", F.slice("candidates", 2, 8))
        .withColumn("rival_tenths", F.coalesce(F.array_max(F.transform(
            F.filter("rest", lambda c: _exclusive(F.col("claim"), c["claim"])), lambda c: c["score_tenths"])),
            F.lit(0).cast("bigint")))
        .withColumn("separation", score - F.col("rival_tenths"))
        .withColumn("abstentions", F.array_sort(F.array_distinct(F.concat(
            "asked", opt(too_close, "ABS-HYBRID-TOO-CLOSE"), opt(mutable, "ABS-EVIDENCE-MUTABLE")))))
        .withColumn("gate_score", score >= V.GATE_MIN_TENTHS)
        .withColumn("gate_method", F.col("best.has_method_anchor"))
        .withColumn("gate_tier", F.coalesce(F.col("best.best_rank") >= min_rank, F.lit(False)))
        .withColumn("gate_uncontradicted", ~contradicted)
        .withColumn("gate_separation", F.col("separation") >= V.GATE_MIN_SEPARATION)
        .withColumn("gate_passes", F.col("gate_score") & F.col("gate_method") & F.col("gate_tier")
                    & F.col("gate_uncontradicted") & F.col("gate_separation"))
        .withColumn("band", F.when(F.col("out_of_scope"), V.BAND_NOT_SUPPLIED)
                    .when(contradicted, V.BAND_CONTRADICTED)
                    .when(F.size("abstentions") > 0, V.BAND_INSUFFICIENT)
                    .when((score >= 700) & ~F.col("gate_passes"), V.BAND_PARTIAL)
                    .otherwise(by_score))
        .withColumn("method_label_emitted", F.col("gate_passes") & (F.col("band") != V.BAND_NOT_SUPPLIED))
    )


def conclusions(cases: DataFrame, stacked: DataFrame) -> DataFrame:
    """One row per case and facet: the screen's result table."""
    return conclusion_table(claim_rows(cases, stacked))


def conclusion_table(rows: DataFrame) -> DataFrame:
    """The conclusions that claim rows lead to."""
    return conclude(rows).select(
        "case_id", "facet", "claim", "band", F.col("best.score_tenths").alias("score_tenths"),
        F.col("best.rubric_divisor").alias("rubric_divisor"), "abstentions",
        F.col("best.best_tier").alias("best_tier"), "method_label_emitted",
        F.transform("rest", lambda c: F.struct(c["claim"].alias("claim"), c["score_tenths"].alias("score_tenths"))).alias("alternatives"),
        "rule_ids", "rival_tenths", "separation", "gate_score", "gate_method", "gate_tier",
        "gate_uncontradicted", "gate_separation", "gate_passes",
    )
