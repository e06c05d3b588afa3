"""Checking delivered reports: integrity, recomputation, challenges, expectations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.functions.dims import lookup, rank_of
from provlake.functions.digest import placed_digest, row_text, tree_digest
from provlake.operators.privacy import forbidden_language
from provlake.operators.skew import apart, crowded

ENVELOPE_NAME = "integrity_envelope.json"
CANARY_DIGITS = 6
REJECT_AT = 250  # bytes from here on would bias the digits


# --- integrity -----------------------------------------------------------------
def envelope_check(envelope: DataFrame, payloads: DataFrame) -> DataFrame:
    """Declared against present payloads (case_id, name, sha256): one row per difference."""
    d = envelope.select("case_id", "name", F.col("sha256").alias("declared"))
    p = payloads.where(F.col("name") != ENVELOPE_NAME).select("case_id", "name", F.col("sha256").alias("present"))
    return (d.join(p, ["case_id", "name"], "full")
            .withColumn("issue", F.when(F.col("present").isNull(), "missing").when(F.col("declared").isNull(), "unexpected")
                        .when(F.col("declared") != F.col("present"), "altered"))
            .where("issue IS NOT NULL").select("case_id", "name", "issue"))


def root_digest(payloads: DataFrame) -> DataFrame:
    """One digest over the names and digests of a case's payloads."""
    rows = payloads.where(F.col("name") != ENVELOPE_NAME)
    return tree_digest(rows, "case_id", F.concat_ws(":", "name", "sha256"), "root_digest")


def integrity_status(cases: DataFrame, envelope: DataFrame, payloads: DataFrame, roots: DataFrame,
                     unreadable: DataFrame | None = None, actual: DataFrame | None = None) -> DataFrame:
    """``roots``: (case_id, declared_root), a row for each case with an envelope; ``actual``: the root digests of the payloads, if known."""
    issues = envelope_check(envelope, payloads).groupBy("case_id").agg(
        F.count(F.when(F.col("issue") == "missing", 1)).alias("missing"),
        F.count(F.when(F.col("issue") != "missing", 1)).alias("changed"))
    actual = root_digest(payloads) if actual is None else actual
    bad = (unreadable if unreadable is not None else cases.limit(0)).select("case_id", F.lit(True).alias("unreadable")).distinct()
    return (cases.select("case_id").join(roots, "case_id", "left").join(issues, "case_id", "left")
            .join(actual, "case_id", "left").join(bad, "case_id", "left")
            .select("case_id", F.when(F.col("unreadable"), "unreadable").when(F.col("declared_root").isNull(), "incomplete")
                    .when(F.col("missing") > 0, "incomplete")
                    .when((F.col("changed") > 0) | ~F.col("declared_root").eqNullSafe(F.col("root_digest")), "modified")
                    .otherwise("intact").alias("integrity_status")))


# --- recomputation ----------------------------------------------------------------
COMPARED = ["claim", "abstentions", "method_label_emitted", "rule_ids"]


def recompute_diff(stated: DataFrame, recomputed: DataFrame, version: int = V.RULESET_VERSION) -> DataFrame:
    """Stated conclusions against a re-evaluation, per facet.

    ``stated`` carries ``ruleset_version``; another version is not comparable.
    """
    s = stated.select("case_id", "facet", "ruleset_version", F.struct("band", "score_tenths", *COMPARED).alias("s"))
    r = recomputed.select("case_id", "facet", F.struct("band", F.col("score_tenths").cast("bigint").alias("score_tenths"), *COMPARED).alias("r"))
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
    moved = ~(F.col("s.band").eqNullSafe(F.col("r.band")) & F.col("s.score_tenths").eqNullSafe(F.col("r.score_tenths")))
    return (s.join(r, ["case_id", "facet"], "full").select(
        "case_id", "facet",
        F.when(F.col("s").isNull() | ~F.col("ruleset_version").eqNullSafe(F.lit(version)), "not_possible")
        .when(moved, "diverges").when(~same, "diverges_elsewhere").otherwise("matches").alias("status"),
        F.col("s.band").alias("stated_band"), F.col("r.band").alias("recomputed_band"),
        F.col("s.score_tenths").alias("stated_tenths"), F.col("r.score_tenths").alias("recomputed_tenths")))


def recomputation(diff: DataFrame) -> DataFrame:
    """One verdict per case over its facets."""
    bad = F.col("status")
    return diff.groupBy("case_id").agg(
        F.when(F.max(bad == "not_possible"), "not_possible").when(F.max(bad != "matches"), "diverges")
        .otherwise("matches").alias("recomputation"))


def challenge_status(cases: DataFrame, challenges: DataFrame, now: Column) -> DataFrame:
    """Binding to a buyer's question.

    ``challenges``: (case_id, parsed, names_case, expires_at, signature, has_key, signature_valid);
    whether a signature is valid is decided elsewhere and given as a column.
    """
    c = challenges.withColumn("present", F.lit(True))
    return (cases.select("case_id").join(c, "case_id", "left").select(
        "case_id", F.when(F.col("present").isNull(), "absent").when(~F.col("parsed"), "signature_invalid")
        .when(F.col("names_case") != F.col("case_id"), "case_mismatch").when(now > F.col("expires_at"), "expired")
        .when(F.col("signature").isNull(), "unsigned")
        .when(F.col("has_key") & F.col("signature_valid"), "bound").otherwise("signature_invalid").alias("challenge_status")))


def weakest_band(conclusions: DataFrame) -> DataFrame:
    """The headline of a case is its weakest facet."""
    strength = rank_of(F.col("band"), V.BAND_STRENGTH)
    return (conclusions.groupBy("case_id").agg(F.min(strength).alias("k"))
            .select("case_id", F.get(F.array(*[F.lit(b) for b in V.BAND_STRENGTH]), F.col("k")).alias("evidence_status")))


def verification_axes(cases: DataFrame, integrity: DataFrame, challenge: DataFrame, coverage: DataFrame,
                      evidence: DataFrame, recomputed: DataFrame) -> DataFrame:
    """The axes side by side, never merged to one verdict."""
    axes = cases.select("case_id")
    for df in (integrity, challenge, coverage, evidence, recomputed):
        axes = axes.join(df, "case_id", "left")
    axes = axes.fillna({"coverage_status": "minimal", "evidence_status": V.BAND_INSUFFICIENT, "recomputation": "not_possible"})
    sound = (F.col("integrity_status") == "intact") & (F.col("recomputation") == "matches")
    bound = F.col("challenge_status") == "bound"
    return axes.withColumns({"is_sound": sound, "is_bound": bound, "all_clear": sound & bound})


# --- canary digits -------------------------------------------------------------------
def canary_digits(digest_hex: Column, case_text: Column, nonce: Column, n: int = CANARY_DIGITS) -> Column:
    """``n`` (at most 32) digits bound to a case: bytes below 250 of the seed and its first expansion, modulo ten."""
    seed = F.sha2(F.concat(F.unhex(digest_hex), F.encode(case_text, "UTF-8"), F.encode(nonce, "UTF-8")), 256)

    def usable(s: Column) -> Column:
        more = F.sha2(F.concat(F.encode(F.lit("CL-CANARY-BLOCK"), "UTF-8"), F.unhex(s), F.unhex(F.lit("00000001"))), 256)
        # pairs of hex digits sort like the bytes they are written for
        return F.filter(F.regexp_extract_all(F.concat(s, more), F.lit(".."), F.lit(0)), lambda h: h < F.lit(f"{REJECT_AT:02x}"))

    # both digests are taken once per case, outside of what runs per byte
    picked = F.slice(F.get(F.transform(F.array(seed), usable), F.lit(0)), 1, n)
    return F.transform(picked, lambda h: F.conv(h, 16, 10).cast("int") % 10)


def render_with_canary(tenths: Column, digit: Column) -> Column:
    """``743`` and digit ``2`` read ``74.32``."""
    size = F.abs(tenths)
    return F.concat(F.when(tenths < 0, "-").otherwise(""), F.call_function("div", size, F.lit(10)).cast("string"), F.lit("."),
                    (size % 10).cast("string"), digit.cast("string"))


def strip_canary(shown: Column) -> Column:
    """The tenths of a rendered value; null for anything not rendered here."""
    ok = shown.rlike("^-?(0|[1-9][0-9]*)[.][0-9][0-9]$") & ~shown.rlike("^-0[.]0[0-9]$")
    return F.when(ok, F.replace(F.left(shown, F.length(shown) - 1), F.lit("."), F.lit("")).try_cast("bigint"))


def canary_check(rendered: DataFrame, expected: DataFrame) -> DataFrame:
    """``rendered``: (case_id, position, shown), positions 1 to 32; ``expected``: (case_id, digits).

    No digits, or a malformed value, is never a match.
    """
    digit = F.when(strip_canary(F.col("shown")).isNotNull(), F.right("shown", F.lit(1)).cast("int"))
    seen = rendered.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", digit.alias("d")))), lambda s: s["d"]).alias("seen"),
        F.min(digit.isNotNull()).alias("well_formed"))
    return (expected.join(seen, "case_id", "left")
            .select("case_id", F.coalesce(F.col("well_formed") & (F.size("seen") > 0) & (F.col("seen") == F.col("digits")), F.lit(False)).alias("canary_ok")))


# --- digests and documents ---------------------------------------------------------------
MANIFEST_PARTS = ["artifact_id", "path_alias", "artifact_type", "size_bytes", "sha256", "hash_scope", "read_status", "mtime"]


def manifest_digest(artifacts: DataFrame) -> DataFrame:
    """Digest of a case's artifacts; absent columns and null values are left out."""
    parts = {c: F.col(c) for c in MANIFEST_PARTS if c in artifacts.columns}
    return tree_digest(artifacts, "case_id", row_text(**parts), "manifest_digest")


def evidence_text(df: DataFrame) -> Column:
    """A row as text: every column but the case, by name."""
    return row_text(**{c: (F.to_json(F.struct(c)) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c))
                       for c in df.columns if c != "case_id"})


def evidence_digest(cases: DataFrame, tables: dict[str, DataFrame], placed: dict[str, DataFrame] | None = None,
                    spread: dict[str, DataFrame] | None = None, few: dict[str, DataFrame] | None = None) -> DataFrame:
    """Digest over the digests of a case's tables, each with all of its columns; none of them holds a clock.

    Every table is reduced by its own tree: rows move once, to their case, and those of crowded cases to their branches; then one row
    per case and table moves.  Rows of ``placed`` tables lie with their case already, and ``spread`` has the rows of other cases of such
    tables; ``few`` are tables of a handful of rows a case, as conclusions are, which are gathered by case.
    """
    near, far = [], []

    def whole(name: str, df: DataFrame) -> None:
        far.append(tree_digest(df, "case_id", F.col("_t"), "d").select("case_id", F.lit(name).alias("part"), "d"))

    for name, df in (placed or {}).items():
        near.append(df.select("case_id", F.lit(name).alias("part"), evidence_text(df).alias("_t")))
    for name, df in (spread or {}).items():
        whole(name, df.select("case_id", evidence_text(df).alias("_t")))
    for name, df in (few or {}).items():
        texts = df.select("case_id", evidence_text(df).alias("_t")).groupBy("case_id").agg(F.collect_list("_t").alias("_t"))
        near.append(texts.select("case_id", F.lit(name).alias("part"), F.explode("_t").alias("_t")))
    for name, df in tables.items():
        small, large = apart(df.select("case_id", evidence_text(df).alias("_t")), "case_id", crowded(df, "case_id"))
        near.append(small.repartition("case_id").select("case_id", F.lit(name).alias("part"), "_t"))
        whole(name, large)
    parts = placed_digest(functools.reduce(DataFrame.unionByName, near), ["case_id", "part"], F.col("_t"), "d")
    for df in far:
        parts = parts.unionByName(df)
    folded = parts.groupBy("case_id").agg(F.collect_list(F.struct("part", F.unhex("d").alias("d"))).alias("parts"))
    lines = F.array_sort(F.transform("parts", lambda p: F.concat(p["part"], F.lit("="), F.lower(F.hex(p["d"])))))
    return (cases.select("case_id").join(folded, "case_id", "left")
            .select("case_id", F.sha2(F.coalesce(F.array_join(lines, "\n"), F.lit("")), 256).alias("evidence_digest")))


STATEMENT = ("This report describes what was observed in vendor-supplied files, within the scope the vendor selected. "
             "It draws no conclusion about intent.")


def report_document(cases: DataFrame, outcomes: DataFrame, conclusions: DataFrame, coverage: DataFrame, ledger: DataFrame,
                    digests: DataFrame) -> DataFrame:
    """One JSON document per case.  What can be long (facts, artifacts) enters by digest; lists are of rule ids."""
    from provlake.operators.scoring import outcome_rollup

    ids = outcome_rollup(outcomes).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "rule_ids"))).alias("ids"))
    concl = conclusions.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(
        "facet", "band", "claim", "score_tenths", "abstentions", "method_label_emitted"))).alias("conclusions"))
    led = ledger.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "kind", "redactions"))).alias("ledger"))
    of = lambda k: F.coalesce(F.try_element_at("ids", F.lit(k)), F.array().cast("array<string>"))
    doc = F.struct(
        of(V.AMBIGUITY).alias("ambiguities"), F.col("conclusions"), of(V.CONTRADICTION).alias("contradictions"),
        F.col("coverage_status"), F.col("evidence_digest"), of(V.LIMITATION).alias("limitations"),
        of(V.REQUEST).alias("next_evidence_requests"), F.coalesce("ledger", F.array().cast("array<struct<rule_id:string,kind:string,redactions:bigint>>")).alias("redaction_ledger"),
        F.lit(V.RULESET_VERSION).alias("ruleset_version"), F.lit(STATEMENT).alias("statement"))
    return (cases.select("case_id").join(ids, "case_id", "left").join(concl, "case_id", "left").join(led, "case_id", "left")
            .join(coverage, "case_id", "left").join(digests, "case_id", "left").select("case_id", F.to_json(doc).alias("document")))


def _same_file(artifacts: DataFrame) -> tuple[DataFrame, list[str]]:
    """Hashed artifacts with a path of their own, and the columns within which digests should agree."""
    named = artifacts.where(F.col("sha256").isNotNull() & F.col("path_alias").isNotNull() & (F.col("path_alias") != V.OUT_OF_SCOPE_PATH))
    # the digest of a whole file and that of its head differ without a conflict
    return named, ["case_id", "path_alias", *[c for c in ("hash_scope",) if c in artifacts.columns]]


def hash_conflict(artifacts: DataFrame) -> DataFrame:
    """Paths seen with more than one digest across submissions, and the abstention they ask for."""
    named, same = _same_file(artifacts)
    return (named.groupBy(*same).agg(F.count_distinct("sha256").alias("digests")).where("digests > 1")
            .groupBy("case_id", "path_alias").agg(F.max("digests").alias("digests"))
            .withColumn("abstention_id", F.lit("ABS-HASH-CONFLICT")))


def conflict_abstentions(artifacts: DataFrame, facets: list[str] = V.FACETS) -> DataFrame:
    """``(case_id, facet, abstention_id)`` for every case with a hash conflict: which file is meant is open, so no facet can rest on it.

    Two digests are enough to know, so the least and the greatest are compared, which combines on the map side.  Null paths,
    null digests and files outside the roots, which share one alias, say nothing; repeated rows change nothing.
    """
    named, same = _same_file(artifacts)
    return (named.groupBy(*same).agg(F.min("sha256").alias("least"), F.max("sha256").alias("most")).where("least <> most")
            .select("case_id").distinct()
            .select("case_id", F.explode(F.array(*[F.lit(f) for f in facets])).alias("facet"), F.lit("ABS-HASH-CONFLICT").alias("abstention_id")))


# --- fleet and corpus -------------------------------------------------------------------
def fleet_summary(conclusions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Counts of cases by facet, band and coverage, with subtotals."""
    rows = conclusions.select("case_id", "facet", "band").join(coverage, "case_id", "left")
    return rows.rollup("facet", "band", "coverage_status").agg(F.count("*").alias("cases"), F.grouping_id().alias("level"))


def corpus_violations(conclusions: DataFrame, outcomes: DataFrame, bands: DataFrame, must_not_name: DataFrame,
                      required: DataFrame, quiet: DataFrame) -> DataFrame:
    """Expectations that do not hold; empty when all do.

    ``bands`` (case_id, facet, band); ``must_not_name`` (case_id, facet);
    ``required`` (case_id, facet, abstention_id); ``quiet`` (case_id) expects no contradiction.
    """
    c = conclusions.select("case_id", "facet", F.col("band").alias("got"), "method_label_emitted", "abstentions")

    def asked(df: DataFrame, check: str, wanted: Column) -> DataFrame:
        return df.select("case_id", "facet", F.lit(check).alias("violation"), wanted.cast("string").alias("wanted"))

    # all three meet the conclusions in one join, so that these are worked out once
    every = (asked(bands, "band", F.col("band")).unionByName(asked(must_not_name, "named", F.lit(None)))
             .unionByName(asked(required, "abstention", F.col("abstention_id"))))
    broken = (F.when(F.col("violation") == "band", ~F.col("got").eqNullSafe(F.col("wanted")))
              .when(F.col("violation") == "named", F.col("method_label_emitted"))
              .otherwise(~F.coalesce(F.array_contains("abstentions", F.col("wanted")), F.lit(False))))
    missed = every.join(c, ["case_id", "facet"], "left").where(broken).select("case_id", "facet", "violation")
    loud = (quiet.join(outcomes.where(F.col("kind") == V.CONTRADICTION).select("case_id").distinct(), "case_id", "left_semi")
            .withColumn("facet", F.lit(None).cast("string")))
    return missed.unionByName(loud.select("case_id", "facet", F.lit("contradiction").alias("violation")))


def catalogue_coverage(outcomes: DataFrame) -> DataFrame:
    """Rules emitted but not catalogued, and catalogued but not emitted."""
    seen = outcomes.where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("times"))
    spark = outcomes.sparkSession
    # the catalogue is a fixed list of rule ids
    known = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in V.CATALOGUE])).alias("rule_id")).withColumn("listed", F.lit(True))
    return (seen.join(F.broadcast(known), "rule_id", "left").where("listed IS NULL")
            .select("rule_id", F.lit("not_catalogued").alias("finding"), "times")
            .unionByName(known.join(seen, "rule_id", "left_anti").select("rule_id", F.lit("not_emitted").alias("finding"), F.lit(0).cast("bigint").alias("times"))))


def reproducibility(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cases whose digest differs between two runs; must be empty."""
    a, b = first.select("case_id", F.col("evidence_digest").alias("a")), second.select("case_id", F.col("evidence_digest").alias("b"))
    return a.join(b, "case_id", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def language_guard(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Authored texts that use a forbidden word; ``columns`` hold authored text only, never quotes."""
    texts = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("text")) for c in columns])))
    return texts.withColumn("word", forbidden_language(F.col("text"))).where("word IS NOT NULL")


def catalogue_text(rule_id: Column) -> Column:
    """Short authored description of a rule's family and number."""
    family = F.regexp_extract(rule_id, "^CL-([A-Z]+)-", 1)
    return F.concat_ws(" ", lookup(family, list(FAMILY_TEXT.items()), F.lit("General rule")), F.lit("number"), F.regexp_extract(rule_id, "([0-9]+)$", 1))


FAMILY_TEXT = {
    "INV": "Scope of the supplied files, rule", "FMT": "Readability of a file format, rule", "BASE": "Identity of the base model, rule",
    "LORA": "Adapter evidence, rule", "MERGE": "Merged adapter evidence, rule", "DENSE": "Dense training evidence, rule",
    "CPT": "Continued pretraining evidence, rule", "DIST": "Distillation evidence, rule", "SCRATCH": "Initialisation evidence, rule",
    "RAG": "Retrieval evidence, rule", "API": "External endpoint evidence, rule", "COMPUTE": "Compute plausibility, rule",
    "CHRONO": "Order of records in time, rule", "PARAM": "Parameter count, rule", "BIND": "Binding to a deployment, rule",
    "PRIV": "Privacy of the report, rule", "XFACET": "Agreement between facets, rule", "XSOURCE": "Independence of sources, rule",
}
BAND_TEXT = {
    V.BAND_CORROBORATED: "Supported by several independent records in the supplied files", V.BAND_STRONG: "The records agree well",
    V.BAND_WEAK: "The records agree in part", V.BAND_PARTIAL: "Well scored, but the method is not named",
    V.BAND_INSUFFICIENT: "Not enough to say; no conclusion is drawn", V.BAND_CONTRADICTED: "Supplied records disagree with each other",
    V.BAND_NOT_SUPPLIED: "The needed files were not supplied",
}
CLAIM_TEXT = {
    "unmerged_lora": "a separate adapter", "merged_adapter": "an adapter merged into the weights", "dense_finetune": "dense fine-tuning",
    "continued_pretraining": "continued pretraining", "distillation": "distillation", "rag": "retrieval", "external_api": "an external endpoint",
    "scratch": "training from random initialisation",
}


def conclusion_text(conclusions: DataFrame) -> DataFrame:
    """Wording of a conclusion from fixed phrases."""
    return conclusions.withColumn("text", F.concat(
        lookup(F.col("band"), list(BAND_TEXT.items())), F.lit(" ("), lookup(F.col("claim"), list(CLAIM_TEXT.items())), F.lit(").")))
