"""Redaction, its ledger, and the checks on authored language.  Everything stays JVM-side."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.functions import patterns as P

# kind -> (rule, ledger name)
LEDGER = {
    "private_key": ("CL-PRIV-001", "credential"), "path": ("CL-PRIV-003", "absolute_path"),
    "email": ("CL-PRIV-001", "email_address"), "jwt": ("CL-PRIV-001", "credential"),
    "token": ("CL-PRIV-001", "credential"),
}
NAME_SALTS = 16  # parts over which the texts that hold one word of a case are spread
NAME_BUCKETS = 1 << 20  # of the tokens of all names


def private_pattern(text: Column) -> Column:
    """The alternation of the kinds that the text may hold; null when plain substring tests rule out all of them."""
    def held(needles):
        tests = [F.contains(text, F.lit(n)) for n in needles]
        return reduce(lambda a, b: a | b, tests)

    return F.nullif(F.concat_ws("|", *[F.when(held(needles), F.lit(pattern)) for pattern, needles in P.KINDS]), F.lit(""))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_pattern(text: Column, body) -> Column:
    """``body`` of the text's pattern, which is computed once."""
    return _once(private_pattern(text), body)


def matches(text: Column) -> Column:
    """Every private span of a text, leftmost first, without overlaps."""
    return _with_pattern(text, lambda p: F.when(p.isNotNull(), F.regexp_extract_all(text, p, F.lit(0))).otherwise(F.array().cast("array<string>")))


def span_kind(span: Column) -> Column:
    return (F.when(span.startswith("-----BEGIN"), "private_key")
            .when(span.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\)"), "path")
            .when(F.contains(span, F.lit("@")), "email").when(span.startswith("eyJ"), "jwt").otherwise("token"))


def _replacement(span: Column) -> Column:
    kind = span_kind(span)
    out = (F.when(kind == "private_key", "[REDACTED:private-key-block]").when(kind == "path", V.OUT_OF_SCOPE_PATH)
           .when(kind == "email", "[REDACTED:email]").when(kind == "jwt", "[REDACTED:jwt]"))
    for label in dict.fromkeys(lab for _, _, lab in V.TOKEN_SHAPES):
        prefixes = "|".join(p for p, _, lab in V.TOKEN_SHAPES if lab == label)
        out = out.when(span.rlike(f"^(?:{prefixes})"), f"[REDACTED:{label}]")
    return out


def _alias_users(piece: Column, names_pattern: Column | None) -> Column:
    return piece if names_pattern is None else F.coalesce(F.regexp_replace(piece, names_pattern, F.lit("[USER]")), piece)


def scrub_text(text: Column, names_pattern: Column | None = None) -> Column:
    """Replace every private span; user names are aliased in what is left between them."""
    def clean(pattern):
        found, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
        put = F.zip_with(F.concat(F.array(F.lit("")), F.transform(found, _replacement)), pieces, lambda r, p: F.concat(r, _alias_users(p, names_pattern)))
        return F.when(pattern.isNotNull(), F.array_join(put, "")).otherwise(_alias_users(text, names_pattern))

    return _with_pattern(text, clean)


def ledger_name(kind: Column) -> Column:
    """The name under which the ledger counts a kind of span."""
    name = F.lit(None)
    for k, (_, n) in LEDGER.items():
        name = F.coalesce(name, F.when(kind == k, n))
    return name


def redaction_ledger(texts: DataFrame) -> DataFrame:
    """``texts``: (case_id, text) -> counts per rule and kind; combines on the map side."""
    kinds = texts.select("case_id", F.explode(F.transform(matches(F.col("text")), span_kind)).alias("k"))
    rule, name = F.lit(None), F.lit(None)
    for k, (r, n) in LEDGER.items():
        rule = F.coalesce(rule, F.when(F.col("k") == k, r))
        name = F.coalesce(name, F.when(F.col("k") == k, n))
    return (kinds.select("case_id", rule.alias("rule_id"), name.alias("kind"))
            .groupBy("case_id", "rule_id", "kind").agg(F.count("*").alias("redactions")))


def full_ledger(texts: DataFrame, fields: DataFrame | None = None, exclusions: DataFrame | None = None,
                users: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """All ledger kinds.  ``fields`` (case_id, key, value); the others one row per event (case_id)."""
    parts = [redaction_ledger(texts)]

    def counted(df: DataFrame, rule: str, kind: str) -> DataFrame:
        return (df.groupBy("case_id").agg(F.count("*").alias("redactions"))
                .select("case_id", F.lit(rule).alias("rule_id"), F.lit(kind).alias("kind"), "redactions"))

    if fields is not None:
        parts.append(counted(fields.where(is_sensitive_key(F.col("key")) & (F.col("value") != "")), "CL-PRIV-001", "sensitive_key_value"))
    if exclusions is not None:
        parts.append(counted(exclusions, "CL-PRIV-004", "submitter_exclusion"))
    if users is not None:
        parts.append(counted(users, "CL-PRIV-002", "windows_username"))
    if hidden is not None:
        parts.append(counted(hidden, "CL-PRIV-005", "submitter_display_redaction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def token_hits(texts: DataFrame, key: str) -> DataFrame:
    """Hits of each token shape on its own; the plain substring test comes before the pattern."""
    shapes = F.array(*[
        F.struct(F.lit(p).alias("shape"), F.when(F.contains("text", F.lit(p)), F.regexp_count("text", F.lit(P.token(p, t)))).alias("hits"))
        for p, t, _ in V.TOKEN_SHAPES])
    return texts.select(key, F.inline(shapes)).where("hits > 0")


def is_sensitive_key(key: Column) -> Column:
    return F.lower(key).rlike(P.SENSITIVE_KEY)


def scrub_field(key: Column, value: Column) -> Column:
    """A value under a credential-like key is dropped whole; any other text is scrubbed."""
    return F.when(is_sensitive_key(key) & (value != ""), V.REDACTED_BY_KEY).otherwise(scrub_text(value))


def field_scrub(facts: DataFrame) -> DataFrame:
    """Scrub the text fields of a fact; path and URL fields never lose their whole value."""
    def clean(k: Column, v: Column) -> Column:
        by_name = F.when(k.rlike("(_path|_url)$"), scrub_text(v["s"])).otherwise(scrub_field(k, v["s"]))
        return F.when(v["s"].isNotNull(), v.withField("s", by_name)).otherwise(v)
    return facts.withColumn("fields", F.transform_values("fields", clean))


def email_hits(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.explode(F.regexp_extract_all("text", F.lit(P.EMAIL), F.lit(0))).alias("email"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def learned_users(paths: DataFrame) -> DataFrame:
    """``paths``: (case_id, path) -> account names under every ``Users/`` or ``home/``, three letters or more."""
    names = F.regexp_extract_all("path", F.lit(r"(?i)(?:^|[\\/])(?:users|home)(?=[\\/]+([^\\/]+))"), F.lit(1))
    return (paths.select("case_id", F.explode(names).alias("name")).select("case_id", ascii_lower(F.trim("name")).alias("name"))
            .where(F.length("name") >= 3).distinct())


def _tokens(lowered: Column) -> Column:
    """Runs of word characters, and every other visible character alone.  A name stands in a text as a whole only if all its tokens do."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"[a-z0-9_]++|[^a-z0-9_\s]"), F.lit(0)))


def name_tokens(users: DataFrame) -> DataFrame:
    """``(case_id, name, token)``: the token of each name that the fewest names of its case share, so that it finds few others."""
    held = users.select("case_id", "name", F.explode(_tokens(F.col("name"))).alias("token"))
    shared = held.groupBy("case_id", "token").agg(F.count("*").alias("n"))
    return (held.join(shared, ["case_id", "token"]).groupBy("case_id", "name")
            .agg(F.min(F.struct("n", (-F.length("token")).alias("longest"), "token"))["token"].alias("token")))


def names_in_texts(texts: DataFrame, users: DataFrame) -> DataFrame:
    """``(case_id, text_key, names)``: the names that may stand in a text of their case, found by an equi-join on one token of each name.

    Tokens and texts move as hashes: two that share one only add names, and a text is searched for those that it holds.  A token goes on only
    if its bucket has a token of some name; there are ``NAME_BUCKETS`` of them however many names there are.  Neither the names of a case
    nor its texts meet in one task: the tokens of texts are spread over ``NAME_SALTS`` parts per token.  Equal texts of a case share one row.
    """
    token = F.xxhash64("case_id", "token").alias("token")
    wanted = name_tokens(users).select("case_id", "name", token)
    bucket = F.pmod("token", F.lit(NAME_BUCKETS)).alias("bucket")
    read = texts.select("case_id", text_key(F.col("text")).alias("text_key"), F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(NAME_SALTS)).cast("int").alias("_salt"),
                        _tokens(ascii_lower(F.col("text"))).alias("tokens"))
    held = read.select("case_id", "text_key", "_salt", F.explode("tokens").alias("token")).select("text_key", "_salt", token)
    likely = held.withColumn("bucket", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    salted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(NAME_SALTS - 1))))
    return likely.join(salted, ["token", "_salt"]).groupBy("case_id", "text_key").agg(F.collect_set("name").alias("names"))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def names_pattern(names: Column, text: Column) -> Column:
    """One pattern of those names that the text holds, longest first; null when there is none."""
    def quoted(name):  # a name may itself hold the end of a quotation
        return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))

    held = _once(ascii_lower(text), lambda low: F.filter(names, lambda n: F.contains(low, n)))
    ordered = F.array_sort(F.transform(held, lambda n: F.struct((-F.length(n)).alias("longest"), n.alias("name"))))
    return _once(F.array_join(F.transform(ordered, lambda s: quoted(s["name"])), "|"), lambda any_name: F.when(
        any_name != "", F.concat(F.lit("(?i)(?<![A-Za-z0-9_])(?:"), any_name, F.lit(")(?![A-Za-z0-9_])"))))


def username_alias(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """Scrub ``texts`` (case_id, .., text) with the user names learned from the case's paths; columns other than ``text`` stay as they are.

    Names match as whole tokens whatever their case (A-Z), the longest first; a text is searched for the names it holds only, so a case
    may have any number of names.  A null text stays null, a null case_id has no names, repeated rows stay.
    """
    key, names = "_text_key", "_names"
    while {key, names} & set(texts.columns):  # columns of the caller are never touched
        key, names = "_" + key, "_" + names
    found = names_in_texts(texts, learned_users(paths)).select("case_id", F.col("text_key").alias(key), F.col("names").alias(names))
    return (texts.withColumn(key, text_key(F.col("text"))).join(found, ["case_id", key], "left")
            .withColumn("text", _once(names_pattern(F.col(names), F.col("text")), lambda p: scrub_text(F.col("text"), p))).select(*texts.columns))


def forbidden_language(text: Column) -> Column:
    """The first forbidden word, in list order, then the first phrase; null when there is none."""
    low, hit = F.lower(text), None
    for w in V.FORBIDDEN_WORDS:
        c = low.rlike(P.whole_word(w))
        hit = F.when(c, w) if hit is None else hit.when(c, w)
    for p in V.FORBIDDEN_PHRASES:
        hit = hit.when(F.contains(low, F.lit(p)), p)
    # one combined test spares ordinary text the ordered search
    return F.when(low.rlike(P.FORBIDDEN), hit)


def leak_check(rows: DataFrame, text_columns: list[str], secrets: list[str]) -> DataFrame:
    """Rows whose output still shows one of the planted secrets; must be empty."""
    said = F.concat_ws("\n", *text_columns)
    any_secret = "|".join("\\Q" + s + "\\E" for s in secrets)
    shown = F.filter(F.array(*[F.lit(s) for s in secrets]), lambda s: F.contains(F.col("_said"), s))
    return (rows.withColumn("_said", said).where(F.col("_said").rlike(any_secret))
            .withColumn("leaked", shown).drop("_said"))
