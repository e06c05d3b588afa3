"""Facts about deployment: endpoints, variables, serving commands, images, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab as V


def clean_url(raw: Column) -> Column:
    """Scheme, host and path only: user info, query and fragment are dropped; null when not a URL."""
    bare = F.regexp_replace(F.trim(raw), "^[\"',;]+|[\"',;]+$", "")
    rest = F.regexp_extract(bare, "^(?:https?|wss?)://([^?#]*)", 1)
    rest = F.regexp_replace(rest, "^.*@", "")
    return F.when(rest != "", F.concat(F.regexp_extract(bare, "^([a-z]+)://", 1), F.lit("://"), rest))


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "^[a-z]+://([^/:]*)", 1), F.lit(""))


def provider_of(host: Column) -> Column:
    """First provider whose host name occurs in the host."""
    low, out = F.lower(host), None
    for needle, provider in V.PROVIDER_HOSTS:
        hit = F.contains(low, F.lit(needle))
        out = F.when(hit, provider) if out is None else out.when(hit, provider)
    return out


def is_private(host: Column) -> Column:
    p = host.isin(*V.PRIVATE_HOSTS)
    for prefix in V.PRIVATE_PREFIXES:
        p = p | host.startswith(prefix)
    return p


def provider_endpoints(urls: DataFrame) -> DataFrame:
    """``urls``: any columns with ``url`` -> cleaned endpoint columns; rows that are no URL are dropped."""
    return (urls.withColumn("endpoint_url", clean_url(F.col("url"))).withColumn("host", host_of(F.col("endpoint_url")))
            .where("host IS NOT NULL").drop("url")
            .withColumn("is_loopback_or_private", is_private(F.col("host")))
            .withColumn("provider", provider_of(F.col("host"))))


def env_vars(lines: DataFrame) -> DataFrame:
    """``lines``: (file, line_no, line) of NAME=VALUE; a credential's value is never kept."""
    name = F.trim(F.regexp_extract("text", "^([^=]*)=", 1))
    raw = F.trim(F.regexp_extract("text", "(?s)^[^=]*=(.*)$", 1))
    value = F.regexp_replace(raw, "^[\"']+|[\"']+$", "")
    secret = F.upper("name").rlike("|".join(V.CREDENTIAL_NAMES))
    url = clean_url(F.col("value"))
    return (lines.withColumn("text", F.regexp_replace(F.trim("line"), "^export ", ""))
            .where(~F.trim("line").startswith("#") & F.contains("text", F.lit("=")))
            .withColumn("name", name).where("name <> ''").withColumn("value", value)
            .withColumn("withheld", secret).withColumn("endpoint_url", F.when(~secret & host_of(url).isNotNull(), url))
            .select("file", "line_no", "name",
                    F.when(F.col("withheld"), "credential").when(F.col("endpoint_url").isNotNull(), "endpoint").otherwise("setting").alias("role"),
                    F.when(~F.col("withheld") & F.col("endpoint_url").isNull(), F.col("value")).alias("value"), "endpoint_url"))


def _flag(names: str) -> Column:
    """Value after ``--flag value`` or ``--flag=value``; the last use wins; another ``--flag`` is no value."""
    return F.nullif(F.regexp_extract("cmd", rf"(?:^|.*\s)(?:{names})(?:=|\s+(?!--))(\S+)", 1), F.lit(""))


def serving_commands(commands: DataFrame) -> DataFrame:
    """``commands``: any columns with ``cmd`` -> engine and model settings."""
    low, engine = F.lower("cmd"), None
    for e in V.ENGINES:
        hit = F.contains(low, F.lit(e))
        engine = F.when(hit, e) if engine is None else engine.when(hit, e)
    positional = F.nullif(F.regexp_extract("cmd", r"^(?:(?!(?:^|\s)(?i:serve|run|start)(?:\s|$)).)*(?:^|\s)(?i:serve|run|start)\s+([^\s\-]\S*)", 1), F.lit(""))
    return (commands.withColumn("engine", engine).where("engine IS NOT NULL")
            .withColumn("model_path", F.coalesce(_flag("--model|-m|--model-path"), positional))
            .withColumn("served_model_name", _flag("--served-model-name"))
            .withColumn("lora_modules", _flag("--lora-modules|--lora"))
            .withColumn("quantization", _flag("--quantization|--quantize"))
            .withColumn("port", _flag("--port").try_cast("bigint"))
            .withColumn("enable_lora", F.col("cmd").rlike(r"(^|\s)(--lora-modules|--lora|--enable-lora)(=|\s|$)"))
            .drop("cmd"))


def artifact_references(serving: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Model paths of serving facts (case_id, fact_id, model_path) as references.

    Without ``artifacts`` nothing is resolved.  With them a path is in scope when it
    ends, by whole components, with the path of an artifact of the case: an
    equi-join on the last component, then a check of the suffix.
    """
    refs = serving.where("model_path IS NOT NULL").select("case_id", "fact_id", F.col("model_path").alias("target_path"))
    if artifacts is None:
        return refs.withColumn("in_scope", F.lit(False))
    last = lambda c: F.substring_index(c, "/", -1)
    rel = F.regexp_replace("path_alias", "^ROOT[0-9]+/", "")
    known = artifacts.select("case_id", last(rel).alias("leaf"), rel.alias("rel")).distinct()
    keyed = refs.withColumn("leaf", last(F.rtrim("target_path", F.lit("/"))))
    inside = F.endswith(F.concat(F.lit("/"), F.rtrim("target_path", F.lit("/"))), F.concat(F.lit("/"), F.col("rel")))
    hits = (keyed.join(known, ["case_id", "leaf"]).where(inside).select("case_id", "fact_id").distinct()
            .withColumn("in_scope", F.lit(True)))
    return refs.join(hits, ["case_id", "fact_id"], "left").fillna({"in_scope": False})


def container_digests(lines: DataFrame) -> DataFrame:
    """``lines``: (file, line_no, line) of build files -> images and their pinned digests."""
    image = F.regexp_extract(F.trim("line"), r"(?i)^FROM\s+(\S+)", 1)
    return (lines.withColumn("image", image).where("image <> ''")
            .select("file", "line_no", "image", F.nullif(F.regexp_extract("image", "@sha256:(.*)$", 1), F.lit("")).alias("image_digest")))
