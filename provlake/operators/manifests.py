"""Packages, images, commands and variables from manifests, read as lines: TOML, YAML, build files and card headers.

Input ``lines``: (file, line_no, line).  A line's place is given by the header or key above it, which is carried down the lines of its
file; nothing is nested in memory, so a manifest of any depth is read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.operators.dependencies import category, normal_name

def _above():
    return Window.partitionBy("file").orderBy("line_no")


_UNQUOTE = "^[\"']+|[\"',]+$"
REQUIREMENT = r"^([^=><~!\[ ;@]+)"


def unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), _UNQUOTE, "")


def _package(name: Column, version: Column, ecosystem: str) -> list[Column]:
    clean = normal_name(name)
    return ["file", "line_no", clean.alias("name"), F.lit(ecosystem).alias("ecosystem"), category(clean).alias("category"),
            F.nullif(version, F.lit("")).alias("version")]


def toml_packages(lines: DataFrame) -> DataFrame:
    """Packages of lock files (``[[package]]``), of ``[project]`` and of ``[tool.poetry.dependencies]``."""
    text = F.trim(F.regexp_replace("line", r"^([^#\"']*)#.*$", "$1"))
    header = F.nullif(F.regexp_extract(text, r"^\[+\s*([^\[\]]+?)\s*\]+$", 1), F.lit(""))
    key = F.nullif(F.regexp_extract(text, r"^[\"']?([A-Za-z0-9_.\-]+)[\"']?\s*=", 1), F.lit(""))
    read = (lines.withColumn("text", text).withColumn("header", header)
            .withColumn("key", F.when(F.col("header").isNull(), key))
            .withColumn("section_no", F.count("header").over(_above())).withColumn("section", F.last("header", ignorenulls=True).over(_above()))
            .withColumn("under", F.last("key", ignorenulls=True).over(Window.partitionBy("file", "section_no").orderBy("line_no"))))
    value = unquoted(F.regexp_replace("text", r"^[^=]*=\s*", ""))
    of = lambda k: F.max(F.when(F.col("key") == k, value))
    locked = (read.where("section = 'package'").groupBy("file", "section_no")
              .agg(of("name").alias("n"), of("version").alias("v"), F.min("line_no").alias("line_no")).where("n <> ''"))
    # a list may go over several lines
    listed = (read.where("section = 'project' AND under = 'dependencies'")
              .select("file", "line_no", F.explode(F.regexp_extract_all("text", F.lit("\"([^\"]+)\"|'([^']+)'"), F.lit(0))).alias("r"))
              .withColumn("r", unquoted(F.col("r"))).where(F.col("r").rlike(REQUIREMENT)))
    rest = F.regexp_replace(F.regexp_replace("r", REQUIREMENT, ""), "^[=><~! ]+", "")
    inner = F.regexp_extract("text", r"version\s*=\s*[\"']([^\"']*)", 1)
    tabled = read.where("section = 'tool.poetry.dependencies' AND key IS NOT NULL").withColumn("v", F.when(F.contains("text", F.lit("{")), inner).otherwise(value))
    return (locked.select(*_package(F.col("n"), F.col("v"), "cargo"))
            .unionByName(listed.select(*_package(F.regexp_extract("r", REQUIREMENT, 1), F.regexp_extract(rest, "^([^ ;,]*)", 1), "python")))
            .unionByName(tabled.select(*_package(F.col("key"), F.col("v"), "python"))))


def build_file(lines: DataFrame) -> dict[str, DataFrame]:
    """Images, commands and variables of a build file, each (file, line_no, ..); a trailing backslash goes on in the next line."""
    goes_on = F.trim("line").endswith("\\")
    starts = F.coalesce(~F.lag(goes_on).over(_above()), F.lit(True))
    whole = (lines.withColumn("no", F.sum(starts.cast("int")).over(_above())).groupBy("file", "no")
             .agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", F.rtrim(F.trim("line"), F.lit("\\")).alias("part")))).alias("p"))
             .select("file", "line_no", F.array_join(F.transform("p", lambda x: x["part"]), " ").alias("text")))
    word = F.upper(F.regexp_extract("text", r"^(\S+)\s", 1))
    rest = F.trim(F.regexp_replace("text", r"^\S+\s+", ""))
    part = lambda *words: whole.where(word.isin(*words)).select("file", "line_no", rest.alias("rest"))
    return {
        "images": part("FROM").select("file", "line_no", F.regexp_extract("rest", r"^(\S+)", 1).alias("image")),
        "commands": part("CMD", "ENTRYPOINT").select("file", "line_no", as_command(F.col("rest")).alias("cmd")),
        "variables": part("ENV").select("file", "line_no", F.when(F.col("rest").rlike(r"^[^\s=]+="), F.col("rest"))
                                        .otherwise(F.regexp_replace("rest", r"^(\S+)\s+", "$1=")).alias("line")),
    }


def as_command(c: Column) -> Column:
    """A command as one line; the signs of a list are dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*\[|\]\s*$", ""), r"[\"']\s*,\s*[\"']|[\"']", " "))


COMMAND_KEYS, ENV_KEYS = ["command", "args", "entrypoint", "ExecStart"], ["environment", "env"]


def yaml_file(lines: DataFrame) -> dict[str, DataFrame]:
    """Images, commands, variables and addresses at any depth of a YAML manifest, each (file, line_no, ..)."""
    text = F.regexp_replace("line", r"\s+#.*$", "")
    body = F.regexp_replace(text, r"^\s*(?:-\s+)*", "")
    read = (lines.where(F.trim("line") != "").where(~F.trim("line").startswith("#"))
            .select("file", "line_no", F.length(F.regexp_extract(text, r"^(\s*(?:-\s+)*)", 1)).alias("indent"), text.rlike(r"^\s*-\s").alias("item"),
                    F.regexp_extract(body, r"^[\"']?([A-Za-z0-9_.\-/]+)[\"']?:(?:\s|$)", 1).alias("key"), F.trim(body).alias("body"))
            .withColumn("value", F.when(F.col("key") != "", F.trim(F.regexp_replace("body", r"^[^:]*:\s*", ""))).otherwise(F.col("body"))))
    # the nearest line above that opens a block of commands or variables, while no line has come back to its depth
    opens = (F.col("value") == "") & F.col("key").isin(*COMMAND_KEYS, *ENV_KEYS)
    held = read.withColumn("block_no", F.sum(opens.cast("int")).over(_above()))
    block = Window.partitionBy("file", "block_no").orderBy("line_no")
    head = F.first(F.struct("key", "indent", opens.alias("opens"))).over(block)
    outside = (F.row_number().over(block) > 1) & ((F.col("indent") < F.col("head.indent")) | ((F.col("indent") == F.col("head.indent")) & ~F.col("item")))
    held = (held.withColumn("head", head).withColumn("outside", outside.cast("int")).withColumn("ended", F.max("outside").over(block) > 0)
            .withColumn("inside", F.col("head.opens") & ~F.col("ended") & ~opens).withColumn("before", F.lag(F.struct("key", "value")).over(_above())))
    listed = (held.where(F.col("inside") & F.col("head.key").isin(*COMMAND_KEYS)).groupBy("file", "block_no")
              .agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", unquoted(F.col("body")).alias("p")))).alias("p"))
              .select("file", "line_no", F.array_join(F.transform("p", lambda x: x["p"]), " ").alias("cmd")))
    inline = held.where(F.col("key").isin(*COMMAND_KEYS) & (F.col("value") != "")).select("file", "line_no", as_command(F.col("value")).alias("cmd"))
    env = held.where(F.col("inside") & F.col("head.key").isin(*ENV_KEYS))
    named = F.when(F.col("key") == "", unquoted(F.col("body"))).when((F.col("key") == "value") & (F.col("before.key") == "name"), F.concat_ws(
        "=", unquoted(F.col("before.value")), "value")).when(~F.col("key").isin("name", "value", "valueFrom", "secretKeyRef", "key"), F.concat_ws("=", "key", "value"))
    return {
        "images": held.where("key = 'image' AND value <> ''").select("file", "line_no", unquoted(F.col("value")).alias("image")),
        "commands": listed.unionByName(inline),
        "variables": env.select("file", "line_no", named.alias("line")).where(F.contains("line", F.lit("="))),
        "addresses": held.where(~F.col("inside") & (F.col("key").endswith("url") | F.col("key").endswith("endpoint"))).select(
            "file", "line_no", F.col("key").alias("declared_in"), unquoted(F.col("value")).alias("url")),
    }


def card_base_lines(lines: DataFrame) -> DataFrame:
    """``base_model`` of a card's front matter, one name or a list of names: (file, line_no, base_ref)."""
    fence = F.rtrim("line") == "---"
    front = (lines.withColumn("fences", F.sum(fence.cast("int")).over(_above())).withColumn("first", F.first(fence).over(_above()))
             .where(F.col("first") & (F.col("fences") == 1) & ~fence))
    key = F.nullif(F.regexp_extract("line", r"^([A-Za-z0-9_\-]+):", 1), F.lit(""))
    held = front.withColumn("key", key).withColumn("under", F.last("key", ignorenulls=True).over(_above())).where("under = 'base_model'")
    said = F.regexp_replace(F.regexp_replace("line", r"^[A-Za-z0-9_\-]+:\s*", ""), r"^\s*-\s+", "")
    names = F.split(F.regexp_replace(said, r"^\s*\[|\]\s*$", ""), ",")
    return held.select("file", "line_no", F.explode(F.transform(names, unquoted)).alias("base_ref")).where("base_ref <> ''")
