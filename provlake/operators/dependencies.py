"""Packages named by dependency lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.functions.dims import lookup
from provlake.operators.ordered import first_rows


def normal_name(name):
    return F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-"))


def category(name):
    """Category of a normalised package name; a literal map, so no join."""
    return lookup(name, V.PACKAGE_CATEGORY, F.lit("other"))


def dependency_packages(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """``lines``: (file, line_no, line) of requirement lists -> one row per package, the first ``limit`` of a file if given."""
    text = F.trim(F.substring_index("line", "#", 1))
    head = r"^([^=><~!\[ ;@]+)"
    rest = F.regexp_replace(F.regexp_replace("text", head, ""), "^[=><~! ]+", "")
    packages = (lines.withColumn("text", text)
                .where((F.col("text") != "") & ~F.col("text").startswith("-") & F.col("text").rlike(head)))
    kept = first_rows(packages, "file", "line_no", limit)
    return (kept.withColumn("name", normal_name(F.regexp_extract("text", head, 1)))
            .select("file", "line_no", "name", F.lit("python").alias("ecosystem"), category(F.col("name")).alias("category"),
                    F.nullif(F.regexp_extract(rest, "^([^ ;,]*)", 1), F.lit("")).alias("version")))


def npm_packages(manifests: DataFrame) -> DataFrame:
    """``manifests``: (file, body) package manifests; lock-file paths are cleaned to names."""
    section = lambda s: F.from_json(F.get_json_object("body", f"$.{s}"), "map<string,string>")
    rows = None
    for i, s in enumerate(["dependencies", "devDependencies", "packages"]):
        part = manifests.select("file", F.lit(i).alias("section_no"), F.explode(section(s)).alias("key", "spec"))
        rows = part if rows is None else rows.unionByName(part)
    clean = F.regexp_replace("key", "^.*node_modules/", "")
    version = F.when(F.col("spec").startswith("{"), F.get_json_object("spec", "$.version")).otherwise(F.col("spec"))
    return (rows.withColumn("name", normal_name(clean)).where("name <> ''")
            .select("file", "section_no", "name", F.lit("npm").alias("ecosystem"), category(F.col("name")).alias("category"),
                    F.nullif(F.trim(version), F.lit("")).alias("version")))
