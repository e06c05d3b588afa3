"""Facts about retrieval: traces, prompts, stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.operators.ordered import first_rows

_CHUNKS = "struct<" + ",".join(f"{c}:array<map<string,string>>" for c in V.CHUNK_FIELDS) + ">"


def _text_query(v: Column) -> Column:
    """Some query field holds a non-empty string (a number is not a query)."""
    hit = F.lit(False)
    for k in V.QUERY_FIELDS:
        part = F.try_variant_get(v, f"$.{k}", "variant")
        # a string is shown in quotes, so a non-empty one is longer than two characters
        hit = hit | F.coalesce((F.schema_of_variant(part) == "STRING") & (F.length(F.to_json(part)) > 2), F.lit(False))
    return hit


def full_chain(line: Column, v: Column) -> Column:
    """A query and a non-empty list of chunks that all carry a score."""
    read = F.from_json(line, _CHUNKS)
    scored = lambda c: F.greatest(*[F.map_contains_key(c, F.lit(s)) for s in V.SCORE_FIELDS])
    ranked = F.lit(False)
    for c in V.CHUNK_FIELDS:
        ranked = ranked | F.coalesce((F.size(read[c]) > 0) & F.forall(read[c], scored), F.lit(False))
    return _text_query(v) & ranked


def trace_entries(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """``lines``: (file, line_no, line) -> the entries of each file, or its first ``limit``, with their chain flag."""
    entries = lines.where(F.trim("line") != "")
    kept = first_rows(entries, "file", "line_no", limit)
    v = F.try_parse_json("line")
    return (kept.withColumn("v", v).withColumn("malformed", F.col("v").isNull())
            .withColumn("full_chain", full_chain(F.col("line"), F.col("v"))))


def retrieval_chain(lines: DataFrame, limit: int | None = None, max_names: int | None = None) -> DataFrame:
    """Per trace file: entries, full chains, and the names of its fields.

    A file with a malformed line is not read; it is reported by its flag.
    """
    entries = trace_entries(lines, limit)
    totals = entries.groupBy("file").agg(
        F.count("*").alias("entry_count"), F.count(F.when(F.col("full_chain"), 1)).alias("full_chain_entry_count"),
        F.bool_and("full_chain").alias("request_level_chain"), F.bool_or("malformed").alias("malformed"))
    names = entries.select("file", F.explode(F.json_object_keys("line")).alias("name")).distinct()
    if max_names is not None:  # applied per input partition before the names of a file meet
        rank = F.row_number().over(Window.partitionBy("file").orderBy("name"))
        names = names.withColumn("rn", rank).where(F.col("rn") <= max_names).drop("rn")
    named = names.groupBy("file").agg(F.array_sort(F.collect_list("name")).alias("field_names"))
    return totals.join(named, "file", "left")


def prompt_templates(texts: DataFrame, preview: int | None = None) -> DataFrame:
    """``texts``: (file, text) -> templates that assemble retrieved context; ``preview`` cuts what is shown of them."""
    shown = F.col("text") if preview is None else F.left("text", F.lit(preview))
    marked = F.lit(False)
    for m in V.PROMPT_MARKERS:
        marked = marked | F.contains("text", F.lit(m))
    return (texts.where(marked).select(
        "file", shown.alias("preview"), F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").alias("length_bytes"), F.contains("text", F.lit("{context}")).alias("has_context_placeholder")))


def store_kind(name: Column) -> Column:
    """Retrieval store named by a file; the first marker in list order wins."""
    low, out = F.lower(name), None
    for needle, kind in V.STORE_MARKERS:
        hit = F.contains(low, F.lit(needle))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def chunking_configs(configs: DataFrame) -> DataFrame:
    """``configs``: (file, body) -> chunking and index settings, where any are given."""
    ints, texts = ["chunk_size", "chunk_overlap", "top_k", "similarity_top_k"], ["splitter", "text_splitter", "embed_model", "vector_store"]
    schema = "struct<" + ",".join([f"{i}:bigint" for i in ints] + [f"{t}:string" for t in texts]) + ">"
    return (configs.select("file", F.from_json("body", schema).alias("v")).select("file", "v.*")
            .where(F.coalesce(*[F.col(c).cast("string") for c in ints + texts]).isNotNull())
            .withColumn("store", F.lit("config")))
