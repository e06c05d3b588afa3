"""Facts from container headers: tensor tables, adapters, quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.functions.dims import lookup
from provlake.operators.ordered import chunked_lag

SPAN_CHUNK_BYTES = 64 * 1024 * 1024
_HEADER = "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>"


def tensor_explode(headers: DataFrame) -> DataFrame:
    """``headers``: (artifact, header_json) -> one row per tensor; metadata is left out."""
    return (
        headers.select("artifact", F.explode(F.from_json("header_json", _HEADER)).alias("name", "t"))
        .where(F.col("name") != "__metadata__")
        .select("artifact", "name", "t.dtype", "t.shape", F.try_element_at("t.data_offsets", F.lit(1)).alias("begin"),
                F.try_element_at("t.data_offsets", F.lit(2)).alias("end"), F.size("t.data_offsets").alias("n_offsets"))
    )


def metadata_explode(headers: DataFrame) -> DataFrame:
    """The header's own ``__metadata__`` strings: (artifact, key, value)."""
    meta = F.from_json(F.get_json_object("header_json", "$.__metadata__"), "map<string,string>")
    return headers.select("artifact", F.explode(meta).alias("key", "value"))


def tensor_check(tensors: DataFrame) -> DataFrame:
    """Add ``elements`` and ``reason``; a null reason means the entry is usable."""
    elements = F.aggregate("shape", F.lit(1).cast("decimal(38,0)"), lambda a, d: F.try_multiply(a, d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    width = lookup(F.col("dtype"), V.DTYPE_BYTES)
    exact = F.col("exact")
    return (
        tensors.withColumn("exact", elements)
        .withColumn("elements", exact.try_cast("bigint"))
        .withColumn("reason", F.when(F.col("dtype").isNull(), "dtype_missing")
                    .when(F.col("shape").isNull() | F.exists("shape", lambda d: d.isNull() | (d < 0)), "shape_dimension")
                    .when(F.col("elements").isNull(), "elements_overflow")
                    .when(F.col("begin").isNull() | F.col("end").isNull() | (F.col("begin") < 0) | (F.col("end") < 0), "data_offsets")
                    .when(F.col("begin") > F.col("end"), "begin_after_end")
                    .when(width.isNotNull() & (F.col("end") - F.col("begin") != exact * width), "span_length"))
        .withColumn("dtype_known", width.isNotNull())
        .drop("exact")
    )


def tensor_overlap(tensors: DataFrame) -> DataFrame:
    """Adjacent spans, by (begin, end, name), where one starts before the other ends."""
    usable = tensor_check(tensors).where("reason IS NULL").select("artifact", "begin", "end", "name")
    lagged = chunked_lag(usable, ["artifact"], F.floor(F.col("begin") / SPAN_CHUNK_BYTES), ["begin", "end", "name"], ["end", "name"])
    return (lagged.where(F.col("begin") < F.col("prev.end"))
            .select("artifact", "name", "begin", F.col("prev.name").alias("prev_name"), F.col("prev.end").alias("prev_end")))


def past_end(tensors: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose tensor data reach beyond the file; ``files``: (artifact, data_start, file_size)."""
    top = tensor_check(tensors).where("reason IS NULL").groupBy("artifact").agg(F.max("end").alias("max_end"))
    return (files.join(top, "artifact").where(F.col("data_start") + F.col("max_end") > F.col("file_size"))
            .select("artifact", "max_end", "file_size"))


def unusable_files(tensors: DataFrame, files: DataFrame | None = None) -> DataFrame:
    bad = tensor_check(tensors).where("reason IS NOT NULL").select("artifact").union(tensor_overlap(tensors).select("artifact"))
    if files is not None:
        bad = bad.union(past_end(tensors, files).select("artifact"))
    return bad.distinct()


def usable_tensors(tensors: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Tensors of the files whose whole table is usable."""
    return tensor_check(tensors).join(unusable_files(tensors, files), "artifact", "left_anti")


def tensor_summary(tensors: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One header fact per usable file.

    Every tensor is marked in one pass; a file with an entry of its own that is unusable is out whatever its spans say,
    so spans are compared over all entries.
    """
    limit = F.lit(2**63 - 1).cast("decimal(38,0)")
    marked = chunked_lag(tensor_check(tensors), ["artifact"], F.floor(F.col("begin") / SPAN_CHUNK_BYTES), ["begin", "end", "name"], ["end"])
    sound = F.col("reason").isNull() & ~F.coalesce(F.col("begin") < F.col("prev.end"), F.lit(False))
    per_file = marked.groupBy("artifact").agg(
        F.bool_and(sound).alias("_sound"), F.max("end").alias("_end"), F.count("*").alias("tensor_count"),
        F.least(F.sum(F.col("elements").cast("decimal(28,0)")), limit).cast("bigint").alias("parameters"),
        F.array_sort(F.collect_set("dtype")).alias("dtypes"),
        F.max(F.size("shape")).alias("max_rank"), F.max("elements").alias("largest_tensor_elements")).where("_sound")
    if files is not None:
        sizes = files.select("artifact", "data_start", "file_size")
        per_file = (per_file.join(sizes, "artifact", "left")
                    .where(F.coalesce(F.col("data_start") + F.col("_end") <= F.col("file_size"), F.lit(True))).drop("data_start", "file_size"))
    return per_file.drop("_sound", "_end")


def _marker(name: Column) -> Column:
    out = None
    for m in V.LORA_MARKERS:
        hit = F.contains(name, F.lit(m))
        out = F.when(hit, m) if out is None else out.when(hit, m)
    return out


def lora_pairs(tensors: DataFrame) -> DataFrame:
    """Adapter structure per file: pairs, ranks, targets, variants.

    Two aggregates: per (file, family, prefix, suffix) the two halves meet, then
    the pairs are counted per file.
    """
    dora = F.contains("name", F.lit("lora_magnitude_vector"))
    marker = F.when(dora, "lora_magnitude_vector").otherwise(_marker(F.col("name")))
    named = (
        tensors.withColumn("marker", marker)
        .withColumn("prefix", F.when(F.col("marker").isNotNull(), F.expr("substring_index(name, marker, 1)")).otherwise(""))
        .withColumn("suffix", F.when(F.col("marker").isNull() | dora, "").otherwise(
            F.expr("substring(name, length(prefix) + length(marker) + 1)")))
        .withColumn("family", F.when(dora, "dora").when(F.col("marker").startswith("lora_embedding"), "lora_embedding")
                    .when(F.col("marker").isNotNull(), "lora").otherwise("none"))
        .withColumn("side", F.right("marker", F.lit(1)))
    )
    halves = named.groupBy("artifact", "family", "prefix", "suffix").agg(
        F.max(F.when(F.col("side") == "A", True)).alias("has_a"), F.max(F.when(F.col("side") == "B", True)).alias("has_b"),
        F.max(F.when(F.col("side") == "A", F.try_element_at("shape", F.lit(1)))).alias("ra"),
        F.max(F.when(F.col("side") == "B", F.try_element_at("shape", F.lit(-1)))).alias("rb"),
        F.max(F.contains("name", F.lit("modules_to_save"))).alias("saves"))
    adapter = F.col("family").isin("lora", "lora_embedding")
    paired = adapter & F.coalesce(F.col("has_a") & F.col("has_b"), F.lit(False))
    target = F.nullif(F.substring_index(F.rtrim("prefix", F.lit(".")), ".", -1), F.lit(""))
    return halves.groupBy("artifact").agg(
        F.count(F.when(paired, 1)).alias("lora_pair_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(paired, F.array_compact(F.array("ra", "rb"))))))).alias("ranks"),
        F.array_sort(F.collect_set(F.when(F.col("family") != "none", target))).alias("target_module_suffixes"),
        F.max(F.col("family") == "dora").alias("has_dora"), F.max("saves").alias("modules_to_save_present"),
        F.count(F.when(adapter & ~paired, 1)).alias("unpaired_key_count"),
        F.count(F.when(paired & ~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)), 1)).alias("rank_disagreement_count"),
        F.max(F.col("family") != "none").alias("any_marker"),
    ).where("any_marker").drop("any_marker").withColumn("inferred_ranks", F.col("ranks").cast("array<string>")).drop("ranks")


def quantization_records(tensors: DataFrame, metadata: DataFrame, file_types: DataFrame, configs: DataFrame) -> DataFrame:
    """Every record of reduced-precision storage: (artifact, source, detail).

    ``tensors`` of usable files; ``metadata`` (artifact, key, value);
    ``file_types`` (artifact, code); ``configs`` (artifact, body JSON).
    """
    eight = (tensors.where(F.col("dtype").isin(*V.EIGHT_BIT_DTYPES)).groupBy("artifact")
             .agg(F.concat_ws(",", F.array_sort(F.collect_set("dtype"))).alias("detail"))
             .select("artifact", F.lit("dtype").alias("source"), "detail"))
    hay = F.lower(F.concat_ws("|", "key", "value"))
    hint = None
    for h in V.QUANT_HINTS:
        hit = F.contains(hay, F.lit(h))
        hint = F.when(hit, h) if hint is None else hint.when(hit, h)
    meta = (metadata.withColumn("hint", hint).where("hint IS NOT NULL").groupBy("artifact")
            .agg(F.min(F.struct("key", "hint")).alias("m"))
            .select("artifact", F.lit("metadata").alias("source"), F.concat_ws(":", "m.key", "m.hint").alias("detail")))
    gguf = (file_types.withColumn("detail", lookup(F.col("code"), V.GGUF_FILE_TYPES))
            .where(F.col("detail").isNotNull() & ~F.col("code").isin(*V.GGUF_FULL_PRECISION))
            .select("artifact", F.lit("file_type").alias("source"), "detail"))
    config = (configs.select("artifact", F.get_json_object("body", "$.quantization_config").alias("q"),
                             F.get_json_object("body", "$.quantization_config.quant_method").alias("m"))
              .where("q IS NOT NULL").select("artifact", F.lit("config").alias("source"), F.coalesce("m", F.lit("")).alias("detail")))
    return eight.unionByName(meta).unionByName(gguf).unionByName(config)


def unknown_file_types(file_types: DataFrame) -> DataFrame:
    """Codes outside the table: a coverage note, never a guess."""
    known = [c for c, _ in V.GGUF_FILE_TYPES]
    return file_types.where(~F.col("code").isin(*known)).select("artifact", "code", F.lit("CL-FMT-004").alias("rule_id"))


def gguf_kv(kv: DataFrame, leaves: tuple[str, ...] = ("context_length", "block_count")) -> DataFrame:
    """Architecture-prefixed integers from key-value rows (artifact, key, ival, sval).

    ``<architecture>.<leaf>`` wins; failing that the only ``.<leaf>`` key; several
    are an ambiguity and give none.
    """
    leaf = F.regexp_extract("key", "[.](" + "|".join(leaves) + ")$", 1)
    arch = kv.where("key = 'general.architecture'").select("artifact", F.col("sval").alias("arch"))
    ints = kv.where("ival IS NOT NULL").withColumn("leaf", leaf).where("leaf <> ''")
    exact = F.col("key") == F.concat_ws(".", "arch", "leaf")
    # at most one architecture row per file joins the few matching keys
    return (ints.join(arch, "artifact", "left").groupBy("artifact", "leaf").agg(
        F.count("*").alias("n"), F.max_by(F.struct("key", "ival"), F.when(exact, 1)).alias("e"),
        F.max(exact).alias("has_exact"), F.max(F.struct("key", "ival")).alias("only"))
        .withColumn("pick", F.when(F.col("has_exact"), F.col("e")).when(F.col("n") == 1, F.col("only")))
        .select("artifact", "leaf", F.col("pick.key").alias("source_key"), F.col("pick.ival").alias("value"),
                F.when(F.col("pick").isNull(), "CL-FMT-004").alias("note")))
