"""Facts from training logs.

Input ``lines``: (run, line_no, line).  Extraction is narrow (no shuffle); what is
kept per run is combined on the map side.  Only the step order needs an order over
all lines of a run: it is computed inside fixed-size line chunks first and then
over one summary row per chunk, so a run of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.functions.numbers import micros, parse_int, percent_decrease, seconds
from provlake.functions.stamps import find_stamp, strip_leading, to_utc

LINES_PER_CHUNK = 4096

# --- fixed values: the shapes of a pair ---------------------------------------
HOLE = "\x01"  # stands where a nested group was
MARKS = "\x02\x03\x04"  # before a key, before its value, behind it
_DQ, _SQ = r'"(?:[^"\\]++|\\.)*+"', r"'(?:[^'\\]++|\\.)*+'"
_KEY = r"[A-Za-z0-9_.\-]++"
_NUM = r"[+-]?(?:[0-9]++[.]?[0-9]*+|[.][0-9]++)(?:[eE][+-]?[0-9]++)?+"
_IN_STRUCTURE = rf"[^,}}\]\s\"'{{\[{HOLE}][^,}}\]]*+"
_BARE = rf"[^,}}\]\s\"'{{\[={HOLE}][^,}}\] \t]*+"
# Group 1 is the key and group 3 the value.  The empty group 2 is set behind ``key=`` only, so that a back reference to it tells the
# two forms of a value apart.  Words and signs before a pair belong to its match, so no place is tried twice.  What is quoted without
# being a pair is stepped over, and an open quote takes the rest.
PAIR = (rf"(?:[^A-Za-z0-9_.\-\"']++|{_KEY}(?![=:]))*+(?:((?:{_DQ}|{_SQ})(?=[ \t]*+:)|{_KEY}(?:(?==(?!=))()|(?=:[ \t]*+[\"']?{_NUM}[\"']?[ \t]*+(?:[,}}\]]|$))))"
        rf"[ \t]*+[:=][ \t]*+({_DQ}|{_SQ}|\2{_BARE}|(?!\2){_IN_STRUCTURE})|{_DQ}|{_SQ}|[\"'].*+$|{_KEY}|\z)")
# brackets inside quotes are text; a quote behind a letter is an apostrophe
NESTING = rf"(?<![A-Za-z0-9_])(?:{_DQ}|{_SQ})|[{{}}\[\]]|(?:[^{{}}\[\]\"']|(?<=[A-Za-z0-9_])[\"'])++|[\"']"


def _flat(line: Column) -> Column:
    """The line with every group that is the value of a key left out, however deep it goes; an unclosed one goes to the end."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))

    def step(a, part):
        opens, closes = part.isin("{", "["), part.isin("}", "]")
        inside = a["depth"] > 0
        enters = opens & ~inside & a["out"].rlike(r"[:=][ \t]*$")
        depth = F.when(inside, a["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).when(enters, 1).otherwise(0)
        return F.struct(F.when(enters, F.concat(a["out"], F.lit(HOLE))).when(inside, a["out"]).otherwise(F.concat(a["out"], part)).alias("out"),
                        depth.alias("depth"))

    flat = F.aggregate(F.regexp_extract_all(line, F.lit(NESTING), F.lit(0)), start, step, lambda a: a["out"])
    return F.when(line.rlike(r"[:=][ \t]*[{\[]"), flat).otherwise(line)


def pair_array(line: Column) -> Column:
    """Every ``key=value``, ``"key": value`` and ``key: number`` of a line, in order."""
    def unquoted(v):
        held = v.startswith('"') | v.startswith("'")
        return F.when(held & (F.length(v) > 1), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    def taken(flat, group):
        return F.regexp_extract_all(flat, F.lit(PAIR), F.lit(group))

    def both(flat):  # one search writes keys and values between marks; what no match covers stands before a match's first mark
        cut = F.split(F.regexp_replace(flat, PAIR, f"{MARKS[0]}$1{MARKS[1]}$3{MARKS[2]}"), MARKS[2])
        return F.filter(F.transform(cut, lambda m: F.substring_index(m, MARKS[0], -1)), lambda m: F.instr(m, MARKS[1]) > 1)

    def pair(k, v):
        return F.struct(F.lower(F.trim(F.btrim(k, F.lit("\"'")))).alias("key"), F.trim(unquoted(v)).alias("value"))

    def read(flat):
        return F.when(flat.rlike(f"[{''.join(MARKS)}]"), F.zip_with(taken(flat, 1), taken(flat, 3), pair)).otherwise(
            F.transform(both(flat), lambda m: pair(F.substring_index(m, MARKS[1], 1), F.substring_index(m, MARKS[1], -1))))

    return F.filter(F.get(F.transform(F.array(_flat(line)), read), F.lit(0)), lambda p: p["key"] != "")


def with_pairs(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``pairs``, unless the lines come with them; with ``keys``, of the lines that hold the text of a key only."""
    if "pairs" in lines.columns:
        return lines
    held = lines if keys is None else lines.where(_has_any(F.lower("line"), keys))
    return held.withColumn("pairs", pair_array(F.col("line")))


def log_pairs(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return (with_pairs(lines, keys).select("run", "line_no", F.posexplode("pairs").alias("pair_no", "p"))
            .select("run", "line_no", "pair_no", "p.key", "p.value"))


def log_labels(lines: DataFrame) -> DataFrame:
    """Banner values: the latest of each field, the first for the number of epochs."""
    part = (lines.select("run", "line_no", F.posexplode(F.split(strip_leading(F.col("line")), r"\|\|")).alias("seg_no", "seg"))
            .select("run", "line_no", "seg_no", F.regexp_extract("seg", r"^([^=:]*)[=:]", 1).alias("raw"),
                    F.trim(F.regexp_replace("seg", r"^[^=:]*[=:]", "")).alias("value"),
                    F.col("seg").rlike("[=:]").alias("cut"))
            .where(F.col("cut") & F.contains(F.trim("raw"), F.lit(" ")) & (F.col("value") != "")))
    label = F.trim(F.lower(F.regexp_replace("raw", r"\s+", " ")))
    field = None
    for suffix, name in V.LABELS:
        field = F.when(label.endswith(suffix), name) if field is None else field.when(label.endswith(suffix), name)
    value = F.when(F.col("field").isin("num_epochs", "final_loss"), F.when(micros(F.col("value")).isNotNull(), F.col("value"))) \
        .otherwise(parse_int(F.col("value")).cast("string"))
    at = F.struct("line_no", "seg_no")
    return (part.withColumn("field", field).withColumn("kept", value).where("field IS NOT NULL AND kept IS NOT NULL")
            .groupBy("run", "field")
            .agg(F.when(F.col("field") == "num_epochs", F.min_by("kept", at)).otherwise(F.max_by("kept", at)).alias("value")))


def log_timestamps(lines: DataFrame) -> DataFrame:
    return (lines.select("run", "line_no", find_stamp(F.col("line")).alias("raw")).where("raw IS NOT NULL")
            .withColumn("utc", to_utc(F.col("raw"))))


def merged(parts: DataFrame, keys: list[str], at: Column, *more: Column) -> DataFrame:
    """One series summary per ``keys`` of the summaries ``parts``, which follow one another by ``at``, and the aggregates ``more``.

    A summary is (entries, n_steps, first_step, last_step, ordered, first_loss, last_loss).  Merging is associative, so
    lines become chunks, chunks become blocks and blocks become runs by the same step.
    """
    earlier = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("_at"))
    # the last step of all parts before that have one
    follows = F.coalesce(F.col("first_step") >= F.last("last_step", ignorenulls=True).over(earlier), F.lit(True))
    return parts.withColumn("_at", at).withColumn("_follows", follows).groupBy(*keys).agg(
        F.sum("entries").alias("entries"), F.sum("n_steps").alias("n_steps"), F.min_by("first_step", known("first_step")).alias("first_step"),
        F.max_by("last_step", known("last_step")).alias("last_step"), F.bool_and(F.col("ordered") & F.col("_follows")).alias("ordered"),
        F.min_by("first_loss", known("first_loss")).alias("first_loss"), F.max_by("last_loss", known("last_loss")).alias("last_loss"), *more)


def chunk_of(line_no: Column, chunk_rows: int = LINES_PER_CHUNK) -> Column:
    return F.floor(line_no / chunk_rows)


def line_summaries(entries: DataFrame) -> DataFrame:
    """``entries``: (run, line_no, is_entry, steps array<bigint>, losses array<string>)."""
    within = F.forall(F.sequence(F.lit(2), F.size("steps")), lambda i: F.element_at("steps", i) >= F.element_at("steps", i - 1))
    return entries.select(  # no filter here: pushed below, it would parse every line again
        "run", "line_no", F.col("is_entry").cast("bigint").alias("entries"), F.size("steps").cast("bigint").alias("n_steps"),
        F.get("steps", F.lit(0)).alias("first_step"), F.try_element_at("steps", F.lit(-1)).alias("last_step"),
        (F.when(F.size("steps") > 1, within).otherwise(F.lit(True))).alias("ordered"),
        F.get("losses", F.lit(0)).alias("first_loss"), F.try_element_at("losses", F.lit(-1)).alias("last_loss"))


def step_order(steps: DataFrame, chunk_rows: int = LINES_PER_CHUNK) -> DataFrame:
    """Per run: first and last step, how many, and whether they never fall.

    ``steps``: (run, line_no, idx, step), ordered by (line_no, idx).
    """
    single = steps.select("run", chunk_of(F.col("line_no"), chunk_rows).alias("chunk"), "line_no", "idx", F.lit(0).alias("entries"),
                          F.lit(1).alias("n_steps"), F.col("step").alias("first_step"), F.col("step").alias("last_step"), F.lit(True).alias("ordered"),
                          F.lit(None).cast("string").alias("first_loss"), F.lit(None).cast("string").alias("last_loss"))
    return runs_of_chunks(merged(single, ["run", "chunk"], F.struct("line_no", "idx")), chunk_rows).select(
        "run", "first_step", "last_step", "n_steps", "ordered")


def chunk_summaries(lines: DataFrame, *more_keys: str) -> DataFrame:
    """One summary row per (run, chunk) of ``lines`` (run, chunk, line_no, step, loss), each line one entry, with its lowest and highest line."""
    single = lines.select("run", "chunk", *more_keys, "line_no", F.lit(1).alias("entries"), F.col("step").isNotNull().cast("int").alias("n_steps"),
                          F.col("step").alias("first_step"), F.col("step").alias("last_step"), F.lit(True).alias("ordered"),
                          F.col("loss").alias("first_loss"), F.col("loss").alias("last_loss"))
    return merged(single, ["run", "chunk", *more_keys], F.col("line_no"), F.min("line_no").alias("low"), F.max("line_no").alias("high"))


def runs_of_chunks(chunks: DataFrame, chunk_rows: int = LINES_PER_CHUNK) -> DataFrame:
    """One summary per run of one per (run, chunk): over blocks of ``chunk_rows`` chunks, so that a long or sparse run meets nowhere whole."""
    blocks = merged(chunks.withColumn("_block", chunk_of(F.col("chunk"), chunk_rows)), ["run", "_block"], F.col("chunk"))
    return merged(blocks, ["run"], F.col("_block"))


def series_of_chunks(chunks: DataFrame) -> DataFrame:
    """Series of every run from one summary per (run, chunk)."""
    return runs_of_chunks(chunks).select(
        "run", F.col("entries").alias("entry_count"), "first_step", "last_step",
        F.when(F.col("n_steps") >= 2, F.col("ordered")).alias("steps_monotonic"), "first_loss", "last_loss",
        percent_decrease(F.col("first_loss"), F.col("last_loss")).alias("loss_decreasing_percent"))


def series_summary(entries: DataFrame) -> DataFrame:
    """``entries``: (run, line_no, is_entry, steps array<bigint>, losses array<string>), read once."""
    lines = line_summaries(entries).withColumn("chunk", chunk_of(F.col("line_no")))
    return series_of_chunks(merged(lines, ["run", "chunk"], F.col("line_no")))


def metric_series(metrics: DataFrame) -> DataFrame:
    """Series of structured metric rows (run, line_no, step, loss)."""
    return series_summary(metrics.select(
        "run", "line_no", F.lit(True).alias("is_entry"), F.array_compact(F.array("step")).alias("steps"),
        F.array_compact(F.array(F.when(micros(F.col("loss")).isNotNull(), F.col("loss")))).alias("losses")))


def _values(keys: list[str]) -> Column:
    return F.transform(F.filter("pairs", lambda p: p["key"].isin(*keys)), lambda p: p["value"])


def log_series(lines: DataFrame) -> DataFrame:
    """The metric series written in a log."""
    return series_summary(with_pairs(lines, V.ENTRY_KEYS).select(
        "run", "line_no", F.exists("pairs", lambda p: p["key"].isin(*V.ENTRY_KEYS)).alias("is_entry"),
        F.array_compact(F.transform(_values(V.STEP_KEYS), parse_int)).alias("steps"),
        F.filter(_values(V.LOSS_KEYS), lambda v: micros(v).isNotNull()).alias("losses"))
    ).where("entry_count > 0")


def _has_any(text: Column, parts: list[str]) -> Column:
    return text.rlike("|".join(parts))


def is_run_start(line: Column) -> Column:
    return _has_any(F.lower(line), V.RUN_START_PHRASES)


def is_checkpoint_write(line: Column) -> Column:
    low = F.lower(line)
    return F.contains(low, F.lit("checkpoint")) & _has_any(low, V.CHECKPOINT_VERBS)


def checkpoint_steps(lines: DataFrame, directories: int | None = None) -> DataFrame:
    """Steps a log speaks of: series ends and the directories written, or the first ``directories`` of them seen.

    Digits that no 64-bit step holds are no step.
    """
    found = F.regexp_extract_all(F.lower("line"), F.lit("checkpoint-([0-9]+)"), F.lit(1))
    dirs = (lines.where(is_checkpoint_write(F.col("line")))
            .select("run", "line_no", F.posexplode(found).alias("idx", "digits"))
            .withColumn("step", F.col("digits").try_cast("bigint")).where("step IS NOT NULL")
            .groupBy("run", "step").agg(F.min(F.struct("line_no", "idx")).alias("at")))
    if directories is not None:  # applied per input partition before the rows of a run meet
        rank = F.row_number().over(Window.partitionBy("run").orderBy("at"))
        dirs = dirs.withColumn("rn", rank).where(F.col("rn") <= directories)
    kept = dirs.select("run", "step", F.lit(2).alias("o"))
    ends = log_series(lines).select("run", F.inline(F.array(
        F.struct(F.col("first_step").alias("step"), F.lit(0).alias("o")),
        F.struct(F.col("last_step").alias("step"), F.lit(1).alias("o"))))).where("step IS NOT NULL")
    names = F.array(F.lit("series_first"), F.lit("series_last"), F.lit("checkpoint_directory"))
    return (ends.unionByName(kept).groupBy("run", "step").agg(F.min("o").alias("o"))
            .select("run", "step", F.element_at(names, F.col("o") + 1).alias("origin")))


def run_chronology(lines: DataFrame) -> DataFrame:
    """Latest run start, and the last checkpoint if it was written no earlier than that start."""
    raw = find_stamp(F.col("line"))
    marked = lines.select("run", "line_no", raw.alias("raw"), is_run_start(F.col("line")).alias("s"),
                          is_checkpoint_write(F.col("line")).alias("c")).where("raw IS NOT NULL")
    at_start, at_ckpt = F.when(F.col("s"), F.col("line_no")), F.when(F.col("c"), F.col("line_no"))
    per_run = marked.groupBy("run").agg(
        F.max(at_start).alias("start_line"), F.max_by("raw", at_start).alias("start"),
        F.max(at_ckpt).alias("ckpt_line"), F.max_by("raw", at_ckpt).alias("ckpt"),
        F.min_by("raw", "line_no").alias("observed_first_at"), F.max_by("raw", "line_no").alias("observed_last_at"))
    paired = F.when(F.col("start_line").isNull() | (F.col("ckpt_line") >= F.col("start_line")), F.col("ckpt"))
    return (per_run.select("run", F.when(F.col("start_line").isNotNull(), F.col("start")).alias("run_started_at_text"),
                           F.when(F.col("ckpt_line").isNotNull(), paired).alias("checkpoint_at_text"),
                           "observed_first_at", "observed_last_at")
            .withColumn("run_started_at", to_utc(F.col("run_started_at_text")))
            .withColumn("checkpoint_at", to_utc(F.col("checkpoint_at_text"))))


def _read_pairs(lines: DataFrame, keys: list[str]) -> DataFrame:
    return log_pairs(lines, keys).where(F.col("key").isin(*keys))


def token_counts(lines: DataFrame) -> DataFrame:
    """Largest token count per run; a throughput is not a count; the banner is the fallback."""
    rate = F.col("key").rlike("|".join(V.RATE_MARKERS))
    pairs = (_read_pairs(lines, V.TOKEN_KEYS).where(~rate).groupBy("run")
             .agg(F.max(parse_int(F.col("value"))).alias("counted")).where("counted IS NOT NULL"))
    banner = log_labels(lines).where("field = 'tokens'").select("run", F.col("value").cast("bigint").alias("announced"))
    return (pairs.join(banner, "run", "full")
            .select("run", F.coalesce("counted", "announced").alias("tokens")))


def _last_int(keys: list[str]) -> Column:
    v = F.when(F.col("key").isin(*keys), parse_int(F.col("value")))
    return F.max_by(v, F.when(v.isNotNull(), F.struct("line_no", "idx")))


def hardware_records(lines: DataFrame) -> DataFrame:
    """World size, accelerator count, device names and ``8x a100`` mentions."""
    known = "|".join(V.ACCELERATORS)
    # a count must not be the tail of a longer word or number
    mention = rf"(?:^|[^a-z0-9.])([0-9]+ *x *(?:{known})[a-z0-9\-]*)"
    said = F.transform(F.regexp_extract_all(F.lower("line"), F.lit(mention), F.lit(1)), lambda m: F.struct(
        F.regexp_extract(m, "^([0-9]+)", 1).try_cast("bigint").alias("count"),
        F.regexp_extract(m, r"x *([a-z0-9\-]+)$", 1).alias("token")))
    said = F.filter(said, lambda m: m["count"] >= 1)
    keys = V.GPU_COUNT_KEYS + V.DEVICE_KEYS + ["world_size"]
    both = with_pairs(lines).select(
        "run", "line_no",
        F.posexplode(F.concat(
            F.transform(F.filter("pairs", lambda p: p["key"].isin(*keys)), lambda p: F.struct(
                p["key"].alias("key"), p["value"].alias("value"))),
            F.transform(said, lambda m: F.struct(F.lit("mention").alias("key"),
                        F.concat_ws("x ", m["count"].cast("string"), m["token"]).alias("value"))))).alias("idx", "p"),
    ).select("run", "line_no", "idx", "p.key", "p.value")
    labels = log_labels(lines).where("field = 'world_size'").select("run", F.col("value").cast("bigint").alias("label_world"))
    device = F.when(F.col("key").isin(*V.DEVICE_KEYS) & (F.col("value") != ""), F.col("value"))
    m = F.col("key") == "mention"
    first_said = F.min_by(F.when(m, F.substring_index("value", "x ", 1).try_cast("bigint")), F.when(m, F.struct("line_no", "idx")))
    out = both.groupBy("run").agg(
        _last_int(["world_size"]).alias("pair_world"), _last_int(V.GPU_COUNT_KEYS).alias("pair_gpus"),
        first_said.alias("said_gpus"),
        F.array_join(F.array_sort(F.collect_set(device)), "; ").alias("device_name"),
        F.array_join(F.array_sort(F.collect_set(F.when(m, F.col("value")))), "; ").alias("description"))
    return (out.join(labels, "run", "full")
            .select("run", F.coalesce("pair_world", "label_world").alias("world_size"),
                    F.coalesce("pair_gpus", "said_gpus").alias("gpu_count"),
                    F.coalesce("device_name", F.lit("")).alias("device_name"),
                    F.coalesce("description", F.lit("")).alias("description"))
            .where("world_size IS NOT NULL OR gpu_count IS NOT NULL OR device_name <> '' OR description <> ''"))


def compute_records(lines: DataFrame) -> DataFrame:
    """Longest runtime, last accelerator hours, largest operation count, last seeds."""
    pairs = (_read_pairs(lines, V.RUNTIME_KEYS + V.GPU_HOUR_KEYS + V.FLOP_KEYS + V.SEED_KEYS + ["data_seed"])
             .withColumnRenamed("pair_no", "idx"))
    per_run = pairs.groupBy("run").agg(
        F.max(F.when(F.col("key").isin(*V.RUNTIME_KEYS), seconds(F.col("value")))).alias("wall_clock_seconds"),
        _last_int(V.GPU_HOUR_KEYS).alias("gpu_hours"),
        F.max(F.when(F.col("key").isin(*V.FLOP_KEYS), parse_int(F.col("value")))).alias("total_flos"),
        _last_int(V.SEED_KEYS).alias("seed"), _last_int(["data_seed"]).alias("data_seed"))
    return per_run.where("coalesce(wall_clock_seconds, gpu_hours, total_flos, seed, data_seed) IS NOT NULL")


def log_tail(lines: DataFrame, tail_bytes: int | None = None, max_line: int | None = None,
             chunk_rows: int = LINES_PER_CHUNK) -> DataFrame:
    """Lines inside the last ``tail_bytes`` of each run (all by default), without a cut first line; longer ones than ``max_line`` are marked.

    Byte totals are summed per chunk, then chunks from the end; only chunks that
    reach into the tail are summed line by line.
    """
    overlong = F.lit(False) if max_line is None else F.octet_length("line") > max_line
    if tail_bytes is None:
        return lines.select("run", "line_no", "line", overlong.alias("overlong"))
    sized = (lines.withColumn("bytes", F.octet_length("line") + 1)
             .withColumn("chunk", F.floor(F.col("line_no") / chunk_rows)))
    per_chunk = sized.groupBy("run", "chunk").agg(F.sum("bytes").alias("chunk_bytes"))
    later = Window.partitionBy("run").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    reach = (per_chunk.withColumn("after", F.coalesce(F.sum("chunk_bytes").over(later), F.lit(0)))
             .where(F.col("after") < tail_bytes).select("run", "chunk", "after"))
    upto = Window.partitionBy("run", "chunk").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    return (sized.join(reach, ["run", "chunk"])
            .withColumn("from_end", F.col("after") + F.sum("bytes").over(upto))
            .where(F.col("from_end") <= tail_bytes)
            .withColumn("overlong", overlong)
            .select("run", "line_no", "line", "overlong"))


def log_tail_summary(lines: DataFrame, **limits) -> DataFrame:
    """Kept lines and overlong lines per run."""
    return log_tail(lines, **limits).groupBy("run").agg(
        F.count(F.when(~F.col("overlong"), 1)).alias("kept_lines"), F.count(F.when(F.col("overlong"), 1)).alias("overlong_lines"),
        F.min(F.when(~F.col("overlong"), F.col("line_no"))).alias("first_line"))


def trainer_state_series(states: DataFrame) -> DataFrame:
    """``states``: (run, body) with the trainer's JSON state; summary of its log history."""
    schema = "struct<global_step:bigint,log_history:array<struct<step:bigint,loss:string>>>"
    # quoting the loss keeps its text exactly as written
    quoted = F.regexp_replace("body", r'("loss"\s*:\s*)(-?[0-9][0-9.eE+\-]*)', '$1"$2"')
    read = states.select("run", F.from_json(quoted, schema).alias("v"))
    history = F.coalesce("v.log_history", F.array().cast("array<struct<step:bigint,loss:string>>"))
    entries = read.select("run", "v.global_step", F.posexplode(history).alias("line_no", "e"))
    series = metric_series(entries.selectExpr("run", "line_no", "e.step", "e.loss"))
    return (read.select("run", "v.global_step").join(series, "run", "left")
            .select("run", F.coalesce("entry_count", F.lit(0)).alias("entry_count"), "first_step", "last_step", "global_step",
                    F.col("steps_monotonic").alias("monotone_step_order"), "first_loss", "last_loss",
                    F.array_compact(F.array_distinct(F.array("first_step", "last_step", "global_step"))).alias("checkpoint_steps")))
