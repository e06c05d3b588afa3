import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from provlake.checks.registry import QUERIES
from provlake.functions.digest import tree_digest
from provlake.operators import verification as X


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(texts):
    leaves, branches = defaultdict(list), defaultdict(list)
    for t in texts:
        leaves[sha(t)[:4]].append(t)
    for leaf, ts in leaves.items():
        branches[leaf[:2]].append(f"{leaf}:{sha(chr(10).join(sorted(ts)))}")
    return sha("\n".join(sorted(f"{b}:{sha(chr(10).join(sorted(d)))}" for b, d in branches.items())))


def moves(df):
    """Exchanges of the plan before it runs."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_texts_move_once_and_digests_once(spark):
    rows = [(i % 3, f"text {i % 1500} é") for i in range(3000)] + [(7, ""), (8, "a\nb"), (8, "a"), (8, "b")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    want = defaultdict(list)
    for k, t in rows:
        want[k].append(t)
    got = tree_digest(df, "k", F.col("t"))
    assert {r.k: r.digest for r in got.collect()} == {k: tree(ts) for k, ts in want.items()}
    assert moves(got) - moves(df) == 2
    placed = df.repartition(5, "k")
    there = tree_digest(placed, "k", F.col("t"), together=True)
    assert {r.k: r.digest for r in there.collect()} == {k: tree(ts) for k, ts in want.items()}
    assert moves(there) == moves(placed)


def test_a_second_run_moves_no_row_before_it_begins(spark, sf):
    assert "RoundRobin" not in QUERIES["reproducibility"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_known_root_digests_are_taken_as_given(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    files = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "case_id long, name string, sha256 string")
    roots = X.root_digest(files).select("case_id", F.col("root_digest").alias("declared_root"))
    given = X.root_digest(files).where("case_id = 1")
    got = X.integrity_status(cases, files, files, roots, actual=given)
    assert {r.case_id: r.integrity_status for r in got.collect()} == {1: "intact", 2: "modified"}


def test_evidence_moves_with_every_column_of_every_table(spark, sf):
    """A change of any column of what was declared, observed, emitted or listed changes the digest of its case."""
    from provlake.checks import q_verification as Q
    from provlake.checks.sqlviews import spark_view

    edits = [("v_declared", "weight_origin", "'x'"), ("v_fact_flat", "base_name", "'x'"), ("v_artifact", "sha256", "'x'"), ("v_outcome", "tier", "'E3'"),
             ("v_outcome", "facet", "'rag'"), ("v_outcome", "emit_step", "1")]
    one = lambda v: spark_view(spark, sf, v).where("case_id BETWEEN 23 AND 29")

    def edited(v):
        df = one(v)
        for case, (view, column, value) in enumerate(edits, 23):  # each edit in a case of its own
            if view == v:
                df = df.withColumn(column, F.when(F.col("case_id") == case, F.expr(value)).otherwise(F.col(column)).cast(df.schema[column].dataType))
        return df

    a, b = ({r.case_id: r.evidence_digest for r in Q.evidence(get).collect()} for get in (one, edited))
    assert {c for c in a if a[c] != b[c]} == set(range(23, 29)) and len(set(a.values())) == len(a) == 7


def test_crowded_cases_get_the_same_digest(spark, monkeypatch):
    from provlake.operators import skew

    facts = spark.createDataFrame([(k, i, f"v{i % 7}") for k, n in ((1, 3000), (2, 5), (None, 2)) for i in range(n)], "case_id long, i long, v string").repartition(4)
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    texts = {k: sorted(f"i={i}|v=v{i % 7}" for i in range(n)) for k, n in ((1, 3000), (2, 5))}
    want = {k: sha("facts=" + tree(t)) for k, t in texts.items()} | {3: sha("")}
    got = lambda: {r.case_id: r.evidence_digest for r in X.evidence_digest(cases, {"facts": facts}).collect()}
    assert got() == want
    monkeypatch.setattr(X, "crowded", lambda rows, key: skew.crowded(rows, key, 1000))
    assert skew.crowded(facts, "case_id", 1000).count() == 1 and got() == want


def test_a_saved_step_leaves_no_shuffle_files(spark):
    import glob

    from provlake.sources.sink import staged

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(3, "count").write.format("noop").mode("overwrite").save()
    kept = files()
    saved = staged(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(3, "count"), "counts")
    assert kept - before and files() <= kept and len(saved.collect()) == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
