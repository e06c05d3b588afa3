"""Pairs of a log line: brackets inside quotes, groups of any depth, apostrophes, and long lines."""

import time

import pytest
from pyspark.sql import functions as F

from provlake.operators import logs as L

CASES = [
    ('{"step":5,"m":{"t":"} ","loss":9},"loss":1.5}', [("step", "5"), ("loss", "1.5")]),
    ('{"step":5,"m":{"t":"{","x":1},"loss":1.5}', [("step", "5"), ("loss", "1.5")]),
    ('{"step":5,"note":"cfg: [1","loss":1.5}', [("step", "5"), ("note", "cfg: [1"), ("loss", "1.5")]),
    ('{"a": {"loss": 9.0}, "loss": 1.0}', [("loss", "1.0")]),
    ('{"m":{"q":"]\\"[","n":[{"loss":8},"}"]},"loss":2}', [("loss", "2")]),
    ("{'loss': 0.5, 'l': [1, 'a]'], 'lr': 1e-4}", [("loss", "0.5"), ("lr", "1e-4")]),
    ("INFO: Saving model checkpoint to out", []),
    ("loss: 1.25", [("loss", "1.25")]),
    ("a=b==c d==e f= 3", [("a", "b==c"), ("f", "3")]),
    ("x={1,2 y=3", []),
    ("it's step=3 lr=1 don't", []),  # what stands between two apostrophes is quoted
    ("loss=    1.5,  acc:      0.9", [("loss", "1.5"), ("acc", "0.9")]),
    ('k: "7", j: 8 }', [("k", "7"), ("j", "8")]),
    ('"a" : [1,[2]] , "b":   true}', [("b", "true")]),
    ("", []),
]


@pytest.mark.parametrize(("line", "want"), CASES)
def test_pairs(spark, line, want):
    df = spark.createDataFrame([(1, 1, line)], "run long, line_no long, line string")
    assert [(r.key, r.value) for r in L.log_pairs(df).orderBy("pair_no").collect()] == want


@pytest.mark.parametrize("line", ["a" * 500_000, '"' * 500_001, '"a' * 200_000, "x=" * 200_000, "1:" * 200_000, " " * 500_000], ids=lambda s: s[:4])
def test_a_long_line_takes_one_pass(spark, line):
    df = spark.createDataFrame([(line,)], "line string").select(F.size(L.pair_array(F.col("line"))))
    df.collect()
    t = time.perf_counter()
    df.collect()
    assert time.perf_counter() - t < 5


@pytest.mark.parametrize(("line", "want"), [
    ("a=\x02b c=\x03 d=\x04x", [("a", "\x02b"), ("c", "\x03"), ("d", "\x04x")]),  # the marks of the search, in the text itself
    ("\x03 step=1 loss=2", [("step", "1"), ("loss", "2")]),
])
def test_marks_in_the_text_are_text(spark, line, want):
    df = spark.createDataFrame([(1, 1, line)], "run long, line_no long, line string")
    assert [(r.key, r.value) for r in L.log_pairs(df).orderBy("pair_no").collect()] == want


def test_keys_choose_lines_without_losing_pairs(spark):
    lines = ["STEP=1 other=2", "nothing here", None, "", '"Loss": 3', "x=1"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "run long, line_no long, line string")
    got = {(r.line_no, r.key, r.value) for r in L.log_pairs(df, ["step", "loss"]).where("key IN ('step', 'loss')").collect()}
    assert got == {(0, "step", "1"), (4, "loss", "3")}
