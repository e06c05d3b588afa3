"""Private spans: the patterns against their plain forms, and one pass over texts of any shape."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from provlake import vocab as V
from provlake.functions import patterns as P
from provlake.operators import privacy

# fixed values: the same kinds without possessive repeats, as they are stated
_C = r"[^\"'<>|?*\n\r\t ]"
_S = r" (?=[^\\/ ]*[\\/])"
_TAIL = rf"{_C}*(?:{_S}{_C}*)*(?<![.,;)\] ])"
PLAIN = [
    P.PRIVATE_KEY,
    rf"(?:(?<![A-Za-z0-9_])[A-Za-z]:[\\/](?:{_C}|{_S})|\\\\(?:{_C}|{_S})(?:{_C}|{_S})){_TAIL}",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9-]*\.[A-Za-z]{2,24}(?=\.*(?:[^A-Za-z0-9.-]|\z))",
    r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}(?![A-Za-z0-9_.-])",
    *[rf"(?<![A-Za-z0-9_]){p}{'[A-Z0-9]' if p in V.UPPER_ONLY_TOKENS else '[A-Za-z0-9_-]'}{{{t},}}" for p, t, _ in V.TOKEN_SHAPES],
]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    parts = ["C:", "\\", "/", "\\\\", " ", "  ", ".", ",", ")", "a", "bc", "srv", "@", "x@y.co", ".com", "-", "_", "%", "eyJ", "abcd", "\"", "\n", "\t", "é",
             "sk-", "AKIA", "A1" * 9, "hf_", "k" * 40, "D:/x", ";", "]", "@b.c.de.", "1", "-----BEGIN RSA PRIVATE KEY-----\n", "-----END X-----\n"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14))) for _ in range(6000)]


def test_patterns_equal_their_plain_forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(8)
    plain = F.regexp_extract_all("text", F.lit("|".join(PLAIN)), F.lit(0))
    differ = df.where(plain != privacy.matches(F.col("text"))).select("text", plain.alias("plain"), privacy.matches(F.col("text")).alias("got"))
    assert differ.collect() == []
    emails = F.regexp_extract_all("text", F.lit(PLAIN[2]), F.lit(0))
    assert df.where(emails != F.regexp_extract_all("text", F.lit(P.EMAIL), F.lit(0))).collect() == []


def test_scrubbed_text_keeps_what_lies_between(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(8)
    labels = "|".join("\\Q" + x + "\\E" for x in ["[REDACTED:private-key-block]", V.OUT_OF_SCOPE_PATH, "[REDACTED:email]", "[REDACTED:jwt]",
                                                *(f"[REDACTED:{label}]" for _, _, label in V.TOKEN_SHAPES)])
    rest = F.array_join(F.split("text", F.lit("|".join(PLAIN)), -1), "")
    out = privacy.scrub_text(F.col("text"))
    assert df.where(F.regexp_replace(out, F.lit(labels), F.lit("")) != rest).select("text", out).collect() == []
    assert df.where(F.regexp_count(out, F.lit(labels)) != F.size(privacy.matches(F.col("text")))).collect() == []


LONG = 1_000_000


@pytest.mark.parametrize("text", ["a" * LONG, "a@" + "b" * LONG, "a@" + "b." * (LONG // 2), "C:\\" + "a b/" * (LONG // 4), "C:\\x" + "." * LONG, "\\\\" + "; " * (LONG // 2),
                                  "a@b" * (LONG // 3), "eyJ" + "a" * LONG, "sk-" + "a" * LONG, "@" * LONG, "a.b@" * (LONG // 4) + "c.de"],
                         ids=lambda t: t[:8])
def test_a_long_run_takes_one_pass(spark, text):
    df = spark.createDataFrame([(text,)], "text string").select(privacy.scrub_text(F.col("text")).alias("out"), F.size(privacy.matches(F.col("text"))).alias("n"))
    df.collect()
    t = time.perf_counter()
    df.collect()
    assert time.perf_counter() - t < 3  # three passes, with the way through the JVM; a quadratic pattern takes minutes


def plain_alias(text, names):
    """Leftmost whole names, the longest first, in a text without other private spans."""
    if text is None or not names:
        return text
    one = "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    return re.sub(rf"(?<![A-Za-z0-9_])(?:{one})(?![A-Za-z0-9_])", "[USER]", text, flags=re.IGNORECASE | re.ASCII)


def test_names_equal_one_plain_pattern_per_case(spark):
    rnd = random.Random(3)
    parts = ["ann", "anna", "bo", "lee", "o'", "mc", "-", ".", " ", "_", "7", "张", "é", "(x", "+", "$", "\\E"]
    name = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    names = {c: [name() for _ in range(40)] for c in (1, 2, 3)}
    texts = [(rnd.choice([1, 2, 3, 4, None]), i, "".join(rnd.choice(parts + ["ANNA", " Lee-", "\n"]) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    texts += [(1, 900, None), (1, 901, ""), (2, 902, texts[5][2]), (2, 902, texts[5][2])]
    df = spark.createDataFrame(texts, "case_id long, doc_id long, text string").withColumns({"_names": F.lit("mine"), "_text_sha": F.lit(1)})
    users = spark.createDataFrame([(c, n) for c, ns in names.items() for n in ns], "case_id long, n string")
    # names straight from the operator's own reading of paths: separators cannot be part of a name
    paths = users.withColumn("path", F.concat(F.lit("/home/"), F.translate("n", "\\", "/"), F.lit("/x")))
    known = {}
    for r in privacy.learned_users(paths).collect():
        known.setdefault(r.case_id, set()).add(r.name)
    assert known[1] == {w for n in names[1] if len(w := next(filter(None, n.split("\\")), "").strip(" ").lower()) >= 3}
    out = privacy.username_alias(df.repartition(5), paths)
    assert out.columns == df.columns
    got = sorted((r.doc_id, str(r.case_id), r.text) for r in out.collect() if r["_names"] == "mine" and r["_text_sha"] == 1)
    assert sorted(got, key=str) == sorted(((d, str(c), plain_alias(t, known.get(c))) for c, d, t in texts), key=str)


def test_a_case_may_have_a_hundred_thousand_names(spark):
    paths = spark.range(100_000).select(F.lit(1).alias("case_id"), F.concat(F.lit("C:\\Users\\user "), F.col("id").cast("string"), F.lit("\\f")).alias("path"))
    texts = spark.range(20_000).select(F.lit(1).alias("case_id"), "id", F.concat(F.lit("by User "), F.col("id") * 5, F.lit(", user x, user "), F.col("id") + 100_000).alias("text"))
    t = time.perf_counter()
    wrong = privacy.username_alias(texts, paths).where(F.col("text") != F.concat(F.lit("by [USER], user x, user "), F.col("id") + 100_000)).count()
    assert wrong == 0 and time.perf_counter() - t < 60


def test_every_account_of_a_path_is_learned(spark):
    paths = spark.createDataFrame([(1, "/home/users/Bob K/x"), (1, "D:\\USERS\\eve\\home\\mallory"), (1, "/home"), (1, None), (1, "xhome/abc"), (2, "home/ab/users/ÄÖÜ")], "case_id long, path string")
    assert sorted((r.case_id, r.name) for r in privacy.learned_users(paths).collect()) == [(1, "bob k"), (1, "eve"), (1, "mallory"), (1, "users"), (2, "ÄÖÜ")]


def test_names_are_right_whatever_hashes_meet(spark, monkeypatch):
    """Tokens and texts move as hashes; with one bucket and one key for all texts, each still gets its own case's names only."""
    texts = spark.createDataFrame([(1, 1, "by Amanda and bob"), (1, 2, "nobody, Robert"), (2, 3, "amanda"), (None, 4, "bob"), (2, 5, None), (2, 6, "robert.")],
                                  "case_id long, doc_id long, text string")
    paths = spark.createDataFrame([(1, "/home/amanda/x"), (1, "C:\\Users\\Bob\\y"), (2, "/home/robert/z"), (None, "/home/nobody/q")], "case_id long, path string")

    def got():
        return {r.doc_id: r.text for r in privacy.username_alias(texts, paths).collect()}

    want = {1: "by [USER] and [USER]", 2: "nobody, Robert", 3: "amanda", 4: "bob", 5: None, 6: "[USER]."}
    assert got() == want
    assert dict(privacy.names_in_texts(texts, privacy.learned_users(paths)).dtypes)["text_key"] == "bigint"
    monkeypatch.setattr(privacy, "NAME_BUCKETS", 1)
    monkeypatch.setattr(privacy, "text_key", lambda text: F.lit(0).cast("long"))
    assert got() == want
