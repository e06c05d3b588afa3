import os
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rnd = random.Random(7)
    vocabulary = ["the", "and", "ouea", "thntion", "clown", "É", "lich", "a", "über", "re", "x" * 300]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    long = text(30_000)
    rows = [(1, None, "en", "b", 0), (2, "", "en", "b", 0), (3, " \n\t ", None, None, None), (None, "null id here", "en", "a", 1),
            (4, long, "en", "a", len(long)), (5, long, "de", None, 3), (6, "one", "en", "ab", 3), (7, "one two", "en", "ab", 3),
            (8, "same row twice in the table", "en", "a", 3), (8, "same row twice in the table", "en", "a", 3),
            (9, "a   b  \n c   d \n\n e 's don't <|endoftext|> x", "fr", "Z", 1), (10, "\x00\x1f\x85 tail", "fr", "é", 1)]
    return rows + [(i, text(rnd.randrange(1, 400)), "en", f"s{i % 5}", 1) for i in range(20, 120)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return (spark.createDataFrame(odd_rows, DOCS).repartition(3)
            .withColumns({c: F.lit("clash") for c in ("size", "score", "fingerprint", "start", "kept", "_row", "shard", "ids", "words")}))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def brute_words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


@pytest.fixture(scope="session")
def split_words():
    return brute_words


@pytest.fixture(scope="session")
def table(spark, sf):
    return lambda name: spark.read.parquet(os.path.join(sf, f"{name}.parquet"))
