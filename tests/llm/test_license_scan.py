import random
import re

import pytest

from provlake.llm import license_scan as scan
from provlake.llm.license_texts import BASE, NOTICES


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base_places(words):
    return sorted((i, label) for label, phrase in BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p)


LONG = {label: text.split() for label, text in NOTICES if len(text.split()) >= scan.NEAR_FROM}


@pytest.fixture(scope="module")
def planted():
    """(text, labels that must be found, labels that must not)."""
    rnd = random.Random(4)
    noise = lambda n: [rnd.choice(["the", "of", "license", "software", "foo", "and", "to", "copy"]) for _ in range(n)]
    out = []
    for label, words in LONG.items():
        changed = list(words)
        for i in range(6, len(words), 20):  # a word in twenty differs
            changed[i] = "another"
        longer = [*words[:11], "very", "new", *words[11:]]
        shorter = words[:9] + words[11:]
        for w in (words, changed, longer, shorter):
            out.append((" ".join(noise(40) + w + noise(40)).title(), {label}, set()))
        half = words[:len(words) // 2]
        out.append((" ".join(noise(60) + half + noise(30)), set(), {label} - {name for _, name in base_places(half)}))
    for label, text in NOTICES:
        words = text.split()
        if len(words) < scan.NEAR_FROM:
            out.append((" - ".join(noise(9) + words + ["end"]), {label}, set()))
            out.append((" ".join([*words[:-1], "other", words[-1]]), set(), {label}))
    out.append(("Under the MIT License. " * 300, {"mit"}, set()))
    out.append(("licensed under CC-BY-NC 4.0; CC BY NC", {"cc-by-nc"}, {"cc-by"}))
    out.append(("a creative commons attribution sharealike 4.0 international license", set(), {"cc-by", "cc-by-sa"}))
    out.append(("Under the \u212aMIT license, under the M\u0130T license", set(), {"mit"}))
    return out


def test_places_and_labels(spark, planted, odd_docs, odd_rows, table):
    texts = [t for t, _, _ in planted] + [r[1] for r in odd_rows] + [r.text for r in table("documents").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in scan.labelled(scan.spans(scan.hits(docs))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, words = got[i], plain_words(t)
        places = base_places(words)
        assert (r.n_words, r.n_base) == (len(words), len(places)), t
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        labels = set(r.labels.split(",")) - {""}
        assert labels >= {label for _, label in places} and 0 <= r.score <= 1 and (not labels or r.score >= scan.LEAST_SHARE)
    for i, (t, must, never) in enumerate(planted):
        labels = set(got[i].labels.split(","))
        assert must <= labels and not never & labels, (t, got[i])


def test_spans_name_their_words(spark):
    words = LONG["mit"]
    text = " ".join(["before"] * 7 + words[:30] + ["extra"] + words[30:] + ["after"] * 5)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = [r for r in scan.spans(scan.hits(docs)).collect() if r.verified]
    assert [(r.label, r.first_word, r.last_word, r.share) for r in found] == [("mit", 7, 7 + len(words), 1.0)]


def test_edge_cases(spark, odd_docs, odd_rows, no_docs):
    rows = scan.labelled(scan.spans(scan.hits(odd_docs))).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)
    assert [(r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in rows if r.doc_id in (1, 2)] == [(0, 0, None, "", 0.0)] * 2
    assert scan.labelled(scan.spans(scan.hits(no_docs))).count() == 0


def test_query_matches_sql(spark, sf):
    import oracle

    from provlake.llm import ORACLES, QUERIES

    assert oracle.compare(spark, oracle.connect(sf), "op11", QUERIES["op11_license_scan"], ORACLES["op11_license_scan"], sf) == ""


def test_no_python_in_the_plan(spark, sf, capsys):
    from provlake.llm import QUERIES

    QUERIES["op11_license_scan"](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "ExistingRDD" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # everything after the hits stays at the document's row number
