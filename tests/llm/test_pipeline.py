from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from provlake.llm import mixing, pii, simhash_trie, toxicity
from test_simhash import near, plain_components


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = [cp.documents(spark, sf)]
    for name, stage in cp.STAGES:
        out.append(cp.saved(stage(spark, out[-1], sf), f"test-{name}"))
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxicity_keeps_what_scores_below_half(spark, sf, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    want = sorted(r.doc_id for r in model.scored(stages[0], "_s").where(F.col("_s") < 0.5).collect())
    assert sorted(r.doc_id for r in stages[1].collect()) == want
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").join(stages[0], "doc_id").count()
    assert stages[1].join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0"), "doc_id").count() >= 0.97 * clean


def test_one_of_each_near_duplicate_group_stays(stages):
    rows = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    roots = plain_components([simhash_trie.fingerprint(r.text, 5) for r in rows], near)
    assert sorted(r.doc_id for r in stages[2].collect()) == [rows[i].doc_id for i in sorted(set(roots))]


def test_personal_data_goes(stages):
    before, after = {r.doc_id: r for r in stages[2].collect()}, {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for r in pii.with_spans(stages[2]).collect():
        text = r.text
        for s in reversed(r.pii):
            text = text[:s.start] + f"[{pii.KINDS[s.kind_no].upper()}]" + text[s.end:] if not any(o.start < s.start < o.end for o in r.pii) else text
        assert after[r.doc_id].text == text and after[r.doc_id].n_chars == len(text)


def test_mix_takes_what_the_plan_says(stages, split_words):
    plan = mixing.plan_mix(stages[3]).collect()
    got = Counter()
    for r in stages[4].collect():
        got[r.doc_id] += len(split_words(r.text))
    assert got == Counter({r.doc_id: r.passes * r["size"] + r.extra for r in plan if r.passes * r["size"] + r.extra})


def test_packing_holds_every_id(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4].collect():
        want[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, ends = Counter(), {}
    for r in stages[5].collect():
        got[r.doc_id] += r.length
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert got == want and max(ends.values()) <= 4096 and sum(ends.values()) == sum(want.values())


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs):
        n = docs.count()
        for name, stage in cp.STAGES:
            docs = cp.saved(stage(spark, docs, sf), f"test-{name}")
        assert docs.count() >= min(n, 1)
