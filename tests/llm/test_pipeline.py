"""The pipeline's stages, each against what its operator says of its own input; registered queries and their SQL."""

import itertools

import compare
import corpus_pipeline
import pytest
from fixtures import docs, nothing

import __spark_entry__ as entry
from sparkplume.llm import decontaminate, pii, quality, queries
from sparkplume.llm.language import held_out
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute_force_kept(texts, limit):
    """The smallest id of each group of texts that are linked at the limit, by all pairs."""
    sets = {}
    for i, text in texts.items():
        words = [w.decode() for w in (text or "").encode().lower().split()]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        one, other = sets[a], sets[b]
        both = len(one & other)
        if one and other and limit[1] * both >= limit[0] * (len(one) + len(other) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i for i in sets if find(i) == i}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name != "bpe_encoding":
            assert after.columns == columns
        kept[name] = (before, after := after.cache())
        before = after
    ids = {n: ({r.doc_id for r in b.collect()}, {r.doc_id for r in a.collect()}) for n, (b, a) in kept.items()}

    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~held_out(F.col("doc_id"), 4, 2))
    judged = quality.score(docs, quality.train(docs, labels)).where("score >= 0.7").collect()
    assert ids["quality_classifier"][1] == {r.doc_id for r in judged}
    before = {r.doc_id: r.text for r in kept["minhash_near_dedup"][0].collect()}
    assert ids["minhash_near_dedup"][1] == brute_force_kept(before, corpus_pipeline.NEAR_LIMIT)
    bad = decontaminate.contamination(kept["benchmark_decontamination"][0], spark.read.parquet(f"{SF}/benchmark.parquet"))
    gone = {r.doc_id for r in bad.where("contaminated").collect()}
    assert ids["benchmark_decontamination"][1] == ids["benchmark_decontamination"][0] - gone
    texts = {r.doc_id: r.text for r in kept["pii_redaction"][0].collect()}
    for r in kept["pii_redaction"][1].collect():
        assert not pii.base_matches(r.text)[0] and r.n_chars == len(r.text)
        if not pii.base_matches(texts[r.doc_id])[0]:
            assert r.text == texts[r.doc_id]
    assert ids["pii_redaction"][0] == ids["pii_redaction"][1] == ids["bpe_encoding"][1]
    run = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r.n_tokens) for r in run.collect()} == {(r.doc_id, r.n_tokens) for r in kept["bpe_encoding"][1].collect()}


def test_stages_on_an_empty_table(spark):
    docs = nothing(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_registered(spark):
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    assert compare.differences(queries.QUERIES[name](spark, SF), compare.connect(SF), queries.ORACLE[name]) == []


def test_stages_on_odd_rows(spark):
    """Null ids, null and empty texts, copies, repeated rows, a long text and clashing columns, stage by stage."""
    before = docs(spark)
    columns, given = before.columns, before.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns
        found = after.collect()
        assert {r.id for r in found} <= {r.id for r in given}
        own = {r.id: r for r in found}
        if name == "minhash_near_dedup":
            assert len({r.doc_id for r in found if r.doc_id is not None}) == len([r for r in found if r.doc_id is not None])
            assert sum(r.doc_id is None for r in found) == sum(r.doc_id is None for r in given)
            assert {1, 6, 7, 8} <= {r.doc_id for r in found} and 2 not in {r.doc_id for r in found}
        elif name == "benchmark_decontamination":
            assert all(r.id in own for r in given if not (r.text or "").strip())
        elif name == "pii_redaction":
            assert len(found) == len(given) and all((own[r.id].text is None) == (r.text is None) for r in given)
    tokens = corpus_pipeline.tokenize(spark, before, SF).collect()
    assert len(tokens) == len(given)
    assert all(r.n_tokens == 0 for r in tokens if r.doc_id in (6, 7))
