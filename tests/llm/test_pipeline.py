from collections import Counter

import corpus_pipeline
from civigrade.llm import quality
from civigrade.llm.catalog import table
from civigrade.session import materialise

FOLDER = "/root/testdata/sf0.01"


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_every_stage_on_its_own_input(spark):
    """Each stage against brute force on what the stage before has written."""
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "temperature_mixing", "hilbert_sharding"]
    written = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written[name] = materialise(stage(spark, docs, FOLDER), name)
        rows, old = docs.collect(), before.collect()
        if name != names[-1]:
            assert docs.columns == columns
        kept, given = Counter(tuple(r)[: len(columns)] for r in rows), Counter(map(tuple, old))
        if name == names[0]:
            accepted = {r.doc_id for r in quality.classified(before, table(spark, FOLDER, "labels")).filter("kept").collect()}
            assert kept == Counter(tuple(r) for r in old if r.doc_id in accepted) and 0 < len(rows) < len(old)
        if name == names[1]:
            from test_near import brute

            least = set(brute([(r.doc_id, r.text) for r in old]))
            assert kept == Counter(tuple(r) for r in old if r.doc_id in least) and len(rows) < len(old)
        if name == names[2]:
            items = [shingles(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
            clean = [r for r in old if not any(len(i & shingles(r.text)) >= 0.8 * len(i) for i in items)]
            assert kept == Counter(map(tuple, clean)) and len(clean) < len(old)
        if name == names[3]:
            assert set(kept) == set(given) and all(given[k] <= kept[k] <= 2 * given[k] for k in given)
        if name == names[4]:
            assert kept == given
            sizes = Counter(r["shard"] for r in rows)
            assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_odd_documents(spark, odd_documents):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert set(odd_documents.columns) <= set(docs.columns)
    assert docs.count() > 0


def test_empty_table(spark, no_documents):
    docs = no_documents
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, "/root/testdata/sf0.001"), name)
    assert docs.count() == 0
