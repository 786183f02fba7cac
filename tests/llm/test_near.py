import random

import pytest

from civigrade.llm import near, odd
from civigrade.llm.blocks import pack
from civigrade.llm.catalog import table


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """The smallest doc_id of every component under Jaccard 0.8, all pairs compared."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if 5 * small >= 4 * large:
                common = len(sets[i] & sets[j])
                if sets[i] == sets[j] or 5 * common >= 4 * (small + large - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        own = (doc_id is None, doc_id or 0)
        least[root(i)] = min(least.get(root(i), own), own)
    return sorted(None if nameless else doc_id for nameless, doc_id in least.values() if not nameless) + [None] * sum(n for n, _ in least.values())


def kept(docs):
    ids = [r.doc_id for r in near.representatives(docs).collect()]
    return sorted(i for i in ids if i is not None) + [None] * ids.count(None)


def test_odd_and_no_documents(odd_documents, no_documents):
    assert near.representatives(odd_documents).columns == odd_documents.columns
    assert kept(odd_documents) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert kept(no_documents) == []


def test_real_documents(odd_documents, spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert kept(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("crowd", [32, 2])
def test_copies_with_changed_words(spark, odd_documents, monkeypatch, crowd):
    """Copies around the limit, far beyond two bits of a fingerprint, and chains of them; also where all keys are crowded."""
    monkeypatch.setattr(odd, "CROWD", crowd)
    chance, rows = random.Random(7), []
    for _ in range(12):
        words = [f"w{chance.randrange(5000)}" for _ in range(chance.randrange(40, 160))]
        for _ in range(chance.randrange(2, 9)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(chance.randrange(4)):
                words[chance.randrange(len(words))] = "changed"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert 12 < len(expected) < len(rows)
    assert kept(docs) == expected


def test_fingerprints_link_what_words_confirm(spark, monkeypatch):
    """The stage's SimHash step on its own: nearly identical texts are linked without any band key, unlike ones never."""
    chance = random.Random(3)
    words = [f"w{chance.randrange(5000)}" for _ in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(f"v{i}" for i in range(400))), (4, None), (5, "a b"), (6, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = pack(docs)
    sets = odd.distinct_sets(odd.marked(blocks, near.SHINGLE))
    ids = {r.node: r.doc_id for r in sets.select("node", "own.doc_id").collect()}
    assert [{ids[r.a], ids[r.b]} for r in near.simhash_links(blocks, sets).collect()] == [{1, 2}]
    monkeypatch.setattr(odd, "linked", lambda blocks, sets, shingle: spark.createDataFrame([], "a long, b long"))
    assert kept(docs) == [1, 3, 4, 5, 6]
