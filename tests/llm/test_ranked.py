import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from civigrade.llm import ranked
from civigrade.llm.catalog import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, limit):
    """Ranks of every item by the formula alone; (item_id, rank, doc_id, score)."""
    counts = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    counts = [(doc_id, c) for doc_id, c in counts if c]
    total, number, df = sum(c.total() for _, c in counts), len(counts), Counter(t for _, c in counts for t in c)
    result = []
    for item_id, text in items:
        asked = {t: math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) for t in set(terms_of(text)) if t in df}
        scored = []
        for doc_id, c in counts:
            m = 50 + 50 * c.total() * number // total
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        result += [(item_id, rank, None if nameless else doc_id, -score) for rank, (score, nameless, doc_id) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(result, key=str)


def found(docs, items, limit=50, part_terms=ranked.PART_TERMS, **options):
    rows = ranked.search(ranked.build(docs, part_terms), items, limit, **options)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.fixture(scope="module")
def items(spark, odd_documents):
    rows = [(1, "The FOX, the dog"), (2, "word5 and 7 again"), (2, "ñandú"), (None, "geese; geese bank"), (3, None), (4, ""), (5, "--- !"), (6, "absent"), (7, "ü 漢字 one two")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, score string")


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


@pytest.mark.parametrize("part_terms,first,limit", [(1 << 20, 4096, 50), (64, 1, 2)])
def test_odd_documents(odd_documents, items, monkeypatch, part_terms, first, limit):
    """Also with many parts in a stratum, and where most strata are only visited above a floor."""
    monkeypatch.setattr(ranked, "FIRST_VISIT", first)
    assert found(odd_documents, items, limit, part_terms) == brute(pairs(odd_documents, "doc_id", "text"), pairs(items, "item_id", "text"), limit)


def test_no_documents_and_no_items(odd_documents, no_documents, items):
    assert found(no_documents, items) == []
    assert found(odd_documents, items.filter("item_id < 0")) == []
    assert found(odd_documents, items.filter("item_id in (3, 4, 5, 6)")) == []


def test_real_documents_in_batches(spark, monkeypatch):
    monkeypatch.setattr(ranked, "FIRST_VISIT", 100)
    docs, items = (table(spark, "/root/testdata/sf0.001", name) for name in ("documents", "benchmark"))
    expected = brute(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"), 50)
    assert found(docs, items, part_terms=5_000, batch_bytes=2_000) == expected


def test_strata_under_the_floor_are_not_opened(spark):
    """A stratum whose bound lies below the floor has no visits; one that ties has."""
    docs = spark.createDataFrame([(i, "rare " * 9) for i in range(60)] + [(100 + i, "rare " + "common " * 200) for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare common")], "item_id long, text string")
    index = ranked.build(docs)
    assert index.strata.count() == 2 and {r.docs for r in index.strata.collect()} == {60}
    assert found(docs, items) == brute(pairs(docs, "doc_id", "text"), [(1, "rare common")], 50)


def test_impacts_and_parts(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("alpha beta beta gamma").alias("text"))
    index = ranked.build(docs.repartition(8), part_terms=100)
    assert index.strata.count() == 1 and index.parts.count() > 1 and (index.documents, index.terms) == (300, 1200)
    items = spark.createDataFrame([(1, "beta")], "item_id long, text string")
    assert [r[2] for r in sorted(found(docs, items), key=lambda r: r[1])] == list(range(50)) or found(docs, items) == []
