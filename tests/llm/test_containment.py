import random

from civigrade.llm import containment
from civigrade.llm.catalog import table


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, items, threshold=0.8):
    result = []
    for doc_id, text in docs:
        own = shingles(text)
        for item_id, item in items:
            wanted = shingles(item)
            if wanted and len(wanted & own) >= threshold * len(wanted):
                result.append((doc_id, item_id, len(wanted), len(wanted & own)))
    return sorted(result, key=repr)


def found(docs, items):
    return sorted((tuple(r)[:4] for r in containment.contaminated_pairs(docs, items).collect()), key=repr)


def plain(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_odd_documents(spark, odd_documents):
    prose = odd_documents.first()["text"]
    rows = [(1, prose), (1, prose), (2, None), (3, ""), (None, "seven grey geese watch from afar"), (4, "one two"), (5, "one"), (6, "word3 and 3 word4 and 4 word5 and 5"), (7, "not there at all in any text")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    expected = brute(plain(odd_documents, "doc_id", "text"), rows)
    assert len(expected) > 10
    assert found(odd_documents, items) == expected


def test_real_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    expected = brute(plain(docs, "doc_id", "text"), plain(items, "item_id", "text"))
    assert expected
    assert found(docs, items) == expected


def test_recall_over_sizes_and_edits(spark):
    """Items of many sizes, whole or with a word changed, inside long documents: at least 0.99 of all pairs are found."""
    chance = random.Random(5)
    filler = [f"f{chance.randrange(4000)}" for _ in range(200_000)]
    items, docs = [], []
    for number in range(240):
        words = [f"i{number}x{k}" for k in range(chance.randrange(5, 140))]
        items.append((number, " ".join(words)))
        inside = list(words)
        if number % 2 and len(words) > 40:
            inside[len(words) // 2] = "changed"
        at = chance.randrange(len(filler) - 20_000)
        body = filler[at : at + chance.randrange(10, 20_000)]
        cut = chance.randrange(len(body))
        docs.append((number, " ".join(body[:cut] + inside + body[cut:])))
    expected = brute(docs, items)
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string"))
    assert set(got) <= set(expected) and len(expected) >= 200
    assert len(got) >= 0.99 * len(expected)


def test_chunks_of_items(spark, sample):
    items = table(spark, "/root/testdata/sf0.001", "benchmark")
    whole = found(sample, items)
    assert whole
    assert len([index for index, alone in containment.indexes(items, containment.SHINGLE, 1_000) if not alone]) > 1
    assert sorted((tuple(r)[:4] for r in containment.contaminated_pairs(sample, items, chunk_bytes=1_000).collect()), key=repr) == whole


def test_smallest_items_of_a_partition(spark):
    """Items just above a power of two with four fifths of their shingles inside a long document: the least similar case."""
    chance = random.Random(9)
    filler = [f"f{chance.randrange(9000)}" for _ in range(3_000)]
    items, docs = [], []
    for number in range(200):
        size = (17, 33, 65)[number % 3]
        words = [f"i{number}x{k}" for k in range(size + 4)]
        items.append((number, " ".join(words)))
        cut = chance.randrange(len(filler))
        docs.append((number, " ".join(filler[:cut] + words[: len(words) - size // 5] + filler[cut:])))
    expected = brute(docs, items)
    assert len(expected) == 200
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string"))
    assert set(got) <= set(expected) and len(got) >= 199


def test_empty_tables(spark, sample, no_documents):
    items = table(spark, "/root/testdata/sf0.001", "benchmark")
    assert found(no_documents, items) == []
    assert found(sample, items.filter("item_id < 0")) == []


def test_other_columns_stay(spark, odd_documents):
    items = spark.createDataFrame([(1, "seven grey geese watch from afar")], "item_id long, text string")
    kept = containment.without_contaminated(odd_documents, items)
    assert kept.columns == odd_documents.columns
    rows = kept.collect()
    assert {r["matches"] for r in rows} == {"m"}
    dirty = {r[0] for r in brute(plain(odd_documents, "doc_id", "text"), [(1, "seven grey geese watch from afar")])}
    assert len(rows) == sum(r["doc_id"] not in dirty or not r["text"] for r in odd_documents.collect())
