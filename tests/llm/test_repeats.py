import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from civigrade.llm import repeats, spans
from civigrade.llm.repeats import levels, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept) of every row, window by window."""
    split = [(doc_id, WORD.findall(text or "")) for doc_id, text in rows]
    order = [(float("inf") if doc_id is None else doc_id, words) for doc_id, words in split]
    first = {}
    for doc_id, words in order:
        for i in range(len(words) - window + 1):
            gram = tuple(words[i : i + window])
            first[gram] = min(first.get(gram, float("inf")), doc_id)
    result = []
    for (doc_id, words), (rank, _) in zip(split, order):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < rank:
                gone.update(range(i, i + window))
        result.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(result, key=repr)


def found(docs, **settings):
    return sorted((tuple(r) for r in without_repeats(docs, **settings).collect()), key=repr)


def test_levels():
    assert levels(13, 7) == [7, 13]
    assert levels(13, 3) == [3, 6, 12, 13]
    assert levels(5, 8) == [5]


def test_odd_documents(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found(odd_documents) == brute(rows, 13)
    assert found(odd_documents, window=6, shortest=2, bucket_hashes=500) == brute(rows, 6)


def test_real_documents(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    expected = brute(rows, 13)
    assert any(r[2] for r in expected)
    assert found(sample, bucket_hashes=1_000) == expected
    assert found(sample, shortest=4) == expected


def test_empty_table(no_documents):
    assert found(no_documents) == []


def test_shared_passage_in_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} " * 5 + passage + f" tail{i}" * 5) for i in range(300)]
    result = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(r[2] for r in result) == [0] + [60] * 299


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ñ\t\n漢", max_size=30), min_size=1, max_size=6))
def test_words_of_a_column(texts):
    import pyarrow as pa

    offsets, data = spans.buffers(pa.array(texts))
    starts, ends, rows = spans.words(offsets, data)
    assert [(int(r), data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, rows)] == [(r, w) for r, t in enumerate(texts) for w in WORD.findall(t)]
    hashes = spans.word_hashes(data, starts, ends)
    names = {}
    for h, a, b in zip(hashes.tolist(), starts, ends):
        assert names.setdefault(h, data[a:b].tobytes()) == data[a:b].tobytes()


def test_scaled_keeps_order_and_bucket():
    values = np.sort(spans.mixed(np.arange(10_000, dtype=np.uint64)))
    parts = repeats.scaled(values, 37)
    assert (np.diff(parts.astype(object)) >= 0).all() and (parts >> np.uint64(32)).max() == 36


def test_query_digest(spark):
    from civigrade.llm.catalog import QUERIES

    row = QUERIES["op5_substring_dedup"](spark, "/root/testdata/sf0.001").first()
    assert re.fullmatch("[0-9a-f]{64}", row["kept_sha256"]) and hashlib.sha256(b"").digest_size == 32


def test_words_that_cancel_in_polynomials(spark):
    """Windows that differ in one long structured word (a Thue-Morse word and its complement) are different windows."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.without_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}
