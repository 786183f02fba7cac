import hashlib

import numpy as np
from pyspark.sql import functions as F

from civigrade.llm import perfect_hash

BLANKS = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(BLANKS), []).append((-len(text or ""), doc_id is None, doc_id))
    result = []
    for doc_id, text in rows:
        own = (text or "").translate(BLANKS)
        keep = min(groups[own])[2]
        result.append((doc_id, keep, len(groups[own]), doc_id == keep, hashlib.sha256(own.encode()).hexdigest()))
    return sorted(result, key=repr)


def found(docs, historical, **settings):
    rows = perfect_hash.deduplicate(docs, historical, **settings).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows), key=repr)


def expected(docs):
    return sorted(((a, b, c, d if a is not None else b is None, e) for a, b, c, d, e in brute([(r.doc_id, r.text) for r in docs.collect()])), key=repr)


def test_any_split_gives_the_same_groups(odd_documents):
    wanted = expected(odd_documents)
    for historical in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0, F.col("lang") == "en"):
        assert found(odd_documents, historical) == wanted
    assert found(odd_documents, F.col("doc_id") > 5, shard_digests=2) == wanted


def test_real_documents(sample):
    assert found(sample, F.col("doc_id") < 80, shard_digests=16) == expected(sample)


def test_empty_table(no_documents):
    assert found(no_documents, F.lit(True)) == []


def test_members_are_told(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    rows = {r.doc_id: (r.keep_id, r.in_history) for r in perfect_hash.deduplicate(docs, F.col("doc_id") == 2).collect()}
    assert rows == {1: (1, True), 2: (1, True), 3: (3, False)}


def test_hash_is_minimal_and_perfect():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5_000)), np.uint8).reshape(-1, 32)
    levels, slots = perfect_hash.build(digests[:4_000])
    assert sorted(slots.tolist()) == list(range(4_000))
    assert (perfect_hash.slots_of(levels, digests)[:4_000] == slots).all()
    strangers = perfect_hash.slots_of(levels, digests)[4_000:]
    assert ((strangers >= -1) & (strangers < 4_000)).all()


def test_same_slot_but_other_bytes_is_no_member(spark):
    """With one digest in history every stranger whose bit is set lands in its slot; bytes decide."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    rows = perfect_hash.deduplicate(docs, F.col("doc_id") == 0).collect()
    assert all(r.group_size == 1 and r.keep_id == r.doc_id and r.in_history == (r.doc_id == 0) for r in rows)
