import random
import re

import xxhash

from civigrade.llm import simhash


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    found = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(rows):
    marks = [(doc_id, fingerprint(text)) for doc_id, text in rows]
    parent = list(range(len(marks)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(marks):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((doc_id, format(mark, "016x"), least.get(root(i))) for i, (doc_id, mark) in enumerate(marks)), key=repr)


def found(docs, **settings):
    return sorted((tuple(r) for r in simhash.clustered(docs, **settings).collect()), key=repr)


def test_odd_documents(odd_documents):
    expected = brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert found(odd_documents) == expected
    assert found(odd_documents, tree_nodes=1) == expected


def test_real_documents(sample):
    expected = brute([(r.doc_id, r.text) for r in sample.collect()])
    assert len({r[2] for r in expected}) < len(expected)
    assert found(sample) == expected


def test_empty_table(no_documents):
    assert found(no_documents) == []


def near_values(count, seed=3):
    """Fingerprints in clusters of one to three changed bits, and chains of single bits."""
    chance, values = random.Random(seed), set()
    for _ in range(count):
        value = chance.getrandbits(64)
        values.add(value)
        for _ in range(chance.randrange(6)):
            for _ in range(chance.randrange(1, 4)):
                value ^= 1 << chance.randrange(64)
            values.add(value)
    return sorted(values)


def test_tree_finds_what_a_scan_finds():
    values = near_values(300)
    tree = simhash.BKTree()
    for value in values:
        tree.add(value)
    for value in values[::7]:
        assert sorted(tree.within(value, 2)) == [i for i, v in enumerate(tree.values) if (v ^ value).bit_count() <= 2]


def roots_of(values, pairs):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = {}
    for v in values:
        groups.setdefault(root(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def test_trees_and_neighbours_connect_the_same(spark):
    values = near_values(150)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    expected = roots_of(signed, [(signed[i], signed[j]) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    for tree_nodes in (512, 3, 1):
        assert roots_of(signed, [(r.a, r.b) for r in simhash.links(table, len(values), tree_nodes).collect()]) == expected


def test_stars_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 5), (2000, 2001), (2001, 2000), (7, 7)]
    rows = simhash.stars(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.a: r.b for r in rows} == {**{i: 0 for i in range(1, 201)}, 1000: 0, 2001: 2000}


def test_one_of_each_group(odd_documents):
    kept = simhash.representatives(odd_documents)
    assert kept.columns == odd_documents.columns
    expected = brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({r[2] for r in expected}, key=repr)
