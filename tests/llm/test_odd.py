import random

import numpy as np
import pyarrow as pa
import pytest

from civigrade.llm import odd, spans


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, size=odd.SHINGLE):
    """(doc_id, n_shingles, component_id, kept) of every row; all pairs compared."""
    sets = [shingles(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            small, large = sorted((len(one), len(sets[j])))
            if small and 5 * small >= 4 * large and root(i) != root(j):
                common = len(one & sets[j])
                if 5 * common >= 4 * (small + large - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc_id)
    names = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    found = [(doc_id, len(sets[i]), names[root(i)]) for i, (doc_id, _) in enumerate(rows)]
    return sorted(((*f, f[0] is not None and f[0] == f[2]) for f in found), key=str)


def found(docs, size=odd.SHINGLE):
    rows = odd.clustered(docs, size)
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_odd_and_no_documents(odd_documents, no_documents):
    assert found(odd_documents) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert found(no_documents) == []


@pytest.mark.parametrize("size", [4, 5])
def test_real_documents(sample, size):
    assert found(sample, size) == brute([(r.doc_id, r.text) for r in sample.collect()], size)


def edited(chance, words, most):
    words = list(words)
    for _ in range(chance.randrange(most + 1)):
        at = chance.randrange(len(words))
        words[at : at + chance.randrange(2)] = [f"n{chance.randrange(10**9)}"] * chance.randrange(3)
    return words


@pytest.mark.parametrize("crowd", [32, 3])
def test_crowds(spark, monkeypatch, crowd):
    """Copies with changed words around the limit, chains of copies, and different texts around one passage; also where all keys are crowded."""
    monkeypatch.setattr(odd, "CROWD", crowd)
    chance, texts = random.Random(crowd), []
    word = lambda: f"w{chance.randrange(5000)}"
    for size, copies, most in ((150, 150, 9), (40, 80, 3), (90, 60, 6)):
        center = [word() for _ in range(size)]
        texts += [edited(chance, center, most) for _ in range(copies)]
    chain = [word() for _ in range(120)]
    for _ in range(60):
        chain = edited(chance, chain, 3)
        texts.append(chain)
    passage = [word() for _ in range(60)]
    texts += [[word() for _ in range(chance.randrange(5, 80))] + passage for _ in range(120)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    chance.shuffle(rows)
    expected = brute(rows)
    assert 60 < len({r[2] for r in expected}) < len(rows) - 150
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == expected


def test_sketches_tell_the_similarity():
    """Bits in which sketches differ, at similarities of 0.8 and 0.3, for small and large sets; and all pairs at 0.8 share a key."""
    chance = random.Random(2)
    for share, low, high in ((0.8, 0, odd.FARTHEST), (0.3, odd.FARTHEST, odd.SKETCH_BITS)):
        for n in (9, 45, 900):
            for _ in range(60):
                common = round(2 * n * share / (1 + share))
                texts = [" ".join([f"c{i}" for i in range(common)] + [f"{side}{chance.random()}" for _ in range(n - common)]) for side in "xy"]
                _, sizes, keys, sketches = odd.set_marks(pa.array(texts), 1)
                assert sizes.tolist() == [n, n]
                assert low <= int(np.bitwise_count(sketches[0] ^ sketches[1]).sum()) <= high
                assert share < 0.8 or (keys[0] == keys[1]).any()


def test_structured_words_have_different_hashes():
    """A Thue-Morse word and its complement, which cancel in every polynomial modulo a power of two."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    for size in (8, 64, 1024, 1):
        texts = pa.array([word[:size] * (3 if size == 1 else 1), (word[:size] * (3 if size == 1 else 1)).translate(str.maketrans("ab", "ba")), word * 2])
        starts, ends, _ = spans.words(*spans.buffers(texts))
        for lane in (0, 1):
            assert len(set(spans.word_hashes(spans.buffers(texts)[1], starts, ends, lane).tolist())) == 3
    swapped = pa.array(["ab" * 8, "ba" * 8, "a" * 16, "a" * 17, "\x00", "\x00\x00"])
    starts, ends, _ = spans.words(*spans.buffers(swapped))
    assert len(set(spans.word_hashes(spans.buffers(swapped)[1], starts, ends).tolist())) == 6
