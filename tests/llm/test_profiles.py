from collections import Counter

from pyspark.sql import functions as F

from civigrade.llm import profiles
from civigrade.llm.catalog import QUERIES


def ranked(text, limit):
    """N-grams of one to three letters, most frequent first, blanks only at their ends."""
    folded = []
    for letter in text or "":
        low = letter.lower()
        folded.append((low if len(low) == 1 and low.isalpha() else letter) if letter.isalpha() else " ")
    line = " " + " ".join("".join(folded).split()) + " "
    if not line.strip():
        return []
    counts = Counter()
    for order in (1, 2, 3):
        for i in range(len(line) - order + 1):
            gram = line[i : i + order]
            if gram.strip() and " " not in gram[1:-1]:
                counts[gram] += 1
    key = lambda gram: sum(ord(c) << (21 * (len(gram) - 1 - i)) for i, c in enumerate(gram))
    return sorted(counts, key=lambda gram: (-counts[gram], key(gram)))[:limit], counts


def brute(train, rows, limit):
    totals = {}
    for text, lang in train:
        if lang is not None and ranked(text, limit):
            totals.setdefault(lang, Counter()).update(ranked(text, limit)[1])
    key = lambda gram: sum(ord(c) << (21 * (len(gram) - 1 - i)) for i, c in enumerate(gram))
    orders = {lang: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], key(g)))[:limit])} for lang, c in totals.items()}
    result = []
    for text in rows:
        own = ranked(text, limit)
        if not own or not orders:
            result.append(("und", 0.0))
            continue
        distance = {lang: sum(abs(i - order[g]) if g in order else limit for i, g in enumerate(own[0])) for lang, order in orders.items()}
        best = min(sorted(distance), key=distance.get)
        result.append((best, 1 - distance[best] / (len(own[0]) * limit)))
    return result


def compare(docs, limit):
    rows = [(r.text, r.lang) for r in docs.collect()]
    out = profiles.predicted(docs, profiles.learned(docs, limit), limit).collect()
    expected = brute(rows, [text for text, _ in rows], limit)
    assert [r.lang_pred for r in out] == [e[0] for e in expected]
    assert all(abs(r.score - e[1]) < 1e-9 for r, e in zip(out, expected))


def test_odd_documents(odd_documents):
    compare(odd_documents.coalesce(1), 300)
    out = profiles.predicted(odd_documents, {"en": [101], "fr": [101]}, 300)
    assert out.columns == [*[c for c in odd_documents.columns if c != "score"], "lang_pred", "score"]
    for row in out.collect():
        assert row["lang_pred"] == ("en" if row["text"] and any(c.isalpha() for c in row["text"]) else "und")


def test_real_documents(sample):
    compare(sample.coalesce(1), 120)


def test_empty_table_and_no_profile(odd_documents, no_documents):
    assert profiles.learned(no_documents) == {}
    assert profiles.predicted(no_documents, {}).count() == 0
    assert {r.lang_pred for r in profiles.predicted(odd_documents, {}).collect()} == {"und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op10_language_profiles"](spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("d"), "lang", "n_chars")
    tested = out.join(truth, F.col("doc_id") == F.col("d")).filter("held_out AND n_chars >= 50")
    right, all_rows = tested.filter("lang = lang_pred").count(), tested.count()
    assert all_rows > 150 and right >= 0.97 * all_rows
    assert out.filter("score < 0 OR score > 1").count() == 0
