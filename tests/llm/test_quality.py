import math
import zlib
from collections import Counter, defaultdict

from civigrade.llm import quality
from civigrade.llm.catalog import table

FOLDER = "/root/testdata/sf0.001"


class Model:
    """The textbook form: recursive, one n-gram at a time."""

    def __init__(self, texts):
        self.counts = {5: Counter()}
        for text in texts:
            line = b"\0" * 4 + text
            self.counts[5].update(line[i : i + 5] for i in range(len(text)))
        for order in (4, 3, 2, 1):
            self.counts[order] = Counter(gram[1:] for gram in self.counts[order + 1])
        self.taken, self.after = {}, {}
        for order, counts in self.counts.items():
            n1, n2, n3, n4 = (sum(c == i for c in counts.values()) for i in (1, 2, 3, 4))
            if n1 and n2 and n3:
                y = n1 / (n1 + 2 * n2)
                raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
                self.taken[order] = [min(max(v, 0.05), i + 0.95) for i, v in enumerate(raw)]
            else:
                self.taken[order] = [0.5, 0.75, 0.9]
            self.after[order] = defaultdict(list)
            for gram, c in counts.items():
                self.after[order][gram[:-1]].append(c)

    def probability(self, gram):
        order = len(gram)
        if order == 0:
            return 1 / 256
        lower = self.probability(gram[1:])
        own = self.after[order].get(gram[:-1])
        if not own:
            return lower
        discount = lambda c: self.taken[order][min(c, 3) - 1]
        c = self.counts[order][gram]
        return ((c - discount(c)) if c else 0) / sum(own) + sum(map(discount, own)) / sum(own) * lower

    def perplexity(self, text):
        line = b"\0" * 4 + text
        return math.exp(-sum(math.log(self.probability(line[i : i + 5])) for i in range(len(text))) / len(text))


def test_perplexities_are_those_of_the_textbook_model(spark, sample):
    labels = table(spark, FOLDER, "labels")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    rows = sample.collect()
    model = Model([r.text.encode() for r in rows if r.text and r.doc_id in good and zlib.crc32(str(r.doc_id).encode()) % 5])
    out = {r.doc_id: r for r in quality.classified(sample, labels).collect()}
    assert len(out) == len(rows)
    for r in sorted(rows, key=lambda r: r.doc_id)[::9]:
        if r.text and len(r.text) < 20_000:
            assert abs(out[r.doc_id].perplexity / model.perplexity(r.text.encode()) - 1) < 1e-4
    assert sum(model.probability(b"the " + bytes([b])) for b in range(256)) - 1 < 1e-9


def test_probabilities_sum_to_one(spark, sample):
    """All 256 continuations of contexts, seen and unseen, through the sharded counts."""
    import numpy as np

    contexts = [b"the ", b"\0\0\0\0", b"zzzz", b"e th", b"\xc3\xa9 d"]
    grams = np.array([int.from_bytes(c + bytes([b]), "big") for c in contexts for b in range(256)], dtype=np.uint64)
    texts = [r.text.encode() for r in sample.collect() if r.text]
    model = Model(texts)
    orders = {o: (np.array(sorted(int.from_bytes(g, "big") for g in c), np.uint64), c) for o, c in model.counts.items()}
    own = {o: (keys, np.array([c[int(k).to_bytes(o, "big")] for k in keys])) for o, (keys, c) in orders.items()}
    two = quality.short_orders(list(zip(*[x.tolist() for x in own[1]])), list(zip(*[x.tolist() for x in own[2]])), model.taken)
    values = quality.probabilities(grams, own, two, model.taken).reshape(len(contexts), 256)
    assert np.allclose(values.sum(axis=1), 1)


def test_odd_documents(spark, odd_documents):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 9)] + [(1, 0, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.classified(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert (r.perplexity is None) == (r.n_bytes == 0)
        assert r.kept == (r.perplexity is not None and (r.limit is None or r.perplexity <= r.limit))
    kept = quality.accepted(odd_documents, labels)
    assert kept.columns == odd_documents.columns and kept.count() == sum(r.kept for r in rows)


def test_empty_tables(spark, sample, no_documents):
    labels = table(spark, FOLDER, "labels")
    assert quality.classified(no_documents, labels).count() == 0
    rows = quality.classified(sample, labels.filter("doc_id < 0")).collect()
    assert all(r.kept for r in rows if r.n_bytes) and all(abs(r.perplexity - 256) < 1e-3 for r in rows if r.n_bytes)


def test_trusted_text_is_kept_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = quality.classified(docs, labels).join(labels, "doc_id").collect()
    clean = [r.kept for r in out if r.quality == 1 and not r.toxic and r.n_bytes > 100]
    junk = [r.kept for r in out if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(junk) <= 0.4 * len(junk)


def test_rejection_rates_of_labelled_documents(spark):
    """Junk, toxic and clean documents of the largest tables; a limit wider than the quantile lets most toxic ones through."""
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    rejected = defaultdict(list)
    for r in quality.classified(table(spark, folder, "documents"), labels).join(labels, "doc_id").collect():
        rejected["toxic" if r.toxic else "clean" if r.quality == 1 else "junk"].append(not r.kept)
    rate = {kind: sum(values) / len(values) for kind, values in rejected.items()}
    assert rate["junk"] >= 0.88 and rate["toxic"] >= 0.4 and rate["clean"] <= 0.01
