import zlib
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from civigrade.llm import hilbert


def curve_points(n, bits):
    """All points in curve order, by walking the curve recursively with the Gray code of its sub-cubes."""
    seen = {}

    def index_of(point):
        x = list(point)
        q = 1 << (bits - 1)
        while q > 1:
            for i in range(n):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= t
                    x[i] ^= t
            q >>= 1
        for i in range(1, n):
            x[i] ^= x[i - 1]
        t, q = 0, 1 << (bits - 1)
        while q > 1:
            t ^= q - 1 if x[n - 1] & q else 0
            q >>= 1
        place = 0
        for level in range(bits - 1, -1, -1):
            for value in x:
                place = 2 * place + (((value ^ t) >> level) & 1)
        return place

    for point in product(range(1 << bits), repeat=n):
        seen[point] = index_of(point)
    return seen


def test_index_visits_every_cell_in_unit_steps(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        expected = curve_points(n, bits)
        rows = spark.createDataFrame(list(expected), ", ".join(f"c{i} int" for i in range(n)))
        got = {tuple(r[:n]): r["h"] for r in rows.withColumn("h", hilbert.curve_index([F.col(f"c{i}") for i in range(n)], bits)).collect()}
        assert got == expected
        path = sorted(got, key=got.get)
        assert sorted(got.values()) == list(range(len(got)))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def check_shards(rows, docs, shards):
    assert len(rows) == len(docs)
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per.get(s, 0) for s in range(shards)) <= 1
    for shard in per:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(per[shard]))
    ranked = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in ranked] == sorted(r["curve_index"] for r in rows)


def test_odd_documents(odd_documents):
    docs = odd_documents.collect()
    out = hilbert.document_shards(odd_documents, 4)
    assert set(out.columns) == {*odd_documents.columns, "text_crc32", "curve_index"}
    rows = out.collect()
    check_shards(rows, docs, 4)
    assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in docs)
    assert Counter(r["matches"] for r in rows) == Counter(r["matches"] for r in docs)
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


def test_more_shards_than_rows(spark):
    docs = spark.createDataFrame([(1, "a", "en", "x"), (2, "b", "de", "y")], "doc_id long, text string, lang string, source string")
    rows = hilbert.document_shards(docs, 16).collect()
    assert len({r["shard"] for r in rows}) == 2 and {r["slot"] for r in rows} == {0}


def test_empty_table(no_documents):
    assert hilbert.document_shards(no_documents).count() == 0


def test_boxes_prune(sample):
    """A filter on one dimension skips most shards of the curve, and more than shards cut by id do."""
    rows = hilbert.document_shards(sample)
    boxes = hilbert.file_boxes(rows, ["lang", "size"]).collect()
    read = sum(b["least_size"] <= 300 for b in boxes)
    assert read < 16 and sum(b["n_rows"] for b in boxes) == sample.count()


def test_written_files(sample, tmp_path, spark):
    rows = hilbert.document_shards(sample)
    hilbert.write_shards(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    key = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, rows.select(*key).collect()))


def test_text_order(cells):
    values = ["", "a", "ab", "b", "zebra12", "zebra13", "ä"]
    numbers = cells(hilbert.text_order, values)
    assert numbers == sorted(numbers)
