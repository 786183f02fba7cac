import base64

import pytest
import tiktoken

from civigrade.llm import token_lengths
from civigrade.llm.catalog import TOKENIZERS

FILE = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def encode():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=token_lengths.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def rows_of(docs, encode):
    return [(r.lang, len(encode(r.text or ""))) for r in docs.collect()]


def test_lengths_and_sums(odd_documents, encode):
    lengths = token_lengths.with_length(odd_documents, "text", FILE, ["lang"])
    expected = rows_of(odd_documents, encode)
    assert sorted(map(tuple, lengths.collect()), key=repr) == sorted(expected, key=repr)
    for row in token_lengths.histogram(lengths, ["lang"]).collect():
        own = [n for lang, n in expected if lang == row["lang"]]
        at = row["n_tokens"]
        assert row["n_docs"] == own.count(at)
        assert row["docs_at_least"] == sum(n >= at for n in own) and row["tokens_at_least"] == sum(n for n in own if n >= at)
        assert (row["docs_total"], row["tokens_total"]) == (len(own), sum(own))
        assert row["tokens_truncated"] == sum(min(n, at) for n in own)
        assert abs(row["share_up_to"] - sum(n <= at for n in own) / len(own)) < 1e-12


def test_limits_and_quantiles(sample, encode):
    lengths = token_lengths.with_length(sample, "text", FILE)
    own = [n for _, n in rows_of(sample, encode)]
    limits = [0, 1, 7, 100, 1024, 2048, 10**7]
    got = {r.context_limit: r.tokens_left for r in token_lengths.truncated_totals(lengths, limits).collect()}
    assert got == {x: sum(min(n, x) for n in own) for x in limits}
    shares = [0.01, 0.5, 0.9, 1.0]
    found = {r.share: r.n_tokens for r in token_lengths.quantiles(lengths, shares).collect()}
    assert found == {s: min(n for n in own if sum(m <= n for m in own) / len(own) >= s) for s in shares}


def test_empty_table(no_documents):
    assert token_lengths.histogram(token_lengths.with_length(no_documents, "text", FILE)).count() == 0


def test_query_holds_every_document(spark):
    from civigrade.llm.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op3_token_lengths"](spark, folder).collect()
    assert sum(r.n_docs for r in rows) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_too_large_vocabulary_is_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(token_lengths, "MAX_VOCABULARY_BYTES", 3)
    (tmp_path / "v").write_bytes(b"12345")
    with pytest.raises(ValueError):
        token_lengths.vocabulary_file(str(tmp_path / "v"))
