"""Exact token counts from a histogram of encoded lengths.

Documents are encoded with a given vocabulary and only their lengths leave the task. One aggregate counts documents per group and
length; suffix sums over the histogram then answer every context limit: how many documents are at least so long, how many tokens
they hold, and how many tokens remain when all are cut at the limit. Quantiles are read from the same sums.

The histogram is small by itself: d distinct lengths need d * (d - 1) / 2 tokens. Its suffix sums still run in two steps, inside
bins of ``BIN`` lengths and over the bins, so no task has to sort all lengths.

Defined results: null and empty texts have length 0 and are counted; an empty table gives no rows; a null group is a group; all
columns but the text and the group are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civigrade.llm.spans import sliced
from civigrade.session import materialise

BIN = 1_024
MAX_VOCABULARY_BYTES = 64 << 20
#: Splitting pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def encoder(vocabulary: bytes, pattern: str):
    """The byte-pair encoder of a vocabulary file (lines of base64 token and rank), made once per worker."""
    key = hash((vocabulary, pattern))
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def vocabulary_file(path: str) -> bytes:
    """The vocabulary as the driver reads it; it goes to the executors, which need not have the file."""
    if Path(path).stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return Path(path).read_bytes()


def with_length(docs: DataFrame, text: str, vocabulary: str, keep: Sequence[str] = (), pattern: str = PATTERN) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` for every row; whole texts are encoded."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value, pattern).encode_ordinary
        for batch in sliced(batches, "encoded_text"):
            lengths = [len(encode(text)) if text else 0 for text in batch.column("encoded_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lengths, pa.int64())], names=[*batch.schema.names[1:], "n_tokens"])

    source = docs.select(F.make_valid_utf8(F.col(text)).alias("encoded_text"), *keep)
    schema = source.drop("encoded_text").schema.add("n_tokens", "long")
    return source.mapInArrow(run, schema)


def histogram(lengths: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Suffix sums per group and length.

    Columns: the groups, n_tokens, n_docs, docs_at_least and tokens_at_least (of all documents of this length or more), docs_total,
    tokens_total, tokens_truncated (left when every document is cut at n_tokens) and share_up_to (documents of at most this length).
    """
    counted = materialise(lengths.groupBy(*groups, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    binned = counted.withColumn("bin", F.col("n_tokens") - F.col("n_tokens") % BIN)
    tokens = F.col("n_docs") * F.col("n_tokens")
    own = Window.partitionBy(*groups, "bin").orderBy(F.col("n_tokens").desc())
    inside = binned.withColumns({"docs_in_bin": F.sum("n_docs").over(own), "tokens_in_bin": F.sum(tokens).over(own)})
    bins = binned.groupBy(*groups, "bin").agg(F.sum("n_docs").alias("bin_docs"), F.sum(tokens).alias("bin_tokens"))
    longer = Window.partitionBy(*groups).orderBy(F.col("bin").desc())
    whole = Window.partitionBy(*groups)
    bins = bins.withColumns(
        {
            "docs_total": F.sum("bin_docs").over(whole),
            "tokens_total": F.sum("bin_tokens").over(whole),
            "docs_longer": F.sum("bin_docs").over(longer) - F.col("bin_docs"),
            "tokens_longer": F.sum("bin_tokens").over(longer) - F.col("bin_tokens"),
        }
    )
    bins = bins.select(*[F.col(g).alias(f"bin_{g}") for g in groups], F.col("bin").alias("of_bin"), "docs_total", "tokens_total", "docs_longer", "tokens_longer")
    same = F.col("bin") == F.col("of_bin")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"bin_{g}"))
    joined = inside.join(bins, same)
    docs_at_least = F.col("docs_in_bin") + F.col("docs_longer")
    tokens_at_least = F.col("tokens_in_bin") + F.col("tokens_longer")
    return joined.select(
        *groups,
        "n_tokens",
        "n_docs",
        docs_at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - tokens_at_least + F.col("n_tokens") * docs_at_least).alias("tokens_truncated"),
        ((F.col("docs_total") - docs_at_least + F.col("n_docs")) / F.col("docs_total")).alias("share_up_to"),
    )


def truncated_totals(lengths: DataFrame, limits: Sequence[int], groups: Sequence[str] = ()) -> DataFrame:
    """Tokens left per group for each of the given context limits, also for limits that no document has as its length.

    The shortest length at or above a limit holds all suffix sums that the limit needs; beyond the longest one nothing is cut.
    """
    sums = histogram(lengths, groups)
    reached = F.when(F.col("n_tokens") >= F.col("context_limit"), F.col("n_tokens"))
    rows = sums.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    best = rows.groupBy(*groups, "context_limit").agg(
        F.max("tokens_total").alias("tokens_total"),
        F.min_by(F.struct("docs_at_least", "tokens_at_least"), reached).alias("above"),
    )
    cut = F.coalesce(F.col("above.tokens_at_least") - F.col("context_limit") * F.col("above.docs_at_least"), F.lit(0))
    return best.select(*groups, "context_limit", "tokens_total", (F.col("tokens_total") - cut).alias("tokens_left"))


def quantiles(lengths: DataFrame, shares: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """The smallest length that at least the given share of each group's documents does not exceed."""
    rows = histogram(lengths, groups).withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    reached: Column = F.when(F.col("share_up_to") >= F.col("share"), F.col("n_tokens"))
    return rows.groupBy(*groups, "share").agg(F.min(reached).alias("n_tokens"))
