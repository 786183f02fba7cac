"""Named queries of the operators, with the SQL that must give the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civigrade.llm import containment, hilbert, layout, mixing, odd, perfect_hash, profiles, quality, ranked, repeats, simhash, token_lengths, whitening
from civigrade.llm.shipping import ship

#: Directory of vocabulary files on the driver; executors get the bytes.
TOKENIZERS = "/opt/tokenizers"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_quality_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of all documents under the model of trusted text, and whether their language's quantiles accept them."""
    return quality.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sixteen runs of the curve through language, source and size; the numbers of rows differ by one at most."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    rows = hilbert.by_metadata(hilbert.measured(docs).drop("text"))
    law = {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    return rows.withColumns(law).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve_index")


@query
def op3_token_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of encoded lengths of all documents by language, with the suffix sums for every context limit."""
    docs = table(spark, folder, "documents")
    lengths = token_lengths.with_length(docs, "text", f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", keep=["lang"])
    return token_lengths.histogram(lengths, ["lang"])


@query
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: those up to the middle doc_id are the history, the later ones the batch that is looked up in it."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    return perfect_hash.deduplicate(docs, F.col("doc_id") <= F.lit(middle).cast("long")).drop("in_history")


ORACLE["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT h, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY h
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the words of 13-word windows that a document with a smaller id has too."""
    kept = repeats.without_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE["op5_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM w, unnest(generate_series(1, len(words) - 12)) AS t(i)
), f AS (
  SELECT gram, min(doc_id) AS least FROM g GROUP BY gram
), removed AS (
  SELECT DISTINCT doc_id, i + k AS place FROM g JOIN f USING (gram), range(0, 13) AS t(k) WHERE least < doc_id
), kept AS (
  SELECT w.doc_id, p AS place, words[p] AS word FROM w, unnest(generate_series(1, len(words))) AS t(p)
), texts AS (
  SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.place) AS kept_text FROM kept k ANTI JOIN removed r ON k.doc_id = r.doc_id AND k.place = r.place GROUP BY k.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n_removed FROM removed GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM w LEFT JOIN counts USING (doc_id) LEFT JOIN texts USING (doc_id)
"""


@query
def op6_benchmark_containment(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of a document and a benchmark item of whose five-word shingles it holds at least four fifths."""
    return containment.contaminated_pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op6_benchmark_containment"] = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM t
), g AS (
  SELECT DISTINCT side, id, array_to_string(words[i:i + 4], ' ') AS gram FROM w, unnest(generate_series(1, greatest(1, len(words) - 4))) AS t(i) WHERE len(words) > 0
), n AS (
  SELECT id AS item_id, count(*) AS n_shingles FROM g WHERE side = 'i' GROUP BY id
), c AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM g d JOIN g i ON d.gram = i.gram AND d.side = 'd' AND i.side = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""


@query
def op7_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as often as the mixture holds them: every source at least once, none more often than the limit."""
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("n_tokens"), F.xxhash64("doc_id", "text").alias("draw_key"))
    return mixing.drawn(rows).drop("draw_key")


@query
def op9_layout_text(spark: SparkSession, folder: str) -> DataFrame:
    """The laid-out visible text of all pages."""
    return layout.with_text(table(spark, folder, "pages"), ["page_id", "url"])


@query
def op10_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The language of all documents; one document in four is held out from learning."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = profiles.learned(docs.filter(~held_out))
    return profiles.predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), found).drop("text")


@query
def op8_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return simhash.clustered(table(spark, folder, "documents"))


@query
def op11_odd_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Component of all documents under links of four fifths of their four-word shingles."""
    return odd.clustered(table(spark, folder, "documents"))


ORACLE["op11_odd_sketches"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
  ) AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS gram FROM w, unnest(generate_series(1, greatest(1, len(words) - 3))) AS t(i) WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n_shingles FROM g GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n_shingles + b.n_shingles - shared)
), reach AS (
  SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.reached = l.x
), named AS (
  SELECT doc_id, min(reached) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM named LEFT JOIN n USING (doc_id)
"""


@query
def op12_whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """All whole embeddings on their first four whitened components."""
    return whitening.whitened(table(spark, folder, "embeddings"))


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return ranked.search(ranked.build(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


ORACLE["op13_ranked_search"] = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT side, id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'
  )) AS term FROM t
), tf AS (
  SELECT id AS doc_id, term, count(*) AS tf FROM w WHERE side = 'd' GROUP BY ALL
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), total AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), m AS (
  SELECT doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM lengths, total
), df AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term
), asked AS (
  SELECT DISTINCT id AS item_id, term FROM w WHERE side = 'i'
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
), ranks AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranks WHERE rank <= 50
"""
