"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through a whole number m, so documents are grouped by equal m: a stratum. Inside a stratum
a term's contribution depends on its frequency tf alone. Postings are therefore kept as runs of documents by (term, tf), and an
impact is worked out once for each tf of a stratum, not for each posting. The highest tf of each asked term gives every stratum an
upper bound for every item. Strata are visited in the order of their bounds: first those that hold ``FIRST_VISIT`` documents between
them; the score of the last result then is a floor, and the strata whose bound lies below the floor are never opened.

``build`` writes the index once: one row for each part of a stratum, with exact terms (bytes, no hashes). A stratum has as many
parts as its number of terms asks for, so a length that a third of all documents share is no hot group. There are at most
10 * sqrt(documents) strata, since m of them need that many documents of ever greater length; that bounds what is broadcast. Texts
never shuffle, only their distinct terms with counts. ``search`` takes items in batches of about ``BATCH_BYTES``; the terms and
weights of one batch are on the driver and broadcast, and no more.

Defined results: null and empty texts, and texts without a term, have no terms and are neither counted nor found; an item without
terms, or none of whose terms occurs, has no rows; each row of ``items`` is ranked by itself, also where ids repeat or are null;
repeated documents are found once each; equal scores are ordered by doc_id, null last; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civigrade.llm import spans, terms
from civigrade.llm.blocks import arrow_schema, spread, squeezed
from civigrade.session import materialise

LIMIT = 50
#: Terms, with repeats, that one part of a stratum is meant to hold.
PART_TERMS = 1 << 20
FIRST_VISIT = 4_096
BATCH_BYTES = 8 << 20
# Fixed values of the score.
SCALE, TF_WEIGHT, LENGTH_WEIGHT, LEAST_M, VARIABLE_M, TERM_WEIGHT = 1_000_000_000, 1000, 20, 50, 50, 1000
FORWARD = "stratum long, salt long, ids array<long>, sizes array<int>, tfs array<int>, terms binary"
INDEX = (
    "stratum long, part long, ids array<long>, n_terms long, terms_size long, terms binary, n_runs long, run_terms binary, run_tfs binary, "
    "run_sizes binary, n_postings long, postings binary"
)
FOUND = "item long, doc_id long, score long"
BOUNDS = "stratum long, term long, df long, top long"


@dataclass(frozen=True)
class Index:
    """``parts`` of strata with their postings, ``strata`` (stratum, docs, parts), and the numbers of documents and terms."""

    parts: DataFrame
    strata: DataFrame
    documents: int
    terms: int


def scanned(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, which of them are in terms, and first byte, end byte and row of every term."""
    offsets, data = spans.buffers(column)
    data = terms.LOWER[data]
    inside = terms.IN_TERM[data]
    return data, inside, *terms.runs(inside, offsets)


def lengths(docs: DataFrame) -> DataFrame:
    """How many documents have how many terms (n, docs); those without are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.sliced(batches, "text"):
            rows = scanned(batch.column("text"))[-1]
            n, count = np.unique(np.bincount(rows, minlength=1), return_counts=True)
            yield pa.RecordBatch.from_pydict({"n": pa.array(n[n > 0], pa.int64()), "docs": pa.array(count[n > 0], pa.int64())})

    return docs.select("text").mapInArrow(run, "n long, docs long").groupBy("n").agg(F.sum("docs").alias("docs"))


def normaliser(n, documents: int, total: int):
    """m of a document of n terms (numbers or arrays)."""
    return LEAST_M + (VARIABLE_M * n * documents) // total


def forward(docs: DataFrame, documents: int, total: int) -> DataFrame:
    """The distinct terms of all documents with their counts; one row for each slice of texts and stratum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() << 32
        for batch in spans.sliced(batches, "text"):
            salt += 1
            data, inside, starts, ends, rows = scanned(batch.column("text"))
            if not len(starts):
                continue
            codes, words = terms.encoded(data, inside, starts, ends)
            n = np.bincount(rows, minlength=batch.num_rows)
            m = normaliser(n, documents, total)
            order = np.lexsort((np.arange(len(n)), m))
            order = order[n[order] > 0]
            rank = np.zeros(len(n), dtype=np.int64)
            rank[order] = np.arange(len(order))
            pairs, tfs = np.unique(rank[rows] * len(words) + codes, return_counts=True)
            of_doc, of_word = np.divmod(pairs, len(words))
            heads = np.flatnonzero(np.diff(m[order], prepend=-1))
            sizes = np.bincount(of_doc, minlength=len(order))
            doc_edges, pair_edges = np.append(heads, len(order)), np.append(np.searchsorted(of_doc, heads), len(pairs))
            joined = pc.binary_join(pa.ListArray.from_arrays(pair_edges.astype(np.int32), words.take(pa.array(of_word))), b" ")
            yield pa.RecordBatch.from_pydict(
                {
                    "stratum": pa.array(m[order][heads]), "salt": pa.array(np.full(len(heads), salt)),
                    "ids": pa.ListArray.from_arrays(doc_edges.astype(np.int32), batch.column("doc_id").take(pa.array(order))),
                    "sizes": pa.ListArray.from_arrays(doc_edges.astype(np.int32), pa.array(sizes.astype(np.int32))),
                    "tfs": pa.ListArray.from_arrays(pair_edges.astype(np.int32), pa.array(tfs.astype(np.int32))), "terms": joined,
                }
            )

    return docs.mapInArrow(run, FORWARD)


def indexed(rows: pa.Table) -> pa.Table:
    """One part of a stratum: its documents by id, its terms in order, and runs of documents by (term, tf)."""
    stratum, part = rows["stratum"][0].as_py(), rows["part"][0].as_py()
    ids = pc.list_flatten(rows["ids"]).combine_chunks()
    sizes = pc.list_flatten(rows["sizes"]).to_numpy()
    tfs = pc.list_flatten(rows["tfs"]).to_numpy().astype(np.int64)
    found = terms.split_terms(rows["terms"].to_pylist()).dictionary_encode()
    by_word = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.zeros(len(by_word), dtype=np.int64)
    rank[by_word] = np.arange(len(by_word))
    codes = rank[found.indices.to_numpy(zero_copy_only=False)]
    by_id = pc.sort_indices(ids).to_numpy()
    place = np.zeros(len(by_id), dtype=np.int64)
    place[by_id] = np.arange(len(by_id))
    docs = np.repeat(place, sizes)
    order = np.lexsort((docs, tfs, codes))
    codes, tfs, docs = codes[order], tfs[order], docs[order]
    heads = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (tfs[1:] != tfs[:-1])))
    blob = b" ".join(found.dictionary.take(pa.array(by_word)).to_pylist())
    small = lambda values: squeezed(values.astype(np.int32))
    values = {
        "stratum": stratum, "part": part, "ids": ids.take(pa.array(by_id)).to_pylist(), "n_terms": len(by_word), "terms_size": len(blob),
        "terms": squeezed(np.frombuffer(blob, np.uint8)), "n_runs": len(heads), "run_terms": small(codes[heads]), "run_tfs": small(tfs[heads]),
        "run_sizes": small(np.diff(np.append(heads, len(docs)))), "n_postings": len(docs), "postings": small(docs),
    }
    return pa.Table.from_pylist([values], schema=arrow_schema(INDEX))


def build(docs: DataFrame, part_terms: int = PART_TERMS) -> Index:
    """The index of all ``docs`` (doc_id, text), written to the shared folder."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = materialise(lengths(docs), "lengths")
    documents, total = counted.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0))).first()
    m = F.expr(f"{LEAST_M} + ({VARIABLE_M} * n * {documents}L) div {max(total, 1)}L").alias("stratum")
    sized = counted.groupBy(m).agg(F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("docs")).alias("terms"))
    strata = materialise(sized.select("stratum", "docs", F.ceil(F.col("terms") / part_terms).alias("parts")), "strata")
    rows = forward(docs, documents, max(total, 1)).join(F.broadcast(strata.select("stratum", "parts")), "stratum")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("salt"), F.col("parts"))).drop("salt", "parts")
    return Index(materialise(dealt.groupBy("stratum", "part").applyInArrow(indexed, INDEX), "strata-parts"), strata, documents, total)


@dataclass(frozen=True)
class Batch:
    """Items of one batch: their distinct terms, and of each item the numbers of its terms."""

    words: list[bytes]
    asked: dict[int, np.ndarray]

    def places(self, part_terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(asked term, term of the part) for all asked terms that the part has."""
        found = pc.index_in(part_terms, value_set=pa.array(self.words, pa.binary()))
        own = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        return found.take(pa.array(own)).to_numpy(), own


class Part:
    """Postings of a row of the index."""

    def __init__(self, row: dict, batch: Batch):
        blob = spread(row["terms"], np.uint8, row["terms_size"]).tobytes()
        self.asked, self.own = batch.places(terms.split_terms([blob]))
        run_terms, self.tfs, self.sizes = (spread(row[name], np.int32, row["n_runs"]).astype(np.int64) for name in ("run_terms", "run_tfs", "run_sizes"))
        self.edges = np.searchsorted(run_terms, np.stack([self.own, self.own + 1]))


def bounds_of(index: Index, shared: Broadcast) -> DataFrame:
    """Of each stratum and asked term: its documents and its highest tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(row, shared.value)
                if not len(part.own):
                    continue
                low, high = part.edges
                before = np.concatenate([[0], np.cumsum(part.sizes)])
                numbers = {"stratum": np.full(len(low), row["stratum"]), "term": part.asked, "df": before[high] - before[low], "top": part.tfs[high - 1]}
                yield pa.RecordBatch.from_pydict({name: pa.array(values, pa.int64()) for name, values in numbers.items()})

    needed = index.parts.select("stratum", "n_terms", "terms_size", "terms", "n_runs", "run_terms", "run_tfs", "run_sizes")
    return needed.mapInArrow(run, BOUNDS).groupBy("stratum", "term").agg(F.sum("df").alias("df"), F.max("top").alias("top"))


def impact(tf, m):
    return (SCALE * tf) // (TF_WEIGHT * tf + LENGTH_WEIGHT * m)


def best_of(scores: np.ndarray, floor: int, limit: int) -> np.ndarray:
    """Places of the ``limit`` best scores of at least ``floor``; the documents lie in the order of ties."""
    able = np.flatnonzero(scores >= floor)
    if len(able) > limit:
        last = np.partition(scores[able], len(able) - limit)[len(able) - limit]
        able = able[scores[able] >= last]
        able = able[np.argsort(-scores[able], kind="stable")[:limit]]
    return able


def visited(index: Index, visits: DataFrame, shared: Broadcast, weights: Broadcast, limit: int) -> DataFrame:
    """The best documents of each part for each item that visits its stratum (stratum, item, floor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield searched(row)

    def searched(row: dict) -> pa.RecordBatch:
        part, w = Part(row, shared.value), weights.value
        by_tf, which = np.unique(part.tfs, return_inverse=True)
        impacts = impact(by_tf, row["stratum"])[which]
        postings = spread(row["postings"], np.int32, row["n_postings"])
        before = np.concatenate([[0], np.cumsum(part.sizes)])
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for term, low, high in zip(part.asked.tolist(), *part.edges.tolist()):
            lists[term] = postings[before[low] : before[high]], np.repeat(w[term] * impacts[low:high], part.sizes[low:high])
        found = [(np.zeros(0, np.int64),) * 3]
        for visit in row["visits"]:
            scores = np.zeros(len(row["ids"]), dtype=np.int64)
            for term in shared.value.asked[visit["item"]].tolist():
                if term in lists:
                    docs, added = lists[term]
                    scores[docs] += added
            best = best_of(scores, visit["floor"], limit)
            found.append((np.full(len(best), visit["item"]), best, scores[best]))
        items, best, scores = (np.concatenate(x) for x in zip(*found))
        ids = pa.array(row["ids"], pa.int64()).take(pa.array(best))
        return pa.RecordBatch.from_arrays([pa.array(items), ids, pa.array(scores)], names=["item", "doc_id", "score"])

    asked = visits.groupBy("stratum").agg(F.collect_list(F.struct("item", "floor")).alias("visits"))
    return index.parts.join(asked, "stratum").mapInArrow(run, FOUND)


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def item_terms(items: DataFrame) -> DataFrame:
    """Each item's distinct terms (item, item_id, item_terms: joined by one blank); ``item`` is a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.sliced(batches, "text"):
            data, inside, starts, ends, rows = scanned(batch.column("text"))
            blobs: list[set[bytes]] = [set() for _ in range(batch.num_rows)]
            if len(starts):
                codes, words = terms.encoded(data, inside, starts, ends)
                known = words.to_pylist()
                for row, code in zip(rows.tolist(), codes.tolist()):
                    blobs[row].add(known[code])
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([b" ".join(sorted(own)) for own in blobs], pa.binary())], names=["item_id", "item_terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "item_id long, item_terms binary")
    return materialise(found.filter("length(item_terms) > 0").withColumn("item", F.monotonically_increasing_id()), "items")


def search_batch(index: Index, batch: DataFrame, limit: int) -> DataFrame:
    """item, doc_id, score and rank of the best documents of each item of a batch."""
    context, spark = batch.sparkSession.sparkContext, batch.sparkSession
    own = {row["item"]: bytes(row["item_terms"]).split(b" ") for row in batch.select("item", "item_terms").collect()}
    words = sorted({word for found in own.values() for word in found})
    number = {word: i for i, word in enumerate(words)}
    asked = {item: np.array([number[word] for word in found], dtype=np.int64) for item, found in own.items()}
    shared = context.broadcast(Batch(words, asked))
    bounds = materialise(bounds_of(index, shared), "stratum-bounds")
    ratio = (F.lit(2.0) * index.documents + 2) / (F.lit(2.0) * F.sum("df") + 1)
    weighted = bounds.groupBy("term").agg(F.floor(TERM_WEIGHT * F.log(ratio)).cast("long").alias("w"))
    weight = np.zeros(len(words), dtype=np.int64)
    for term, w in weighted.collect():
        weight[term] = w
    weights = context.broadcast(weight)
    pairs = pa.table({"item": np.repeat(list(asked), [len(a) for a in asked.values()]), "term": np.concatenate(list(asked.values()))})
    known = spark.createDataFrame(pairs).join(weighted, "term")
    highest = F.expr(f"w * (({SCALE}L * top) div ({TF_WEIGHT}L * top + {LENGTH_WEIGHT}L * stratum))")
    limits = bounds.join(known, "term").groupBy("item", "stratum").agg(F.sum(highest).alias("bound")).filter("bound > 0")
    ahead = Window.partitionBy("item").orderBy(F.col("bound").desc(), "stratum").rowsBetween(Window.unboundedPreceding, -1)
    ordered = limits.join(index.strata.select("stratum", "docs"), "stratum").withColumn("ahead", F.coalesce(F.sum("docs").over(ahead), F.lit(0)))
    order = materialise(ordered, "visits")
    first = order.filter(F.col("ahead") < FIRST_VISIT).select("stratum", "item", F.lit(1).cast("long").alias("floor"))
    before = materialise(first_rows(visited(index, first, shared, weights, limit), limit), "first-found")
    floors = before.filter(F.col("rank") == limit).select("item", F.col("score").alias("floor"))
    rest = order.filter(F.col("ahead") >= FIRST_VISIT).join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
    later = visited(index, rest.filter("bound >= floor").select("stratum", "item", "floor"), shared, weights, limit)
    return first_rows(before.drop("rank").unionByName(later), limit)


def search(index: Index, items: DataFrame, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The ``limit`` best documents of every row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    asked = item_terms(items)
    size = asked.agg(F.coalesce(F.sum(F.length("item_terms")), F.lit(0))).first()[0]
    empty = items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if size == 0 or index.documents == 0:
        return empty
    batches = -(-size // batch_bytes)
    result = empty
    for number in range(batches):
        batch = asked.filter(F.pmod(F.xxhash64("item"), F.lit(batches)) == number)
        if batches > 1 and batch.isEmpty():
            continue
        found = search_batch(index, batch, limit).join(asked.select("item", "item_id"), "item")
        result = result.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return result
