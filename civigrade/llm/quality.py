"""Quality classification with an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are UTF-8 bytes and its order is five, so an n-gram is an exact 40-bit number. It is counted over every trusted
document (labelled good and not toxic). Counts of lower orders are continuation counts, discounts come from the counts of counts of
each order, and all orders interpolate down to the uniform distribution.

Scoring joins the corpus with the sharded counts: each block of documents sends its distinct n-grams to the shards that hold their
counts (an n-gram, all its shorter endings and all its contexts share the two bytes before the last, which decide the shard), gets
one log probability per n-gram back, and adds them up along its texts. Neither texts nor single occurrences are shuffled; only
orders one and two are sent to every task, at most 256 + 65,536 numbers.

One trusted document in ``CALIBRATION_FOLDS`` teaches nothing; the perplexities of these documents give each language its own
quantile, by length, since short texts scatter more. A document is rejected when its perplexity lies above that quantile.

Defined results: a null or empty text has no perplexity and is rejected; a null language is a language; a language and length with
fewer than ``LEAST_CALIBRATED`` calibration documents uses the language's, then the whole calibration set's quantiles, and without
any document nothing is rejected; a document with contradicting labels is not trusted; repeated rows are scored alike, and each
counts as a document; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.llm import spans
from civigrade.llm.blocks import Blocks, arrow_schema, pack, spread, squeezed
from civigrade.session import materialise

ORDER = 5
BYTE = np.uint64(8)
PAIRS = 1 << 16
SHARD_GRAMS = 250_000
#: Blocks that one task of a shard answers; beyond it the shard's counts are repeated.
BLOCKS_PER_SALT = 2_048
CALIBRATION_FOLDS = 5
QUANTILE = 0.99
#: Texts of fewer or more bytes than these powers of two share a class of lengths.
SHORTEST_CLASS, LONGEST_CLASS = 5, 14
LEAST_CALIBRATED = 50
MODEL = "target long, n_symbols int, gram long, n long"
REQUESTS = "target long, block long, shard int, size long, grams binary"
REPLIES = "block long, shard int, logs binary"
SCORES = "block long, place long, doc_id long, lang string, n_bytes long, perplexity double"
TRAIN, CALIBRATE = 1, 2


def grams_of(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For every byte the number made of it and the four bytes before it; bytes before a text's first are zero."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    place = np.arange(len(data)) + np.repeat((ORDER - 1) * np.arange(1, rows + 1), sizes)
    line = np.zeros(len(data) + (ORDER - 1) * rows, dtype=np.uint8)
    line[place] = data
    grams = np.zeros(len(data), dtype=np.uint64)
    for back in range(ORDER - 1, -1, -1):
        grams <<= BYTE
        grams |= line[place - back]
    return grams


def text_grams(texts: pa.ChunkedArray):
    """Offsets of bounded slices of a block's texts with their n-grams."""
    for batch in spans.sliced(pa.table({"text": texts}).to_batches(), "text"):
        offsets, data = spans.buffers(batch.column("text"))
        yield offsets, grams_of(offsets, data)


def distinct_grams(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a block and how often each occurs."""
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, grams in text_grams(texts):
        own, count = np.unique(grams, return_counts=True)
        found.append(own)
        counts.append(count)
    grams, place = np.unique(np.concatenate(found), return_inverse=True)
    return grams, np.bincount(place, np.concatenate(counts), minlength=len(grams)).astype(np.int64)


def shard_numbers(grams: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram, decided by the two bytes before the last."""
    return (spans.mixed((grams >> BYTE) & np.uint64(PAIRS - 1)) % np.uint64(shards)).astype(np.int64)


def in_shards(grams: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted n-grams ordered by shard, and where each shard begins."""
    number = shard_numbers(grams, shards)
    order = np.argsort(number, kind="stable")
    return order, np.searchsorted(number[order], np.arange(shards + 1))


def trusted_roles(blocks: Blocks, labels: DataFrame) -> DataFrame:
    """(block, place, role) of the trusted documents: most teach, one fold calibrates. Only ids are joined."""

    def named(block: int, rows: pa.Table) -> pa.Table:
        ids = rows["doc_id"].cast(pa.int64())
        return pa.table({"block": pa.array(np.full(len(ids), block)), "place": pa.array(np.arange(len(ids))), "doc_id": ids})

    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), F.lit(False))
    trusted = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_and(good).alias("good")).filter("good").drop("good")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % CALIBRATION_FOLDS
    role = F.when(fold == 0, CALIBRATE).otherwise(TRAIN).cast("int")
    return blocks.each(named, "block long, place long, doc_id long").join(trusted, "doc_id").select("block", "place", role.alias("role"))


def gram_counts(blocks: Blocks, roles: DataFrame) -> DataFrame:
    """Counts of all n-grams of the documents that teach."""

    def count(_: int, rows: pa.Table, own: pa.Table) -> pa.Table:
        grams, counts = distinct_grams(rows["text"].take(own["place"]))
        return pa.table({"gram": pa.array(grams.astype(np.int64)), "n": pa.array(counts)})

    counted = blocks.answered(roles.filter(F.col("role") == TRAIN), count, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def shorter(counts: DataFrame, symbols: int) -> DataFrame:
    """Continuation counts of n-grams of ``symbols`` bytes: how many different bytes stand before each."""
    ending = F.col("gram").bitwiseAND(F.lit((1 << 8 * symbols) - 1).cast("long"))
    return counts.groupBy(ending.alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """What modified Kneser-Ney takes from counts of one, two, and three or more."""
    row = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (row[f"n{i}"] or 0 for i in range(1, 5))
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(value, 0.05), i + 0.95) for i, value in enumerate(raw)]


def interpolated(counts: np.ndarray, heads: np.ndarray, taken: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Discounted share of each n-gram in its context, and the mass each context leaves to shorter ones.

    ``heads`` is where each context begins; n-grams are sorted, so those of one context stand together.
    """
    discount = np.asarray(taken)[np.minimum(counts, 3) - 1]
    total = np.add.reduceat(counts, heads).astype(float)
    sizes = np.diff(np.append(heads, len(counts)))
    return (counts - discount) / np.repeat(total, sizes), np.add.reduceat(discount, heads) / total


def short_orders(singles: list, pairs: list, taken: dict[int, list[float]]) -> np.ndarray:
    """Probability of the second byte after the first, for all 65,536 pairs, from the counts of orders one and two."""
    one = np.full(256, 1 / 256)
    if singles:
        grams, counts = (np.array(x, dtype=np.int64) for x in zip(*sorted(singles)))
        share, left = interpolated(counts, np.zeros(1, np.int64), taken[1])
        one *= left[0]
        one[grams] += share
    two = np.tile(one, (256, 1))
    if pairs:
        grams, counts = (np.array(x, dtype=np.int64) for x in zip(*sorted(pairs)))
        contexts, heads = np.unique(grams >> 8, return_index=True)
        share, left = interpolated(counts, heads, taken[2])
        two[contexts] *= left[:, None]
        two[grams >> 8, grams & 255] += share
    return two.ravel()


def probabilities(wanted: np.ndarray, model: dict[int, tuple[np.ndarray, np.ndarray]], two: np.ndarray, taken: dict[int, list[float]]) -> np.ndarray:
    """Interpolated probability of the last byte of each wanted n-gram after the bytes before it."""
    result = two[(wanted & np.uint64(PAIRS - 1)).astype(np.int64)]
    for symbols in range(3, ORDER + 1):
        grams, counts = model.get(symbols, (np.zeros(0, np.uint64),) * 2)
        if not len(grams):
            continue
        contexts, heads = np.unique(grams >> BYTE, return_index=True)
        share, left = interpolated(counts.astype(np.int64), heads, taken[symbols])
        key = wanted & np.uint64((1 << 8 * symbols) - 1)
        at = np.minimum(np.searchsorted(contexts, key >> BYTE), len(contexts) - 1)
        result = result * np.where(contexts[at] == key >> BYTE, left[at], 1.0)
        at = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
        result = result + np.where(grams[at] == key, share[at], 0.0)
    return result


def shard_of(gram: Column, shards: int) -> Column:
    """``shard_numbers`` as a column: the 65,536 values are mapped by a table made by the same function."""
    table = shard_numbers(np.arange(PAIRS, dtype=np.uint64) << BYTE, shards).astype(np.int32)
    pair = F.shiftright(gram, 8).bitwiseAND(F.lit(PAIRS - 1))
    packed = F.lit(bytearray(table.astype(">u4").tobytes()))
    return F.conv(F.hex(F.substring(packed, pair.cast("int") * 4 + 1, F.lit(4))), 16, 10).cast("long")


def sharded_model(orders: dict[int, DataFrame], shards: int, salts: int) -> DataFrame:
    """Counts of orders three to five by target: the shard, once for every salt."""
    together = None
    for symbols in range(3, ORDER + 1):
        own = orders[symbols].select(F.lit(symbols).alias("n_symbols"), "gram", "n")
        together = own if together is None else together.unionByName(own)
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    target = shard_of(F.col("gram"), shards) * salts + F.col("salt")
    return together.withColumn("salt", salt).select(target.cast("long").alias("target"), "n_symbols", "gram", "n")


def log_probabilities(blocks: Blocks, counts: DataFrame) -> tuple[DataFrame, int]:
    """(block, shard, logs) for the distinct n-grams of every block, in their order; and the number of shards."""
    spark = blocks.table.sparkSession
    orders = {ORDER: counts}
    for symbols in range(ORDER - 1, 0, -1):
        orders[symbols] = materialise(shorter(orders[symbols + 1], symbols), f"grams-{symbols}")
    taken = {symbols: discounts(orders[symbols]) for symbols in orders}
    singles, pairs = ([(r["gram"], r["n"]) for r in orders[symbols].collect()] for symbols in (1, 2))  # at most 256 and 65,536 rows
    two = short_orders(singles, pairs, taken)
    shards = min(PAIRS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // SHARD_GRAMS)))
    salts = max(1, -(-blocks.count // BLOCKS_PER_SALT))

    def request(block: int, rows: pa.Table) -> pa.Table:
        grams, _ = distinct_grams(rows["text"])
        order, edges = in_shards(grams, shards)
        grams, used = grams[order], np.flatnonzero(np.diff(edges))
        steps = [np.diff(grams[edges[s] : edges[s + 1]], prepend=np.uint64(0)) for s in used]
        columns = {
            "target": used * salts + spans.mixed(np.full(len(used), block, dtype=np.uint64)).astype(np.int64) % salts,
            "block": np.full(len(used), block),
            "shard": used,
            "size": np.diff(edges)[used],
            "grams": [squeezed(own.view(np.uint8).reshape(-1, 8).T) for own in steps],
        }
        schema = arrow_schema(REQUESTS)
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema)

    def reply(model: pa.Table, asked: pa.Table) -> pa.Table:
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        symbols, grams, counts = (model[name].to_numpy() for name in ("n_symbols", "gram", "n"))
        for n in range(3, ORDER + 1):
            mine = symbols == n
            order = np.argsort(grams[mine])
            own[n] = grams[mine][order].astype(np.uint64), counts[mine][order]
        logs = []
        for packed, size in zip(asked["grams"].to_pylist(), asked["size"].to_pylist()):
            steps = np.ascontiguousarray(spread(packed, np.uint64, size).view(np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
            logs.append(squeezed(np.log(probabilities(np.cumsum(steps, dtype=np.uint64), own, two, taken)).astype(np.float32)))
        return pa.table({"block": asked["block"], "shard": asked["shard"], "logs": pa.array(logs, pa.binary())})

    model = sharded_model(orders, shards, salts)
    requests = blocks.each(request, REQUESTS)
    return model.groupBy("target").cogroup(requests.groupBy("target")).applyInArrow(reply, REPLIES), shards


def perplexities(blocks: Blocks, replies: DataFrame, shards: int) -> DataFrame:
    """Perplexity per byte of every document, named by block and place."""

    def score(block: int, rows: pa.Table, own: pa.Table) -> pa.Table:
        grams, _ = distinct_grams(rows["text"])
        order, edges = in_shards(grams, shards)
        logs = np.zeros(len(grams), dtype=np.float64)
        for shard, packed in zip(own["shard"].to_pylist(), own["logs"].to_pylist()):
            part = order[edges[shard] : edges[shard + 1]]
            logs[part] = spread(packed, np.float32, len(part))
        sums, sizes = [], []
        for offsets, occurring in text_grams(rows["text"]):
            named = pa.array(occurring).dictionary_encode()
            values = logs[np.searchsorted(grams, named.dictionary.to_numpy())][named.indices.to_numpy()]
            total = np.concatenate([[0.0], np.cumsum(values)])
            sums.append(total[offsets[1:]] - total[offsets[:-1]])
            sizes.append(np.diff(offsets))
        sums, sizes = np.concatenate(sums), np.concatenate(sizes)
        with np.errstate(invalid="ignore", divide="ignore"):
            values = np.exp(-sums / sizes)
        return pa.table(
            {
                "block": pa.array(np.full(len(sizes), block)),
                "place": pa.array(np.arange(len(sizes))),
                "doc_id": rows["doc_id"].cast(pa.int64()),
                "lang": rows["lang"].cast(pa.string()),
                "n_bytes": pa.array(sizes),
                "perplexity": pa.array(values, mask=sizes == 0),
            }
        )

    return blocks.answered(replies, score, SCORES)


def judged(scores: DataFrame, roles: DataFrame) -> DataFrame:
    """Scores with the limit that holds for them and ``kept``; a small table of quantiles is joined by language and length."""
    length = F.floor(F.log2(F.greatest("n_bytes", F.lit(1)))).cast("int")
    rows = scores.withColumn("length_class", F.greatest(F.least(length, F.lit(LONGEST_CLASS)), F.lit(SHORTEST_CLASS)))
    calibration = rows.join(roles.filter(F.col("role") == CALIBRATE), ["block", "place"], "left_semi").filter("perplexity IS NOT NULL")
    measures = [F.percentile_approx("perplexity", QUANTILE, 10_000).alias("edge"), F.count(F.lit(1)).alias("n")]
    enough = F.col("n") >= LEAST_CALIBRATED
    by_length = calibration.groupBy("lang", "length_class").agg(*measures).filter(enough)
    by_lang = calibration.groupBy("lang").agg(*measures).filter(enough)
    overall = calibration.agg(*measures).first()["edge"]
    exact = by_length.select(F.col("lang").alias("l1"), F.col("length_class").alias("c1"), F.col("edge").alias("exact"))
    whole = by_lang.select(F.col("lang").alias("l2"), F.col("edge").alias("whole"))
    found = rows.join(exact, F.col("lang").eqNullSafe(F.col("l1")) & (F.col("length_class") == F.col("c1")), "left").join(
        whole, F.col("lang").eqNullSafe(F.col("l2")), "left"
    )
    edge = F.coalesce("exact", "whole", F.lit(overall).cast("double"))
    limited = found.withColumn("limit", edge).drop("l1", "c1", "l2", "exact", "whole", "length_class")
    return limited.withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True)))


def judged_blocks(docs: DataFrame, labels: DataFrame) -> tuple[Blocks, DataFrame]:
    """The packed documents and the written judgement of each, named by block and place."""
    blocks = pack(docs)
    roles = materialise(trusted_roles(blocks, labels), "trusted")
    counts = materialise(gram_counts(blocks, roles), "grams-5")
    replies, shards = log_probabilities(blocks, counts)
    scores = materialise(perplexities(blocks, replies, shards), "perplexities")
    return blocks, judged(scores, roles)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, limit and kept for every row of ``docs`` (doc_id, text, lang)."""
    return judged_blocks(docs.select("doc_id", "text", "lang"), labels)[1].drop("block", "place")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns."""
    blocks, judgement = judged_blocks(docs, labels)
    return blocks.chosen(judgement.filter("kept").select("block", "place"))
