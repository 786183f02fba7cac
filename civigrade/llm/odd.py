"""MinHash near duplicates with odd sketches: documents whose sets of word shingles agree to four fifths are linked.

Every set gets ``SAMPLES`` MinHash values. ``BAND_ROWS`` of them at a time make a band key; sets with a key in common are candidates
(at a similarity of 0.8 a pair has none in common once in eight million, (1 - 0.8 ** 5) ** 40). All samples together are folded into
an odd sketch: a bitmap in which each sample turns one bit over. Where two sets have a sample in common its bits cancel, so the
number of bits in which two sketches differ tells the similarity, and most precisely where it is high: 512 bits differ in 69 +- 11 at
0.8 and in 156 at 0.4. Candidates whose sketches differ in more than ``FARTHEST`` bits are left (a link is lost so once in tens of
millions), the others are decided on the words of their whole texts.

Equal sets are folded first, by 128 bits made of real hashes of their words, so copies never become pairs. A band key that more than
``CROWD`` sets share is not paired. Its sets go through an exact prefix filter instead: shingles are ordered by how many of these sets
hold them, rarest first, and two sets alike to four fifths share a shingle among the first few of each, how few following from both
sizes. So keys are made of a shingle and two classes of size. A boilerplate passage lies behind the rare shingles and makes no keys.
Where even such a key is crowded, by copies with small changes, its sets are compared with the one that has fewest rare shingles
before the common one, which is the least changed; the few that are not in its component then are compared with the others, where
positions, sizes and sketches allow a link.

Texts are packed in blocks once. A text is sent once to each block that has to be compared with it.

Defined results: words are runs without ASCII white space, in lower case (A-Z); fewer words than a shingle are one shingle; texts
without words (null, empty, blank) have an empty set and are linked with nothing; a null doc_id names a component only if all its
ids are null, and is not kept; repeated rows come once each; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civigrade.llm import spans, terms
from civigrade.llm.blocks import Blocks, pack
from civigrade.llm.simhash import stars
from civigrade.session import materialise

SHINGLE = 4
#: A similarity of four fifths, as whole numbers, and the share of both sizes together that is common then.
SHARED, OF = 4, 5
BANDS, BAND_ROWS = 40, 5
SAMPLES = BANDS * BAND_ROWS
_SEEDS = spans.mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
FACTORS, SHIFTS = _SEEDS[:SAMPLES] | np.uint64(1), _SEEDS[SAMPLES:]
SKETCH_LONGS = 8
SKETCH_BITS = 64 * SKETCH_LONGS
FARTHEST = 131
CROWD = 32
#: Classes of size to a doubling.
CLASSES = 8
#: Shingles that one count of the crowd's shingles is meant to hold.
BUCKET_SHINGLES = 1_000_000
MARKS = "block long, place long, doc_id long, d1 long, d2 long, size long, keys array<long>, sketch array<long>"
PREFIX = "bucket long, lo int, hi int, node long, size long, position long, own int, sketch array<long>"
KEY = ["bucket", "lo", "hi"]


def word_shingles(text: bytes | None, shingle: int) -> set[bytes]:
    """The distinct shingles of a text, as words joined by one blank."""
    words = (text or b"").lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def similar(one: set[bytes], other: set[bytes]) -> bool:
    common = len(one & other)
    return OF * common >= SHARED * (len(one) + len(other) - common)


def overlap(size, other):
    """The least number of shingles that two similar sets have in common."""
    return -(-SHARED * (size + other) // (SHARED + OF))


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each distinct shingle, and its row, in the order of rows and first hashes."""
    offsets, data = spans.buffers(texts)
    data = terms.LOWER[data]
    inside = ~spans.IS_BLANK[data]
    starts, ends, rows = terms.runs(inside, offsets)
    if not len(starts):
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    hashes = np.stack([spans.word_hashes(data, starts, ends, lane) for lane in (0, 1)], axis=1)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    found, of_row = [], []
    for size in range(1, shingle):  # whole sequences of fewer words
        short = np.flatnonzero(counts == size)
        at = np.searchsorted(rows, short)
        found.append(runs_hashed(hashes, at, size))
        of_row.append(short)
    at = np.flatnonzero(spans.windows_inside(rows, shingle))
    found.append(runs_hashed(hashes, at, shingle))
    of_row.append(rows[at])
    hashes, rows = np.concatenate(found), np.concatenate(of_row)
    # One number to sort by: the row, then as many bits of the hash as are left.
    bits = np.uint64(max(1, (len(offsets) - 1).bit_length()))
    order = np.argsort((rows.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes[:, 0] >> bits))
    hashes, rows = hashes[order], rows[order]
    new = np.append(True, (hashes[1:, 0] != hashes[:-1, 0]) | (rows[1:] != rows[:-1]))[: len(rows)]
    return hashes[new], rows[new]


def runs_hashed(hashes: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """Two hashes of the ``count`` words from each place, order and number included."""
    result = np.full((len(at), 2), count, dtype=np.uint64)
    for step in range(count):
        result *= np.uint64(0x9FB21C651E98DF25)
        result += hashes[at + step]
    return spans.mixed(result)


def set_marks(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: 128 bits of its set, the set's size, its band keys and its odd sketch."""
    hashes, rows = shingle_sets(texts, shingle)
    count = len(texts)
    sizes = np.bincount(rows, minlength=count)
    digests = np.zeros((count, 2), dtype=np.uint64)
    keys, sketches = np.zeros((count, BANDS), dtype=np.uint64), np.zeros((count, SKETCH_LONGS), dtype=np.uint64)
    if not len(rows):
        return digests, sizes, keys, sketches
    heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    filled = rows[heads]
    digests[filled] = spans.mixed(np.add.reduceat(spans.mixed(hashes), heads, axis=0) + sizes[filled, None].astype(np.uint64))
    least = np.empty((SAMPLES, len(filled)), dtype=np.uint64)
    first = np.ascontiguousarray(hashes[:, 0])
    for number in range(SAMPLES):
        np.minimum.reduceat((first ^ SHIFTS[number]) * FACTORS[number], heads, out=least[number])
    band = np.full((BANDS, len(filled)), 1, dtype=np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
    for row in range(BAND_ROWS):
        band = spans.mixed(band * np.uint64(0x9FB21C651E98DF25) + least[row::BAND_ROWS])
    keys[filled] = band.T
    turned = spans.mixed(least + SHIFTS[:, None]) >> np.uint64(64 - 9)
    for number in range(SAMPLES):
        np.bitwise_xor.at(sketches, (filled, (turned[number] >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (turned[number] & np.uint64(63)))
    return digests, sizes, keys, sketches


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix of unsigned numbers as lists of signed ones."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], np.ascontiguousarray(values).view(np.int64).ravel())


def marked(blocks: Blocks, shingle: int) -> DataFrame:
    """Set, size, band keys and sketch of every row, named by block and place."""

    def mark(block: int, rows: pa.Table) -> pa.Table:
        texts = pa.table({"text": rows["text"]}).to_batches()
        found = [set_marks(batch.column("text"), shingle) for batch in spans.sliced(texts, "text")]
        digests, sizes, keys, sketches = (np.concatenate(x) for x in zip(*found))
        return pa.table(
            {
                "block": pa.array(np.full(len(sizes), block)), "place": pa.array(np.arange(len(sizes))), "doc_id": rows["doc_id"].cast(pa.int64()),
                "d1": pa.array(digests[:, 0].copy().view(np.int64)), "d2": pa.array(digests[:, 1].copy().view(np.int64)),
                "size": pa.array(sizes.astype(np.int64)), "keys": lists(keys), "sketch": lists(sketches),
            }
        )

    return materialise(blocks.each(mark, MARKS), "set-marks")


def distinct_sets(marks: DataFrame) -> DataFrame:
    """Each set that is not empty once, with a number (node), its size, keys and sketch, and the row that stands for it (own)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "block", "place")).alias("own")
    rest = [F.first(c).alias(c) for c in ("size", "keys", "sketch")]
    sets = marks.filter("size > 0").groupBy("d1", "d2").agg(first, *rest)
    return materialise(sets.withColumn("node", F.monotonically_increasing_id()), "sets")


def differing(one: str, other: str) -> str:
    """The number of bits in which two sketches differ."""
    return " + ".join(f"bit_count({one}.sketch[{i}] ^ {other}.sketch[{i}])" for i in range(SKETCH_LONGS))


def able(one: str, other: str) -> str:
    """Whether sizes and sketches of two sets allow the similarity."""
    sizes = f"{OF} * least({one}.size, {other}.size) >= {SHARED} * greatest({one}.size, {other}.size)"
    return f"{sizes} AND {differing(one, other)} <= {FARTHEST}"


def in_reach(one: str, other: str) -> str:
    """Whether the places of a common shingle still allow the similarity: no more than the shingles from there on can be common."""
    needed = f"ceil({SHARED} * ({one}.size + {other}.size) / {SHARED + OF})"
    both = f"least({one}.size - {one}.position, {other}.size - {other}.position) >= {needed}"
    return f"({one}.lo = {one}.hi OR {one}.own <> {other}.own) AND {both}"


def bucket_pairs(members: DataFrame, key: list[str], allowed: str) -> DataFrame:
    """All allowed pairs (a, b) of buckets that are small."""
    columns = [c for c in members.columns if c != "node"]
    listed = members.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("node", *columns))).alias("m"))
    inner = f"transform(filter(slice(m, i + 2, size(m)), y -> {allowed}), y -> struct(x.node AS a, y.node AS b))"
    return listed.select(F.expr(f"inline(flatten(transform(m, (x, i) -> {inner})))"))


def shared_keys(sets: DataFrame) -> DataFrame:
    """Band keys that several sets have (bucket), with their number n, by set."""
    keys = sets.select("node", F.explode("keys").alias("bucket"))
    counts = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return materialise(keys.join(counts, "bucket"), "shared-keys")


def size_class(size: int) -> int:
    return int(CLASSES * math.log2(size))


def frequencies(blocks: Blocks, members: DataFrame, shingle: int) -> DataFrame:
    """How many of ``members`` hold each shingle that several hold: (block, tokens, dfs), for the shingles of each block.

    A block asks for its distinct shingles with their counts, in sorted arrays by range of the hash; so a shingle that all members
    hold is one number for each block.
    """
    total = members.agg(F.sum("size")).first()[0]
    buckets = np.uint64(min(1 << 30, -(-total // BUCKET_SHINGLES)))

    def ask(block: int, rows: pa.Table, own: pa.Table) -> pa.Table:
        hashes, _ = shingle_sets(rows["text"].take(own["place"]), shingle)
        found, counts = np.unique(hashes[:, 0], return_counts=True)
        of_bucket = ((found >> np.uint64(32)) * buckets >> np.uint64(32)).astype(np.int64)
        heads = np.flatnonzero(np.diff(of_bucket, prepend=-1))
        edges = np.append(heads, len(found)).astype(np.int32)
        columns = {"bucket": pa.array(of_bucket[heads]), "block": pa.array(np.full(len(heads), block))}
        return pa.table(columns | {"tokens": pa.ListArray.from_arrays(edges, found.view(np.int64)), "counts": pa.ListArray.from_arrays(edges, counts)})

    def count(rows: pa.Table) -> pa.Table:
        tokens, counts = (pc.list_flatten(rows[name]).to_numpy() for name in ("tokens", "counts"))
        found, place = np.unique(tokens, return_inverse=True)
        totals = np.zeros(len(found), dtype=np.int64)
        np.add.at(totals, place, counts)
        totals = totals[place]
        of_row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["tokens"]).to_numpy())
        several = totals > 1
        edges = np.searchsorted(of_row[several], np.arange(rows.num_rows + 1)).astype(np.int32)
        kept = {"tokens": tokens[several], "dfs": totals[several]}
        return pa.table({"block": rows["block"]} | {name: pa.ListArray.from_arrays(edges, values) for name, values in kept.items()})

    asked = blocks.answered(members.select("block", "place"), ask, "bucket long, block long, tokens array<long>, counts array<long>")
    return asked.groupBy("bucket").applyInArrow(count, "block long, tokens array<long>, dfs array<long>")


def prefixes(blocks: Blocks, members: DataFrame, shingle: int) -> DataFrame:
    """Keys of the exact filter for all ``members`` (node, size, sketch, block, place)."""

    def keyed(_: int, rows: pa.Table, own: pa.Table) -> pa.Table:
        tokens, dfs = (np.concatenate([np.zeros(0, np.int64), *own[name].drop_null().to_pylist()]).astype(np.int64) for name in ("tokens", "dfs"))
        order = np.argsort(tokens)
        tokens, dfs = tokens[order], dfs[order]
        own = own.filter(pc.is_valid(own["place"]))
        hashes, of_row = shingle_sets(rows["text"].take(own["place"]), shingle)
        found = hashes[:, 0].copy().view(np.int64)
        at = np.minimum(np.searchsorted(tokens, found), max(len(tokens) - 1, 0))
        # Shingles that no other member has come first and only count as positions.
        common = tokens[at] == found if len(tokens) else np.zeros(len(found), dtype=bool)
        found, of_row, df = found[common], of_row[common], dfs[at[common]] if len(tokens) else found[common]
        order = np.lexsort((found, df, of_row))
        found, edges = found[order], np.searchsorted(of_row, np.arange(own.num_rows + 1))
        out = {name: [] for name in ("bucket", "lo", "hi", "row", "position")}
        for row, size in enumerate(own["size"].to_pylist()):
            rare = size - int(edges[row + 1] - edges[row])
            mine, smallest = size_class(size), -(-SHARED * size // OF)
            for other in range(size_class(smallest), size_class(OF * size // SHARED) + 1):
                least = max(smallest, int(2 ** (other / CLASSES)))
                count = size - overlap(size, least) + 1 - rare
                for i, token in enumerate(found[edges[row] : edges[row] + max(0, min(count, size - rare))].tolist()):
                    for name, value in zip(out, (token, min(mine, other), max(mine, other), row, rare + i)):
                        out[name].append(value)
        taken = own.select(["node", "size", "sketch"]).take(pa.array(out["row"], pa.int64()))
        classes = [size_class(size) for size in taken["size"].to_pylist()]
        columns = {"bucket": pa.array(out["bucket"], pa.int64()), "lo": pa.array(out["lo"], pa.int32()), "hi": pa.array(out["hi"], pa.int32())}
        columns |= {"node": taken["node"], "size": taken["size"], "position": pa.array(out["position"], pa.int64())}
        return pa.table(columns | {"own": pa.array(classes, pa.int32()), "sketch": taken["sketch"]})

    members = materialise(members, "crowd")
    known = members.unionByName(materialise(frequencies(blocks, members, shingle), "crowd-shingles"), allowMissingColumns=True)
    keys = materialise(blocks.answered(known, keyed, PREFIX), "prefix-keys")
    counts = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("position", "node", "size", "sketch", "own", "lo", "hi")).alias("hub")).filter("n > 1")
    return materialise(keys.join(counts, KEY), "shared-prefixes")


def verified(blocks: Blocks, pairs: DataFrame, where: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar, decided on their words; ``where`` has each node's block and place."""

    def text_of(_: int, rows: pa.Table, own: pa.Table) -> pa.Table:
        return pa.table({"a": own["a"], "a_text": rows["text"].cast(pa.binary()).take(own["place"])})

    def decide(_: int, rows: pa.Table, own: pa.Table) -> pa.Table:
        texts, kept, held = rows["text"].cast(pa.binary()), [], {}
        for a, a_text, others in zip(own["a"].to_pylist(), own["a_text"], own["others"].to_pylist()):
            one = word_shingles(a_text.as_py(), shingle)
            for other in others:
                if other["place"] not in held:
                    held[other["place"]] = word_shingles(texts[other["place"]].as_py(), shingle)
                if similar(one, held[other["place"]]):
                    kept.append((a, other["b"]))
        return pa.table({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})

    pairs = materialise(pairs, "candidate-pairs")
    wanted = where.join(pairs.select(F.col("a").alias("node")).distinct(), "node").withColumnRenamed("node", "a")
    texts = materialise(blocks.answered(wanted, text_of, "a long, a_text binary"), "asked-texts")
    located = pairs.join(where.withColumnRenamed("node", "b"), "b")
    asked = located.groupBy("block", "a").agg(F.collect_list(F.struct("b", "place")).alias("others")).join(texts, "a")
    return materialise(blocks.answered(asked, decide, "a long, b long"), "similar-pairs")


def crowd_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs of the exact filter: all of small buckets, and of the least changed set with the others in crowded ones."""
    few = bucket_pairs(keyed.filter(F.col("n") <= CROWD).drop("n", "hub"), KEY, f"{in_reach('x', 'y')} AND {able('x', 'y')}")
    many = keyed.filter((F.col("n") > CROWD) & (F.col("node") != F.col("hub.node"))).withColumn("x", F.struct("size", "sketch", "lo", "hi", "own", "position"))
    # The hub is compared with members of its own class too: what is not yet linked need not differ in class from it.
    stars_of = many.filter(able("x", "hub")).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    return few.unionByName(stars_of).distinct()


def stray_pairs(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of crowded buckets that could still join two components; one of the two is not in its hub's component."""
    roots = stars(links).select(F.col("a").alias("node"), F.col("b").alias("root"))
    hubs = roots.select(F.col("node").alias("hub_node"), F.col("root").alias("hub_root"))
    crowded = keyed.filter(F.col("n") > CROWD).withColumn("hub_node", F.col("hub.node")).drop("hub", "n")
    rooted = crowded.join(roots, "node", "left").join(hubs, "hub_node", "left")
    members = rooted.withColumns({"root": F.coalesce("root", "node"), "hub_root": F.coalesce("hub_root", "hub_node")}).drop("hub_node")
    members = materialise(members, "crowds")
    strays = members.filter("root <> hub_root")
    one, other = members.alias("x"), strays.alias("y")
    same = " AND ".join(f"x.{c} = y.{c}" for c in KEY)
    met = one.join(other, F.expr(f"{same} AND x.root <> y.root AND {in_reach('x', 'y')} AND {able('x', 'y')}"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def linked(blocks: Blocks, sets: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) that connect all similar sets."""
    where = sets.select("node", "own.block", "own.place")
    shared = shared_keys(sets)
    few = shared.filter(F.col("n") <= CROWD).select("bucket", "node").join(sets.select("node", "size", "sketch"), "node")
    links = verified(blocks, bucket_pairs(few, ["bucket"], able("x", "y")).distinct(), where, shingle)
    crowd = shared.filter(F.col("n") > CROWD).select("node").distinct()
    if crowd.isEmpty():
        return links
    members = sets.select("node", "size", "sketch", "own.block", "own.place").join(crowd, "node")
    keyed = prefixes(blocks, members, shingle)
    known = links.unionByName(verified(blocks, crowd_pairs(keyed), where, shingle))
    if keyed.filter(F.col("n") > CROWD).isEmpty():
        return known
    return known.unionByName(verified(blocks, stray_pairs(keyed, known), where, shingle))


def rooted_sets(blocks: Blocks, sets: DataFrame, shingle: int, known: DataFrame | None = None) -> DataFrame:
    """The sets with ``root``, the same for all that are reachable through links; ``known`` links (a, b) count too."""
    links = linked(blocks, sets, shingle)
    roots = stars(links if known is None else known.unionByName(links)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    return sets.select("node", "d1", "d2", "own").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def clustered(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    blocks = pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    marks = marked(blocks, shingle)
    rooted = materialise(rooted_sets(blocks, distinct_sets(marks), shingle), "rooted-sets")
    names = rooted.groupBy("root").agg(F.min("own.doc_id").alias("component_id"))
    named = rooted.join(names, "root").select("d1", "d2", "component_id")
    rows = marks.select("doc_id", F.col("size").alias("n_shingles"), "d1", "d2")
    full = rows.filter("n_shingles > 0").join(named, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    bare = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def representatives(docs: DataFrame, shingle: int, first_links: Callable[[Blocks, DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id (null last), the first such if it is repeated.

    All texts without words are one component here. ``first_links(blocks, sets)`` gives links found another way, which count too.
    """
    blocks = pack(docs)
    marks = marked(blocks, shingle)
    sets = distinct_sets(marks)
    rooted = rooted_sets(blocks, sets, shingle, None if first_links is None else first_links(blocks, sets))
    best = rooted.groupBy("root").agg(F.min("own").alias("best")).select("best.block", "best.place")
    bare = marks.filter("size = 0").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "block", "place")).alias("best")).filter("best IS NOT NULL")
    return blocks.chosen(best.unionByName(bare.select("best.block", "best.place")))
