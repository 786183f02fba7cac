"""Near duplicates by SimHash, linked with sharded BK-trees.

A fingerprint has 64 bits; a bit is set if more than half of the document's word shingles have it set in their hash. Two fingerprints
within ``RADIUS`` bits are linked, and documents reachable through links are one component.

A BK-tree keys the children of a node by their Hamming distance to it, so a search follows only the edges within the radius of the
distance it has measured. One tree over all fingerprints would have to be sent everywhere, so the trees are sharded: fingerprints
are cut into four segments, and two within two bits share at least two whole segments. For each of the six pairs of segments, the
fingerprints that share both get a tree of their own; trees and searches meet by a shuffle on the pair's value. A tree holds at most
``TREE_NODES`` fingerprints. Where more share a pair of segments, they are linked through single-bit neighbours instead: two
fingerprints within two bits have a neighbour in common, and no number has more than 65, so these groups stay small whatever the data.

Only distinct fingerprints are linked, with their smallest doc_id; copies of a text never become pairs. Trees emit the links that
join parts of a tree not yet joined, which loses no component. Components come from large-star and small-star rounds over the links,
each written to the shared folder.

Defined results: texts without words (null, empty, blank) have fingerprint zero and are linked like any others; fewer words than a
shingle make one shingle; a null doc_id is never a component's name unless all its ids are null; repeated rows come once each;
further columns are ignored, or kept by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.llm import spans
from civigrade.llm.blocks import Blocks, pack
from civigrade.session import materialise

SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENTS = 4
TREE_NODES = 512
SHARD_KEYS = 50_000
MAX_ROUNDS = 60


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words joined by one blank, repeats included; fewer words are one run."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    together = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return [together[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]


def fingerprints(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every text, as unsigned numbers."""
    result = np.zeros(len(texts), dtype=np.uint64)
    for row, text in enumerate(texts):
        found = shingles((text or "").encode().lower().split(), size)
        if not found:
            continue
        counts = np.zeros(64, dtype=np.int64)
        for start in range(0, len(found), 1 << 16):
            digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in found[start : start + (1 << 16)]])
            bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
        result[row] = np.packbits(counts * 2 > len(found)).view(">u8")[0]
    return result


def row_fingerprints(blocks: Blocks, places: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The ``fingerprint`` of the texts named by ``places`` (node, block, place)."""

    def mark(_: int, rows: pa.Table, own: pa.Table) -> pa.Table:
        texts = rows["text"].cast(pa.binary()).take(own["place"])
        values = fingerprints([None if t is None else t.decode(errors="replace") for t in (text.as_py() for text in texts)], size)
        return pa.table({"node": own["node"], "fingerprint": pa.array(values.view(np.int64))})

    return materialise(blocks.answered(places, mark, "node long, fingerprint long"), "text-fingerprints")


def with_fingerprint(docs: DataFrame, keep: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` and the ``fingerprint`` (its 64 bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.sliced(batches, "hashed_text"):
            values = fingerprints(batch.column("hashed_text").to_pylist(), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values)], names=[*batch.schema.names[1:], "fingerprint"])

    source = docs.select(F.make_valid_utf8(F.col(text)).alias("hashed_text"), *keep)
    return source.mapInArrow(run, source.drop("hashed_text").schema.add("fingerprint", "long"))


class BKTree:
    """Fingerprints by Hamming distance; ``children[node]`` maps a distance to the child at that distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Put a value below the node its distances lead to (the first is the root); returns the node."""
        new, node = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while node != new:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), new)
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` bits from the value; only edges that can lead there are followed."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            below = self.children[node]
            open_nodes += [below[d] for d in range(distance - radius, distance + radius + 1) if d in below]
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of one tree that join parts not joined before (as positions in ``values``)."""
    tree, parent, links = BKTree(), list(range(len(values))), []

    def root(node: int) -> int:
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for value in values:
        near = tree.within(value, radius)
        new = tree.add(value)
        for other in near:
            if root(other) != root(new):
                parent[root(other)] = root(new)
                links.append((other, new))
    return links


def segment(value: Column, number: int) -> Column:
    return F.shiftrightunsigned(value, 16 * number).bitwiseAND(F.lit(0xFFFF).cast("long"))


def segment_keys(values: DataFrame) -> DataFrame:
    """(fp, pair, pair_value) for each of the six pairs of segments."""
    keys = [
        F.struct(F.lit(i).alias("pair"), (F.shiftleft(segment(F.col("fp"), a), 16) + segment(F.col("fp"), b)).alias("pair_value"))
        for i, (a, b) in enumerate(combinations(range(SEGMENTS), RADIUS))
    ]
    return values.select("fp", F.inline(F.array(*keys)))


def shard_links(radius: int):
    """Links of all trees of a shard."""

    def run(rows: pa.Table) -> pa.Table:
        pairs, values, fps = (rows[name].to_numpy() for name in ("pair", "pair_value", "fp"))
        order = np.lexsort((fps, values, pairs))
        pairs, values, fps = pairs[order], values[order], fps[order]
        heads = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (values[1:] != values[:-1])))
        left, right = [], []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(fps)]):
            if b - a > 1:
                for i, j in tree_links(fps[a:b].view(np.uint64).tolist(), radius):
                    left.append(a + i)
                    right.append(a + j)
        return pa.table({"a": pa.array(fps[np.array(left, np.int64)]), "b": pa.array(fps[np.array(right, np.int64)])})

    return run


def neighbour_links(crowded: DataFrame) -> DataFrame:
    """Links between fingerprints that have a single-bit neighbour (or themselves) in common; at most 65 share one."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long") for bit in range(64)])
    neighbours = crowded.select("fp", F.explode(F.transform(flips, lambda flip: F.col("fp").bitwiseXOR(flip))).alias("near"))
    groups = neighbours.groupBy("near").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    return groups.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b")).distinct()


def links(values: DataFrame, count: int, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Enough links (a, b) between the distinct fingerprints ``fp`` of ``values`` to connect all within the radius."""
    keys = segment_keys(values)
    shards = max(1, -(-count * 6 // SHARD_KEYS))
    sizes = keys.groupBy("pair", "pair_value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    sized = materialise(sizes, "pair-sizes")
    same = ["pair", "pair_value"]
    shard = F.pmod(F.xxhash64(*same), F.lit(shards))
    usual = keys.join(sized.filter(F.col("n") <= tree_nodes), same, "left_semi").withColumn("shard", shard)
    trees = usual.groupBy("shard").applyInArrow(shard_links(RADIUS), "a long, b long")
    crowded = keys.join(sized.filter(F.col("n") > tree_nodes), same, "left_semi").select("fp").distinct()
    return trees.unionByName(neighbour_links(crowded)).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the node's least neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the least of them; edges lead from the greater node to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    lower = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """Each linked node (a) with the least node of its component (b)."""
    directed = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    current, mark = materialise(directed, "links"), None
    for _ in range(MAX_ROUNDS):
        summary = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if summary["n"] == 0 or tuple(summary) == mark:
            return current
        mark = tuple(summary)
        current = materialise(small_star(large_star(current)), "stars")
    raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")


def components(fingerprinted: DataFrame, least: Column, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(fp, component): for every distinct fingerprint the least ``least`` over all rows of its component."""
    values = materialise(fingerprinted.groupBy(F.col("fingerprint").alias("fp")).agg(least.alias("own")), "fingerprints")
    roots = stars(links(values, values.count(), tree_nodes)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = values.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("own").alias("component"))
    return rooted.join(names, "root").select("fp", "component")


def clustered(docs: DataFrame, tree_nodes: int = TREE_NODES) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = materialise(with_fingerprint(rows, ["doc_id"]), "document-fingerprints")
    named = components(marked, F.min("doc_id"), tree_nodes)
    joined = marked.join(named, F.col("fingerprint") == F.col("fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def candidate_pairs(fingerprinted: DataFrame, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Pairs (a, b) of nodes that connect all ``fingerprinted`` (node, fingerprint) within the radius, equal ones too."""
    heads = materialise(fingerprinted.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("node").alias("head")), "fingerprints")
    near = links(heads, heads.count(), tree_nodes)
    one, other = (heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_node")) for side in ("a", "b"))
    apart = near.join(one, "a").join(other, "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    same = fingerprinted.join(heads, F.col("fingerprint") == F.col("fp")).filter("node <> head")
    return apart.unionByName(same.select(F.col("head").alias("a"), F.col("node").alias("b")))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id (null last), the first such if it is repeated."""
    blocks = pack(docs)

    def mark(block: int, rows: pa.Table) -> pa.Table:
        texts = [None if t is None else t.decode(errors="replace") for t in rows["text"].cast(pa.binary()).to_pylist()]
        values = fingerprints(texts).view(np.int64)
        return pa.table(
            {"block": pa.array(np.full(len(values), block)), "place": pa.array(np.arange(len(values))), "doc_id": rows["doc_id"].cast(pa.int64()), "fingerprint": pa.array(values)}
        )

    marked = materialise(blocks.each(mark, "block long, place long, doc_id long, fingerprint long"), "document-fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "block", "place"))
    best = components(marked, first).select("component").distinct()
    return blocks.chosen(best.select("component.block", "component.place"))
